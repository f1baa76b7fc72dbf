"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so (upper and lower case alike)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def segments(texts: list[str], rows: int, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of segments of at most ``rows`` texts and, unless one text alone has more, ``chars`` characters."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if k > start and (k - start == rows or size + len(t) > chars):
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def id_filter(rows: DataFrame, ids: DataFrame, key: str, words: int = 1 << 18) -> DataFrame:
    """``rows`` and ``_perhaps``: whether their long ``key`` may be among ``ids``; false for none that is.

    One hash of 64 * ``words`` bits, so of a size that does not grow with ``ids`` and can be broadcast. With more ids
    than bits it says yes to all. Null keys: false.
    """
    hashed = F.xxhash64(F.col(key).cast("long"))
    word, bit = F.pmod(F.shiftright(hashed, 6), F.lit(words)), F.pmod(hashed, F.lit(64)).cast("int")
    bits = ids.filter(F.col(key).isNotNull()).select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    marked = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(bits), "_word", "left")
    hit = F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False)) & F.col(key).isNotNull()
    return marked.withColumn("_perhaps", hit).drop("_word", "_bit", "_bits")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one of this
    machine if Spark runs on it alone; RuntimeError on a cluster, where the executors would not see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, total: str) -> DataFrame:
    """Adds ``rank``, the 0-based place of each row in its group by ``order`` (nulls first), and ``total``, the group's rows.

    Rows are sorted by range over all tasks, equal ones by their number in a written table, so neither a hot group nor
    a row repeated in a third of the table meets in one task. Places follow from the few counts of (task, group).
    ``group`` columns may be null.
    """
    rows = written(df, "rank-rows").withColumn("_row", F.monotonically_increasing_id())
    by = [*group, *order, "_row"]
    rows = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id()), "rank-sorted")
    rows = rows.withColumn("_g", F.struct(*group)).withColumn("_task", F.shiftright("_at", 33))
    counts = rows.groupBy("_g", "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_g", "_task", "_first", before.alias("_before"), F.sum("_n").over(w).alias(total))
    return rows.join(counts, ["_g", "_task"]).withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_g", "_task", "_at", "_first", "_before")


def blocked_rank(df: DataFrame, group: list[str], ties: list[str], rank: str, total: str, blocks: int = 64) -> DataFrame:
    """:func:`ranked` by a hash of ``ties`` in so many blocks, then ``ties``: an order that has nothing to do with the values,
    the same on every run."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", *ties)), 1, 8), 16, 10).cast("long")
    return ranked(df.withColumn("_b", F.pmod(hashed, F.lit(blocks))), group, ["_b", *ties], rank, total).drop("_b")


def blocks_for(df: DataFrame, rows: int = 100_000) -> int:
    """Hash blocks of about ``rows`` each in a group that has all rows of ``df``; 64 at least."""
    return max(64, df.count() // rows)


def crc32_sql(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a value's text in ASCII, bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), lambda c, k: {bit}, xor(r, b))"
    return f"xor(list_reduce(list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda r, b: {byte}, 4294967295), 4294967295)"
