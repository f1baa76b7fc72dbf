"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sphygmo.llm.common import WORD, blocked_rank, blocks_for, table, written

#: Sources in order of their names weigh 5, 2, 1, 5, 2, 1, ...
WEIGHTS = (5, 2, 1)
#: Rows that agree in doc_id, source and size which share their copies in one task.
SHARED = 4096


def with_targets(sources: DataFrame, share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): ``share`` of all sizes dealt by weight, no target above
    ``most`` times its source's size, the excess dealt again by weight until none is above.

    Each round is one aggregate over the sources (two sums reach the driver); a source that is full stays full, so
    the level only rises and the rounds end when no source becomes full.
    """
    cap = F.col("source_size") * F.lit(most)
    level, full = Fraction(0), -1
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = min(share * total, Fraction(most) * total)
    while True:
        over = cap <= F.col("weight") * F.lit(float(level))
        n, taken, weight = sources.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not weight:
            break
        full, level = n, (budget - (taken or 0)) / weight
    return sources.withColumn("target", F.round(F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))), 6))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken.

    Each document of a source is expected ``target / source_size`` times. Within a source the documents stand by size
    class (16 to an octave) and, inside a class, by a hash of doc_id; the running sum of the expected copies plus one
    random offset (a hash of the seed and the source) gives the copies: one for each integer boundary crossed. As sizes
    rise along the sum, the words taken are off by about the largest document at most. Places along the sums come from a
    sort by range over all tasks, so that neither a source nor a document with a third of all rows is a single task.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last in order. Equal doc_ids and repeated
    rows are documents of their own; rows that tie in all of (doc_id, size, source) are interchangeable. No rows: no rows.
    Columns besides doc_id, source and text are ignored.
    """
    sized = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source here; the number of sources does not follow the number of documents
    place = F.row_number().over(ordered) - 1
    chosen = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = with_targets(written(by_source.withColumn("weight", chosen.cast("long")), "mix-sources"), share, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    sources = sources.withColumn("offset", offset)

    classed = sized.withColumn("class", F.when(F.col("size") > 0, F.floor(16 * F.log2(F.col("size") + 0.5))).otherwise(F.lit(-1)).cast("int"))
    ranked = blocked_rank(classed, ["source", "class"], ["doc_id", "size"], "rank", "n", blocks_for(sized))
    classes = classed.groupBy("source", "class").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(F.col("source").alias("s"), F.col("class").alias("c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    per_class = classes.join(sources, F.col("s").eqNullSafe(F.col("source"))).select("s", "c", "before", "source_size", "target", "offset")
    # (source, class) rows: at most a few hundred for each source
    joined = ranked.join(per_class, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    rate = F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(F.col("target") / F.col("source_size"))
    rate = F.when(F.col("source_size") > 0, rate).otherwise(F.lit(0.0))
    place = F.col("before") + F.col("rank")
    copies = F.floor((place + 1) * rate + F.col("offset")) - F.floor(place * rate + F.col("offset"))
    return joined.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as :func:`mix` takes it; order is free.

    The plan goes back to the documents by (doc_id, source, size); rows that agree in all three share their copies
    evenly: where there are more than SHARED of them, they are dealt to parts, each of which takes its share, so that none of
    them meets in one task. Documents without words add nothing to a mix and are kept or left out like all others.
    """
    plan = mix(docs, **options).groupBy(F.struct("doc_id", "source", "size").alias("key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # a document is one struct here, so its columns may have any names
    keyed = docs.select(F.struct("*").alias("row"), F.struct("doc_id", "source", size.alias("size")).alias("key"), F.monotonically_increasing_id().alias("number")).join(plan.filter("copies > 0"), "key")
    parts = F.ceil(F.col("n") / SHARED)
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("number"), parts))
    # a part starts somewhere between two copies, so that all parts together take as many as they should
    start = F.when(parts > 1, F.pmod(F.xxhash64("key", "part"), F.lit(1 << 20)) / float(1 << 20)).otherwise(0.0)
    rate = F.col("copies") / F.col("n")
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("number")) - 1
    # copies / n of whole numbers: floor((place + 1) * copies / n) where there is one part
    upto = lambda p: F.when(parts > 1, F.floor(p * rate + start)).otherwise(F.floor(p * F.col("copies") / F.col("n")))
    taken = keyed.withColumn("own", (upto(place + 1) - upto(place)).cast("int")).filter("own > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all ``documents`` takes of each."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


#: The same mix in DuckDB: water level from the sources sorted by cap to weight, ranks over whole sources.
OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sized GROUP BY source
), ratio AS (
  SELECT *, 2.0 * source_size / weight AS full_at FROM src
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratio
), water AS (
  SELECT arg_min(level, full_at) AS level FROM levels WHERE level <= full_at
), targets AS (
  SELECT source, source_size, round(least(CAST(2 * source_size AS DOUBLE), weight * coalesce(water.level, 1e300)), 6) AS target,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce('=' || source, 'null')), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS off
  FROM src, water
), placed AS (
  SELECT doc_id, source, size, CASE WHEN size > 0 THEN CAST(floor(16 * log2(size + 0.5)) AS INTEGER) ELSE -1 END AS class,
    CAST('0x' || substr(md5(concat_ws(':', doc_id, size)), 1, 8) AS UBIGINT) % (SELECT greatest(64, count(*) // 100000) FROM sized) AS block FROM sized
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, block, doc_id, size) - 1 AS place FROM placed
), rated AS (
  SELECT r.*, source_size, target, off, CASE WHEN source_size = 0 THEN 0.0 WHEN target >= 2 * source_size THEN 2.0 ELSE target / source_size END AS rate
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, source, CAST(floor((place + 1) * rate + off) - floor(place * rate + off) AS BIGINT) AS copies,
  CAST(floor((place + 1) * rate + off) - floor(place * rate + off) AS BIGINT) * size AS taken FROM rated
"""
