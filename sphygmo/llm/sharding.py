"""Resharding that moves the fewest bytes: a minimum-cost flow from old shard sizes to new capacities."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sphygmo.llm.common import shared_folder, table, written

#: Hash blocks of texts over all old shards; a block moves as a whole, so equal texts stay together.
BLOCKS = 6144
#: Shards of the layout that op9 starts from, and of the one it makes.
OLD, NEW = 6, 8
#: Bytes of text in a file of a layout.
FILE = 128 << 20


def transfers(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j, all of ``sizes`` placed, no more than ``capacities``, fewest moved.

    A minimum-cost flow (cost 0 from shard i to shard i, else 1 a byte) by successive cheapest paths over the
    network of shards alone; its size is the number of shards, never that of the data.
    """
    n, m = len(sizes), len(capacities)
    source, sink = n + m, n + m + 1
    room: dict[tuple[int, int], int] = {}
    cost: dict[tuple[int, int], int] = {}

    def edge(a: int, b: int, most: int, price: int) -> None:
        room[a, b], cost[a, b], room[b, a], cost[b, a] = most, price, 0, -price

    for i, s in enumerate(sizes):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, int(i != j))
    for j, c in enumerate(capacities):
        edge(n + j, sink, c, 0)
    while True:
        far: dict[int, int] = {source: 0}
        via: dict[int, int] = {}
        for _ in range(n + m + 1):
            for (a, b), left in room.items():
                if left and a in far and far[a] + cost[a, b] < far.get(b, 1 << 60):
                    far[b], via[b] = far[a] + cost[a, b], a
        if sink not in far:
            break
        path, at = [], sink
        while at != source:
            path.append((via[at], at))
            at = via[at]
        step = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= step
            room[b, a] += step
    return {(i, j): room[n + j, i] for i in range(n) for j in range(m) if room[n + j, i]}


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def old_layout(sized: DataFrame, shards: int = OLD) -> Column:
    """The shard of a layout by hash of the text's checksum."""
    return F.pmod(F.xxhash64(F.lit("old"), "text_crc32", "size"), F.lit(shards)).cast("int")


def resharding(sized: DataFrame, new: int = NEW, blocks: int = BLOCKS) -> Callable[[DataFrame], DataFrame]:
    """What adds ``shard`` to rows (doc_id, size, text_crc32, old_shard, ...) like those of ``sized``: sizes near equal, fewest bytes moved.

    Each old shard's rows fall into hash blocks of their texts. The blocks stand by falling bytes; the first bytes of
    that order stay, the next go to the new shards that the flow names, and a block goes where its middle byte falls.
    Large blocks thus stay and the cut is among small ones. Only a block beyond half a new shard (a text repeated so
    often, or one so long) is split by doc_id before. No rows: no rows. The table of blocks is bounded by their number, so rows
    find their shard where they are.
    """
    total, *_ = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    if not total:
        return lambda rows: rows.withColumn("shard", F.lit(0))
    sizes = [0] * (1 + max(r[0] for r in sized.select("old_shard").distinct().collect()))
    for shard, size in sized.groupBy("old_shard").agg(F.sum("size")).collect():  # a row for each old shard
        sizes[shard] = size
    moves = transfers(sizes, even(total, new))
    block = F.pmod(F.xxhash64("text_crc32", "size"), F.lit(blocks)).cast("int")
    heavy = sized.withColumn("_block", block).groupBy("old_shard", "_block").agg(F.sum("size").alias("_bytes")).filter(F.col("_bytes") > total // new // 2)
    # heavy blocks: 2 * new at most, as each holds more than a half of a new shard's bytes
    heavy = F.broadcast(heavy.select("old_shard", "_block", F.lit(True).alias("_heavy")))

    def keyed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_block", block).join(heavy, ["old_shard", "_block"], "left")
        return rows.withColumn("_sub", F.when(F.col("_heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(1024))).otherwise(F.lit(0)).cast("int")).drop("_heavy")

    units = keyed(sized).groupBy("old_shard", "_block", "_sub").agg(F.sum("size").alias("_bytes"))
    w = Window.partitionBy("old_shard").orderBy(F.desc("_bytes"), "_block", "_sub")
    middle = F.sum("_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bytes") / 2
    to = F.lit(None).cast("int")
    for i in range(len(sizes)):
        bounds, at = [], 0
        for j in sorted(range(new), key=lambda j: (j != i, j)):  # what stays comes first
            if (i, j) in moves:
                at += moves[i, j]
                bounds.append((at, j))
        pick = F.lit(bounds[-1][1] if bounds else 0)
        for at, j in reversed(bounds[:-1]):
            pick = F.when(F.col("_middle") <= at, F.lit(j)).otherwise(pick)
        to = F.when(F.col("old_shard") == i, pick).otherwise(to)
    units = F.broadcast(written(units.withColumn("_middle", middle).withColumn("shard", to.cast("int")).select("old_shard", "_block", "_sub", "shard"), "shard-units"))
    return lambda rows: keyed(rows).join(units, ["old_shard", "_block", "_sub"]).drop("_block", "_sub")


def shard_documents(docs: DataFrame, old: int = OLD, new: int = NEW) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for each row of ``docs``, read back from a layout of ``new`` shards.

    ``docs`` are stored as a layout of ``old`` shards, and its affected shards are written again; both layouts stand in the
    shared folder. Size is the text's UTF-8 bytes plus 1; null text has no bytes and checksum 0. Repeated rows are rows of their own.
    """
    folder = f"{shared_folder(docs.sparkSession)}/layouts-{uuid.uuid4().hex}"
    manifest = rewrite(store(docs, f"{folder}/old", old), f"{folder}/new", new)
    if manifest.isEmpty():
        rows = docs.limit(0).select(F.struct("*").alias("row"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard"))
    else:
        rows = read_layout(manifest)
    sized = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), *_sized(F.col("row.text")), "shard", "slot")
    return sized.select("doc_id", "size", "text_crc32", old_layout(sized, old).alias("old_shard"), "shard", "slot")


def moved_bytes(placed: DataFrame) -> int:
    """Bytes of the rows of :func:`shard_documents` that change their shard."""
    return placed.agg(F.coalesce(F.sum(F.when(F.col("shard") != F.col("old_shard"), F.col("size"))), F.lit(0))).first()[0]


def _sized(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def _store(rows: DataFrame, folder: str) -> list[tuple[int, str]]:
    """Writes rows (row, shard), one folder a shard, and says which shards are there.

    Beside ``row`` stands ``at``: the task and the place in it. A task's rows of a shard have places next to each other, so
    slots follow from a count for each task and shard.
    """
    made = rows.select("row", "shard", F.monotonically_increasing_id().alias("at"))
    made.write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    found = rows.sparkSession.read.schema("at long, shard int").parquet(folder)
    return [(k, f"{folder}/shard={k}") for (k,) in found.select("shard").distinct().collect()]


def store(docs: DataFrame, folder: str, shards: int = OLD) -> DataFrame:
    """Writes ``docs`` as a new layout of ``shards`` shards under ``folder``; the layout's manifest (shard, path).

    ``folder`` must not exist. A document is the struct ``row``, so that its columns may have any names; a row is named by its
    shard and slot, whatever its doc_id: null and repeated doc_ids are rows of their own. Each task writes its own rows, a file
    for each shard.
    """
    rows = docs.select(F.struct("*").alias("row"), *_sized(F.col("text")))
    return _manifest(docs.sparkSession, _store(rows.withColumn("shard", old_layout(rows, shards)).sortWithinPartitions("shard"), folder))


def _manifest(spark: SparkSession, paths: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(sorted(paths), "shard int, path string")


def _written_rows(manifest: DataFrame) -> DataFrame:
    """(row, at, shard) of all documents that the manifest's folders hold; the shards are few."""
    parts = [manifest.sparkSession.read.parquet(path).withColumn("shard", F.lit(shard)) for shard, path in manifest.select("shard", "path").collect()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_layout(manifest: DataFrame) -> DataFrame:
    """(row, slot, shard) of all documents of a layout; ``slot`` is the place in the shard, gapless from 0."""
    rows = _written_rows(manifest)
    task = F.shiftright("at", 33)
    counts = rows.groupBy("shard", task.alias("_task")).agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = rows.withColumn("_task", task).join(F.broadcast(counts), ["shard", "_task"])
    return placed.select("row", (F.col("at") + F.col("_shift")).alias("slot"), "shard")


def rewrite(manifest: DataFrame, folder: str, new: int = NEW) -> DataFrame:
    """Rewrites an existing layout to ``new`` shards: only the shards that gain or lose rows; the new manifest.

    The affected shards are written whole under ``folder``, which must not exist, in files of about FILE bytes, and the manifest
    then names the new folders for these and the old ones for the others; old folders are not changed, so a lost executor or a
    failed run leaves the old layout as it was. An empty layout stays as it is.
    """
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return manifest
    keys = _written_rows(manifest).select("row", "at", F.col("row.doc_id").cast("long").alias("doc_id"), *_sized(F.col("row.text")), F.col("shard").alias("old_shard"))
    sized = written(keys.drop("row", "at"), "shard-sizes")
    placing = resharding(sized, new)
    flows = placing(sized).groupBy("old_shard", "shard").agg(F.sum("size")).collect()  # of few shards
    touched = {s for old, to, _ in flows if old != to for s in (old, to)}
    held = {to for _, to, _ in flows}
    if touched:
        files = max(1, -(-max(sum(size for _, to, size in flows if to == s) for s in touched) // FILE))
        rows = placing(keys.filter(F.col("old_shard").isin(*touched))).repartition("shard", F.pmod(F.xxhash64("old_shard", "at"), F.lit(files)))
        _store(rows.sortWithinPartitions("shard", "doc_id", "text_crc32", "size"), folder)
    paths = {s: p for s, p in manifest.select("shard", "path").collect() if s in held} | {s: f"{folder}/shard={s}" for s in touched & held}
    return _manifest(spark, list(paths.items()))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents resharded from a layout by hash to eight shards of near equal bytes; ``old_shard`` is where each was."""
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
