"""Connected components, and grouped work in a stream: shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sphygmo.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b): the smallest node it can reach.

    Large-star and small-star rounds: each links nodes to the smallest node they know, until nothing changes. A round
    is two joins and partial minima; the edges are written after each. Hubs are join keys that Spark can split.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = written(small.filter("a > b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def by_group(df: DataFrame, key: str, work: Callable[[pa.Table], list[tuple]], schema: StructType | str, most: int = 4096) -> DataFrame:
    """Rows of ``work`` for the rows of each value of ``key``, brought together by hash and streamed in order.

    ``work`` gets one group as a table; groups are of bounded size by what the callers make them of.
    """
    if isinstance(schema, str):
        from pyspark.sql.types import _parse_datatype_string

        schema = _parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, out = None, []
        for b in batches:
            keys = b.column(0).to_pylist()
            start = 0
            for k, value in enumerate(keys):
                if value != now:
                    if k > start:
                        held.append(b.slice(start, k - start))
                    if held:
                        out += work(pa.Table.from_batches(held))
                        while len(out) >= most:
                            yield batch(out[:most])
                            out = out[most:]
                    held, now, start = [], value, k
            if len(keys) > start:
                held.append(b.slice(start))
        if held:
            out += work(pa.Table.from_batches(held))
        for k in range(0, len(out), most):
            yield batch(out[k : k + most])

    ordered = df.select(key, *[c for c in df.columns if c != key]).repartition(key).sortWithinPartitions(key)
    return ordered.mapInArrow(run, schema)
