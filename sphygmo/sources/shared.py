"""Tables on the way: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Keep = Callable[[DataFrame, str], DataFrame]


def staged(folder: str) -> Keep:
    """Writes each step's table under ``folder`` and reads it again, so that no step is computed twice and a lost executor
    costs one step."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


def matched(a: DataFrame, b: DataFrame, on: str | list[str] = "recording_id", how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the recordings: sorted and merged. A table that was written is many times the
    size of its files, by which it would else be thought small enough to be gathered at the driver and sent to every executor."""
    return a.join(b.hint("merge"), on, how)


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir); a temporary one where Spark runs on this
    machine alone. RuntimeError on a cluster without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-steps-")
    return f"{found.rstrip('/')}/steps-{uuid.uuid4().hex}"
