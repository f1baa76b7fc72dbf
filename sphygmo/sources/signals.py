"""Signals as long tables (recording_id, idx, v), bound to the event tables; and their packed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def by_key(events: DataFrame, key: str) -> DataFrame:
    """One recording for each value of ``key``, samples by time."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.select(F.col(key).alias("recording_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("value").alias("v"))


def sig_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_key(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id")


def sig_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_key(table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value"), "event_type")


def packed(long: DataFrame) -> DataFrame:
    """(recording_id, v array<double>): the samples of each recording in order."""
    return long.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]).alias("v"))
