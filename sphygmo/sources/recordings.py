"""Delimited recordings: scan, classify, load, from files or from texts in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphygmo.operators import files, rates
from sphygmo.sources.datasource import register
from sphygmo.sources.shared import matched

SCAN = ("file_path", "status", "reason", "file_size_bytes", "file_extension", "encoding", "digest")


def _read(spark: SparkSession, path: str, rows: str, only: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("recordings").option("rows", rows)
    return (reader if only is None else reader.option("only", only)).load(path)


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """The columns :data:`SCAN` of a file or of a folder's files at any depth, those of ZIP files in their place. Names that
    begin with a dot and cache folders are passed over; a path that is not there, empty files, and ZIP files that cannot be
    read, are one Unsafe row each."""
    found = _read(spark, path, "files")
    known = files.classified(found.withColumnsRenamed({"file_size_bytes": "size", "head": "text"}))
    odd = lambda c, gone, bad: F.when(F.col("state") == "gone", gone).when(F.col("state") == "zip", bad).otherwise(F.col(c)).alias(c)
    return known.select("file_path", odd("status", "Unsafe", "Unsafe"), odd("reason", files.WHY["path"], files.WHY["zip"]), F.col("size").alias("file_size_bytes"), F.when(F.col("state") == "gone", "").otherwise(files.extension(F.col("file_path"))).alias("file_extension"), "encoding", "digest")


def layouts(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    return _read(spark, path, "layout", only)


def frames(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """(file_path, idx, v): all columns of each file without gaps, one row a line."""
    return _read(spark, path, "samples", only).select("file_path", "idx", "v")


def _stat(name: Column) -> Column:
    return F.get(F.filter("stats", lambda c: c["name"].eqNullSafe(name)), 0)


def described(layout: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(recording_id, columns, id_col, timestamp_col, signal_col, signal_at, metadata, meta_fs, time_fs, name_fs, n, loader_ok,
    error) of rows (file_path, and a layout): which column is what, and what the file tells of its rate.

    ``wanted`` (recording_id, signal) names signal columns by hand; such a column is taken where the file has it. A file
    without data, or whose signal has no number, is not ok, and ``error`` says why.
    """
    if wanted is not None:
        layout = layout.join(wanted.select(F.col("recording_id").alias("file_path"), "signal"), "file_path", "left")
    else:
        layout = layout.withColumn("signal", F.lit(None).cast("string"))
    rising = F.transform(F.filter("stats", lambda c: c["rising"]), lambda c: c["name"])
    x = layout.withColumn("r", files.roles(F.col("columns"), rising, F.col("signal")))
    time, signal = _stat(F.col("r.timestamp_col")), _stat(F.col("r.signal_col"))
    told = F.get(F.filter(F.transform("metadata", lambda m: rates.from_entry(F.concat_ws(" ", m["key"], m["value"]))), lambda v: v.isNotNull()), 0)
    time_fs = rates.from_times(F.col("r.timestamp_col"), F.try_divide(time["last"] - time["first"], F.col("n_rows") - 1), time["last"], F.col("n_rows"))
    ok = F.col("error").isNull() & F.coalesce(signal["n"] > 0, F.lit(False))
    return x.select(
        F.col("file_path").alias("recording_id"), "columns", "r.*", F.array_position("columns", F.col("r.signal_col")).cast("int").alias("signal_at"), "metadata", told.alias("meta_fs"), time_fs.alias("time_fs"),
        rates.from_name(F.regexp_extract("file_path", "[^/]*$", 0)).alias("name_fs"), F.col("n_rows").alias("n"), ok.alias("loader_ok"), F.coalesce("error", F.when(~ok, "the signal column holds no numbers")).alias("error"),
    )


def signals(frame: DataFrame, info: DataFrame) -> DataFrame:
    """(recording_id, idx, v): the signal column of each file that is ok, of rows (file_path, idx, v)."""
    own = info.filter("loader_ok").select(F.col("recording_id").alias("file_path"), "signal_at")
    return matched(frame, own, "file_path").select(F.col("file_path").alias("recording_id"), "idx", F.element_at("v", F.col("signal_at")).alias("v"))
