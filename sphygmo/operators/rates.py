"""Sampling rates: votes from the signal, and what metadata, time stamps and names say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphygmo.operators import kernels
from sphygmo.sources.shared import matched

#: Rates that are voted for, in order; the heart rate that is likeliest and how far others fall off.
RATES, USUAL, SPREAD, LOWEST, HIGHEST = (30, 60, 100, 125, 250, 500, 1000), 72.0, 25.0, 40.0, 180.0
#: How header lines give a rate.
STEP = r"(\d+(?:\.\d+)?)\s*m?sec/sample"
KEYWORD = r"(?:sample\s*rate|sampling\s*rate|sampling\s*freq|fs|frequency)\b.*?(\d+(?:\.\d+)?)\s*(?:hz|samples/sec)?"
#: Fixed value: how a file's name gives a rate.
IN_NAME = r"(\d+)\s*hz"


def likelihood(rate: Column, period: Column) -> Column:
    """How usual the heart rate is that ``period`` samples a beat mean at ``rate``; 0 outside what is possible."""
    beats = F.try_divide(60 * rate, period)
    return F.when(beats.between(LOWEST, HIGHEST), F.exp(-0.5 * ((beats - USUAL) / SPREAD) ** 2)).otherwise(0.0)


def votes(periods: DataFrame) -> DataFrame:
    """(recording_id, method, rate): the likeliest rate for each period; the first of equals."""
    tried = periods.filter("period > 0").withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in RATES])))
    return tried.groupBy("recording_id", "method").agg(F.max_by("rate", F.struct(likelihood(F.col("rate"), F.col("period")), -F.col("rate"))).alias("rate"))


def estimated(sig: DataFrame, lags: int | None = None) -> DataFrame:
    """(recording_id, estimated_fs, agreement) by majority of the methods, the first method's of equals; 100 and 0 if no
    method finds a period. ``lags``: up to where the autocorrelation is asked, else up to half a recording."""
    each = votes(kernels.periods(sig, lags)).groupBy("recording_id", "rate").agg(F.count("*").alias("n"), F.min("method").alias("first"))
    most = each.groupBy("recording_id").agg(F.max(F.struct("n", (-F.ascii("first")).alias("o"), "rate")).alias("top"), F.sum("n").alias("all"))
    found = most.select("recording_id", F.col("top.rate").alias("estimated_fs"), (F.col("top.n") / F.col("all")).alias("agreement"))
    return matched(sig.select("recording_id").distinct(), found, how="left").select("recording_id", F.coalesce("estimated_fs", F.lit(100.0)).alias("estimated_fs"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"))


def from_entry(entry: Column) -> Column:
    """Samples a second from one header entry: a step a sample (in ms, whatever it says), else a rate behind a keyword."""
    text = F.lower(entry)
    number = lambda pattern: F.nullif(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.coalesce(F.try_divide(F.lit(1000.0), number(STEP)), number(KEYWORD))


def from_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(name), IN_NAME, 1), F.lit("")).try_cast("double")


def from_times(name: Column, step: Column, last: Column, n: Column) -> Column:
    """From the mean step of a time column, its name, last value and length; a last value under a tenth of the length is
    read as minutes."""
    low = F.lower(name)
    seconds = F.when(low.contains("min"), step * 60).when(low.contains("ms"), step / 1000).when((last > 0) & (last < n / 10), step * 60).otherwise(step)
    return F.when(step > 0, F.try_divide(F.lit(1.0), seconds))


def detected(rows: DataFrame) -> DataFrame:
    """Adds fs, fs_source, fs_confidence and fs_status to rows (user_fs, meta_fs, time_fs, name_fs, estimated_fs, agreement).

    The first of these that is there holds; it is sure if the estimate is within a tenth, else the less so the further the
    estimate is. An estimate alone is as sure as its methods agree.
    """
    told = F.coalesce(F.when(F.col("user_fs") > 0, F.col("user_fs")), "meta_fs", "time_fs", "name_fs")
    source = F.when(F.col("user_fs") > 0, "User Override").when(F.col("meta_fs").isNotNull(), "Metadata").when(F.col("time_fs").isNotNull(), "Timestamp-derived").when(F.col("name_fs").isNotNull(), "Filename Hint").otherwise("Estimation")
    off = F.try_divide(F.abs(told - F.col("estimated_fs")), told)
    sure = F.when(told.isNull(), F.col("agreement")).when(off < 0.10, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - off))
    out = rows.withColumn("fs", F.coalesce(told, "estimated_fs")).withColumn("fs_source", source).withColumn("fs_confidence", sure)
    return out.withColumn("fs_status", F.when(F.col("fs_confidence") > 0.90, "PASS").when(F.col("fs_confidence") >= 0.70, "WARNING").otherwise("FS_UNRESOLVED"))
