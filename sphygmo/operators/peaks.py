"""Peaks, beats and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sphygmo.operators.samples import W
from sphygmo.sources.shared import matched


def local_maxima(sig: DataFrame) -> DataFrame:
    """Samples above both neighbours; a plateau counts once, at its middle (rounded down); ends never."""
    step = sig.withColumn("_new", F.when(F.col("v") == F.lag("v").over(W()), 0).otherwise(1))
    runs = step.withColumn("_run", F.sum("_new").over(W())).groupBy("recording_id", "_run").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.first("v").alias("v"))
    w = Window.partitionBy("recording_id").orderBy("a")
    tops = runs.withColumn("_l", F.lag("v").over(w)).withColumn("_r", F.lead("v").over(w)).filter("v > _l AND v > _r")
    return tops.select("recording_id", F.floor((F.col("a") + F.col("b")) / 2).alias("idx"), "v")


def intervals(peaks: DataFrame, fs: float) -> DataFrame:
    """(recording_id, time, rr, hr) from each peak to the one before."""
    rr = (F.col("idx") - F.lag("idx").over(W())) / F.lit(fs)
    return peaks.select("recording_id", "idx", rr.alias("rr")).filter("rr IS NOT NULL").select("recording_id", (F.col("idx") / F.lit(fs)).alias("time"), "rr", (60.0 / F.col("rr")).alias("hr"))


def poincare(peaks: DataFrame, fs: float) -> DataFrame:
    """(recording_id, sd1, sd2, ratio); under three peaks 0, 0, 1."""
    rr = (F.col("idx") - F.lag("idx").over(W())) / F.lit(fs)
    x = peaks.select("recording_id", "idx", rr.alias("rr")).withColumn("next", F.lead("rr").over(W()))
    pair = F.col("rr").isNotNull() & F.col("next").isNotNull()
    var = lambda e: F.coalesce(F.sqrt(0.5 * F.var_pop(F.when(pair, e))), F.lit(0.0))
    out = x.groupBy("recording_id").agg(var(F.col("rr") - F.col("next")).alias("sd1"), var(F.col("rr") + F.col("next")).alias("sd2"))
    return out.withColumn("ratio", F.when(F.col("sd2") > 1e-9, F.col("sd1") / F.col("sd2")).otherwise(1.0))


def troughs_around(peaks: DataFrame, troughs: DataFrame) -> DataFrame:
    """(recording_id, idx, before, after): the last trough before and the first after each peak, by an ordered pass each way."""
    both = peaks.select("recording_id", "idx", F.lit(True).alias("top")).unionByName(troughs.select("recording_id", "idx", F.lit(False).alias("top")))
    low = F.when(~F.col("top"), F.col("idx"))
    before, after = (F.last(low, True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for w in (W(), W(back=True)))
    return both.select("recording_id", "idx", "top", before.alias("before"), after.alias("after")).filter("top").drop("top")


def stability(peaks: DataFrame) -> DataFrame:
    """(recording_id, peak_stability): spread of the prominences over their mean; 0 for one peak or none."""
    out = peaks.groupBy("recording_id").agg(F.count("*").alias("n"), F.avg("prominence").alias("m"), F.stddev_pop("prominence").alias("s"))
    return out.select("recording_id", F.when((F.col("n") > 1) & (F.col("m") > 1e-9), F.col("s") / F.col("m")).otherwise(0.0).alias("peak_stability"))


def beats(sig: DataFrame, peaks: DataFrame) -> DataFrame:
    """(recording_id, start, beat): the samples from each peak up to the next, in order; more than five of them."""
    tops = peaks.select("recording_id", "idx", F.lit(1).alias("_top"), F.coalesce(F.lead("idx").over(W()), F.lit(-1)).alias("_next"))
    run = matched(sig, tops, ["recording_id", "idx"], "left").withColumn("_beat", F.count("_top").over(W().rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_stop", F.last("_next", True).over(W().rowsBetween(Window.unboundedPreceding, 0))).filter("idx < _stop")
    out = run.groupBy("recording_id", "_beat").agg(F.min("idx").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]).alias("beat"))
    return out.filter(F.size("beat") > 5).select("recording_id", "start", "beat")


def _scores(beats: pd.Series, points: int) -> pd.Series:
    """Each beat's z-scores at ``points`` even places, those of one length together; none for flat beats."""
    k = np.arange(points)
    out, size = np.full(len(beats), None, object), beats.map(len).to_numpy()
    for n in np.unique(size):
        at = k * (n - 1)
        low, rows = at // (points - 1), np.flatnonzero(size == n)
        x = np.stack([np.asarray(b, float) for b in beats.iloc[rows]])
        y = x[:, low] + (x[:, np.minimum(low + 1, n - 1)] - x[:, low]) * (at % (points - 1)) / float(points - 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            there = (~np.isnan(y)).sum(axis=1)
            y -= (np.nansum(y, axis=1) / there)[:, None]
            s = np.sqrt(np.nansum(y * y, axis=1) / there)
            y /= s[:, None]
        for i in np.flatnonzero(s > 1e-9):
            out[rows[i]] = y[i]
    return pd.Series(out)


def resampled(of: DataFrame, points: int = 100) -> DataFrame:
    """(recording_id, start, k, z): each beat at ``points`` even places, linear between samples, as z-scores; flat beats are left out.

    A beat is scored where it stands, those of one length together; its places are made rows only then."""
    scores = F.pandas_udf(lambda beats: _scores(beats, points), "array<double>")
    bad = F.coalesce(F.exists("beat", F.isnan), F.lit(False))  # a beat with such a sample has no mean; a missing sample only lacks its own places
    z = of.withColumn("_bad", bad).withColumn("_z", F.when(F.col("_bad"), F.array_repeat(F.lit(float("nan")), points)).otherwise(scores("beat")))
    rows = z.select("recording_id", "start", "_bad", F.posexplode("_z").alias("k", "z"))
    return rows.select("recording_id", "start", "k", F.when(F.col("_bad") | ~F.isnan("z"), F.col("z")).alias("z"))


def consistency(sig: DataFrame, peaks: DataFrame, points: int = 100) -> DataFrame:
    """(recording_id, beat_consistency): mean correlation of all pairs of beats; 0.5 under three usable beats.

    Of z-scores the pairs' correlations add up to (|sum z|^2 - sum |z|^2) / (2 points), so no pairs are made; and the sums are
    made of the beats as they come, not of a row for each place of each.
    """

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            z = _scores(part["beat"], points)
            for i in np.flatnonzero(part["bad"]):
                z[i] = np.full(points, np.nan)
            out = []
            for name, some in part.assign(z=z).dropna(subset="z").groupby("recording_id", dropna=False, sort=False):
                x, bad = np.stack(some["z"].tolist()), some["bad"].to_numpy(bool)[:, None]
                x = np.where(bad, x, np.nan_to_num(x))  # a missing sample only lacks its own places
                out.append(pd.DataFrame({"recording_id": name, "k": np.arange(points), "s": x.sum(axis=0), "q": (x * x).sum(axis=0), "m": len(x)}))
            if out:
                yield pd.concat(out)

    of = beats(sig, peaks).select("recording_id", "beat", F.exists("beat", F.isnan).alias("bad")).withColumn("bad", F.coalesce("bad", F.lit(False)))
    each = of.mapInPandas(summed, f"recording_id {dict(of.dtypes)['recording_id']}, k int, s double, q double, m long")
    at = each.groupBy("recording_id", "k").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("m").alias("m"))
    mean = at.groupBy("recording_id").agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("t"), F.max("m").alias("m"))
    mean = mean.filter("m >= 3").select("recording_id", (F.col("t") / (points * F.col("m") * (F.col("m") - 1))).alias("c"))
    return matched(sig.select("recording_id").distinct(), mean, how="left").select("recording_id", F.coalesce("c", F.lit(0.5)).alias("beat_consistency"))
