"""Signal quality, decisions and scores: one row a recording, pure expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sphygmo.operators.samples import ALL, W, beside, detrend


def clip(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def stats(sig: DataFrame) -> DataFrame:
    """Count, mean, population deviation, extremes, median, biased skewness and excess kurtosis (null if constant)."""
    return sig.groupBy("recording_id").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.median("v").alias("median"), F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"),
    )


def entropy(sig: DataFrame, bins: int = 50) -> DataFrame:
    """Entropy in bits of ``bins`` equal bins from smallest to largest value; 0 for a range under 1e-9."""
    sig, low, high = beside(sig, _low=F.min("v"), _high=F.max("v")), F.col("_low"), F.col("_high")
    place = F.when(high - low < 1e-9, F.lit(0)).otherwise(F.least(F.floor((F.col("v") - low) * bins / F.nullif(high - low, F.lit(0.0))), F.lit(bins - 1)))
    counts = sig.withColumn("bin", place).groupBy("recording_id", "bin").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(ALL())
    return counts.withColumn("p", p).groupBy("recording_id").agg((-F.sum(F.col("p") * F.log2("p")) + F.lit(0.0)).alias("entropy"))


def energy(sig: DataFrame) -> DataFrame:
    return detrend(sig).groupBy("recording_id").agg((F.sum(F.col("v") * F.col("v")) / F.count("*")).alias("energy"))


def gaps_flats_motion(sig: DataFrame, spread: float = 5.0) -> DataFrame:
    """(recording_id, missing_pct, flat_pct, motion_pct): null or non-finite samples; differences under 1e-7; differences
    over ``spread`` of their population deviations (0 where that is under 1e-9)."""
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    d = beside(sig.withColumn("d", F.col("v") - F.lag("v").over(W())), s=F.stddev_pop("d"))
    share = lambda c: F.coalesce(F.avg(F.when(F.col("d").isNotNull(), F.when(c, 100.0).otherwise(0.0))), F.lit(0.0))
    return d.groupBy("recording_id").agg(
        F.avg(F.when(bad, 100.0).otherwise(0.0)).alias("missing_pct"), share(F.abs("d") < 1e-7).alias("flat_pct"), share((F.col("s") > 1e-9) & (F.abs("d") > spread * F.col("s"))).alias("motion_pct"),
    )


def heatmap(sig: DataFrame, chunks: int = 10) -> DataFrame:
    """(recording_id, chunk, motion, drift, flat) of equal chunks, rest dropped; none if chunks are under 10 samples."""
    cut = beside(sig, size=F.floor(F.count("*") / chunks)).filter("size >= 10 AND idx < size * " + str(chunks)).withColumn("chunk", F.floor(F.col("idx") / F.col("size")))
    x = cut.withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy("recording_id", "chunk").orderBy("idx")))
    told = x.groupBy(F.col("recording_id").alias("_id"), F.col("chunk").alias("_chunk")).agg(F.coalesce(F.regr_slope("v", "idx"), F.lit(0.0)).alias("slope"), F.stddev_pop("d").alias("s"))
    x = x.join(told, x["recording_id"].eqNullSafe(told["_id"]) & (x["chunk"] == told["_chunk"]), "left").withColumn("r", F.col("v") - F.col("slope") * F.col("idx"))
    share = lambda c: F.avg(F.when(F.col("d").isNotNull(), F.when(c, 100.0).otherwise(0.0)))
    spread, rest = F.stddev_pop("v"), F.stddev_pop("r")
    return x.groupBy("recording_id", "chunk").agg(
        share((F.col("s") > 1e-9) & (F.abs("d") > 4 * F.col("s"))).alias("motion"), F.greatest(F.lit(0.0), (spread - rest) / (spread + 1e-9) * 100).alias("drift"), share(F.abs("d") < 1e-7).alias("flat"),
    )


def correlation_score(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(recording_id, morphology): Pearson correlation of two columns, at least 0, in percent; 0 if either is constant."""
    out = pairs.groupBy("recording_id").agg(F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("s"), F.stddev_pop(b).alias("t"))
    r = F.try_divide("c", F.col("s") * F.col("t"))
    return out.select("recording_id", F.when((F.col("s") < 1e-9) | (F.col("t") < 1e-9), 0.0).otherwise(F.greatest(F.lit(0.0), r) * 100).alias("morphology"))


def quality_score(snr: Column, drift: Column, missing: Column, flat: Column, motion: Column, stability: Column, consistency: Column) -> Column:
    """100 less the penalties, within 0 and 100. The weights and where they begin."""
    over = lambda c, x: F.when(c, x).otherwise(F.lit(0.0))
    lost = 3 * missing + over(flat > 1, 2 * (flat - 1)) + over(snr < 15, 2 * (15 - snr)) + over(snr < 0, F.lit(10.0)) + over(drift > 0.1, 40 * (drift - 0.1)) + 15 * motion + 25 * stability + over(consistency < 0.85, 60 * (0.85 - consistency))
    return clip(100 - lost)


def band(score: Column) -> Column:
    return F.when(score >= 95, "Excellent").when(score >= 85, "Very Good").when(score >= 70, "Good").when(score >= 50, "Acceptable").otherwise("Poor")


def quality_radar(rows: DataFrame) -> DataFrame:
    """(recording_id, and five axes of 0 to 100) of rows with the quality metrics; consistency is not clipped."""
    axes = {
        "snr_power": clip(F.col("snr_db") / 30 * 100), "baseline_stability": clip((1 - F.col("drift_ratio")) * 100), "beat_consistency": F.col("beat_consistency") * 100,
        "sensor_connection": clip(100 - F.col("flat_region_pct")), "amplitude_stability": clip((1 - F.col("peak_stability")) * 100),
    }
    return rows.select("recording_id", *[c.alias(n) for n, c in axes.items()])


def morphology_radar(rows: DataFrame) -> DataFrame:
    """(recording_id, and four axes of 0 to 100) of rows with the features: how near each is to its usual value (fixed)."""
    usual = {"heart_rate_bpm": 72.0, "pulse_width_sec": 0.3, "rise_time_sec": 0.2, "decay_time_sec": 0.5}
    return rows.select("recording_id", *[clip(100 - F.abs(F.col(c) - mid) / mid * 100).alias(c.rsplit("_", 1)[0]) for c, mid in usual.items()])


def submetric_status(rows: DataFrame) -> DataFrame:
    """(recording_id, metric, value, ok): the eight marks that are shown with a state. The limits."""
    c = F.col
    marks = {
        "snr_db": c("snr_db") >= 15, "drift_ratio": c("drift_ratio") < 0.1, "motion_artifact_pct": c("motion_artifact_pct") < 1, "entropy": (c("entropy") > 2) & (c("entropy") < 7),
        "flat_region_pct": c("flat_region_pct") < 0.1, "missing_data_pct": c("missing_data_pct") == 0, "peak_stability": c("peak_stability") < 0.2, "beat_consistency": c("beat_consistency") >= 0.8,
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c(n).alias("value"), ok.alias("ok")) for n, ok in marks.items()])).alias("m")
    return rows.select("recording_id", each).select("recording_id", "m.*")


def penalties(rows: DataFrame) -> DataFrame:
    """(recording_id, missing, drift, consistency): what is shown as taken off the quality score."""
    over = lambda ok, x: F.when(ok, x).otherwise(0.0)
    return rows.select(
        "recording_id", (3 * F.col("missing_data_pct")).alias("missing"), over(F.col("drift_ratio") > 0.1, (F.col("drift_ratio") - 0.1) * 40).alias("drift"), over(F.col("beat_consistency") < 0.85, (0.85 - F.col("beat_consistency")) * 60).alias("consistency"),
    )


#: Plausible ranges of the features.
RANGES = {
    "heart_rate_bpm": (40.0, 160.0), "rr_mean_sec": (0.375, 1.5), "pulse_width_sec": (0.10, 0.60), "rise_time_sec": (0.05, 0.45), "decay_time_sec": (0.10, 1.20),
    "entropy": (1.5, 7.5), "sd1_sec": (0.001, 0.200), "sd2_sec": (0.005, 0.400),
}


def readiness(features: DataFrame) -> DataFrame:
    """Adds readiness_score and readiness_category to rows with the features and fs_status: ten points a check."""
    checks = [F.coalesce(F.col(c).between(*r), F.lit(False)) for c, r in RANGES.items()] + [F.coalesce(F.col("amplitude") > 1e-6, F.lit(False)), F.coalesce((F.col("vpg_range") > 1e-6) & (F.col("apg_range") > 1e-6), F.lit(False))]
    score = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int")) * 10
    lost = F.col("fs_status") == "FS_UNRESOLVED"
    capped = F.when(lost, F.least(score, F.lit(85))).otherwise(score)
    grade = F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 50, "C").otherwise("D")
    return features.withColumn("readiness_score", capped.cast("int")).withColumn("readiness_category", F.when(lost & (grade == "A"), "B").otherwise(grade))


#: Why a recording fails.
REASONS = {
    "loader": "File Loader: Failed to decode, parse, or load signal data.",
    "rate": "FS Detector: Sampling frequency is unresolved (cannot compute frequency features).",
    "preprocess": "Preprocessor: Preprocessing failed (NaNs or empty array returned).",
    "guard": "Morphology Guard: Filtering severely distorted physiological waves, fell back to raw.",
    "features": "Feature Validator: Signal features failed physiological plausibility (readiness: %.1f%%).",
}


def verdict(rows: DataFrame) -> DataFrame:
    """Adds overall_verdict, wording and failure_reasons to rows (loader_ok, fs_status, preprocess_ok, guard_status,
    readiness_category, readiness_score)."""
    rules = [
        (~F.col("loader_ok"), F.lit(REASONS["loader"])),
        (F.col("fs_status") == "FS_UNRESOLVED", F.lit(REASONS["rate"])),
        (~F.col("preprocess_ok"), F.lit(REASONS["preprocess"])),
        (F.col("guard_status") == "DEGRADED_FALLBACK", F.lit(REASONS["guard"])),
        ((F.col("readiness_category") == "D") | (F.col("readiness_score") < 50), F.format_string(REASONS["features"], F.col("readiness_score").cast("double"))),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))
    out = rows.withColumn("failure_reasons", reasons).withColumn("overall_verdict", F.when(F.size("failure_reasons") > 0, "Verification FAIL").otherwise("Verification PASS"))
    return out.withColumn("wording", F.when(F.size("failure_reasons") == 0, "Ready for biomedical research").otherwise("Not ready for biomedical research"))


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 20, "<20s Short").when(seconds <= 120, "20-120s Standard").when(seconds <= 300, "120-300s Long").otherwise(">300s Extended")


def source_kind(name: Column, metadata: Column, fs: Column, span: Column) -> Column:
    """Where a recording comes from, by file name, then metadata (one text), then rate and value range."""
    n = F.lower(name)
    # fixed values: the words, rates and ranges
    return (
        F.when(n.rlike("mobile|phone|camera|app|sensor|smartwatch"), "Mobile")
        .when(n.rlike("clg|aiims|clinical|patient|hosp|subject"), F.when(span > 10, "Mobile").otherwise("Clinical"))
        .when(n.rlike("sub|research|lab|trial"), "Research")
        .when(F.lower(metadata).rlike("acq|channels"), "Research")
        .when(fs <= 60, "Mobile")
        .when((fs >= 200) & (span < 5), "Clinical")
        .when((fs >= 100) & (span > 10), "Research")
        .otherwise("Unknown")
    )
