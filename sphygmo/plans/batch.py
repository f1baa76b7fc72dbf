"""The whole run over files: one summary row a file, exports beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphygmo.operators import beats, quality, rates, samples
from sphygmo.sources import recordings
from sphygmo.sources.datasource import write_keyed
from sphygmo.sources.shared import Keep, matched, scratch, staged

#: What each file of a scan gets in the summary where it fails: fixed values.
DEFAULTS = {
    "sampling_rate_hz": 0.0, "duration_seconds": 0.0, "quality_score": 0.0, "quality_band": "Poor", "readiness_score": 0, "readiness_category": "D",
    "overall_verdict": "Verification FAIL", "wording": "Not ready for biomedical research", "failure_reasons": "Pipeline execution failed: no result",
}
SUMMARY = ("file_name", "status", *DEFAULTS)
#: The columns of the summary that are shown.
SHOWN = ("file_name", "status", "sampling_rate_hz", "quality_band", "readiness_category", "overall_verdict")
#: What may be set by hand for a recording, by its path.
OVERRIDES = "recording_id string, fs double, orientation string, filter string, reverse boolean, signal string"
#: Fixed value: what stands before the reason where a step failed.
FAILED = "Pipeline execution failed: "


def name_of(path: str) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def analysed(info: DataFrame, signal: DataFrame, overrides: DataFrame | None = None, keep: Keep = lambda df, name: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, signals, errors): one row for each recording that all steps took, with all that was found; the signals
    (recording_id, idx, raw, v, fs) before and after; and (recording_id, error) of the others.

    ``info`` and ``signal`` as :mod:`recordings` gives them. Rates, orientation, filter and a reversal set by hand come before
    what is detected; a rate set so is not held against the estimate. A step that cannot take a recording gives no row but an
    error: the first, in the order of the steps, is kept, and the others' results for that recording are left out.
    """
    spark = info.sparkSession
    hand = overrides if overrides is not None else spark.createDataFrame([], OVERRIDES)
    hand = hand.select("recording_id", F.col("fs").alias("hand_fs"), F.col("orientation").alias("hand_orientation"), F.col("filter").alias("hand_filter"), F.col("reverse").alias("hand_reverse"))
    loaded = info.join(hand, "recording_id", "left")
    voted = rates.estimated(signal.withColumn("fs", F.lit(1.0)))
    rated = rates.detected(matched(loaded.filter("loader_ok").drop("error"), voted).withColumn("user_fs", F.lit(None).cast("double")))
    set_ = F.coalesce(F.col("hand_fs") > 0, F.lit(False))
    rated = rated.withColumn("fs", F.when(set_, F.col("hand_fs")).otherwise(F.col("fs"))).withColumn("fs_status", F.when(set_, "Overridden").otherwise(F.col("fs_status"))).withColumn("fs_confidence", F.when(set_, 1.0).otherwise(F.col("fs_confidence"))).withColumn("fs_source", F.when(set_, "manual").otherwise(F.col("fs_source")))
    rated = keep(rated, "rates")
    sig = keep(matched(signal, rated.select("recording_id", "fs")).select("recording_id", "idx", "v", "fs"), "signals")
    span = sig.groupBy("recording_id").agg((F.max("v") - F.min("v")).alias("span"))
    facing = matched(beats.orientation(sig), rated.select("recording_id", "hand_orientation", "hand_reverse"))
    forced = F.when(F.col("hand_orientation") == "Force Inverted", True).when(F.col("hand_orientation") == "Force Normal", False)
    by_hand = F.coalesce("hand_reverse", forced)
    label = F.when(by_hand, "inverted").when(~by_hand, "normal").otherwise(F.col("orientation"))
    facing = keep(facing.select("recording_id", label.alias("orientation"), F.col("confidence").alias("orientation_confidence"), F.coalesce(by_hand, "reverse").alias("reverse")), "orientations")
    clean = matched(sig, facing.select("recording_id", "reverse")).select("recording_id", "idx", F.col("v").alias("raw"), F.when(F.col("reverse"), -F.col("v")).otherwise(F.col("v")).alias("v"), "fs")
    clean = keep(clean, "clean")
    plain = clean.select("recording_id", "idx", "v", "fs")
    scored = keep(beats.scored(beats.metrics(clean.select("recording_id", "idx", F.col("raw").alias("v"), "fs"), plain)), "quality")
    board = keep(beats.scoreboard(plain), "scoreboard")
    errors = info.filter(~F.col("loader_ok")).select("recording_id", "error").unionByName(beats.first_error(board))
    errors = keep(errors, "errors")
    fine = matched(plain, errors.select("recording_id"), how="left_anti")
    best = matched(matched(beats.best_filter(board), errors.select("recording_id"), how="left_anti"), rated.select("recording_id", "hand_filter"))
    known = F.when(F.col("hand_filter").isin(*beats.FILTERS), F.col("hand_filter"))  # any other name: as if none were set
    best = keep(best.select("recording_id", F.coalesce(known, "best").alias("filter"), "needs_comparison"), "filters")
    named = matched(fine, best.select("recording_id", "filter"))
    guards = keep(beats.guarded(named), "guards")
    after = keep(beats.guard_output(named, None, guards), "preprocessed")
    ok = after.groupBy("recording_id").agg(F.bool_and(F.col("v").isNotNull() & ~F.isnan("v")).alias("preprocess_ok"))
    rows = reduce(matched, (rated.drop("columns"), facing, scored, best, span))
    rows = matched(matched(rows, guards.select("recording_id", "attempt", F.col("status").alias("guard_status"), "degraded")), ok, how="left")
    rows = matched(rows, keep(beats.features(after).withColumnRenamed("entropy", "signal_entropy"), "features"), how="left").withColumn("preprocess_ok", F.coalesce("preprocess_ok", F.lit(False)))
    rows = rows.withColumnRenamed("entropy", "quality_entropy").withColumnRenamed("signal_entropy", "entropy").withColumn("duration_seconds", F.col("n") / F.col("fs"))
    meta = F.concat_ws(" ", F.transform("metadata", lambda m: F.concat_ws(" ", m["key"], m["value"])))
    rows = rows.withColumn("duration_bucket", quality.duration_bucket(F.col("duration_seconds"))).withColumn("source_guess", quality.source_kind(name_of("recording_id"), meta, F.col("fs"), F.col("span")))
    signals = matched(clean.select("recording_id", "idx", "raw"), after.select("recording_id", "idx", "v", "fs"), ["recording_id", "idx"])
    return quality.verdict(quality.readiness(rows)), signals, errors


def summary(scan: DataFrame, rows: DataFrame, errors: DataFrame) -> DataFrame:
    """(file_path, and the eleven columns of the summary), one row for each file of the scan; a file that was not analysed
    fails, and says why: by its class, or by the step that could not take it."""
    why = F.when(F.size("failure_reasons") == 0, "None").otherwise(F.array_join("failure_reasons", "; "))
    found = rows.select(F.col("recording_id").alias("file_path"), F.col("fs").alias("sampling_rate_hz"), *[c for c in DEFAULTS if c not in ("sampling_rate_hz", "failure_reasons")], why.alias("failure_reasons"))
    failed = errors.select(F.col("recording_id").alias("file_path"), F.concat(F.lit(FAILED), F.col("error")).alias("failed"))
    x = matched(matched(scan, found, "file_path", "left"), failed, "file_path", "left")
    x = x.withColumn("failure_reasons", F.when(F.col("status") == "Unsafe", F.col("reason")).otherwise(F.coalesce("failed", "failure_reasons")))
    return x.select("file_path", name_of("file_path").alias("file_name"), "status", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()])


def _keyed(scan: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """The scan with ``run_key``: a digest of a file's name, content and what is set by hand for it."""
    hand = overrides if overrides is not None else scan.sparkSession.createDataFrame([], OVERRIDES)
    own = F.to_json(F.struct(*[c for c in hand.columns if c != "recording_id"])).alias("hand")
    x = scan.join(hand.select(F.col("recording_id").alias("file_path"), own), "file_path", "left")
    parts = F.concat_ws("\n", name_of("file_path"), F.coalesce("digest", F.lit("-")), F.coalesce("hand", F.lit("-")))
    return x.withColumn("run_key", F.sha2(parts, 256)).drop("hand")


def _remembered(spark: SparkSession, memo: str | None) -> DataFrame | None:
    try:
        return None if memo is None else spark.read.parquet(memo)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def process(spark: SparkSession, path: str, folder: str | None = None, overrides: DataFrame | None = None, memo: str | None = None) -> DataFrame:
    """The summary of all files under ``path``.

    With a ``folder``, which must not exist, the steps are kept there and the exports written: for each recording its frame,
    its signal before and after with derivatives, features and report, under the recording's own path; and the summary. With
    a ``memo`` (a folder), what a file came to is kept there under a digest of its name, content and overrides, and files found
    there are neither read beyond the scan nor worked on or exported again.
    """
    steps = f"{folder}/steps" if folder else scratch(spark)
    keep = staged(steps)
    scan = keep(_keyed(recordings.scanned(spark, path), overrides), "scan")
    known = _remembered(spark, memo)
    todo = scan if known is None else scan.join(known.select("run_key"), "run_key", "left_anti")
    wanted = keep(todo.filter("status <> 'Unsafe'").select("file_path"), "wanted")
    some = not wanted.isEmpty()
    if some:
        only = f"{steps}/wanted"
        info = keep(recordings.described(recordings.layouts(spark, path, only), overrides), "info")
        frame = recordings.frames(spark, path, only)
        signal = keep(recordings.signals(frame, info), "samples")
        rows, after, errors = analysed(info, signal, overrides, keep)
        rows = keep(rows, "rows")
        fresh = summary(todo, rows, errors)
    else:
        fresh = todo.select("file_path", name_of("file_path").alias("file_name"), "status", *[F.lit(v).alias(c) for c, v in DEFAULTS.items() if c != "failure_reasons"], F.col("reason").alias("failure_reasons"))
    fresh = keep(fresh, "fresh")
    out = fresh
    if known is not None:
        seen = known.drop("file_name", "status").dropDuplicates(["run_key"])
        out = fresh.unionByName(scan.join(seen, "run_key").select("file_path", name_of("file_path").alias("file_name"), "status", *DEFAULTS))
    if memo is not None:
        fresh.join(scan.select("file_path", "run_key"), "file_path").select("run_key", *SUMMARY).write.mode("append").parquet(memo)
    if folder:
        if some:
            export(path, info, frame, rows, after, folder)
        out.select(*SUMMARY).write.option("header", True).csv(f"{folder}/summary")
    return out.select(*SUMMARY)


FEATURES = ("heart_rate_bpm", "rr_mean_sec", "pulse_width_sec", "rise_time_sec", "decay_time_sec", "amplitude", "entropy", "energy", "area", "sd1_sec", "sd2_sec", "sd_ratio", "vpg_range", "apg_range")
METRICS = ("snr_db", "baseline_wander_std", "drift_ratio", "motion_artifact_pct", "variance", "kurtosis", "skewness", "flat_region_pct", "missing_data_pct", "peak_stability", "beat_consistency", "peak_count")


def _line(*cells: Column) -> Column:
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])


def quoted(name: Column) -> Column:
    """A CSV cell: in quotes where it has a comma, a quote or a line break."""
    return F.when(name.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(name)


def table_lines(rows: DataFrame, file: Column, ord_: Column, header: Column, cells: Column) -> DataFrame:
    """(file, ord, line): a CSV for each ``file``, its header before its rows; ``header`` is the same in all rows of a file."""
    body = rows.select(file.alias("file"), ord_.cast("long").alias("ord"), header.alias("header"), cells.alias("line"))
    heads = body.groupBy("file").agg(F.first("header").alias("line")).select("file", F.lit(-1).cast("long").alias("ord"), "line")
    return body.select("file", "ord", "line").unionByName(heads)


def report(rows: DataFrame) -> Column:
    """All that was found of a recording, nested, as JSON; numbers that are no numbers are strings there."""
    of = lambda *cols, **more: F.struct(*cols, *[F.col(c).alias(n) for n, c in more.items()])
    return F.to_json(F.struct(
        of("recording_id", "timestamp_col", "signal_col", "id_col").alias("file_info"), of("duration_bucket", "source_guess", "duration_seconds").alias("classification"),
        of(detected_fs="fs", confidence="fs_confidence", status="fs_status", method="fs_source").alias("sampling_rate"), of("orientation", recommend_reverse="reverse", confidence="orientation_confidence").alias("orientation"),
        F.struct(F.col("quality_score").alias("score"), F.col("quality_band").alias("band"), of(*METRICS, entropy="quality_entropy").alias("metrics")).alias("quality"),
        of("filter", "attempt", "degraded", status="guard_status").alias("morphology_guard"), of(*FEATURES).alias("features"), of("readiness_score", "readiness_category").alias("validation"),
        of("overall_verdict", "wording", reasons="failure_reasons").alias("verification"),
    ))


def export(path: str, info: DataFrame, frame: DataFrame, rows: DataFrame, after: DataFrame, folder: str) -> None:
    """Files of each recording that was analysed, named by its path below ``path``: the frame without gaps, the signal with
    its derivatives, the features, and the report."""
    base = path.rstrip("/")
    inside = F.when(F.col("recording_id").startswith(base + "/"), F.substring("recording_id", len(base) + 2, 1 << 20)).otherwise(name_of("recording_id"))
    named = lambda end: F.concat(inside, F.lit(end))
    done = rows.select("recording_id")
    own = info.join(done, "recording_id", "left_semi").select("recording_id", F.array_join(F.transform("columns", quoted), ",").alias("header"))
    whole = frame.withColumnRenamed("file_path", "recording_id").join(own, "recording_id")
    lines = table_lines(whole, named("_raw.csv"), F.col("idx"), F.col("header"), F.array_join(F.col("v").cast("array<string>"), ","))
    bent = samples.derivatives(after, F.col("fs"))
    cells = (F.col("idx") / F.col("fs"), F.col("v"), F.col("vpg"), F.col("apg"))
    lines = lines.unionByName(table_lines(bent, named("_preprocessed.csv"), F.col("idx"), F.lit("time_sec,preprocessed_signal,vpg_1st_derivative,apg_2nd_derivative"), _line(*cells)))
    lines = lines.unionByName(table_lines(rows, named("_features.csv"), F.lit(0), F.lit(",".join(FEATURES)), _line(*map(F.col, FEATURES))))
    lines = lines.unionByName(rows.select(named("_report.json").alias("file"), F.lit(0).cast("long").alias("ord"), report(rows).alias("line")))
    write_keyed(lines, f"{folder}/recordings")
