"""What keeps work linear and whole at size: plans and steps that findings of round 3 asked for."""

from __future__ import annotations

import datetime
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sphygmo.functions import kernels as K
from sphygmo.llm import sharding
from sphygmo.operators import beats, kernels, peaks, quality, rates, samples
from sphygmo.plans import registry
from sphygmo.sources.shared import matched, staged


def test_sharding_reads_back_a_rewritten_layout(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "shared_folder", lambda s: f"file://{tmp_path}", raising=False)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 50).cast("int")).alias("text"))
    docs = docs.unionByName(docs.filter("doc_id < 5")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS STRING) AS text"))
    got = sharding.shard_documents(docs).collect()
    layouts = list(Path(tmp_path).glob("layouts-*"))
    assert len(layouts) == 1 and len(list(layouts[0].glob("old/shard=*"))) == sharding.OLD and list(layouts[0].glob("new/shard=*"))
    key = lambda d: (-1 if d is None else d)
    assert sorted(key(r.doc_id) for r in got) == sorted([*range(3000), *range(5), -1])
    for k in range(sharding.NEW):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def _signal(spark, n: int = 400):
    """Two recordings, rows out of order; one has no name."""
    rows = [("a" if k % 2 else None, k // 2, math.sin(k / 9) + (k * 7919 % 13) / 40 + k / 300, 30.0) for k in range(n)]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1] * 7919 % 101), "recording_id string, idx long, v double, fs double")


def test_troughs_ahead_are_asked_backward(spark):
    rng = random.Random(3)
    tops, lows = sorted(rng.sample(range(500), 60)), sorted(rng.sample(range(500), 45))
    make = lambda at: spark.createDataFrame([("r", k) for k in at], "recording_id string, idx long")
    got = peaks.troughs_around(make(tops), make(lows))
    assert "unboundedfollowing" not in _plan(got).lower()  # such a frame is gone through whole for each row
    want = {k: (max((x for x in lows if x < k), default=None), min((x for x in lows if x > k), default=None)) for k in tops}
    assert {r.idx: (r.before, r.after) for r in got.collect() if r.idx not in lows} == {k: v for k, v in want.items() if k not in lows}


def test_kernels_stream_recordings(spark):
    sig = _signal(spark)
    for made in (kernels.filtered(sig, "Butterworth"), kernels.found_peaks(sig), kernels.spectrum(sig), kernels.periods(sig)):
        assert "FlatMapGroups" not in _plan(made)  # a frame for each recording, all of its columns at once
    for name in ("a", None):
        x = np.array([r.v for r in sorted(sig.collect(), key=lambda r: r.idx) if r.recording_id == name])
        mine = sorted((r for r in kernels.filtered(sig, "Butterworth").collect() if r.recording_id == name), key=lambda r: r.idx)
        assert np.allclose([r.v for r in mine], K.apply("Butterworth", x, 30.0)) and [r.idx for r in mine] == list(range(len(x)))


def test_peaks_of_a_levelled_signal(spark):
    sig = _signal(spark).filter("recording_id = 'a'")
    key = lambda df: sorted((r.side, r.idx, round(r.prominence, 9), round(r.width, 9)) for r in df.collect())
    low = kernels.filtered(sig, "low-pass").select("recording_id", "idx", "v", "fs")
    assert key(kernels.found_peaks(sig, 0.4, 0.05, level=True, after="low-pass")) == key(kernels.found_peaks(beats.flat(low), 0.4, 0.05)) != []
    assert "Window" not in _plan(kernels.found_peaks(sig, level=True))


def test_clipping_holds_no_map_of_values(spark):
    sig = _signal(spark)
    got = samples.iqr_clip(sig)
    assert "percentile" not in _plan(got).lower() and got.count() == sig.count()  # the unnamed recording included


def test_lines_and_shares_hold_no_recording_in_a_window(spark):
    sig = _signal(spark)
    assert "Window" not in _plan(samples.detrend(sig)) and "min(v" not in "".join(x for x in _plan(quality.entropy(sig)).splitlines() if "Window" in x)
    assert samples.detrend(sig).count() == sig.count()  # the unnamed recording included
    got = [r.v for r in samples.detrend(sig.filter("recording_id IS NULL")).orderBy("idx").collect()]
    assert np.allclose(got, K.leveled(np.array([r.v for r in sig.filter("recording_id IS NULL").orderBy("idx").collect()])))


def test_beats_are_scored_where_they_stand(spark):
    of = spark.createDataFrame([("r", 0, [0.0, 1.0, 4.0, 9.0, 16.0, 25.0]), ("r", 6, [2.0] * 7), ("r", 13, [1.0, None, 3.0, 2.0, 0.0, 5.0]), ("r", 19, [1.0, float("nan"), 3.0, 2.0, 0.0, 5.0])], "recording_id string, start long, beat array<double>")
    got = peaks.resampled(of, 11)
    assert "Window" not in _plan(got)
    rows = {(r.start, r.k): r.z for r in got.collect()}
    y = np.interp(np.arange(11) / 2, np.arange(6), [0.0, 1.0, 4.0, 9.0, 16.0, 25.0])
    assert np.allclose([rows[0, k] for k in range(11)], (y - y.mean()) / y.std()) and (6, 0) not in rows
    assert [k for k in range(11) if rows[13, k] is None] == [0, 1, 2, 3]  # what leans on the missing sample
    assert all(math.isnan(rows[19, k]) for k in range(11))


def test_filters_are_run_once_for_the_ranking(spark):
    sig = _signal(spark).filter("recording_id = 'a'")
    assert _plan(beats.scoreboard(sig)).split("== Physical Plan ==")[-1].count("MapInArrow") <= 2  # the spectrum; peaks and filters are read back
    assert "MapInArrow" not in _plan(beats.guarded(sig, "Butterworth")).split("== Physical Plan ==")[-1]


def test_maxima_piece_by_piece(monkeypatch):
    x = np.random.default_rng(5).integers(0, 4, 3000).astype(float)
    x[900:1100] = 9.0
    whole = K._maxima(x)
    monkeypatch.setattr(K, "PIECE", 64)
    assert np.array_equal(K.maxima(x), whole) and 999 in whole


def test_results_of_a_long_recording_go_back_some_at_a_time(spark):
    def counted(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    made = kernels.filtered(_signal(spark, 300_000), "None")
    sizes = made.mapInArrow(counted, "n long").collect()
    assert sum(r.n for r in sizes) == 300_000 and max(r.n for r in sizes) <= kernels.ROWS


def test_views_nest_samples_in_order(spark):
    sig = _signal(spark).filter("recording_id = 'a'")
    got = kernels.viewed(kernels.filtered(sig, "Butterworth", raw=True)).first()
    assert [round(r.raw, 9) for r in got.samples] == [round(r.v, 9) for r in sig.orderBy("idx").collect()]
    bent = samples.derivatives(kernels.filtered(sig, "Butterworth"), F.col("fs")).orderBy("idx").collect()
    assert np.allclose([(r.preprocessed, r.vpg, r.apg) for r in got.samples], [(r.v, r.vpg, r.apg) for r in bent])
    one = kernels.viewed(sig.filter("idx = 0").withColumn("raw", F.col("v"))).first().samples[0]
    assert one.vpg is None and one.apg is None


def test_rates_are_voted_by_whole_recordings(spark, tmp_path):
    """The middle 5,000 samples of a recording beat at another rate than the rest; the whole of it votes, as in SQL."""
    t = np.arange(8000)
    x = np.where(abs(t - 4000) < 2500, np.sin(t * 2 * np.pi / 100), 6 * np.sin(t * 2 * np.pi / 25))
    pa_rows = {"event_id": t, "ts": [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=int(k)) for k in t], "user_id": t % 3, "event_type": ["view"] * len(t), "value": x, "props": ["{}"] * len(t)}
    pq.write_table(pa.table(pa_rows), tmp_path / "events.parquet")
    got = rates.votes(kernels.periods(registry._kept(spark, str(tmp_path)))).select("recording_id", "method", "rate")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = con.execute(f"WITH {registry._votes_sql('a.n // 2')} SELECT recording_id, method, rate FROM voted").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and {(m, r) for _, m, r in want} == {("acf", 30.0), ("fft", 30.0), ("psd", 30.0)}
    assert "2000" not in registry.SQL["measured_verdict"]


def test_long_periods_are_found(spark):
    x = np.sin(np.arange(9000) * 2 * np.pi / 2500)
    assert abs(K.periods(x)["acf"] - 2500) < 60 and "acf" not in K.periods(x, 2000)


def _sent(df) -> list[str]:
    """The plans of what is sent to every executor, once the query was run."""
    df.collect()
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "BroadcastExchange" in x]


def test_tables_that_grow_with_the_recordings_are_not_sent_whole(spark, tmp_path):
    """Written tables are small as files, so their size tells nothing; rows a recording are merged, and samples never sent."""
    keep = staged(f"file://{tmp_path}/steps")
    sig = keep(spark.range(40_000).select(F.concat(F.lit("set/user_"), (F.col("id") % 2000).cast("string")).alias("recording_id"), F.floor(F.col("id") / 2000).alias("idx"), F.sin("id").alias("v"), F.lit(10.0).alias("fs")), "sig")
    for made in (samples.detrend(sig), samples.iqr_clip(sig), quality.gaps_flats_motion(sig), quality.entropy(sig)):
        made.collect()
        joins = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
        assert all("LeftOuter, BuildRight" in x for x in joins) and made.count() >= 2000
    tops = keep(kernels.found_peaks(sig, level=True).filter("side = 'peak'"), "tops")
    assert _sent(peaks.beats(sig, tops)) == [] and _sent(matched(sig, tops.groupBy("recording_id").count())) == []


def test_beats_end_at_the_last_peak(spark):
    sig = spark.createDataFrame([(r, k, float(k)) for r in ("a", "b", "c") for k in range(40)], "recording_id string, idx long, v double")
    tops = spark.createDataFrame([("a", 3), ("a", 10), ("a", 14), ("a", 30), ("b", 5)], "recording_id string, idx long")
    got = sorted((r.recording_id, r.start, r.beat) for r in peaks.beats(sig, tops).collect())
    assert got == [("a", 3, [float(k) for k in range(3, 10)]), ("a", 14, [float(k) for k in range(14, 30)])]


def test_awkward_lengths_are_transformed_block_by_block(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=10_007) + np.sin(np.arange(10_007) / 4) + 3
    hertz, power = K.spectrum(x, 30.0)
    want, whole, found = (power[(hertz >= 0.5) & (hertz <= 4)].sum(), power[hertz > 4].sum()), np.fft.rfft(x), K.periods(x)
    assert np.allclose(K.band_power(x, 30.0, 0.5, 4.0), want, rtol=1e-12)
    monkeypatch.setattr(K, "LONG", 1000)
    assert np.allclose(np.concatenate([z for _, z in K._transformed(x)]), whole, atol=1e-9) and K.periods(x) == found
    monkeypatch.setattr(np.fft, "rfft", None)  # a whole transform takes some 150 bytes a sample
    assert np.allclose(K.band_power(x, 30.0, 0.5, 4.0), want, rtol=1e-12)


def test_windows_over_samples_meet_in_no_task(spark):
    """What windows tell of a recording is written before it is joined, so that no task sorts whole recordings for several at once."""
    sig = _signal(spark, 4000)
    for made in (beats.metrics(sig, sig), beats.features(sig)):
        plan = _plan(made).split("== Physical Plan ==")[-1]
        assert "lag(v" not in plan and "lag(vpg" not in plan and made.filter("recording_id = 'a'").count() == 1
