"""Core operators: kernels by their invariants, decisions by literal rows, queries against DuckDB."""

import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sphygmo.functions import kernels as K
from sphygmo.operators import beats, blocks, files, kernels, quality, rates, samples
from sphygmo.plans import batch
from sphygmo.sources import recordings, tables

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["trim", "chunk_stats", "interpolate_gaps", "signal_quality", "verdict", "peaks_distance", "poincare", "beat_resample", "beat_consistency", "modal_columns", "peaks_standard", "trough_asof", "dft_power", "band_snr", "rate_scores", "rate_entries", "gauss_filter", "filter_scoreboard", "top3_filters", "data_start", "file_class", "file_columns", "file_round_trip", "sanitized_frames", "butterworth", "baseline_drift", "savitzky_golay", "autocorr", "features", "orientation", "rate_detected", "wavelet"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows(got.select(*cols)) == sorted(map(tuple, want), key=repr)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_edges():
    for kind, gain in (("butterworth", 0.5**0.5), ("chebyshev2", 0.1)):
        for order, low in ((3, 0.05), (2, 0.002), (1, 0.3), (3, None)):
            sections = K.design(kind, order, low, 0.4)
            for edge in (e for e in (low, 0.4) if e):
                z = np.exp(1j * np.pi * edge)
                assert abs(np.prod([np.polyval(b, z) / np.polyval(a, z) for b, a in sections])) == pytest.approx(gain, rel=1e-6)
            assert all((abs(np.roots(a)) < 1).all() for _, a in sections) and K.padding(sections) == 3 * (1 + order * (2 if low else 1))


def test_forward_backward():
    t = np.arange(1200) / 100
    x = np.sin(2 * np.pi * 1.5 * t)
    y = K.apply("Butterworth", x, 100.0)
    assert np.abs(y - x)[300:-300].max() < 1e-2
    with pytest.raises(ValueError, match="padlen, which is 21"):
        K.apply("Butterworth", x[:21], 100.0)
    # as one quotient of polynomials, sample by sample
    sections, x = K.recursion("chebyshev", 30.0), np.random.default_rng(7).normal(size=90)
    b, a = (np.array([1.0]), np.array([1.0]))
    for p, q in sections:
        b, a = np.convolve(b, p), np.convolve(a, q)
    step = np.zeros((6, 6))
    step[:, 0], step[:-1, 1:] = -a[1:], np.eye(5)
    start = np.linalg.solve(np.eye(6) - step, b[1:] - a[1:] * b[0])

    def plain(x, s):
        out = []
        for v in x:
            out.append(b[0] * v + s[0])
            s = np.r_[s[1:], 0] + b[1:] * v - a[1:] * out[-1]
        return np.array(out)

    ext = np.r_[2 * x[0] - x[21:0:-1], x, 2 * x[-1] - x[-2:-23:-1]]
    y = plain(ext, start * ext[0])[::-1]
    assert np.allclose(plain(y, start * y[0])[::-1][21:-21], K.forward_backward(sections, x), atol=1e-8)


def test_savitzky_golay_keeps_quadratics():
    x = 0.5 * np.arange(60.0) ** 2 - 3 * np.arange(60.0) + 1
    assert np.allclose(K.savitzky_golay(x, 30.0), x)


@pytest.mark.parametrize("n", [64, 77, 300])
def test_wavelet_without_shrinkage(n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(K.wavelet(x, 0.0), x)


def brute_peaks(x, distance, prominence):
    n, top = len(x), []
    for k in range(1, n - 1):
        j = k
        while j + 1 < n and x[j + 1] == x[k]:
            j += 1
        if x[k - 1] < x[k] and j + 1 < n and x[j + 1] < x[k]:
            top.append((k + j) // 2)
    keep = []
    for p in sorted(set(top), key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in keep):
            keep.append(p)
    out = []
    for p in sorted(keep):
        left, right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
        a, b = (left[-1] + 1 if len(left) else 0), (p + 1 + right[0] if len(right) else n)
        prom = x[p] - max(x[a : p + 1].min(), x[p:b].min())
        if prom >= prominence:
            out.append((p, prom))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_peaks_brute_force(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 2, 3, 10, 300):
        x = rng.integers(0, 9, n).astype(float) if seed % 2 else rng.normal(size=n)
        for distance, prominence in ((1, 0.0), (4, 0.0), (7, 2.0)):
            idx, prom, width = K.measured(x, distance, prominence)
            want = brute_peaks(x, distance, prominence)
            assert idx.tolist() == [k for k, _ in want] and np.allclose(prom, [v for _, v in want]) and len(width) == len(idx)


def test_width_of_a_triangle():
    x = np.r_[np.arange(11.0), np.arange(9.0, -1, -1)]
    idx, prom, width = K.measured(x, 1, 0.0)
    assert (idx.tolist(), prom.tolist(), width.tolist()) == ([10], [10.0], [10.0])


def test_recursive_filter_in_blocks():
    sections = K.design("butterworth", 3, 0.05, 0.4)
    x, state = np.random.default_rng(2).normal(size=301), np.arange(6.0)
    want, s, states = [], state.copy(), [state]
    for v in x:
        for k, (b, a) in enumerate(sections):
            y = b[0] * v + s[2 * k]
            s = s.copy()
            s[2 * k : 2 * k + 2] = [s[2 * k + 1] + b[1] * v - a[1] * y, b[2] * v - a[2] * y]
            v = y
        want.append(v)
        states.append(s)
    for n in (301, 296, 5, 0):
        got, left = K.run(sections, x[:n], state)
        assert np.allclose(got, want[:n]) and np.allclose(left, states[n])
    assert np.allclose(K.carried(sections, 37) @ state, K.run(sections, np.zeros(37), state)[1])


def test_spectrum_and_gaussian_kernels(spark):
    x = np.random.default_rng(3).normal(size=77)
    assert K.spectrum(x, 10.0)[1].sum() * 10 / 77 == pytest.approx(x.var())
    sig = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "recording_id string, idx long, v double")
    for f, g in ((samples.gaussian(sig, 30.0), K.gaussian(x, 30.0)), (samples.median_filter(sig, 30.0), K.median(x, 30.0))):
        assert np.allclose([r.v for r in f.orderBy("idx").collect()], g)


def pulse(fs, seconds, hertz=1.2, seed=0):
    t = np.arange(int(fs * seconds)) / fs
    phase = (t * hertz) % 1
    wave = np.exp(-0.5 * ((phase - 0.3) / 0.09) ** 2) + 0.35 * np.exp(-0.5 * ((phase - 0.62) / 0.08) ** 2)
    return wave + 0.004 * np.random.default_rng(seed).normal(size=len(t))


def test_beats_of_a_pulse(spark):
    made = {"up": pulse(30.0, 60), "down": -pulse(30.0, 60), "flat": np.full(300, 2.0)}
    sig = spark.createDataFrame([(n, k, float(v), 30.0) for n, x in made.items() for k, v in enumerate(x)], "recording_id string, idx long, v double, fs double")
    m = {r.recording_id: r for r in beats.morphology(sig).collect()}
    assert m["up"].hr == pytest.approx(72, abs=1) and m["up"].peak_count == 72 and 0.1 < m["up"].pulse_width < 0.4 and m["flat"].hr == 72.0
    o = {r.recording_id: (r.orientation, r.reverse) for r in beats.orientation(sig).collect()}
    assert o == {"up": ("normal", False), "down": ("inverted", True), "flat": ("uncertain", False)}
    f = quality.readiness(beats.features(sig).withColumn("fs_status", F.lit("FS_UNRESOLVED"))).collect()
    assert all(r.readiness_score <= 85 and r.readiness_category != "A" for r in f)
    q = {r.recording_id: r for r in beats.scored(beats.metrics(sig, sig)).collect()}
    assert q["up"].snr_db > 10 and q["up"].beat_consistency > 0.9 and q["up"].quality_score > q["flat"].quality_score
    board = beats.scoreboard(sig)
    assert board.count() == 21 and {r.best for r in beats.best_filter(board).collect()} <= set(beats.FILTERS)
    g = beats.guarded(sig, "Butterworth")
    assert {r.status for r in g.collect()} == {"PASSED"} and beats.guard_output(sig, "Butterworth", g).count() == sig.count()
    assert all(r.notch_preserved in (True, False) for r in beats.notch(sig, "Gaussian").collect())
    e = {r.recording_id: r.estimated_fs for r in rates.estimated(sig).collect()}
    assert e["up"] == 30.0 and e["flat"] == 100.0


def made_files(folder):
    """The recordings that FIXTURES names, in folders of their own."""
    (folder / "deep").mkdir(parents=True)
    acq = "acq title\n1 msec/sample\n2 channels\nmin,CH1,CH3\n,5000 samples,5000 samples\n" + "\n".join(f"{k / 60000:.8f},{k % 7},{v:.6f}" for k, v in enumerate(pulse(1000.0, 5)))
    (folder / "acq.csv").write_text(acq)
    (folder / "plain_30hz.txt").write_text("\n".join(f"{v:.6f}" for v in pulse(30.0, 80)))
    (folder / "deep" / "tabs.tsv").write_text("time\tppg\t\t\n" + "\n".join(f"\t{k / 30:.5f}\t{v:.6f}\t\t" if k == 7 else f"{k / 30:.5f}\t{v:.6f}" for k, v in enumerate(pulse(30.0, 40))))
    (folder / "utf16.csv").write_text("id,signal\n" + "\n".join(f"1,{v:.5f}" for v in pulse(30.0, 20)), encoding="utf-16")
    (folder / "latin1.csv").write_bytes("mètre,ppg\n".encode("latin-1") + "\n".join(f"{k},{v:.5f}" for k, v in enumerate(pulse(30.0, 12))).encode())
    (folder / "short.csv").write_text("ppg\n" + "\n".join(f"{k % 4}" for k in range(12)))
    gaps = [[f"{k / 30:.5f}", f"{v:.5f}", ""] for k, v in enumerate(pulse(30.0, 30))]
    for k, x in ((0, "nan"), (1, "NaN"), (40, "inf"), (41, "-inf"), (42, "oops"), (899, "nan")):
        gaps[k][1] = x
    (folder / "gaps.csv").write_text("time,ppg,hollow,end\n" + "\n".join(",".join(r) + f",{k}" for k, r in enumerate(gaps)))
    (folder / "nul.txt").write_bytes(b"1,2\x00,3\n")
    (folder / "prose.txt").write_text("nothing but words here\nand more of them\n")
    (folder / "data.dat").write_text("1,2\n3,4\n5,6\n")
    (folder / "empty.csv").write_text("")
    (folder / "_under.csv").write_text("ppg\n" + "\n".join(f"{v:.5f}" for v in pulse(30.0, 15)))
    (folder / ".hidden.csv").write_text("1\n2\n")
    for sub, seconds in (("a", 30), ("b", 24)):
        (folder / sub).mkdir()
        (folder / sub / "x.csv").write_text("time,ppg\n" + "\n".join(f"{k / 30:.5f},{v:.6f}" for k, v in enumerate(pulse(30.0, seconds, seed=seconds))))
    with zipfile.ZipFile(folder / "set.zip", "w") as z:
        z.writestr("inner.csv", "ppg,other\n" + "\n".join(f"{v:.5f},{k % 5}" for k, v in enumerate(pulse(30.0, 15))))
        z.writestr(".hidden", "1")
    (folder / "broken.zip").write_bytes(b"PK\x03\x04nonsense")


def test_batch_over_files(spark, tmp_path):
    folder = tmp_path / "set"
    made_files(folder)
    hand = spark.createDataFrame([(f"{folder}/set.zip/inner.csv", 30.0, "Force Normal", "Median", None, "ppg"), (f"{folder}/b/x.csv", None, None, None, True, None)], batch.OVERRIDES)
    batch.process(spark, str(folder), str(tmp_path / "out"), hand)
    rows = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out" / "summary")).collect()
    got = {r.file_name: r for r in rows}
    assert len(rows) == 16 and set(rows[0].asDict()) == set(batch.SUMMARY)
    assert {n: got[n].status for n in ("acq.csv", "plain_30hz.txt", "tabs.tsv", "nul.txt", "prose.txt", "data.dat", "broken.zip", "empty.csv", "_under.csv")} == {
        "acq.csv": "Ready", "plain_30hz.txt": "Ready", "tabs.tsv": "Partially Ready", "nul.txt": "Unsafe", "prose.txt": "Research Only", "data.dat": "Research Only", "broken.zip": "Unsafe", "empty.csv": "Unsafe", "_under.csv": "Ready",
    }
    assert got["acq.csv"].sampling_rate_hz == 1000.0 and got["plain_30hz.txt"].sampling_rate_hz == 30.0 and got["inner.csv"].sampling_rate_hz == 30.0
    assert got["plain_30hz.txt"].overall_verdict == "Verification PASS" and got["plain_30hz.txt"].duration_seconds == 80.0
    assert got["empty.csv"].failure_reasons == files.WHY["empty"] and got["nul.txt"].failure_reasons == files.WHY["binary"]
    # what a step cannot take fails, and says why; the others are unharmed
    short = got["short.csv"]
    assert short.failure_reasons == "Pipeline execution failed: The length of the input vector x must be greater than padlen, which is 21."
    assert (short.quality_score, short.quality_band, short.overall_verdict) == (0.0, "Poor", "Verification FAIL")
    assert got["prose.txt"].failure_reasons == "Pipeline execution failed: the signal column holds no numbers" and got["data.dat"].failure_reasons.startswith("Pipeline execution failed: The length")
    # one file a recording: two of one name stay apart
    out = tmp_path / "out" / "recordings"
    for sub, n in (("a", 900), ("b", 720)):
        lines = (out / sub / "x.csv_raw.csv").read_text().split("\n")
        assert lines[0] == "time,ppg" and len(lines) == n + 2 and (out / sub / "x.csv_features.csv").exists() and (out / sub / "x.csv_report.json").exists()
        assert [float(x.split(",")[1]) for x in lines[1:-1]] == [round(v, 6) for v in pulse(30.0, n / 30, seed=n // 30).tolist()]
    assert (out / "b" / "x.csv_report.json").read_text().count('"orientation":"inverted"') == 1
    pre = (out / "deep" / "tabs.tsv_preprocessed.csv").read_text().split("\n")
    assert pre[0] == "time_sec,preprocessed_signal,vpg_1st_derivative,apg_2nd_derivative" and len(pre) == 1202
    assert not list(out.glob("short*")) and not [p for p in out.iterdir() if p.name.startswith("_temporary")]
    raw = [x.split(",") for x in (out / "gaps.csv_raw.csv").read_text().split("\n")[1:-1]]
    v = [round(x, 5) for x in pulse(30.0, 30).tolist()]
    ppg = [float(r[1]) for r in raw]
    assert ppg[:3] == [v[2]] * 3 and ppg[898:] == [v[898]] * 2 and np.allclose(ppg[39:44], np.linspace(v[39], v[43], 5)) and {r[2] for r in raw} == {"0.0"}
    role = {r.recording_id.rsplit("/", 1)[-1]: (r.timestamp_col, r.signal_col) for r in spark.read.parquet(str(tmp_path / "out" / "steps" / "info")).collect()}
    assert role["acq.csv"] == ("min", "CH3") and role["tabs.tsv"] == ("time", "ppg") and role["utf16.csv"][1] == "signal" and role["inner.csv"][1] == "ppg" and role["latin1.csv"] == ("mètre", "ppg")
    gone = recordings.scanned(spark, str(tmp_path / "nowhere")).collect()
    assert [(r.status, r.reason) for r in gone] == [("Unsafe", files.WHY["path"])]
    # read through the source's own interface, with the columns that are asked for
    frame = spark.read.format("recordings").option("rows", "samples").schema("file_path string, v array<double>").load(str(folder / "a"))
    assert frame.count() == 900 and "idx" not in frame._jdf.queryExecution().executedPlan().toString()


def test_batch_remembers(spark, tmp_path):
    folder, memo = tmp_path / "set", str(tmp_path / "memo")
    folder.mkdir()
    for k in range(3):
        (folder / f"f{k}.csv").write_text("ppg\n" + "\n".join(f"{v:.5f}" for v in pulse(30.0, 20, seed=k)))
    first = sorted(batch.process(spark, str(folder), str(tmp_path / "one"), None, memo).collect())
    (folder / "f1.csv").write_text("ppg\n" + "\n".join(f"{v:.5f}" for v in pulse(30.0, 25, seed=9)))
    second = sorted(batch.process(spark, str(folder), str(tmp_path / "two"), None, memo).collect())
    read = spark.read.parquet(str(tmp_path / "two" / "steps" / "info")).collect()
    assert [r.recording_id.rsplit("/", 1)[-1] for r in read] == ["f1.csv"] and [p.name for p in (tmp_path / "two" / "recordings").glob("*_raw.csv")] == ["f1.csv_raw.csv"]
    assert len(second) == 3 and second[0] == first[0] and second[2] == first[2] and second[1] != first[1]
    scan = recordings.scanned(spark, str(folder))
    hand = spark.createDataFrame([(f"{folder}/f2.csv", 60.0, None, None, None, None)], batch.OVERRIDES)
    keys = [{r.file_path: r.run_key for r in batch._keyed(scan, h).collect()} for h in (None, hand)]
    assert [p.rsplit("/", 1)[-1] for p in keys[0] if keys[0][p] != keys[1][p]] == ["f2.csv"]  # what is set by hand is part of what is remembered


def test_layout_of_texts(spark):
    made = [("a", "x;y\n1;2\n;4\n5;6"), ("b", None), ("c", "id name\n1 2\n3 4\n5 6\n7 8\n9 x"), ("d", "count,n\n1,2\n3,4")]
    texts = spark.createDataFrame(made, "file_path string, text string")
    found = {r.recording_id: r for r in recordings.described(tables.layouts_of(texts)).collect()}
    assert found["a"].columns == ["x", "y"] and found["a"].loader_ok and found["b"].error.startswith("No delimited data") and found["c"].id_col == "id"
    assert found["d"].columns == ["col_0", "col_1"]  # a header that counts is none
    assert [r.v for r in tables.samples_of(texts).filter("file_path = 'a'").orderBy("idx").collect()] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]


def as_signal(spark, made, fs=100.0):
    return spark.createDataFrame([(n, k, float(v), fs) for n, x in made.items() for k, v in enumerate(x)], "recording_id string, idx long, v double, fs double")


def test_recursive_filters_over_blocks(spark):
    rng = np.random.default_rng(0)
    made = {"a": rng.normal(size=700).cumsum(), "b": rng.normal(size=60), "c": rng.normal(size=22), "d": rng.normal(size=21), "e": rng.normal(size=1)}
    sig = as_signal(spark, made)
    for name, size in (("Butterworth", 1000), ("chebyshev", 120), ("baseline", 15)):
        out = blocks.filtered(sig, name, 0, size)
        got = {(r.recording_id, r.idx): (r.v, r.error) for r in out.collect()}
        assert set(got) == {(n, k) for n, x in made.items() for k in range(len(x))}
        for n, x in made.items():
            v, errors = [got[n, k][0] for k in range(len(x))], {got[n, k][1] for k in range(len(x))}
            try:
                assert np.abs(np.array(v) - K.apply(name, x, 100.0)).max() < 1e-9 and errors == {None}
            except ValueError as e:
                assert v == x.tolist() and errors == {str(e)}
    assert blocks.filtered(sig, "Wavelet").filter("error is null").count() == sig.count()


def test_autocorrelation_over_blocks(spark):
    rng = np.random.default_rng(1)
    made = {"a": rng.normal(size=700), "b": rng.normal(size=61), "c": np.ones(9), "d": np.ones(1)}
    got = {(r.recording_id, r.lag): r.r for r in blocks.correlated(as_signal(spark, made), 50, 64).collect()}
    for n, x in made.items():
        y, most = x - x.mean(), max(1, min(len(x) // 2, 50))
        f = np.correlate(y, y, "full")[len(y) - 1 :]
        assert sorted(k for m, k in got if m == n) == list(range(most)) and np.allclose([got[n, k] for k in range(most)], (f / f[0] if f[0] > 0 else f)[:most], atol=1e-9)


def test_peaks_over_blocks(spark):
    rng = np.random.default_rng(2)
    made = {"a": rng.normal(size=260).cumsum(), "b": rng.integers(0, 4, 150).astype(float), "ramp": np.arange(60) + 5 * (np.arange(60) % 3 == 0), "flat": np.ones(20), "plate": np.repeat(rng.integers(0, 3, 20), 7).astype(float)}
    sig = as_signal(spark, made, 25.0)
    for seconds, share, size in ((0.2, 0.05, 24),):
        want = {(r.recording_id, r.side, r.idx): (r.v, r.prominence, r.width, r.fs) for r in kernels.found_peaks(sig, seconds, share).collect()}
        got = {(r.recording_id, r.side, r.idx): (r.v, r.prominence, r.width, r.fs) for r in blocks.found_peaks(sig, seconds, share, size).collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_filters_on_frames(spark):
    rng = np.random.default_rng(4)
    made = {n: rng.normal(size=n) for n in (1, 3, 5, 6, 9, 13, 14, 40)}
    sig = spark.createDataFrame([(str(n), k, float(v)) for n, x in made.items() for k, v in enumerate(x)], "recording_id string, idx long, v double")
    for out, kernel in ((samples.savitzky_golay(sig, 30.0), K.savitzky_golay), (samples.gaussian(sig, 30.0), K.gaussian)):
        got = {(r.recording_id, r.idx): r.v for r in out.collect()}
        assert len(got) == sum(made) and all(np.allclose([got[str(n), k] for k in range(n)], kernel(x, 30.0)) for n, x in made.items())


def test_quality_of_a_spike(spark):
    """One sample far out is clipped before anything but gaps is measured."""
    clean = pulse(30.0, 40)
    spiked = clean.copy()
    spiked[500] = 400.0
    got = {r.recording_id: r for r in beats.scored(beats.metrics(*[as_signal(spark, {"clean": clean, "spiked": spiked}, 30.0)] * 2)).collect()}
    a, b = got["clean"], got["spiked"]
    assert b.variance == pytest.approx(a.variance, rel=0.1) and abs(b.kurtosis - a.kurtosis) < 1 and b.entropy > 3 and b.peak_stability < 1 and b.quality_score > 40


def test_filters_that_fail_have_no_marks(spark):
    board = beats.scoreboard(as_signal(spark, {"short": np.arange(12.0) % 4, "long": pulse(30.0, 10)}, 30.0)).collect()
    errors = {(r.recording_id, r.filter): r.error for r in board}
    assert errors["short", "Butterworth"] == K.too_short(21) and errors["short", "None"] is None and not any(errors["long", f] for f in beats.FILTERS)
    assert all((r.total_score is None) == (r.error is not None) for r in board)


def test_gaps_and_short_chunks(spark):
    sig = spark.createDataFrame([("a", k, v) for k, v in enumerate([None, 1.0, None, 3.0, float("inf")])], "recording_id string, idx long, v double")
    assert [r.v for r in samples.fill_gaps(sig).orderBy("idx").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
    assert {r.idx for r in samples.chunks(sig, 4.0, 0.5).collect()} == {0, 1}


def test_gaussian_keeps_constants(spark):
    sig = spark.createDataFrame([("a", k, 2.5) for k in range(30)], "recording_id string, idx long, v double")
    assert all(abs(r.v - 2.5) < 1e-12 for r in samples.gaussian(sig, 30.0).collect())


def test_verdict_rules(spark):
    made = spark.createDataFrame(
        [(1, True, "PASS", True, "PASSED", "A", 100), (2, True, "FS_UNRESOLVED", True, "PASSED", "B", 85), (3, False, "FS_UNRESOLVED", False, "DEGRADED_FALLBACK", "D", 30)],
        "k int, loader_ok boolean, fs_status string, preprocess_ok boolean, guard_status string, readiness_category string, readiness_score int",
    )
    got = {r.k: (r.overall_verdict, len(r.failure_reasons)) for r in quality.verdict(made).collect()}
    assert got == {1: ("Verification PASS", 0), 2: ("Verification FAIL", 1), 3: ("Verification FAIL", 5)}


def test_numbers_and_rates(spark):
    tokens = spark.createDataFrame([("1",), ("-2.5e3",), ("nan",), ("1_000",), ("1d",), ("",), ("abc",)], "t string")
    assert [r[0] for r in tokens.select(files.is_number(F.col("t"))).collect()] == [True, True, True, True, False, False, False]
    rate = spark.createDataFrame([("4 msec/sample",), ("none",)], "t string").select(rates.from_entry(F.col("t")))
    assert [r[0] for r in rate.collect()] == [250.0, None]
