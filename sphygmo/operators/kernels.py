"""Kernels over recordings (recording_id, idx, v, fs): each recording is brought together once, in order.

A task goes through its recordings one after another as they come sorted from the shuffle, and holds the samples of one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sphygmo.functions import kernels as K

#: Between a recording's name and the name of a variant of it.
MARK = "\x1f"
#: Rows of a batch that goes back; results of short recordings go together.
ROWS = 1 << 16


def variant(sig: DataFrame, name: str | Column) -> DataFrame:
    """The signal under its own name and that of a variant, so that variants go through one and the same job."""
    return sig.withColumn("recording_id", F.concat_ws(MARK, F.col("recording_id").cast("string"), F.lit(name) if isinstance(name, str) else name))


def by_variant(rows: DataFrame, into: str = "variant") -> DataFrame:
    """Recording (as a string) and variant apart again."""
    parts = F.split("recording_id", MARK)
    return rows.withColumn(into, F.element_at(parts, -1)).withColumn("recording_id", parts[0])


def _recordings(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], told: tuple[str, ...]) -> Iterator[tuple[pa.Scalar, dict[str, np.ndarray], float, list]]:
    """(name, its samples' ``columns``, rate, what the ``told`` columns say) of each recording, from batches sorted by recording.

    Samples are copied out of their batches, which else stay whole, and no column is held twice but while it is put together."""
    now, parts, rate, said = None, {c: [] for c in columns}, 0.0, []

    def whole() -> tuple:
        own = {}
        for c in columns:
            own[c], parts[c] = np.concatenate(parts[c]), []
        return now, own, rate, said

    for batch in batches:
        runs = pc.run_end_encode(batch.column("recording_id"))
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        start = 0
        for end, name in zip(runs.run_ends.to_pylist(), runs.values, strict=True):
            if parts["v"] and not name.equals(now):
                yield whole()
            if not parts["v"]:
                now, rate, said = name, float(batch.column("fs").to_numpy(zero_copy_only=False)[start]), [batch.column(c)[start].as_py() for c in told]
            for c, x in rows.items():
                parts[c].append(x[start:end].astype(float if c == "v" else x.dtype))
            start = end
    if parts["v"]:
        yield whole()


def _each(sig: DataFrame, run: Callable[..., dict[str, np.ndarray]], schema: str, *carry: str, told: tuple[str, ...] = (), along: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``run`` for the samples of each recording in order, its rate and what its ``told`` columns say; ``carry``
    columns (idx, fs) stand beside samples, ``along`` ones go to ``run``. Numbers that are no numbers come out as null. Rows go back some at a time."""
    kinds = dict(sig.dtypes)
    ddl = f"recording_id {kinds['recording_id']}, {schema}" + "".join(f", {c} {kinds[c]}" for c in carry)
    made = to_arrow_schema(StructType.fromDDL(ddl))

    def column(values, kind: pa.DataType, n: int) -> pa.Array:
        if isinstance(values, pa.Array):
            return values
        return pa.array(values, kind, from_pandas=True) if isinstance(values, np.ndarray) else pa.repeat(pa.scalar(values, kind), n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, rows = [], 0
        together = lambda: pa.Table.from_batches(ready, made).combine_chunks().to_batches(ROWS)
        for name, own, rate, said in _recordings(batches, ("v", *[c for c in carry if c != "fs"], *along), told):
            found = run(own.pop("v"), rate, *[own.pop(c) for c in along], *said) | own | ({"fs": rate} if "fs" in carry else {})
            n = max((len(x) for x in found.values() if isinstance(x, np.ndarray)), default=1)
            for at in range(0, n, ROWS):
                part = {c: x[at : at + ROWS] if isinstance(x, np.ndarray) else x for c, x in found.items()}
                here = min(ROWS, n - at)
                ready.append(pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name.as_py(), made.field(0).type), here), *[column(part[f.name], f.type, here) for f in list(made)[1:]]], schema=made))
                rows += here
                if rows >= ROWS:
                    yield from together()
                    ready, rows = [], 0
            del own, found
        if ready:
            yield from together()

    dealt = sig.select("recording_id", "idx", "v", "fs", *[c for c in along if c != "idx"], *told).repartition("recording_id").sortWithinPartitions("recording_id", "idx")
    return dealt.mapInArrow(work, ddl)


def filtered(sig: DataFrame, name: str | None = None, level: int = 0, raw: bool = False) -> DataFrame:
    """(recording_id, v, error, idx, fs) after a filter, without a name after the one in each recording's column ``filter``;
    a recording that it cannot take stays as it is, and ``error`` says why. With ``raw`` each sample as it was stands beside."""

    def run(x: np.ndarray, fs: float, own: str | None = name) -> dict:
        was = {"raw": x} if raw else {}
        try:
            return {"v": K.apply(own, x, fs, level), "error": None} | was
        except ValueError as e:
            return {"v": x, "error": str(e)} | was

    return _each(sig, run, "v double, error string" + (", raw double" if raw else ""), "idx", "fs", told=() if name else ("filter",))


def viewed(sig: DataFrame) -> DataFrame:
    """(recording_id, samples): time, raw, preprocessed, vpg and apg of all samples of a recording in order, nested in one row; ``sig``
    has ``raw`` beside each filtered sample. Columns of numbers are put together, not rows."""
    names = ("time", "raw", "preprocessed", "vpg", "apg")

    def run(x: np.ndarray, fs: float, idx: np.ndarray, raw: np.ndarray) -> dict:
        vpg = K.gradient(x, fs)
        columns = [pa.array(c, pa.float64(), from_pandas=True) for c in (idx / fs, raw, x, vpg, K.gradient(vpg, fs))]
        return {"samples": pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.StructArray.from_arrays(columns, names))}

    kind = f"samples array<struct<{', '.join(f'{n}: double' for n in names)}>>"
    return _each(sig, run, kind, along=("idx", "raw"))


def found_peaks(sig: DataFrame, seconds: float = 0.4, share: float = 0.1, level: bool = False, after: str | None = None) -> DataFrame:
    """(recording_id, side, idx, v, prominence, width, raw, fs): peaks and troughs at least max(5, int(seconds * fs)) samples
    apart, the higher first, and ``share`` of the signal's deviation high; width at half prominence, in samples. They are
    those of the signal ``after`` a filter, where it can take the recording, and with ``level`` without its least-squares line;
    ``raw`` is the sample before either."""

    def run(x: np.ndarray, fs: float) -> dict:
        raw = x
        if after:
            try:
                x = K.apply(after, x, fs)
            except ValueError:
                pass
        if level:
            x = K.leveled(x)
        spread = float(x.std()) if len(x) else 0.0
        least, parts = share * (spread if spread > 1e-9 else 1.0), []
        for side, sign in (("peak", 1.0), ("trough", -1.0)):
            top, prom, width = K.measured(sign * x, max(5, int(seconds * fs)), least)
            parts.append((np.full(len(top), side, object), top, x[top], prom, width, raw[top]))
        names = ("side", "idx", "v", "prominence", "width", "raw")
        return {n: np.concatenate(c) for n, c in zip(names, zip(*parts, strict=True), strict=True)} | {"fs": fs}

    return _each(sig, run, "side string, idx long, v double, prominence double, width double, raw double, fs double")


def quartiles(sig: DataFrame) -> DataFrame:
    """(recording_id, q1, q2, q3), linear between samples; null without any."""

    def run(x: np.ndarray, fs: float) -> dict:
        x = x[~np.isnan(x)]
        return dict(zip(("q1", "q2", "q3"), np.percentile(x, (25, 50, 75)).tolist() if len(x) else (None,) * 3, strict=True))

    return _each(sig.withColumn("fs", F.lit(1.0)), run, "q1 double, q2 double, q3 double")


def spectrum(sig: DataFrame) -> DataFrame:
    """(recording_id, bin, hertz, power): the one-sided power density of each recording; none under two samples."""

    def run(x: np.ndarray, fs: float) -> dict:
        hertz, power = K.spectrum(x, fs) if len(x) > 1 else (np.zeros(0), np.zeros(0))
        return {"bin": np.arange(len(hertz)), "hertz": hertz, "power": power}

    return _each(sig, run, "bin long, hertz double, power double")


def band_power(sig: DataFrame, low: float, high: float) -> DataFrame:
    """(recording_id, s, n): the sums of the power density from ``low`` to ``high`` hertz, and above ``high``."""

    def run(x: np.ndarray, fs: float) -> dict:
        return dict(zip(("s", "n"), K.band_power(x, fs, low, high) if len(x) > 1 else (0.0, 0.0), strict=True))

    return _each(sig, run, "s double, n double")


def periods(sig: DataFrame, lags: int | None = None) -> DataFrame:
    """(recording_id, method, period): samples a beat by acf (up to ``lags``), fft and psd, where each finds one, of all samples."""

    def run(x: np.ndarray, fs: float) -> dict:
        found = K.periods(x, lags)
        return {"method": np.array(list(found), object), "period": np.array(list(found.values()), float)}

    return _each(sig, run, "method string, period double")
