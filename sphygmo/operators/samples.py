"""Sample-wise transforms of signals (recording_id, idx, v): windows by recording, one shuffle each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from sphygmo.operators import kernels


def W(back: bool = False) -> WindowSpec:  # noqa: N802
    """Samples of a recording in order, or backward: frames that end with the recording's last row would be gone through whole
    for each row, so what lies ahead is asked of a backward window up to the row."""
    return Window.partitionBy("recording_id").orderBy(F.desc("idx") if back else F.col("idx"))


def ALL() -> WindowSpec:  # noqa: N802
    """All samples of a recording."""
    return Window.partitionBy("recording_id")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def trim(sig: DataFrame, fs: float, start: float, end: float) -> DataFrame:
    """Cuts ``start`` seconds off the front and ``end`` off the back; at least one sample stays."""
    n = F.count("*").over(ALL())
    first = F.greatest(F.lit(0), F.least(F.lit(int(start * fs)), n - 1))
    last = F.greatest(first + 1, F.least(n - F.lit(int(end * fs)), n))
    return sig.withColumn("_a", first).withColumn("_b", last).filter("idx >= _a AND idx < _b").drop("_a", "_b")


def reverse(sig: DataFrame) -> DataFrame:
    return sig.withColumn("v", -F.col("v") + F.lit(0.0))


def center(sig: DataFrame, method: str) -> DataFrame:
    """mean, median or detrend; anything else leaves the signal as it is."""
    if method == "detrend":
        return detrend(sig)
    by = {"mean": F.avg("v").over(ALL()), "median": F.median("v").over(ALL())}.get(method)
    return sig if by is None else sig.withColumn("v", F.col("v") - by)


def beside(sig: DataFrame, **about: Column) -> DataFrame:
    """Adds what aggregates tell of each recording: grouped and joined, as a window over all samples holds them in one task. Each
    sample has its row there; a left join, as of an inner one the samples could be the side that is sent to every executor."""
    told = sig.groupBy(F.col("recording_id").alias("_id")).agg(*[c.alias(n) for n, c in about.items()])
    return sig.join(told, sig["recording_id"].eqNullSafe(told["_id"]), "left").drop("_id")


def detrend(sig: DataFrame) -> DataFrame:
    """Least-squares line taken off; a recording of one sample becomes 0."""
    x = beside(sig, _slope=F.coalesce(F.regr_slope("v", "idx"), F.lit(0.0)), _at=F.avg("idx"), _mean=F.avg("v"))
    return x.withColumn("v", F.col("v") - F.col("_mean") - F.col("_slope") * (F.col("idx") - F.col("_at"))).drop("_slope", "_at", "_mean")


def chunks(sig: DataFrame, fs: float, seconds: float) -> DataFrame:
    """Adds ``chunk``: pieces of int(seconds * fs) samples, a last piece under one second joined to the one before; one
    chunk if the size is not between 1 and the length. Chunks under one second: only the first is returned."""
    c, n = int(seconds * fs), F.count("*").over(ALL())
    if c <= 0:
        return sig.withColumn("chunk", F.lit(0).cast("long"))
    raw = F.floor(F.col("idx") / c)
    short = (n % c > 0) & (n % c < int(fs)) & (raw == F.floor(n / c)) & (raw > 0)
    out = sig.withColumn("chunk", F.when(n < c, F.lit(0)).when(short, raw - 1).otherwise(raw).cast("long"))
    return out.filter("chunk = 0") if c < int(fs) else out


def fill_columns(frame: DataFrame, names: list[str]) -> DataFrame:
    """Null, NaN and infinite cells of each column by linear interpolation along idx; ends by the nearest; a column without a
    number: 0. All columns share one order of a recording."""
    past, ahead = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (W(), W(back=True)))
    clean = {c: F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), F.col(c)) for c in names}
    out = frame.withColumns(clean)
    made = {}
    for c in names:
        at = F.when(F.col(c).isNotNull(), F.col("idx"))
        (a, b), (i, j) = ([F.last(x, True).over(w) for w in (past, ahead)] for x in (c, at))
        line = a + (b - a) * F.try_divide((F.col("idx") - i).cast("double"), (j - i).cast("double"))
        made[c] = F.coalesce(c, line, a, b, F.lit(0.0))
    return out.withColumns(made)


def fill_gaps(sig: DataFrame) -> DataFrame:
    """:func:`fill_columns` of the signal alone."""
    return fill_columns(sig, ["v"])


def iqr_clip(sig: DataFrame) -> DataFrame:
    """Clipped to median +- 3.5 IQR where the IQR is above 1e-9."""
    q = kernels.quartiles(sig).withColumnRenamed("recording_id", "_id")
    with_q = sig.join(q, sig["recording_id"].eqNullSafe(q["_id"]), "left").withColumn("_r", F.col("q3") - F.col("q1"))
    low, high = F.col("q2") - 3.5 * F.col("_r"), F.col("q2") + 3.5 * F.col("_r")
    return with_q.withColumn("v", F.when(F.col("_r") > 1e-9, F.least(F.greatest("v", low), high)).otherwise(F.col("v"))).drop("_id", "q1", "q2", "q3", "_r")


def gradient(sig: DataFrame, fs: float, source: str, name: str) -> DataFrame:
    """Central differences, one-sided at the ends; null for a single sample."""
    x, before, after = F.col(source), F.lag(source).over(W()), F.lead(source).over(W())
    d = F.when(before.isNull(), (after - x) * fs).when(after.isNull(), (x - before) * fs).otherwise((after - before) * fs / 2)
    return sig.withColumn(name, d)


def derivatives(sig: DataFrame, fs: float) -> DataFrame:
    return gradient(gradient(sig, fs, "v", "vpg"), fs, "vpg", "apg")


def differences(sig: DataFrame) -> DataFrame:
    return sig.withColumn("d", F.col("v") - F.lag("v").over(W())).filter("d IS NOT NULL")


def normalized(sig: DataFrame) -> DataFrame:
    low, high = F.min("v").over(ALL()), F.max("v").over(ALL())
    return sig.withColumn("v", (F.col("v") - low) / (high - low + 1e-9))


def framed(sig: DataFrame, reach: int) -> DataFrame:
    """Adds ``frame``: the samples up to ``reach`` before and behind each, in order; ``first``: the idx of the first of them;
    and ``n``: how many samples the recording has."""
    n = sig.groupBy("recording_id").agg(F.count("*").alias("n"))
    near = F.collect_list("v").over(W().rowsBetween(-reach, reach))
    return sig.join(n, "recording_id").withColumn("frame", near).withColumn("first", F.greatest(F.lit(0), F.col("idx") - reach))


def gaussian(sig: DataFrame, fs: float, seconds: float = 0.05) -> DataFrame:
    """Gaussian smoothing, sigma max(0.5, seconds * fs) samples, to 4 sigma, ends reflected half a sample out.

    Constant weights on the frame of each sample; places beyond the ends are read at their mirror image."""
    sigma = max(0.5, seconds * fs)
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    weights = F.array(*[F.lit(x / sum(w)) for x in w])
    place = lambda k: F.pmod(F.col("idx") + k - r, 2 * F.col("n"))
    read = lambda k: F.get("frame", (F.least(place(k), 2 * F.col("n") - 1 - place(k)) - F.col("first")).cast("int"))
    v = F.aggregate(F.transform(weights, lambda x, k: x * read(k)), F.lit(0.0), lambda a, x: a + x)
    return framed(sig, r).withColumn("v", v).drop("frame", "first", "n")


def savitzky_golay(sig: DataFrame, fs: float, seconds: float = 0.4) -> DataFrame:
    """Local least-squares parabolas over windows of about ``seconds``; ends from the fits to the first and last window.
    Recordings under five samples stay as they are.

    The parabola of a window follows from three sums over it, as its places are even and centred; so one expression serves
    all window lengths that short recordings bring."""
    w = int(seconds * fs)
    w = max(5, w + (w % 2 == 0))
    size = F.greatest(F.lit(5), F.least(F.lit(w), F.col("n") - 1)).cast("int")
    half = F.floor(F.col("w") / 2)
    x = framed(sig, w).withColumn("w", size)
    tail, head = F.col("idx") >= F.col("n") - half, F.col("idx") < half
    x = x.withColumn("a", F.when(tail, F.col("n") - F.col("w")).when(head, 0).otherwise(F.col("idx") - half))
    m = (F.col("w") - 1) / 2
    t = F.when(tail | head, F.col("idx") - F.col("a") - m).otherwise(0.0)
    part = F.transform(F.slice("frame", (F.col("a") - F.col("first") + 1).cast("int"), F.col("w")), lambda v, k: F.struct(v.alias("a"), (v * (k - m)).alias("b"), (v * (k - m) * (k - m)).alias("c")))
    none = F.struct(*[F.lit(0.0).alias(c) for c in "abc"])
    x = x.withColumn("s", F.aggregate(part, none, lambda p, q: F.struct(*[(p[c] + q[c]).alias(c) for c in "abc"])))
    n = F.col("w").cast("double")
    two, four = n * (n * n - 1) / 12, n * (n * n - 1) * (3 * n * n - 7) / 240
    scale = n * four - two * two
    fit = (four * F.col("s.a") - two * F.col("s.c")) / scale + F.col("s.b") / two * t + (n * F.col("s.c") - two * F.col("s.a")) / scale * t * t
    return x.withColumn("v", F.when(F.col("n") < 5, F.col("v")).otherwise(fit)).drop("frame", "first", "n", "w", "a", "s")


def median_filter(sig: DataFrame, fs: float, seconds: float = 0.1) -> DataFrame:
    """Running median over an odd window, zeros beyond the ends."""
    k = int(seconds * fs)
    k = max(3, k + (k % 2 == 0))
    h = k // 2
    near = F.collect_list("v").over(W().rowsBetween(-h, h))
    padded = F.array_sort(F.concat(near, F.array_repeat(F.lit(0.0), F.lit(k) - F.size(near))))
    return sig.withColumn("v", F.element_at(padded, h + 1))
