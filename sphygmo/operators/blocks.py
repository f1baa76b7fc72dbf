"""Work on recordings of any length: samples in blocks, and little tables that tie the blocks together.

A recording's rows (recording_id, idx, v, fs) are packed into blocks of so many samples. What a block needs of its
neighbours is a few numbers: a filter's state, extremes, samples that overlap. No task holds a recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphygmo.functions import kernels as K
from sphygmo.sources.shared import Keep, scratch, staged

#: Samples of a block.
BLOCK = 1 << 16


def ends_of(sig: DataFrame) -> DataFrame:
    """(recording_id, n, low, high): how many samples, the first and the last value."""
    return sig.groupBy("recording_id").agg(F.count("*").alias("n"), F.min_by("v", "idx").alias("low"), F.max_by("v", "idx").alias("high"))


def packed(rows: DataFrame, block: int) -> DataFrame:
    """(recording_id, block, fs, at, v): the samples of each block in order, the first of them at place ``at``."""
    cut = rows.withColumn("block", F.floor(F.col("idx") / block).cast("long"))
    each = cut.groupBy("recording_id", "block").agg(F.first("fs").alias("fs"), F.min("idx").alias("at"), F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("s"))
    return each.select("recording_id", "block", "fs", "at", F.transform("s", lambda x: x["v"]).alias("v"))


def unpacked(blocks: DataFrame) -> DataFrame:
    return blocks.select("recording_id", "at", "fs", F.posexplode("v").alias("k", "v")).select("recording_id", (F.col("at") + F.col("k")).alias("idx"), "v", "fs")


def _mapped(df: DataFrame, one: Callable[[pd.Series], tuple], schema: str, *keep: str) -> DataFrame:
    """``keep`` columns and what ``one`` makes of each row."""
    kinds = dict(df.dtypes)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [one(row) for row in part.itertuples(index=False)]
            out = part[list(keep)].copy()
            for k, n in enumerate(names):
                out[n] = pd.Series([m[k] for m in made], index=out.index, dtype=object if "array" in schema.split(", ")[k] else None)
            yield out

    return df.mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in keep], schema]))


def _swept(blocks: DataFrame, name: str, level: int, back: bool) -> DataFrame:
    """The blocks after the recursive filter, gone through forward or backward.

    A block turns the state s it gets into M s + c: M follows from its length, c is the state that its own samples leave when
    they start from none. These maps are composed block by block, a few numbers each, and then every block runs from the
    state that it gets. The first block of the way starts from the steady state of its first sample, and so does its c.
    """
    kind = dict(blocks.dtypes)["recording_id"]

    def left(row) -> tuple:
        sections = K.recursion(name, row.fs, level)
        x = np.asarray(row.v)[:: -1 if back else 1]
        start = K.steady(sections) * x[0] if (row.last if back else row.block == 0) else np.zeros(2 * len(sections))
        return K.run(sections, x, start)[1].tolist(), len(x), float(x[0])

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block", ascending=not back)
        sections = K.recursion(name, float(part["fs"].iloc[0]), level)
        state, states = None, []
        for c, n, edge in zip(part["c"], part["len"], part["edge"], strict=True):
            states.append((K.steady(sections) * edge if state is None else state).tolist())
            state = np.asarray(c) + (0 if state is None else K.carried(sections, int(n)) @ state)
        return pd.DataFrame({"recording_id": part["recording_id"].to_numpy(), "block": part["block"].to_numpy(), "state": states})

    def run(row) -> tuple:
        way = -1 if back else 1
        return (K.run(K.recursion(name, row.fs, level), np.asarray(row.v)[::way], np.asarray(row.state))[0][::way].tolist(),)

    maps = _mapped(blocks, left, "c array<double>, len long, edge double", "recording_id", "block", "fs")
    states = maps.groupBy("recording_id").applyInPandas(composed, f"recording_id {kind}, block long, state array<double>")
    return _mapped(blocks.join(states, ["recording_id", "block"]), run, "v array<double>", "recording_id", "block", "fs", "at", "last")


def filtered(sig: DataFrame, name: str, level: int = 0, block: int = BLOCK) -> DataFrame:
    """(recording_id, v, error, idx, fs) after a recursive filter, forward and backward, of recordings cut into blocks.

    Equal to :func:`kernels.filtered` within rounding, for blocks of any size. The recording's ends are extended by their
    mirror image about the end sample; recordings too short for that stay as they are, with an ``error``.
    """
    tried = K.recursion(name, 100.0, level)
    sig = sig.select("recording_id", "idx", "v", "fs")
    same = lambda df, error=None: df.select("recording_id", "v", F.lit(error).cast("string").alias("error"), "idx", "fs")
    if tried is None:
        return same(sig)
    pad = K.padding(tried)
    rows = sig.join(ends_of(sig), "recording_id")
    taken = F.col("n") > pad
    if name == "low-pass":
        taken &= F.col("fs") / 2 - 0.1 > 0.1
    here = lambda idx, v: F.struct(idx.alias("idx"), v.alias("v"))
    front = F.when(F.col("idx").between(1, pad), here(-F.col("idx"), 2 * F.col("low") - F.col("v")))
    back = F.when(F.col("idx").between(F.col("n") - 1 - pad, F.col("n") - 2), here(2 * (F.col("n") - 1) - F.col("idx"), 2 * F.col("high") - F.col("v")))
    wide = rows.filter(taken).select("recording_id", "fs", F.explode(F.array_compact(F.array(here(F.col("idx"), F.col("v")), front, back))).alias("e"))
    blocks = packed(wide.select("recording_id", (F.col("e.idx") + pad).alias("idx"), "e.v", "fs"), block)
    total = rows.select("recording_id", "n").distinct()
    blocks = blocks.join(total, "recording_id").withColumn("last", F.col("at") + F.size("v") == F.col("n") + 2 * pad).drop("n")
    out = unpacked(_swept(_swept(blocks, name, level, False), name, level, True)).withColumn("idx", F.col("idx") - pad)
    out = out.join(total, "recording_id").filter("idx >= 0 AND idx < n")
    short = rows.filter(~taken & (F.col("n") <= pad))
    left = rows.filter(~taken & (F.col("n") > pad))
    return same(out).unionByName(same(short, K.too_short(pad))).unionByName(same(left))


def correlated(sig: DataFrame, most: int = 2000, block: int = BLOCK) -> DataFrame:
    """(recording_id, lag, r): autocorrelation without the mean at lags 0 to min(n / 2, ``most``) - 1 (lag 0 at least), as a
    share of that at lag 0.

    Each block is multiplied by itself and the ``most`` samples behind it in the frequency domain; the products of all blocks
    are summed by lag. A sample goes to its own block and, near a block's front, to those that look ahead to it.
    """
    block = max(block, most)
    mean = sig.groupBy("recording_id").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    x = sig.join(mean, "recording_id").select("recording_id", "idx", (F.col("v") - F.col("mean")).alias("v"))
    own = F.floor(F.col("idx") / block).cast("long")
    both = x.select("recording_id", "idx", "v", F.explode(F.array_compact(F.array(own, F.when((F.col("idx") % block < most) & (own > 0), own - 1)))).alias("block"))
    each = both.groupBy("recording_id", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("s"))
    each = each.select("recording_id", "block", F.transform("s", lambda e: e["v"]).alias("v"))

    def products(row) -> tuple:
        v = np.asarray(row.v)
        size = 1 << (len(v) + min(block, len(v))).bit_length()
        sums = np.fft.irfft(np.conj(np.fft.rfft(v[:block], size)) * np.fft.rfft(v, size), size)
        return (sums[: min(most, len(v))].tolist(),)

    sums = _mapped(each, products, "p array<double>", "recording_id").select("recording_id", F.posexplode("p").alias("lag", "p"))
    total = sums.groupBy("recording_id", "lag").agg(F.sum("p").alias("s"))
    zero = total.filter("lag = 0").select("recording_id", F.col("s").alias("z"))
    kept = total.join(zero, "recording_id").join(mean.select("recording_id", "n"), "recording_id").filter(F.col("lag") < F.greatest(F.lit(1), F.least(F.floor(F.col("n") / 2), F.lit(most))))
    r = F.when(F.col("z") > 0, F.try_divide("s", "z")).otherwise(F.col("s"))
    return kept.select("recording_id", F.col("lag").cast("long").alias("lag"), r.alias("r"))


# --- peaks -----------------------------------------------------------------------------------------------------------

def _inner_maxima(row) -> tuple:
    """Maxima inside a block, and its first and last run of equal samples, whose neighbours may stand in other blocks."""
    v = np.asarray(row.v)
    start = np.r_[0, np.flatnonzero(v[1:] != v[:-1]) + 1]
    top = K.maxima(v)
    more = len(start) > 1
    return (top + row.at).tolist(), v[top].tolist(), float(v[0]), int(row.at + (start[1] if more else len(v)) - 1), float(v[start[1]]) if more else None, float(v[-1]), int(row.at + start[-1]), float(v[start[-2]]) if more else None, not more


def _edge_maxima(part: pd.DataFrame) -> pd.DataFrame:
    """Maxima whose runs touch a block's edge, from the blocks' first and last runs in order."""
    out, now = [], None  # the open run: start, value, the value before it

    def closed(run: tuple, end: int, after: float) -> None:
        start, value, before = run
        if before is not None and before < value > after:
            out.append(((start + end) // 2, value))

    part = part.sort_values("block")
    for at, first, end, second, last, start, before, single in zip(*[part[c] for c in ("at", "first", "first_end", "second", "last", "last_start", "but_last", "single")], strict=True):
        if now is None:
            now = (at, first, None)
        elif now[1] != first:
            closed(now, at - 1, first)
            now = (at, first, now[1])
        if not single:
            closed(now, end, second)
            now = (start, last, before)
    return pd.DataFrame({"recording_id": np.full(len(out), part["recording_id"].iloc[0], object), "idx": [k for k, _ in out], "v": [v for _, v in out]})


def maxima(blocks: DataFrame) -> DataFrame:
    """(recording_id, idx, v): samples above both neighbours, plateaus once, at their middle; ends never."""
    kind = dict(blocks.dtypes)["recording_id"]
    seen = _mapped(blocks, _inner_maxima, "tops array<long>, heights array<double>, first double, first_end long, second double, last double, last_start long, but_last double, single boolean", "recording_id", "block", "at")
    inner = seen.select("recording_id", F.explode(F.arrays_zip("tops", "heights")).alias("t")).select("recording_id", F.col("t.tops").alias("idx"), F.col("t.heights").alias("v"))
    edges = seen.drop("tops", "heights").groupBy("recording_id").applyInPandas(_edge_maxima, f"recording_id {kind}, idx long, v double")
    return inner.unionByName(edges)


def _settled(part: pd.DataFrame) -> pd.DataFrame:
    """One round in a block and what lies within the distance of it: a maximum stays if no higher one near it can stay, and
    goes if one near it stays; 0 where neither is sure yet."""
    part = part.sort_values("idx", ignore_index=True)
    idx, v, state, own, far = part["idx"].to_numpy(), part["v"].to_numpy(), part["state"].to_numpy().copy(), part["own"].to_numpy(), int(part["distance"].iloc[0])
    rank = np.empty(len(idx), int)
    rank[np.lexsort((-idx, -v))] = np.arange(len(idx))
    for i in np.argsort(rank):
        if state[i]:
            continue
        gone = unsure = False
        for way in (-1, 1):
            j = i + way
            while 0 <= j < len(idx) and abs(idx[j] - idx[i]) < far and not gone:
                gone = state[j] == 1
                unsure |= state[j] == 0 and rank[j] < rank[i]
                j += way
        if gone:
            state[i] = 2
        elif not unsure and own[i]:
            state[i] = 1
    part["state"] = state
    return part[own & (state < 2)]


def spaced(tops: DataFrame, block: int, keep: Keep) -> DataFrame:
    """Of maxima (recording_id, idx, v, distance) those that stay when the higher, of equals the later, drops those closer than
    the distance.

    Each block settles what it can with the maxima near its edges at hand; what hangs on undecided ones beyond goes to another
    round. A round decides all but chains that lead from block to block, so a few are enough unless heights rise or fall
    without end.
    """
    state, turn = tops.withColumn("state", F.lit(0)), 0
    while True:
        near = F.sequence(F.floor((F.col("idx") - F.col("distance")) / block), F.floor((F.col("idx") + F.col("distance")) / block))
        dealt = state.withColumn("block", F.explode(near)).withColumn("own", F.col("block") == F.floor(F.col("idx") / block))
        schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
        state = keep(dealt.groupBy("recording_id", "block").applyInPandas(_settled, schema).drop("block", "own"), f"spaced-{turn}")
        if state.filter("state = 0").isEmpty():
            return state.drop("state")
        turn += 1


def _beyond(x: np.ndarray, k: int, way: int, height: float, above: bool) -> tuple[int, float]:
    """The first place from ``k`` on above ``height`` (or not above it), -1 if none; and the lowest sample before it."""
    low, size = np.inf, 64
    while 0 <= k < len(x):
        part = x[k : k + size] if way > 0 else x[max(0, k - size + 1) : k + 1][::-1]
        hit = part > height if above else part <= height
        j = int(hit.argmax())
        if hit[j]:
            return k + way * j, min(low, float(part[:j].min())) if j else low
        low, k, size = min(low, float(part.min())), k + way * len(part), 4 * size
    return -1, low


_SIDE = "recording_id {0}, idx long, height double, block long, way long, at long, low double, x double, y double"


def _reached(rows: DataFrame, blocks: DataFrame, block: int, above: bool, keep: Keep, name: str) -> DataFrame:
    """(recording_id, idx, way, at, low, x, y) for each place (recording_id, idx, height) and way (-1, 1): the first sample
    above ``height`` (or not above it), -1 if the recording ends before; the lowest sample up to it; its value, and that of
    the sample before it.

    Most places find it in their own block. The others learn from the blocks' extremes in which block it stands, and look
    only there.
    """
    kind = dict(rows.dtypes)["recording_id"]
    listed = rows.withColumn("block", F.floor(F.col("idx") / block).cast("long")).groupBy("recording_id", "block").agg(F.collect_list(F.struct("idx", "height")).alias("p"))

    def inside(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                v = np.asarray(r.v)
                for p in r.p:
                    k = p["idx"] - r.at
                    for way in (-1, 1):
                        at, low = _beyond(v, k + way, way, p["height"], above)
                        found = at >= 0
                        out.append((r.recording_id, p["idx"], p["height"], r.block, way, at + r.at if found else -1, min(low, v[k]), v[at] if found else np.nan, v[at - way] if found else np.nan))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _SIDE.split(", ")])

    first = keep(blocks.join(listed, ["recording_id", "block"]).select("recording_id", "block", "at", "v", "p").mapInPandas(inside, _SIDE.format(kind)), f"{name}-inside")
    ends = blocks.select("recording_id", "block", F.array_max("v").alias("top"), F.array_min("v").alias("low"), F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"))

    def sent(open_: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        about = about.sort_values("block")
        number, top, low, head, tail = (about[c].to_numpy() for c in ("block", "top", "low", "first", "last"))
        targets, lows, after = [], [], []
        for h, b, way, so_far in zip(open_["height"], open_["block"], open_["way"], open_["low"], strict=True):
            k = int(np.searchsorted(number, b)) + way
            at, _ = _beyond(top if above else low, k, way, h, above)
            between = low[k:at] if way > 0 else low[at + 1 : k + 1]
            if at < 0:
                between = low[k:] if way > 0 else low[: k + 1]
            targets.append(int(number[at]) if at >= 0 else -1)
            lows.append(min(so_far, float(between.min())) if len(between) else so_far)
            after.append(float(head[at + 1] if way < 0 else tail[at - 1]) if at >= 0 else np.nan)
        return open_.assign(target=targets, low=lows, y=after)[["recording_id", "idx", "height", "way", "target", "low", "y"]]

    waiting = first.filter("at < 0")
    known = waiting.groupBy("recording_id").cogroup(ends.join(waiting.select("recording_id").distinct(), "recording_id", "left_semi").groupBy("recording_id")).applyInPandas(sent, f"recording_id {kind}, idx long, height double, way long, target long, low double, y double")
    known = keep(known, f"{name}-sent")
    none = known.filter("target < 0").select("recording_id", "idx", "way", F.lit(-1).cast("long").alias("at"), "low", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    there = known.filter("target >= 0").groupBy("recording_id", F.col("target").alias("block")).agg(F.collect_list(F.struct("idx", "height", "way", "low", "y")).alias("p"))

    def looked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                v = np.asarray(r.v)
                for p in r.p:
                    way = p["way"]
                    k = 0 if way > 0 else len(v) - 1
                    at, low = _beyond(v, k, way, p["height"], above)
                    out.append((r.recording_id, p["idx"], way, at + r.at, min(low, p["low"]), v[at], p["y"] if at == k else v[at - way]))
            yield pd.DataFrame(out, columns=["recording_id", "idx", "way", "at", "low", "x", "y"])

    later = blocks.join(there, ["recording_id", "block"]).select("recording_id", "at", "v", "p").mapInPandas(looked, f"recording_id {kind}, idx long, way long, at long, low double, x double, y double")
    return first.filter("at >= 0").select("recording_id", "idx", "way", "at", "low", "x", "y").unionByName(none).unionByName(later)


def found_peaks(sig: DataFrame, seconds: float = 0.4, share: float = 0.1, block: int = BLOCK, keep: Keep | None = None) -> DataFrame:
    """(recording_id, side, idx, v, prominence, width, fs), as :func:`kernels.found_peaks` finds them, of recordings cut into
    blocks: maxima that touch a block's edge are settled by the blocks' first and last runs, distances round by round,
    prominence and width by the blocks' extremes."""
    keep = keep or staged(scratch(sig.sparkSession))
    sig = sig.select("recording_id", "idx", "v", "fs")
    about = keep(sig.groupBy("recording_id").agg(F.first("fs").alias("fs"), F.stddev_pop("v").alias("spread"), F.count("*").alias("n")), "recordings")
    out = None
    for side, sign in (("peak", 1.0), ("trough", -1.0)):
        blocks = keep(packed(sig.withColumn("v", sign * F.col("v")), block), f"{side}-blocks")
        distance = F.greatest(F.lit(5), (F.lit(seconds) * F.col("fs")).cast("int"))
        tops = maxima(blocks).join(about.select("recording_id", distance.alias("distance")), "recording_id")
        local = lambda df, name, side=side: keep(df, f"{side}-{name}")
        tops = spaced(tops, block, local)
        edge = _reached(tops.select("recording_id", "idx", F.col("v").alias("height")), blocks, block, True, local, "height")
        base = edge.groupBy("recording_id", "idx").agg(F.max("low").alias("base"))
        kept = tops.join(base, ["recording_id", "idx"]).join(about.select("recording_id", "fs", "spread", "n"), "recording_id").withColumn("prominence", F.col("v") - F.col("base"))
        least = share * F.when(F.col("spread") > 1e-9, F.col("spread")).otherwise(1.0)
        kept = local(kept.filter(F.col("prominence") >= least).withColumn("height", F.col("v") - F.col("prominence") / 2), "kept")
        cross = _reached(kept.select("recording_id", "idx", "height"), blocks, block, False, local, "width").join(kept.select("recording_id", "idx", "height", "n"), ["recording_id", "idx"])
        place = F.when(F.col("at") < 0, F.when(F.col("way") < 0, 0.0).otherwise(F.col("n") - 1.0)).otherwise(F.col("at") - F.col("way") * F.coalesce(F.try_divide(F.col("height") - F.col("x"), F.col("y") - F.col("x")), F.lit(0.0)))
        width = cross.groupBy("recording_id", "idx").agg(F.sum(place * F.col("way")).alias("width"))
        part = kept.join(width, ["recording_id", "idx"]).select("recording_id", F.lit(side).alias("side"), "idx", (sign * F.col("v")).alias("v"), "prominence", "width", "fs")
        out = part if out is None else out.unionByName(part)
    return out
