"""Periodic runs of words by harmonic grid probing."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphygmo.llm.common import WORD, crc32_sql, table

#: A run repeats its period so many times at least, and has so many words at least.
TIMES, LEAST = 4, 6
#: Grid points tested at once, and words compared at first and at most when a run is extended.
POINTS, FIRST, CHUNK = 1 << 20, 32, 1 << 16


def _right(w: np.ndarray, i: int, p: int) -> int:
    """The first place from ``i`` on whose word differs from that ``p`` later, or where there is none so late."""
    size, last = FIRST, len(w) - p
    while i < last:
        stop = min(i + size, last)
        differs = w[i:stop] != w[i + p : stop + p]
        k = int(differs.argmax())
        if differs[k]:
            return i + k
        i, size = stop, min(4 * size, CHUNK)
    return last


def _left(w: np.ndarray, i: int, p: int) -> int:
    """The first of the places up to ``i`` that all have the word which stands ``p`` later."""
    size = FIRST
    while i > 0:
        stop = max(i - size, 0)
        differs = (w[stop:i] != w[stop + p : i + p])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return i - k
        i, size = stop, min(4 * size, CHUNK)
    return 0


def _survivors(w: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(p, j, end) of the stretches of grid points j <= .. < end whose word and the next two points' are found again ``p``
    later, by rising ``p``, then ``j``: a run holds three such neighbours of the grid of its period at least."""
    n, low = len(w), 1
    while low <= n // TIMES:
        counts = (n - 1) // np.arange(low, min(n // TIMES, low + POINTS) + 1)
        high = low + max(1, int(np.searchsorted(np.cumsum(counts), POINTS)))
        counts = counts[: high - low]
        p = np.repeat(np.arange(low, low + len(counts)), counts)
        j = np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)
        same = w[j * p] == w[(j + 1) * p]
        three = same[:-2] & same[1:-1] & same[2:] & (p[:-2] == p[2:])
        at = np.flatnonzero(three)
        if len(at):
            cut = np.r_[True, (np.diff(at) > 1) | (p[at[1:]] != p[at[:-1]])]
            first, last = at[cut], at[np.r_[cut[1:], True]]
            yield from zip(p[first].tolist(), j[first].tolist(), (j[last] + 1).tolist(), strict=True)
        low += len(counts)


def found_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in an array of word numbers, by start, then period.

    For each period p the words at jp and (j+1)p are compared: n/p points, n log n for all periods. Where three neighbours
    agree, the stretch is extended word by word to both sides. Grid points inside what was just extended, and those inside
    a run found before whose period divides p, are skipped: they can only give the same stretch again. So what is found
    has no smaller period.
    """
    found: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts, and ends
    for p, j, end in _survivors(w):
        while j < end:
            i = j * p
            beyond = None
            for q, (starts, ends) in found.items():
                if p % q == 0 and (k := bisect_right(starts, i)) and ends[k - 1] > i + p:
                    beyond = max(j + 1, -(-ends[k - 1] // p) - 1)
                    break
            if beyond is None:
                a, b = _left(w, i, p), _right(w, i, p)
                if b - a + p >= max(LEAST, TIMES * p):
                    starts, ends = found.setdefault(p, ([], []))
                    starts.append(a)
                    ends.append(b + p)
                beyond = max(j + 1, -(-b // p))
            j = beyond
    return sorted((a, b - a, p) for p, (starts, ends) in found.items() for a, b in zip(starts, ends, strict=True))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The rows of ``docs``, all columns, with the runs of each whole text (array of start, length, period, in words, by
    start, then period) and the text with each run brought down to its first period (words joined by one space).

    A run is a stretch of words of smallest period q, at least max(6, 4 q) long, that no neighbouring word extends. Texts
    are worked on one by one where they are read. Null or empty text, or without words: no runs, collapsed empty. Repeated
    rows: rows of their own. No rows: no rows. The new names must not be columns of ``docs`` (ValueError).
    """
    if {runs, collapsed} & set(docs.columns):
        raise ValueError(f"documents have a column {runs} or {collapsed}")
    at, names = docs.columns.index("text"), [*docs.columns, runs, collapsed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for raw in batch.column(at).cast(pa.binary()):
                words = (raw.as_py() or b"").split()  # of bytes: at the six ASCII spaces and controls alone
                number: dict[bytes, int] = {}
                w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int32, len(words))
                these = found_runs(w)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in these])
                if these:
                    words = [words[k] for k in np.flatnonzero(kept_words(len(words), these)).tolist()]
                texts.append(b" ".join(words))
            yield pa.record_batch([*batch.columns, pa.array(found, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())], names)

    each = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(runs, T.ArrayType(each)), T.StructField(collapsed, T.StringType())]))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where of every tenth document by h = crc32(doc_id) the words from a on repeat the first p of
    them; a and p follow from h. Null doc_id: as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.size("words").cast("long")
    g = F.floor(F.col("h") / 10).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    words = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    tenth = docs.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    some = F.coalesce(F.size("words"), F.lit(0)) > 0
    tenth = tenth.withColumn("a", F.when(some, a)).withColumn("p", F.when(some, p))
    return tenth.select("doc_id", F.when(some, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def summed_up() -> list[Column]:
    """What tells of the columns ``runs`` and ``collapsed``: counts, the longest run, and digests."""
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, r: F.when(b.isNull() | (r["length"] > b["length"]), r).otherwise(b))
    of = lambda c: best[c].alias(c)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]).cast("string")), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return [
        F.size("runs").cast("long").alias("n_runs"), of("start"), of("length"), of("period"), F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every whole text of ``documents``, every tenth of which is made periodic from some word on."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", *summed_up())


#: All periods' grids in one table; of the periods with three agreeing neighbours, the stretches of equal words.
OP12_SQL = rf"""
WITH hashed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, CAST({crc32_sql('doc_id')} AS BIGINT) AS h FROM documents),
sized AS (SELECT *, CAST(len(o) AS BIGINT) AS n, h // 10 AS g FROM hashed),
cut AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
made AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
texts AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: o[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) END AS w FROM made),
word AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM texts),
steps AS (SELECT doc_id, n, unnest(range(1, n // {TIMES} + 1)) AS p FROM texts),
grid AS (SELECT doc_id, p, unnest(range(0, (n - 1) // p)) AS j FROM steps),
same AS (SELECT g.doc_id, g.p, g.j, a.w = b.w AS ok FROM grid g JOIN word a ON a.doc_id = g.doc_id AND a.i = g.j * g.p JOIN word b ON b.doc_id = g.doc_id AND b.i = (g.j + 1) * g.p),
three AS (SELECT doc_id, p, bool_and(ok) OVER s AND count(*) OVER s = 3 AS ok FROM same WINDOW s AS (PARTITION BY doc_id, p ORDER BY j ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
tried AS (SELECT DISTINCT doc_id, p FROM three WHERE ok),
equal AS (SELECT t.doc_id, t.p, a.i FROM tried t JOIN word a ON a.doc_id = t.doc_id JOIN word b ON b.doc_id = t.doc_id AND b.i = a.i + t.p WHERE a.w = b.w),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS part FROM equal),
stretch AS (SELECT doc_id, min(i) AS start, count(*) + p AS length, p AS period FROM island GROUP BY doc_id, p, part HAVING count(*) + p >= greatest({LEAST}, {TIMES} * p)),
runs AS (SELECT doc_id, start, length, min(period) AS period FROM stretch GROUP BY ALL),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
  arg_min(struct_pack(s := start, l := length, q := period), struct_pack(l := -length, s := start, q := period)) AS b FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT r.doc_id, w.i FROM runs r JOIN word w ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
left_over AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS c FROM word w LEFT JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i WHERE d.i IS NULL GROUP BY w.doc_id)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM texts t LEFT JOIN told USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
