"""Toxicity by class-conditional Kneser-Ney models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphygmo.llm.common import free_name, id_filter, table, written

#: The models predict a symbol from the ORDER - 1 before it, across words. A symbol has BITS bits, so there are never
#: more than 2 ** (ORDER * BITS) grams (16.8 million), nor more ratios to broadcast (8 bytes each), whatever the corpus.
ORDER, BITS = 4, 6
SYMBOLS = 1 << BITS
#: Labelled documents on which the score is fitted at most; the models' counts take all others that are not held out.
FITTED = 20_000
#: Symbols of a passage; a document is predicted toxic from this score on.
PASSAGE, CUT = 16, 0.3
#: Symbols handled at once in a long text.
CHUNK = 1 << 20


def _symbols() -> np.ndarray:
    """The symbol of each code point of the basic plane: 0 a space or control, 1 to 26 letters, 27 digits, 28 to 31 other
    ASCII, and 32 classes of all other characters by a multiplicative hash."""
    point = np.arange(1 << 16, dtype=np.uint64)
    found = (32 + (point * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(32)).astype(np.uint8)
    found[:128] = 28 + np.arange(128) % 4
    found[97:123] = np.arange(1, 27)
    found[48:58] = 27
    found[[9, 10, 11, 12, 13, 32]] = 0
    return found


_SYMBOL = _symbols()


def grams(text: str | None) -> Iterator[np.ndarray]:
    """The grams of a text in order, in chunks: lower-cased, words apart by one space, a space before and behind."""
    text, carry = text or "", np.zeros(ORDER - 1, np.int32)
    for k in range(0, max(len(text), 1), CHUNK):
        part = (" " if k == 0 else "") + text[k : k + CHUNK].lower() + (" " if k + CHUNK >= len(text) else "")
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        s = np.concatenate([carry, _SYMBOL[points & 0xFFFF]]).astype(np.int32)
        at = ORDER - 1
        stays = np.r_[np.ones(at, bool), (s[at:] != 0) | (s[at - 1 : -1] != 0)]
        if k == 0:
            stays[at] = True
        s = s[stays]
        n = len(s) - at
        if n > 0:
            code = np.zeros(n, np.int32)
            for j in range(ORDER):
                code = code << BITS | s[j : j + n]
            yield code
        carry = s[-at:]


@dataclass
class Model:
    """Log ratios toxic : ordinary of the grams and, for grams not seen, of their contexts; and the score's weights."""

    gram: np.ndarray
    gram_ratio: np.ndarray
    context: np.ndarray
    context_ratio: np.ndarray
    weights: np.ndarray

    @cached_property
    def ratio(self) -> np.ndarray:
        """The ratio of every gram there can be."""
        out = np.zeros(SYMBOLS ** (ORDER - 1), np.float32)
        out[self.context] = self.context_ratio
        out = np.repeat(out, SYMBOLS)
        out[self.gram] = self.gram_ratio
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Length-normalised log-likelihood ratios, toxic : ordinary, a symbol: of the whole text, of its most toxic
        passage, and of the most toxic one that does not overlap it (0 without such)."""
        total, size, sums, tail = 0.0, 0, [], np.zeros(0)
        for code in grams(text):
            r = self.ratio[code]
            total += float(r.sum(dtype=np.float64))
            size += len(r)
            run = np.concatenate([tail, r.astype(np.float64)])
            upto = np.concatenate([[0.0], np.cumsum(run)])
            sums.append((upto[PASSAGE:] - upto[:-PASSAGE]).astype(np.float32))
            tail = run[-(PASSAGE - 1) :]
        v = np.concatenate(sums) / PASSAGE
        if not len(v):
            return np.array([total / size, total / PASSAGE, 0.0])
        top = int(v.argmax())
        apart = np.concatenate([v[: max(0, top - PASSAGE + 1)], v[top + PASSAGE :]])
        return np.array([total / size, v[top], apart.max() if len(apart) else 0.0])

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): how often each gram stands in the labelled texts (text, toxic 0/1) of either class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def counted() -> pa.RecordBatch:
            codes = np.concatenate([*held[0], *held[1]])
            ordinary = sum(map(len, held[0]))
            name, at = np.unique(codes, return_inverse=True)
            sums = [np.bincount(part, minlength=len(name)) for part in (at[ordinary:], at[:ordinary])]
            held[0].clear(), held[1].clear()
            return pa.record_batch([pa.array(name), *[pa.array(s.astype(np.int64)) for s in sums]], ["gram", "toxic", "ordinary"])

        size = 0
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for code in grams(text.as_py()):
                    held[toxic].append(code)
                    size += len(code)
                    if size >= 4 * CHUNK:
                        yield counted()
                        size = 0
        if size:
            yield counted()

    each = labelled.select("text", "toxic").mapInArrow(run, "gram int, toxic long, ordinary long")
    return each.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _discount(df: DataFrame, *counts: str) -> list[float]:
    """The discount of each column of counts: n1 / (n1 + 2 n2), of how many counts are 1 and 2."""
    found = df.agg(*[F.count(F.when(F.col(c) == k, 1)) for c in counts for k in (1, 2)]).first()
    return [a / (a + 2 * b) if a and b else 0.5 for a, b in zip(found[::2], found[1::2], strict=True)]


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) and (context, ratio), log P(symbol | context, toxic) : ordinary, from :func:`gram_counts`.

    Below the highest order both classes share one distribution: interpolated Kneser-Ney, by how many different symbols
    stand before a shorter gram in either class. A class's own counts, discounted, add to that; where a class has not
    seen a context, the shared distribution stands alone. So rare expressions get ratios near 1. A gram that neither
    class has seen takes the ratio of its context's backoff weights. All of it is grouping and joins of gram tables.
    """
    suffix = lambda df, k, g="gram": df.groupBy(F.col(g).bitwiseAND((1 << BITS * k) - 1).alias("gram")).agg(F.count("*").alias("n"))
    # levels[k]: grams of k symbols by how many different symbols stand before them
    levels = {ORDER - 1: written(suffix(counts, ORDER - 1), "grams-3")}
    for k in range(ORDER - 2, 0, -1):
        levels[k] = suffix(levels[k + 1], k)
    below = None
    for k in range(1, ORDER):
        (d,) = _discount(levels[k], "n")
        own = levels[k].withColumn("context", F.shiftright("gram", BITS)).withColumn("lower", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1))
        of = own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        own = own.join(of, "context")
        own = own.withColumn("p", F.lit(1.0 / SYMBOLS)) if below is None else own.join(below, "lower")
        p = (F.col("n") - d) / F.col("total") + d * F.col("kinds") / F.col("total") * F.col("p")
        below = own.select(F.col("gram").alias("lower"), p.alias("p"))
    dt, do = _discount(counts, "toxic", "ordinary")
    own = counts.withColumn("context", F.shiftright("gram", BITS)).withColumn("lower", F.col("gram").bitwiseAND((1 << BITS * (ORDER - 1)) - 1))
    sums = [f(c).alias(n) for c in ("toxic", "ordinary") for f, n in ((F.sum, f"{c}_total"), (lambda c: F.count(F.when(F.col(c) > 0, 1)), f"{c}_kinds"))]
    of = own.groupBy("context").agg(*sums)
    for c, d in (("toxic", dt), ("ordinary", do)):
        of = of.withColumn(f"{c}_weight", F.when(F.col(f"{c}_total") > 0, F.try_divide(d * F.col(f"{c}_kinds"), F.col(f"{c}_total"))).otherwise(1.0))
    of = written(of, "contexts")
    own = own.join(of, "context").join(below, "lower")

    def log(c: str, d: float) -> Column:
        return F.log(F.greatest(F.col(c) - d, F.lit(0.0)) / F.greatest(F.col(f"{c}_total"), F.lit(1)) + F.col(f"{c}_weight") * F.col("p"))

    ratio = (log("toxic", dt) - log("ordinary", do)).cast("float")
    return own.select("gram", ratio.alias("ratio")), of.select("context", F.log(F.col("toxic_weight") / F.col("ordinary_weight")).cast("float").alias("ratio"))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Logistic weights, intercept first; those of the log ratios are never negative, so that a text likelier under the
    toxic model never scores lower for it. Without both classes: no weights, and the share of the toxic ones as score."""
    w = np.zeros(x.shape[1] + 1)
    if not 0 < y.sum() < len(y):
        rate = np.clip(y.sum() / (len(y) + 1), 1e-9, 1 - 1e-9)
        w[0] = np.log(rate / (1 - rate))
        return w
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, v, b = (x - mean) / spread, np.zeros(x.shape[1]), np.log(y.mean() / (1 - y.mean()))
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(b + z @ v, -30, 30))) - y
        b, v = b - 0.5 * miss.mean(), np.maximum(v - 0.5 * (z.T @ miss / len(y) + 1e-3 * v), 0)
    return np.r_[b - (v * mean / spread).sum(), v / spread]


def _fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, fitted: int = FITTED) -> Model:
    """Models and score from the labelled documents whose crc32(doc_id as text) mod 4 is not 2.

    Of remainder 3, ``fitted`` documents at most give the weights of the score, so that it is fitted on texts which the
    counts have not seen; its other documents and remainders 0 and 1 give the counts, all of them, occurrence by
    occurrence. Labels other than 0 and 1, documents without doc_id and null texts are not used; of several labels of a
    doc_id the highest holds, and each row of a repeated doc_id counts. Texts meet labels by a join on doc_id that deals
    both by hash, at every size alike. No labels: all scores are about 0. Other columns are ignored.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known.filter(_fold() != 2), "known")
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text").filter(_fold() != 2)
    chosen = written(known.filter(_fold() == 3).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted).select("doc_id", "toxic"), "fitted")
    counted = known.join(F.broadcast(chosen), "doc_id", "left_anti")  # bounded by ``fitted``: broadcast
    # texts without labels stay out of the shuffle, but for the few that the filter mistakes
    likely = id_filter(texts, counted, "doc_id").filter("_perhaps").drop("_perhaps")
    counts = written(gram_counts(likely.hint("merge").join(counted, "doc_id")), "grams")
    # at most 2 ** (ORDER * BITS) ratios of 8 bytes pass through the driver
    (gram, gram_ratio), (context, context_ratio) = ([c.to_numpy() for c in df.toArrow().columns] for df in kneser_ney(counts))
    model = Model(gram, gram_ratio, context, context_ratio, np.zeros(4))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [shared.value.features(t.as_py()) for t in b.column(0)]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    got = sample.mapInArrow(run, "x array<double>, toxic int").toArrow()
    x, y = np.array(got.column("x").to_pylist(), float).reshape(-1, 3), got.column("toxic").to_numpy().astype(float)
    order = np.lexsort([y, *x.T])  # the same sums whichever task came first
    model.weights = fit(x[order], y[order])
    return model


def score(docs: DataFrame, model: Model, into: str = "toxic_score") -> DataFrame:
    """The rows of ``docs``, all columns, and the score (0 to 1), from the text alone.

    Null and empty texts: the score of no evidence. Long texts are scored whole, in chunks. Repeated texts: equal scores.
    No rows: no rows. ``into`` must not be a column of ``docs`` (ValueError).
    """
    if into in docs.columns:
        raise ValueError(f"documents have a column {into}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index("text"), [*docs.columns, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([shared.value.score([t.as_py()])[0] for t in b.column(at)])
            yield pa.record_batch([*b.columns, pa.array(found, pa.float64())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns, whatever those are called."""
    into = free_name(docs, "toxic_score")
    return score(docs, train(docs, labels), into).filter(F.col(into) < CUT).select(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity: (doc_id, held_out, score, predicted); null doc_id: not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = score(docs, model, "score")
    held_out = F.coalesce(_fold() == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
