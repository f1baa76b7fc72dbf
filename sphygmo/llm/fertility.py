"""Quality rules by tokeniser fertility: how public vocabularies cut a text, against bands of its language or script."""

from __future__ import annotations

import base64
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphygmo.llm.common import table, written

#: Words whose tokens a worker keeps at most; then it starts anew.
KEPT_WORDS = 1_000_000
#: What is measured of each text by each vocabulary.
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")
#: A band reaches so many interquartile ranges to either side of the median of a language, but no less than this: a share
#: of the median for characters a token, else in the measure's own unit (share of tokens, bits).
REACH = 6.0
LEAST = {"chars_per_token": 0.2, "fallback_share": 0.05, "token_entropy": 1.5}
#: The bounds of a band that reject; a text of many token kinds, or without byte tokens, is no worse for that.
SIDES = {"chars_per_token": ("low", "high"), "fallback_share": ("high",), "token_entropy": ("low",)}
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
_NO_POINTS = bytes(range(0x80, 0xC0)) + _SPACES  # bytes that begin no code point of a word


class Pieces:
    """A SentencePiece vocabulary: pieces of a word, those that stand for one byte marked."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.partial = np.array([self.model.IsByte(k) or self.model.IsUnknown(k) for k in range(self.model.GetPieceSize())])

    def of(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words)


class Ranks:
    """A byte-level vocabulary of ranks: tokens of a word behind a space, those that are no whole characters marked."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.partial = np.zeros(max(ranks.values()) + 1, bool)
        for token, k in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.partial[k] = True

    def of(self, words: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + w) for w in words]


def default_vocabularies() -> list[str]:
    """Paths of a vocabulary with byte fallback and of a byte-level one."""
    import public_tokenizers

    return [public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")]


def vocabulary(path: str) -> Pieces | Ranks:
    return Pieces(path) if path.endswith(".model") else Ranks(path)


class Known:
    """Tokens of the words seen so far, by vocabulary, in one array each."""

    def __init__(self, paths: list[str]) -> None:
        self.models = [vocabulary(p) for p in paths]
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.tokens = [np.zeros(0, np.int32) for _ in self.models]
        self.ends = [np.zeros(1, np.int64) for _ in self.models]

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The words' numbers, for some texts; words not seen before are cut into tokens once."""
        if len(self.number) > KEPT_WORDS:
            self.clear()
        fresh = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in self.number]
        if fresh:
            for w in fresh:
                self.number[w] = len(self.number)
            words = [w.decode("utf-8", "replace") for w in fresh]
            for k, m in enumerate(self.models):
                cut = m.of(words)
                self.tokens[k] = np.concatenate([self.tokens[k], np.fromiter((x for c in cut for x in c), np.int32)])
                self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum([len(c) for c in cut])])
        return [np.fromiter((self.number[w] for w in t), np.int64, len(t)) for t in texts]

    def tokens_of(self, k: int, words: np.ndarray) -> np.ndarray:
        start, n = self.ends[k][words], self.ends[k][words + 1] - self.ends[k][words]
        return self.tokens[k][np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]


def repeated_words(words: np.ndarray) -> int:
    """Words in windows of three that are there twice or more, the first included."""
    if len(words) < 3:
        return 0
    two = np.unique(words[:-2] << 31 | words[1:-1], return_inverse=True)[1]
    _, at, count = np.unique(two.astype(np.int64) << 31 | words[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """The script that most letters of a text are of, by the first word of their Unicode names; no letters: ``none``."""
    letters = Counter(c for c in text if c.isalpha())
    names: Counter[str] = Counter()
    for c, k in letters.items():
        names[unicodedata.name(c, "none").split(" ")[0].split("-")[0].lower()] += k
    return max(names, key=lambda n: (names[n], n)) if names else "none"


def _measured(tokens: np.ndarray, chars: int, partial: np.ndarray) -> tuple[float | None, float | None, float | None]:
    n = len(tokens)
    if not n:
        return None, None, None
    p = np.bincount(tokens)
    p = p[p > 0] / n
    return chars / n, float(partial[tokens].sum()) / n, float(-(p * np.log2(p)).sum())


def measured(docs: DataFrame, vocabularies: list[str], chars: int = 1 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, and ``_m``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), the
    script where ``lang`` is null or not a column, and an array of the measures by vocabulary (null without words).

    Every whole text is worked on where it is read, word by word: the tokens of a text are those of its words. A worker keeps
    the tokens of :data:`KEPT_WORDS` words and those of ``chars`` bytes of text, or of one longer text.
    """
    at, names = docs.columns.index("text"), [*docs.columns, "_m"]
    lang = docs.columns.index("lang") if "lang" in docs.columns else None
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kind = pa.struct([*[(c, pa.int64()) for c in counts], ("script", pa.string()), *[(f"{m}_{k}", pa.float64()) for k in range(len(vocabularies)) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(vocabularies)
        for batch in batches:
            raws = batch.column(at).cast(pa.binary())
            sizes = np.cumsum(pa.compute.binary_length(raws).fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + chars, "right")))
                part = [r.as_py() or b"" for r in raws[start:end]]
                found = []
                for k, (raw, words) in enumerate(zip(part, known.numbers([r.split() for r in part]), strict=True)):
                    points = len(raw.translate(None, _NO_POINTS))
                    row = {"n_words": len(words), "word_chars": points, "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS)), "n_dup_lines": repeated_lines(raw), "n_repeat_words": repeated_words(words)}
                    row["script"] = None if lang is not None and batch.column(lang)[start + k].is_valid else script(raw.decode("utf-8", "replace"))
                    for v, model in enumerate(known.models):
                        row |= dict(zip((f"{m}_{v}" for m in MEASURES), _measured(known.tokens_of(v, words), points, model.partial), strict=True))
                    found.append(row)
                yield pa.record_batch([*batch.slice(start, end - start).columns, pa.array(found, kind)], names)
                start = end

    fields = [*[T.StructField(c, T.LongType()) for c in counts], T.StructField("script", T.StringType()), *[T.StructField(f"{m}_{k}", T.DoubleType()) for k in range(len(vocabularies)) for m in MEASURES]]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_m", T.StructType(fields))]))


def base_failed(m: Callable[[str], Column]) -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows of three."""
    return (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))


def bands(rows: DataFrame, vocabularies: int) -> DataFrame:
    """(group, measure, low, high) of all rows (group, failed, and the measures) that have not failed.

    Median and quartiles are exact, of values rounded to three digits, by how many rows have each: those counts are made
    where the rows are, so a language with a third of all rows is no larger than its different values.
    """
    names = [f"{m}_{k}" for k in range(vocabularies) for m in MEASURES]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.round(n, 3).alias("value")) for n in names])).alias("e")
    counts = rows.filter("not failed").select("group", each).select("group", "e.*").filter("value is not null").groupBy("group", "measure", "value").agg(F.count("*").alias("n"))
    q = counts.groupBy("group", "measure").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    of = F.regexp_replace("measure", "_[0-9]+$", "")
    least = F.lit(None).cast("double")
    for m, x in LEAST.items():
        least = F.when(of == m, F.col("q")[1] * x if m == "chars_per_token" else F.lit(x)).otherwise(least)
    wide = F.greatest(REACH * (F.col("q")[2] - F.col("q")[0]), least)
    return q.select("group", "measure", (F.col("q")[1] - wide).alias("low"), (F.col("q")[1] + wide).alias("high"))


def judged(docs: DataFrame, vocabularies: list[str]) -> DataFrame:
    """The rows of ``docs`` (doc_id, text[, lang], ...), all columns, with ``quality``: a struct of the five counts,
    base_failed, the group (language, else script), the measures, the names of those outside the group's band, and kept.

    A text is kept if the base rules hold and it is within its group's bands: characters a token neither too few nor too
    many, not too large a share of byte tokens, not too little entropy of tokens. The bands come from all texts of a group that
    pass the base rules. Null or empty text: no words, fails. Repeated rows: each. Any other columns, whatever their names. No
    rows: no rows.
    """
    packed = docs.select(F.struct("*").alias("row"), "text", *(["lang"] if "lang" in docs.columns else []))
    rows = written(measured(packed, vocabularies).drop("text"), "fertility")
    group = F.coalesce(F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("script:"), F.col("_m.script"))) if "lang" in docs.columns else F.concat(F.lit("script:"), F.col("_m.script"))
    rows = rows.select("row", group.alias("group"), base_failed(lambda c: F.col(f"_m.{c}")).alias("failed"), F.col("_m"))
    names = [f"{m}_{k}" for k in range(len(vocabularies)) for m in MEASURES]
    wide = bands(rows.select("group", "failed", *[F.col(f"_m.{n}").alias(n) for n in names]), len(vocabularies))
    # one row for each language or script
    limits = wide.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("bands"))
    out = rows.join(limits, "group", "left")
    value = lambda n: F.round(F.col(f"_m.{n}"), 3)
    bad = []
    for n in names:
        band, sides = F.try_element_at("bands", F.lit(n)), SIDES[n.rsplit("_", 1)[0]]
        off = F.lit(False)
        if "low" in sides:
            off |= value(n) < band["low"]
        if "high" in sides:
            off |= value(n) > band["high"]
        bad.append(F.when(F.coalesce(off, F.lit(False)), F.lit(n)))
    outside = F.array_compact(F.array(*bad))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    told = F.struct(*[F.col(f"_m.{c}").alias(c) for c in counts], F.col("failed").alias("base_failed"), "group", *[F.col(f"_m.{n}").alias(n) for n in names], outside.alias("outside"), (~F.col("failed") & (F.size(outside) == 0)).alias("kept"))
    return out.select("row.*", told.alias("quality"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), default_vocabularies())
    q = F.col("quality")
    names = [f"{m}_{k}" for k in range(2) for m in MEASURES]
    return found.select("doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], q["group"].alias("band"), *[F.round(q[n], 4).alias(n) for n in names], F.array_join(q["outside"], ",").alias("outside"))
