"""Secret scans over a trigram inverted index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphygmo.llm.common import free_name, segments, table


@dataclass(frozen=True)
class Rule:
    """``group`` is what must be at least ``least`` long; a match that is shorter is dropped after it has matched."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base rules, then public token formats.
BASE = (
    Rule("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

#: A query: any of these sets of trigrams must be there whole. ALL holds for every text.
Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])
#: Strings that a part of a pattern is spelled out into at most.
SPELLED = 64


def _of_strings(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


def _least(q: Query) -> Query:
    return frozenset(c for c in q if not any(d < c for d in q))


def _both(a: Query, b: Query) -> Query:
    made = _least(frozenset(x | y for x in a for y in b))
    return made if len(made) <= 256 else min(a, b, key=len)


def _walk(items: list) -> tuple[set[str] | None, Query]:
    """All lower-cased strings that a part can be, if they are few (else None), and its query."""
    exact: set[str] | None = {""}
    query = ALL
    run: set[str] = {""}  # what the latest spelled-out items can be

    def stop() -> None:
        nonlocal exact, query, run
        query = _both(query, _of_strings(run))
        exact, run = None, {""}

    for op, arg in items:
        strings: set[str] | None = None
        inner = ALL
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            strings = chars
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(list(arg[3]))
        elif op is sre.BRANCH:
            parts = [_walk(list(p)) for p in arg[1]]
            strings = set().union(*[s for s, _ in parts]) if all(s is not None for s, _ in parts) else None
            inner = _least(frozenset().union(*[q if s is None else _of_strings(s) for s, q in parts]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            strings, inner = _walk(list(sub))
            if high == 1 and low == 0 and strings is not None:
                strings, inner = strings | {""}, ALL
            elif low == high == 1:
                pass
            else:
                if low and strings is not None:  # begins with what it repeats
                    inner = _of_strings({s * min(low, 8) for s in strings}) if len(strings) == 1 else ALL
                strings, inner = None, inner if low else ALL
        if strings is not None and len(run) * len(strings) <= SPELLED:
            run = {a + b for a in run for b in strings}
        else:
            stop()
            query = _both(query, inner)
            if strings is not None and len(strings) <= SPELLED:
                run = set(strings)
    if exact is None:
        return None, _both(query, _of_strings(run))
    return run, _of_strings(run)


def trigram_query(pattern: str) -> Query:
    """A Boolean query on the trigrams of the lower-cased text that every match of ``pattern`` fulfils.

    Literals, small classes, options and alternatives are spelled out; anything else only ends a run of text. A pattern
    without a trigram of its own gives ALL: it is scanned fully.
    """
    return _walk(list(parser.parse(pattern)))[1]


class Segment:
    """The inverted index of some texts: for each trigram that the rules ask for, the numbers of the texts with it."""

    def __init__(self, texts: list[str], wanted: np.ndarray, table_: np.ndarray) -> None:
        raw = [t.encode().lower() for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(r) + 2 for r in raw])])
        b = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8)
        code = np.zeros(0, np.uint32) if len(b) < 3 else (b[:-2].astype(np.uint32) << 16) | (b[1:-1].astype(np.uint32) << 8) | b[2:]
        at = np.flatnonzero(table_[code])
        gram, text = np.searchsorted(wanted, code[at]), np.searchsorted(starts, at, "right") - 1
        pair = np.unique(gram.astype(np.int64) * (len(texts) + 1) + text)
        cuts = np.searchsorted(pair, np.arange(len(wanted) + 1) * (len(texts) + 1))
        self.postings = [pair[cuts[k] : cuts[k + 1]] % (len(texts) + 1) for k in range(len(wanted))]
        self.size = len(texts)

    def candidates(self, clauses: list[list[int]]) -> np.ndarray:
        found = [np.arange(self.size)] if [] in clauses else []
        for clause in clauses if not found else []:
            hit = self.postings[clause[0]]
            for k in clause[1:]:
                hit = np.intersect1d(hit, self.postings[k], assume_unique=True)
            found.append(hit)
        return np.unique(np.concatenate(found)) if found else np.zeros(0, int)


def _matcher(rule: Rule) -> re.Pattern[str]:
    """One class repeated, at least ``least`` long: said so to the regex, as shorter runs are dropped whole anyway."""
    if not rule.group and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}")
    return re.compile(rule.pattern)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = 256, into: str = "spans") -> DataFrame:
    """The rows of ``docs``, all columns, and the spans: array of (kind, start, end), by start, then rule order.

    Each task indexes its texts in segments of at most ``rows`` texts and a million characters: the postings of the rules' trigrams are intersected as each
    rule's query asks, and the rule's regex then runs on the candidates alone, over their whole texts; rules without a
    mandatory trigram run on every text. Spans are in code points, ends exclusive. The index lives where the texts are
    read, so no text is shuffled. Null or empty text: no spans. Repeated rows: rows of their own. No rows: no rows.
    ``into`` must not be a column of ``docs`` (ValueError).
    """
    if into in docs.columns:
        raise ValueError(f"documents have a column {into}")
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for clause in q for g in clause}, key=lambda g: g.encode())
    at = docs.columns.index("text")
    names = [*docs.columns, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.array([int.from_bytes(g.encode(), "big") for g in grams], np.uint32)
        flags = np.zeros(1 << 24, bool)
        flags[codes] = True
        number = {g: k for k, g in enumerate(grams)}
        clauses = [[sorted(number[g] for g in c) for c in q] for q in queries]
        regexes = [_matcher(r) for r in rules]
        for batch in batches:
            whole = [t.as_py() or "" for t in batch.column(at)]
            for k, end in segments(whole, rows):
                part, texts = batch.slice(k, end - k), whole[k:end]
                found: list[list[tuple]] = [[] for _ in texts]
                segment = Segment(texts, codes, flags)
                for order, (rule, regex) in enumerate(zip(rules, regexes, strict=True)):
                    for d in segment.candidates(clauses[order]):
                        for m in regex.finditer(texts[d]):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[d].append((m.start(), order, m.end(), rule.kind))
                spans = [[{"kind": x[3], "start": x[0], "end": x[2]} for x in sorted(f)] for f in found]
                yield pa.record_batch([*part.columns, pa.array(spans, _SPANS)], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    return docs.mapInArrow(run, schema)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows and columns of ``docs`` with each secret in ``text`` replaced by ``[kind]`` and n_chars as it is then.

    Overlapping spans are replaced as one, named by the first. Null texts stay null; texts without secrets stay as they are.
    """
    into = free_name(docs, "spans")
    text, spans = F.col("row.text"), F.col("spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    fresh = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))
    within = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
    clean = F.aggregate(spans, start, lambda acc, s: F.when(s["start"] >= acc["at"], fresh(acc, s)).otherwise(within(acc, s)), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    hit = F.size(spans) > 0
    out = scan(docs, rules, into=into).select(F.struct(*docs.columns).alias("row"), F.col(into).alias("spans"))
    out = out.withColumn("text", F.when(hit, clean).otherwise(text))
    cols = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return out.select(*[cols[c].alias(c) for c in docs.columns])


def joined(spans, kinds: list[str] | None = None):
    picked = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(picked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every whole text of ``documents``."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in BASE]
    return found.select("doc_id", *[count(k) for k in base], F.sha2(joined(F.col("spans"), base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """Each rule's matches in order; a match stands where its text first comes after the end of the one before, as no rule looks
    beyond its match."""
    parts = []
    for order, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""m{order} AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS g FROM texts),
e{order} AS (SELECT doc_id, list_reduce(range(1, len(m) + 1), lambda a, i: list_append(a, CAST(a[-1] + strpos(substr(text, a[-1] + 1), m[i]) - 1 + len(m[i]) AS BIGINT)), [CAST(0 AS BIGINT)]) AS e, m, g FROM m{order} WHERE len(m) > 0),
k{order} AS (SELECT doc_id, {order} AS ord, '{r.kind}' AS kind, e - n AS start, e AS stop FROM (SELECT doc_id, unnest(e[2:]) AS e, unnest(list_transform(m, lambda x: len(x))) AS n, unnest(list_transform(g, lambda x: len(x))) AS size FROM e{order}) WHERE size >= {r.least})""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    every = " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(len(RULES)))
    span = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(parts)}, every AS ({every}),
told AS (SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY start, ord) FILTER (kind IN ({base})) AS base, string_agg({span}, ',' ORDER BY start, ord) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN told USING (doc_id)"""


OP3_SQL = _sql()
