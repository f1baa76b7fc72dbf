"""Periodic runs, the Merkle manifest and tokeniser fertility, against brute force and edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphygmo.llm import fertility, merkle, periodic
from sphygmo.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = "word " * 300_000
EDGE = [
    (1, None, "en", "a", None, "x"), (2, "", None, None, 0, None), (3, "one two", "en", "a", 7, "x"), (3, "one two", "en", "a", 7, "x"), (4, "one two", "en", None, 7, "x"),
    (None, "a b a b a b a b\nc c c c c c", "en", "b", None, "x"), (5, LONG, "en", "b", len(LONG), "x"), (6, " \t\n ", "en", "b", 4, "x"), (7, "αβγ Ünï 漢字 don't\x1cI'll x1²y <|endoftext|>\xa0z", "el", "c", None, "x"),
]
DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w):
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        same, i = [w[k] == w[k + p] for k in range(n - p)], 0
        while i < len(same):
            k = i
            while k < len(same) and same[k]:
                k += 1
            if k > i and k - i + p >= max(6, 4 * p):
                out.setdefault((i, k - i + p), p)
            i = max(k, i + 1)
    return sorted((a, n, p) for (a, n), p in out.items())


@pytest.mark.parametrize("seed", range(8))
def test_runs_brute_force(seed):
    rng = np.random.default_rng(seed)
    for t in range(150):
        n, k = int(rng.integers(0, 120)), int(rng.integers(1, 5))
        w = rng.integers(0, k, n).astype(np.int32)
        if t % 3 == 0 and n > 10:
            a = int(rng.integers(0, n))
            w[a:] = np.resize(rng.integers(0, 2, int(rng.integers(1, 8))), n - a)
        if t % 7 == 0:  # runs that touch and overlap
            w = np.concatenate([np.resize(rng.integers(0, 3, int(rng.integers(1, 6))), int(rng.integers(5, 50))) for _ in range(4)]).astype(np.int32)
        runs = periodic.found_runs(w)
        assert runs == brute_runs(w.tolist())
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert periodic.kept_words(len(w), runs).tolist() == [i not in gone for i in range(len(w))]


def test_runs_over_chunks_of_the_grid(monkeypatch):
    monkeypatch.setattr(periodic, "POINTS", 50)
    monkeypatch.setattr(periodic, "FIRST", 2)
    monkeypatch.setattr(periodic, "CHUNK", 4)
    w = np.r_[np.arange(7), np.resize(np.arange(20, 33), 100), np.arange(7), np.zeros(40), [3]].astype(np.int32)
    assert periodic.found_runs(w) == brute_runs(w.tolist()) == [(7, 100, 13), (114, 40, 1)]


def test_runs_query_brute_force(spark, docs, edge):
    made = docs.select("doc_id", "text").unionByName(edge.filter("doc_id is null or doc_id <> 5").select("doc_id", "text"))
    got = Counter(map(tuple, periodic.periodic_runs(periodic.with_planted_runs(made)).select("doc_id", *periodic.summed_up()).collect()))
    want = Counter()
    for doc, text in made.collect():
        w = words(text)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        b = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[(doc, len(runs), *(b or (None,) * 3), b and 1000 * b[1] // b[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    assert got == want


def test_runs_edges(spark, edge):
    got = periodic.periodic_runs(edge)
    assert got.columns == [*edge.columns, "runs", "collapsed"] and got.count() == len(EDGE)
    by = {r.doc_id: (r.runs, r.collapsed) for r in got.collect()}
    assert by[1] == by[2] == by[6] == ([], "") and by[5] == ([(0, 300_000, 1)], "word") and by[None] == ([(0, 8, 2), (8, 6, 1)], "a b c")
    assert by[7][1] == EDGE[-1][1]  # other spaces part no words
    with pytest.raises(ValueError, match="runs"):
        periodic.periodic_runs(edge.withColumn("runs", F.lit(1)))
    assert periodic.periodic_runs(edge.limit(0)).count() == 0


# --- Merkle ---------------------------------------------------------------------------------------------------------

H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """Root, and each leaf's steps (before, after)."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            a = i // 16 * 16
            paths[k].append((level[a:i], level[i + 1 : a + 16]))
        level = [H(level[a : a + 16]) for a in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


def brute_manifest(rows):
    by = {}
    for source, doc, leaf, now in rows:
        by.setdefault(source, []).append((doc is not None, doc or 0, leaf, now, doc))
    trees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        part = sorted(by[source])
        trees.append((part, *brute_tree([x[2] for x in part])))
    root, outer = brute_tree([t[1] for t in trees])
    out = []
    for (part, subroot, paths), above in zip(trees, outer):
        for (_, _, leaf, now, doc), path in zip(part, paths):
            steps, node = path + above, now
            for a, b in steps:
                node = H([*a, node, *b])
            out.append((doc, leaf, subroot, root, H([x for a, b in steps for x in a + b]), node, node == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 600, 4096])
def test_traversal_brute_force(n):
    leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    root, paths = brute_tree(leaves)
    levels = merkle.height(n)
    assert 16 ** max(levels - 1, 0) <= n <= 16**levels
    raw = [x.encode() for x in leaves]
    walk = merkle.Traversal(raw.__getitem__, n, levels)
    for got, want in zip(walk.paths(), paths, strict=True):
        assert [([x.decode() for x in run[:at]], [x.decode() for x in run[at + 1 :]]) for at, run in got] == want
    built = merkle.Builder(levels)
    for x in raw:
        built.add(x)
    assert [x.decode() for x in built.close()] == [root]


@pytest.mark.parametrize("deep", [1, 3])
def test_manifest_brute_force(spark, monkeypatch, deep):
    monkeypatch.setattr(merkle, "DEEP", deep)
    monkeypatch.setattr(merkle, "BLOCK", 16**deep)
    rows = [(s, k, H([s or "", str(k)]), H([s or "", str(k), "x" * (k % 3 == 0)])) for s, n in ((None, 3), ("a", 700), ("b", 1), ("é", 300), ("", 17), ("B:1", 20)) for k in range(n)]
    rows += [("a", 5, "same", "same")] * 400 + [("a", None, "none", "none")] * 2  # one row in a third of the table
    made = spark.createDataFrame(rows, "source string, doc_id long, leaf string, now string")
    got = merkle.manifest(made, paths=True).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(brute_manifest(rows))
    for r in got[::97]:  # the paths themselves
        node = r.leaf
        for s in r.path:
            node = H([s.before, node, s.after])
        assert node == r.root and H([s.before + s.after for s in r.path]) == r.proof_sha256


def test_manifest_of_many_sources(spark):
    rows = [(f"s{k}", k, H([str(k)]), H([str(k)])) for k in range(300)]
    made = spark.createDataFrame(rows, "source string, doc_id long, leaf string, now string")
    assert Counter(map(tuple, merkle.manifest(made).collect())) == Counter(brute_manifest(rows))


def test_manifest_edges(spark, edge):
    leaf = merkle.leaf_digest(F.col("text"))
    made = edge.select("source", "doc_id", leaf.alias("leaf"), leaf.alias("now"))
    want = {H([*(f"{len(v.encode())}:{v}" if v is not None else "-" for v in (None if d is None else str(d), s, l, None if n is None else str(n), t))]) for d, t, l, s, n, _ in EDGE}
    got = merkle.manifest(made).collect()
    assert len(got) == len(EDGE) and {r.leaf for r in got} == want and all(r.verified for r in got)
    assert merkle.manifest(made.limit(0)).count() == 0
    low = edge.select("doc_id", merkle.tampered(F.col("text"), F.col("doc_id")).alias("t")).collect()
    assert all(r.t is None for r in low if r.doc_id == 1)


# --- fertility ------------------------------------------------------------------------------------------------------

def brute_counts(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_base_counts_brute_force(spark, docs, edge):
    made = docs.select("doc_id", "text", "lang").unionByName(edge.select("doc_id", "text", "lang"))
    made = made.unionByName(spark.createDataFrame([(9000 + k, t, None) for k, t in enumerate(["a b a b a b " * 20, "x\n \nx\ny\nx", "# é é é é <> |"])], "doc_id long, text string, lang string"))
    got = fertility.judged(made.withColumn("quality_", F.lit(1)), fertility.default_vocabularies()).collect()
    assert Counter((r.doc_id, r.quality.n_words, r.quality.word_chars, r.quality.n_symbols, r.quality.n_dup_lines, r.quality.n_repeat_words, r.quality.base_failed) for r in got) == Counter((r.doc_id, *brute_counts(r.text)) for r in made.collect())
    assert not any(r.quality.kept and r.quality.base_failed for r in got)


def test_fertility_brute_force(spark, docs):
    """Measures by the libraries alone, bands by NumPy, and what they reject."""
    import sentencepiece

    pieces, ranks = fertility.default_vocabularies()
    made = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(9000, "你好 世界 " * 40 + "𓀀𓀁 ☃ naïve", "zh"), (9001, "Ω " * 60, None), (9002, " ".join(f"q{k}x$$&&%%" for k in range(90)), "en")], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.quality for r in fertility.judged(made, [pieces, ranks]).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
    by = {}
    for r in made.collect():
        q, w = got[r.doc_id], words(r.text)
        ids = [i for x in w for i in sp.encode(x)]
        p = np.array(list(Counter(ids).values())) / len(ids)
        want = sum(map(len, w)) / len(ids), sum(sp.IsByte(i) for i in ids) / len(ids), -(p * np.log2(p)).sum()
        assert (q.chars_per_token_0, q.fallback_share_0, q.token_entropy_0) == pytest.approx(want)
        if not q.base_failed:
            by.setdefault(q.group, []).append(q)
    assert got[9001].group == "script:greek" and got[9000].group == "lang:zh" and got[9000].fallback_share_0 > 0
    for part in by.values():
        for m in ("chars_per_token_0", "fallback_share_1", "token_entropy_1"):
            kind = m[:-2]
            x = np.round([q[m] for q in part], 3)
            a, b, c = np.quantile(x, [0.25, 0.5, 0.75])
            wide = max(fertility.REACH * (c - a), fertility.LEAST[kind] * (b if kind == "chars_per_token" else 1))
            for q, v in zip(part, x):
                assert (m in q.outside) == (v < b - wide and "low" in fertility.SIDES[kind] or v > b + wide and "high" in fertility.SIDES[kind])
    assert not got[9002].kept and "chars_per_token_1" in got[9002].outside


def test_fertility_keeps_the_clean(spark):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    good = {r.doc_id: r.quality for r in labels.select("doc_id", "quality").collect()}
    kept = {r.doc_id: r for r in fertility.judged(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang"), fertility.default_vocabularies()).select("doc_id", "quality.kept", "quality.base_failed").collect()}
    assert all(kept[d].kept for d, q in good.items() if q == 1 and not kept[d].base_failed)
    bad = [kept[d].kept for d, q in good.items() if q == 0]
    assert sum(bad) < 0.5 * len(bad)


def test_word_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(fertility, "KEPT_WORDS", 3)
    known = fertility.Known(fertility.default_vocabularies()[:1])
    for text in ("a b c d e", "f g", "a a b"):
        (at,) = known.numbers([text.encode().split()])
        assert [known.tokens_of(0, at[k : k + 1]).tolist() for k in range(len(at))] == known.models[0].of(text.split())


def test_fertility_edges(spark, edge):
    odd = edge.withColumn("group", F.lit("g")).withColumn("failed", F.lit(1)).withColumn("row", F.lit(2)).withColumn("bands", F.lit(3))
    got = fertility.judged(odd, fertility.default_vocabularies())
    assert got.columns == [*odd.columns, "quality"] and got.count() == len(EDGE) and not any(r.quality.kept for r in got.collect() if r.doc_id != 5)
    assert fertility.judged(edge.drop("lang"), fertility.default_vocabularies()).count() == len(EDGE)
    assert fertility.judged(edge.limit(0), fertility.default_vocabularies()).count() == 0
    assert fertility.script("Привет мир a") == "cyrillic" and fertility.script("12 !") == "none"
