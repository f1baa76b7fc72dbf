"""The toxicity models against a brute-force Kneser-Ney, and edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sphygmo.llm import toxicity
from sphygmo.llm.common import table

SF = "/root/testdata/sf0.001"
LABELLED = [("you utter zgrum of a zgrum", 1), ("zgrum!", 1), ("a quiet day at the sea, a quiet night", 0), ("The sea,  the\tsea", 0), ("42 tides of élan", 0), ("", 0)]


def symbols(text):
    return [0] + [int(toxicity._SYMBOL[ord(c) & 0xFFFF]) for c in re.sub(r"[\x20\x09-\x0D]+", " ", f" {text.lower()} ")[1:]]


def brute_grams(text):
    s = [0] * (toxicity.ORDER - 1) + symbols(text)
    return [tuple(s[k : k + toxicity.ORDER]) for k in range(len(s) - toxicity.ORDER + 1)]


def brute_model(rows):
    """P(gram's last symbol | the others, class) by dictionaries, as a function of gram and class."""
    own = [Counter(g for t, y in rows if y == c for g in brute_grams(t)) for c in (0, 1)]
    levels = {toxicity.ORDER - 1: Counter(g[1:] for g in set(own[0]) | set(own[1]))}
    for k in range(toxicity.ORDER - 2, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discount(counts):
        ones, twos = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def one(counts, gram, lower):
        d, same = discount(counts), {g: v for g, v in counts.items() if g[:-1] == gram[:-1]}
        if not same:
            return lower
        return max(counts.get(gram, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * lower

    def p(gram, c):
        low = 1 / toxicity.SYMBOLS
        for k in range(1, toxicity.ORDER):
            low = one(levels[k], gram[-k:], low)
        return one(own[c], gram, low)

    return p


def code(gram):
    out = 0
    for s in gram:
        out = out << toxicity.BITS | s
    return out


@pytest.fixture(scope="module")
def tiny(spark):
    fold0 = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 == 0]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in zip(fold0, LABELLED)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in zip(fold0, LABELLED)], "doc_id long, toxic int")
    return docs, labels


def test_grams_in_chunks(monkeypatch):
    text = "  Ab\t\n c漢 7! x\x00  " + "word " * 9
    whole = np.concatenate(list(toxicity.grams(text))).tolist()
    assert whole == [code(g) for g in brute_grams(text)]
    for chunk in (1, 2, 3, 7):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.concatenate(list(toxicity.grams(text))).tolist() == whole


def test_kneser_ney_brute_force(tiny):
    docs, labels = tiny
    counts = toxicity.gram_counts(docs.join(labels, "doc_id"))
    want = [Counter(g for t, y in LABELLED if y == c for g in brute_grams(t)) for c in (0, 1)]
    assert {(r.gram, r.toxic, r.ordinary) for r in counts.collect()} == {(code(g), want[1][g], want[0][g]) for g in want[0] | want[1]}
    model, p = toxicity.train(docs, labels), brute_model(LABELLED)
    for g in {g for t, _ in LABELLED for g in brute_grams(t)} | {(1, 1, 1, 1), *brute_grams("a zgrux")}:
        assert model.ratio[code(g)] == pytest.approx(math.log(p(g, 1) / p(g, 0)), abs=1e-5)


def test_features_of_long_texts(tiny, monkeypatch):
    model = toxicity.train(*tiny)
    text = "a quiet night of zgrum and 42 more zgrum by the sea " * 5
    r = model.ratio[[code(g) for g in brute_grams(text)]].astype(float)
    w = np.convolve(r, np.ones(toxicity.PASSAGE), "valid") / toxicity.PASSAGE
    top = int(w.argmax())
    second = max(v for k, v in enumerate(w) if abs(k - top) >= toxicity.PASSAGE)
    assert model.features(text) == pytest.approx([r.mean(), w[top], second], abs=1e-4)
    monkeypatch.setattr(toxicity, "CHUNK", 11)
    assert model.features(text) == pytest.approx([r.mean(), w[top], second], abs=1e-4)


def test_edges(spark, tiny):
    docs, labels = tiny
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "zgrum " * 400_000, None), (None, "zgrum", "z")]
    edge = spark.createDataFrame(rows, "doc_id long, text string, toxic_score string")
    model = toxicity.train(edge.unionByName(docs.selectExpr("doc_id", "text", "'' toxic_score")), labels)
    got = toxicity.score(edge, model, "s").collect()
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    assert len({r.s for r in got if not r.text}) == 1
    with pytest.raises(ValueError, match="toxic_score"):
        toxicity.score(edge, model)
    assert toxicity.score(edge.limit(0), model, "s").count() == 0
    kept = toxicity.drop_toxic(edge, labels.limit(0))  # nothing learnt: nothing goes, the user's column stays
    assert sorted(map(str, kept.collect())) == sorted(map(str, edge.collect()))


def test_tied_labels(spark, tiny):
    docs, labels = tiny
    more = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None), (3, 7)], labels.schema))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, more)
    assert (a.ratio == b.ratio).all() and (a.weights == b.weights).all()


def test_fitted_is_no_cap_on_counts(spark):
    fold = defaultdict(list)
    for k in range(60):
        fold[zlib.crc32(str(k).encode()) % 4].append(k)
    rows = [(fold[0][0], "plain text", 0), (fold[0][1], "zgrum", 1), *[(k, "blarghx", 1) for k in fold[3]], *[(k, "held out", 1) for k in fold[2]]]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int"), fitted=1)
    assert set(code(g) for t in ("plain text", "zgrum", "blarghx") for g in brute_grams(t)) == set(model.gram.tolist())


def test_pipeline_stage_keeps_columns(spark):
    docs = table(spark, SF, "documents").withColumnRenamed("lang", "toxic_score")
    out = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, SF)
    assert out.columns == docs.columns and out.filter("toxic_score not in ('en','de','fr','es')").count() == docs.filter("toxic_score not in ('en','de','fr','es')").count()
