"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphygmo.llm.common import WORD, id_filter, segments, table, written
from sphygmo.llm.graph import by_group, components

#: Words in a shingle; links at or above this Jaccard similarity, in hundredths.
WORDS, PERCENT = 5, 75
#: Hashes of a signature, bands they form (4 hashes each miss a pair at 0.75 with 5e-6), hashes compared at a time,
#: and the chance at which a pair at the threshold may be pruned.
HASHES, BANDS, BATCH, MISS = 128, 32, 16, 1e-6
#: A bucket up to this size gives all its pairs; a larger one gives a star, and its outliers are looked at after that.
SMALL = 16
#: Classes on either side that one task compares.
TILE = 512
#: Text bytes hashed at a time.
CHUNK = 1 << 20

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * _U(2) + _U(1)
_FLIP = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_TIMES = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 4096)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw``, and where they start."""
    b = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _powers(len(b) + 1)
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of one document's words."""
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        return _mix(np.array([int((words * _PLACE[:n]).sum(dtype=np.uint64)) + n & 0xFFFFFFFFFFFFFFFF], np.uint64))
    return np.unique(_mix(sum(words[k : n - WORDS + 1 + k] * _PLACE[k] for k in range(WORDS))))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's set: A-Z lower-cased, 5-word shingles; fewer words: the whole sequence; none: empty."""
    held: list[bytes] = []

    def flush() -> Iterator[np.ndarray]:
        cuts = np.concatenate([[0], np.cumsum([len(h) + 1 for h in held])])
        words, start = _words(b" ".join(held) + b" ")
        at = np.searchsorted(start, cuts)
        for k in range(len(held)):
            yield _shingles(words[at[k] : at[k + 1]])

    size = 0
    for t in texts:
        raw = (t or "").encode().lower()
        if size + len(raw) > CHUNK and held:
            yield from flush()
            held, size = [], 0
        if len(raw) > CHUNK:  # very long: words are hashed a chunk at a time, cut at white space
            parts, k = [], 0
            while k < len(raw):
                end = min(len(raw), k + CHUNK)
                while end < len(raw) and not _SPACE[raw[end]]:
                    end += 1
                parts.append(_words(raw[k:end])[0])
                k = end
            yield _shingles(np.concatenate(parts))
        else:
            held.append(raw)
            size += len(raw)
    if held:
        yield from flush()


def _minima(x: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 2048):
        low = np.minimum(low, ((x[None, k : k + 2048] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1))
    return low


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, signature, bands, digest): the set's size, its 128-bit digest, 16 bits of each hash, band
    keys, and the digest of the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = HASHES // BANDS
        names = ["doc_id", "n_shingles", "class", "signature", "bands", "digest"]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part, out = batch.slice(k, 512), []
                for x in shingle_sets([t.as_py() for t in part.column(1)]):
                    if not len(x):
                        out.append((0, None, None, None))
                        continue
                    low = _minima(x)
                    keys = _mix((low.reshape(BANDS, rows_of) * _PLACE[None, :rows_of]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                    out.append((len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), (_mix(low) >> _U(48)).astype("<u2").tobytes(), keys.view(np.int64)))
                n, name, sig, bands = zip(*out, strict=True)
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), part.column(2)], names)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.md5(text)).mapInArrow(run, "doc_id long, n_shingles long, class binary, signature binary, bands array<long>, digest string")


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For 1, 2, ... batches compared: the fewest equal hashes at which the posterior chance that the similarity
    reaches the threshold is still ``miss`` or more, from a uniform prior.

    With m of n hashes equal, that posterior is Beta(1 + m, 1 + n - m); its upper tail at t is the chance of m or fewer
    hits in n + 1 draws of chance t.
    """
    t = percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while m < n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return out


def _alive(a: np.ndarray, b: np.ndarray, floor: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two signature matrices stay in play when compared batch by batch, and their equal hashes."""
    at = np.arange(len(a))
    same = np.zeros(len(a), int)
    for k, least in enumerate(floor):
        same = same + (a[at, k * BATCH : (k + 1) * BATCH] == b[at, k * BATCH : (k + 1) * BATCH]).sum(axis=1)
        keep = same >= least
        at, same = at[keep], same[keep]
    return at, same


def _sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave the threshold possible, and how many of their hashes are equal."""
    floor = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(k).to_numpy() for k in (2, 4))
                s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, HASHES) for k in (3, 5))
                at = np.flatnonzero(_sizes_fit(n, m))
                left, same = _alive(s[at], t[at], floor)
                yield pa.record_batch([*batch.select([0, 1]).take(pa.array(at[left])).columns, pa.array(same)], ["a", "b", "same"])

    side = lambda c: classes.select(F.col("class").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a binary, b binary, same long")


def exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (s, t) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    side = lambda c: sets.select(F.col("class").alias(c), F.col("set").alias(f"s{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, set) of the wanted (class, first_doc): their documents are read again, so that no sets need be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(0)]
            for k, end in segments(texts, 256):
                found = [x.tobytes() for x in shingle_sets(texts[k:end]) if len(x)]
                yield pa.record_batch([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in found], pa.binary()), pa.array(found, pa.binary())], ["class", "set"])

    ids = wanted.select(F.col("first_doc").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a null doc_id can be a class's first: it joins too
    return texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text").mapInArrow(run, "class binary, set binary").dropDuplicates(["class"])


class _Sets:
    """Sorted sets of one task, and how many values each has in common with one of them."""

    def __init__(self, sets: list[bytes]) -> None:
        self.each = [np.frombuffer(x, np.uint64) for x in sets]
        self.size = np.array([len(x) for x in self.each])
        values, owner = np.concatenate(self.each), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def linked(self, i: int, j: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.values, self.each[i], side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.size))[j]
        return j[100 * both >= PERCENT * (self.size[i] + self.size[j] - both)]


def outlier_links(large: DataFrame, part: DataFrame, slim: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that large buckets still hide, where their members are not one component after the stars.

    The component that most of a bucket's members are in is its main one; the other members are outliers of it. All
    outliers of one main component, from whatever buckets, are held against all its classes and against each other:
    dealt by hash to tiles of TILE by TILE, signatures first, then the full sets of what is left. A task writes down
    only links that join components not joined before, so a few rows however large the group is.
    ``large`` has (band, class, component), ``part`` (node, component).
    """
    sizes = large.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("k")).filter("k > 1").select("band", F.col("most.component").alias("main"))
    outliers = written(large.join(main, "band").filter("component <> main").select("main", "class", "component").distinct(), "outliers")
    groups = outliers.groupBy("main").agg(F.count("*").alias("o"))
    inside = part.select(F.col("component").alias("main"), F.col("node").alias("class")).unionByName(outliers.select("main", F.col("main").alias("class"))).distinct()
    inside = inside.join(groups, "main")
    counts = inside.groupBy("main").agg(F.count("*").alias("m"), F.first("o").alias("o"))
    tiles = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / TILE)).cast("int")
    deal = lambda of: F.pmod(F.xxhash64("class"), of).cast("int")
    one = inside.select("main", "class").join(counts, "main").withColumn("component", F.col("main")).withColumn("_t", deal(tiles("m")))
    one = one.withColumn("_u", F.explode(F.sequence(F.lit(0), tiles("o") - 1))).withColumn("_k", F.concat_ws(":", F.hex("main"), "_t", "_u")).withColumn("out", F.lit(0))
    two = outliers.join(counts, "main").withColumn("_u", deal(tiles("o")))
    with_main = two.withColumn("_t", F.explode(F.sequence(F.lit(0), tiles("m") - 1))).withColumn("_k", F.concat_ws(":", F.hex("main"), "_t", "_u")).withColumn("out", F.lit(1))
    other = two.withColumn("_t", F.explode(F.sequence(F.lit(0), tiles("o") - 1))).withColumn("_k", F.concat_ws(":", F.lit("o"), F.hex("main"), F.least("_t", "_u"), F.greatest("_t", "_u"))).withColumn("out", F.lit(1))
    cols = ["_k", "out", "class", "component"]
    rows = one.select(*cols).unionByName(with_main.select(*cols)).unionByName(other.select(*cols))
    rows = rows.join(slim, "class").join(sets, "class")
    floor = least_matches()

    def work(group: pa.Table) -> list[tuple]:
        name, out = group.column("class").to_pylist(), group.column("out").to_numpy()
        part = np.unique(np.array(group.column("component").to_pylist(), object), return_inverse=True)[1]
        n = group.column("n_shingles").to_numpy()
        s = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u2").reshape(-1, HASHES)
        full, found = None, []
        for i in np.flatnonzero(out):
            j = np.flatnonzero((part != part[i]) & _sizes_fit(n, n[i]))
            if len(j):
                j = j[_alive(s[j], np.broadcast_to(s[i], (len(j), HASHES)), floor)[0]]
            if len(j):
                full = full or _Sets(group.column("set").to_pylist())
                for k in full.linked(i, j):
                    if part[k] != part[i]:
                        found.append((max(name[i], name[k]), min(name[i], name[k])))
                        part[part == part[k]] = part[i]
        return found

    return by_group(rows.select("_k", "out", "class", "component", "n_shingles", "signature", "set"), "_k", work, "a binary, b binary")


def _found(docs: DataFrame) -> DataFrame:
    """:func:`near_duplicates`, and of each row the digest of its text and the class that stands for its component."""
    sigs = written(signatures(docs), "signatures")
    classes = sigs.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    banded = classes.select("class", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("band", "class"), F.col("class"))).alias("p")).filter("m > 1").select("band", "m", F.col("p.class").alias("pivot"))
    members = written(banded.join(buckets, "band"), "members")
    lists = members.filter(F.col("m") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("class")).alias("l")).select("l").distinct()
    some = F.expr("flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x AS a, y AS b))))")
    small = lists.select(F.explode(some).alias("p")).select("p.a", "p.b")
    star = members.filter((F.col("m") > SMALL) & (F.col("class") != F.col("pivot"))).select(F.least("pivot", "class").alias("a"), F.greatest("pivot", "class").alias("b"))
    slim = classes.select("class", "n_shingles", "signature")
    pairs = written(prune(small.unionByName(star).distinct(), slim), "pairs")

    large = members.filter(F.col("m") > SMALL)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(large.select("class")).distinct()
    sets = written(sets_of(docs, classes.join(nodes, "class", "left_semi")), "sets")
    likeliest = lambda c: pairs.groupBy(c).agg(F.max(F.struct("same", "a", "b")).alias("p")).select("p.a", "p.b")
    links = written(exact(likeliest("a").unionByName(likeliest("b")).distinct(), sets), "links")
    part = written(components(links), "parts")

    def placed(df: DataFrame, c: str) -> DataFrame:
        return df.join(part.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))

    apart = placed(placed(pairs, "a"), "b").filter("_a <> _b").select("a", "b")
    links = links.unionByName(written(exact(apart, sets), "links"))
    part = written(components(links), "parts")
    hidden = outlier_links(placed(large, "class").withColumnRenamed("_class", "component"), part, slim, sets)
    part = written(components(links.unionByName(hidden)), "parts")

    first = part.join(classes.select(F.col("class").alias("node"), "first_doc"), "node").groupBy("component").agg(F.min("first_doc").alias("linked"))
    found = classes.select("class", "first_doc").join(part.join(first, "component").select(F.col("node").alias("class"), "component", "linked"), "class", "left")
    found = found.select("class", F.coalesce("linked", "first_doc").alias("_id"), F.coalesce("component", "class").alias("_group"))
    out = sigs.select("doc_id", "n_shingles", "class", "digest").join(found, "class", "left").withColumn("component_id", F.coalesce("_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "digest", F.col("_group").alias("group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Documents with one and the same set are one class, and everything runs on classes. Signatures are cut into bands;
    classes that share a band are candidates. Small buckets give all their pairs (equal member lists once); of a large
    bucket each member is first held against one of them. Candidates' signatures are compared a batch at a time and
    dropped when the posterior allows; survivors are verified on their full sets: first the likeliest pair of each
    class, then those that would still join two components. What large buckets still hide is found among their outliers
    (:func:`outlier_links`). So no link between different components is left out, and copies or near copies by the
    thousand cost a star for each band.

    component_id is the smallest doc_id of all rows of the linked classes (null ones last). Null and empty texts or texts
    without words: n_shingles 0, a component of their own, kept. Repeated rows: the same class; rows that repeat a kept
    doc_id are kept too. Null doc_id: kept only if nothing else is in its component. No rows: no rows. Other columns
    are ignored.
    """
    return _found(docs).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of near duplicates, that with the smallest doc_id
    (null ones last; of several with that doc_id the one with the smallest digest of its text; of rows equal in both, the
    one with the smallest hash of all its columns). Rows without words are in no group and all stay. No rows: no rows.

    Most rows are settled where they are read: a bit filter tells that their doc_id neither goes nor repeats. Only the
    others, with their texts, meet the list of what stays in a join.
    """
    found = written(_found(docs).filter("n_shingles > 0").select("doc_id", "digest", "group"), "found")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    stay = found.groupBy("group").agg(F.min(row).alias("s")).select("s.none", "s.doc_id", "s.digest")
    stay = written(stay, "stay")
    once = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    settled = stay.filter("not none").select("doc_id").join(once.filter("n = 1"), "doc_id").select("doc_id")
    doubt = once.select("doc_id").filter("doc_id is not null").join(settled, "doc_id", "left_anti")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False)).alias("words"))
    marked = id_filter(rows, doubt.withColumnRenamed("doc_id", "id"), "id").withColumn("open", F.col("words") & (F.col("_perhaps") | F.col("id").isNull()))
    rest = marked.filter("open").withColumn("digest", F.md5(F.col("row.text").cast("string"))).withColumn("none", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0)))
    stay = stay.select("none", F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")
    # repeated rows: partial minima before the shuffle, so a row in a third of the table is no hot group
    rest = rest.join(stay.hint("merge"), ["none", "id", "digest"]).groupBy("none", "id", "digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return marked.filter("not open").select("row.*").unionByName(rest.select("row.*"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is kept, for every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and what they can reach.
OP6_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END) AS g FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
common_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y FROM common_ JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * c >= {PERCENT} * (s.n + t.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM reach r JOIN edge e ON r.b = e.x),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least USING (doc_id) LEFT JOIN size USING (doc_id)
"""
