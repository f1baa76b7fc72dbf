"""Merkle dataset manifest: per-source trees, a root over them, and authentication paths by fractal traversal."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphygmo.llm.common import crc32_sql, ranked, table, written
from sphygmo.llm.graph import by_group

#: Children of a node, and tree levels below a block's root: a block has FAN ** DEEP leaves and is one task's group.
FAN, DEEP = 16, 3
BLOCK = FAN**DEEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Builder:
    """Nodes of one level from leaves given one after another, with at most FAN unfinished digests a level below it."""

    def __init__(self, level: int) -> None:
        self.open: list[list[bytes]] = [[] for _ in range(level)]
        self.nodes: list[bytes] = []

    def add(self, node: bytes) -> None:
        for run in self.open:
            run.append(node)
            if len(run) < FAN:
                return
            node = digest(run)
            run.clear()
        self.nodes.append(node)

    def close(self) -> list[bytes]:
        """The nodes, the last of a shorter run than FAN if the leaves end so."""
        carry: list[bytes] = []
        for run in self.open:
            run += carry
            carry = [digest(run)] if run else []
        return self.nodes + carry


class Traversal:
    """Successive authentication paths of the leaves of one tree of ``height`` levels.

    At each level one existing subtree stands: the FAN siblings that hold the current leaf's ancestor. Beside it a desired
    one is built, of the siblings that come next, by one leaf of theirs a step; where an existing subtree ends, the desired
    one takes its place. So at most 2 FAN digests a level are held, and each leaf is hashed once a level.
    """

    def __init__(self, leaf: Callable[[int], bytes], n: int, height: int) -> None:
        self.leaf, self.n, self.height = leaf, n, height
        self.exist: list[list[bytes]] = []
        for level in range(height):
            first = Builder(level)
            for k in range(min(n, FAN ** (level + 1))):
                first.add(leaf(k))
            self.exist.append(first.close())
        self.desired = [Builder(level) for level in range(height)]
        self.ahead = [FAN ** (level + 1) for level in range(height)]

    def paths(self) -> Iterator[list[tuple[int, list[bytes]]]]:
        """For each leaf, level by level: the place in its run, and the run."""
        for i in range(self.n):
            yield [(i // FAN**level % FAN, run) for level, run in enumerate(self.exist)]
            for level in range(self.height):
                if self.ahead[level] < self.n:
                    self.desired[level].add(self.leaf(self.ahead[level]))
                    self.ahead[level] += 1
                if (i + 1) % FAN ** (level + 1) == 0:
                    self.exist[level], self.desired[level] = self.desired[level].close(), Builder(level)


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def framed(c: Column) -> Column:
    """``-`` for null, else how many UTF-8 bytes, a colon, and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    return F.sha2(F.concat(*[framed(text if c == "text" else F.col(c)) for c in fields]), 256)


_STEP = "struct<before:string,after:string>"


def climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, root) and (tree, k, path) of nodes (tree, k, digest, n), n a tree's number of nodes.

    Each level is one grouping of FAN siblings at most; on the way down each node's step (the digests before and after it
    among its siblings) goes before its parent's path. A tree of one node is its own root.
    """
    level, runs, tops = nodes.select("tree", "k", "digest", F.col("n").alias("m")), [], []
    while True:
        tops.append(level.filter("m = 1").select("tree", F.col("digest").alias("root")))
        more = level.filter("m > 1")
        if more.isEmpty():
            break
        run = more.groupBy("tree", F.floor(F.col("k") / FAN).cast("long").alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "digest"))).alias("run"), F.ceil(F.first("m") / FAN).cast("long").alias("m"))
        run = written(run, "tree-level")
        runs.append(run)
        level = run.select("tree", "k", F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256).alias("digest"), "m")
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    none = F.array().cast(f"array<{_STEP}>")
    path = None
    for run in reversed(runs):
        at, texts = F.col("at"), F.transform("run", lambda x: x["digest"])
        child = run.select("tree", F.col("k").alias("up"), "run", F.posexplode(F.transform("run", lambda x: x["k"])).alias("at", "k"))
        step = F.struct(F.array_join(F.slice(texts, F.lit(1), at), "").alias("before"), F.array_join(F.slice(texts, at + 2, F.lit(FAN)), "").alias("after"))
        child = child.select("tree", "k", "up", F.array(step).alias("step"))
        if path is not None:
            child = child.join(path.select("tree", F.col("k").alias("up"), "path"), ["tree", "up"], "left")
        above = none if path is None else F.coalesce("path", none)
        path = written(child.select("tree", "k", F.concat("step", above).alias("path")), "tree-paths")
    lone = nodes.filter("n = 1").select("tree", "k", none.alias("path"))
    return roots, lone if path is None else path.unionByName(lone)


def _siblings(run: list[bytes], at: int) -> list[bytes]:
    return run[:at] + run[at + 1 :]


def block_roots(rows: DataFrame) -> DataFrame:
    """(key, digest): the root of each block (key, rank, leaf, total), at a block's full height unless the tree is lower."""

    def work(block: pa.Table) -> list[tuple]:
        leaves = [x.encode() for x in block.sort_by("rank").column("leaf").to_pylist()]
        top = min(DEEP, height(block.column("total")[0].as_py()))
        built = Builder(top)
        for x in leaves:
            built.add(x)
        (root,) = built.close()
        return [(block.column("key")[0].as_py(), root.decode())]

    return by_group(rows.select("key", "rank", "leaf", "total"), "key", work, "key string, digest string")


def proofs(rows: DataFrame, blocks: DataFrame, paths: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, proof_sha256, folded_root[, path]) of rows (key, rank, total, doc_id, leaf, now).

    ``blocks`` has (key, path, subroot): the steps above each block. A task takes one block at a time with its path,
    walks its leaves by :class:`Traversal`, puts the block's path behind each leaf's own, and folds what the leaf is
    ``now`` up to the root. ``path`` is the whole authentication path, as steps (before, after).
    """
    kind = f", path array<{_STEP}>" * paths
    both = rows.select("key", "rank", "total", "doc_id", "leaf", "now", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(f"array<{_STEP}>").alias("above"))
    none = lambda t: F.lit(None).cast(t)
    both = both.unionByName(blocks.select("key", F.lit(-1).cast("long").alias("rank"), none("long").alias("total"), none("long").alias("doc_id"), none("string").alias("leaf"), none("string").alias("now"), "subroot", F.col("path").alias("above")))

    def work(block: pa.Table) -> list[tuple]:
        block = block.sort_by("rank")
        leaves, now, ids = block.column("leaf").to_pylist()[1:], block.column("now").to_pylist()[1:], block.column("doc_id").to_pylist()[1:]
        raw = [x.encode() for x in leaves]
        subroot, above = block.column("subroot")[0].as_py(), block.column("above")[0].as_py()
        upper = [(x["before"].encode(), x["after"].encode()) for x in above]
        tail = b"".join(a + b for a, b in upper)
        roots: dict[bytes, str] = {}
        out = []
        walk = Traversal(raw.__getitem__, len(raw), min(DEEP, height(block.column("total")[1].as_py())))
        for k, steps in enumerate(walk.paths()):
            proof = hashlib.sha256(b"".join([x for at, run in steps for x in _siblings(run, at)]))
            proof.update(tail)
            node = now[k].encode()
            for at, run in steps:
                node = digest([*run[:at], node, *run[at + 1 :]])
            if node not in roots:
                top = node
                for a, b in upper:
                    top = digest([a, top, b])
                roots[node] = top.decode()
            whole = [{"before": b"".join(run[:at]).decode(), "after": b"".join(run[at + 1 :]).decode()} for at, run in steps] + above if paths else None
            out.append((ids[k], leaves[k], subroot, proof.hexdigest(), roots[node], *[whole] * paths))
        return out

    return by_group(both, "key", work, f"doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string{kind}")


def manifest(leaves: DataFrame, paths: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified[, path]) of rows (source, doc_id, leaf, now).

    Per source, leaves stand by doc_id (null first), equal ones by leaf; every FAN are hashed into one until one is left, the
    source's subroot; the subroots by source (null first) make the root the same way. ``now`` is the leaf of what is there
    now: folded up beside the original siblings it gives the root again only if it is the original leaf. Leaves are cut into
    aligned blocks of :data:`BLOCK`; block roots are built block by block, the tree above them by grouping level by level.
    Repeated rows are leaves of their own. No rows: no rows.
    """
    placed = ranked(leaves.select("source", "doc_id", "leaf", "now"), ["source"], ["doc_id", "leaf"], "rank", "total")
    key = F.concat_ws(":", F.floor(F.col("rank") / BLOCK).cast("string"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    placed = written(placed.withColumn("key", key), "leaves")
    if placed.isEmpty():
        return placed.select("doc_id", "leaf", F.lit("").alias("subroot"), F.lit("").alias("root"), F.lit("").alias("proof_sha256"), F.lit("").alias("folded_root"), F.lit(True).alias("verified"), *[F.array().cast(f"array<{_STEP}>").alias("path")] * paths)
    tree, k = F.regexp_extract("key", "(?s)^[0-9]+:(.*)$", 1), F.regexp_extract("key", "^[0-9]+", 0).cast("long")
    per = placed.groupBy("key").agg(F.first("total").alias("total"))
    nodes = written(block_roots(placed).join(per, "key").select(tree.alias("tree"), k.alias("k"), "digest", F.ceil(F.col("total") / BLOCK).cast("long").alias("n"), "key"), "block-roots")
    subroots, inner = climbed(nodes)
    sources = subroots.withColumn("all", F.lit(0)).withColumn("source", F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30)))
    sources = written(ranked(sources, ["all"], ["source"], "k", "n"), "subroots")
    top, outer = climbed(sources.select(F.lit("").alias("tree"), "k", F.col("root").alias("digest"), "n"))
    (root,) = (r.root for r in top.collect())  # one row
    outer = sources.join(outer.select("k", F.col("path").alias("outer")), "k").select("tree", F.col("root").alias("subroot"), "outer")
    blocks = nodes.select("tree", "k", "key").join(inner, ["tree", "k"]).join(outer, "tree").select("key", "subroot", F.concat("path", "outer").alias("path"))
    found = proofs(placed, blocks, paths)
    return found.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), *["path"] * paths)


def tampered(text: Column, doc_id: Column) -> Column:
    """A-Z in lower case where crc32(doc_id as text) is divisible by 5; null doc_id: as it is."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents``, checked against the documents with every fifth in lower case."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    now = leaf_digest(tampered(F.col("text"), F.col("doc_id")))
    return manifest(docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text")).alias("leaf"), now.alias("now")))


def _sql(levels: int = 7) -> str:
    """All levels written out: a level's runs of FAN, then each node's siblings; trees of up to FAN ** levels nodes."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    low = "CASE WHEN " + crc32_sql("doc_id") + " % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    parts = [f"""docs AS (SELECT doc_id, source, lang, n_chars, text, {low} AS low FROM documents),
    leaves AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, source, {leaf('text')} AS d, {leaf('low')} AS now FROM docs),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS k, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    a0 AS (SELECT tree, k, d, n FROM placed)"""]

    def climb(a: str) -> str:
        out = []
        for v in range(1, levels + 1):
            out.append(f"{a}{v} AS (SELECT tree, k // {FAN} AS k, sha256(string_agg(d, '' ORDER BY k)) AS d, (any_value(n) + {FAN - 1}) // {FAN} AS n FROM {a}{v - 1} WHERE n > 1 GROUP BY tree, k // {FAN})")
        return ",\n".join(out)

    tops = lambda a: " UNION ALL ".join(f"SELECT tree, d FROM {a}{v} WHERE n = 1" for v in range(levels + 1))
    parts += [climb("a"), f"subs AS ({tops('a')})", "b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree <> '-', substr(tree, 2)) - 1 AS k, d, count(*) OVER () AS n, tree AS own FROM subs)", climb("b"), f"top AS ({tops('b')})"]
    joins, path, fold = [], [], "now"
    step = lambda a, v, t, k: f"LEFT JOIN (SELECT x.tree, x.k, string_agg(y.d, '' ORDER BY y.k) FILTER (y.k < x.k) AS lo, string_agg(y.d, '' ORDER BY y.k) FILTER (y.k > x.k) AS hi FROM {a}{v} x JOIN {a}{v} y ON x.tree = y.tree AND x.k // {FAN} = y.k // {FAN} WHERE x.n > 1 GROUP BY 1, 2) {a}p{v} ON {a}p{v}.tree = {t} AND {a}p{v}.k = {k} // {FAN**v}"
    for a, t, k in (("a", "p.tree", "p.k"), ("b", "''", "s.k")):
        for v in range(levels):
            joins.append(step(a, v, t, k))
            path.append(f"coalesce({a}p{v}.lo, '') || coalesce({a}p{v}.hi, '')")
            parts_fold = f"coalesce({a}p{v}.lo, '') || {{}} || coalesce({a}p{v}.hi, '')"
            fold_next = f"f{a}{v}"
            joins.append(f", LATERAL (SELECT CASE WHEN {a}p{v}.tree IS NULL THEN {fold} ELSE sha256({parts_fold.format(fold)}) END AS {fold_next})")
            fold = fold_next
    lefts = "\n".join(j for j in joins if not j.startswith(","))
    laterals = "\n".join(j for j in joins if j.startswith(","))
    return f"""WITH {", ".join(parts)}
SELECT p.doc_id, p.d AS leaf, s.d AS subroot, top.d AS root, sha256({" || ".join(path)}) AS proof_sha256, {fold} AS folded_root, {fold} = top.d AS verified
FROM placed p JOIN b0 s ON s.own = p.tree CROSS JOIN top {lefts}
{laterals}"""


#: Trees of up to FAN ** 4 nodes.
OP13_SQL = _sql(4)
