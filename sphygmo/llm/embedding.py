"""Embedding near-duplicates by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sphygmo.llm.common import table, written
from sphygmo.llm.graph import by_group, components

#: Vectors link at or above this cosine.
THRESHOLD = 0.9
#: Neighbours kept for each vector, neighbouring vectors of an order that are compared with each other, and bytes that these
#: have as doubles at most: fewer are compared where vectors are long.
LISTS, BLOCK, BLOCK_BYTES = 10, 1024, 64 << 20
#: The chance at which an isolated pair at the threshold may be missed by the orders that start the graph: their number
#: follows from it and from the size of the table.
MISSED = 0.01
#: Probes that are laid at the threshold beside random vectors, and the share of them, less its standard error times
#: :data:`SURE`, that the orders must find; else more orders follow, so many times at most.
PROBES, SURE, TURNS = 1024, 1.645, 6
#: Rounds go on while they join components; then an audit must find this recall, in one of so many audits. An audit asks more
#: and more vectors until it has seen so many links, or asked all, or what :data:`ASKED_BYTES` of vectors allow.
AUDITS, RECALL, LEAST_RECALL, SEEN, ASKED_BYTES = 10, 0.95, 0.9, 100, 8 << 20
#: Cosines this near the threshold are computed again, in one fixed order of sums, so that every stage decides alike.
NEAR = 1e-12
#: Vectors that the audit first compares with all others, and members of a component that one task compares.
AUDITED, TILE = 256, 1024


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors as rows, shorter vectors filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == lengths[0]).all():
        x = flat.reshape(len(lengths), -1)
    else:
        x = np.zeros((len(lengths), max(lengths, default=0)))
        x[np.arange(x.shape[1])[None, :] < lengths[:, None]] = flat
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(largest > 0, largest, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors; those near the threshold do not depend on how the product is cut into blocks."""
    s = x @ y.T
    i, j = np.nonzero(np.abs(s - THRESHOLD) <= NEAR)
    for k in range(0, len(i), 4096):
        a, b = i[k : k + 4096], j[k : k + 4096]
        s[a, b] = (x[a] * y[b]).sum(axis=1)
    return s


def _cosines(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Cosines of all rows with each other in double precision; -1 where dimensions differ."""
    x = _unit(_matrix(column))
    n = pa.compute.list_value_length(column).to_numpy()
    s = _products(x, x)
    return s if (n == n[0]).all() else np.where(n[:, None] == n[None, :], s, -1.0)


def sound() -> Column:
    """Whether ``embedding`` can link: not null, not zero, no null or non-finite component."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return F.coalesce(F.col("embedding").isNotNull() & fine, F.lit(False))


def orders_for(n: int, block: int, missed: float = MISSED) -> tuple[int, int]:
    """(orders, hyperplanes of each) that start the graph of ``n`` vectors.

    A pair at the threshold is on one side of a random hyperplane with chance p = 1 - angle / pi. In an order by signs it
    meets in a run when about log2(n / block) + 1 signs agree; so the orders grow with the table.
    """
    p = 1 - np.arccos(THRESHOLD) / np.pi
    signs = max(0.0, np.log2(max(n, 1) / block)) + 1
    return max(3, int(np.ceil(np.log(missed) / np.log(1 - p**signs)))), min(62, max(20, int(signs) + 4))


def with_probes(nodes: DataFrame, n: int) -> DataFrame:
    """The nodes, and about PROBES more with negative ids: vectors at the threshold from some nodes, in random directions."""

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, size = _unit(_matrix(b.column(1))), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            out = []
            for k, i in enumerate(b.column(0).to_pylist()):
                u, d = x[k, : size[k]], int(size[k])
                v = np.random.Generator(np.random.PCG64(i)).standard_normal(d)
                v -= u * (u @ v)
                length = np.sqrt(v @ v)
                out.append((THRESHOLD * u + np.sqrt(1 - THRESHOLD**2) * v / length if length > 1e-9 else u) * (1 + 1e-9))
            yield pa.record_batch([pa.array([-1 - i for i in b.column(0).to_pylist()], pa.int64()), pa.array([o.tolist() for o in out], b.schema.field(1).type)], ["id", "embedding"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    some = nodes.select("id", "embedding").filter(F.pmod(F.xxhash64(F.lit("probe"), "id"), F.lit(max(1, n // PROBES))) == 0)
    return nodes.select("id", "embedding").unionByName(some.mapInArrow(laid, f"id long, embedding {kind}"))


def starting_graph(nodes: DataFrame, orders: int, planes: int, seed: int, block: int) -> DataFrame:
    """(u, v, s): what :func:`_kept` keeps of each node's neighbours in several random-projection orders; and for each probe
    (negative id) that meets a vector within the threshold, one such link.

    An order sorts the nodes by the signs of random projections, equal signs by a hash, and compares runs of ``block``; so a
    dense group of any size spreads over many runs, others in each order.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            for t in range(orders):
                sides = np.random.Generator(np.random.PCG64([7, seed, t])).standard_normal((x.shape[1], planes))
                codes = (x @ sides > 0) @ (1 << np.arange(planes, dtype=np.int64)[::-1])
                yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(codes), b.column(0), b.column(1)], ["order", "code", "id", "embedding"])

    def found(run: pa.Table) -> pa.RecordBatch:
        name = run.column("id").to_numpy()
        s = _cosines(run.column("embedding"))
        real, probe = np.flatnonzero(name >= 0), np.flatnonzero(name < 0)
        u, v, w = _kept(name[real], name[real], s[np.ix_(real, real)]) if len(real) > 1 else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        if len(probe) and len(real):
            near = s[np.ix_(probe, real)]
            at = near.argmax(axis=1)
            top = near[np.arange(len(probe)), at]
            hit = top >= THRESHOLD - 1e-6  # a probe is rounded to the vectors' own precision
            u, v, w = np.r_[u, name[probe][hit]], np.r_[v, name[real][at[hit]]], np.r_[w, top[hit]]
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.float64())], ["u", "v", "s"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 2 * block:
                whole = pa.Table.from_batches(held)
                while whole.num_rows >= 2 * block:
                    yield found(whole.slice(0, block))
                    whole = whole.slice(block)
                held, rows = whole.to_batches(), whole.num_rows
        if rows > 1:
            yield found(pa.Table.from_batches(held))

    kind = nodes.schema["embedding"].dataType.simpleString()
    coded = nodes.select("id", "embedding").mapInArrow(code, f"order int, code long, id long, embedding {kind}")
    dealt = coded.withColumn("tie", F.xxhash64("order", "id")).repartitionByRange("order", "code", "tie").sortWithinPartitions("order", "code", "tie")
    return dealt.select("id", "embedding").mapInArrow(runs, "u long, v long, s double")


def started(nodes: DataFrame) -> DataFrame:
    """(u, v, s) that start the graph, by as many orders as find the probes; RuntimeError if TURNS times the orders do not."""
    n = nodes.count()
    width = nodes.agg(F.max(F.size("embedding"))).first()[0] or 1
    block = min(BLOCK, max(64, BLOCK_BYTES // (8 * width)))
    orders, planes = orders_for(n, block)
    probed = written(with_probes(nodes, n), "probed")
    laid = probed.filter("id < 0").count()
    none = nodes.sparkSession.createDataFrame([], "u long, v long, s double")
    graph, share = none, 0.0
    for turn in range(TURNS):
        graph = written(graph.unionByName(starting_graph(probed, orders, planes, turn, block)).groupBy("u", "v").agg(F.max("s").alias("s")), "orders")
        share = graph.filter("u < 0").select("u").distinct().count() / laid if laid else 1.0
        if share - SURE * (share * (1 - share) / max(1, laid)) ** 0.5 >= LEAST_RECALL:
            return graph.filter("u >= 0")
    raise RuntimeError(f"{share:.1%} of {laid} probes found, too few to be sure of {LEAST_RECALL:.0%}")


def _forest(label: np.ndarray, linked: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of the links, as few as join all the labels that they join; and the labels joined."""
    label, edges = label.copy(), []
    for i in np.nonzero((linked & (label[:, None] != label[None, :])).any(axis=1))[0]:
        at = np.nonzero(linked[i] & (label != label[i]))[0]
        if len(at):
            others, first = np.unique(label[at], return_index=True)
            edges += [(i, j) for j in at[first]]
            label[np.isin(label, others)] = label[i]
    return edges, label


def _kept(name: np.ndarray, label: np.ndarray, s: np.ndarray, floor: np.ndarray | None = None, far_floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, s) that stay of all cosines of some nodes with components ``label``: no link that joins components is lost.

    These are a forest of the links between components; each node's LISTS nearest above its floor; and, as links fill
    the list of a node in a dense group, its LISTS nearest outside its component above its other floor.
    """
    s = np.where(name[:, None] == name[None, :], -2.0, s)
    edges, label = _forest(label, s >= THRESHOLD)
    low = np.full(len(name), -2.0)
    k = min(LISTS, len(name) - 1)

    def above(s: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        i, c = np.nonzero(np.take_along_axis(s, at, 1) > low[:, None])
        return i, at[i, c]

    i, j = above(s, low if floor is None else floor)
    far = np.where(label[:, None] == label[None, :], -2.0, s)
    if far_floor is None:
        far_floor = np.where((s >= THRESHOLD).sum(axis=1) >= LISTS, -2.0, 2.0)
    a, b = above(far, far_floor)
    x, y = np.array(edges, int).reshape(-1, 2).T
    pairs = np.unique(np.stack([np.concatenate([i, a, x, y]), np.concatenate([j, b, y, x])]), axis=1)
    return name[pairs[0]], name[pairs[1]], s[pairs[0], pairs[1]]


def sided(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Adds ``far``: whether an edge joins different components."""
    side = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    return edges.join(side("u"), "u", "left").join(side("v"), "v", "left").withColumn("far", F.coalesce("_u", "u") != F.coalesce("_v", "v")).drop("_u", "_v")


def nearest(edges: DataFrame, part: DataFrame, k: int = LISTS) -> DataFrame:
    """(u, v, s, far): the ``k`` nearest of each node's edges; where those are links all, its ``k`` nearest outside its
    component too; and each link between components. Each neighbour once."""
    w = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    beyond = Window.partitionBy("u").orderBy(F.desc("far"), F.desc("s"), "v")
    link = F.col("s") >= THRESHOLD
    once = sided(edges.groupBy("u", "v").agg(F.max("s").alias("s")), part)
    ranked = once.withColumn("r", F.row_number().over(w)).withColumn("q", F.row_number().over(beyond))
    full = F.count(F.when(link, 1)).over(Window.partitionBy("u")) >= k
    return ranked.withColumn("full", full).filter((F.col("r") <= k) | F.col("far") & (link | F.col("full") & (F.col("q") <= k))).drop("r", "q", "full")


def refine(graph: DataFrame, nodes: DataFrame, part: DataFrame) -> DataFrame:
    """One round: neighbours of a node become neighbours of each other where that betters their lists or joins components.

    A node brings together its list and as many of those that list it, nearest first; who is left out there meets the
    node's neighbours through its own list, and dense groups are completed afterwards.
    """
    now = written(sided(graph.select("u", "v", "s"), part), "sides")
    back = now.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")
    around = now.select("u", "v", "s").unionByName(nearest(back, part).drop("far"))
    top = now.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v")))
    lowest = lambda m, n: F.when(n >= LISTS, m).otherwise(F.lit(-2.0))
    floor = top.groupBy("u").agg(
        lowest(F.min(F.when(F.col("r") <= LISTS, F.col("s"))), F.count("*")).alias("floor"),
        lowest(F.min(F.when(F.col("far"), F.col("s"))), F.count(F.when(F.col("far"), 1))).alias("beyond"),
    )
    # only links fill a list: else whatever is outside the component comes by the first floor
    floor = floor.withColumn("beyond", F.when(F.col("floor") >= THRESHOLD, F.col("beyond")).otherwise(F.lit(2.0)))
    own = part.withColumnRenamed("node", "v").withColumnRenamed("component", "part")
    known = nodes.select(F.col("id").alias("v"), "embedding").join(floor.withColumnRenamed("u", "v"), "v", "left").join(own, "v", "left")
    met = around.select("u", "v").distinct().join(known, "v")
    met = met.select("u", "v", F.coalesce("part", "v").alias("part"), F.coalesce("floor", F.lit(-2.0)).alias("floor"), F.coalesce("beyond", F.lit(2.0)).alias("beyond"), "embedding")

    def work(group: pa.Table) -> list[tuple]:
        if group.num_rows < 2:
            return []
        name, label, floor_, beyond = (group.column(c).to_numpy() for c in ("v", "part", "floor", "beyond"))
        return list(zip(*(x.tolist() for x in _kept(name, label, _cosines(group.column("embedding")), floor_, beyond)), strict=True))

    return by_group(met, "u", work, "u long, v long, s double")


def audit(nodes: DataFrame, part: DataFrame, turn: int) -> tuple[int, DataFrame | None, int]:
    """How many links some nodes have, by comparison with all nodes, which of those join components, and how many these are.

    The nodes are picked by hash, others in each turn: AUDITED first, then four times as many, until SEEN links are seen, or
    all nodes were asked, or their vectors reach ASKED_BYTES; so what is broadcast has a fixed bound.
    """
    asked, n = AUDITED, nodes.count()
    picked = nodes.select("id", "embedding").orderBy(F.xxhash64(F.lit("audit"), F.lit(turn), "id"))
    while True:
        queries = picked.limit(asked).toArrow()
        if not queries.num_rows:
            return 0, None, 0
        name, width = queries.column("id").to_numpy(), queries.column("embedding")

        def run(batches: Iterator[pa.RecordBatch], name: np.ndarray = name, width: pa.ChunkedArray = width) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, BLOCK):  # a block of vectors against a block of queries at a time
                    b = whole.slice(k, BLOCK)
                    for q in range(0, len(name), BLOCK):
                        both = pa.chunked_array([*width.slice(q, BLOCK).chunks, b.column(1)])
                        own = name[q : q + BLOCK]
                        s = _cosines_between(both, len(own))
                        i, j = np.nonzero((s >= THRESHOLD) & (own[:, None] != b.column(0).to_numpy()[None, :]))
                        yield pa.record_batch([pa.array(own[i]), b.column(0).take(pa.array(j))], ["u", "v"])

        links = written(sided(nodes.select("id", "embedding").mapInArrow(run, "u long, v long"), part), "audit")
        true, missed = links.agg(F.count("*"), F.count(F.when(F.col("far"), 1))).first()
        if true >= SEEN or asked >= n or 4 * queries.nbytes > ASKED_BYTES:
            return true, links.filter("far").select("u", "v"), missed
        asked *= 4


def linking(graph: DataFrame) -> DataFrame:
    """The links of the graph that join components."""
    return graph.filter(F.col("far") & (F.col("s") >= THRESHOLD))


def joined(part: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after the links (u, v) too."""
    known = part.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return written(components(known.unionByName(links.select(F.col("u").alias("a"), F.col("v").alias("b")))), "parts")


def _cosines_between(column: pa.ChunkedArray, n: int) -> np.ndarray:
    x = _unit(_matrix(column))
    d = pa.compute.list_value_length(column).to_numpy()
    return np.where(d[:n, None] == d[None, n:], _products(x[:n], x[n:]), -1.0)


def complete(nodes: DataFrame, part: DataFrame) -> DataFrame:
    """(id, n): how many vectors each node of a component links, from whole lists.

    In a dense group more vectors pass the threshold than a list holds: the lists are saturated. They are enlarged to
    all of the component: its members, dealt to tiles by hash, are compared tile by tile, and each task gives a count for
    each of its members, never the pairs. Members that stand for equal vectors count for all of them.
    """
    size = part.groupBy("component").agg(F.count("*").alias("m"))
    rows = nodes.join(part.join(size, "component").withColumnRenamed("node", "id"), "id")
    rows = rows.withColumn("_of", F.ceil(F.col("m") / TILE)).withColumn("_t", F.pmod(F.xxhash64("id"), F.col("_of")))
    rows = rows.withColumn("_p", F.explode(F.expr("transform(sequence(0, _of - 1), k -> struct(least(k, _t) AS i, greatest(k, _t) AS j))")))
    rows = rows.withColumn("_k", F.concat_ws(":", "component", "_p.i", "_p.j")).withColumn("_two", (F.col("_p.i") != F.col("_p.j")).cast("int"))

    def work(group: pa.Table) -> list[tuple]:
        name, copies, tile = (group.column(c).to_numpy() for c in ("id", "copies", "_t"))
        linked = _cosines(group.column("embedding")) >= THRESHOLD
        np.fill_diagonal(linked, False)
        if group.column("_two")[0].as_py():
            linked &= tile[:, None] != tile[None, :]
        return list(zip(name.tolist(), (linked @ copies).tolist(), strict=True))

    return by_group(rows.select("_k", "id", "copies", "_t", "_two", "embedding"), "_k", work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Equal vectors become one node that counts for all of them. Random-projection orders start a neighbour graph, as many as
    the table's size asks for and as probes at the threshold show to be enough: that holds for isolated pairs, which no
    neighbour leads to. Rounds of neighbours-of-neighbours joins refine it until a round joins no components and an audit
    against all vectors finds the recall. Each link met between components joins them; a list filled by links is enlarged beyond its
    component, and to the whole of it in the end, where every pair is confirmed in double precision. Links that an audit
    misses are added; RuntimeError if AUDITS audits do not find the recall, or the orders too few probes.

    Vectors of floats stay floats until they are compared; any other numbers are taken as doubles.

    Null, empty or zero vectors, null or non-finite components: no links, a component of their own, kept. Vectors of
    different lengths do not link. Repeated rows link like any equal vectors; equal vec_ids are not told apart in
    component_id. Null vec_id: component_id the smallest of the others, null if alone. No rows: no rows. Other columns
    are ignored.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    # equal vectors by a digest of their values; -0.0 counts as 0.0
    digest = F.md5(F.to_json(F.transform("embedding", lambda v: v + F.lit(0.0).cast(kind))))
    keyed = written(own.filter(sound()).withColumn("class", digest), "vectors")
    nodes = keyed.groupBy("class").agg(F.min("vec_id").alias("first_vec"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    part = nodes.sparkSession.createDataFrame([], "node long, component long")
    graph = written(nearest(started(nodes), part), "graph")
    part, turn = joined(part, linking(graph)), 0
    while True:
        graph = written(nearest(graph.select("u", "v", "s").unionByName(refine(graph, nodes, part)), part), "graph")
        if not linking(graph).isEmpty():
            part = joined(part, linking(graph))
            continue
        true, missed, lost = audit(nodes, part, turn)
        if lost:
            part = joined(part, missed)
        if true - lost >= RECALL * true:
            break
        turn += 1
        if turn == AUDITS:
            raise RuntimeError(f"{true - lost} of {true} audited links found, fewer than {RECALL:.0%}")
    counts = complete(nodes, part)
    first = part.join(nodes.select(F.col("id").alias("node"), "first_vec"), "node").groupBy("component").agg(F.min("first_vec").alias("linked"))
    linked = part.join(first, "component").select(F.col("node").alias("id"), "linked")
    per_class = nodes.select("id", "class", "first_vec", "copies").join(linked, "id", "left").join(counts, "id", "left")
    per_class = per_class.select("class", F.coalesce("linked", "first_vec").alias("_first"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"))
    good = keyed.select("vec_id", "class").join(per_class, "class").select("vec_id", F.col("_n").alias("n_links"), F.col("_first").alias("component_id"))
    bad = own.filter(~sound()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``, whatever their labels: links, component and whether the vector is kept."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = f"""
WITH RECURSIVE sound AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.n AS i, b.n AS j FROM sound a JOIN sound b ON a.n <> b.n AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach(i, j) AS (SELECT n, n FROM sound UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
least AS (SELECT r.i AS n, min(s.vec_id) AS component_id FROM reach r JOIN sound s ON s.n = r.j GROUP BY r.i),
counts AS (SELECT i AS n, count(*) AS n_links FROM links GROUP BY i),
found AS (
  SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id FROM sound JOIN least USING (n) LEFT JOIN counts USING (n)
  UNION ALL SELECT vec_id, 0, vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM sound)
)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM found
"""
