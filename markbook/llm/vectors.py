"""Near-duplicate embeddings by range search on robust-pruned flat graphs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import settled
from markbook.llm.components import components

LEAST = 0.98


@dataclass(frozen=True)
class Graph:
    """Sizes of the index. None of them limits how many links a vector may have."""

    cell: int = 16_384  # vectors of a label that are searched together; larger labels are cut into overlapping cells
    shard: int = 1024  # vectors of a cell whose graph is built together
    near: int = 24  # nearest vectors of the shard that compete for an edge
    far: int = 8  # vectors drawn from the shard that compete too
    degree: int = 24  # edges a shard may give a vector; united and in both directions it keeps the nearest twice as many
    slack: float = 1.2  # an edge is dropped if a kept one leads so much nearer to its end
    beam: int = 4  # best vectors held while a search approaches its query
    most_centres: int = 16_384  # centres sent to every task, the bound of that broadcast
    sample: int = 65_536  # vectors the centres are fitted on, first by hash

    def wider(self) -> Graph:
        return Graph(self.cell, self.shard, 2 * self.near, 2 * self.far, 2 * self.degree, self.slack, 2 * self.beam,
                     self.most_centres, self.sample)


# --- inside a cell: numpy ------------------------------------------------------------------------------------
def centres_of(vectors: np.ndarray, many: int, seed: int = 7, rounds: int = 6) -> np.ndarray:
    """Unit centres of ``many`` clusters by Lloyd's rounds on at most 64 vectors a cluster."""
    rng = np.random.default_rng(seed)
    some = vectors[rng.permutation(len(vectors))[: 64 * many]]
    centres = some[:many].copy()
    for _ in range(rounds):
        own = (some @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (own == k).any():
                centres[k] = some[own == k].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def two_nearest(vectors: np.ndarray, centres: np.ndarray, block: int = 8192) -> np.ndarray:
    """The two nearest centres of each vector (one, twice, where there is only one)."""
    found = np.zeros((len(vectors), 2), np.int64)
    if len(centres) > 1:
        for at in range(0, len(vectors), block):
            found[at : at + block] = np.argpartition(-(vectors[at : at + block] @ centres.T), 1, axis=1)[:, :2]
    return found


def shards_of(vectors: np.ndarray, most: int, depth: int = 0) -> list[np.ndarray]:
    """Overlapping groups of about ``most`` rows: each row goes to the groups of its two nearest centres."""
    rows = np.arange(len(vectors))
    if len(vectors) <= most:
        return [rows]
    nearest = two_nearest(vectors, centres_of(vectors, -(-2 * len(vectors) // most), depth))
    found = []
    for k in np.unique(nearest):
        mine = rows[(nearest == k).any(1)]
        # vectors that no centre tells apart, as many equal ones, stay one group
        if len(mine) > most and len(mine) < 0.9 * len(vectors):
            found += [mine[part] for part in shards_of(vectors[mine], most, depth + 1)]
        else:
            found.append(mine)
    return found


def pruned_edges(vectors: np.ndarray, graph: Graph, rng: np.random.Generator, block: int = 1024) -> np.ndarray:
    """Neighbours per vector (-1 for none): of its nearest and some drawn vectors, those that no kept one replaces.

    Candidates are taken from near to far; one is kept unless a kept one is nearer to it than the vector is, by the slack
    (robust pruning). Near vectors that prune nothing of each other all stay, so tight groups remain connected.
    """
    n = len(vectors)
    near = min(graph.near, n - 1)
    # a shard's own products are kept and looked up; only groups that no centre cuts are too large for that
    products = vectors @ vectors.T if n <= 4 * graph.shard else None
    edges = np.full((n, graph.degree), -1, np.int64)
    for at in range(0, n, block) if near else ():
        own = np.arange(at, min(at + block, n))
        like = products[own].copy() if products is not None else vectors[own] @ vectors.T
        like[np.arange(len(own)), own] = -np.inf
        close = np.argpartition(-like, near - 1, axis=1)[:, :near]
        drawn = rng.integers(0, n, (len(own), graph.far))
        pool = np.concatenate((close, drawn), axis=1)
        score = np.take_along_axis(like, pool, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        pool, score = np.take_along_axis(pool, order, 1), np.take_along_axis(score, order, 1)
        gap = np.sqrt(np.maximum(2 - 2 * np.where(np.isfinite(score), score, -1), 0))
        alive = np.isfinite(score)
        alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
        kept = np.zeros(len(own), np.int64)
        for j in range(pool.shape[1]):
            take = np.flatnonzero(alive[:, j] & (kept < graph.degree))
            edges[own[take], kept[take]] = pool[take, j]
            kept[take] += 1
            if j + 1 < pool.shape[1] and len(take):
                if products is not None:
                    between = products[pool[take, j, None], pool[take, j + 1 :]]
                else:
                    between = np.einsum("qd,qcd->qc", vectors[pool[take, j]], vectors[pool[take, j + 1 :]])
                reach = graph.slack * np.sqrt(np.maximum(2 - 2 * between, 0))
                alive[take, j + 1 :] &= reach > gap[take, j + 1 :]
    return edges


def flat_graph(vectors: np.ndarray, graph: Graph) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, medoids): graphs of overlapping shards, their adjacency lists united, edges in both directions."""
    rng = np.random.default_rng(11)
    heads, tails, medoids = [], [], []
    for rows in shards_of(vectors, graph.shard):
        own = vectors[rows]
        medoids.append(rows[(own @ own.mean(0)).argmax()])
        edges = pruned_edges(own, graph, rng)
        source, slot = np.nonzero(edges >= 0)
        heads.append(rows[source])
        tails.append(rows[edges[source, slot]])
    head, tail = np.concatenate(heads), np.concatenate(tails)
    both = np.unique(np.concatenate((head * len(vectors) + tail, tail * len(vectors) + head)))
    head, tail = both // len(vectors), both % len(vectors)
    order = np.lexsort((-np.einsum("qd,qd->q", vectors[head], vectors[tail]), head))
    head, tail = head[order], tail[order]
    many = np.bincount(head, minlength=len(vectors))
    place = np.arange(len(head)) - np.repeat(np.cumsum(many) - many, many)
    table = np.full((len(vectors), 2 * graph.degree), -1, np.int64)
    table[head[place < table.shape[1]], place[place < table.shape[1]]] = tail[place < table.shape[1]]
    return table, np.unique(medoids)


def range_search(vectors: np.ndarray, table: np.ndarray, medoids: np.ndarray, queries: np.ndarray, least: float, beam: int):
    """Yield (query row, found row) with likeness of ``least`` or more, for blocks of queries.

    A search starts at the medoids and at the query's own place in the graph, keeps the ``beam`` best vectors seen and follows
    the best not yet followed (greedy). Once the beam is followed it goes on over every vector in range, however many there
    are, until none is left (range expansion).
    """
    n = len(vectors)
    block = max(16, min(1024, 16_000_000 // n))
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        seen = np.zeros((len(q), n), bool)
        ids = np.full((len(q), beam), -1, np.int64)
        like = np.full((len(q), beam), -2, np.float32)
        done = np.ones((len(q), beam), bool)
        row = np.repeat(np.arange(len(q)), len(medoids) + 1)
        new = np.column_stack((q, np.broadcast_to(medoids, (len(q), len(medoids))))).ravel()
        while len(row):
            # what is new: once per query, with its likeness
            row, new = np.divmod(np.unique(row * n + new), n)
            fresh = ~seen[row, new]
            row, new = row[fresh], new[fresh]
            seen[row, new] = True
            value = np.einsum("qd,qd->q", vectors[q[row]], vectors[new])
            close = value >= least
            if close.any():
                yield q[row[close]], new[close]
            # the beam takes the best of what it holds and what is new but not in range
            far_row, far, far_value = row[~close], new[~close], value[~close]
            if len(far):
                all_row = np.concatenate((np.repeat(np.arange(len(q)), beam), far_row))
                all_like = np.concatenate((like.ravel(), far_value))
                order = np.lexsort((-all_like, all_row))
                many = np.bincount(all_row, minlength=len(q))
                place = order[(np.cumsum(many) - many)[:, None] + np.arange(beam)]
                ids = np.concatenate((ids.ravel(), far))[place]
                done = np.concatenate((done.ravel(), np.zeros(len(far), bool)))[place]
                like = all_like[place]
            # followed next: all that is new in range, and the best of the beam
            best = np.where(done, -2, like).argmax(1)
            go = np.flatnonzero(~done[np.arange(len(q)), best])
            done[go, best[go]] = True
            heads = np.concatenate((row[close], go))
            near = table[np.concatenate((new[close], ids[go, best[go]]))]
            which, slot = np.nonzero(near >= 0)
            row, new = heads[which], near[which, slot]


def links_in_cell(exact: np.ndarray, weight: np.ndarray, cells: np.ndarray, cell: int, least: float, graph: Graph):
    """(weights linked per row, smallest linked row) of one cell.

    ``exact`` holds unit vectors in double precision. The search runs in single precision with a margin; every pair found is
    verified in double precision, either way round. A pair that lies in two cells together counts in the first of them.
    """
    n = len(exact)
    vectors = exact.astype(np.float32)
    table, medoids = flat_graph(vectors, graph)
    links, root = np.zeros(n, np.int64), np.arange(n)
    heads, tails = [], []
    for a, b in range_search(vectors, table, medoids, np.arange(n), least - 1e-4, graph.beam):
        good = a != b
        a, b = a[good], b[good]
        true = np.einsum("qd,qd->q", exact[a], exact[b]) >= least
        heads.append(np.minimum(a[true], b[true]))
        tails.append(np.maximum(a[true], b[true]))
    pairs = np.unique(np.concatenate(heads) * n + np.concatenate(tails)) if heads else np.zeros(0, np.int64)
    a, b = pairs // n, pairs % n
    common = np.where((cells[a][:, :, None] == cells[b][:, None, :]).any(2), cells[a], np.iinfo(np.int64).max).min(1)
    first = common == cell
    np.add.at(links, a[first], weight[b[first]])
    np.add.at(links, b[first], weight[a[first]])
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped
    return links, root


# --- tables --------------------------------------------------------------------------------------------------
def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _usable() -> Column:
    """Whether a vector can link: a label, a non-zero norm, finite components only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & finite & some, F.lit(False))


def _centres(nodes: DataFrame, graph: Graph) -> dict[tuple, np.ndarray]:
    """Unit centres per group that is larger than a cell, in all at most ``graph.most_centres``; fitted on the sample."""
    large = (
        nodes.groupBy("label", "size").count().where(F.col("count") > graph.cell)
        .orderBy(F.desc("count"), "label", "size").limit(graph.most_centres // 4).collect()
    )
    total = sum(r["count"] for r in large)
    if not total:
        return {}
    wanted = {(r["label"], r["size"]): -(-2 * r["count"] // graph.cell) for r in large}
    over = max(1.0, sum(wanted.values()) / graph.most_centres)
    some = nodes.join(F.broadcast(nodes.sparkSession.createDataFrame(list(wanted), nodes.select("label", "size").schema)), ["label", "size"])
    drawn = some.orderBy(F.xxhash64("rep"), "rep").limit(graph.sample).select("label", "size", "embedding").collect()
    groups: dict[tuple, list] = {}
    for r in drawn:
        groups.setdefault((r["label"], r["size"]), []).append(r["embedding"])
    found = {}
    for key, rows in groups.items():
        unit = np.array(rows) / np.linalg.norm(np.array(rows), axis=1, keepdims=True)
        many = max(2, int(wanted[key] / over))
        if len(unit) >= many:
            found[key] = centres_of(unit, many)
    return found


def _linked(nodes: DataFrame, least: float, graph: Graph) -> DataFrame:
    """(rep, links, to): per node and cell the copies linked to it, and the smallest node linked there."""
    centres = nodes.sparkSession.sparkContext.broadcast(_centres(nodes, graph))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = centres.value
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist(), strict=True))
            cells = np.zeros((len(keys), 2), np.int64)
            for key in set(keys) & known.keys():
                mine = np.array([k == key for k in keys])
                unit = _matrix(batch.column("embedding").filter(pa.array(mine)))
                cells[mine] = np.sort(two_nearest(unit, known[key]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells[:, 0]), pa.array(cells[:, 1])], [*batch.schema.names, "c0", "c1"]
            )

    label = dict(nodes.dtypes)["label"]
    placed = nodes.select("label", "size", "rep", "n", "embedding").mapInArrow(
        place, f"label {label}, size int, rep long, n long, embedding array<double>, c0 long, c1 long"
    )
    spread = placed.withColumn("cell", F.explode(F.array_distinct(F.array("c0", "c1"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close() -> pa.RecordBatch:
            column = lambda name: np.concatenate([h.column(name).to_numpy() for h in held])
            rep = column("rep")
            exact = np.concatenate([_matrix(h.column("embedding")) for h in held])
            order = np.argsort(rep)
            rep, exact = rep[order], exact[order]
            cells = np.column_stack((column("c0"), column("c1")))[order]
            links, root = links_in_cell(exact, column("n")[order], cells, key[2], least, graph)
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(rep[root])], ["rep", "links", "to"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "size", "cell")), strict=True))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if key is not None and keys[at] != key:
                        yield close()
                        held.clear()
                    key = keys[at]
                    held.append(batch.slice(at, i - at))
                    at = i
        if held:
            yield close()

    return (
        spread.repartition("label", "size", "cell")
        .sortWithinPartitions("label", "size", "cell")
        .mapInArrow(search, "rep long, links long, to long")
    )


def near_duplicates(vectors: DataFrame, least: float = LEAST, graph: Graph = Graph(), audit_at: float = 0.97) -> DataFrame:  # noqa: B008
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label link at cosine ``least`` or more, in double precision. n_links counts the other vectors linked
    directly; component_id is the smallest vec_id reachable; kept tells whether it is the vector's own.

    Equal vectors of a label are one node with a weight. Labels larger than a cell are cut: each node goes to the cells of
    its two nearest centres. A task holds one cell, builds a robust-pruned graph per overlapping shard, unites their
    adjacency lists and runs the range search for every node. Pairs stay inside the task: sums of weights and one edge per
    node to its smallest partner leave it. Afterwards recall is audited on a bounded sample; below ``audit_at`` the graphs
    are built twice as wide and searched again, at most twice. Links are verified, so none is below ``least``.

    Null, zero and non-finite vectors and vectors without a label link with nothing, and vectors of different length do not
    link. Rows that repeat a vec_id are vectors of their own and link with each other. No vectors give no rows.
    """
    every = vectors.select(F.col("vec_id").cast("bigint"), "label", F.col("embedding").cast("array<double>"))
    rows = settled(every.where(_usable()), "vector-rows")
    nodes = settled(
        rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .where("rep is not null").withColumn("size", F.size("embedding")),
        "vector-nodes",
    )
    for _ in range(3):
        found = settled(_linked(nodes, least, graph), "vector-links")
        sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
        if audit(nodes, sums, least) >= audit_at:
            break
        graph = graph.wider()
    linked = settled(components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), "vector-components"), "vector-components")
    named = settled(
        nodes.join(sums, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(
            F.struct("label", "embedding").alias("_key"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        ),
        "vector-named",
    )
    keyed = rows.select("vec_id", F.struct("label", "embedding").alias("_key"))
    good = keyed.join(named, "_key").select("vec_id", "n_links", "component_id")
    other = every.where(~_usable()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(other).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(nodes: DataFrame, sums: DataFrame, least: float = LEAST, queries: int = 256) -> float:
    """Share of the links of sampled nodes that were found; 1.0 without links. The sample, first by hash, is bounded.

    Every node is compared with the sample, in blocks; only counts leave the tasks.
    """
    sample = nodes.orderBy(F.xxhash64("rep", F.lit("audit")), "rep").limit(queries).join(sums, "rep", "left")
    asked: dict[tuple, tuple[list, list]] = {}
    found = 0
    for r in sample.select("label", "size", "rep", "embedding", F.coalesce("links", F.lit(0)).alias("links")).collect():
        group = asked.setdefault((r["label"], r["size"]), ([], []))
        group[0].append(r["rep"])
        group[1].append(r["embedding"])
        found += r["links"]
    ready = {}
    for key, (reps, rows) in asked.items():
        unit = np.array(rows)
        ready[key] = (np.array(reps), unit / np.linalg.norm(unit, axis=1, keepdims=True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist(), strict=True))
            for key in set(keys) & ready.keys():
                mine = pa.array([k == key for k in keys])
                reps, unit = ready[key]
                other = batch.column("rep").filter(mine).to_numpy()
                close = (_matrix(batch.column("embedding").filter(mine)) @ unit.T >= least) & (other[:, None] != reps[None, :])
                total += int((close * batch.column("n").filter(mine).to_numpy()[:, None]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["total"])

    there = nodes.select("label", "size", "rep", "n", "embedding").mapInArrow(count, "total long").agg(F.sum("total")).head()[0]
    return found / there if there else 1.0
