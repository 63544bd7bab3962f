"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one. The different ones are dealt to shards by hash; a task builds the graph of a shard and writes it to the
shared folder. Every vector then asks every shard: greedy steps on the upper levels, a beam on the lowest, and on from all that
lies within the wanted likeness until nothing more does. An audit compares samples of all queries, of those with links and of planted
near copies with all vectors; while its recall is too low, beams are widened and all is asked again. If the widest one fails
too, every vector is compared with all, shard by shard in blocks. Links are pairs whose cosine, in double
precision, is high enough; components are united from a spanning forest of those found, made shard by shard.

Vectors are inserted and asked in batches, so that the steps of a batch are a few array operations.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import arrow_batch, new_name, partitions, store_of, stored
from runlattice.llm.graph import components
from runlattice.session import shared_folder

LIKENESS = 0.95
#: Shards at least, vectors of a shard about; neighbours on upper levels (twice as many on the lowest); beam when inserting.
SHARDS, SHARD, LINKS, BUILD_BEAM = 4, 50_000, 12, 48
#: Beams to ask with, one after the other until the audit passes; sampled queries of the audit, the recall asked for, and the
#: true links it takes to see that (no miss in 3 / (1 - RECALL) has a chance of 5 % at a lower recall): so many queries with links are sampled and so many near copies planted.
BEAMS, AUDITED, RECALL, ENOUGH = (32, 96, 256, 1024), 256, 0.995, 600
#: Vectors inserted or asked at once, and rows compared at once in the audit.
BATCH = 512


class Graph:
    """Unit vectors and, per level, the neighbours of each node (-1: none)."""

    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.entry = vectors, levels, entry

    @classmethod
    def build(cls, vectors: np.ndarray, heights: np.ndarray) -> Graph:
        """Nodes are inserted in descending order of height, in batches that at most double the graph; each is joined to the
        nearest found on its levels, and to the nearest of its own batch."""
        order = np.argsort(-heights, kind="stable")
        x, heights = vectors[order], heights[order]
        n, top = len(x), int(heights[0]) if len(x) else 0
        width = [2 * LINKS] + [LINKS] * top
        graph = cls(x, [np.full((n if level == 0 else int((heights >= level).sum()), width[level]), -1, np.int32) for level in range(top + 1)], 0)
        done = min(n, 64)
        graph._join(0, done, heights, np.tile(np.arange(done), (done, 1)) if done else np.empty((0, 0), int))
        while done < n:
            end = min(n, 2 * done, done + BATCH)
            graph._join(done, end, heights, None)
            done = end
        graph.order = order
        return graph

    def _join(self, start: int, end: int, heights: np.ndarray, everyone: np.ndarray | None) -> None:
        if start == end:
            return
        new = np.arange(start, end)
        own = self.vectors[new] @ self.vectors[new].T
        for level in range(int(heights[new].max()), -1, -1):
            rows = np.flatnonzero(heights[new] >= level)
            if everyone is None:
                near, _ = self._beam(self.vectors[new[rows]], BUILD_BEAM, level, start)
            else:
                near = np.empty((len(rows), 0), np.int64)
            batch = np.where(heights[new][None, :] >= level, own[rows], -2.0)
            batch[np.arange(len(rows)), rows] = -2.0
            k = min(BUILD_BEAM, batch.shape[1])
            peers = np.argpartition(-batch, k - 1, axis=1)[:, :k]
            candidates = np.concatenate([near, np.where(np.take_along_axis(batch, peers, 1) > -2, new[peers], -1)], 1)
            table = self.levels[level]
            chosen = self._spread(new[rows], candidates, LINKS)
            table[new[rows], : chosen.shape[1]] = chosen
            self._back(level, np.repeat(new[rows], chosen.shape[1]), chosen.ravel())

    def _spread(self, nodes: np.ndarray, candidates: np.ndarray, m: int) -> np.ndarray:
        """Of each node's candidates up to m, nearest first, that are nearer to the node than to one chosen already; places
        left go to the nearest of the others, so no node is left with few links."""
        x = self.vectors
        sim = np.where(candidates >= 0, np.einsum("nkd,nd->nk", x[candidates], x[nodes]), -2.0)
        rank = np.argsort(-sim, axis=1, kind="stable")[:, : 3 * m]
        cand, sim = np.take_along_axis(candidates, rank, 1), np.take_along_axis(sim, rank, 1)
        between = np.einsum("nkd,njd->nkj", x[cand], x[cand])
        n, k = cand.shape
        taken, count = np.zeros((n, k), bool), np.zeros(n, int)
        for j in range(k):
            hidden = (taken[:, :j] & (between[:, j, :j] > sim[:, j : j + 1])).any(1) if j else np.zeros(n, bool)
            again = (cand[:, :j] == cand[:, j : j + 1]).any(1) if j else np.zeros(n, bool)
            sim[again, j] = -2.0
            take = ~hidden & (count < m) & (sim[:, j] > -2)
            taken[:, j] = take
            count += take
        score = np.where(sim > -2, sim + 4.0 * taken, -2.0)
        best = np.argsort(-score, axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(cand, best, 1)
        return np.where(np.take_along_axis(score, best, 1) > -2, out, -1)

    def _back(self, level: int, source: np.ndarray, target: np.ndarray) -> None:
        """Links back from the chosen neighbours; a node with too many keeps a spread choice of them."""
        table = self.levels[level]
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, begin, counts = np.unique(target, return_index=True, return_counts=True)
        if not len(nodes):
            return
        place = np.arange(len(target)) - np.repeat(begin, counts)
        fresh = np.full((len(nodes), counts.max()), -1, np.int64)
        fresh[np.repeat(np.arange(len(nodes)), counts), place] = source
        for part in range(0, len(nodes), BATCH):
            some = slice(part, part + BATCH)
            candidates = np.concatenate([table[nodes[some]], fresh[some]], 1)
            if candidates.shape[1] > 6 * table.shape[1]:  # a node that very many chose: the nearest of them
                sim = np.where(candidates >= 0, np.einsum("nkd,nd->nk", self.vectors[candidates], self.vectors[nodes[some]]), -2.0)
                candidates = np.take_along_axis(candidates, np.argsort(-sim, axis=1)[:, : 6 * table.shape[1]], 1)
            table[nodes[some]] = -1
            chosen = self._spread(nodes[some], candidates, table.shape[1])
            table[nodes[some], : chosen.shape[1]] = chosen

    def _descend(self, queries: np.ndarray, level: int, size: int) -> np.ndarray:
        """The node that greedy steps reach on the levels above."""
        at = np.full(len(queries), self.entry)
        for upper in range(len(self.levels) - 1, level, -1):
            table = self.levels[upper]
            best = np.einsum("nd,nd->n", self.vectors[at], queries)
            moving = np.arange(len(queries))
            while len(moving):
                near = table[at[moving]]
                sim = np.where((near >= 0) & (near < size), np.einsum("nkd,nd->nk", self.vectors[near], queries[moving]), -2.0)
                k = sim.argmax(1)
                found = sim[np.arange(len(moving)), k]
                better = found > best[moving]
                at[moving[better]] = near[better, k[better]]
                best[moving[better]] = found[better]
                moving = moving[better]
        return at

    def _beam(self, queries: np.ndarray, beam: int, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest found, and their likenesses, of the first `size` nodes: per query the beam's best, -1 where fewer."""
        n, table = len(queries), self.levels[level]
        nodes = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2.0, queries.dtype)
        opened = np.ones((n, beam), bool)
        nodes[:, 0] = self._descend(queries, level, size)
        sims[:, 0] = np.einsum("nd,nd->n", self.vectors[nodes[:, 0]], queries)
        opened[:, 0] = False
        live = np.arange(n)
        while len(live):
            first = np.where(opened[live], -3.0, sims[live]).argsort(1)[:, ::-1][:, :4]  # the nearest that aren't opened
            closed = np.take_along_axis(opened[live], first, 1)
            from_ = np.where(closed, -1, np.take_along_axis(nodes[live], first, 1))
            opened[live[:, None], first] = True
            near = np.where(from_[:, :, None] >= 0, table[np.minimum(from_, len(table) - 1)], -1).reshape(len(live), -1).astype(np.int64)
            near[near >= size] = -1
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            known = np.sort(nodes[live], 1)
            flat = known + (np.arange(len(live)) * (size + 2))[:, None]
            asked = near + (np.arange(len(live)) * (size + 2))[:, None]
            place = np.minimum(np.searchsorted(flat.ravel(), asked.ravel()), flat.size - 1)
            near[(flat.ravel()[place] == asked.ravel()).reshape(near.shape)] = -1
            sim = np.where(near >= 0, np.einsum("nkd,nd->nk", self.vectors[near], queries[live]), -2.0)
            all_sims = np.concatenate([sims[live], sim], 1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], near], 1), best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], near < 0], 1), best, 1)
            live = live[~opened[live].all(1)]
        return nodes, sims

    def within(self, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
        """Per query all nodes found with at least that likeness: the beam's, and on from those by links until none is new."""
        nodes, sims = self._beam(queries, beam, 0, len(self.vectors))
        table = self.levels[0]
        seen = np.zeros(len(self.vectors), bool)
        for i in range(len(queries)):
            found = nodes[i][(sims[i] >= least) & (nodes[i] >= 0)]
            if not len(found):
                continue
            reached = [found]
            seen[found] = True
            looked = [found]
            while len(found):
                near = np.unique(table[found])
                near = near[near >= 0]
                near = near[~seen[near]]
                seen[near] = True
                looked.append(near)
                found = near[self.vectors[near] @ queries[i] >= least]
                reached.append(found)
            for some in looked:
                seen[some] = False
            yield i, np.concatenate(reached)

    def all_within(self, queries: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """Per query all nodes with at least that likeness: it is compared with every one, in blocks."""
        found: list[list[np.ndarray]] = [[] for _ in queries]
        for part in range(0, len(self.vectors), 8192):
            query, node = np.nonzero(queries @ self.vectors[part : part + 8192].T >= least)
            for i, some in zip(*np.unique(query, return_index=True)):
                found[i].append(part + node[some : np.searchsorted(query, i, "right")])
        for i, some in enumerate(found):
            if some:
                yield i, np.concatenate(some)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, order=self.order, **{f"level{i}": t for i, t in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as z:
            graph = cls(z["vectors"], [z[f"level{i}"] for i in range(sum(k.startswith("level") for k in z.files))], 0)
            graph.order = z["order"]
        return graph


def heights(hashes: np.ndarray) -> np.ndarray:
    """Level of each node by its hash: one in LINKS goes one level higher."""
    u = ((hashes.astype(np.uint64) >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53
    return np.floor(-np.log(u) / np.log(LINKS)).astype(np.int64)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Rows (node, copies, embedding): the different usable vectors, scaled to length one; node is the least vec_id of each."""
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok &= F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter(ok).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).select("node", "copies", "embedding")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.array(column.flatten()).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _roots(up: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the ways up from these places end."""
    top = up[at]
    while (up[top] != top).any():
        top = up[top]
    return top


def _united(graph: Graph, exact: np.ndarray, likeness: float) -> np.ndarray:
    """Per row of a shard the least row that the graph's own links of enough likeness lead to."""
    n = len(exact)
    table = graph.levels[0]
    a, b = [], []
    for part in range(0, n, BATCH):
        near = table[part : part + BATCH]
        own, other = np.repeat(np.arange(part, part + len(near)), near.shape[1]), near.ravel()
        own, other = graph.order[own[other >= 0]], graph.order[other[other >= 0]]
        linked = np.einsum("nd,nd->n", exact[own], exact[other]) >= likeness
        a.append(own[linked])
        b.append(other[linked])
    own, other = np.concatenate([*a, *b]), np.concatenate([*b, *a])
    up = np.arange(n)
    while True:
        least = up.copy()
        np.minimum.at(least, own, up[other])
        np.minimum.at(least, up[own], up[other])  # a tree's root goes along
        least = _roots(least, np.arange(n))
        if (least == up).all():
            return up
        up = least


def _built(nodes: DataFrame, folder: str, n_shards: int, likeness: float, dims: int) -> list[str]:
    """Names of the files of the shards' graphs."""
    rows = nodes.select("node", "embedding", F.pmod(F.xxhash64("node"), F.lit(n_shards)).cast("int").alias("shard"), F.xxhash64("node", F.lit(1)).alias("h"))
    schema = pa.schema([("file", pa.string())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # SHARD vectors about, a shard or a few
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        shard = table.column("shard").to_numpy()
        store, path = store_of(folder)
        for number in np.unique(shard):
            own = table.filter(pa.array(shard == number)).sort_by("node").combine_chunks()
            x = _unit(_matrix(own.column("embedding").chunk(0), dims))
            h = own.column("h").to_numpy().view(np.uint64)
            graph = Graph.build(x.astype(np.float32), heights(h))
            out = io.BytesIO()
            np.savez(out, nodes=own.column("node").to_numpy(), copies=own.column("copies").to_numpy(), exact=x, up=_united(graph, x, likeness))
            name = new_name(f"shard-{number}", ".npz")
            for kind, data in (("graph", graph.packed()), ("rows", out.getvalue())):
                with store.open_output_stream(f"{path}/{kind}-{name}", compression=None) as f:
                    f.write(data)
            yield arrow_batch(schema, [[name]])

    rows = rows.join(nodes.select("node", "copies"), "node")
    dealt = rows.repartitionByRange(n_shards, "shard")
    return sorted(r.file for r in stored(dealt.mapInArrow(build, "file string"), "graph-files").collect())  # a name per shard


#: The shard that a worker read last, and no other.
_SHARD: dict[str, tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def _open(folder: str, name: str) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    def read() -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        store, path = store_of(folder)
        parts = []
        for kind in ("graph", "rows"):
            with store.open_input_file(f"{path}/{kind}-{name}") as f:
                parts.append(f.read())
        with np.load(io.BytesIO(parts[1])) as z:
            return Graph.unpacked(parts[0]), z["nodes"], z["copies"], z["exact"], z["up"]

    if f"{folder}/{name}" not in _SHARD:
        _SHARD.clear()
        _SHARD[f"{folder}/{name}"] = read()
    return _SHARD[f"{folder}/{name}"]


def _asked(queries: DataFrame, folder: str, files: list[str], beam: int | None, likeness: float, dims: int) -> DataFrame:
    """Per query and shard the number of vectors linked to it (copies counted) and the nodes to unite it with: (node, links, others).

    A link is a pair with a cosine of at least `likeness`, judged in double precision. Without a beam all pairs are compared. A task keeps which nodes of a shard are
    united already, from the graph's own links on. `others` are one linked node of each tree of these that a query links to,
    which makes them one tree, and of a query of the shard itself the root of its own; so all that any link joins is joined,
    by no more rows than a task has queries and a shard has nodes.
    """
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("others", pa.list_(pa.int64()))])
    n = partitions(queries.sparkSession)
    asked = queries.select("node", "copies", "embedding", F.explode(F.array(*map(F.lit, files))).alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, up = None, np.empty(0, np.int64)
        for batch in batches:
            names = batch.column(3).to_pylist()
            for name in dict.fromkeys(names):
                graph, nodes, copies, exact, start = _open(folder, name)
                if name != current:
                    current, up = name, start.copy()
                rows = np.flatnonzero(np.array(names, object) == name)
                for part in range(0, len(rows), BATCH):
                    some = batch.take(pa.array(rows[part : part + BATCH]))
                    mine = some.column(0).to_numpy()
                    x = _unit(_matrix(some.column(2), dims))
                    own = np.minimum(np.searchsorted(nodes, mine), len(nodes) - 1)
                    out = {int(m): (0, [int(nodes[start[at]])]) for m, at in zip(mine, own) if nodes[at] == m and start[at] != at}
                    near = x.astype(np.float32), likeness - 1e-4
                    for i, found in graph.within(*near, beam) if beam else graph.all_within(*near):
                        at = graph.order[found]
                        at = at[(exact[at] @ x[i] >= likeness) & (nodes[at] != mine[i])]
                        if len(at):
                            tops, first = np.unique(_roots(up, at), return_index=True)
                            up[at] = up[tops] = tops[0]
                            out[int(mine[i])] = int(copies[at].sum()), nodes[at[first]].tolist() + out.get(int(mine[i]), (0, []))[1]
                    if out:
                        yield arrow_batch(schema, [list(out), *zip(*out.values())])

    return asked.repartition(n, "file", F.pmod(F.xxhash64("node"), F.lit(n))).sortWithinPartitions("file").mapInArrow(run, "node long, links long, others array<long>")


def _drawn(nodes: DataFrame, n: int, seed: int) -> dict[int, list[float]]:
    """At most n nodes and their vectors, first by a hash; no other vector leaves its place."""
    ids = [r.node for r in nodes.select("node").dropna().orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n).collect()]
    return {r.node: r.embedding for r in nodes.filter(F.col("node").isin(ids)).select("node", "embedding").collect()}


def _probes(nodes: DataFrame, likeness: float, dims: int) -> dict[int, list[float]]:
    """Known near copies: ENOUGH vectors turned by a chance angle, at a cosine from `likeness` on, under numbers not in use."""
    drawn = _drawn(nodes, ENOUGH, 4)
    low, high = nodes.agg(F.min("node"), F.max("node")).first()
    x = _unit(np.array([drawn[i] for i in sorted(drawn)], float).reshape(-1, dims))
    rng = np.random.default_rng(4)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    cosine = rng.uniform(likeness + (1 - likeness) * 0.02, 1, (len(x), 1))
    turned = cosine * x + np.sqrt(1 - cosine**2) * side
    return {low - 1 - i if low > -(1 << 62) else high + 1 + i: row for i, row in enumerate(turned.tolist())}


def _audit(nodes: DataFrame, found: DataFrame, probes: dict[int, list[float]], likeness: float, dims: int) -> float:
    """Share of the true links of the sampled queries that were found: they are compared with all vectors, in blocks. AUDITED
    queries are drawn from all, ENOUGH from those that have links, and the probes come on top, so a table with hardly any
    links is audited as well; the lowest share counts."""
    got = found.groupBy("node").agg(F.sum("links").alias("got"))
    having = nodes.join(got.filter("got > 0"), "node", "left_semi")
    drawn = [_drawn(nodes, AUDITED, 2), _drawn(having, ENOUGH, 3), probes]
    held = drawn[0] | drawn[1] | drawn[2]
    ids = np.array(list(held), np.int64)
    queries = nodes.sparkSession.sparkContext.broadcast((ids, _unit(np.array(list(held.values()), float).reshape(-1, dims))))
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = queries.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                some = batch.slice(part, 4096)
                near = (_unit(_matrix(some.column(2), dims)) @ x.T >= likeness) & (some.column(0).to_numpy()[:, None] != ids)
                total += some.column(1).to_numpy() @ near
        yield arrow_batch(schema, [ids, total])

    true = nodes.select("node", "copies", "embedding").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    rows = true.join(got, "node", "left").select("node", "true", F.least("true", F.coalesce("got", F.lit(0))).alias("got")).collect()  # a row per sampled query
    recall = 1.0
    for sample in drawn:
        links = sum(r.true for r in rows if r.node in sample)
        if links:
            recall = min(recall, sum(r.got for r in rows if r.node in sample) / links)
    return recall


def linked(vectors: DataFrame, likeness: float = LIKENESS, beams: tuple[int, ...] = BEAMS) -> DataFrame:
    """Rows (node, links, component) of the different vectors that are linked to another one; vectors of different lengths
    are not."""
    nodes = stored(distinct_vectors(vectors), "graph-nodes")
    lengths = sorted(r.n for r in nodes.select(F.size("embedding").alias("n")).distinct().collect())
    if not lengths:
        return nodes.select("node", F.col("copies").alias("links"), F.col("node").alias("component"))
    return reduce(DataFrame.union, [_linked(nodes.filter(F.size("embedding") == n), n, likeness, beams) for n in lengths])


def _linked(nodes: DataFrame, dims: int, likeness: float, beams: tuple[int, ...]) -> DataFrame:
    spark, n = nodes.sparkSession, nodes.count()
    folder = shared_folder(spark, "graphs")
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    files = _built(nodes, folder, max(SHARDS, -(-n // SHARD)), likeness, dims)
    probes = _probes(nodes, likeness, dims)
    planted = spark.createDataFrame([(i, 1, x) for i, x in probes.items()], nodes.select(F.col("node").cast("long"), F.col("copies").cast("long"), F.col("embedding").cast("array<double>")).schema)
    for beam in beams:
        found = stored(_asked(nodes, folder, files, beam, likeness, dims), "graph-links")
        probed = stored(_asked(planted, folder, files, beam, likeness, dims), "graph-probes")
        recall = _audit(nodes, found.select("node", "links").union(probed.select("node", "links")), probes, likeness, dims)
        if recall >= RECALL:
            break
    else:
        found = stored(_asked(nodes, folder, files, None, likeness, dims), "graph-links")
    links = found.select("node", "links", F.explode_outer("others").alias("other"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    united = components(links.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    return counts.join(united, "node", "left").select("node", "links", F.coalesce("component", "node").alias("component"))


def near_duplicates(vectors: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing and stay. Equal vectors are
    linked. A vec_id names one vector: different vectors under one id are linked as one. A null id names nothing if there is another. Other columns are
    not read. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = rows.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    nodes = distinct_vectors(rows).select("node", "copies", "embedding")
    found = linked(rows, likeness)
    named = nodes.join(found, "node", "left")
    joined = usable.join(named, "embedding", "left")
    component = F.coalesce("component", "node", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
