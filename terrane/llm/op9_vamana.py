"""Embedding near-dedup on a robust-pruned flat graph.

Vectors are compared within a label and a dimension. Equal vectors are one node with a multiplicity. A label with more
than 2 * TARGET nodes is cut into clusters around sampled pivots; a node joins its nearest pivot and every pivot whose
cosine is within a margin of that one, so clusters overlap. On every shard a graph is grown by search: nodes are inserted
in batches, each looks for its place by greedy beam search from the shard's medoid, its beam is robustly pruned to its
neighbours (a candidate goes if a kept neighbour is ALPHA times nearer to it than the node), and neighbours get it back,
pruned again when their lists overflow. The adjacency lists of one node from all its shards are united. Then every node
of a shard is a query: greedy search from the medoid brings it to its place, and the range is expanded from all that lies
within the threshold until nothing new is found. Only cosines of visited nodes are computed; what is found is verified in
double precision.

Recall is audited twice: each shard compares AUDITED of its nodes with all its nodes and, if it falls short, all pairs
instead; then a sample of at most ASKED nodes is compared with the whole table, so links across shards count too. If that
falls short of LEAST_RECALL, the work is done again with twice the margin, up to `rounds` times. The recall measured last
is in the column `recall` (null if the sample had no link); short of LEAST_RECALL it is also told in a warning.

A shard with more than MOST nodes is cut into blocks and each pair of blocks is compared in a task of its own, so no task
grows with the data and no pair of the shard is lost. Nothing is emitted per pair: a shard gives each node its number of
links, a pair being counted in the first shard that both share, and one edge to the least linked node of its part.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, is
linked with nothing and its own component; ids must be numbers; a null id is its own component null; vectors that repeat
are linked with each other; an empty table gives an empty result; other columns pass by unread.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, components

TARGET, MOST = 4000, 40_000
MARGIN = 0.15
#: Most pivots in all, about.
PIVOTS = 8192
DEGREE, WIDTH, BEAM, ALPHA = 16, 32, 24, 1.2
QUERIES = 256
AUDITED, ASKED, LEAST_RECALL = 32, 512, 0.99
#: What single precision may be off by.
SLACK = 1e-5


def unit_rows(t) -> np.ndarray:
    """The vectors of a table in double precision, of length 1."""
    x = np.asarray(t.column("vec").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def prune(x: np.ndarray, own: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of many nodes at once. pool: candidates of each node, -1 pads; so does the result."""
    out = np.full((len(own), degree), -1)
    for lo in range(0, len(own), 128):
        cand, mine = pool[lo : lo + 128], own[lo : lo + 128]
        alive = (cand >= 0) & (cand != mine[:, None])
        v = x[cand]
        sim = np.einsum("bpd,bd->bp", v, x[mine])
        far = np.sqrt(np.maximum(2 - 2 * sim, 0))
        between = np.sqrt(np.maximum(2 - 2 * (v @ v.transpose(0, 2, 1)), 0))
        rows = np.arange(len(cand))
        for r in range(degree):
            at = np.where(alive, far, np.inf).argmin(1)
            some = alive[rows, at]
            if not some.any():
                break
            out[lo + rows[some], r] = cand[rows[some], at[some]]
            alive &= alpha * between[rows, at] > far
            alive[rows, at] = False
    return out


class Graph:
    """Adjacency lists over the rows of x (single precision, length 1); a node pads its list with itself."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.medoid = int((x @ x.mean(0)).argmax()) if len(x) else 0
        self.adj = np.tile(np.arange(self.n)[:, None], (1, WIDTH))
        self.size = np.zeros(self.n, np.int64)
        self.compared = 0

    def search(self, queries: np.ndarray, threshold: float = 9.0, beam: int = BEAM, at_once: int = 4):
        """(beam of each query, nodes visited by each query, pairs of a query and a node within the threshold) of greedy
        search from the medoid; -1 pads the beam."""
        m, rows = len(queries), np.arange(len(queries))[:, None]
        ids, value = np.full((m, beam), -1), np.full((m, beam), -9.0, np.float32)
        open_ = np.zeros((m, beam), bool)
        ids[:, 0], value[:, 0], open_[:, 0] = self.medoid, queries @ self.x[self.medoid], True
        seen = np.zeros((m, self.n), bool)
        seen[:, self.medoid] = True
        near = [(np.flatnonzero(value[:, 0] >= threshold), np.full(int((value[:, 0] >= threshold).sum()), self.medoid))]
        while open_.any():
            at = np.argpartition(np.where(open_, -value, 9.0), at_once - 1, axis=1)[:, :at_once]
            go = open_[rows, at]
            open_[rows, at] = False
            more = self.adj[ids[rows, at]].reshape(m, -1)
            fresh = ~seen[rows, more] & np.repeat(go, self.adj.shape[1], axis=1)
            b, k = np.nonzero(fresh)
            code = np.unique(b * self.n + more[b, k])
            b, u = code // self.n, code % self.n
            seen[b, u] = True
            s = np.einsum("id,id->i", self.x[u], queries[b])
            self.compared += len(u)
            near.append((b[s >= threshold], u[s >= threshold]))
            width = int(np.bincount(b, minlength=m).max()) if len(b) else 0
            slot = np.arange(len(b)) - np.searchsorted(b, np.arange(m))[b]
            new, score = np.full((m, width), -1), np.full((m, width), -9.0, np.float32)
            new[b, slot], score[b, slot] = u, s
            ids, value = np.concatenate([ids, new], 1), np.concatenate([value, score], 1)
            open_ = np.concatenate([open_, new >= 0], 1)
            top = np.argpartition(-value, beam - 1, axis=1)[:, :beam]
            ids, value, open_ = ids[rows, top], value[rows, top], open_[rows, top]
        return ids, seen, tuple(np.concatenate(c) for c in zip(*near))

    def insert(self, nodes: np.ndarray) -> None:
        """Neighbours for the nodes, found by search, and the edges back."""
        for lo in range(0, len(nodes), QUERIES):
            own = nodes[lo : lo + QUERIES]
            kept = prune(self.x, own, self.search(self.x[own])[0])
            for i, k in zip(own, kept):
                k = k[k >= 0]
                self.adj[i, : len(k)], self.size[i] = k, len(k)
            a, r = np.nonzero(kept >= 0)
            self._back(own[a], kept[a, r])

    def _back(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds a to the list of b, edge by edge; lists that overflow are pruned."""
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        nodes, first, count = np.unique(b, return_index=True, return_counts=True)
        fits = self.size[nodes] + count <= WIDTH
        rank = np.arange(len(b)) - np.repeat(first, count)
        ok = np.repeat(fits, count)
        self.adj[b[ok], self.size[b[ok]] + rank[ok]] = a[ok]
        self.size[nodes[fits]] += count[fits]
        over = np.flatnonzero(~fits)
        for lo in range(0, len(over), 512):
            part = over[lo : lo + 512]
            pool = np.full((len(part), WIDTH + int(count[part].max())), -1)
            for j, i in enumerate(part):
                n = self.size[nodes[i]]
                both = np.unique(np.concatenate([self.adj[nodes[i], :n], a[first[i] : first[i] + count[i]]]))
                pool[j, : len(both)] = both
            if pool.shape[1] > 2 * WIDTH:  # the nearest of them
                sim = np.where(pool >= 0, np.einsum("bpd,bd->bp", self.x[pool], self.x[nodes[part]]), -9.0)
                pool = np.take_along_axis(pool, np.argpartition(-sim, 2 * WIDTH - 1, axis=1)[:, : 2 * WIDTH], 1)
            for i, k in zip(nodes[part], prune(self.x, nodes[part], pool)):
                k = k[k >= 0]
                self.adj[i] = i
                self.adj[i, : len(k)], self.size[i] = k, len(k)

    def grow(self, seed: int = 0) -> "Graph":
        order = np.random.default_rng(seed).permutation(self.n)
        order = np.concatenate([[self.medoid], order[order != self.medoid]]).astype(np.int64)
        at = 1
        while at < self.n:
            step = min(self.n - at, at, 4 * QUERIES)
            self.insert(order[at : at + step])
            at += step
        return self

    def lists(self) -> list[np.ndarray]:
        return [self.adj[i, :k] for i, k in enumerate(self.size)]

    def unite(self, lists: list[np.ndarray]) -> "Graph":
        """Takes the given lists."""
        width = max(1, max(map(len, lists), default=1))
        self.adj = np.tile(np.arange(self.n)[:, None], (1, width))
        for i, k in enumerate(lists):
            self.adj[i, : len(k)] = k
        return self

    def within(self, exact: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a, b) of different nodes with a cosine of at least the threshold, as far as the graph shows; both
        directions of each. exact: the vectors in double precision."""
        found = []
        for lo in range(0, self.n, QUERIES):
            own = np.arange(lo, min(lo + QUERIES, self.n))
            q = self.x[own]
            _, seen, (a, b) = self.search(q, threshold - SLACK)
            while len(b):  # the range expands over the neighbours of what is within it
                found.append(own[a] * self.n + b)
                next_a, next_b = [], []
                for k in range(0, len(b), 20_000):
                    more = self.adj[b[k : k + 20_000]]
                    code = np.unique((a[k : k + 20_000, None] * self.n + more).ravel())
                    u, v = code // self.n, code % self.n
                    new = ~seen[u, v]
                    u, v = u[new], v[new]
                    seen[u, v] = True
                    self.compared += len(u)
                    u, v = _near(self.x, q, u, v, threshold - SLACK)
                    next_a.append(u)
                    next_b.append(v)
                a, b = np.concatenate(next_a), np.concatenate(next_b)
        code = np.concatenate(found) if found else np.zeros(0, np.int64)
        a, b = code // self.n, code % self.n
        a, b = a[a != b], b[a != b]
        a, b = _near(exact, exact, a, b, threshold)
        code = np.unique(np.concatenate([a * self.n + b, b * self.n + a]))
        return code // self.n, code % self.n


def _near(x: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of q and x with a product of at least the threshold."""
    hit = np.zeros(len(a), bool)
    for k in range(0, len(a), 100_000):
        hit[k : k + 100_000] = np.einsum("id,id->i", q[a[k : k + 100_000]], x[b[k : k + 100_000]]) >= threshold
    return a[hit], b[hit]


def all_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y within the threshold, block by block."""
    out = [(np.zeros(0, np.int64),) * 2]
    for i in range(0, len(x), 1000):
        for j in range(0, len(y), 4000):
            a, b = np.nonzero(x[i : i + 1000] @ y[j : j + 4000].T >= threshold)
            out.append((a + i, b + j))
    return tuple(np.concatenate(c) for c in zip(*out))


def least_linked(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id of each node's part."""
    best = ids.copy()
    while True:
        now = best.copy()
        np.minimum.at(now, a, best[b])
        if (now == best).all():
            return best
        best = now


def first_common(shards: list[list[int]], a: np.ndarray, b: np.ndarray, here: int) -> np.ndarray:
    """Whether `here` is the first shard that both nodes of each pair are in."""
    width = max(map(len, shards), default=1)
    if width == 1:
        return np.ones(len(a), bool)
    table = np.full((len(shards), width), -1)
    for i, s in enumerate(shards):
        table[i, : len(s)] = sorted(s)
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 50_000):
        x, y = table[a[k : k + 50_000]], table[b[k : k + 50_000]]
        common = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any(2)
        out[k : k + 50_000] = np.where(common, x, np.iinfo(np.int64).max).min(1) == here
    return out


def near_vectors(vectors: DataFrame, stash: Stash, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = 3) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept, recall."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast(kind).alias("vec"))
    sound = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    good = rows.where(sound)
    nodes = stash.put(good.groupBy("label", "vec").agg(F.min("id").alias("node"), F.count("*").alias("times")).withColumn("part", F.concat_ws(":", F.col("label").cast("string"), F.size("vec"))), "nodes")
    truth = _truth(nodes, threshold)
    margin, recall = MARGIN, None
    for k in range(rounds):
        out, several = _linked(nodes, stash, threshold, margin, kind, f"r{k}")
        recall = _recall(out, truth)
        if recall is None or recall >= LEAST_RECALL or not several:
            break
        margin *= 2
    if recall is not None and recall < LEAST_RECALL:
        warnings.warn(f"the audited recall of links is {recall:.4f}", stacklevel=2)
    comp = components(out.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")), stash, "cc")
    per_node = out.groupBy("node").agg(F.sum("links").alias("links")).join(comp.select("node", "root"), "node", "left")
    per_node = nodes.select("node", "label", "vec", "times").join(per_node, "node", "left")
    linked = good.join(per_node, ["label", "vec"]).select("id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def _truth(nodes: DataFrame, threshold: float) -> dict[int, int]:
    """The number of linked vectors of each of a sample of nodes, by comparing it with all nodes."""
    import pyarrow as pa

    n = nodes.count()
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20)) < F.lit(min(1.0, ASKED / max(1, n)) * (1 << 20))).select("part", "node", "vec").limit(2 * ASKED).collect()
    asked: dict[str, tuple[list[int], list]] = {}
    for r in drawn:
        asked.setdefault(r["part"], ([], []))[0].append(r["node"])
        asked[r["part"]][1].append(r["vec"])
    ready = {}
    for p, (i, v) in asked.items():
        v = np.array(v, float)
        v = v / np.abs(v).max(1, keepdims=True)
        ready[p] = np.array(i), v / np.sqrt((v * v).sum(1, keepdims=True))
    shared = nodes.sparkSession.sparkContext.broadcast(ready)

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            part = np.array(t.column("part").to_pylist(), object)
            for p in set(part.tolist()) & set(shared.value):
                at = np.flatnonzero(part == p)
                own = t.take(pa.array(at))
                ids, times = np.asarray(own.column("node")), np.asarray(own.column("times"))
                q, v = shared.value[p]
                a, c = all_pairs(unit_rows(own), v, threshold)
                other = ids[a] != q[c]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.bincount(c[other], times[a[other]], len(q)).astype(np.int64))], ["node", "links"])

    got = nodes.select("part", "node", "times", "vec").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).collect()
    return {r["node"]: r["links"] for r in got}


def _recall(out: DataFrame, truth: dict[int, int]) -> float | None:
    """Found links of the sample over all its links."""
    if not sum(truth.values()):
        return None
    spark = out.sparkSession
    asked = spark.createDataFrame([(n,) for n in truth], "node long")
    return (out.join(F.broadcast(asked), "node").agg(F.sum("links")).first()[0] or 0) / sum(truth.values())


def _linked(nodes: DataFrame, stash: Stash, threshold: float, margin: float, vec_type: str, name: str) -> tuple[DataFrame, bool]:
    """(node, links, least) by shard, and whether there are several shards of one label."""
    import pyarrow as pa

    spark = nodes.sparkSession
    sizes = nodes.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > 2 * TARGET)
    large = sizes.agg(F.sum("n")).first()[0] or 0
    # As many pivots as clusters of TARGET nodes need, PIVOTS at most in all.
    share = 1 / TARGET * min(1.0, PIVOTS / max(1.0, large / TARGET))
    drawn = nodes.join(sizes.select("part"), "part", "left_semi").where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < share * (1 << 20)).select("part", "node", "vec").collect() if large else []
    pivots: dict[str, tuple[list[int], list]] = {}
    for r in sorted(drawn, key=lambda r: (r["part"], r["node"])):
        pivots.setdefault(r["part"], ([], []))[0].append(r["node"])
        pivots[r["part"]][1].append(r["vec"])
    unit = {p: (np.array(i), np.array(v, float) / np.linalg.norm(np.array(v, float), axis=1, keepdims=True)) for p, (i, v) in pivots.items()}
    shared = spark.sparkContext.broadcast(unit)

    def assign(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            part = np.array(t.column("part").to_pylist(), object)
            out: list[list[int]] = [[0]] * len(part)
            for p in set(part.tolist()) & set(shared.value):
                at = np.flatnonzero(part == p)
                s = unit_rows(t.take(pa.array(at))) @ shared.value[p][1].T
                for i, mine in zip(at.tolist(), s >= s.max(1, keepdims=True) - margin):
                    out[i] = (np.flatnonzero(mine) + 1).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(out, pa.list_(pa.int64()))], ["part", "node", "times", "vec", "shards"])

    placed = nodes.select("part", "node", "times", "vec").mapInArrow(assign, f"part string, node long, times long, vec {vec_type}, shards array<long>")
    placed = stash.put(placed.withColumn("shard", F.explode("shards")), f"placed-{name}")
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    small = placed.join(counts.where(F.col("n") <= MOST).drop("n"), ["part", "shard"], "left_semi")

    def lists(t):
        ids = np.asarray(t.column("node"))
        g = Graph(unit_rows(t).astype(np.float32)).grow()
        return pa.table([pa.array(ids), pa.array([ids[x] for x in g.lists()], pa.list_(pa.int64()))], ["node", "near"])

    graph = small.select("part", "shard", "node", "vec").groupBy("part", "shard").applyInArrow(lists, "node long, near array<long>")
    graph = stash.put(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"graph-{name}")

    def links(key, t):
        here, x = key[1].as_py(), unit_rows(t)
        ids = np.asarray(t.column("node"))
        order = np.argsort(ids)
        near = t.column("near").combine_chunks()
        flat, width = np.asarray(near.flatten()), np.diff(np.asarray(near.offsets))
        at = order[np.minimum(np.searchsorted(ids, flat, sorter=order), len(ids) - 1)]
        inside = ids[at] == flat  # a list united from several shards names nodes that are not here
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(ids)), width)[inside], minlength=len(ids)))
        g = Graph(x.astype(np.float32)).unite(np.split(at[inside], ends[:-1]))
        a, b = g.within(x, threshold)
        ask = np.unique(np.linspace(0, len(ids) - 1, min(AUDITED, len(ids))).astype(int))
        qa, qb = all_pairs(x[ask], x, threshold)
        truth = int((ask[qa] != qb).sum())
        if np.isin(a, ask).sum() < LEAST_RECALL * truth:
            a, b = all_pairs(x, x, threshold)
            a, b = a[a != b], b[a != b]
        return counted(a, b, t, ids, here)

    def counted(a, b, t, ids, here):
        times = np.asarray(t.column("times"))
        first = first_common(t.column("shards").to_pylist(), a, b, here)
        n = np.bincount(a[first], times[b[first]], len(ids)).astype(np.int64)
        return pa.table([pa.array(ids), pa.array(n), pa.array(least_linked(ids, a, b))], ["node", "links", "least"])

    schema = "node long, links long, least long"
    out = small.join(graph, "node").select("part", "shard", "node", "times", "vec", "shards", "near").groupBy("part", "shard").applyInArrow(links, schema)
    over = counts.where(F.col("n") > MOST)
    if not over.isEmpty():
        out = out.unionByName(_by_blocks(placed.join(over, ["part", "shard"]), counted, threshold, schema))
    return stash.put(out, f"links-{name}"), bool(pivots)


def _by_blocks(rows: DataFrame, counted, threshold: float, schema: str) -> DataFrame:
    """Shards that are too large for a task: every pair of blocks of about MOST / 8 nodes is compared in full."""
    blocks = F.ceil(F.col("n") / max(1, MOST // 8)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def pair(key, t):
        x, block = unit_rows(t), np.asarray(t.column("block"))
        a, b = all_pairs(x, x, threshold)
        ok = (block[a] != block[b]) if key[2].as_py() != key[3].as_py() else a != b
        return counted(a[ok], b[ok], t, np.asarray(t.column("node")), key[1].as_py())

    return rows.select("part", "shard", "lo", "hi", "node", "times", "vec", "shards", "block").groupBy("part", "shard", "lo", "hi").applyInArrow(pair, schema)
