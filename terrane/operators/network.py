"""Road networks: tables of nodes (node_id, x, y) and edges (edge_id, source, target, length, travel_time, oneway).

Building, degrees, checks and coverage are joins and aggregations. Searches run over a compact adjacency that is broadcast
only while it is counted to be within MOST_ARCS; beyond it distances spread by rounds of joins."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import haversine
from . import bands as B
from .vector import connected, ready_for_checkpoints

#: Arcs of a network that may be broadcast.
MOST_ARCS = 5_000_000

#: Pairs of a source and a node that a task of the centralities holds at once, and the cost that all arcs are over for that.
STATES = 6_000_000
LEAST_COST = 1e-6

#: Bands of a network that goes by them, at least, and bands of a task.
LEAST_BANDS = 5
BANDS_AT_ONCE = 2


def build(lines: DataFrame, speed: float = 40.0, geographic: bool = False, unit_scale: float = 1.0, snap: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Lines (fid, vertices, optional speed and oneway in -1, 0, 1). Each straight piece is an edge, pieces without
    length go, of repeated edges the fastest stays. Node numbers follow first appearance. Positions are one node if they
    agree at nine decimals, or, with snap, if they lie within it of an earlier node."""
    if snap > 0:
        lines = snapped(lines, snap)
    has = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in lines.columns else F.lit(d)
    n = F.size("vertices")
    piece = lines.select("fid", has("speed", speed).alias("speed"), has("oneway", 0.0).cast("int").alias("way"), F.posexplode(F.arrays_zip(F.slice("vertices", 1, n - 1).alias("a"), F.slice("vertices", 2, n - 1).alias("b"))).alias("i", "p"))
    key = lambda v: F.struct(F.round(v["x"] * 1e9).cast("long").alias("x"), F.round(v["y"] * 1e9).cast("long").alias("y"))
    piece = piece.withColumns({"a": F.when(F.col("way") < 0, F.col("p.b")).otherwise(F.col("p.a")), "b": F.when(F.col("way") < 0, F.col("p.a")).otherwise(F.col("p.b"))}).withColumns({"ka": key(F.col("a")), "kb": key(F.col("b"))}).where("ka <> kb")
    seen = piece.select("ka", "a", F.struct("fid", "i", F.lit(0).alias("e")).alias("at")).unionByName(piece.select(F.col("kb").alias("ka"), F.col("b").alias("a"), F.struct("fid", "i", F.lit(1).alias("e")).alias("at")))
    first = seen.groupBy("ka").agg(F.min("at").alias("at"), F.min_by("a", "at").alias("v"))
    nodes = numbered(first, "at", "node_id").select("node_id", F.col("v.x").alias("x"), F.col("v.y").alias("y"), "ka")
    length = haversine(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) if geographic else F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2)) * unit_scale
    ids = nodes.select("ka", "node_id")
    e = piece.withColumn("length", length).join(ids.withColumnRenamed("node_id", "source"), "ka").join(ids.select(F.col("ka").alias("kb"), F.col("node_id").alias("target")), "kb")
    one = (F.col("way") != 0).cast("int")
    e = e.select("fid", "i", "source", "target", "length", "speed", one.alias("oneway"), (F.col("length") / 1000 / F.col("speed") * 60).alias("travel_time"))
    same = [F.when(F.col("oneway") == 1, F.col("source")).otherwise(F.least("source", "target")).alias("u"), F.when(F.col("oneway") == 1, F.col("target")).otherwise(F.greatest("source", "target")).alias("w"), "oneway"]
    best = e.groupBy(*same).agg(F.min_by(F.struct("fid", "i", "source", "target", "length", "travel_time", "speed"), F.struct("travel_time", "fid", "i")).alias("e"))
    edges = numbered(best.select("e.*", "oneway").withColumn("at", F.struct("fid", "i")), "at", "edge_id").select("edge_id", "source", "target", "length", "travel_time", "speed", "oneway")
    return nodes.drop("ka"), edges


def snapped(lines: DataFrame, tolerance: float) -> DataFrame:
    """Lines whose vertices are moved to the first node within the tolerance, in order of appearance. Which node is first
    depends on all before it, so the distinct positions (MOST_ARCS at most) are gone through in one task."""
    import pyarrow as pa

    v = lines.select("fid", F.posexplode("vertices").alias("i", "p"))
    first = v.groupBy("p").agg(F.min(F.struct("fid", "i")).alias("at"))
    if first.limit(MOST_ARCS + 1).count() > MOST_ARCS:
        raise ValueError("too many positions to snap in one task")

    def move(key, t):
        t = t.sort_by([("f", "ascending"), ("i", "ascending")])
        x, y = (np.asarray(t.column(c)) for c in ("x", "y"))
        cells: dict = {}
        nx, ny = np.empty(len(x)), np.empty(len(x))
        for k in range(len(x)):
            cx, cy = int(np.floor(x[k] / tolerance)), int(np.floor(y[k] / tolerance))
            near = [j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((cx + a, cy + b), ()) if np.hypot(x[j] - x[k], y[j] - y[k]) <= tolerance]
            j = min(near) if near else k
            if not near:
                cells.setdefault((cx, cy), []).append(k)
            nx[k], ny[k] = x[j], y[j]
        return pa.table([t.column("x"), t.column("y"), pa.array(nx), pa.array(ny)], ["x", "y", "nx", "ny"])

    flat = first.select(F.lit(0).alias("all"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("at.fid").cast("long").alias("f"), F.col("at.i").alias("i"))
    to = flat.groupBy("all").applyInArrow(move, "x double, y double, nx double, ny double")
    moved = v.join(to, (F.col("p.x") == to["x"]) & (F.col("p.y") == to["y"])).groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("i", F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias("q")))).alias("s"))
    return lines.drop("vertices").join(moved.select("fid", F.transform("s", lambda e: e["q"]).alias("vertices")), "fid").select(*lines.columns)


def name_nodes(nodes: DataFrame, names: DataFrame, tolerance: float) -> DataFrame:
    """Names (fid, name, x, y) go to the nearest node within the tolerance; of several the first stays."""
    from ..functions import geometry as G
    from .vector import nearest

    place = lambda df, k: df.select(F.col(k).alias("fid"), G.point(F.col("x"), F.col("y")).alias("geom"))
    hit = nearest(place(names, "fid"), place(nodes, "node_id")).where(F.col("m.d") <= tolerance)
    won = hit.join(names, hit["s"] == names["fid"]).groupBy(F.col("m.t").alias("node_id")).agg(F.min_by("name", "fid").alias("name"))
    return nodes.drop("name").join(won, "node_id", "left")


def numbered(df: DataFrame, order: str, name: str, parts: int = 256) -> DataFrame:
    """Numbers from 0 in an order, by a range partitioning: rows are counted per part, and ranked inside."""
    p = df.repartitionByRange(parts, order).withColumn("__p", F.spark_partition_id()).persist()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    start = p.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__p", "__b")  # at most `parts` rows
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return p.withColumn("__r", rank).join(F.broadcast(start), "__p").withColumn(name, F.col("__b") + F.col("__r")).drop("__p", "__r", "__b")


def arcs(edges: DataFrame, cost: str = "length") -> DataFrame:
    """Directed arcs (u, v, w, edge_id); two-way edges give two."""
    a = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col(cost).alias("w"), "edge_id")
    return a.unionByName(edges.where("oneway = 0").select(F.col("target").alias("u"), F.col("source").alias("v"), F.col(cost).alias("w"), "edge_id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree and degree / (n - 1)."""
    ends = edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id")))
    n = nodes.count()
    d = F.coalesce("degree", F.lit(0))
    return nodes.join(ends.groupBy("node_id").agg(F.count("*").alias("degree")), "node_id", "left").select("node_id", d.alias("degree"), (d / max(1, n - 1)).alias("degree_centrality"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and lengths."""
    box = nodes.agg(F.count("*").alias("nodes"), F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    e = edges.agg(F.count("*").alias("edges"), F.sum("length").alias("length_sum"), F.min("length").alias("length_min"), F.avg("length").alias("length_mean"), F.max("length").alias("length_max"), F.count_if(F.col("oneway") == 1).alias("oneway"))
    return box.crossJoin(e)


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by degree, 5 and more together."""
    return degrees(nodes, edges).groupBy(F.least("degree", F.lit(5)).alias("degree")).agg(F.count("*").alias("nodes"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """N08 weak components: (node_id, component) numbered by size, then by first node."""
    c = connected(nodes.select(F.col("node_id").alias("fid")), edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return _numbered_by_size(c.select(F.col("fid").alias("node_id"), "root"))


def _numbered_by_size(c: DataFrame) -> DataFrame:
    """(node_id, component, size) from (node_id, root): the largest first, then by first node."""
    size = c.groupBy("root").agg(F.count("*").alias("size"), F.min("node_id").alias("first"))
    rank = numbered(size.withColumn("at", F.struct((-F.col("size")).alias("n"), "first")), "at", "component")
    return c.join(rank.select("root", "component", "size"), "root").select("node_id", F.col("component").cast("int").alias("component"), "size")


def _strong(t):
    """(node_id, root) of the strong components of arcs (u, v); v is null for a node as such."""
    import pyarrow as pa

    u, v = t.column("u").to_pylist(), t.column("v").to_pylist()
    out: dict = {}
    for a, b in zip(u, v):
        out.setdefault(a, [])
        if b is not None:
            out[a].append(b)
    number: dict = {}
    low: dict = {}
    open_: list = []
    held: set = set()
    root: dict = {}
    for first in sorted(out):
        if first in number:
            continue
        walk = [(first, iter(out[first]))]
        number[first] = low[first] = len(number)
        open_.append(first)
        held.add(first)
        while walk:
            a, rest = walk[-1]
            for b in rest:
                if b not in out:  # an arc to a node that is not listed
                    continue
                if b not in number:
                    number[b] = low[b] = len(number)
                    open_.append(b)
                    held.add(b)
                    walk.append((b, iter(out[b])))
                    break
                if b in held:
                    low[a] = min(low[a], number[b])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[a])
                if low[a] == number[a]:
                    member = []
                    while not member or member[-1] != a:
                        member.append(open_.pop())
                        held.discard(member[-1])
                    root.update(dict.fromkeys(member, min(member)))
    return pa.table([pa.array(list(root), pa.int64()), pa.array(list(root.values()), pa.int64())], ["node_id", "root"])


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """N08 strong components: (node_id, component, size), numbered by size, then by first node. A network of at most
    MOST_ARCS arcs is gone through in one task, depth first; a larger one by rounds of colouring on tables: nodes that no arc of what is left enters or leaves are components of their own; of the others each takes the
    least node that reaches it as its colour, and what the colour's own node reaches backwards inside the colour is one
    component. All other nodes go on."""
    ready_for_checkpoints(nodes.sparkSession)
    left = nodes.select(F.col("node_id").alias("v")).checkpoint()
    a = arcs(edges).select("u", "v").distinct().where("u <> v").checkpoint()
    if a.limit(MOST_ARCS + 1).count() <= MOST_ARCS and left.limit(MOST_ARCS + 1).count() <= MOST_ARCS:
        both = a.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
        return _numbered_by_size(both.select(F.lit(0).alias("all"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).groupBy("all").applyInArrow(_strong, "node_id long, root long"))
    found = None

    def spread(value: DataFrame, along: DataFrame) -> DataFrame:
        """Least values along arcs (u, v) until nothing falls. value: (k, x)."""
        while True:
            low = along.join(value, along["u"] == value["k"]).groupBy(F.col("v").alias("j")).agg(F.min("x").alias("y"))
            now = value.join(low, value["k"] == low["j"], "left").select("k", F.least("x", F.coalesce("y", "x")).alias("x"), (F.col("y") < F.col("x")).alias("fell")).checkpoint()
            value = now.select("k", "x")
            if now.where("fell").isEmpty():
                return value

    def add(part: DataFrame) -> None:
        nonlocal found, left, a
        found = part if found is None else found.unionByName(part)
        left = left.join(part.select(F.col("node_id").alias("v")), "v", "left_anti").checkpoint()
        inside = lambda df, c: df.join(left.select(F.col("v").alias("k")), F.col(c) == F.col("k"), "left_semi")
        a = inside(inside(a, "u"), "v").checkpoint()

    while not left.isEmpty():
        ends = a.select(F.col("u").alias("v")).distinct().join(a.select("v").distinct(), "v", "left_semi")
        alone = left.join(ends, "v", "left_anti").select(F.col("v").alias("node_id"), F.col("v").alias("root")).checkpoint()
        if not alone.isEmpty():
            add(alone)
            continue
        colour = spread(left.select(F.col("v").alias("k"), F.col("v").alias("x")), a)
        of = lambda c, n: colour.select(F.col("k").alias(c), F.col("x").alias(n))
        same = a.join(of("u", "xu"), "u").join(of("v", "xv"), "v").where("xu = xv").select(F.col("v").alias("u"), F.col("u").alias("v")).checkpoint()
        back = spread(colour.select("k", F.when(F.col("k") == F.col("x"), 0).otherwise(1).alias("x")), same)
        add(back.where("x = 0").join(of("k", "root"), "k").select(F.col("k").alias("node_id"), "root").checkpoint())
    if found is None:
        found = nodes.select("node_id", F.col("node_id").alias("root"))
    return _numbered_by_size(found)


def find_node(nodes: DataFrame, text: str) -> DataFrame:
    """By number, else by exact name, else by a part of the name; the first kind that finds any."""
    n = nodes.withColumn("kind", F.when(F.col("node_id").cast("string") == text, 0).when(F.col("name") == text, 1).when(F.lower("name").contains(text.lower()), 2)).where("kind is not null")
    least = n.agg(F.min("kind").alias("least"))
    return n.join(F.broadcast(least), F.col("kind") == F.col("least")).select(*nodes.columns)


class Graph:
    """Adjacency of a network that fits in memory."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, e: np.ndarray, node_ids: np.ndarray):
        self.ids = np.unique(node_ids)
        u, v = self.place(u), self.place(v)
        order = np.lexsort((e, w, v, u))
        self.v, self.w, self.e = v[order], w[order], e[order]
        self.ptr = np.searchsorted(u[order], np.arange(len(self.ids) + 1))

    @classmethod
    def of(cls, t) -> "Graph":
        """From an Arrow table of arcs (u, v, w, e); a row without v names a node."""
        import pyarrow.compute as pc

        alone = t.column("v").is_null()
        column = lambda x, c, kind: x.column(c).to_numpy().astype(kind, copy=False)
        a = t.filter(pc.invert(alone))
        return cls(column(a, "u", np.int64), column(a, "v", np.int64), column(a, "w", float), column(a, "e", np.int64), column(t.filter(alone), "u", np.int64))

    def place(self, nodes: Sequence[int]) -> np.ndarray:
        """Where nodes stand among the sorted ids."""
        nodes = np.asarray(nodes, np.int64)
        at = np.searchsorted(self.ids, nodes)
        lost = (at >= len(self.ids)) | (self.ids[np.minimum(at, len(self.ids) - 1)] != nodes) if len(self.ids) else np.ones(len(nodes), bool)
        if lost.any():
            raise KeyError(int(nodes[lost][0]))
        return at

    def search(self, source: int, targets: Sequence[int] = (), limit: float = float("inf")):
        """Distances, previous nodes and previous edges; stops when all targets are settled."""
        n = len(self.ids)
        dist, prev, edge = np.full(n, np.inf), np.full(n, -1), np.full(n, -1)
        dist[source] = 0.0
        heap, left, done = [(0.0, source)], set(targets), np.zeros(n, bool)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            if d > limit:
                break
            done[u] = True
            if left:
                left.discard(u)
                if not left:
                    break
            for k in range(self.ptr[u], self.ptr[u + 1]):
                v, nd = self.v[k], d + self.w[k]
                if nd < dist[v]:
                    dist[v], prev[v], edge[v] = nd, u, self.e[k]
                    heapq.heappush(heap, (nd, int(v)))
        return dist, prev, edge


def whole(nodes: DataFrame, edges: DataFrame, cost: str = "length") -> DataFrame:
    """What Graph.of reads: arcs (u, v, w, e), and nodes as u alone."""
    a = arcs(edges, cost).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"), F.col("edge_id").cast("long").alias("e"))
    if a.count() > MOST_ARCS:
        raise ValueError("the network is too large for one search; use distances()")
    return a.unionByName(nodes.select(F.col("node_id").cast("long").alias("u"), *[F.lit(None).cast(k).alias(c) for c, k in (("v", "long"), ("w", "double"), ("e", "long"))]))


def graph(nodes: DataFrame, edges: DataFrame, cost: str = "length") -> Graph:
    """On the driver, for a broadcast."""
    return Graph.of(whole(nodes, edges, cost).toArrow())


def distances(nodes: DataFrame, edges: DataFrame, source: int, cost: str = "length", limit: float | None = None, rounds: int = 10_000) -> DataFrame:
    """Least costs from one node for networks of any size: rounds of joins from the nodes that just improved."""
    spark = nodes.sparkSession
    ready_for_checkpoints(spark)
    a = arcs(edges, cost).persist()
    known = nodes.where(F.col("node_id") == source).select("node_id", F.lit(0.0).alias("d"))
    front = known
    for _ in range(rounds):
        step = front.join(a, front["node_id"] == a["u"]).groupBy(F.col("v").alias("node_id")).agg(F.min(F.col("d") + F.col("w")).alias("nd"))
        if limit is not None:
            step = step.where(F.col("nd") <= limit)
        front = step.join(known, "node_id", "left").where("d is null or nd < d").select("node_id", F.col("nd").alias("d")).checkpoint()
        if front.isEmpty():
            return known
        known = known.unionByName(front).groupBy("node_id").agg(F.min("d").alias("d")).checkpoint()
    raise RuntimeError(f"distances are not settled after {rounds} rounds")


def shortest_path(nodes: DataFrame, edges: DataFrame, source: int, target: int, cost: str = "length", limit: float = float("inf")) -> DataFrame:
    """The path's edges in order with the running cost; empty if there is none of at most the limit's cost. One task holds the graph, as arrays;
    nothing but the path leaves it."""
    import pyarrow as pa

    def run(t):
        g = Graph.of(t)
        s, at = g.place([source, target]).tolist()
        dist, prev, edge = g.search(s, [at], limit)
        steps, v = [], at
        while np.isfinite(dist[at]) and dist[at] <= limit and v != s:
            steps.append((int(g.ids[prev[v]]), int(g.ids[v]), int(edge[v]), float(dist[v])))
            v = prev[v]
        rows = [dict(zip(("seq", "from_node", "to_node", "edge_id", "total_cost"), (i, *r))) for i, r in enumerate(reversed(steps))]
        return pa.Table.from_pylist(rows, pa.schema([("seq", pa.int32()), ("from_node", pa.int64()), ("to_node", pa.int64()), ("edge_id", pa.int64()), ("total_cost", pa.float64())]))

    return whole(nodes, edges, cost).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "seq int, from_node long, to_node long, edge_id long, total_cost double")


def _dependencies(g: Graph, s: int):
    """Of one source: distances, and what each node adds to the betweenness, with a heap."""
    n = len(g.ids)
    dist, sigma, before = np.full(n, np.inf), np.zeros(n), [[] for _ in range(n)]
    dist[s], sigma[s] = 0.0, 1.0
    heap, order, done = [(0.0, s)], [], np.zeros(n, bool)
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        order.append(u)
        for k in range(g.ptr[u], g.ptr[u + 1]):
            v, nd = int(g.v[k]), d + g.w[k]
            if nd < dist[v] - 1e-12:
                dist[v], sigma[v], before[v] = nd, sigma[u], [u]
                heapq.heappush(heap, (nd, v))
            elif abs(nd - dist[v]) <= 1e-12 and not done[v]:
                sigma[v] += sigma[u]
                before[v].append(u)
    part = np.zeros(n)
    for v in reversed(order):
        for u in before[v]:
            part[u] += sigma[u] / sigma[v] * (1 + part[v])
    part[s] = 0.0
    return dist, part


def _dependencies_of_many(g: Graph, sources: np.ndarray, back: tuple):
    """The same of many sources at once, as rows, where all arcs cost more than LEAST_COST. A state is a source and a node.
    Buckets are half as wide as the least cost, so the states of one settle together, and no tie is within one. back: arcs by
    their heads (ptr, tails, costs)."""
    n, m = len(g.ids), len(sources)
    width = float(g.w.min()) / 2 if len(g.w) else 1.0
    dist, sigma, done, mark = np.full(m * n, np.inf), np.zeros(m * n), np.zeros(m * n, bool), np.zeros(m * n, np.int32)
    start = np.arange(m) * n + sources
    dist[start], sigma[start] = 0.0, 1.0

    def around(states, ptr, ends, costs):
        """Arcs of the nodes of states: (which state, the state at the other end, cost)."""
        u = states % n
        first, count = ptr[u], ptr[u + 1] - ptr[u]
        i = np.repeat(np.arange(len(u)), count)
        k = np.arange(len(i)) + (first - np.cumsum(count) + count)[i]
        return i, (states - u)[i] + ends[k], costs[k]

    buckets: dict[int, list] = {0: [start]}
    heap, settled = [0], []
    while heap:
        at = heapq.heappop(heap)
        x = np.concatenate(buckets.pop(at))
        x = x[~done[x]]
        mark[x] = np.arange(len(x))
        x = x[mark[x] == np.arange(len(x))]
        if not len(x):
            continue
        done[x] = True
        settled.append(x)
        i, u, w = around(x, *back)
        tight = np.abs(dist[u] + w - dist[x][i]) <= 1e-12
        sigma[x] += np.bincount(i[tight], sigma[u[tight]], len(x))
        i, v, w = around(x, g.ptr, g.v, g.w)
        nd = dist[x][i] + w
        less = nd < dist[v] - 1e-12
        v, nd = v[less], nd[less]
        np.minimum.at(dist, v, nd)
        v = v[nd == dist[v]]
        to = np.floor(dist[v] / width).astype(np.int64)
        order = np.argsort(to, kind="stable")
        v, to = v[order], to[order]
        cuts = [*np.flatnonzero(np.diff(to, prepend=-1)).tolist(), len(v)]
        for k, i0, i1 in zip(to[cuts[:-1]].tolist(), cuts, cuts[1:]):
            if k not in buckets:
                buckets[k] = []
                heapq.heappush(heap, k)
            buckets[k].append(v[i0:i1])
    part = np.zeros(m * n)
    for x in reversed(settled):
        i, v, w = around(x, g.ptr, g.v, g.w)
        tight = np.abs(dist[x][i] + w - dist[v]) <= 1e-12
        i, v = i[tight], v[tight]
        part[x] = sigma[x] * np.bincount(i, (1 + part[v]) / sigma[v], len(x))
    part[start] = 0.0
    return dist.reshape(m, n), part.reshape(m, n)


def _by_bands(spark, bands: B.Bands, ids: np.ndarray) -> DataFrame:
    """What sources add to nodes (node_id, b, c), by tasks of a few bands; first what searches need around each band's edge."""
    shared = spark.sparkContext.broadcast(bands)

    def around(batches):
        import pyarrow as pa

        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            on = shared.value.between(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), k), pa.int64()), pa.array(on, pa.int64())], ["band", "node"])

    per = lambda k: spark.range(0, len(bands), 1, -(-len(bands) // k))
    on = per(BANDS_AT_ONCE).mapInArrow(around, "band long, node long").toArrow()
    bands.learn(on.column("band").to_numpy(), on.column("node").to_numpy())
    shared = spark.sparkContext.broadcast(bands)

    def run(batches):
        import pyarrow as pa

        sums = B.Sums(shared.value)
        sums.add([k for batch in batches for k in batch.column(0).to_pylist()])
        sums.end()
        at = np.flatnonzero((sums.score != 0) | sums.own)
        yield pa.RecordBatch.from_arrays([pa.array(ids[shared.value.order[at]], pa.int64()), pa.array(sums.score[at], pa.float64()), pa.array(sums.close[at], pa.float64())], ["node_id", "b", "c"])

    return per(BANDS_AT_ONCE).mapInArrow(run, "node_id long, b double, c double")


def centrality(nodes: DataFrame, edges: DataFrame, cost: str = "length") -> DataFrame:
    """Betweenness (Brandes, weighted, over ordered pairs) and closeness (scaled by the reachable share). Sources are
    dealt to tasks, and the sums of tasks meet in one aggregation. A network that can be cut into bands goes by them; in
    others each source is searched from by itself, as many at once as make STATES states."""
    g = graph(nodes, edges, cost)
    n = len(g.ids)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    tails = np.repeat(np.arange(n), np.diff(g.ptr))
    if B.suits(tails, g.v, g.w) and len(bands := B.Bands(tails, g.v, g.w, n)) >= LEAST_BANDS:
        return _by_bands(nodes.sparkSession, bands, g.ids).groupBy("node_id").agg((F.sum("b") * scale).alias("betweenness"), F.sum("c").alias("closeness"))
    shared = nodes.sparkSession.sparkContext.broadcast(g)
    at_once, least = max(1, STATES // max(1, n)), LEAST_COST

    def run(batches):
        import pyarrow as pa

        g, score, close = shared.value, np.zeros(n), []
        tails = np.repeat(np.arange(n), np.diff(g.ptr))
        order = np.argsort(g.v, kind="stable")
        back = np.searchsorted(g.v[order], np.arange(n + 1)), tails[order], g.w[order]
        many = bool(np.all((g.w > least) & np.isfinite(g.w)))
        ids = [node for b in batches for node in b.column(0).to_pylist()]
        for k in range(0, len(ids), at_once):
            sources = g.place(ids[k : k + at_once])
            for dist, part in [_dependencies_of_many(g, sources, back)] if many else (map(np.atleast_2d, _dependencies(g, int(s))) for s in sources):
                score += part.sum(axis=0)
                there = np.isfinite(dist)
                for total, reached in zip(np.where(there, dist, 0.0).sum(axis=1).tolist(), there.sum(axis=1).tolist()):
                    close.append((reached - 1) / (n - 1) * (reached - 1) / total if total > 0 and n > 1 else 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([*g.ids.tolist(), *ids], pa.int64()), pa.array([*score.tolist(), *[0.0] * len(close)], pa.float64()), pa.array([*[0.0] * n, *close], pa.float64())], ["node_id", "b", "c"])

    sums = nodes.select("node_id").repartition(min(64, max(1, n // 50))).mapInArrow(run, "node_id long, b double, c double")
    return sums.groupBy("node_id").agg((F.sum("b") * scale).alias("betweenness"), F.sum("c").alias("closeness"))


def service_area(edges: DataFrame, reached: DataFrame, limit: float, cost: str = "length") -> DataFrame:
    """Covered parts of edges, given distances (node_id, d): (edge_id, share_from, share_to, cost_min, cost_max,
    partial). Each end covers (limit - d) / w of an edge; a two-way edge may be covered from both."""
    d = reached.select("node_id", "d").where(F.col("d") <= limit)
    e = edges.join(d.select(F.col("node_id").alias("source"), F.col("d").alias("ds")), "source", "left").join(d.select(F.col("node_id").alias("target"), F.col("d").alias("dt")), "target", "left")
    w = F.col(cost)
    reach = lambda at, ok: F.when(ok & F.col(at).isNotNull(), F.least(F.lit(1.0), F.when(w > 0, (limit - F.col(at)) / F.nullif(w, F.lit(0.0))).otherwise(1.0))).otherwise(0.0)
    e = e.withColumns({"a": reach("ds", F.lit(True)), "b": reach("dt", F.col("oneway") == 0)}).where((F.col("a") > 0) | (F.col("b") > 0))
    full = F.col("a") + F.col("b") >= 1 - 1e-12
    near = lambda x, y: F.least(F.coalesce(x, F.lit(float("inf"))), F.coalesce(y, F.lit(float("inf"))))
    back = F.when(F.col("oneway") == 0, F.col("dt"))
    top = F.least(F.lit(float(limit)), F.when(F.col("ds").isNotNull() & back.isNotNull(), (F.col("ds") + back + w) / 2).otherwise(near(F.col("ds"), back) + w))
    whole = F.array(F.struct(F.lit(0.0).alias("share_from"), F.lit(1.0).alias("share_to"), near(F.col("ds"), back).alias("cost_min"), top.alias("cost_max"), F.lit(0).alias("partial")))
    part = F.filter(F.array(
        F.when(F.col("a") > 0, F.struct(F.lit(0.0).alias("share_from"), F.col("a").alias("share_to"), F.col("ds").alias("cost_min"), (F.col("ds") + F.col("a") * w).alias("cost_max"), F.lit(1).alias("partial"))),
        F.when(F.col("b") > 0, F.struct((1 - F.col("b")).alias("share_from"), F.lit(1.0).alias("share_to"), F.col("dt").alias("cost_min"), (F.col("dt") + F.col("b") * w).alias("cost_max"), F.lit(1).alias("partial"))),
    ), lambda x: x.isNotNull())
    return e.select("edge_id", "source", "target", F.explode(F.when(full, whole).otherwise(part)).alias("p")).select("edge_id", "source", "target", "p.*")


def isochrones(nodes: DataFrame, edges: DataFrame, reached: DataFrame, limits: Sequence[float], buffer: float | None = None, cost: str = "length") -> DataFrame:
    """(interval, cost_limit, reached_nodes, reached_edges, region, rings): the covered parts of edges, widened by a
    buffer (a sixtieth of the extent's diagonal unless given) on a grid of a third of it, traced with their holes."""
    from ..functions import geometry as G
    from .raster import Header, Raster
    from .surfaces import regions

    b = nodes.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    buffer = buffer or max(np.hypot(b["x1"] - b["x0"], b["y1"] - b["y0"]) / 60, 1e-9)
    cell = buffer / 3
    while (b["x1"] - b["x0"] + 4 * buffer) * (b["y1"] - b["y0"] + 4 * buffer) / cell**2 > 4e6:
        cell *= 1.25
    x0, y0 = b["x0"] - 2 * buffer, b["y0"] - 2 * buffer
    h = Header(int(np.ceil((b["x1"] + 2 * buffer - x0) / cell)), int(np.ceil((b["y1"] + 2 * buffer - y0) / cell)), x0, y0, cell)
    at = lambda k, s: nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    out = None
    for i, limit in enumerate(sorted(limits)):
        part = service_area(edges, reached, limit, cost).join(at("source", "s"), "source").join(at("target", "t"), "target")
        mix = lambda c, t: F.col(f"s{c}") + F.col(t) * (F.col(f"t{c}") - F.col(f"s{c}"))
        seg = part.select(G.vertex(mix("x", "share_from"), mix("y", "share_from")).alias("p"), G.vertex(mix("x", "share_to"), mix("y", "share_to")).alias("q"))
        col, row = (lambda x: F.floor((x - h.xll) / cell)), (lambda y: F.floor((F.lit(h.ymax) - y) / cell))
        cells = seg.withColumn("r", F.explode(F.sequence(row(F.greatest("p.y", "q.y") + buffer).cast("int"), row(F.least("p.y", "q.y") - buffer).cast("int")))).withColumn("c", F.explode(F.sequence(col(F.least("p.x", "q.x") - buffer).cast("int"), col(F.greatest("p.x", "q.x") + buffer).cast("int"))))
        hit = cells.where(G.segment_distance(h.x(F.col("c")), h.y(F.col("r")), F.col("p"), F.col("q")) <= buffer).select("r", "c").distinct().withColumn("v", F.lit(1.0))
        counts = [F.lit(reached.where(F.col("d") <= limit).count()).alias("reached_nodes"), F.lit(part.select("edge_id").distinct().count()).alias("reached_edges")]
        rings = regions(Raster(h, hit)).select(F.lit(i + 1).alias("interval"), F.lit(float(limit)).alias("cost_limit"), *counts, "region", "rings")
        out = rings if out is None else out.unionByName(rings)
    return out


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(severity, issue, element, id)."""
    row = lambda df, severity, issue, element, id_: df.select(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), F.lit(element).alias("element"), F.col(id_).cast("string").alias("id"))
    deg = degrees(nodes, edges)
    place = Window.partitionBy(F.round(F.col("x") * 1e8), F.round(F.col("y") * 1e8)).orderBy("node_id")
    ends = lambda c: F.when(F.col("oneway") == 1, F.col(c))
    u = F.coalesce(ends("source"), F.least("source", "target"))
    v = F.coalesce(ends("target"), F.greatest("source", "target"))
    twice = edges.where("source <> target").withColumn("k", F.row_number().over(Window.partitionBy(u, v, "oneway").orderBy("edge_id"))).where("k > 1")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) < 0)
    parts = components(nodes, edges).groupBy("component").agg(F.max("size").alias("size")).where("component > 0 and size > 1")
    known = nodes.select(F.col("node_id").alias("n"))
    lost = edges.join(known, edges["source"] == known["n"], "left_anti").unionByName(edges.join(known, edges["target"] == known["n"], "left_anti")).dropDuplicates(["edge_id"])
    out = [
        row(deg.where("degree = 0"), "warning", "ISOLATED_NODE", "node", "node_id"), row(nodes.withColumn("k", F.row_number().over(place)).where("k > 1"), "warning", "COINCIDENT_NODES", "node", "node_id"),
        row(edges.where(bad("length")), "error", "BAD_COST", "edge", "edge_id"), row(edges.where(bad("travel_time")), "error", "BAD_COST", "edge", "edge_id"),
        row(edges.where("length = 0"), "warning", "ZERO_LENGTH_EDGE", "edge", "edge_id"), row(edges.where("source = target"), "warning", "SELF_LOOP", "edge", "edge_id"),
        row(twice, "warning", "DUPLICATE_EDGE", "edge", "edge_id"), row(parts.withColumn("number", F.col("component") + 1), "warning", "DISCONNECTED_COMPONENT", "component", "number"), row(lost, "error", "UNKNOWN_NODE", "edge", "edge_id"),
    ]
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def strong_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (severity, issue, element, id) if there are several strong components, id their number."""
    n = strong_components(nodes, edges).agg((F.max("component") + 1).alias("n")).where("n > 1")
    return n.select(F.lit("warning").alias("severity"), F.lit("NOT_STRONGLY_CONNECTED").alias("issue"), F.lit("network").alias("element"), F.col("n").cast("string").alias("id"))


def limited(issues: DataFrame, most: int = 10) -> DataFrame:
    """A report's first rows of each kind of issue, by element and id, with the number of all as `total`."""
    w = Window.partitionBy("issue")
    first = F.row_number().over(w.orderBy("element", F.length("id"), "id"))
    return issues.withColumns({"__k": first, "total": F.count("*").over(w)}).where(F.col("__k") <= most).drop("__k")


#: Searches that one copy of a graph serves in a task.
SEARCHES = 64


def cost_matrix(nodes: DataFrame, edges: DataFrame, stops: Sequence[int], cost: str = "length") -> np.ndarray:
    """Costs between stops, one search a stop. Tasks hold the graph, as arrays, and search for SEARCHES stops each;
    the matrix alone comes to the driver."""
    import pyarrow as pa

    stops = [int(s) for s in stops]
    n = len(stops)

    def run(key, t):
        g, first = Graph.of(t), key[0].as_py() * SEARCHES
        at = g.place(stops)
        found = [(i, g.search(int(at[i]), at.tolist())[0][at]) for i in range(first, min(n, first + SEARCHES))]
        return pa.table([pa.array(np.repeat([i for i, _ in found], n), pa.int64()), pa.array(np.tile(np.arange(n), len(found)), pa.int64()), pa.array(np.concatenate([d for _, d in found]))], ["i", "j", "d"])

    parts = F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1) // SEARCHES)))
    out = np.full((n, n), np.inf)
    if n:
        for r in whole(nodes, edges, cost).withColumn("part", parts).groupBy("part").applyInArrow(run, "i long, j long, d double").collect():
            out[r["i"], r["j"]] = r["d"]
    return out


def tour_exact(cost: np.ndarray, closed: bool = True, end: int | None = None) -> tuple[list[int], float]:
    """The least tour from stop 0 through all, by dynamic programming over subsets (18 stops at most)."""
    n = len(cost)
    if n > 18:
        raise ValueError("18 stops at most")
    best = {(1, 0): (0.0, -1)}
    for size in range(1, n):
        for chosen in itertools.combinations(range(1, n), size):
            mask = 1 | sum(1 << i for i in chosen)
            for j in chosen:
                rest = mask ^ (1 << j)
                options = [(best[rest, k][0] + cost[k, j], k) for k in range(n) if rest >> k & 1 and (rest, k) in best]
                if options:
                    best[mask, j] = min(options)
    full = (1 << n) - 1
    ends = [end] if end is not None and not closed else range(n)
    total, last = min((best[full, j][0] + (cost[j, 0] if closed and n > 1 else 0.0), j) for j in ends if (full, j) in best)
    tour, mask, j = [], full, last
    while j != -1:
        tour.append(j)
        mask, j = mask ^ (1 << j), best[mask, j][1]
    return tour[::-1], float(total)


def tour_heuristic(cost: np.ndarray, closed: bool = True, rounds: int = 500, seed: int = 1) -> tuple[list[int], float]:
    """Nearest neighbour, then 2-opt and moved runs of up to five, restarted by double-bridge kicks."""
    n = len(cost)
    rng = np.random.default_rng(seed)

    def length(t):
        return float(sum(cost[a, b] for a, b in zip(t, t[1:])) + (cost[t[-1], t[0]] if closed else 0.0))

    def improve(t):
        now, better = length(t), True
        while better:
            better = False
            for i in range(1, n - 1):
                for j in range(i + 1, n):
                    new = t[:i] + t[i : j + 1][::-1] + t[j + 1 :]
                    if (l := length(new)) < now - 1e-9:
                        t, now, better = new, l, True
            for run in range(1, min(5, n - 2) + 1):
                for i in range(1, n - run + 1):
                    piece, rest = t[i : i + run], t[:i] + t[i + run :]
                    for j in range(1, len(rest) + 1):
                        new = rest[:j] + piece + rest[j:]
                        if (l := length(new)) < now - 1e-9:
                            t, now, better = new, l, True
        return t, now

    tour = [0]
    while len(tour) < n:
        tour.append(min((j for j in range(n) if j not in tour), key=lambda j: (cost[tour[-1], j], j)))
    best, least = improve(tour)
    for _ in range(rounds if n >= 8 else 0):
        a, b, c = sorted(rng.choice(np.arange(1, n), 3, replace=False))
        t, l = improve(best[:a] + best[b:c] + best[a:b] + best[c:])
        if l < least - 1e-9:
            best, least = t, l
    return best, least


#: Segments that may be broadcast.
MOST_SEGMENTS = 100_000


def crossings(lines: DataFrame, size: float) -> DataFrame:
    """Proper crossings of segments of different lines: (a, ai, b, bi, x, y). Segments meet in the grid cells of
    their boxes, and a pair counts in the first cell that both have; or, where cells would make more pairs than there are,
    each segment meets each."""
    n = F.size("vertices")
    seg = lines.select("fid", F.posexplode(F.arrays_zip(F.slice("vertices", 1, n - 1).alias("p"), F.slice("vertices", 2, n - 1).alias("q"))).alias("i", "s")).select("fid", "i", *[F.col(f"s.{p}.{c}").cast("double").alias(f"{p}{c}") for p in "pq" for c in "xy"])
    low, high = (lambda c, f=f: F.floor(f(f"p{c}", f"q{c}") / size) for f in (F.least, F.greatest))
    line = lambda c: F.sequence(low(c), high(c))
    keyed = seg.withColumns({"x0": low("x"), "y0": low("y"), "cx": F.explode(line("x"))}).withColumn("cy", F.explode(line("y")))
    met = keyed.groupBy("cx", "cy").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    count = seg.count()
    dense = met >= count * count
    side = lambda p, q, r: (F.col(f"{q}x") - F.col(f"{p}x")) * (F.col(f"{r}y") - F.col(f"{p}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (F.col(f"{r}x") - F.col(f"{p}x"))
    a, b = ((seg if dense else keyed).select(*[F.col(c).alias(f"{s}_{c}") for c in (seg if dense else keyed).columns]) for s in "ab")
    d1, d2, d3, d4 = side("a_p", "a_q", "b_p"), side("a_p", "a_q", "b_q"), side("b_p", "b_q", "a_p"), side("b_p", "b_q", "a_q")
    test = (F.col("a_fid") < F.col("b_fid")) & (d1 * d2 < 0) & (d3 * d4 < 0)
    if dense:
        hit = a.repartition(a.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(b) if count <= MOST_SEGMENTS else b, test)
    else:
        same = (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy"))
        hit = a.join(b, same & (F.col("a_cx") == F.greatest("a_x0", "b_x0")) & (F.col("a_cy") == F.greatest("a_y0", "b_y0")) & test)
    t: Column = d3 / F.nullif(d3 - d4, F.lit(0.0))
    hit = hit.withColumn("t", t)
    return hit.select(F.col("a_fid").alias("a"), F.col("a_i").alias("ai"), F.col("b_fid").alias("b"), F.col("b_i").alias("bi"), *[(F.col(f"a_p{c}") + F.col("t") * (F.col(f"a_q{c}") - F.col(f"a_p{c}"))).alias(c) for c in "xy"])


def split_at_crossings(lines: DataFrame, size: float) -> DataFrame:
    """N02 -split: lines with a vertex at each proper crossing with another line, in order along each segment."""
    x = crossings(lines, size)
    cut = x.select(F.col("a").alias("fid"), F.col("ai").alias("i"), "x", "y").unionByName(x.select(F.col("b").alias("fid"), F.col("bi").alias("i"), "x", "y"))
    own = lines.select("fid", F.posexplode("vertices").alias("i", "p"))
    start = own.select("fid", "i", F.col("p.x").alias("sx"), F.col("p.y").alias("sy"))
    cut = cut.join(start, ["fid", "i"]).select("fid", "i", F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)).alias("t"), F.struct("x", "y").alias("p"))
    every = own.select("fid", "i", F.lit(0.0).alias("t"), F.struct(F.col("p.x").alias("x"), F.col("p.y").alias("y")).alias("p")).unionByName(cut).distinct()
    made = every.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t", "p"))), lambda e: e["p"]).alias("vertices"))
    return lines.drop("vertices").join(made, "fid").select(*lines.columns)
