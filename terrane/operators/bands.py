"""Centralities of a network by bands: nodes are cut into bands by their height (least cost from one end, whatever the
direction of arcs). A source is searched for within its band; what lies beyond needs only its costs and counts of least paths
at the band's edge.

Sources whose costs there differ by a constant, and whose counts by a factor, have the same least paths beyond it, so one
search serves all of them; a few bands away few such states are left, and most are those of the lowest (highest) node, which
are known beforehand. Sums of costs have to be exact (see suits), so that ties are ties."""

from __future__ import annotations

import heapq

import numpy as np

#: Nodes of a band at least, states (a source and a node) of a search, bytes of searches that are kept for the way back, and
#: arcs of a node at most.
BAND = 1_600
STATES = 1_000_000
KEPT = 300_000_000
DEGREE = 16


def suits(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> bool:
    """Whether all sums of costs along paths are exact (positive multiples of 2^-20, with a sum below 2^52 of them), and no
    node has more than DEGREE arcs."""
    units = w * 2.0**20
    sums = len(w) and np.all(np.isfinite(w)) and w.min() > 0 and units.sum() < 2.0**52 and np.all(units == np.floor(units))
    return bool(sums and max(np.bincount(u).max(), np.bincount(v).max()) <= DEGREE)


def _heights(n: int, ptr: list, ends: list, costs: list) -> tuple[np.ndarray, np.ndarray]:
    """Least costs from a far end of each component, with components above each other, and the component."""
    height, part, top, k = np.full(n, np.inf), np.zeros(n, np.int64), 0.0, 0

    def search(s: int) -> dict:
        known, heap, best = {}, [(0.0, s)], {s: 0.0}
        while heap:
            d, u = heapq.heappop(heap)
            if u in known:
                continue
            known[u] = d
            for i in range(ptr[u], ptr[u + 1]):
                v, nd = ends[i], d + costs[i]
                if nd < best.get(v, np.inf):
                    best[v] = nd
                    heapq.heappush(heap, (nd, v))
        return known

    for s in range(n):
        if height[s] == np.inf:
            known = search(s)
            known = search(next(reversed(known))) if len(known) > 1 else known
            at = np.fromiter(known, np.int64, len(known))
            height[at], part[at] = top + np.fromiter(known.values(), float, len(known)), k
            top, k = float(height[at].max()) + 1.0, k + 1
    return height, part


def _slots(n: int, of: np.ndarray, ends: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arcs of nodes as columns; costs without an arc are infinite."""
    order = np.argsort(of, kind="stable")
    of, ends, costs = of[order], ends[order], costs[order]
    ptr = np.searchsorted(of, np.arange(n + 1))
    most = int(np.diff(ptr).max()) if len(of) else 1
    k = np.arange(len(of)) - ptr[of]
    e, c = np.zeros((n, most), np.int64), np.full((n, most), np.inf)
    e[of, k], c[of, k] = ends, costs
    return e, c


class Bands:
    """Nodes numbered by height, with their arcs, and where bands begin. Arcs join nodes of one band or of bands side by side.
    edge: nodes of a band with neighbours above it; upper and lower: nodes above it, and below those, that are on a least
    path between two of them (see between)."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, size: int | None = None):
        size = size or BAND
        a, b, c = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w])
        order = np.argsort(a, kind="stable")
        height, part = _heights(n, np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist(), c[order].tolist())
        self.order = np.argsort(height, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.n, self.h, self.part, self.width = n, height[self.order], part[self.order], float(w.min())
        u, v = self.place[u], self.place[v]
        self.into, self.out = _slots(n, v, u, w), _slots(n, u, v, w)
        far = np.arange(n)
        np.maximum.at(far, u, v)
        np.maximum.at(far, v, u)
        reach, cuts = np.maximum.accumulate(far), [0]
        while cuts[-1] < n:
            i = min(n, max(cuts[-1] + size, int(reach[cuts[-1] - 1]) + 1 if cuts[-1] else 0))
            i = int(np.searchsorted(self.h, self.h[i - 1], "right"))
            cuts.append(n if n - i < size // 2 else i)
        self.cuts = cuts
        self.edge = [np.flatnonzero(far[i:j] >= j) + i for i, j in zip(cuts, cuts[1:])]
        self.upper, self.lower = [np.zeros(0, np.int64)] * len(self.edge), [np.zeros(0, np.int64)] * len(self.edge)
        self.known: dict = {}
        self.reach = 0.0

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def between(self, b: int) -> np.ndarray:
        """Nodes on a least path between two nodes of a band's edge. What is higher than x above the edge, or lower than x
        below it, costs more than 2 x there and back."""
        s = self.edge[b]
        if not len(s):
            return s
        x = self.reach or max(float(self.h[self.cuts[b + 1] - 1] - self.h[self.cuts[b]]), self.width)
        first, last = np.searchsorted(self.part, self.part[s[0]], "left"), np.searchsorted(self.part, self.part[s[0]], "right")
        while True:
            lo = max(int(first), int(np.searchsorted(self.h, self.h[s[0]] - x)))
            hi = min(int(last), int(np.searchsorted(self.h, self.h[self.cuts[b + 1] - 1] + x, "right")))
            at = np.arange(lo, hi)
            there = Window(self, at).from_nodes(s - lo)[0]
            cost = there[:, s - lo]
            need = cost.max() / 2
            if need <= x or hi - lo == last - first:
                break
            x = float(need) if np.isfinite(need) else 2 * x
        if np.isfinite(need):
            self.reach = float(need) * 1.1  # for the next one
        back = Window(self, at, turned=True).from_nodes(s - lo)[0]
        cost = np.where(np.isfinite(cost), cost, -1.0)
        on = np.zeros(len(at), bool)
        for k in range(len(s)):
            on |= (there[k] + back == cost[k][:, None]).any(axis=0)
        return at[on]

    def local(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that a search from a band needs, and its own targets among them."""
        own, below = np.arange(self.cuts[b], self.cuts[b + 1]), self.edge[b - 1] if b else np.zeros(0, np.int64)
        at = np.unique(np.concatenate([own, below, self.upper[b], self.lower[b - 1] if b else below]))
        return at, np.isin(at, own) | np.isin(at, below)

    def beyond(self, b: int, side: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The same of a search from the edge of a band up (side 1) or down (-1), and the next edge that it meets (-1: none)."""
        if side > 0:
            own, more, to = np.arange(self.cuts[b + 1], self.cuts[b + 2]), self.upper[b + 1], b + 1 if len(self.edge[b + 1]) else -1
        else:
            own, to = np.setdiff1d(np.arange(self.cuts[b], self.cuts[b + 1]), self.edge[b]), b - 1 if b and len(self.edge[b - 1]) else -1
            own, more = np.concatenate([own, self.edge[b - 1]]) if to >= 0 else own, self.lower[b - 1] if to >= 0 else own[:0]
        at = np.unique(np.concatenate([own, more, self.edge[b]]))
        return at, np.isin(at, own), to

    def learn(self, band: np.ndarray, node: np.ndarray) -> None:
        """Takes what between gives for all bands, and finds the states of the lowest and of the highest node of each
        component at all edges, and what lies beyond for them."""
        for b in range(len(self)):
            on = np.sort(node[band == b])
            self.upper[b], self.lower[b] = on[on >= self.cuts[b + 1]], np.setdiff1d(on[on < self.cuts[b + 1]], self.edge[b])
        starts = np.flatnonzero(np.diff(self.part, prepend=-1))
        ends = np.append(starts[1:], self.n)
        for side, first in ((1, starts), (-1, ends - 1)):
            dist, sigma = self._counts(first.tolist())
            got: dict = {}
            for b in range(len(self) - 2, -1, -1) if side > 0 else range(len(self) - 1):
                s = self.edge[b]
                if not len(s) or not np.isfinite(dist[s]).any() or not np.isfinite(sigma).all():
                    continue
                at, own, to = self.beyond(b, side)
                to = to if to in got and self.part[self.edge[to][0]] == self.part[s[0]] else -1
                win = Window(self, at, s)
                d, c = dist[at], sigma[at] / sigma[s].max()
                on = np.isfinite(d) & (self.part[at] == self.part[s[0]])
                order = np.argsort(np.where(on, d, np.inf), kind="stable")[: int(on.sum())]
                cell = np.floor(d[order] / self.width)
                settled = np.split(order, np.flatnonzero(np.diff(cell)) + 1)
                put = np.zeros((1, len(at)))
                beyond = got.get(to)
                if beyond:
                    put[0, np.searchsorted(at, self.edge[to])] = beyond["put"]
                gain = win.back(d[None], c[None], settled, own, put)
                count = int((own & on).sum()) + (beyond["count"] if beyond else 0)
                total = float(d[own & on].sum() - dist[s].min() * (own & on).sum()) + (beyond["total"] + (dist[self.edge[to]].min() - dist[s].min()) * beyond["count"] if beyond else 0.0)
                through = np.where(win.free, gain[0] + put[0], 0.0)
                got[b] = {"dist": dist[s] - dist[s].min(), "sigma": sigma[s] / sigma[s].max(), "put": gain[0][np.searchsorted(at, s)], "count": count, "total": total, "at": at, "through": through, "to": to}
            self.known[side] = got

    def _counts(self, starts: list) -> tuple[np.ndarray, np.ndarray]:
        """Least costs and counts of least paths from nodes that reach no node in common."""
        dist, sigma, done = [np.inf] * self.n, [0.0] * self.n, bytearray(self.n)
        ends, costs = (x.tolist() for x in self.out)
        for s in starts:
            dist[s], sigma[s] = 0.0, 1.0
        heap = [(0.0, s) for s in starts]
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = 1
            for v, w in zip(ends[u], costs[u]):
                nd = d + w
                if nd < dist[v]:
                    dist[v], sigma[v] = nd, sigma[u]
                    heapq.heappush(heap, (nd, v))
                elif nd == dist[v] and w < np.inf:
                    sigma[v] += sigma[u]
        return np.array(dist), np.array(sigma)


class Window:
    """Some nodes and the arcs between them, but none into fixed ones. A state is a source and a node."""

    def __init__(self, g: Bands, at: np.ndarray, fixed: np.ndarray = (), turned: bool = False):
        self.at, self.n, self.width = at, len(at), g.width
        self.free = ~np.isin(at, fixed)
        into, out = (g.out, g.into) if turned else (g.into, g.out)
        self.into, self.into_cost = self._inside(*into, self.free, np.ones(self.n, bool))
        self.out, self.out_cost = self._inside(*out, np.ones(self.n, bool), self.free)

    def _inside(self, ends, costs, of, to) -> tuple[np.ndarray, np.ndarray]:
        """Arcs as steps from a state to another."""
        ends, costs = ends[self.at], costs[self.at]
        k = np.minimum(np.searchsorted(self.at, ends), self.n - 1)
        keep = (self.at[k] == ends) & to[k] & of[:, None]
        return np.where(keep, k - np.arange(self.n)[:, None], 0), np.where(keep, costs, np.inf)

    def from_nodes(self, rows: np.ndarray):
        dist, sigma = np.full((len(rows), self.n), np.inf), np.zeros((len(rows), self.n))
        dist[np.arange(len(rows)), rows], sigma[np.arange(len(rows)), rows] = 0.0, 1.0
        return self.search(dist, sigma)

    def search(self, dist: np.ndarray, sigma: np.ndarray):
        """Least costs and counts of least paths from the finite states, in place, and the states as they settle. A bucket is
        as wide as the least cost, so its states settle together."""
        n, width = self.n, self.width
        shape, dist, sigma = dist.shape, dist.reshape(-1), sigma.reshape(-1)
        done = np.zeros(len(dist), bool)
        buckets: dict[int, list] = {}
        heap, settled = [], []

        def put(v, d):
            if not len(v):
                return
            to = (d / width).astype(np.int64)
            order = np.argsort(to, kind="stable")
            v, to = v[order], to[order]
            cuts = (np.flatnonzero(to[1:] != to[:-1]) + 1).tolist()
            for k, i, j in zip(to[[0, *cuts]].tolist(), [0, *cuts], [*cuts, len(v)]):
                if k not in buckets:
                    buckets[k] = []
                    heapq.heappush(heap, k)
                buckets[k].append(v[i:j])

        start = np.flatnonzero(np.isfinite(dist))
        put(start, dist[start])
        while heap:
            x = np.concatenate(buckets.pop(heapq.heappop(heap)))
            x = x[~done.take(x)]
            if not len(x):
                continue
            x.sort()  # neighbours in memory together, and equal ones
            if len(x) > 1:
                x = x[np.append(True, x[1:] != x[:-1])]
            done[x] = True
            settled.append(x.astype(np.int32))
            u, d = x % n, dist.take(x)[:, None]
            p = self.into.take(u, axis=0)
            p += x[:, None]
            tight = dist.take(p)
            tight += self.into_cost.take(u, axis=0)
            sigma[x] += np.einsum("ij,ij->i", sigma.take(p), (tight == d).astype(float))
            q = self.out.take(u, axis=0)
            q += x[:, None]
            nd = self.out_cost.take(u, axis=0)
            nd += d
            less = nd < dist.take(q)
            v, nd = q[less], nd[less]
            a, b = v, nd
            while len(a):  # of equal ones the last is written; again, where another is less
                dist[a] = b
                less = b < dist[a]
                a, b = a[less], b[less]
            last = nd == dist[v]
            put(v[last], nd[last])
        return dist.reshape(shape), sigma.reshape(shape), settled

    def back(self, dist: np.ndarray, sigma: np.ndarray, settled: list, ends: np.ndarray, put: np.ndarray) -> np.ndarray:
        """What the targets make of each state. ends: nodes that are targets; put: what comes from beyond."""
        one = np.divide(1.0, sigma, out=np.zeros_like(sigma), where=sigma > 0)
        share, gain = ((put + ends) * one).reshape(-1), np.zeros(dist.size)
        dist, sigma, one = dist.reshape(-1), sigma.reshape(-1), one.reshape(-1)
        for x in reversed(settled):
            u = x % self.n
            q = self.out.take(u, axis=0)
            q += x[:, None]
            nd = self.out_cost.take(u, axis=0)
            nd += dist.take(x)[:, None]
            got = np.einsum("ij,ij->i", share.take(q), (nd == dist.take(q)).astype(float))
            gain[x] = got * sigma[x]
            share[x] += got * sigma[x] * one[x]
        return gain.reshape(put.shape)


class Sums:
    """Of some sources: what they add to the betweenness, and their closeness."""

    def __init__(self, g: Bands):
        self.g, self.score, self.close, self.own = g, np.zeros(g.n), np.zeros(g.n), np.zeros(g.n, bool)
        self.entered = {side: np.zeros(len(g)) for side in (1, -1)}  # sources whose state is a known one from here on

    def add(self, bands: list) -> None:
        """All sources of some bands side by side."""
        g, runs = self.g, []
        for b in bands:
            at, own = g.local(b)
            win, sources = Window(g, at), np.arange(g.cuts[b], g.cuts[b + 1])
            some = max(1, STATES // len(at))
            for s in (sources[i : i + some] for i in range(0, len(sources), some)):
                dist, sigma, settled = win.from_nodes(np.searchsorted(at, s))
                runs.append((b, s, win, own, dist, sigma, settled, np.zeros_like(dist)))
        more = [np.zeros((2, len(s))) for _, s, *_ in runs]
        for side in (1, -1):
            feeds: dict = {}
            for k, (b, _, win, _, dist, sigma, _, _) in enumerate(runs):
                edge = b if side > 0 else b - 1
                if edge >= 0 and len(g.edge[edge]):
                    e = np.searchsorted(win.at, g.edge[edge])
                    feeds.setdefault(edge, []).append((k, e, dist[:, e], sigma[:, e]))
            for k, e, put, count, total in self.go(side, feeds):
                runs[k][7][:, e] += put
                more[k] += count, total
        for (b, s, win, own, dist, sigma, settled, put), (count, cost) in zip(runs, more):
            there = np.isfinite(dist) & own
            reached, total = there.sum(axis=1) + count, np.where(there, dist, 0.0).sum(axis=1) + cost
            gain = win.back(dist, sigma, settled, own, put)
            gain += put
            gain[np.arange(len(s)), np.searchsorted(win.at, s)] = 0.0
            self.score[win.at] += gain.sum(axis=0)
            self.own[s], self.close[s] = True, np.where(total > 0, (reached - 1) ** 2 / (g.n - 1) / np.where(total > 0, total, 1.0), 0.0)

    def go(self, side: int, feeds: dict) -> list:
        """What lies beyond edges for the sources that start there (by edge: a key, rows, costs, counts): how the targets
        beyond divide among the edge's nodes, how many there are and the sum of their costs."""
        g, levels, kept = self.g, [], 0
        left = sorted(feeds, reverse=side < 0)
        b, come = -1, None
        while left or b >= 0:
            if b < 0:
                b = left[0]
            starts = feeds[left.pop(0)] if left and left[0] == b else []
            empty = np.zeros((0, len(g.edge[b])))
            dist, sigma, times = come or (empty, empty, empty[:, 0])
            level = {"b": b, "come": len(dist), "starts": starts, "to": -1}
            levels.append(level)
            dist, sigma = np.concatenate([dist, *[x[2] for x in starts]]), np.concatenate([sigma, *[x[3] for x in starts]])
            times = np.concatenate([times, np.ones(len(dist) - len(times))])
            level["least"] = least = dist.min(axis=1)
            some = np.flatnonzero(np.isfinite(least))
            d = dist[some] - least[some, None]
            c = sigma[some] / sigma[some].max(axis=1, keepdims=True)
            level["known"] = known = g.known.get(side, {}).get(b)
            met = np.zeros(len(some), bool)
            if known:
                met = (d == known["dist"]).all(axis=1) & (np.abs(c - known["sigma"]) <= 1e-10 * known["sigma"]).all(axis=1)
                self.entered[side][b] += times[some[met]].sum()
            level["met"], level["rest"] = some[met], some[~met]
            d, c, times = d[~met], c[~met], times[some[~met]]
            b, come = -1, None
            if len(d):
                digits, power = np.frexp(c)
                key = np.ascontiguousarray(np.concatenate([d, np.round(digits * 2**36), power], axis=1))
                _, one, level["of"] = np.unique(key.view(f"V{key.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
                d, c, times = d[one], c[one], np.bincount(level["of"], times, len(one))
                at, own, to = g.beyond(level["b"], side)
                level |= {"win": Window(g, at, g.edge[level["b"]]), "own": own, "to": to, "times": times, "start": (d, c)}
                held = self.through(level)
                kept += held[0].size * 20
                level["held"] = held if kept <= KEPT else None
                if to >= 0:
                    e = np.searchsorted(at, g.edge[to])
                    b, come = to, (held[0][:, e], held[1][:, e], times)
        more, out = None, []
        for level in reversed(levels):
            s, m = g.edge[level["b"]], len(level["least"])
            put, count, total = np.zeros((m, len(s))), np.zeros(m), np.zeros(m)
            if level["known"]:
                k, i = level["known"], level["met"]
                put[i], count[i], total[i] = k["put"], k["count"], k["total"]
            if "win" in level:
                win, own = level["win"], level["own"]
                dist, sigma, settled = level.pop("held") or self.through(level)
                there = np.isfinite(dist) & own
                n, cost, beyond = there.sum(axis=1).astype(float), np.where(there, dist, 0.0).sum(axis=1), np.zeros_like(dist)
                if level["to"] >= 0:
                    beyond[:, np.searchsorted(win.at, g.edge[level["to"]])] = more[0]
                    n, cost = n + more[1], cost + more[2]
                gain = win.back(dist, sigma, settled, own, beyond)
                i, of, e = level["rest"], level["of"], np.searchsorted(win.at, s)
                put[i], count[i], total[i] = gain[of][:, e], n[of], cost[of]
                self.score[win.at] += np.where(win.free, level["times"] @ (gain + beyond), 0.0)
            total += np.where(np.isfinite(level["least"]), level["least"], 0.0) * count
            at = level["come"]
            more = put[:at], count[:at], total[:at]
            for k, e, x, _ in level["starts"]:
                out.append((k, e, put[at : at + len(x)], count[at : at + len(x)], total[at : at + len(x)]))
                at += len(x)
        return out

    def through(self, level: dict) -> tuple:
        """The search of a level's states through the next band."""
        win, (d, c) = level["win"], level["start"]
        dist, sigma = np.full((len(d), win.n), np.inf), np.zeros((len(d), win.n))
        e = np.flatnonzero(~win.free)
        dist[:, e], sigma[:, e] = d, c
        return win.search(dist, sigma)

    def end(self) -> None:
        """Adds what the known states make of the nodes beyond."""
        for side, entered in self.entered.items():
            got, now = self.g.known.get(side, {}), np.zeros(len(self.g))
            for b in sorted(got, reverse=side < 0):
                now[b] += entered[b]
                if now[b]:
                    self.score[got[b]["at"]] += now[b] * got[b]["through"]
                    if got[b]["to"] >= 0:
                        now[got[b]["to"]] += now[b]
