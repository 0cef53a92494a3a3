"""MinHash near-dedup by a signature-coordinate inverted join.

Every text becomes the set of its word shingles and K min-hash coordinates. Texts with equal sets are one class and only
a class's smallest id goes on. Each class is posted under its coordinate-value pairs; pairs that one class alone has can
never collide and are dropped, and a class with fewer than T of the others matches nothing. Of the rest, ordered rarest
first, a class needs to be posted under all but T - 1 only: two classes with T collisions must meet in such a prefix. The
skipped, longer lists are never merged; their collisions are counted from the signatures of the pairs that met. A pair
with T collisions is confirmed on the full sets, in integers.

What is asked for is components, so a list of m classes isn't expanded into m * m pairs. Rounds of stars come first: each
list's members are compared with one pivot and components are formed from the confirmed links; a list whose members are
all in one component is finished. A class that is in open lists still gets the largest of them as its home, lists that
share a good part of their classes are one home, and the classes of one home are compared in full, block by block, in tasks of bounded size that return no pairs but one edge to the
least linked class. What is left, pairs that meet in an open list and differ in home and component, is expanded and
compared one by one, all of it, so that no link between components is lost.

T lies five standard deviations below the collisions expected at the threshold itself (K = 64, similarity 0.85: T = 40),
where a pair is missed with probability below 1e-5; full sets are 64-bit shingle hashes.

Defined results: A-Z are lower-cased; null text, or text without words, is an empty set, linked with nothing, and its own
component; fewer words than a shingle has are one shingle, the whole sequence; rows that repeat an id are marked alike;
an empty table gives an empty result; other columns pass by unread.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, collect_bitmap, components, mix64, string_slices, without_ids, word_hashes

K = 64
#: Bits of the bitmap of classes that may match: 4 MB at most.
BITS = 1 << 25
PIVOT_ROUNDS = 1
HOME_ROUNDS = 1
#: Lists are one home if so much of the smaller is in both.
SHARED = 0.2
#: Classes of one home that a task compares with as many others.
BLOCK = 400

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_collisions(percent: int, k: int = K) -> int:
    p = percent / 100
    return max(1, math.floor(k * p - 5 * math.sqrt(k * p * (1 - p))))


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, row = word_hashes(data, off)
    n = np.bincount(row, minlength=len(off) - 1) if len(row) else np.zeros(len(off) - 1, np.int64)
    m = max(0, len(h) - words + 1)
    s = np.zeros(m, np.uint64)
    for j in range(words):
        s += h[j : j + m] * _C[j]
    s = mix64(s)
    first = np.concatenate([[0], np.cumsum(n)])
    out = []
    for r in range(len(off) - 1):
        if n[r] >= words:
            out.append(np.unique(s[first[r] : first[r + 1] - words + 1]))
        elif n[r]:
            w = h[first[r] : first[r + 1]]
            out.append(mix64((w * _C[: len(w)]).sum(keepdims=True) + _C[40 + len(w) : 41 + len(w)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """K coordinate-value pairs, each as one 64-bit number."""
    best = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(best, (s[i : i + 1024, None] * _A[None, :] + _B[None, :]).min(0), out=best)
    return mix64(best ^ (np.arange(K, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)))


def _offsets(arrays):
    import pyarrow as pa

    return pa.array(np.concatenate([[0], np.cumsum([len(s) for s in arrays])]), pa.int32())


def _signed(docs: DataFrame, words: int) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for i, data, off in string_slices(b.column(1)):
                sets = shingle_sets(data, off, words)
                sigs = [signature(s) if len(s) else s for s in sets]
                lists = pa.ListArray.from_arrays(_offsets(sigs), pa.array(np.concatenate(sigs).view(np.int64)))
                hi = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                lo = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi), pa.array(lo), lists], ["id", "n", "hi", "lo", "sig"])

    return docs.mapInArrow(run, "id long, n long, hi long, lo long, sig array<long>")


def _full_sets(docs: DataFrame, words: int, bitmap: np.ndarray) -> DataFrame:
    """Full sets of the ids that the bitmap may hold."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    docs = docs.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(BITS)))

    def run(batches):
        for b in batches:
            slot = b.column(2).to_numpy()
            hit = np.flatnonzero(shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            if len(hit):
                b = b.take(pa.array(hit))
                for i, data, off in string_slices(b.column(1)):
                    sets = shingle_sets(data, off, words)
                    lists = pa.ListArray.from_arrays(_offsets(sets), pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(sets)), lists], ["id", "full"])

    return docs.mapInArrow(run, "id long, full array<long>")


def near_groups(docs: DataFrame, stash: Stash, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept. Links are 100 * intersection >= percent * union."""
    t = least_collisions(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stash.put(_signed(docs, words), "signed")
    classes = stash.put(
        signed.where("n > 0 and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes"
    )
    posts = classes.select(F.col("rep").alias("id"), F.col("n").alias("size"), F.explode("sig").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    known = Window.partitionBy("id")
    prefix = (
        posts.join(shared, "key")
        .withColumn("u", F.count("*").over(known)).where(F.col("u") >= t)
        .withColumn("rank", F.row_number().over(known.orderBy("f", "key"))).where(F.col("rank") <= F.col("u") - t + 1)
        .select("id", "size", "key")
    )
    prefix = stash.put(prefix, "prefix")
    met = prefix.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    prefix = stash.put(prefix.join(met, "key", "left_semi"), "met")
    stash.drop("prefix")
    maybe = prefix.select("id").distinct()
    full = _full_sets(docs, words, collect_bitmap(maybe, "id", BITS))
    sets = stash.put(
        full.join(maybe, "id", "left_semi").dropDuplicates(["id"]).join(classes.select(F.col("rep").alias("id"), "n", "sig"), "id"), "sets"
    )

    links: list[DataFrame] = []

    def confirm(pairs: DataFrame, name: str) -> None:
        """Counts collisions, then compares full sets."""
        a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"), F.col("full").alias("fa"))
        b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"), F.col("full").alias("fb"))
        both = F.when(F.size(F.array_intersect("sa", "sb")) >= t, F.size(F.array_intersect("fa", "fb"))).otherwise(0)
        hit = pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "na", "nb", both.cast("long").alias("i"))
        links.append(stash.put(hit.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"), name))

    def close(size_a, size_b):
        """Sets of too different sizes can't reach the threshold."""
        return 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)

    lists, comp, left, r = prefix.withColumn("comp", F.col("id")), None, 1, 0
    for _ in range(PIVOT_ROUNDS):
        pivot = lists.groupBy("key").agg(F.min_by(F.struct("id", "size", "comp"), F.struct(F.xxhash64("id", F.lit(r)), "id") if r else F.struct("id")).alias("p"))
        star = lists.join(pivot, "key").where((F.col("comp") != F.col("p.comp")) & close(F.col("size"), F.col("p.size")))
        confirm(star.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")), f"links-{r}")
        comp, lists, left = _regroup(prefix, links, stash, r)
        r += 1
        if not left:
            break
    homes: list[DataFrame] = []
    for _ in range(HOME_ROUNDS if left else 0):
        homes.append(stash.put(_homes(lists, homes, stash, r), f"homes-{r}"))
        links.append(stash.put(_compare_homes(homes[-1], sets, t, percent), f"links-{r}"))
        comp, lists, left = _regroup(prefix, links, stash, r)
        r += 1
        if not left:
            break
    if left:
        for i, h in enumerate(homes):
            lists = lists.join(h.select("id", F.col("home").alias(f"home{i}")), "id", "left")
        apart = [f"home{i}" for i in range(len(homes))]
        side = lambda x: lists.select("key", F.col("id").alias(x), F.col("size").alias(f"z{x}"), F.col("comp").alias(f"c{x}"), *[F.col(h).alias(f"{h}{x}") for h in apart])
        rest = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & close(F.col("za"), F.col("zb")))
        for h in apart:  # pairs of one home have been compared
            rest = rest.where(F.coalesce(F.col(f"{h}a") != F.col(f"{h}b"), F.lit(True)))
        confirm(rest.select("a", "b"), f"links-{r}")
        comp = _joined(links, stash, r)
    of_class = classes.select("hi", "lo", "rep").join(comp.select(F.col("node").alias("rep"), "root"), "rep", "left").select("hi", "lo", F.coalesce("root", "rep").alias("root"))
    out = signed.select("id", "n", "hi", "lo").join(of_class, ["hi", "lo"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("root")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _homes(lists: DataFrame, before: list[DataFrame], stash: Stash, r: int) -> DataFrame:
    """(id, comp, home): the largest open list of each class; in later rounds, the largest counting only members whose
    earlier home isn't the list's most common one."""
    for i, h in enumerate(before):
        usual = lists.join(h.select("id", "home"), "id", "left").groupBy("key", "home").agg(F.count("*").alias("m"))
        usual = usual.groupBy("key").agg(F.max_by("home", F.struct("m", "home")).alias("usual"))
        seen = lists.join(h.select("id", "home"), "id", "left").join(usual, "key")
        odd = seen.where(~F.col("home").eqNullSafe(F.col("usual"))).select("key").distinct()
        lists = lists.join(odd, "key", "left_semi")
    size = lists.groupBy("key").agg(F.count("*").alias("m"))
    own = stash.put(lists.join(size, "key").groupBy("id").agg(F.max_by("key", F.struct("m", "key")).alias("home"), F.min("comp").alias("comp")), f"own-{r}")
    other = size.select(F.col("key").alias("home"), F.col("m").alias("mh"))
    both = lists.join(own.select("id", "home"), "id").where("key <> home").groupBy("key", "home").agg(F.count("*").alias("n")).join(size, "key").join(other, "home")
    family = components(both.where(F.col("n") >= SHARED * F.least("m", "mh")).where("least(m, mh) >= 20").select(F.col("key").alias("a"), F.col("home").alias("b")), stash, f"family-{r}")
    return own.join(family.select(F.col("node").alias("home"), "root"), "home", "left").select("id", "comp", F.coalesce("root", "home").alias("home"))


def _compare_homes(homes: DataFrame, sets: DataFrame, t: int, percent: int) -> DataFrame:
    """Edges (a, b) that join all linked classes of one home; every pair of one home is compared."""
    import pyarrow as pa

    several = homes.groupBy("home").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("home", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = homes.join(several, "home").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("id", "home", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(sets, "id")

    def compare(table):
        ids, sizes = np.asarray(table.column("id")), np.asarray(table.column("n"))
        comp = np.asarray(table.column("comp"))
        sig = np.asarray(table.column("sig").combine_chunks().flatten()).reshape(len(ids), -1)
        hits = np.zeros((len(ids), len(ids)), np.int16)
        for k in range(sig.shape[1]):
            hits += sig[:, k, None] == sig[None, :, k]
        full = table.column("full").combine_chunks()
        values = np.asarray(full.flatten())
        owner = np.repeat(np.arange(len(ids)), np.diff(np.asarray(full.offsets)))
        kinds, at, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)
        column = np.full(len(kinds), -1)
        column[shared] = np.arange(len(shared))
        at = column[at]
        inter = np.zeros((len(ids), len(ids)), np.float32)
        for lo in range(0, len(shared), 4096):
            part = (at >= lo) & (at < lo + 4096)
            m = np.zeros((len(ids), min(4096, len(shared) - lo)), np.float32)
            m[owner[part], at[part] - lo] = 1
            inter += m @ m.T
        linked = (hits >= t) & (100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)) | (comp[:, None] == comp[None, :])
        best = ids.copy()
        while True:
            now = np.minimum(best, np.where(linked, best[None, :], np.iinfo(np.int64).max).min(1))
            if (now == best).all():
                break
            best = now
        # Members of one component are joined already; their edge here changes nothing.
        out = ids != best
        return pa.table([pa.array(best[out]), pa.array(ids[out])], ["a", "b"])

    return rows.groupBy("home", "i", "j").applyInArrow(compare, "a long, b long")


def _joined(links: list[DataFrame], stash: Stash, r: int) -> DataFrame:
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    return components(every, stash, f"cc-{r}")


def _regroup(prefix: DataFrame, links: list[DataFrame], stash: Stash, r: int):
    """Components of all links so far, the lists that still span several, and how many rows those have."""
    comp = _joined(links, stash, r)
    member = prefix.join(comp, prefix["id"] == comp["node"], "left").select("key", "id", "size", F.coalesce("root", "id").alias("comp"))
    open_keys = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    lists = stash.put(member.join(open_keys, "key", "left_semi"), f"open-{r}")
    return comp, lists, lists.count()


def first_of_groups(docs: DataFrame, stash: Stash, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that a component's smallest id stands for."""
    groups = stash.put(near_groups(docs, stash, words, percent, id_col, text_col), "groups")
    return without_ids(docs, id_col, groups.where("not kept").select(id_col))
