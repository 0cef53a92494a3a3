"""LM scoring by a probabilistic suffix tree over words.

A document is its tokens, words with A-Z lower-cased and an end. The tree's symbols are SYMBOLS classes of tokens (the
upper bits of a token's hash), its contexts up to two symbols before a token, with a start symbol before the first. A
context is retained as a state if the likelihood that its next-symbol distribution gains over its parent's (its
divergence times its count) exceeds half the log of its count for each symbol that follows it; ancestors of states are
states. A state's distribution is smoothed with its parent's (Witten-Bell), the root's with an even share. A token's
class is scored by the longest retained suffix of what precedes it; the token itself by its share in its class. Tokens
that training never saw are one symbol more, as in the base, with the mass of the tokens seen once; so the
probabilities of all tokens after any context add up to one.

Nothing holds the tree as a whole. Texts are read in chunks of bounded size. A chunk posts its distinct tokens and its
distinct (context, symbol) triples, sorted and packed, with their counts in training, to buckets; a bucket adds up what
all chunks post, grows its part of the tree, and answers each chunk with the values of just what it posted. A second
pass over the texts brings each chunk's tokens to its answers; chunks are known by what they hold, so texts that come in
another order the second time (no files, and no written table) are an error and never a wrong score. So what is
shuffled follows the distinct triples of chunks and the tree grows with the corpus, at any size. A bucket takes a range
of the last context symbol, so states, parents and their tests lie in one bucket; buckets follow the number of tokens.
A symbol with more tokens than a bucket should have is split by the symbol before it into groups. What follows it in all
groups is added up first, by ranges of the symbols that follow, and brought to each group, so its first context is one
state whatever the number of groups, and buckets change no score.

Defined results: null text is empty text, the end alone; rows that repeat are scored one by one and alike; without
training rows the base is 0 and every token is unseen; an empty table gives an empty result; a text longer than a chunk
is read in several; other columns pass by unread.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, crc_fold, string_slices, word_hashes

BITS = 20
SYMBOLS = 1 << BITS
#: Tokens of a bucket, about, and bytes of text of a chunk.
BUCKET, CHUNK = 1 << 21, 12_000_000
END, START = np.uint64(0x5D4C1F0E9B3A7701), np.uint64(0xA1B2C3D4E5F60789)
_LAST = np.int64(SYMBOLS - 1)


def symbol(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, byte plane by byte plane."""
    import pyarrow as pa

    gaps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return _squeeze(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_stretch(raw, 8 * n).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_plain(values: np.ndarray) -> bytes:
    """Numbers of any order, compressed byte plane by byte plane."""
    return _squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T))


def unpack_plain(raw: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(_stretch(raw, size * n).reshape(size, n).T).view(kind).ravel()


def _squeeze(data: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd", 1).compress(pa.py_buffer(data.tobytes()), asbytes=True) if data.size else b""


def _stretch(raw: bytes, size: int) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.Codec("zstd").decompress(raw, size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)


class Shape:
    """How symbols are dealt to buckets, from their counts in training: a range of first symbols a bucket, and buckets
    of their own for the groups of a symbol that has more tokens than a bucket should."""

    def __init__(self, seen: np.ndarray, tokens: int, bucket: int = BUCKET):
        self.log = min(BITS, max(0, math.ceil(math.log2(max(1, tokens / bucket)))))
        groups = -(-seen // bucket)
        self.hot = np.flatnonzero(groups > 1)
        self.groups = groups[self.hot].astype(np.int64)
        self.first = (1 << self.log) + np.concatenate([[0], np.cumsum(self.groups)[:-1]]).astype(np.int64)

    def bucket(self, triples: np.ndarray) -> np.ndarray:
        """Of packed (first symbol, symbol before it, symbol)."""
        c1 = triples >> (2 * BITS)
        out = c1 >> (BITS - self.log)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, c1), len(self.hot) - 1)
            hit = self.hot[at] == c1
            before = (triples[hit] >> BITS) & _LAST
            out[hit] = self.first[at[hit]] + ((before * self.groups[at[hit]]) >> BITS)
        return out


def triples(hashes: np.ndarray, start: np.ndarray, before: np.ndarray) -> np.ndarray:
    """(last symbol, the one before it, symbol) of each token as one number. start: first tokens of texts, or of parts of
    texts; before: their two symbols before, last one first."""
    s = symbol(hashes)
    c1, c2 = np.empty_like(s), np.empty_like(s)
    c1[1:], c2[2:] = s[:-1], s[:-2]
    c1[start], c2[start] = before[:, 0], before[:, 1]
    second = start[np.diff(np.append(start, len(s))) > 1]
    c2[second + 1] = c1[second]
    return (c1 << (2 * BITS)) | (c2 << BITS) | s


def grow(keys: np.ndarray, counts: np.ndarray, root: np.ndarray, first: tuple | None = None, flag: bool = False):
    """log10 of the probability of each (context, symbol) of one bucket by the longest retained state. keys: distinct
    triples, sorted; counts: how often each occurs in training; root: the root's distribution. first: for a group of one
    first symbol, what follows it in all groups, as (symbols, counts, their sum, their number, whether it is a state).
    flag: only tell whether a context of two symbols is a state."""
    n = counts.astype(float)
    w = keys & _LAST
    p = root[w]

    def level(context: np.ndarray, pair: np.ndarray, parent: np.ndarray):
        """Smoothed probabilities under the contexts, and which contexts gain enough. pair: numbers the (context, symbol)
        of each key."""
        first = np.zeros(pair.max() + 1, np.int64)
        first[pair] = np.arange(len(pair))
        m = np.bincount(pair, n)
        c, before = context[first], parent[first]
        total = np.bincount(c, m)
        kinds = np.bincount(c, m > 0)
        some = m > 0
        gain = np.bincount(c[some], m[some] * np.log(m[some] / total[c[some]] / before[some]), len(total))
        state = gain > 0.5 * kinds * np.log(np.maximum(total, 2))
        q = (m + kinds[c] * before) / np.maximum(total[c] + kinds[c], 1)
        return q[pair], state

    if not len(keys):
        return False if flag else np.zeros(0)
    c1 = np.unique(keys >> (2 * BITS), return_inverse=True)[1]
    c2 = np.unique(keys >> BITS, return_inverse=True)[1]
    pair1 = np.unique(c1 * np.int64(SYMBOLS) + w, return_inverse=True)[1]
    if first is None:
        q1, state1 = level(c1, pair1, p)
    else:
        after, m, total, kinds, state = first
        at = np.minimum(np.searchsorted(after, w), max(0, len(after) - 1))
        q1 = (np.where(after[at] == w, m[at], 0) if len(after) else 0) + kinds * p
        q1, state1 = q1 / max(total + kinds, 1), np.array([state])
    q2, state2 = level(c2, np.arange(len(keys)), q1)
    if flag:
        return bool(state2.any())
    of1 = np.zeros(c2.max() + 1, np.int64)
    of1[c2] = c1
    state1 |= np.bincount(of1[state2], minlength=len(state1)) > 0
    # A state's distribution is smoothed with its parent's, which a context that is no state leaves to the root.
    q1 = np.where(state1[c1], q1, p)
    if not state1.all():
        q2, _ = level(c2, np.arange(len(keys)), q1)
    return np.log10(np.where(state2[c2], q2, q1))


def _chunks(batches):
    """(row of each part, id, held out, token hashes, first tokens, symbols before) for runs of texts. Rows count from
    the first of the task."""
    row, parts, size = 0, [], 0

    def done():
        rows, ids, held, lengths, hashes, before = zip(*parts)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        return list(rows), list(ids), np.array(held, bool), np.concatenate(hashes), start, np.array(before, np.int64).reshape(-1, 2)

    opening = [int(symbol(START[None])[0])] * 2
    for b in batches:
        ids, held = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, data, off in string_slices(b.column(2)):
            cuts = _cuts(data) if len(off) == 2 else [len(data)]
            at, tail = 0, None
            for cut in cuts:
                whole = len(cuts) == 1
                h, r = word_hashes(data[at:cut], off if whole else np.array([0, cut - at], np.int64))
                bounds = np.searchsorted(r, np.arange(len(off)))
                for k in range(len(off) - 1):
                    mine = h[bounds[k] : bounds[k + 1]]
                    if cut == cuts[-1]:
                        mine = np.append(mine, END)
                    if len(mine):
                        parts.append((row + i + k, ids[i + k], held[i + k], len(mine), mine, tail or opening))
                        s = symbol(mine[-2:]).tolist()[::-1]
                        tail = None if whole or cut == cuts[-1] else (s + (tail or opening))[:2]
                size += cut - at
                at = cut
                if size >= CHUNK:
                    yield done()
                    parts, size = [], 0
        row += b.num_rows
    if parts:
        yield done()


def _cuts(data: np.ndarray) -> list[int]:
    """Ends of parts of one text of about CHUNK bytes, at white space."""
    out, at = [], 0
    while len(data) - at > 2 * CHUNK:
        space = np.flatnonzero((data[at + CHUNK : at + 2 * CHUNK] == 32) | ((data[at + CHUNK : at + 2 * CHUNK] >= 9) & (data[at + CHUNK : at + 2 * CHUNK] <= 13)))
        at += CHUNK + (int(space[0]) if len(space) else CHUNK)
        out.append(at)
    return [*out, len(data)]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(bucket, keys, counts): the distinct tokens of training and how often each occurs, packed; docs: held, text."""
    import pyarrow as pa

    def run(batches):
        for _, _, held, hashes, start, _ in _chunks(batches):
            train = np.repeat(~held, np.diff(np.append(start, len(hashes))))
            keys, n = np.unique(hashes[train], return_counts=True)
            yield pa.RecordBatch.from_pylist([{"bucket": b, "n": len(k), "keys": pack_sorted(k), "counts": pack_plain(c.astype(np.int64))} for b, k, c in _dealt(keys, n, (keys >> np.uint64(58)).astype(np.int64))], _PACKED)

    def add(t):
        n = t.column("n").to_pylist()
        keys = np.concatenate([unpack_sorted(x, m) for x, m in zip(t.column("keys").to_pylist(), n)])
        counts = np.concatenate([unpack_plain(x, m, np.int64) for x, m in zip(t.column("counts").to_pylist(), n)])
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, counts, len(keys)).astype(np.int64)
        sums = np.bincount(symbol(keys), counts, SYMBOLS).astype(np.int64)
        used = np.flatnonzero(sums)
        return pa.table({"tokens": [int(counts.sum())], "kinds": [len(keys)], "once": [int((counts == 1).sum())], "used": [len(used)], "symbols": [pack_sorted(used.astype(np.uint64))], "sums": [pack_plain(sums[used])]}, pa.schema([("tokens", pa.int64()), ("kinds", pa.int64()), ("once", pa.int64()), ("used", pa.int64()), ("symbols", pa.binary()), ("sums", pa.binary())]))

    _PACKED = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    return docs.mapInArrow(run, "bucket long, n long, keys binary, counts binary").groupBy("bucket").applyInArrow(add, "tokens long, kinds long, once long, used long, symbols binary, sums binary")


def _dealt(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray):
    """(bucket, keys, counts) by bucket; keys stay sorted."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b, prepend=-1))
    for lo, hi in zip(cut, [*cut[1:], len(b)]):
        yield int(b[lo]), keys[order[lo:hi]], counts[order[lo:hi]]


def score(docs: DataFrame, train_where, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score."""
    import pyarrow as pa

    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), (~F.coalesce(train_where, F.lit(False))).alias("held"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    seen = np.zeros(SYMBOLS, np.int64)
    total = kinds = once = 0
    for r in count_tokens(texts).toLocalIterator():  # at most 64 rows, each with its own range of SYMBOLS sums
        total, kinds, once = total + r["tokens"], kinds + r["kinds"], once + r["once"]
        seen[unpack_sorted(bytes(r["symbols"]), r["used"]).astype(np.int64)] += unpack_plain(bytes(r["sums"]), r["used"], np.int64)
    shape = Shape(seen, total, bucket)
    unseen = (once + 1) / (total + 2)
    below = math.log10(total + 0.1 * (kinds + 1))
    shared = spark.sparkContext.broadcast((shape, seen))  # SYMBOLS numbers, whatever the corpus
    words_log = min(16, max(4, shape.log))
    arrow = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    fields = "chunk long, kind int, bucket long, n long, keys binary, counts binary"

    def chunks(batches):
        """(number of the chunk, the chunk). The number comes from what the chunk holds: both passes over the texts must
        cut them alike, or their chunks do not meet."""
        import xxhash

        for rows, ids, held, hashes, start, before in _chunks(batches):
            digest = xxhash.xxh64(hashes.tobytes())
            digest.update(start.tobytes() + held.tobytes() + before.tobytes())
            yield np.uint64(digest.intdigest()).astype(np.int64).item(), (rows, ids, held, hashes, start, before)

    def follow(batches):
        """What follows the symbols that are split, by ranges of the symbols that follow."""
        shape = shared.value[0]
        for _, (_, _, held, hashes, start, before) in chunks(batches):
            k = triples(hashes, start, before)[np.repeat(~held, np.diff(np.append(start, len(hashes))))]
            at = np.minimum(np.searchsorted(shape.hot, k >> (2 * BITS)), len(shape.hot) - 1)
            mine = shape.hot[at] == k >> (2 * BITS)
            keys, n = np.unique((at[mine] << BITS) | (k[mine] & _LAST), return_counts=True)
            for b, k, c in _dealt(keys, n, keys >> (BITS - 4)):
                yield pa.RecordBatch.from_pylist([{"bucket": b, "n": len(k), "keys": pack_sorted(k), "counts": pack_plain(c.astype(np.int64))}], pa.schema([arrow.field(c) for c in ("bucket", "n", "keys", "counts")]))

    def unpacked(t):
        n = t.column("n").to_pylist()
        keys = np.concatenate([unpack_sorted(x, m) for x, m in zip(t.column("keys").to_pylist(), n)])
        counts = np.concatenate([unpack_plain(x, m, np.int64) for x, m in zip(t.column("counts").to_pylist(), n)])
        return n, keys, counts

    def followed(t):
        _, keys, counts = unpacked(t)
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, counts, len(keys)).astype(np.int64)
        seen, after = shared.value[1], keys.astype(np.int64) & _LAST
        gain = float((counts * (np.log(counts) - np.log((seen[after] + 0.5) / (seen.sum() + 0.5 * SYMBOLS)))).sum())
        return pa.table([[int(keys[0]) >> BITS], [len(keys)], [int(counts.sum())], [gain], pa.array([pack_sorted(after.astype(np.uint64))], pa.binary()), pa.array([pack_plain(counts)], pa.binary())], ["hot", "n", "total", "gain", "keys", "counts"])

    def to_groups(batches):
        shape = shared.value[0]
        for b in batches:
            for r in b.to_pylist():
                for g in range(int(shape.groups[r["hot"]])):
                    yield pa.RecordBatch.from_pylist([{"chunk": None, "kind": 2, "bucket": int(shape.first[r["hot"]]) + g, "n": r["n"], "keys": r["keys"], "counts": r["counts"]}], arrow)

    def tree(key, t, flag=False):
        """The posts of a bucket and the values of their distinct keys; a group's first context comes without a chunk."""
        (shape, seen), of = shared.value, key[1].as_py() - (1 << shared.value[0].log)
        root, first = (seen + 0.5) / (seen.sum() + 0.5 * SYMBOLS), None
        if of >= 0:
            own = t.filter(t.column("chunk").is_null())
            t = t.filter(t.column("chunk").is_valid())
            if not t.num_rows:
                return t, [], np.zeros(0, np.int64), False if flag else np.zeros(0)
            h = int(np.searchsorted(shape.first, of + (1 << shape.log), side="right")) - 1
            after, m = unpacked(own)[1:] if own.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            order = np.argsort(after)
            first = (after[order].astype(np.int64), m[order], *[x[h] for x in whole.value])
        n, keys, counts = unpacked(t)
        keys, at = np.unique(keys, return_inverse=True)
        return t, n, at, grow(keys.astype(np.int64), np.bincount(at, counts, len(keys)).astype(np.int64), root, first, flag)

    def tell(batches):
        """Kind 0: the chunk's tokens, as places in its sorted distinct ones."""
        import pickle

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for chunk, (rows, ids, held, hashes, start, before) in chunks(batches):
            keys, at = np.unique(hashes, return_inverse=True)
            own = pickle.dumps((part, rows, ids, np.diff(np.append(start, len(hashes))), before, len(keys), pack_sorted(keys)))
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "kind": 0, "bucket": 0, "n": len(hashes), "keys": pack_plain(at.astype(np.int32)), "counts": own}], arrow)

    def post(batches):
        """Kind 1: the chunk's distinct tokens; 2: its distinct triples; with their counts in training."""
        shape = shared.value[0]
        for chunk, (rows, ids, held, hashes, start, before) in chunks(batches):
            train = np.repeat(~held, np.diff(np.append(start, len(hashes))))
            for kind in (1, 2):
                keys, at = np.unique(hashes if kind == 1 else triples(hashes, start, before), return_inverse=True)
                n = np.bincount(at, train, len(keys)).astype(np.int64)
                for b, k, c in _dealt(keys, n, (keys >> np.uint64(64 - words_log)).astype(np.int64) if kind == 1 else shape.bucket(keys)):
                    yield pa.RecordBatch.from_pylist([{"chunk": chunk, "kind": kind, "bucket": b, "n": len(k), "keys": pack_sorted(k), "counts": pack_plain(c)}], arrow)

    def answer(key, t):
        """Each chunk's distinct tokens get their counts in training, its triples their log probabilities."""
        if key[0].as_py() == 2:
            t, n, at, values = tree(key, t)
            values = values.astype(np.float32)
        else:
            n, keys, counts = unpacked(t)
            keys, at = np.unique(keys, return_inverse=True)
            values = np.bincount(at, counts, len(keys)).astype(np.int64)
        chunk = t.column("chunk")
        parts = np.split(values[at], np.cumsum(n)[:-1]) if n else []
        return pa.table([chunk, t.column("kind"), t.column("bucket"), t.column("n"), pa.array([pack_plain(v) for v in parts], pa.binary()), pa.nulls(len(n), pa.binary())], arrow)

    def add_up(t):
        """One row per text, or part of a text, of the chunk."""
        import pickle

        shape, seen = shared.value
        kind, of = np.asarray(t.column("kind")), np.asarray(t.column("bucket"))
        raw, count = t.column("keys"), t.column("n").to_pylist()
        told = np.flatnonzero(kind == 0).tolist()
        if not told or not (kind == 2).any():
            raise RuntimeError("the texts came in another order than before; write them to a table first")
        own = [pickle.loads(t.column("counts")[i].as_py()) for i in told]  # chunks of the same texts have one number
        *_, size, before, distinct, packed = own[0]
        at = unpack_plain(raw[told[0]].as_py(), count[told[0]], np.int32)
        words = unpack_sorted(packed, distinct)
        known = np.zeros(distinct, np.int64)

        def fill(out, which, keys_bucket, kind_of):
            order = np.argsort(keys_bucket, kind="stable")
            sorted_ = keys_bucket[order]
            for i in np.flatnonzero(kind == which):
                lo, hi = np.searchsorted(sorted_, [of[i], of[i] + 1])
                out[order[lo:hi]] = unpack_plain(raw[int(i)].as_py(), count[i], kind_of)

        fill(known, 1, (words >> np.uint64(64 - words_log)).astype(np.int64), np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        hashes = words[at]
        keys, where = np.unique(triples(hashes, start, before), return_inverse=True)
        p = np.zeros(len(keys), np.float32)
        fill(p, 2, shape.bucket(keys), np.float32)
        c = known[at]
        in_class = np.log10(np.maximum(known, 1) / np.maximum(seen[symbol(words)], 1))[at]
        log_p = np.where(c > 0, math.log10(1 - unseen) + p[where] + in_class, math.log10(unseen))
        add = lambda x: np.add.reduceat(x, start)
        sums = [pa.array(size), pa.array(add((c > 0).astype(np.int64))), pa.array(add(np.log10(c + 0.1))), pa.array(add(log_p))]
        return pa.concat_tables([
            pa.table([pa.array([(part << 40) + r for r in rows], pa.int64()), pa.array(ids, schema_id), *sums], ["row", "id", "n_tokens", "n_known", "base", "score"])
            for part, rows, ids, *_ in own
        ])

    from pyspark.sql.pandas.types import to_arrow_type

    schema_id = to_arrow_type(texts.schema["id"].dataType)
    posted, whole = texts.mapInArrow(post, fields), None
    if len(shape.hot):
        after = texts.mapInArrow(follow, "bucket long, n long, keys binary, counts binary").groupBy("bucket").applyInArrow(followed, "hot long, n long, total long, gain double, keys binary, counts binary").persist()
        total1, kinds1, gain1 = (np.zeros(len(shape.hot)) for _ in range(3))
        for r in after.groupBy("hot").agg(F.sum("total").alias("t"), F.sum("n").alias("n"), F.sum("gain").alias("g")).toLocalIterator():  # a row for each split symbol
            total1[r["hot"]], kinds1[r["hot"]], gain1[r["hot"]] = r["t"], r["n"], r["g"] - r["t"] * math.log(r["t"])
        state1 = gain1 > 0.5 * kinds1 * np.log(np.maximum(total1, 2))
        whole = spark.sparkContext.broadcast((total1, kinds1, state1))
        posted = posted.unionByName(after.mapInArrow(to_groups, fields))
        if not state1.all():  # it is one if a longer context is, in any group
            def longer(key, t):
                return pa.table([[key[1].as_py()], [tree(key, t, flag=True)[3]]], ["bucket", "any"])

            least = [int(shape.first[h]) + g for h in np.flatnonzero(~state1) for g in range(int(shape.groups[h]))]
            for r in posted.where((F.col("kind") == 2) & F.col("bucket").isin(least)).groupBy("kind", "bucket").applyInArrow(longer, "bucket long, any boolean").where("any").collect():
                state1[np.searchsorted(shape.first, r["bucket"], side="right") - 1] = True
            whole = spark.sparkContext.broadcast((total1, kinds1, state1))
    answered = posted.groupBy("kind", "bucket").applyInArrow(answer, fields)
    parts = answered.unionByName(texts.mapInArrow(tell, fields)).groupBy("chunk").applyInArrow(add_up, f"row long, id {id_type}, n_tokens long, n_known long, base double, score double")
    out = parts.groupBy("row").agg(F.first("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score")


def judge(docs: DataFrame, stash: Stash, id_col: str = "doc_id") -> DataFrame:
    """Learns from nine of ten folds of ids and scores every document."""
    held = crc_fold(id_col, 10) == 0
    return score(docs, ~held, id_col).select(id_col, held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
