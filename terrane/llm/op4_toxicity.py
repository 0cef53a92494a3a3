"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index; distance-weighted votes,
calibrated, with the neighbours as evidence.

Terms are byte 5-grams over the folded text (A-Z lower-cased, ASCII that is no letter as one space each), as exact 40-bit
numbers, each taken with how often it occurs: once at least, twice, four times. Of these the vocabulary keeps all that are
associated with the label in the examples (chi-square at least CHI, in LEAST_DF examples at least); on invented or
inflected words this keeps stems, and what all texts share falls away. The bounded examples bound the vocabulary.
Examples are a bounded sample of labelled rows: about MOST_POSITIVE and MOST_NEGATIVE at most, drawn by a hash of the id;
votes are weighted back to the label's true shares. Document frequencies are counted over all documents.

The index is postings by (term, block of examples) with each term's largest weight in each block. For a text, the block of
the highest upper bound is scored first, then all blocks whose bound reaches the k-th best similarity there, so the k
nearest are exact.
Votes go through an isotonic curve fitted on leave-one-out votes of the examples. Texts without any term of the
vocabulary take the calibrated rate of such examples.

Examples with one text are one example, so a text with many copies is no evidence about its words.

Defined results: null text is empty text; labels that are null are unlabelled; of several labels for one id the largest
counts; without labelled rows every score is 0, and with one class alone it is that class's; repeated rows are scored
alike; ids must be numbers; a text of any length is cut into grams span by span; examples of equal similarity are taken
in the order of the index (toxic ones first, then by id); an empty table gives an empty result; other columns pass by
unread.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, crc_fold, string_slices
from .op7_langid import _FOLD

#: Most examples of either label, about.
MOST_POSITIVE, MOST_NEGATIVE = 1200, 2400
CHI, LEAST_DF = 30.0, 5
#: Bytes of a text that are cut into grams at once.
SPAN = 500_000
GRAM, BLOCK, NEIGHBOURS = 5, 512, 25
#: Occurrences from which a gram is a term of its own.
LEVELS = (1, 2, 4)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 5-grams as numbers, and the row of each. None crosses rows; each row is taken as between two spaces."""
    n = len(off) - 1
    b = np.full(len(data) + 2 * n, 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(off) + 2)
    b[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))] = _FOLD[data]
    m = max(0, len(b) - GRAM + 1)
    key = np.zeros(m, np.uint64)
    for j in range(GRAM):
        key = (key << np.uint64(8)) | b[j : j + m].astype(np.uint64)
    inside = row[: len(b) - GRAM + 1] == row[GRAM - 1 :]
    return key[inside], row[:m][inside]


def gram_spans(data: np.ndarray, off: np.ndarray):
    """(5-grams, rows) in pieces of bounded size: a long text is cut into overlapping spans, so that each of its grams is
    in one of them."""
    if len(off) != 2 or len(data) <= SPAN:
        yield grams(data, off)
        return
    for at in range(0, len(data), SPAN):
        part = data[at : at + SPAN + GRAM - 1]
        key, row = grams(part, np.array([0, len(part)]))
        first, last = at == 0, at + SPAN >= len(data)
        key = key[0 if first else 1 : len(key) if last else len(key) - 1]  # the spaces around a span are none of the text
        yield key, row[: len(key)]


class Vocabulary:
    """Terms are gram * 4 + level."""

    def __init__(self, terms: np.ndarray):
        terms = np.sort(terms.astype(np.uint64))
        self.size = len(terms)
        self.keys, at = np.unique(terms >> np.uint64(2), return_inverse=True)
        self.term = np.full((len(self.keys), len(LEVELS)), -1)
        self.term[at, (terms & np.uint64(3)).astype(np.int64)] = np.arange(len(terms))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys * _MULT) >> np.uint64(44)] = True

    def counts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times), sorted by row and term."""
        none = np.zeros(0, np.int64)
        if not self.size:
            return none, none, none
        codes = []
        for key, row in gram_spans(data, off):
            at = np.flatnonzero(self.bits[(key * _MULT) >> np.uint64(44)])
            k = key[at]
            i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            ok = self.keys[i] == k
            codes.append(row[at[ok]].astype(np.int64) * len(self.keys) + i[ok])
        code, times = np.unique(np.concatenate(codes), return_counts=True)
        row, gram = code // len(self.keys), code % len(self.keys)
        parts = []
        for l, least in enumerate(LEVELS):
            term = self.term[gram, l]
            hit = (times >= least) & (term >= 0)
            parts.append((row[hit], term[hit], times[hit]))
        row, term, times = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((term, row))
        return row[order], term[order], times[order]


class Index:
    """Block-max postings of the examples, and the calibration."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        self.vocabulary, self.idf, self.ids, self.labels, self.weights = vocabulary, idf, ids, labels, weights
        n, t = len(rows), len(idf)
        self.blocks = max(1, -(-n // BLOCK))
        vectors = [self.vector(term, times) for term, times in rows]
        ex = np.repeat(np.arange(n), [len(term) for term, _ in vectors])
        term = np.concatenate([x for x, _ in vectors]) if n else np.zeros(0, np.int64)
        w = np.concatenate([x for _, x in vectors]) if n else np.zeros(0)
        order = np.lexsort((ex, term))
        self.ex, self.w = ex[order].astype(np.int64), w[order]
        cell = term[order] * self.blocks + self.ex // BLOCK
        self.ptr = np.searchsorted(cell, np.arange(t * self.blocks + 1))
        self.most = np.zeros(t * self.blocks)
        np.maximum.at(self.most, cell, self.w)
        self.most = self.most.reshape(t, self.blocks)
        self.prior = float((weights * labels).sum() / weights.sum()) if n else 0.0
        none = np.array([len(term) == 0 for term, _ in vectors], bool)
        self.bare = float((weights * labels)[none].sum() + self.prior) / float(weights[none].sum() + 1) if n else 0.0
        raw = np.array([self.vote(*v, skip=i)[0] if len(v[0]) else np.nan for i, v in enumerate(vectors)])
        self.curve = _isotonic(raw[~none], labels[~none], weights[~none]) if (~none).any() else (np.array([0.0, 1.0]), np.array([self.prior] * 2))

    def vector(self, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(times)) * self.idf[term]
        norm = np.sqrt((w * w).sum())
        return (term, w / norm) if norm > 0 else (term[:0], w[:0])

    def nearest(self, term: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0, exactly; ties go to the earlier example."""
        bound = w @ self.most[term]
        order = np.argsort(-bound, kind="stable")
        best_i, best_s = self._visit(term, w, order[:1], skip)  # the most promising block gives the bar for the others
        bar = np.sort(best_s)[-k] - 1e-12 if len(best_s) >= k else 0.0
        rest = order[1:][(bound[order[1:]] > 0) & (bound[order[1:]] >= bar)]
        if len(rest):
            i, s = self._visit(term, w, rest, skip)
            best_i, best_s = np.concatenate([best_i, i]), np.concatenate([best_s, s])
        top = np.lexsort((best_i, -best_s))[:k]
        return best_i[top], best_s[top]

    def _visit(self, term: np.ndarray, w: np.ndarray, blocks: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the blocks with a cosine above 0, and the cosines."""
        cell = (term[:, None] * self.blocks + blocks[None, :]).ravel()
        lo, size = self.ptr[cell], self.ptr[cell + 1] - self.ptr[cell]
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        ex = self.ex[at]
        s = np.bincount(ex, np.repeat(np.repeat(w, len(blocks)), size) * self.w[at], len(self.ids))
        hit = np.flatnonzero(s > 0)
        hit = hit[hit != skip]
        return hit, s[hit]

    def vote(self, term, w, skip: int = -1):
        i, s = self.nearest(term, w, skip=skip)
        mass = s * self.weights[i]
        return float(((mass * self.labels[i]).sum() + 0.1 * self.prior) / (mass.sum() + 0.1)), i, s

    def score(self, term: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(score, neighbours, similarities)."""
        term, w = self.vector(term, times)
        if not len(term):
            return self.bare, np.zeros(0, np.int64), np.zeros(0)
        raw, i, s = self.vote(term, w)
        return float(0.99 * np.interp(raw, *self.curve) + 0.01 * raw), i, s


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a non-decreasing curve through weighted means (pooled adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([float(w[i]), float(w[i] * y[i]), float(x[i]), float(x[i])])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            a, b = pools.pop(), pools.pop()
            pools.append([a[0] + b[0], a[1] + b[1], b[2], a[3]])
    xs, ys = [], []
    for weight, hits, low, high in pools:
        p = (hits + 0.01) / (weight + 0.02)
        xs += [low, high] if high > low else [low]
        ys += [p, p] if high > low else [p]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def fit(docs: DataFrame, labels: DataFrame, train, stash: Stash, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """Learns from labelled rows that satisfy `train`, a condition on the id column."""
    import pyarrow as pa

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train).groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("label"))
    have = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = {1: min(1.0, MOST_POSITIVE / max(1, have.get(1, 0))), 0: min(1.0, MOST_NEGATIVE / max(1, have.get(0, 0)))}
    share = F.when(F.col("label") == 1, rate[1]).otherwise(rate[0])
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))  # bounded by the two numbers above
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Copies of one text are one example, with the largest label and id of theirs.
    sample = texts.join(F.broadcast(drawn), "id").groupBy("text").agg(F.max("label").alias("label"), F.max("id").alias("id"))
    sample = stash.put(sample.select("id", "text", "label"), "examples")

    def presence(batches):
        for b in batches:
            label = b.column(1).to_numpy()
            for i, data, off in string_slices(b.column(0)):
                key, row = _levels(gram_spans(data, off))
                keys, at = np.unique(key, return_inverse=True)
                pos = np.bincount(at, label[i + row], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64))], ["key", "pos", "n"])

    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    df = sample.select("text", "label").mapInArrow(presence, "key long, pos long, n long").groupBy("key").agg(F.sum("pos").alias("a"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DF)
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    c, d = F.lit(float(n1)) - a, F.lit(float(n0)) - b
    chi = (n1 + n0) * F.pow(a * d - b * c, 2) / F.greatest((a + b) * (c + d) * F.lit(float(max(1, n1))) * F.lit(float(max(1, n0))), F.lit(1.0))
    best = df.withColumn("chi", chi).where(F.col("chi") >= CHI).select("key").collect()
    vocabulary = Vocabulary(np.array([r["key"] for r in best], np.int64).view(np.uint64) if best else np.zeros(0, np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        size = shared.value.size
        total, rows = np.zeros(size, np.int64), 0
        for b in batches:
            for _, data, off in string_slices(b.column(0)):
                _, term, _ = shared.value.counts(data, off)
                total += np.bincount(term, minlength=size)
                rows += len(off) - 1
        yield pa.RecordBatch.from_arrays([pa.array([*np.flatnonzero(total), -1], pa.int64()), pa.array([*total[total > 0], rows], pa.int64())], ["term", "n"])

    freq = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + freq.get(-1, 0)) / (1 + np.array([freq.get(i, 0) for i in range(vocabulary.size)], float))) + 1

    def vectors(batches):
        for b in batches:
            for i, data, off in string_slices(b.column(2)):
                row, term, times = shared.value.counts(data, off)
                cut = np.searchsorted(row, np.arange(len(off)))
                part = lambda x, r: x[cut[r] : cut[r + 1]].astype(np.int64).tolist()
                rows = range(len(off) - 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(off) - 1), b.column(1).slice(i, len(off) - 1), pa.array([part(term, r) for r in rows], pa.list_(pa.int64())), pa.array([part(times, r) for r in rows], pa.list_(pa.int64()))], ["id", "label", "terms", "times"])

    got = sorted(sample.select("id", "label", "text").mapInArrow(vectors, "id long, label int, terms array<long>, times array<long>").collect(), key=lambda r: (-r["label"], r["id"]))  # like examples share blocks
    labels_ = np.array([r["label"] for r in got], float)
    weights = np.where(labels_ == 1, 1 / max(rate[1], 1e-12), 1 / max(rate[0], 1e-12))
    weights = weights / weights.mean() if len(weights) else weights
    rows = [(np.array(r["terms"], np.int64), np.array(r["times"], np.int64)) for r in got]
    return Index(vocabulary, idf, rows, np.array([r["id"] for r in got], np.int64), labels_, weights)


def _levels(spans) -> tuple[np.ndarray, np.ndarray]:
    """The terms that each row has, once each."""
    parts = []
    for key, row in spans:
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
        parts.append((key[start], row[start], np.diff(np.append(start, len(key)))))
    key, row, times = (np.concatenate(x) for x in zip(*parts))
    if len(parts) > 1:  # spans of one text
        key, at = np.unique(key, return_inverse=True)
        row, times = row[: len(key)], np.bincount(at, times, len(key))
    parts = [(key[times >= least] * np.uint64(4) + np.uint64(l), row[times >= least]) for l, least in enumerate(LEVELS)]
    return np.concatenate([k for k, _ in parts]), np.concatenate([r for _, r in parts])


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", evidence: int = 5) -> DataFrame:
    """One row per document: id, score, evidence (ids and similarities of the nearest examples)."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())]))

    def run(batches):
        index = shared.value
        for b in batches:
            scores, why = [], []
            for _, data, off in string_slices(b.column(1)):
                row, term, times = index.vocabulary.counts(data, off)
                cut = np.searchsorted(row, np.arange(len(off)))
                for r in range(len(off) - 1):
                    p, i, s = index.score(term[cut[r] : cut[r + 1]], times[cut[r] : cut[r + 1]])
                    scores.append(p)
                    why.append([{"doc_id": int(index.ids[j]), "similarity": float(x)} for j, x in zip(i[:evidence], s)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(why, kind)], [id_col, "score", "evidence"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double, evidence array<struct<doc_id: long, similarity: double>>")


def judge(docs: DataFrame, labels: DataFrame, stash: Stash, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """Learns from three of four folds of ids and scores every document."""
    held = crc_fold(id_col, 4) == 2
    out = score(docs, fit(docs, labels, ~held, stash, id_col), id_col)
    return out.select(id_col, held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence")
