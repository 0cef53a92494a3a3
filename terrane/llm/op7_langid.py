"""Language ID by hierarchical discrimination: linear support vector machines predict the language family, then
one-versus-one machines tell the languages of that family apart.

Features are relative frequencies of hashed byte n-grams (orders 1 to 4; A-Z lower-cased, ASCII that is no letter as one
space) over the whole text, so a score is a sum over positions and texts of any length take bounded memory. The machines
are fitted on the driver on a bounded sample of labelled rows: at most about SAMPLE documents in all, drawn by a hash of
the id with an equal share for each language; beside each whole document a short window of it is learnt from, so that
short texts are told apart too. The model is a matrix of BUCKETS rows and one column a machine.

Defined results: text that is null or has no letter is `und` with score 0; without any labelled row all are `und`; rows
with null language are scored and never learnt from; one learnt language is predicted throughout; repeated rows are
scored alike; languages that tie go in alphabetical order; a text of any length is summed span by span; an empty table gives an
empty result; other columns pass by unread.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, string_slices

#: Most documents to learn from, about; shared equally by the languages.
SAMPLE = 1200
BUCKETS = 1 << 12
ORDERS = (1, 2, 3, 4)
WINDOW = 90
#: Bytes of a text that are looked at at once.
SPAN = 500_000

# Families of languages by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "semitic": ("ar", "he", "mt", "am"),
    "celtic": ("ga", "cy", "gd", "br"),
    "austronesian": ("id", "ms", "tl", "jv"),
}
_FAMILY = {c: f for f, codes in FAMILIES.items() for c in codes}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def _grams(data: np.ndarray, off: np.ndarray):
    """For each order: (bucket of each position, first position of each row). A row shorter than the order has none."""
    b = _FOLD[data].astype(np.uint32)
    key = b
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            key = (key[:-1] << np.uint32(8)) | b[n - 1 :]
        if n in ORDERS:
            yield n, ((key ^ np.uint32(n * 0x11ED270B)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)


def _row_sums(values: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values (positions x k) over the n-grams inside each row, and how many there are."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    start = np.minimum(off[:-1], len(values))
    end = np.minimum(np.maximum(off[1:] - n + 1, off[:-1]), len(values))
    return total[end] - total[start], (end - start)


def _windows(data: np.ndarray, off: np.ndarray):
    """(bytes, offsets, n-grams of each order to take at most) of runs of rows, or of spans of one long row."""
    if len(off) != 2 or len(data) <= SPAN:
        yield data, off, None
        return
    for at in range(0, len(data), SPAN):
        part = data[at : at + SPAN + max(ORDERS) - 1]
        yield part, np.array([0, len(part)]), SPAN


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Dense rows of relative frequencies, for learning."""
    out = np.zeros((len(off) - 1, BUCKETS), np.float32)
    size = np.diff(off)
    for part, ends, most in _windows(data, off):
        for n, bucket in _grams(part, ends):
            for r in range(len(ends) - 1):
                own = bucket[ends[r] : max(ends[r], ends[r + 1] - n + 1)][:most]
                if len(own):
                    out[r] += np.bincount(own, minlength=BUCKETS)[:BUCKETS] / ((size[r] - n + 1) * len(ORDERS))
    return out


def scores(data: np.ndarray, off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """features() @ weights without the features."""
    out = np.zeros((len(off) - 1, weights.shape[1]))
    size = np.diff(off)
    for part, ends, most in _windows(data, off):
        for n, bucket in _grams(part, ends):
            if most is None:
                s, _ = _row_sums(weights[bucket], ends, n)
            else:
                s = weights[bucket[:most]].sum(0, dtype=np.float64)[None]
            out += s / np.maximum(size - n + 1, 1)[:, None] / len(ORDERS)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, sweeps: int = 40, seed: int = 0) -> np.ndarray:
    """Weights of an L2-regularised hinge-loss machine, by dual coordinate descent; classes weigh the same."""
    rng = np.random.default_rng(seed)
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    q = np.einsum("ij,ij->i", x, x)
    a, w = np.zeros(len(y)), np.zeros(x.shape[1], x.dtype)
    for _ in range(sweeps):
        moved = 0.0
        for i in rng.permutation(len(y)):
            if q[i] <= 0:
                continue
            new = min(max(a[i] - (y[i] * float(w @ x[i]) - 1) / float(q[i]), 0.0), cost[i])
            if new != a[i]:
                w += x.dtype.type((new - a[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    """Columns of `weights`: a machine for each family (if several), then one for each pair of languages inside one."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        fam = [family(l) for l in langs]
        self.families = sorted(set(fam))
        lang_a, fam_a = np.array(langs, object), np.array(fam, object)
        scale = (1 / np.sqrt(x.mean(0) + 1e-5) if len(x) else np.ones(BUCKETS)).astype(np.float32)
        x *= scale  # in place: the sample is the driver's largest array
        columns, steep, self.pairs = [], [], []
        if len(self.families) > 1:
            for f in self.families:
                y = np.where(fam_a == f, 1.0, -1.0)
                columns.append(linear_svm(x, y))
        for f in self.families:
            own = sorted({l for l in self.langs if family(l) == f})
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    at = (lang_a == a) | (lang_a == b)
                    columns.append(linear_svm(x[at], np.where(lang_a[at] == a, 1.0, -1.0)))
                    self.pairs.append((a, b))
        self.weights = (np.stack(columns, 1) * scale[:, None]).astype(np.float32) if columns else np.zeros((BUCKETS, 0), np.float32)

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(margins)
        k = len(self.families) if len(self.families) > 1 else 0
        p_family = np.ones((n, len(self.families)))
        if k:
            e = np.exp(2 * np.clip(margins[:, :k], -20, 20))
            p_family = e / e.sum(1, keepdims=True)
        best_family = p_family.argmax(1)
        mass = {l: np.zeros(n) for l in self.langs}
        for j, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-2 * np.clip(margins[:, k + j], -20, 20)))
            mass[a] += p
            mass[b] += 1 - p
        fam_of = np.array([self.families.index(family(l)) for l in self.langs])
        size = np.bincount(fam_of, minlength=len(self.families))
        m = np.stack([mass[l] / max(1, size[f] - 1) if size[f] > 1 else np.ones(n) for l, f in zip(self.langs, fam_of)], 1)
        m = np.where(fam_of[None, :] == best_family[:, None], m, -1.0)
        best = m.argmax(1)
        return [self.langs[i] for i in best], np.clip(p_family[np.arange(n), best_family] * m[np.arange(n), best], 0, 1)


def fit(rows: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the given rows that have text and language; which rows those are is the caller's choice."""
    import pyarrow as pa

    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    # With more languages than the sample has room for, those with the most documents are learnt.
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not have:
        return Model(np.zeros((0, BUCKETS), np.float32), [])
    each = max(1, sample // len(have))
    share = F.create_map(*[F.lit(v) for l, n in have.items() for v in (l, min(1.0, each / n))])
    drawn = rows.where(F.col("lang").isin(*have)).where(F.pmod(F.col("h"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def run(batches):
        for b in batches:
            langs = b.column(1).to_pylist()
            for i, data, off in string_slices(b.column(2)):
                length = np.diff(off)
                x = features(data, off)
                starts = off[:-1] + (b.column(0).to_numpy()[i : i + len(length)].astype(np.uint64) % np.maximum(1, length - WINDOW).astype(np.uint64)).astype(np.int64)
                cut = [data[s : min(s + WINDOW, e)] for s, e in zip(starts, off[1:])]
                short = features(np.concatenate(cut) if cut else data, np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64))
                packed = [r.tobytes() for r in np.concatenate([x, short]).astype(np.float16)]
                yield pa.RecordBatch.from_arrays([pa.array(langs[i : i + len(length)] * 2, pa.string()), pa.array(packed, pa.binary())], ["lang", "x"])

    def train(t):  # the sample, bounded, in one task
        langs, packed = t.column("lang").to_pylist(), [v for c in t.column("x").chunks for v in c]
        order = sorted(range(len(langs)), key=lambda i: (langs[i], bytes(packed[i].as_buffer())))  # the same model whatever the order of tasks
        x = np.empty((len(langs), BUCKETS), np.float32)
        for r, i in enumerate(order):
            x[r] = np.frombuffer(packed[i].as_buffer(), np.float16)
        return pa.table({"model": [pickle.dumps(Model(x, [langs[i] for i in order]))]})

    learnt = drawn.select("h", "lang", "text").mapInArrow(run, "lang string, x binary").select(F.lit(0).alias("all"), "lang", "x").groupBy("all").applyInArrow(train, "model binary").collect()
    return pickle.loads(learnt[0]["model"]) if learnt else Model(np.zeros((0, BUCKETS), np.float32), [])


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, then the predicted language and its score under the given names."""
    import pyarrow as pa
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = list(dict.fromkeys([*keep, text_col]))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches):
        model = shared.value
        for b in batches:
            text = b.column(cols.index(text_col))
            lang, score = [], []
            for i, data, off in string_slices(text):
                if model.langs:
                    l, s = model.predict(scores(data, off, model.weights))
                else:
                    l, s = ["und"] * (len(off) - 1), np.zeros(len(off) - 1)
                for r in range(len(off) - 1):
                    ok = model.langs and any(c.isalpha() for c in (text[i + r].as_py() or ""))
                    lang.append(l[r] if ok else "und")
                    score.append(float(s[r]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([*[b.column(cols.index(c)) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    return docs.select(*cols).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document, learnt from three of four folds of ids."""
    held = crc_fold(id_col, 4) == 2
    model = fit(docs.where(~held), id_col=id_col)
    return predict(docs, model, [id_col]).select(id_col, (crc_fold(id_col, 4) == 2).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, id_col: str = "doc_id", odds: float = 1.4) -> DataFrame:
    """The rows of docs, all columns, whose language is known: neither `und` nor with a score of less than `odds` times
    an even share among the learnt languages (half at most), which says next to nothing of any language."""
    model = fit(docs.where(crc_fold(id_col, 4) != 2), id_col=id_col)
    least = min(0.5, odds / max(1, len(model.langs)))
    known = predict(docs, model, docs.columns, names=("__lang", "__score"))
    return known.where((F.col("__lang") != "und") & (F.col("__score") >= least)).select(*docs.columns)
