"""Best-fit packing by exact-complement hashing.

Documents are tokenised where they are read; what remains of each is a few numbers per piece. Pieces of one length are
interchangeable, so the plan is made on the histogram of lengths alone (at most `size` counts, on the driver): for the
longest piece left, its gap is looked up among single lengths, then sums of two, then of three, and combinations that
fill the gap exactly are used up as often as the counts allow; what finds no exact complement is placed best-fit. The
plan is a list of patterns with multiplicities. Pieces get their places by their rank within their length; ranks come
from counts per (length, salt), so a length that a third of all pieces have is dealt over many tasks.

Defined results: a null or empty text is the end token alone; ids need not be distinct, every row has its own pieces;
an empty table gives an empty result; other columns pass by unread. Ranks within a length follow (id, piece, row), so the
places are the same in every run unless rows repeat.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash

SIZE, END = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker remembers at least; past it, those not met again are forgotten.
REMEMBERED = 250_000
_coders: dict[str, "Coder"] = {}


class Coder:
    """The ids of texts, word by word. The tokenizer drops white space and never looks across it, so the ids of a text
    are those of its words one after another, and a worker encodes each distinct word once. Where the tokenizer folds
    case, words are folded first; where it always parts letters from what follows them, a word is its stem and its
    trailing punctuation."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        made = json.loads(self.tok.to_str())
        self.folds = '"Lowercase"' in json.dumps(made["normalizer"])
        self.parts = "[\\\\p{L}]+|" in json.dumps(made["pre_tokenizer"])
        special = [x for x in made["added_tokens"] if x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"])]
        self.mark = (special[0]["content"], special[0]["id"]) if special else None
        vocabulary = self.tok.get_vocab()
        suffix = made["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if suffix and self.parts else None
        if self.ends is not None:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.ends is not None:  # words of letters alone are one piece each, whose last id ends a word
            plain = [i for i, t in enumerate(texts) if t.isalpha()]
            ids = self._at_once(" ".join([texts[i] for i in plain]))
            if self._cut([words[i] for i in plain], ids, np.flatnonzero(self.ends[ids]) + 1, 0):
                rest = set(range(len(texts))).difference(plain)
                words, texts = [words[i] for i in rest], [texts[i] for i in rest]
        if self.mark and texts and not any("<" in t for t in texts):  # kept apart by a token that none of them holds
            text, number = self.mark
            ids = self._at_once(text.join(texts))
            if self._cut(words, ids, np.append(np.flatnonzero(ids == number), len(ids)), 1):
                return
        for w, e in zip(words, self.tok.encode_batch(texts, add_special_tokens=False)):
            self.known[w] = np.asarray(e.ids, "<u4").tobytes()

    def _at_once(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _cut(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> bool:
        """Gives each word its ids if there are as many ends as words."""
        if len(ends) != len(words):
            return False
        raw, start = ids.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist()):
            self.known[w] = raw[start:end]
            start = end + 4 * gap
        return True

    def _learn(self, fresh: list[bytes]) -> None:
        known, split, need = self.known, [], {}
        for w in fresh:
            stem = w.rstrip(b".,;:!?") if self.parts else w
            if stem != w and stem and (stem[-1:].isalpha() or stem[-1] > 127 and stem.decode("utf-8", "replace")[-1].isalpha()):
                tail = w[len(stem) :]
                split.append((w, stem, tail))
                for x in (stem, tail):
                    if x not in known:
                        if x in self.old:
                            known[x] = self.old[x]
                        else:
                            need[x] = None
            else:
                need[w] = None
        words = list(need)
        for i in range(0, len(words), 5000):
            self._encode(words[i : i + 5000])
        for w, stem, tail in split:
            known[w] = known[stem] + known[tail]

    def words(self, text: str | None) -> list[bytes]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return (raw.lower() if self.folds else raw).split()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = list(map(self.words, texts))
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        fresh = set().union(*split).difference(self.known)
        if self.old:
            again = fresh.intersection(self.old)
            self.known.update(zip(again, map(self.old.__getitem__, again)))
            fresh -= again
        self._learn(list(fresh))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in split]


def token_bytes(texts, tokenizer_path: str):
    """The ids of each text of an Arrow array as bytes."""
    coder = _coders.get(tokenizer_path)
    if coder is None:
        coder = _coders[tokenizer_path] = Coder(tokenizer_path)
    for i in range(0, len(texts), 500):
        yield from coder.ids(texts.slice(i, 500).to_pylist())


def pieces_of(ids: bytes, size: int = SIZE, end: int = END):
    """(piece, start, length, crc32) of one document's ids and its end token; only longer ones are cut."""
    ids += int(end).to_bytes(4, "little")
    for k, at in enumerate(range(0, len(ids), 4 * size)):
        part = ids[at : at + 4 * size]
        yield k, k * size, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for i, x in zip(ids, token_bytes(b.column(1), tokenizer_path)):
                rows += [(i, *p) for p in pieces_of(x, size, end)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) patterns that use up all counts, no pattern over size tokens."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def take(parts: list[int]) -> None:
        """Uses the combination as often as the counts allow."""
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        times = min(int(left[p]) // k for p, k in need.items())
        for p, k in need.items():
            left[p] -= k * times
        out.append((times, sorted(need.items(), reverse=True)))

    def pair(total: int, but: dict[int, int]) -> tuple[int, int] | None:
        """The two lengths with this sum whose longer one is longest, counting what `but` has used already."""
        if total < 2:
            return None
        have = left.copy()
        for p, k in but.items():
            have[p] -= k
        a = np.arange((total + 1) // 2, min(total, size + 1))
        ok = (have[a] > 0) & (have[total - a] > (a == total - a))
        hit = np.flatnonzero(ok)
        return (int(a[hit[-1]]), int(total - a[hit[-1]])) if len(hit) else None

    def pair_sums() -> np.ndarray:
        have = np.fft.rfft((left > 0).astype(float), 4 * size)
        return np.fft.irfft(have * have, 4 * size)[: size + 1] > 0.5

    sums, sums_at = pair_sums(), 0
    hopeless: list[int] = []
    for first in range(size, 0, -1):
        while left[first]:
            gap = size - first
            if gap == 0:
                take([first])
                continue
            if left[gap] > (gap == first):
                take([first, gap])
                continue
            two = pair(gap, {first: 1})
            if two:
                take([first, *two])
                continue
            three = None
            if gap > 2:
                if len(out) >= sums_at + 64:  # sums of two lengths; counts only fall, so an old index errs to one side
                    sums, sums_at = pair_sums(), len(out)
                for a in np.flatnonzero((left[: gap - 1] > 0) & sums[gap : 1 : -1])[::-1]:
                    if left[a] - (a == first) > 0 and (two := pair(gap - int(a), {first: 1, **{int(a): 1 + (a == first)}})):
                        three = (int(a), *two)
                        break
            if three:
                take([first, *three])
                continue
            break
        if left[first]:
            hopeless.append(first)
    # The rest, longest first, into the fullest sequence that still has room; equal sequences are kept as one entry.
    open_at: dict[int, list[list]] = defaultdict(list)  # room -> [times, parts]
    rooms = np.zeros(size + 1, bool)
    for length in hopeless:
        n = int(left[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = int(fits[0]) + length
                times, parts = open_at[room].pop()
                rooms[room] = bool(open_at[room])
            else:
                room, times, parts = size, n, {}
                times = -(-n // (size // length))
            each = room // length  # as many copies as fit while there are any
            whole = min(times, n // each)
            for m, k in ((whole, each), (1 if whole < times and n - whole * each else 0, n - whole * each)):
                if m:
                    more = dict(parts)
                    more[length] = more.get(length, 0) + k
                    open_at[room - k * length].append([m, more])
                    rooms[room - k * length] = True
                    n -= m * k
                    times -= m
            if times and parts:
                open_at[room].append([times, parts])
                rooms[room] = True
        left[length] = 0
    for entries in open_at.values():
        out += [(m, sorted(parts.items(), reverse=True)) for m, parts in entries]
    return out


def slots(patterns) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, first sequence, copies a sequence, offset)]: rank r lies in sequence
    first + (r - first rank) // copies at offset + (r - first rank) % copies * length."""
    out, rank, sequence = defaultdict(list), defaultdict(int), 0
    for times, parts in patterns:
        at = 0
        for length, k in parts:
            out[length].append((rank[length], sequence, k, at))
            rank[length] += times * k
            at += k * length
        sequence += times
    return out


def pack(docs: DataFrame, stash: Stash, tokenizer_path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import pyarrow as pa

    spark = docs.sparkSession
    cut = stash.put(pieces(docs, tokenizer_path, size, end, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")), "pieces")
    # At most size x salts counts, whatever the number of documents.
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()
    by_length: dict[int, int] = defaultdict(int)
    base = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["salt"])):
        base[r["length"], r["salt"]] = by_length[r["length"]]
        by_length[r["length"]] += r["n"]
    place = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots(plan(by_length, size)).items()}
    shared = spark.sparkContext.broadcast((base, place))
    ranked = cut.withColumn("rank", F.row_number().over(_by("length", "salt", order=("doc_id", "piece", "ids_crc32"))) - 1)

    def run(batches):
        base, place = shared.value
        for b in batches:
            length, salt = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "salt"))
            rank = b.column(b.schema.get_field_index("rank")).to_numpy().astype(np.int64)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            rank = rank + np.fromiter((base[k] for k in zip(length.tolist(), salt.tolist())), np.int64, len(length))
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                first, sequence, copies, offset = place[int(value)]
                k = np.searchsorted(first, rank[at], "right") - 1
                d = rank[at] - first[k]
                seq[at] = sequence[k] + d // copies[k]
                off[at] = offset[k] + d % copies[k] * value
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def _by(*cols, order):
    from pyspark.sql import Window

    return Window.partitionBy(*cols).orderBy(*order)
