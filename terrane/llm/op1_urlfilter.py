"""URL filters: a sorted array of 64-bit xxhash digests, memory-mapped, probed by vectorised binary search and confirmed
on the stored strings.

Rules are hosts with path prefixes. They are written once, as one file, to the folder that executors share: the sorted
digests, then where each rule's string lies, then the strings. Spark ships the file to every executor, where workers map
it; no rule list is ever held in a process's memory. For a url, each suffix of its host (whole labels) is joined with its
path cut at each length that rule paths have; those candidates are hashed and searched, and a hit counts only if the
stored string is the candidate itself. Of all hits the longest rule (host and path together) wins, and of equally long
ones that with the longer host.

Defined results: a null url, or one without `://`, has empty host and path, no rule and the default verdict; a host may
be empty and matches nothing; of repeated rules the first stands; repeated rows are judged alike; an empty table or an
empty rule list is fine; other columns pass by unread.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

MAGIC = 0x52554C4553303031


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The file for (verdict, host, path) rules, verdicts allow or block."""
    import xxhash

    first: dict[str, int] = {}
    for verdict, host, path in rules:
        first.setdefault(host + path, int(verdict == "block"))
    digest = {r: xxhash.xxh64_intdigest(r.encode()) for r in first}
    order = sorted(first, key=lambda r: (digest[r], r))
    body = [r.encode() for r in order]
    ends = np.cumsum([0, *[len(b) for b in body]]).astype("<u8")
    lengths = sorted({len(path.encode()) for _, _, path in rules})
    head = np.array([MAGIC, len(order), len(lengths), *lengths], "<u8")
    return b"".join([head.tobytes(), np.array([digest[r] for r in order], "<u8").tobytes(), ends.tobytes(), np.array([first[r] for r in order], "u1").tobytes(), *body])


class Rules:
    """The file, mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, k = (int(x) for x in raw[8:24].view("<u8"))
        at = 24
        self.lengths = [int(x) for x in raw[at : at + 8 * k].view("<u8")][::-1]
        at += 8 * k
        self.digests = raw[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = raw[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.block = raw[at : at + n]
        self.body = raw[at + n :]

    def stored(self, i: int) -> bytes:
        return self.body[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def candidates(self, host: bytes, path: bytes):
        """Longer hosts first."""
        while host:
            for k in self.lengths:
                if k <= len(path):
                    yield host + path[:k]
            cut = host.find(b".")
            if cut < 0:
                return
            host = host[cut + 1 :]

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[str, bool] | None]:
        """The rule that fits best and whether it blocks, or None."""
        import xxhash

        out: list[tuple[str, bool] | None] = [None] * len(hosts)
        if not len(self.digests):
            return out
        best = [0] * len(hosts)
        asked, owner = [], []
        for r, (h, p) in enumerate(zip(hosts, paths)):
            for c in self.candidates(h, p):
                asked.append(c)
                owner.append(r)
        keys = np.fromiter((xxhash.xxh64_intdigest(c) for c in asked), np.uint64, len(asked))
        at = np.searchsorted(self.digests, keys)
        inside = at < len(self.digests)
        for q in np.flatnonzero(inside & (self.digests[np.where(inside, at, 0)] == keys)):
            if out[owner[q]] is None or len(asked[q]) > best[owner[q]]:
                i = int(at[q])
                while i < len(self.digests) and self.digests[i] == keys[q]:  # equal digests of other strings
                    if self.stored(i) == asked[q]:
                        out[owner[q]] = asked[q].decode("utf-8", "replace"), bool(self.block[i])
                        best[owner[q]] = len(asked[q])
                        break
                    i += 1
        return out


def ship(spark: SparkSession, data: bytes) -> str:
    """Writes the file to the shared folder and has Spark bring it to each executor; its name there."""
    name = f"rules-{uuid.uuid4().hex}.bin"
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/{name}"
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for i in range(0, len(data), 1 << 22):
            out.write(bytearray(data[i : i + (1 << 22)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    import pyarrow as pa

    name = ship(pages.sparkSession, build(list(rules)))
    url = F.col(url_col).cast("string")
    asked = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    id_type = dict(asked.dtypes)[id_col]

    def run(batches):
        from pyspark import SparkFiles

        filter_ = Rules(SparkFiles.get(name))
        for b in batches:
            host, path = (b.column(i).to_pylist() for i in (1, 2))
            found = filter_.judge([h.encode() for h in host], [p.encode() for p in path])
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([default if f is None else "block" if f[1] else "allow" for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    return asked.mapInArrow(run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")
