"""What the operators of this subpackage share: written intermediate tables, bounded bitmaps, components, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session that names none has one of its own; a cluster must name it."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="terrane-llm-")
    return _own_dir


class Stash:
    """Tables written to the shared folder. They cut lineage and outlive the executors that wrote them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self.remove(self.path(name))

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of texts that go between the JVM and a Python worker at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand at most BATCH_ROWS rows at once to Python workers, unless it already hands fewer. Both sides
    hold a batch and its buffers outside the heap, so whole texts in batches of the default size take hundreds of MB. The
    setting must hold when a lazy result is computed, so it stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's text, modulo parts; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


# A bitmap over hashes: at most `bits` bits, whatever the number of rows behind it.

BITMAP_BUCKET = 32768  # bits in one row of bitmap_construct_agg


def _slot(col: str, bits: int) -> Column:
    """From 1, as the bitmap functions count."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(bits)) + 1


def bitmap_table(hashes: DataFrame, col: str, bits: int) -> DataFrame:
    """Rows (__bucket, __bitmap) marking xxhash64(col) modulo bits; never more than bits/8 bytes in all."""
    slots = hashes.select(_slot(col, bits).alias("__slot"))
    return slots.groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bitmap"))


def _with_bit(df: DataFrame, col: str, bitmap: DataFrame, bits: int) -> DataFrame:
    keyed = df.withColumn("__slot", _slot(col, bits)).withColumn("__bucket", F.bitmap_bucket_number("__slot"))
    byte = "cast(conv(hex(substring(__bitmap, int(bitmap_bit_position(__slot) div 8) + 1, 1)), 16, 10) as bigint)"
    bit = F.expr(f"coalesce(getbit({byte}, int(bitmap_bit_position(__slot) % 8)), 0)")
    return keyed.join(F.broadcast(bitmap), "__bucket", "left").withColumn("__bit", bit).drop("__slot", "__bucket", "__bitmap")


def maybe_in(df: DataFrame, col: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """Rows whose key may be in the bitmap's set: false positives pass, no member is lost. The bitmap is broadcast;
    its size is bounded by `bits`, whatever the number of rows."""
    return _with_bit(df, col, bitmap, bits).where("__bit = 1").drop("__bit")


def surely_not_in(df: DataFrame, col: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """The other rows."""
    return _with_bit(df, col, bitmap, bits).where("__bit = 0").drop("__bit")


def without_ids(docs: DataFrame, id_col: str, dropped: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """docs without the rows whose id is in the one column of `dropped`. Only rows that the bitmap can't rule out are
    shuffled. Rows with null id stay."""
    name = dropped.columns[0]
    dropped = dropped.select(F.col(name).alias("__gone")).where("__gone is not null").distinct()
    marks = bitmap_table(dropped, "__gone", bits)
    keyed = docs.withColumn("__id", F.col(id_col).cast("long"))
    doubtful = maybe_in(keyed, "__id", marks, bits).join(dropped, F.col("__id") == F.col("__gone"), "left_anti")
    return surely_not_in(keyed, "__id", marks, bits).unionByName(doubtful).drop("__id")


def collect_bitmap(hashes: DataFrame, col: str, bits: int) -> np.ndarray:
    """The bitmap as bits/8 bytes on the driver, indexed by xxhash64(col) modulo bits."""
    out = np.zeros(bits // 8, np.uint8)
    for r in bitmap_table(hashes, col, bits).collect():  # at most bits / 32768 rows of 4 KB
        part = np.frombuffer(bytes(r["__bitmap"]), np.uint8)
        at = (r["__bucket"] - 1) * BITMAP_BUCKET // 8
        out[at : at + len(part)] |= part[: len(out) - at]
    return out


def components(edges: DataFrame, stash: Stash, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) edges by alternating large and small stars: rows (node, root), root the
    smallest node reachable. Every round is two aggregations and two joins on written tables; nothing is collected."""
    e = stash.put(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-0",
    )
    for i in range(1, most_rounds + 1):
        if _stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stash.put(small, f"{name}-{i}")
        stash.drop(f"{name}-{i - 1}")
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one root and no root has one of its own, so that the edges are the answer."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return ends.groupBy("k").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 or (a = 1 and b = 1)").isEmpty()


# Vectorised hashing of the words in an Arrow string column.

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
#: Bytes that are hashed at once.
SPAN = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table() -> tuple[np.ndarray, np.ndarray]:
    """Powers up to SPAN; longer stretches are hashed piece by piece."""
    if not _powers:
        one = np.ones(1, np.uint64)
        _powers["p"] = np.concatenate([one, np.cumprod(np.full(SPAN, _P, np.uint64))])
        _powers["q"] = np.concatenate([one, np.cumprod(np.full(SPAN, _P_INV, np.uint64))])
    return _powers["p"], _powers["q"]


def string_slices(column, most_bytes: int = 500_000):
    """(first row, uint8 bytes, offsets) of runs of rows of an Arrow string or binary column; nulls are empty.
    A row longer than most_bytes is a run of its own."""
    import pyarrow as pa

    a = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most_bytes, "right")) - 1)
        j = min(j, len(a))
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) and the row of each, in order."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = _LOWER[data]
    word = ~_SPACE[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = off[1:-1]
    edge = edge[edge < len(b)]
    first[edge] = word[edge]  # a word never crosses rows
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # words that lie within one span
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        h[i:j] = _span_hashes(b[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    h = mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return h, np.searchsorted(off, starts, "right") - 1


def _span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) times powers that count from each word's first byte."""
    p, q = _power_table()
    if len(b) > SPAN:  # one word
        total, scale = np.uint64(0), np.uint64(1)
        for at in range(0, len(b), SPAN):
            part = b[at : at + SPAN].astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                total += scale * (part * p[: len(part)]).sum(dtype=np.uint64)
                scale *= p[SPAN]
        return np.array([total], np.uint64)
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=s[1:])
    return (s[ends] - s[starts]) * q[starts]
