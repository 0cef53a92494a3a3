"""Exact dedup: groups of equal texts by a 128-bit content hash, byte-compared inside each hash group.

DataFrame functions only. Text is hashed where it is scanned; only hashes and ids are shuffled for all rows. Texts
travel only for rows whose hash occurs more than once (a bounded bitmap drops most others before the shuffle), and there
they are grouped by the whole text, with partial aggregation, so a group that holds a third of all rows leaves one row
per task.

Defined results: a null text is the empty text; null ids sort before all others, so such a row stays only when no other
row has its text, and its keep_id is null; repeated rows (same id, same text) are one document and are marked alike;
an empty table gives an empty result; other columns of the input pass by unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, bitmap_table, maybe_in, surely_not_in

#: Bits of the bitmap of repeated hashes: 4 MB at most.
BITS = 1 << 25


def _hash(text):
    """128 bits as two longs."""
    h = F.md5(text.cast("binary"))
    half = lambda at: F.conv(F.substring(h, at, 16), 16, -10).cast("long")
    return half(1), half(17)


def first_copies(docs: DataFrame, stash: Stash, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with all their columns. Of rows that repeat both id and
    text one stays. Rows whose hash is certainly single pass without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hi, lo = _hash(text)
    rows = _grouped(docs, stash, id_col, text_col, keep)
    several = stash.put(rows.where("shared").select("id", "hi", "lo", "sha", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")), "several")
    marks = stash.put(bitmap_table(several.select("hi"), "hi", BITS), "marks")
    body = docs.withColumns({"__hi": hi, "__lo": lo})
    stay = several.where("kept").select(F.col("id").alias("__id"), F.col("hi").alias("__h"), F.col("lo").alias("__l"), F.col("sha").alias("__s")).distinct()
    single = several.select(F.col("hi").alias("__h"), F.col("lo").alias("__l")).distinct()
    doubtful = maybe_in(body, "__hi", marks, BITS)
    same = (F.col("__hi") == F.col("__h")) & (F.col("__lo") == F.col("__l"))
    alone = doubtful.join(single, same, "left_anti")
    sha = F.sha2(text.cast("binary"), 256)  # rows of one hash and id may still differ in text
    kept = doubtful.withColumn("__sha", sha).join(stay, same & (F.col("__sha") == F.col("__s")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    kept = kept.groupBy("__hi", "__lo", "__sha", F.col(id_col).alias("__id")).agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return surely_not_in(body, "__hi", marks, BITS).select(*docs.columns).unionByName(alone.select(*docs.columns)).unionByName(kept)


def exact_groups(docs: DataFrame, stash: Stash, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, with the id of the row that stays (the
    smallest or largest of its group)."""
    return _grouped(docs, stash, id_col, text_col, keep).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _grouped(docs: DataFrame, stash: Stash, id_col: str, text_col: str, keep: str) -> DataFrame:
    """Rows (id, keep_id, n, sha, hi, lo, shared): shared says that other rows have the hash, whatever their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hi, lo = _hash(text)
    rows = docs.select(F.col(id_col).alias("id"), hi.alias("hi"), lo.alias("lo"), F.sha2(text.cast("binary"), 256).alias("sha"))
    rows = stash.put(rows, "rows")
    best = F.max if keep == "max" else F.min
    groups = stash.put(rows.groupBy("hi", "lo").agg(best("id").alias("keep_id"), F.count("*").alias("n")), "groups")
    # Bytes are compared inside the groups of two and more: a group with several texts is a collision.
    marks = bitmap_table(groups.where("n > 1").select("hi"), "hi", BITS)
    body = docs.select(F.col(id_col).alias("id"), hi.alias("hi"), lo.alias("lo"), text.alias("body"))
    again = maybe_in(body, "hi", marks, BITS)
    texts = again.groupBy("hi", "lo", "body").agg(best("id").alias("keep_id"), F.count("*").alias("n"))
    clash = stash.put(texts.groupBy("hi", "lo").agg(F.count("*").alias("texts")).where("texts > 1").select("hi", "lo"), "clash")
    shared = (F.col("n") > 1).alias("shared")
    out = rows.join(groups, ["hi", "lo"]).select("id", "keep_id", "n", "sha", "hi", "lo", shared)
    if not clash.isEmpty():  # one hash, several texts: such rows are grouped by the text itself
        sound = groups.join(clash, ["hi", "lo"], "left_anti")
        split = texts.join(clash, ["hi", "lo"], "left_semi")
        apart = maybe_in(body, "hi", bitmap_table(clash, "hi", BITS), BITS).join(split, ["hi", "lo", "body"])
        out = rows.join(sound, ["hi", "lo"]).select("id", "keep_id", "n", "sha", "hi", "lo", shared).unionByName(
            apart.select("id", "keep_id", "n", F.sha2(F.col("body").cast("binary"), 256).alias("sha"), "hi", "lo", F.lit(True).alias("shared"))
        )
    return out
