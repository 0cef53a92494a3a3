"""Mixing sources to target weights: iterative proportional fitting over the cells (source, language, topic), then
Poisson sampling of documents by the calibrated probabilities.

DataFrame functions only. Documents are scanned twice: once for token sums per cell (partial aggregation, so a source
with a third of all rows costs one row per task) and once to attach each cell's probability. Raking itself runs on the
cells, a table of at most sources x languages x topics rows, which is rewritten every few sweeps.

The mass m(cell) starts at the tokens there and is scaled in turn to each marginal's target until every marginal is met
within `tolerance`. A document's sampling probability is min(1, s * m(cell) / tokens(cell)), with s such that the
expected tokens equal `budget` times all tokens, or all tokens that the cells can give. The draw is a hash of the id and
the seed, so it is the same in every run and on every retry.

Targets: a dict value -> share per marginal, or a temperature t: share proportional to tokens ** t (1 keeps the
marginal as it is, 0 makes it uniform). Values that a dict does not name get share 0; named values that are absent are
left out and the rest scaled.

Defined results: null source or language is the value "" of its own; null or empty text has no tokens, topic "empty" and
its cell's probability, 0 if the cell has no tokens at all; repeated rows share one draw; an empty table gives an empty
result; other columns pass by unread.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Stash

# The topics, first match wins; patterns over the whole text.
TOPICS = (
    ("tabular", r" \| "),
    ("symbols", r"###|%%%|&&&|\$\$\$|\*\*\*"),
    ("contact", r"@|https?://|\d{3}[-. ]\d{3}"),
)
MARGINS = ("source", "lang", "topic")


def topic(text: Column, topics=TOPICS) -> Column:
    """The first topic whose pattern occurs; else "empty" or "prose"."""
    out = F.when(F.length(text) == 0, "empty")
    for name, pattern in topics:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def _targets(cells: DataFrame, col: str, target: float | Mapping[str, float], total: float) -> DataFrame:
    """(col, want): tokens wanted for each value that has tokens."""
    sums = cells.where("n > 0").groupBy(col).agg(F.sum("n").alias("have"))
    if isinstance(target, Mapping):
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in target.items() for x in (kv[0], float(kv[1]))]), F.col(col)), F.lit(0.0))
    else:
        share = F.pow(F.col("have").cast("double"), F.lit(float(target)))
    sums = sums.select(col, share.alias("share"))
    all_share = sums.agg(F.sum("share")).first()[0] or 0.0
    return sums.select(col, (F.col("share") * F.lit(total / max(all_share, 1e-300))).alias("want"))


def mix(
    docs: DataFrame, stash: Stash, targets: Mapping[str, float | Mapping[str, float]] | None = None, budget: float = 0.5, seed: int = 17,
    tolerance: float = 1e-4, most_sweeps: int = 40, id_col: str = "doc_id", text_col: str = "text", topics=TOPICS,
) -> DataFrame:
    """One row per document: id, source, lang, topic, n_tokens, weight (mass per token), probability, sampled."""
    marked, rates = _rates(docs, stash, targets, budget, tolerance, most_sweeps, text_col, topics, id_col)
    return marked.join(rates, list(MARGINS)).select(
        F.col("id").alias(id_col), *MARGINS, "n_tokens", "weight", "probability", (_draw(F.col("id"), seed) < F.col("probability")).alias("sampled")
    )


def sampled(
    docs: DataFrame, stash: Stash, targets=None, budget: float = 0.5, seed: int = 17, tolerance: float = 1e-4, most_sweeps: int = 40,
    id_col: str = "doc_id", text_col: str = "text", topics=TOPICS,
) -> DataFrame:
    """The sampled rows of docs, all columns. Cells are joined to the rows themselves, so texts are not shuffled as
    long as Spark finds the table of cells small enough to broadcast."""
    _, rates = _rates(docs, stash, targets, budget, tolerance, most_sweeps, text_col, topics, id_col)
    rates = rates.select(*[F.col(c).alias(f"__{c}") for c in MARGINS], F.col("probability").alias("__p"))
    keyed = docs.withColumns({f"__k_{c}": v for c, v in _cell(F.coalesce(F.col(text_col), F.lit("")), topics).items()})
    chosen = keyed.join(rates, [F.col(f"__k_{c}") == F.col(f"__{c}") for c in MARGINS]).where(_draw(F.col(id_col), seed) < F.col("__p"))
    return chosen.select(*[F.col(c) for c in docs.columns])


def _draw(id_: Column, seed: int) -> Column:
    """Uniform in [0, 1)."""
    return F.pmod(F.xxhash64(id_.cast("string"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _cell(text: Column, topics) -> dict[str, Column]:
    return {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang")} | {"topic": topic(text, topics)}


def _rates(docs, stash, targets, budget, tolerance, most_sweeps, text_col, topics, id_col) -> tuple[DataFrame, DataFrame]:
    """Documents with their cell and tokens, and cells with weight and probability."""
    targets = {"source": 0.5, "lang": 0.7, "topic": 0.5} | dict(targets or {})
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.col(id_col).alias("id"), *[v.alias(c) for c, v in _cell(text, topics).items()], F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))
    marked = stash.put(marked, "marked")  # a few bytes a row; texts are read once
    cells = stash.put(marked.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")), "cells")
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    if total > 0:
        fitted = rake(cells, stash, targets, total, tolerance, most_sweeps)
        scale = _scale(fitted, budget * total)
    else:
        fitted, scale = cells.withColumn("m", F.lit(0.0)), 0.0
    rate = F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(0.0)
    return marked, stash.put(fitted.select(*MARGINS, rate.alias("weight"), F.least(F.lit(1.0), rate * F.lit(scale)).alias("probability")), "rates")


def rake(cells: DataFrame, stash: Stash, targets, total: float, tolerance: float, most_sweeps: int, sweeps_at_once: int = 4) -> DataFrame:
    """Cells with their fitted mass m. Written anew every few sweeps; only the largest deviation comes to the driver."""
    now = cells.withColumn("m", F.col("n").cast("double"))
    for c in MARGINS:
        now = now.join(_targets(cells, c, targets[c], total).withColumnRenamed("want", f"want_{c}"), c, "left").fillna(0.0, [f"want_{c}"])
    now, last = stash.put(now, "start"), "start"
    for done in range(0, most_sweeps, sweeps_at_once):
        for _ in range(sweeps_at_once):
            for c in MARGINS:  # a window over the cells, so that the plan grows by one step a marginal
                mass = F.sum("m").over(Window.partitionBy(c))
                now = now.withColumn("m", F.when(mass > 0, F.col("m") * F.col(f"want_{c}") / mass).otherwise(0.0))
        name = f"raked-{done}"
        now = stash.put(now, name)
        stash.drop(last)
        last = name
        off = 0.0
        for c in MARGINS[:-1]:  # the last marginal has just been met
            gap = now.groupBy(c).agg(F.sum("m").alias("is"), F.max(f"want_{c}").alias("want")).agg(F.max(F.abs(F.col("is") - F.col("want"))).alias("gap")).first()["gap"]
            off = max(off, gap or 0.0)
        if off <= tolerance * total:
            return now
    warnings.warn(f"raking is {off / total:.2g} of all tokens off its targets after {most_sweeps} sweeps", stacklevel=2)
    return now


def _scale(cells: DataFrame, tokens: float) -> float:
    """s with sum(min(n, s * m)) = tokens, found on a ladder of 65 values that is narrowed four times; each
    time one small aggregation over the cells."""
    reach = cells.where("m > 0").agg(F.sum("n").alias("n"), F.max(F.col("n") / F.col("m")).alias("s")).first()
    if not reach["n"]:
        return 0.0
    if tokens >= reach["n"]:
        return float(reach["s"])
    low, high = 0.0, float(reach["s"])
    steps = 64
    for _ in range(4):  # 64 ** 4 parts of the range
        ladder = [low + (high - low) * k / steps for k in range(steps + 1)]
        got = cells.agg(*[F.sum(F.least(F.col("n").cast("double"), F.col("m") * F.lit(s))).alias(f"s{k}") for k, s in enumerate(ladder)]).first()
        k = max(i for i in range(steps) if (got[i] or 0.0) <= tokens)
        low, high = ladder[k], ladder[k + 1]
    return (low + high) / 2
