"""Mixing sources to target weights by fitting each source's budget as a subset sum.

A source's target first buys whole passes over its documents. What remains is filled from the counts
of its documents by exact token length: every length gives its even share, rounded so that the sum
never strays by more than one document, and bounded-knapsack dynamic programming then finds
documents whose lengths add up to the rest exactly or as nearly as can be. Which documents of a
length are taken is settled by a seeded hash.

The tables that grow with the corpus (documents, counts by source, length and hash range) stay in
Spark. A source's counts by length are one group, bounded by its longest document; the dynamic
programme needs some thirty bytes for each token of the longest document.

Defined results: a null text is empty and has size 0; a null source is a source, ordered last; a
source without tokens has target 0; a null doc_id is seeded like any other value, and rows with equal
doc_ids may be picked apart, in any order, as they are equal to the seed; an empty table gives an
empty result; other columns are carried through whatever their names.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import ROW, WORD, boxed, text_of
from assaylake.sources.shared import shared_folder, stored

#: Weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
MAX_TIMES = 3
SEED = 20
#: Hash ranges of a source's documents of one length: a range is numbered in one task, and a length
#: that many documents share is spread over all.
RANGES = 256
#: Documents that even shares have taken and the subset sum may take or leave.
RELEASED = 16

SOURCE = ("no_source", "source")


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _source_key(source: Column) -> dict[str, Column]:
    return {
        "no_source": source.isNull(),
        "source": F.coalesce(source.cast("string"), F.lit("")),
    }


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``no_source, source, source_size, target``: one row per source.

    Targets are in proportion to the weights, cut at ``MAX_TIMES`` the source's size. Sources by
    that cap per weight are cut in this order, so the level that spends the whole budget
    follows from running sums.
    """
    totals = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(*SOURCE)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1)
    weighed = totals.withColumn("weight", weight.cast("long")).withColumn(
        "cap", MAX_TIMES * F.col("source_size")
    )
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), *SOURCE)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0)
    )
    level = left / open_weight
    levels = weighed.withColumn("level", level).withColumn(
        "reached", F.col("level") * F.col("weight") <= F.col("cap")
    )
    first = F.min(F.when(F.col("reached"), F.struct(F.col("cap") / F.col("weight"), *SOURCE, "level")))
    common = first.over(everything)["level"]
    return levels.withColumn("common", common).select(
        *SOURCE,
        "source_size",
        F.least(
            F.col("cap").cast("double"),
            F.coalesce(F.col("common") * F.col("weight"), F.col("cap").cast("double")),
        ).alias("target"),
    )


def closest_subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that lengths sum as near to ``budget`` as can
    be, the lower sum at a tie.

    Bounded knapsack over sums up to ``budget`` plus the longest length; a count is split into
    powers of two, and ``made_by`` holds for each sum the piece that first made it, which is enough
    to walk back.
    """
    taken = np.zeros(len(lengths), np.int64)
    usable = (lengths > 0) & (counts > 0)
    if budget <= 0 or not usable.any():
        return taken
    top = budget + int(lengths[usable].max())
    made_by = np.full(top + 1, -1, np.int32)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    pieces: list[tuple[int, int]] = []
    for i in np.flatnonzero(usable)[::-1].tolist():
        rest, power = min(int(counts[i]), top // int(lengths[i])), 1
        while rest > 0 and not reached[budget]:
            n = min(power, rest)
            step = n * int(lengths[i])
            fresh = np.zeros_like(reached)
            fresh[step:] = reached[: top + 1 - step]
            fresh &= ~reached
            made_by[fresh] = len(pieces)
            reached |= fresh
            pieces.append((i, n))
            rest, power = rest - n, power * 2
    sums = np.flatnonzero(reached)
    total = int(sums[np.argmin(np.abs(sums - budget))])
    while total > 0:
        i, n = pieces[made_by[total]]
        taken[i] += n
        total -= n * int(lengths[i])
    return taken


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length a budget takes: even shares first, then the subset sum.

    ``budget`` must not exceed all lengths together. Shares are rounded down on the running sum of
    tokens, so less than the longest length is left over; some short documents are put back, to
    leave the subset sum a choice.
    """
    whole = int((lengths * counts).sum())
    if budget >= whole:
        return counts.copy()
    taken = np.zeros(len(lengths), np.int64)
    wanted, given = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, count = int(lengths[i]), int(counts[i])
        if length == 0:
            continue
        wanted += budget * length * count  # over whole
        taken[i] = min(count, max(0, (wanted - given * whole) // (length * whole)))
        given += int(taken[i]) * length
    bound, released = 4 * int(lengths.max()), 0
    for i in np.argsort(lengths, kind="stable").tolist():
        if released == RELEASED or budget - given + int(lengths[i]) > bound:
            break
        if taken[i] and lengths[i]:
            taken[i] -= 1
            given -= int(lengths[i])
            released += 1
    return taken + closest_subset(lengths, counts - taken, budget - given)


def _fit(histogram: pd.DataFrame) -> pd.DataFrame:
    """A source's counts by length, with the passes and the picked documents of each."""
    histogram = histogram.sort_values("size")
    lengths = histogram["size"].to_numpy(np.int64)
    counts = histogram["documents"].to_numpy(np.int64)
    size, target = int(histogram["source_size"].iloc[0]), float(histogram["target"].iloc[0])
    passes = int(target // size) if size else 0
    picked = fit_counts(lengths, counts, round(target) - passes * size)
    return histogram[[*SOURCE, "size", "source_size", "target"]].assign(
        passes=np.full(len(lengths), passes, np.int64), picked=picked
    )


_PICKS = (
    "no_source boolean, source string, size long, source_size long, target double, "
    "passes long, picked long"
)


def plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """For each source, length and hash range: passes, and how many rows the range still gives."""
    by_range = sizes.groupBy(*SOURCE, "size", "range").agg(F.count(F.lit(1)).alias("documents"))
    by_range = by_range.withColumnRenamed("documents", "rows")
    by_length = by_range.groupBy(*SOURCE, "size").agg(F.sum("rows").alias("documents"))
    picks = (
        by_length.join(targets(sizes, weights), list(SOURCE))
        .groupBy(*SOURCE)
        .applyInPandas(_fit, _PICKS)
    )
    before = F.sum("rows").over(
        Window.partitionBy(*SOURCE, "size")
        .orderBy("range")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("rows")
    ranged = by_range.withColumn("before", before)
    left = F.greatest(F.lit(0).cast("long"), F.col("picked") - F.col("before"))
    return ranged.join(picks, [*SOURCE, "size"]).select(
        *SOURCE, "size", "range", "source_size", "target", "passes", left.alias("left")
    )


def _sized(rows: DataFrame, doc_id: Column, text: Column, source: Column) -> DataFrame:
    order = F.xxhash64(doc_id, F.lit(SEED))
    return rows.withColumns(
        {
            **_source_key(source),
            "doc_id": doc_id,
            "size": size_of(text),
            "range": F.pmod(order, F.lit(RANGES)).cast("int"),
            "order": order,
        }
    )


def _taken(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows with ``times``, how often the mix takes them."""
    key = [*SOURCE, "size", "range"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("order", "doc_id"))
    extra = (F.col("nth") <= F.col("left")).cast("long")
    return (
        sized.withColumn("nth", nth).join(planned, key).withColumn("times", F.col("passes") + extra)
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, times``."""
    folder = shared_folder(docs.sparkSession, "mix")
    rows = docs.select("doc_id", "text", "source")
    sized = _sized(rows, F.col("doc_id"), text_of(), F.col("source")).drop("text")
    sized = stored(sized, folder, "sizes")
    return _taken(sized, plan(sized, weights)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
        "times",
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    rows = boxed(docs)
    doc_id, text, source = (F.col(f"{ROW}.{c}") for c in ("doc_id", "text", "source"))
    sized = _sized(rows, doc_id, text_of(f"{ROW}.text"), source)
    folder = shared_folder(docs.sparkSession, "mix")
    small = stored(sized.select(*SOURCE, "size", "range"), folder, "sizes")
    planned = stored(plan(small, weights), folder, "plan")
    taken = _taken(sized, planned)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return taken.select(ROW, copies.alias("_copy")).select(f"{ROW}.*")
