"""Differences between the facts of two environments (CP8)."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake import fixed_values as fixed

# One row per side after deduplication, so nothing fans out and no key can be hot.
FULL_GRAIN = ("biomarker_key", "report_date", "provider")
COMPARED = ("value_si", "unit_si", "source_file")


def pair_facts(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = FULL_GRAIN,
    source_file: str | None = None,
) -> DataFrame:
    """Full outer join of two fact tables with a status per row, equal rows included.

    Keys must name one fact on each side, as the default does.
    """
    needed = [*keys, *COMPARED]
    p, d = left.select(needed).alias("p"), right.select(needed).alias("d")
    joined = p.join(d, [F.col(f"p.{k}") == F.col(f"d.{k}") for k in keys], "full")
    if source_file is not None:
        # Either side may hold the source. Ahead of the join this would make matches one-sided.
        joined = joined.where(
            (F.col("p.source_file") == source_file) | (F.col("d.source_file") == source_file)
        )
    old, new = F.col("p.value_si"), F.col("d.value_si")
    status = (
        F.when(F.col(f"p.{keys[0]}").isNull(), fixed.DIFF_RIGHT_ONLY)
        .when(F.col(f"d.{keys[0]}").isNull(), fixed.DIFF_LEFT_ONLY)
        .when(~old.eqNullSafe(new), fixed.DIFF_CHANGED)
        .otherwise(fixed.DIFF_SAME)
    )
    names = {"biomarker_key": "biomarker"}
    return joined.select(
        *[F.coalesce(f"p.{k}", f"d.{k}").alias(names.get(k, k)) for k in keys],
        old.alias("prod_value"),
        new.alias("env_value"),
        F.round(new - old, 4).alias("diff"),
        F.coalesce("p.unit_si", "d.unit_si").alias("unit"),
        status.alias("status"),
    )


def compare_facts(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = FULL_GRAIN,
    source_file: str | None = None,
) -> DataFrame:
    """Changed and one-sided rows by date and key."""
    differing = pair_facts(left, right, keys, source_file).where(
        F.col("status") != fixed.DIFF_SAME
    )
    names = ["biomarker" if k == "biomarker_key" else k for k in keys]
    order = sorted(names, key=lambda n: (n != "report_date", n != "biomarker"))
    return differing.orderBy(*[F.asc_nulls_last(n) for n in order])


def compare_summary(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = FULL_GRAIN
) -> DataFrame:
    """Rows on either side and rows per status, as ``(measure, rows)``, from one comparison.

    As rows match one to one, a side's rows are all but those of the other side only.
    """
    status = F.col("status")
    states = (
        fixed.DIFF_LEFT_ONLY, fixed.DIFF_RIGHT_ONLY, fixed.DIFF_CHANGED, fixed.DIFF_SAME
    )
    measures = {
        "prod rows": status != fixed.DIFF_RIGHT_ONLY,
        "env rows": status != fixed.DIFF_LEFT_ONLY,
        **{s: status == s for s in states},
    }
    counted = pair_facts(left, right, keys).agg(
        *[F.count_if(holds).alias(name) for name, holds in measures.items()]
    )
    rows = [
        F.struct(F.lit(name).alias("measure"), F.col(f"`{name}`").alias("rows"))
        for name in measures
    ]
    listed = counted.select(F.inline(F.array(*rows)))
    return listed.where((F.col("rows") > 0) | ~F.col("measure").isin(*states))
