"""Versioned history of the providers' reference ranges (CP5-CP7).

Every key holds at most one staged row per report date, so a key's window is bounded by the
number of dates, however large its share of the raw rows was.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("provider", "biomarker_name")
BOUNDS = ("reference_range_low", "reference_range_high")


def _with_a_bound(staged: DataFrame) -> DataFrame:
    return staged.where(F.col(BOUNDS[0]).isNotNull() | F.col(BOUNDS[1]).isNotNull())


def range_snapshot(staged: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """Each distinct range of a provider and measurement with the date it was last seen."""
    return (
        _with_a_bound(staged)
        .groupBy(*part, *KEY, *BOUNDS)
        .agg(F.max("report_date").alias("last_seen_date"))
    )


def newest_range(staged: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """The range last seen per key: the one-row-per-key batch that a merge needs."""
    day = F.col("report_date")
    return (
        _with_a_bound(staged)
        .groupBy(*part, *KEY)
        .agg(*[F.max_by(b, day).alias(b) for b in BOUNDS], F.max(day).alias("last_seen_date"))
    )


def of_keys(staged: DataFrame, keys: DataFrame) -> DataFrame:
    """The staged rows of some providers and measurements."""
    s, k = staged.alias("s"), keys.alias("k")
    return s.join(k, [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEY], "left_semi")


def open_history(batch: DataFrame, run_ts: Column) -> DataFrame:
    """First history: every key of the batch gets one open version."""
    return batch.withColumn("valid_from", run_ts).withColumn(
        "valid_to", F.lit(None).cast("timestamp_ntz")
    )


def merge_range_history(
    history: DataFrame, batch: DataFrame, run_ts: Column, part: Sequence[str] = ()
) -> DataFrame:
    """History after a batch with one row per key.

    A changed bound closes the open version and opens another; equal bounds leave the version
    as it is; keys absent from the batch stay open. Both sides of the join hold a key once, and
    one pass over it yields the closed and the reopened row.
    """
    keys = [*part, *KEY]
    columns = [*keys, *BOUNDS, "last_seen_date", "valid_from", "valid_to"]
    old = history.where(F.col("valid_to").isNull()).select(columns).alias("old")
    new = open_history(batch, run_ts).select(columns).alias("new")
    same_key = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    had, has = F.col("old.valid_from").isNotNull(), F.col("new.valid_from").isNotNull()
    same = had & F.col(f"old.{BOUNDS[0]}").eqNullSafe(F.col(f"new.{BOUNDS[0]}"))
    same = same & F.col(f"old.{BOUNDS[1]}").eqNullSafe(F.col(f"new.{BOUNDS[1]}"))

    def version(side: str, valid_to: Column) -> Column:
        kept = [F.col(f"{side}.{c}").alias(c) for c in columns[:-1]]
        return F.struct(*kept, valid_to.alias("valid_to"))

    closed_at = F.when(has & ~same, run_ts)
    versions = F.array(
        F.when(had, version("old", closed_at)),
        F.when(has & ~same, version("new", F.col("new.valid_to"))),
    )
    merged = old.join(new, same_key, "full").select(F.inline(F.array_compact(versions)))
    return history.where(F.col("valid_to").isNotNull()).select(columns).unionByName(merged)


def rebuild_range_history(staged: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """History straight from staging: a version starts where a bound differs from the last one.

    ``valid_to`` is the next version's first date, ``last_seen_date`` the last date that showed
    the version's own range.
    """
    key = Window.partitionBy(*part, *KEY)
    by_date = key.orderBy(F.asc_nulls_last("report_date"))
    dated = _with_a_bound(staged).select(*part, *KEY, *BOUNDS, "report_date")
    unchanged = F.lit(True)
    for bound in BOUNDS:
        unchanged = unchanged & F.col(bound).eqNullSafe(F.lag(bound).over(by_date))
    marked = dated.select(
        "*",
        ((F.row_number().over(by_date) == 1) | ~unchanged).alias("starts"),
        F.lag("report_date").over(by_date).alias("date_before"),
        F.max("report_date").over(key).alias("last_date"),
    )
    return marked.where("starts").select(
        *part,
        *KEY,
        *BOUNDS,
        F.coalesce(F.lead("date_before").over(by_date), F.col("last_date")).alias(
            "last_seen_date"
        ),
        F.col("report_date").alias("valid_from"),
        F.lead("report_date").over(by_date).alias("valid_to"),
    )
