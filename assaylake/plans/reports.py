"""Report tables (RP1-RP5): one row per line item, no text formatting."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake import fixed_values as fixed
from assaylake.functions.display import link_from_profile_docs
from assaylake.functions.labels import (
    condition_rank,
    finding_label,
    source_and_date,
    status_label,
    trend_label,
)

_LATEST = (
    "category",
    "value_si",
    "unit_si",
    "value_original",
    "unit_original",
    "report_date",
    "provider",
    "is_within_ref_range",
    "is_within_optimal_range",
    "is_below_detection_limit",
)


def latest_and_previous(facts: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """Newest fact per key next to the value and date of the one before, in one window.

    Ranks up to 2 are kept before the shuffle, so a key sends two rows per map task however
    many it has; both ranks then fold into one row on the same partitioning. That holds for
    written facts and broadcast dimensions. Where a dimension too large to broadcast is yet to
    be joined, start from ``newest_two`` of the staged rows.
    """
    keys = [*part, "biomarker_key"]
    newest_first = Window.partitionBy(*keys).orderBy(
        F.desc_nulls_last("report_date"), F.desc("lab_result_id")
    )
    ranked = facts.withColumn("place", F.row_number().over(newest_first)).where("place <= 2")
    latest, previous = F.col("place") == 1, F.col("place") == 2
    return ranked.groupBy(*keys).agg(
        *[F.max(F.when(latest, F.col(c))).alias(c) for c in _LATEST],
        F.max(F.when(previous, F.col("value_si"))).alias("prev_value_si"),
        F.max(F.when(previous, F.col("report_date"))).alias("prev_date"),
    )


def snapshot_rows(facts: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """Latest value per key with status and trend, in no order."""
    rows = latest_and_previous(facts, part)
    status = status_label(
        F.col("is_below_detection_limit"),
        F.col("is_within_optimal_range"),
        F.col("is_within_ref_range"),
    )
    trend = trend_label(F.col("value_si"), F.col("prev_value_si"))
    return rows.select("*", status.alias("status"), trend.alias("trend"))


def current_snapshot(facts: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """Latest value per key with status and trend, by category and key."""
    return snapshot_rows(facts, part).orderBy(
        *part, F.asc_nulls_last("category"), "biomarker_key"
    )


def timeline(documents: DataFrame) -> DataFrame:
    """Documents, newest first."""
    return documents.select(
        "report_date", "provider", "report_type", "source_file", "biomarker_count", "tags"
    ).orderBy(F.desc_nulls_last("report_date"), "source_file")


INDEXED = ("report_date", "provider", "report_type", "biomarker_count", "tags", "markdown_path")


def index_rows(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Reports with their out-of-range counts and links, in no order.

    Documents equal in all six shown attributes merge into one line. Facts are counted per
    source before the join, which then meets each source once.
    """
    out = (
        facts.where(~F.col("is_within_ref_range"))
        .groupBy("source_file")
        .agg(F.count(F.lit(1)).alias("out_of_range"))
    )
    counted = (
        documents.select(*INDEXED, "source_file")
        .join(out, "source_file", "left")
        .groupBy(*INDEXED)
        .agg(F.coalesce(F.sum("out_of_range"), F.lit(0)).alias("out_of_range_count"))
    )
    link = F.coalesce(link_from_profile_docs(F.col("markdown_path")), F.lit(""))
    return counted.withColumn("link", link)


def report_index(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Reports with their out-of-range counts and links, newest first."""
    rest = [F.asc_nulls_last(c) for c in INDEXED[::-1] if c != "report_date"]
    return index_rows(documents, facts).orderBy(F.desc_nulls_last("report_date"), *rest)


def conditions_by_priority(conditions: DataFrame) -> DataFrame:
    """Conditions with the sort key ``(rank, position)`` of the history report.

    ``position`` is the input order. Listed states take their rank from the list. Others follow,
    by their first appearance; only these are joined with it.
    """
    named = conditions.withColumn(
        "status", F.coalesce("status", F.lit(fixed.CONDITION_UNKNOWN))
    )
    listed = F.col("status").isin(*fixed.CONDITION_ORDER)
    others = named.where(~listed)
    first = others.groupBy("status").agg(F.min("position").alias("first_seen"))
    both = named.where(listed).withColumn("first_seen", F.lit(None).cast("long"))
    both = both.unionByName(others.join(first, "status"))
    origin = source_and_date(F.col("source_report"), F.col("discovered_date"))
    return both.withColumns(
        {"rank": condition_rank(F.col("status"), F.col("first_seen")), "origin": origin}
    ).drop("first_seen")


def finding_rows(facts: DataFrame) -> DataFrame:
    """Facts with their range wording, in no order."""
    return facts.select(
        "report_date",
        "biomarker_key",
        "lab_result_id",
        "value_raw",
        "value_si",
        "unit_si",
        "provider",
        finding_label(F.col("is_within_ref_range")).alias("range_label"),
    )


def findings(facts: DataFrame) -> DataFrame:
    """Facts with their range wording, newest first."""
    return finding_rows(facts).orderBy(
        F.desc_nulls_last("report_date"), "biomarker_key", "lab_result_id"
    )


def documents_with_context(documents: DataFrame) -> DataFrame:
    """Documents that carry a summary or candidates."""
    return documents.where(
        F.col("document_summary").isNotNull() | F.col("baseline_candidates").isNotNull()
    )
