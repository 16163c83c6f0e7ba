"""Standard questions over facts and documents (CP9, CP12).

Sort keys end in the row's id: the order is total, and a date that many rows share is sorted by
several tasks.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(facts: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """Every measurement of a key's newest date, ties included.

    The newest dates are one small row per key; the facts are kept by a semi join, so ties
    never gather in one window.
    """
    keys = [*part, "biomarker_key"]
    newest = facts.groupBy(*keys).agg(F.max("report_date").alias("report_date"))
    return (
        facts.join(newest, [*keys, "report_date"], "left_semi")
        .orderBy(F.asc_nulls_last("category"), "biomarker_key", "lab_result_id")
        .select(
            *part,
            "biomarker_key",
            "value_si",
            "unit_si",
            "report_date",
            "category",
            "is_within_ref_range",
            "is_within_optimal_range",
        )
    )


def key_trend(facts: DataFrame, key: str) -> DataFrame:
    return (
        facts.where(F.col("biomarker_key") == key)
        .orderBy(F.asc_nulls_last("report_date"), "lab_result_id")
        .select(
            "report_date",
            "value_si",
            "unit_si",
            "provider",
            "is_within_ref_range",
            "is_within_optimal_range",
        )
    )


def newest_out_of_range(facts: DataFrame) -> DataFrame:
    """Out-of-range measurements of the newest report date, found by a scalar subquery."""
    newest = facts.select(F.max("report_date")).scalar()
    return (
        facts.where((F.col("report_date") == newest) & ~F.col("is_within_ref_range"))
        .orderBy("biomarker_key", "lab_result_id")
        .select(
            "biomarker_key",
            "value_si",
            "unit_si",
            "reference_range_low_si",
            "reference_range_high_si",
        )
    )


def outside_optimal(facts: DataFrame) -> DataFrame:
    return (
        facts.where(~F.col("is_within_optimal_range"))
        .orderBy(F.desc_nulls_last("report_date"), "biomarker_key", "lab_result_id")
        .select(
            "biomarker_key",
            "value_si",
            "unit_si",
            "optimal_range_low_si",
            "optimal_range_high_si",
            "report_date",
        )
    )


def report_inventory(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc_nulls_last("report_date"), "source_file").select(
        "report_date", "provider", "report_type", "biomarker_count", "tags"
    )


def category_summary(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy("category")
        .agg(
            F.count_distinct("biomarker_key").alias("unique_biomarkers"),
            F.count_distinct("report_date").alias("report_count"),
        )
        .orderBy(F.asc_nulls_last("category"))
    )


def count_per_source(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source_file").agg(F.count(F.lit(1)).alias("measurements"))


def recent_facts(facts: DataFrame) -> DataFrame:
    """All facts, newest first, in the short form used for quick looks."""
    newest_first = [F.desc_nulls_last("report_date"), "biomarker_key", "lab_result_id"]
    return facts.orderBy(*newest_first).select(
        "biomarker_key",
        "value_si",
        "unit_si",
        "report_date",
        "is_within_ref_range",
        "is_within_optimal_range",
    )


def document_context(documents: DataFrame) -> DataFrame:
    """Narratives and candidates of all documents, oldest first."""
    return documents.select(
        "source_file", "report_date", "report_type", "document_summary", "baseline_candidates"
    ).orderBy(F.asc_nulls_last("report_date"), "source_file")


def load_status(raw: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: reports with their first and last date, distinct names, measurements."""
    reports = docs.agg(
        F.count(F.lit(1)).alias("reports"),
        F.min("report_date").alias("first_report"),
        F.max("report_date").alias("last_report"),
    )
    # Names are counted from one row per name, so the hottest name is reduced in the map tasks.
    names = raw.groupBy("biomarker_name_raw").agg(F.count(F.lit(1)).alias("n"))
    totals = names.agg(
        F.count("biomarker_name_raw").alias("unique_biomarkers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("measurements"),
    )
    both = reports.unionByName(totals, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
