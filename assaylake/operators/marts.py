"""Measurement facts and the document dimension (CP3, CP4)."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.values import from_si, in_optimal, in_reference, to_si


def measurement_facts(
    staged: DataFrame, meta: DataFrame, part: Sequence[str] = ()
) -> DataFrame:
    """Staged measurements with SI values, range flags and the reference dimension's columns.

    The dimension is joined without a hint: Spark broadcasts it while its size is below
    ``spark.sql.autoBroadcastJoinThreshold``, and otherwise sorts and merges, where adaptive
    execution splits the partition of a hot measurement name.
    """
    s, m = staged.alias("s"), meta.alias("m")
    value, factor = F.col("s.value_numeric"), F.col("m.conversion_factor")
    low, high = F.col("s.reference_range_low"), F.col("s.reference_range_high")
    best_low, best_high = F.col("m.optimal_range_low_si"), F.col("m.optimal_range_high_si")
    joined = s.join(m, F.col("s.biomarker_name") == F.col("m.biomarker_key"), "left")
    return joined.select(
        *[F.col(f"s.{p}") for p in part],
        "s.lab_result_id",
        "s.report_date",
        "s.provider",
        "s.source_file",
        F.col("s.biomarker_name").alias("biomarker_key"),
        "s.value_raw",
        value.alias("value_original"),
        F.col("s.unit").alias("unit_original"),
        F.coalesce("m.si_unit", "s.unit").alias("unit_si"),
        to_si(value, factor).alias("value_si"),
        to_si(low, factor).alias("reference_range_low_si"),
        to_si(high, factor).alias("reference_range_high_si"),
        best_low,
        best_high,
        in_reference(value, low, high).alias("is_within_ref_range"),
        in_optimal(value, factor, best_low, best_high).alias("is_within_optimal_range"),
        "s.is_below_detection_limit",
        "s.is_above_detection_limit",
        "m.category",
        F.coalesce("s.loinc_code", "m.loinc_code").alias("loinc_code"),
    )


def to_conventional_units(facts: DataFrame, meta: DataFrame) -> DataFrame:
    """Facts with their value back in the dimension's conventional unit (PRJ23)."""
    f, m = facts.alias("f"), meta.alias("m")
    joined = f.join(m, F.col("f.biomarker_key") == F.col("m.biomarker_key"), "left")
    return joined.select(
        "f.*",
        from_si(F.col("f.value_si"), F.col("m.conversion_factor")).alias("value_conventional"),
        F.coalesce("m.conventional_unit", "f.unit_original").alias("unit_conventional"),
    )


def document_dimension(docs: DataFrame, staged: DataFrame) -> DataFrame:
    """Documents with the number of their measurements that survived deduplication."""
    counts = staged.groupBy("source_file").agg(F.count(F.lit(1)).alias("survivors"))
    return docs.join(counts, "source_file", "left").select(
        F.col("id").alias("document_id"),
        "source_file",
        "report_date",
        "provider",
        "report_type",
        "tags",
        "markdown_path",
        F.coalesce("survivors", F.lit(0).cast("long")).alias("biomarker_count"),
        "extracted_at",
        "extraction_method",
        "document_summary",
        "baseline_candidates",
    )


def recounted(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """The document dimension after the measurement counts of some sources changed."""
    change = F.coalesce("change", F.lit(0))
    joined = documents.join(changes, "source_file", "left")
    counted = joined.withColumn("biomarker_count", F.col("biomarker_count") + change)
    return counted.select(*documents.columns)
