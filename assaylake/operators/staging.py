"""Raw measurements to cleaned, deduplicated measurements (CP2)."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.values import (
    censored_value,
    is_above_limit,
    is_below_limit,
    plain_number,
)


def newest_extraction(raw: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """One raw row per report date, measurement name and provider: the last one extracted.

    The name is trimmed before the window, so that a filter on it reaches the scan. Keeping
    rank 1 lets every map task drop its losers before the shuffle, whatever the key's share of
    the rows. ``id`` settles equal extraction times.
    """
    named = raw.where(F.col("biomarker_name_raw").isNotNull() & F.col("value_raw").isNotNull())
    named = named.withColumn("biomarker_name", F.trim("biomarker_name_raw"))
    newest_first = Window.partitionBy(
        *part, "report_date", "biomarker_name", "provider"
    ).orderBy(F.desc("extracted_at"), F.desc("id"))
    return (
        named.withColumn("place", F.row_number().over(newest_first))
        .where(F.col("place") == 1)
        .drop("place")
    )


def stage_measurements(raw: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """Deduplicate, then parse the survivors: what is dropped is never parsed or shuffled."""
    value = F.col("value_raw")
    return newest_extraction(raw, part).select(
        *part,
        F.col("id").alias("lab_result_id"),
        "source_file",
        "extracted_at",
        "extraction_method",
        "report_date",
        "provider",
        "biomarker_name",
        "value_raw",
        censored_value(value).alias("value_numeric"),
        F.col("unit_raw").alias("unit"),
        is_below_limit(value).alias("is_below_detection_limit"),
        is_above_limit(value).alias("is_above_detection_limit"),
        plain_number(F.col("reference_range_low_raw")).alias("reference_range_low"),
        plain_number(F.col("reference_range_high_raw")).alias("reference_range_high"),
        "loinc_code",
        "notes",
    )


def newest_staged(staged: DataFrame) -> DataFrame:
    """Of staged rows from several loads the last extracted one per date, name and provider."""
    newest_first = Window.partitionBy("report_date", "biomarker_name", "provider").orderBy(
        F.desc("extracted_at"), F.desc("lab_result_id")
    )
    ranked = staged.withColumn("place", F.row_number().over(newest_first))
    return ranked.where(F.col("place") == 1).drop("place")


def newest_two(staged: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """The two newest staged rows per measurement name: all that a snapshot needs.

    Taken ahead of the join with a reference dimension too large to broadcast, it keeps a hot
    name from gathering in one task of that join.
    """
    newest_first = Window.partitionBy(*part, "biomarker_name").orderBy(
        F.desc_nulls_last("report_date"), F.desc("lab_result_id")
    )
    ranked = staged.withColumn("place", F.row_number().over(newest_first))
    return ranked.where(F.col("place") <= 2).drop("place")
