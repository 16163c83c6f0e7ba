"""Exports of loaded documents by year (SNK11)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake import fixed_values as fixed
from assaylake.functions.display import slug, year_part
from assaylake.sources.named_files import write_named

DOCUMENT = ("biomarkers", "document_summary", "metadata", "source_file", "extracted_at", "extraction_method")


def export_rows(good: DataFrame) -> DataFrame:
    """Documents with the names their JSON and narrative go by, as the first measurement
    dates and names them; the time of day in the JSON's name is that of the extraction."""
    unknown = F.lit(fixed.UNKNOWN_PART)
    day = F.coalesce(F.col("first_report_date").cast("string"), unknown)
    provider = slug(F.coalesce("first_provider", unknown))
    clock = F.date_format(F.col("extracted_at"), "HHmmss")
    kind = F.col("metadata.report_type")
    return good.select(
        year_part(F.col("first_report_date")).alias("year"),
        F.concat(F.concat_ws("_", day, provider, clock), F.lit(".json")).alias("json_name"),
        F.concat(F.concat_ws("_", day, kind, provider), F.lit(".md")).alias("narrative_name"),
        F.col("measurements").alias("biomarkers"),
        "document_summary",
        "metadata",
        "source_file",
        "extracted_at",
        "extraction_method",
    )


def export_documents(good: DataFrame, path: str) -> None:
    """Documents as JSON lines and narratives as text rows with their names, by year."""
    rows = export_rows(good)
    rows.write.mode("overwrite").partitionBy("year").json(f"{path}/documents")
    narratives = rows.select("year", "narrative_name", "document_summary")
    narratives.write.mode("overwrite").partitionBy("year").json(f"{path}/findings")


def _last_by_name(rows: DataFrame, name: Column, content: Column) -> DataFrame:
    """``name, content``: of documents that share a name the one extracted last, as if each were written
    over the one before. Losers are dropped before the shuffle."""
    last = Window.partitionBy("name").orderBy(F.desc("extracted_at"), F.desc("source_file"))
    named = rows.select(name.alias("name"), content.alias("content"), "extracted_at", "source_file")
    ranked = named.withColumn("place", F.row_number().over(last)).where(F.col("place") == 1)
    return ranked.select("name", "content")


def export_files(good: DataFrame, path: str) -> None:
    """A JSON file per document in ``raw``, and its narrative as Markdown in ``findings`` by year."""
    rows = export_rows(good)
    document = F.to_json(F.struct(*DOCUMENT), {"pretty": "true", "ignoreNullFields": "false"})
    write_named(_last_by_name(rows, F.col("json_name"), document), f"{path}/raw", rows_per_name=1)
    narrative = F.concat_ws("/", "year", "narrative_name")
    narratives = _last_by_name(rows, narrative, F.col("document_summary"))
    write_named(narratives, f"{path}/findings", rows_per_name=1)
