"""Schemas of the raw tables and of the nested extraction document."""

from pyspark.sql import types as T


TEXTS = T.ArrayType(T.StringType())

MEASUREMENT = (
    T.StructType()
    .add("report_date", "date")
    .add("provider", "string")
    .add("biomarker_name", "string")
    .add("value", "string")
    .add("unit", "string")
    .add("reference_range_low", "string")
    .add("reference_range_high", "string")
    .add("loinc_code", "string")
    .add("notes", "string")
)

METADATA = (
    T.StructType()
    .add("report_type", "string")
    .add("report_date", "date")
    .add("provider", "string")
    .add("tags", TEXTS)
    .add("baseline_candidates", TEXTS)
)

# One validated (or rejected) extraction file.
CHECKED_FILE = (
    T.StructType()
    .add("path", "string")
    .add("source_file", "string")
    .add("errors", TEXTS)
    .add("extracted_at", "timestamp_ntz")
    .add("extraction_method", "string")
    .add("document_summary", "string")
    .add("metadata", METADATA)
    .add("first_report_date", "date")
    .add("first_provider", "string")
    .add("measurement_count", "integer")
    .add("measurements", T.ArrayType(MEASUREMENT))
)

LAB_RESULTS = (
    T.StructType()
    .add("id", "string")
    .add("source_file", "string")
    .add("extracted_at", "timestamp_ntz")
    .add("extraction_method", "string")
    .add("report_date", "date")
    .add("provider", "string")
    .add("biomarker_name_raw", "string")
    .add("value_raw", "string")
    .add("unit_raw", "string")
    .add("reference_range_low_raw", "string")
    .add("reference_range_high_raw", "string")
    .add("loinc_code", "string")
    .add("notes", "string")
)

DOCUMENTS = (
    T.StructType()
    .add("id", "string")
    .add("source_file", "string")
    .add("report_date", "date")
    .add("provider", "string")
    .add("report_type", "string")
    .add("tags", "string")
    .add("markdown_path", "string")
    .add("biomarker_count", "integer")
    .add("extracted_at", "timestamp_ntz")
    .add("extraction_method", "string")
    .add("document_summary", "string")
    .add("baseline_candidates", "string")
)

# What a stream brings: checked files, and the sources that it has not met before.
ARRIVALS = T.StructType([*CHECKED_FILE.fields]).add("is_new", "boolean")

REJECTED = T.StructType().add("path", "string").add("errors", TEXTS)

REFERENCE_DIMENSION = (
    T.StructType()
    .add("biomarker_key", "string")
    .add("loinc_code", "string")
    .add("conventional_unit", "string")
    .add("si_unit", "string")
    .add("conversion_factor", "double")
    .add("category", "string")
    .add("optimal_range_low_si", "double")
    .add("optimal_range_high_si", "double")
)

# Columns that must not be NULL, and columns that must be unique, in the raw tables.
LAB_RESULTS_REQUIRED = (
    "id",
    "source_file",
    "extracted_at",
    "extraction_method",
    "report_date",
    "provider",
    "biomarker_name_raw",
    "value_raw",
    "unit_raw",
)
DOCUMENTS_REQUIRED = (
    "id",
    "source_file",
    "report_type",
    "biomarker_count",
    "extracted_at",
    "extraction_method",
)
