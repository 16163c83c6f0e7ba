"""Extraction files: strict validation with quarantine, and the raw rows they give.

A file is taken whole or rejected whole. Validation works on the JSON's own types through
``variant``, because ``from_json`` would quietly turn a number into text.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake import fixed_values as fixed
from assaylake.functions.display import findings_path
from assaylake.functions.text import first_fenced_block
from assaylake.operators.redaction import restore
from assaylake.sources.named_files import read_files

_END = "end of extraction file"
_DATE = r"^\d{4}-\d{2}-\d{2}([T ]00:00(:00(\.0+)?)?Z?)?$"
_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_OFFSET = r"[T ].*(Z|[+-]\d{2}:?\d{2})$"
_OPTIONAL_TEXTS = ("reference_range_low", "reference_range_high", "loinc_code", "notes")

# The document with every leaf as text; whether the leaves were text is checked apart.
_AS_TEXT = """struct<
  biomarkers: array<struct<report_date: string, provider: string, biomarker_name: string,
    value: string, unit: string, reference_range_low: string, reference_range_high: string,
    loinc_code: string, notes: string>>,
  document_summary: string,
  metadata: struct<report_type: string, report_date: string, provider: string,
    tags: array<string>, baseline_candidates: array<string>>,
  source_file: string, extracted_at: string, extraction_method: string>"""

# The document with every leaf as it stands in the JSON, to look at the types of odd ones. What is not there is
# NULL; what has another shape is taken as if nothing were in it.
_AS_FOUND = _AS_TEXT.replace("array<string>", "variant").replace(": string", ": variant")

# Types of a document without surprises, as ``schema_of_variant`` writes them: names in
# alphabetical order, list elements merged.
_LIST_TYPE = "ARRAY<(STRING|VOID)>"
_ROW_TYPE = (
    "OBJECT<((biomarker_name|loinc_code|notes|provider|reference_range_high|reference_range_low"
    "|report_date|unit|value): (STRING|VOID)(, |(?=>)))+>"
)
_PLAIN_TYPES = (
    f"^OBJECT<biomarkers: ARRAY<(VOID|{_ROW_TYPE})>, document_summary: STRING"
    "(, extracted_at: STRING)?(, extraction_method: STRING)?"
    f", metadata: OBJECT<(baseline_candidates: {_LIST_TYPE}, )?(provider: (STRING|VOID), )?"
    f"(report_date: (STRING|VOID), )?report_type: STRING(, tags: {_LIST_TYPE})?>"
    "(, source_file: STRING)?>$"
)


def whole_files(spark: SparkSession, directory: str, **options: object) -> DataFrame:
    """``value``, the text of each file, with ``_metadata``. The same as whole texts, but Spark's text source
    copies the whole configuration for every file, which takes longer than a small file does."""
    files = spark.read.format("binaryFile").options(**options).load(directory)
    return files.select(F.col("content").cast("string").alias("value"), "_metadata")


def read_extraction_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, content)`` of every ``*.json`` file in a directory."""
    files = whole_files(spark, directory, pathGlobFilter="*.json")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def extraction_files_by_tasks(spark: SparkSession, directory: str) -> DataFrame:
    """What ``read_extraction_files`` gives, for directories of millions of files: tasks list and read them, where
    Spark's sources list them in the driver."""
    files = read_files(spark, directory, "*.json")
    if files is None:
        return read_extraction_files(spark, directory)
    return files.select("path", F.col("content").cast("string").alias("content"))


def read_text_reports(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Plain-text reports as ``(path, content)`` and, apart, the paths of all other files.

    The suffix is part of the file listing, so no other file is opened as text.
    """
    any_case = ["".join(f"[{c}{c.upper()}]" for c in suffix) for suffix in fixed.TEXT_SUFFIXES]
    texts = spark.read.text(
        directory, wholetext=True, pathGlobFilter="*.{" + ",".join(any_case) + "}"
    ).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    listed = spark.read.format("binaryFile").load(directory).select("path")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return texts, listed.where(~suffix.isin(*fixed.TEXT_SUFFIXES))


def _framed(content: Column) -> Column:
    """The text and an end mark as a JSON list, so that nothing may follow the document."""
    return F.try_parse_json(F.concat(F.lit("["), content, F.lit(f', "{_END}"]')))


def _whole_document(framed: Column) -> Column:
    ends_here = F.try_variant_get(framed, "$[1]", "string") == _END
    return F.when(ends_here, F.try_variant_get(framed, "$[0]", "variant"))


def _kind(field: Column) -> Column:
    """JSON type of a field: ``VOID`` for null, ``missing`` if absent."""
    return F.coalesce(F.schema_of_variant(field), F.lit("missing"))


def _text(field: Column) -> Column:
    return F.try_variant_get(field, "$", "string")


def _date(text: Column) -> Column:
    return F.when(text.rlike(_DATE), F.substring(text, 1, 10).try_cast("date"))


def _instant(text: Column) -> Column:
    """Time without zone; a text with an offset is moved to the session's zone."""
    local = text.try_cast("timestamp_ntz")
    moved = text.try_cast("timestamp").cast("timestamp_ntz")
    return F.when(text.rlike(_TIME), F.when(text.rlike(_OFFSET), moved).otherwise(local))


def _measurement_errors(e: Column) -> dict[str, Column]:
    errors = {name: _kind(e[name]) != "STRING" for name in ("provider", "biomarker_name")}
    errors["report_date"] = (_kind(e["report_date"]) != "STRING") | _date(_text(e["report_date"])).isNull()
    errors["value"] = ~_kind(e["value"]).isin("STRING", "VOID")
    for name in ("unit", *_OPTIONAL_TEXTS):
        errors[name] = ~_kind(e[name]).isin("STRING", "VOID", "missing")
    return errors


def _incomplete(e: Column) -> Column:
    """A row to examine: something required is null or absent."""
    required = ("provider", "biomarker_name", "value")
    return reduce(Column.__or__, [e[name].isNull() for name in required], e.isNull())


def _list_is_bad(field: Column) -> Column:
    items = F.try_variant_get(field, "$", "array<variant>")
    all_text = F.forall(items, lambda i: F.schema_of_variant(i) == "STRING")
    return (_kind(field) != "missing") & ~F.coalesce(all_text, F.lit(False))


def _document_errors(doc: Column, given: bool) -> Column:
    """The fields at fault of a document taken apart as ``_AS_FOUND``."""
    meta, rows = doc["metadata"], doc["biomarkers"]
    source, method, time = _kind(doc["source_file"]), _kind(doc["extraction_method"]), doc["extracted_at"]
    day = meta["report_date"]
    bad = {
        "biomarkers": rows.isNull(),
        "document_summary": _kind(doc["document_summary"]) != "STRING",
        "source_file": source != ("missing" if given else "STRING"),
        "extraction_method": ~method.isin(*(["missing"] if given else ["STRING", "missing"])),
        "extracted_at": (_kind(time) != "missing") & ((_kind(time) != "STRING") | _instant(_text(time)).isNull()),
        "metadata.report_type": _kind(meta["report_type"]) != "STRING",
        "metadata.provider": ~_kind(meta["provider"]).isin("STRING", "VOID", "missing"),
        "metadata.report_date": ~_kind(day).isin("VOID", "missing")
        & ((_kind(day) != "STRING") | _date(_text(day)).isNull()),
        "metadata.tags": _list_is_bad(meta["tags"]),
        "metadata.baseline_candidates": _list_is_bad(meta["baseline_candidates"]),
    }
    messages = [F.when(cond, F.lit(name)) for name, cond in bad.items()]

    def row_errors(e: Column) -> Column:
        checks = _measurement_errors(e)
        return F.array_compact(
            F.array(*[F.when(c, F.lit(f"biomarkers.{n}")) for n, c in checks.items()])
        )

    in_rows = F.array_distinct(F.flatten(F.transform(rows, row_errors)))
    none = F.array().cast("array<string>")
    return F.concat(F.array_compact(F.array(*messages)), F.coalesce(in_rows, none))


def check_extractions(files: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per file, as ``schemas.CHECKED_FILE``: its document, or why it is rejected.

    ``errors`` lists the fields at fault and is empty for a good file. ``now`` stands in for a
    missing extraction time. Columns ``given_source`` and ``given_method``, where ``files`` has
    them, take the place of the document's own fields.
    """
    given = "given_source" in files.columns
    now = F.localtimestamp() if now is None else now
    doc, typed, rows = F.col("_doc"), F.col("_typed"), F.col("measurements")
    meta = typed["metadata"]

    def measurement(e: Column) -> Column:
        return F.struct(
            _date(e["report_date"]).alias("report_date"),
            e["provider"].alias("provider"),
            e["biomarker_name"].alias("biomarker_name"),
            F.coalesce(e["value"], F.lit("")).alias("value"),
            F.coalesce(e["unit"], F.lit("")).alias("unit"),
            *[e[name].alias(name) for name in _OPTIONAL_TEXTS],
        )

    def texts(name: str) -> Column:
        return F.coalesce(meta[name], F.array().cast("array<string>")).alias(name)

    parsed = (
        files.withColumn("_framed", _framed(F.col("content")))
        .withColumn("_doc", _whole_document(F.col("_framed")))
        .withColumn("_typed", F.try_variant_get(doc, "$", _AS_TEXT))
        .withColumn("measurements", F.transform(typed["biomarkers"], measurement))
        .withColumn("_time", _instant(typed["extracted_at"]))
        .withColumn("_day", _date(meta["report_date"]))
    )
    # Most documents are plain and need one look at their types; the others are examined field
    # by field.
    plain = (
        F.schema_of_variant(doc).rlike(_PLAIN_TYPES)
        & (F.col("given_source").isNotNull() if given else typed["source_file"].isNotNull())
        & (typed["extracted_at"].isNull() | F.col("_time").isNotNull())
        & (meta["report_date"].isNull() | F.col("_day").isNotNull())
        & ~F.exists(typed["biomarkers"], _incomplete)
        & ~F.exists(rows, lambda m: m["report_date"].isNull())
        & ~F.exists(texts("tags"), F.isnull)
        & ~F.exists(texts("baseline_candidates"), F.isnull)
    )
    if given:
        plain = plain & typed["source_file"].isNull() & typed["extraction_method"].isNull()
    # A lambda's argument holds what is found once, for all checks that look at it.
    found = F.array(F.try_variant_get(doc, "$", _AS_FOUND))
    errors = (
        F.when(plain, F.array().cast("array<string>"))
        .when(doc.isNull(), F.array(F.lit("not a JSON document")))
        .otherwise(F.flatten(F.transform(found, lambda d: _document_errors(d, given))))
    )
    method = F.coalesce(typed["extraction_method"], F.lit(fixed.DEFAULT_METHOD))
    first = F.try_element_at(rows, F.lit(1))
    checked = parsed.select(
        "path",
        (F.col("given_source") if given else typed["source_file"]).alias("source_file"),
        errors.alias("errors"),
        F.coalesce("_time", now).alias("extracted_at"),
        (F.col("given_method") if given else method).alias("extraction_method"),
        typed["document_summary"].alias("document_summary"),
        F.struct(
            meta["report_type"].alias("report_type"),
            F.col("_day").alias("report_date"),
            meta["provider"].alias("provider"),
            texts("tags"),
            texts("baseline_candidates"),
        ).alias("metadata"),
        first["report_date"].alias("first_report_date"),
        first["provider"].alias("first_provider"),
        F.coalesce(F.size(rows), F.lit(0)).alias("measurement_count"),
        "measurements",
    )
    # A generator of one row: a filter on the errors stays above it. Pushed below, it would
    # parse the file once per field it looks at.
    return checked.select(F.inline(F.array(F.struct("*"))))


def good_files(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0)


def rejected_files(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0).select("path", "errors")


def parse_extractions(files: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``; the batch goes on past bad files."""
    checked = check_extractions(files, now)
    return good_files(checked), rejected_files(checked)


def first_by_source(good: DataFrame) -> DataFrame:
    """The first file by path for each source; map tasks send at most one file per source."""
    by_path = Window.partitionBy("source_file").orderBy("path")
    first = good.withColumn("place", F.row_number().over(by_path)).where(F.col("place") == 1)
    return first.drop("place")


def new_documents(good: DataFrame, existing_docs: DataFrame) -> DataFrame:
    """Files to load: the first by path for each source, unless the source is known already.

    The anti join runs on the partitioning of the first.
    """
    known = existing_docs.select("source_file")
    return first_by_source(good).join(known, "source_file", "left_anti")


def document_rows(good: DataFrame) -> DataFrame:
    """Rows of the raw document table; the metadata goes before the first measurement."""
    meta = F.col("metadata")
    provider = F.coalesce(
        F.when(meta["provider"] != "", meta["provider"]), F.col("first_provider")
    )
    report_date = F.coalesce(meta["report_date"], F.col("first_report_date"))
    candidates = meta["baseline_candidates"]
    return good.select(
        F.sha2("source_file", 256).alias("id"),
        "source_file",
        report_date.alias("report_date"),
        provider.alias("provider"),
        meta["report_type"].alias("report_type"),
        F.array_join(meta["tags"], ",").alias("tags"),
        findings_path(report_date, meta["report_type"], provider).alias("markdown_path"),
        F.col("measurement_count").alias("biomarker_count"),
        "extracted_at",
        "extraction_method",
        "document_summary",
        F.when(F.size(candidates) > 0, F.to_json(candidates)).alias("baseline_candidates"),
    )


def measurement_rows(good: DataFrame) -> DataFrame:
    """Rows of the raw measurement table; ids come from source and position, so a rerun of a
    lost task gives the same ones."""
    flat = good.select(
        "source_file",
        "extracted_at",
        "extraction_method",
        F.posexplode("measurements").alias("position", "m"),
    )
    return flat.select(
        F.sha2(F.concat_ws("\n", "source_file", F.col("position").cast("string")), 256).alias("id"),
        "source_file",
        "extracted_at",
        "extraction_method",
        "m.report_date",
        "m.provider",
        F.col("m.biomarker_name").alias("biomarker_name_raw"),
        F.col("m.value").alias("value_raw"),
        F.col("m.unit").alias("unit_raw"),
        F.col("m.reference_range_low").alias("reference_range_low_raw"),
        F.col("m.reference_range_high").alias("reference_range_high_raw"),
        "m.loinc_code",
        "m.notes",
    )


def load_statistics(checked: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row: files found, loaded and rejected, and measurement rows inserted."""
    none = F.lit(0).cast("long")
    found = checked.select(
        F.lit(1).alias("files_found"),
        none.alias("files_loaded"),
        none.alias("rows_inserted"),
        (F.size("errors") > 0).cast("int").alias("files_rejected"),
    )
    taken = loaded.select(
        none.alias("files_found"),
        F.lit(1).alias("files_loaded"),
        F.col("measurement_count").alias("rows_inserted"),
        none.alias("files_rejected"),
    )
    names = ("files_found", "files_loaded", "rows_inserted", "files_rejected")
    return found.unionByName(taken).agg(*[F.coalesce(F.sum(n), none).alias(n) for n in names])


def check_responses(
    responses: DataFrame, method: str = fixed.DEFAULT_METHOD, now: Column | None = None
) -> DataFrame:
    """Check model responses ``(source_file, response, mapping)`` like extraction files.

    The fenced block is taken and its placeholders are restored before it is parsed. Source and
    method come from the table; a response that names them itself is rejected.
    """
    fenced = responses.withColumn("response", first_fenced_block(F.col("response")))
    bodies = restore(fenced, "response", "mapping")
    files = bodies.select(
        F.col("source_file").alias("path"),
        F.col("response").alias("content"),
        F.col("source_file").alias("given_source"),
        F.lit(method).alias("given_method"),
    )
    return check_extractions(files, now)
