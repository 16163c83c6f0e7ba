"""Registered queries: every operator over whole tables of a directory."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake import schemas
from assaylake.functions.sql import create_functions
from assaylake.functions.text import first_fenced_block
from assaylake.functions.values import (
    censored_value,
    is_above_limit,
    is_below_limit,
    plain_number,
)
from assaylake.operators import digests, history, quality, redaction
from assaylake.operators.compare import compare_facts, compare_summary
from assaylake.operators.marts import (
    document_dimension,
    measurement_facts,
    to_conventional_units,
)
from assaylake.operators.staging import newest_extraction, newest_two, stage_measurements
from assaylake.plans import questions, report_lines, reports, workflow
from assaylake.sources import exports, extraction, raw_tables
from assaylake.sources.named_files import read_files, write_named
from assaylake.sources.reference_dim import read_reference_dimension
from assaylake.sources.shared import shared_folder, stored
from assaylake.streaming.incremental import start_load, start_stateful_load
from registry import extraction_files, views
from registry.oracle_texts import (
    DELETED,
    GENERATED,
    LISTED,
    PLAIN_WORD,
    RUN_1,
    RUN_2,
    SECOND_LOAD,
    SOURCE,
    TO_REDACT,
)

Query = Callable[[SparkSession, str], DataFrame]

#: Files of a part of the event stream, and the rows of the table from which parts have as many.
PART_FILES, PARTED_ROWS = 48, 20_000

#: Events whose documents one task makes and parses.
DEALT_ROWS = 50_000


class Lab:
    """The lab-shaped views of one directory and what is derived from them, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def view(self, text: str) -> DataFrame:
        return views.in_spark(self.spark, self.sf_dir, text)

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    @property
    def raw(self) -> DataFrame:
        return self.view(views.LAB_RESULTS).drop("subject")

    @property
    def meta(self) -> DataFrame:
        return self.view(views.META)

    @property
    def docs(self) -> DataFrame:
        return self.view(views.DOCUMENTS)

    @property
    def staged(self) -> DataFrame:
        return stage_measurements(self.raw)

    @property
    def facts(self) -> DataFrame:
        return measurement_facts(self.staged, self.meta)

    @property
    def documents(self) -> DataFrame:
        return document_dimension(self.docs, self.staged)

    @property
    def staged_large(self) -> DataFrame:
        return stage_measurements(self.view(views.LAB_RESULTS_LARGE))

    @property
    def facts_large(self) -> DataFrame:
        return measurement_facts(self.staged_large, self.view(views.META_LARGE))

    @property
    def env_facts(self) -> DataFrame:
        """Facts of the second environment: keys renamed, values missing or shifted."""
        number, value = F.col("lab_result_id"), F.col("value_si")
        key = F.col("biomarker_key")
        renamed = F.when(number % 11 == 0, F.concat(key, F.lit("_new"))).otherwise(key)
        changed = F.when(number % 7 == 0, value + 1).otherwise(value)
        return self.facts.withColumns(
            {"biomarker_key": renamed, "value_si": F.when(number % 5 != 0, changed)}
        )

    @property
    def files_dealt(self) -> DataFrame:
        """The extraction files from evenly dealt events: a table of few row groups would leave most cores
        idle while the texts are made and parsed. Ranges keep what is near in the table together."""
        events = self.table("events")
        parts = events.count() // DEALT_ROWS + 1
        events = events.repartitionByRange(parts, "event_id")
        return self.spark.sql(extraction_files.FILES, events=events)

    @property
    def checked_files(self) -> DataFrame:
        files = self.view(extraction_files.FILES)
        return extraction.check_extractions(files, _now())

    @property
    def profile(self) -> dict[str, DataFrame]:
        return {
            "conditions": self.view(views.CONDITIONS),
            "variants": self.view(views.VARIANTS),
            "patterns": self.view(views.PATTERNS),
        }


def _now() -> Column:
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


def _run(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _generated() -> Column:
    return F.lit(GENERATED).cast("date")


def _censored_parse(lab: Lab) -> DataFrame:
    raw = F.col("value_raw")
    return lab.raw.select(
        "id",
        "value_raw",
        censored_value(raw).alias("value_numeric"),
        is_below_limit(raw).alias("below"),
        is_above_limit(raw).alias("above"),
        plain_number(F.col("reference_range_low_raw")).alias("low"),
        plain_number(F.col("reference_range_high_raw")).alias("high"),
    )


def _count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("facts"))


def _conventional(lab: Lab) -> DataFrame:
    return to_conventional_units(lab.facts, lab.meta).select(
        "lab_result_id", "biomarker_key", "value_si", "value_conventional", "unit_conventional"
    )


def _snapshot_per_subject(lab: Lab) -> DataFrame:
    raw = lab.view(views.LAB_RESULTS)
    part = ("subject",)
    facts = measurement_facts(stage_measurements(raw, part), lab.meta, part)
    return reports.current_snapshot(facts, part)


def _snapshot_at_scale(lab: Lab) -> DataFrame:
    """The dimension grows with the data here, so rows are cut to two per name before it."""
    facts = measurement_facts(newest_two(lab.staged_large), lab.view(views.META_LARGE))
    return reports.current_snapshot(facts)


def _compare_at_scale(lab: Lab) -> DataFrame:
    """Line items of a third of the suppliers differ, others moved to another provider."""
    facts = lab.facts_large
    supplier = F.regexp_extract("provider", r"(\d+)", 1).cast("long")
    moved = F.when(supplier % 7 == 0, F.concat("provider", F.lit("b"))).otherwise(F.col("provider"))
    shifted = F.when(supplier % 3 == 0, F.col("value_si") * 2).otherwise(F.col("value_si"))
    other = facts.withColumns({"provider": moved, "value_si": shifted})
    return compare_facts(facts, other)


def _relationships_at_scale(lab: Lab) -> DataFrame:
    meta = lab.view(views.META_LARGE)
    return quality.check_relationship(
        lab.staged_large, "biomarker_name", meta, "biomarker_key", "stg_lab_results"
    )


def _facts_on_date(lab: Lab) -> DataFrame:
    """Ad-hoc SQL over a registered view."""
    lab.facts.createOrReplaceTempView("fct_biomarkers")
    return lab.spark.sql("select * from fct_biomarkers where report_date = '2024-01-20'")


def _scd2(lab: Lab) -> DataFrame:
    half = F.to_date(F.lit("2024-01-15"))
    staged = lab.staged
    first = history.newest_range(staged.where(F.col("report_date") < half))
    second = history.newest_range(staged.where(F.col("report_date") >= half))
    return history.merge_range_history(
        history.open_history(first, _run(RUN_1)), second, _run(RUN_2)
    )


def _dq_unique(lab: Lab) -> DataFrame:
    parts = (
        quality.check_unique(lab.raw, ["id"], "lab_results"),
        quality.check_unique(lab.docs, ["id", "source_file"], "documents"),
        quality.check_unique(lab.staged, ["lab_result_id"], "stg_lab_results"),
        quality.check_unique(lab.facts, ["lab_result_id"], "fct_biomarkers"),
        quality.check_unique(lab.documents, ["document_id", "source_file"], "dim_documents"),
    )
    first, *rest = parts
    for one in rest:
        first = first.unionByName(one)
    return first


def _dq_not_null(lab: Lab) -> DataFrame:
    columns = ["lab_result_id", "value_si", "category", "is_within_ref_range"]
    return quality.check_not_null(lab.facts, columns, "fct_biomarkers", quality.WARN)


def _dq_relationships(lab: Lab) -> DataFrame:
    return quality.check_relationship(
        lab.facts, "biomarker_key", lab.meta, "biomarker_key", "fct_biomarkers", quality.WARN
    )


def _unit_mismatch(lab: Lab) -> DataFrame:
    facts = lab.facts
    relabelled = facts.withColumn("unit_original", F.lit("eur"))
    return quality.unit_mismatch(facts.unionByName(relabelled), lab.meta).select(
        "lab_result_id", "biomarker_key", "unit_original", "conventional_unit"
    )


def _redacted(lab: Lab, texts: DataFrame | None = None) -> DataFrame:
    texts = lab.table("documents") if texts is None else texts
    return redaction.redact(
        texts.select("doc_id", "lang", "text"), "text", redaction.redaction_list(TO_REDACT)
    )


def _redact_text(lab: Lab) -> DataFrame:
    entries = F.map_entries("redacted_strings")
    found = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";")))
    return _redacted(lab).select("doc_id", "text", F.array_join(found, "").alias("found"))


def _redact_many(lab: Lab) -> DataFrame:
    """Texts without the longest of their own plain words."""
    texts = lab.table("documents").select("doc_id", "text")
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(PLAIN_WORD), F.lit(0))).alias("w"))
    words = words.distinct().orderBy(F.desc(F.length("w")), "w").limit(LISTED)
    strings = redaction.redaction_list(r.w for r in words.collect())
    return redaction.redact_many(texts, "text", strings).select("doc_id", "text")


def _responses(lab: Lab) -> DataFrame:
    """Redacted texts as they would come back in a fenced JSON answer."""
    measurement = F.struct(
        F.lit("2024-01-01").alias("report_date"),
        F.lit("lab").alias("provider"),
        F.lit("length").alias("biomarker_name"),
        F.length("text").cast("string").alias("value"),
    )
    body = F.to_json(
        F.struct(
            F.array(measurement).alias("biomarkers"),
            F.col("text").alias("document_summary"),
            F.struct(F.col("lang").alias("report_type")).alias("metadata"),
        )
    )
    answer = F.concat(F.lit("As asked:\n```json\n"), body, F.lit("\n```\nDone."))
    return _redacted(lab, lab.table("documents")).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"),
        answer.alias("response"),
        F.col("redacted_strings").alias("mapping"),
    )


def _responses_to_documents(lab: Lab) -> DataFrame:
    checked = extraction.check_responses(_responses(lab), "manual", _now())
    return extraction.document_rows(extraction.good_files(checked)).select(
        "source_file", "document_summary", "report_type", "biomarker_count", "extraction_method"
    )


def _conditions(lab: Lab) -> DataFrame:
    return reports.conditions_by_priority(lab.view(views.CONDITIONS)).select(
        "name", "status", "rank", "position", "origin"
    )


def _marts(lab: Lab) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staging, facts and documents, each written once and read by what follows it."""
    folder = shared_folder(lab.spark, "marts")
    staged = stored(lab.staged, folder, "staged")
    facts = stored(measurement_facts(staged, lab.meta), folder, "facts")
    return staged, facts, stored(document_dimension(lab.docs, staged), folder, "documents")


def _declared_checks(lab: Lab) -> DataFrame:
    return quality.declared_checks(lab.raw, lab.docs, *_marts(lab), lab.meta)


def _profile_lines(lab: Lab) -> DataFrame:
    _, facts, documents = _marts(lab)
    return report_lines.profile_lines(facts, documents, _generated(), **lab.profile)


def _reports_written(lab: Lab) -> DataFrame:
    """The four reports as text files, read back."""
    folder = shared_folder(lab.spark, "reports")
    report_lines.write_reports(_profile_lines(lab), folder)
    return lab.spark.read.text(folder).select("report", F.col("value").alias("line"))


def _loaded(lab: Lab) -> str:
    """Raw tables loaded from the event documents; their folder."""
    root = shared_folder(lab.spark, "raw")
    raw_tables.load_files(lab.files_dealt, root, "first", _now())
    return root


def _workflow_facts(lab: Lab) -> DataFrame:
    root = _loaded(lab)
    workflow.transform(lab.spark, root, lab.meta, _run(RUN_1))
    return workflow.read_mart(lab.spark, root, workflow.FACTS)


def _event(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(\d+)", 1).cast("long")


def _refreshed(lab: Lab) -> str:
    """Two loads with a run after each; the second brings later files, with another lower bound, and
    sources that were deleted in between. Only what this touches is written again."""
    spark, root, files = lab.spark, shared_folder(lab.spark, "refreshed"), lab.files_dealt
    bound = F.replace("content", F.lit('range_low": "10"'), F.lit('range_low": "20"'))
    later = F.when(_event() >= SECOND_LOAD, bound).otherwise(F.col("content"))
    files = files.withColumn("content", later)
    raw_tables.load_files(files.where(_event() < SECOND_LOAD), root, "first", _now())
    workflow.refresh(spark, root, lab.meta, _run(RUN_1))
    raw_tables.delete_sources(spark, root, DELETED)
    raw_tables.load_files(files, root, "second", _now())
    workflow.refresh(spark, root, lab.meta, _run(RUN_2))
    return root


def _refreshed_mart(lab: Lab, table: str) -> DataFrame:
    return workflow.read_mart(lab.spark, _refreshed(lab), table)


def _two_environments(lab: Lab) -> str:
    """Production, and a trial without some sources and with other values in some. Neither reads what the
    other writes, so they are built side by side."""
    root, files = shared_folder(lab.spark, "environments"), lab.files_dealt
    kind = _event() % 20
    changed = F.replace("content", F.lit('"value": "'), F.lit('"value": "9'))
    trial = files.where(kind != 14).withColumn(
        "content", F.when(kind == 15, changed).otherwise(F.col("content"))
    )

    @inheritable_thread_target(lab.spark)
    def build(home: str, content: DataFrame) -> None:
        raw_tables.load_files(content, home, "first", _now())
        workflow.refresh(lab.spark, home, lab.meta, _run(RUN_1))

    with ThreadPoolExecutor(2) as pool:
        built = [pool.submit(build, root, files)]
        built.append(pool.submit(build, raw_tables.environment_root(root, "trial"), trial))
    for one in built:
        one.result()
    return root


def _environments_compared(lab: Lab) -> DataFrame:
    return workflow.compare(lab.spark, _two_environments(lab), "trial")


def _environments_in_sql(lab: Lab) -> DataFrame:
    """Ad-hoc SQL over the registered tables of both environments."""
    root, spark = _two_environments(lab), lab.spark
    workflow.register_tables(spark, root)
    workflow.register_tables(spark, root, "trial")
    # read before other queries register tables of these names
    found = spark.sql("""
        select d.source_file, d.biomarker_count, t.biomarker_count as trial_count,
               f.value_si, g.value_si as trial_value, f.biomarker_key, l.value_raw, l.load_batch
        from main.dim_documents d
        left join trial_main.dim_documents t on t.source_file = d.source_file
        left join main.fct_biomarkers f on f.source_file = d.source_file
        left join trial_main.fct_biomarkers g on g.lab_result_id = f.lab_result_id
        left join raw.lab_results l on l.id = f.lab_result_id
    """)
    return stored(found, shared_folder(spark, "adhoc"), "found")


def _facts_in_sql(lab: Lab) -> DataFrame:
    """Facts with status and conventional value by SQL alone, the rules as SQL functions."""
    spark = lab.spark
    create_functions(spark, "rules")
    return spark.sql(
        """
        with valued as (
          select s.*, rules.censored_value(s.value_raw) as value, m.conversion_factor as factor,
                 m.optimal_range_low_si as best_low, m.optimal_range_high_si as best_high
          from {staged} s left join {meta} m on s.biomarker_name = m.biomarker_key),
        flagged as (
          select *, rules.to_si(value, factor) as value_si,
                 rules.in_reference(value, reference_range_low, reference_range_high) as in_range,
                 rules.in_optimal(value, factor, best_low, best_high) as optimal
          from valued)
        select lab_result_id, value_si, rules.from_si(value_si, factor) as value_conventional,
               rules.status_label(rules.is_below_limit(value_raw), optimal, in_range) as status,
               rules.trend_label(value_si, lag(value_si) over (
                 partition by biomarker_name order by report_date, lab_result_id)) as trend
        from flagged
        """,
        staged=lab.staged,
        meta=lab.meta,
    )


def _workflow_run(lab: Lab) -> DataFrame:
    """A directory of extraction files, from its loading to its reports."""
    folder = shared_folder(lab.spark, "run")
    files = lab.view(extraction_files.FILES)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    # dealt out by name, however few files the table has; a name that comes twice is refused
    write_named(named.repartition("name"), f"{folder}/in", rows_per_name=1)
    workflow.run(lab.spark, f"{folder}/in", f"{folder}/lake", "first", lab.meta, _run(RUN_1))
    return workflow.read_mart(lab.spark, f"{folder}/lake", workflow.FACTS)


def _exported_files(lab: Lab) -> DataFrame:
    """Documents and narratives as files of their own, read back by name."""
    folder = shared_folder(lab.spark, "files")
    exports.export_files(_new_good(lab), folder)

    def read(part: str, glob: str) -> DataFrame:
        rows = read_files(lab.spark, f"{folder}/{part}", glob, recursive=True)
        name = F.substring_index("path", f"/{part}/", -1)
        return rows.select(F.concat(F.lit(f"{part}/"), name).alias("name"), F.col("content").cast("string").alias("value"))

    source = F.get_json_object("value", "$.source_file")
    documents = read("raw", "*.json").select("name", source.alias("content"))
    narratives = read("findings", "*.md").select("name", F.col("value").alias("content"))
    return stored(documents.unionByName(narratives), folder, "found")


def _report_files(lab: Lab) -> DataFrame:
    """The four reports as one Markdown file each, read back."""
    folder = shared_folder(lab.spark, "report-files")
    report_lines.write_report_files(_profile_lines(lab), folder)
    report = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1)
    lines = lab.spark.read.option("lineSep", "\n").text(folder)
    return lines.select(report.alias("report"), F.col("value").alias("line"))


def _write_files(df: DataFrame, path: str, number: int) -> None:
    """Exactly so many files, as Spark leaves out empty ones but for the first."""
    (df.coalesce(1) if number == 1 else df.repartition(number)).write.parquet(path)
    written = len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())
    if written != number:
        raise ValueError(f"{written} files instead of {number}: {path}")


def _stateful_ingest(lab: Lab) -> DataFrame:
    """The event table as a stream of five parts, in small batches with a restart between them. A part is one
    micro-batch, so all have the same number of files; several where there are rows enough to fill all of them."""
    root = shared_folder(lab.spark, "stateful")
    events = lab.table("events")
    limits, rows = events.select(
        F.percentile_approx("event_id", [0.2, 0.4, 0.6, 0.8]), F.count("event_id")
    ).first()
    files_each = PART_FILES if rows >= PARTED_ROWS else 1
    for number, (low, high) in enumerate(zip([None, *limits], [*limits, None], strict=True)):
        inside = F.lit(True) if low is None else F.col("event_id") > low
        inside = inside if high is None else inside & (F.col("event_id") <= high)
        _write_files(events.where(inside), f"{root}/in/{number}", files_each)
        if number in (1, 4):  # start, and start again with what has come meanwhile
            stream = lab.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files_each)
            stream = stream.option("recursiveFileLookup", True).parquet(f"{root}/in")
            files = lab.spark.sql(extraction_files.FILES, events=stream)
            start_stateful_load(files, root, f"{root}/checkpoint", _now()).awaitTermination()
    return raw_tables.read_raw(lab.spark, root, "lab_results").drop(raw_tables.BATCH)


def _deleted_source(lab: Lab) -> DataFrame:
    root = _loaded(lab)
    raw_tables.delete_sources(lab.spark, root, DELETED)
    return raw_tables.read_raw(lab.spark, root, "lab_results").drop(raw_tables.BATCH)


def _purged_files(lab: Lab) -> DataFrame:
    """All measurements that stand in the files after a purge, whether they count or not."""
    root = _loaded(lab)
    raw_tables.delete_sources(lab.spark, root, DELETED)
    workflow.purge(lab.spark, root)
    return raw_tables.stored_rows(lab.spark, root, "lab_results").drop(
        raw_tables.BATCH, raw_tables.ATTEMPT
    )


def _reloaded_source(lab: Lab) -> DataFrame:
    """Deleted sources come back with the next load; all others stay as they were."""
    root = _loaded(lab)
    raw_tables.delete_sources(lab.spark, root, DELETED)
    raw_tables.load_files(lab.files_dealt, root, "second", _now())
    return raw_tables.read_raw(lab.spark, root, "lab_results")


def _dimension_from_csv(lab: Lab) -> DataFrame:
    folder = shared_folder(lab.spark, "csv")
    lab.meta.write.csv(folder, header=True)
    return read_reference_dimension(lab.spark, folder)


def _older_documents(lab: Lab) -> DataFrame:
    """Documents written before two columns were added."""
    root = shared_folder(lab.spark, "older")
    older = lab.docs.drop("document_summary", "baseline_candidates")
    older.write.parquet(f"{raw_tables.table_path(root, 'documents')}/{raw_tables.BATCH}=old")
    return raw_tables.read_raw(lab.spark, root, "documents")


def _exported(lab: Lab) -> DataFrame:
    folder = shared_folder(lab.spark, "exports")
    exports.export_documents(_new_good(lab), folder)
    rows = lab.spark.read.json(f"{folder}/documents")
    return rows.select("year", "json_name", "narrative_name", "source_file")


def _new_good(lab: Lab) -> DataFrame:
    good = extraction.good_files(lab.checked_files)
    return extraction.new_documents(good, _no_documents(lab))


def _no_documents(lab: Lab) -> DataFrame:
    return raw_tables.empty(lab.spark, schemas.DOCUMENTS)


def _quarantine(lab: Lab) -> DataFrame:
    return extraction.rejected_files(lab.checked_files).select(
        "path", F.array_join("errors", ", ").alias("reason")
    )


def _ingest_idempotent(lab: Lab) -> DataFrame:
    """What is new when the sources of even events and the shared one are loaded already."""
    good = extraction.good_files(lab.checked_files)
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    shared = F.col("source_file") == "shared.pdf"
    loaded = extraction.new_documents(good, _no_documents(lab)).where((number % 2 == 0) | shared)
    fresh = extraction.new_documents(good, loaded)
    return fresh.select("source_file", number.alias("event_id"))


def _incremental_ingest(lab: Lab) -> DataFrame:
    """The event table read as a file stream, its documents loaded batch by batch."""
    root = shared_folder(lab.spark, "registry")
    stream = (
        lab.spark.readStream.schema(lab.table("events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(lab.sf_dir)
    )
    files = lab.spark.sql(extraction_files.FILES, events=stream)
    start_load(files, root, f"{root}/checkpoint", _now()).awaitTermination()
    return raw_tables.read_raw(lab.spark, root, "lab_results").drop(raw_tables.BATCH)


def _delete_source(lab: Lab) -> DataFrame:
    return raw_tables.without_sources(lab.raw, ["doc_7", "doc_8"])


def _export_names(lab: Lab) -> DataFrame:
    return exports.export_rows(_new_good(lab)).select(
        "year", "json_name", "narrative_name", "source_file"
    )


_QUERIES: dict[str, Callable[[Lab], DataFrame]] = {
    "stage_measurements": lambda lab: lab.staged,
    "censored_parse": _censored_parse,
    "dedup_latest_extraction": lambda lab: newest_extraction(lab.raw).select(
        "id", "report_date", "provider", "biomarker_name"
    ),
    "measurement_facts": lambda lab: lab.facts,
    "facts_at_scale": lambda lab: lab.facts_large,
    "reference_range_flag": lambda lab: _count_by(lab.facts, "is_within_ref_range"),
    "optimal_range_flag": lambda lab: _count_by(
        lab.facts, "biomarker_key", "is_within_optimal_range"
    ),
    "to_conventional_units": _conventional,
    "document_dimension": lambda lab: lab.documents,
    "document_dimension_at_scale": lambda lab: document_dimension(
        lab.view(views.DOCUMENTS_LARGE), lab.staged_large
    ),
    "current_snapshot": lambda lab: reports.current_snapshot(lab.facts),
    "current_snapshot_at_scale": _snapshot_at_scale,
    "current_snapshot_per_subject": _snapshot_per_subject,
    "timeline": lambda lab: reports.timeline(lab.documents),
    "report_index": lambda lab: reports.report_index(lab.documents, lab.facts),
    "latest_per_key": lambda lab: questions.latest_per_key(lab.facts),
    "key_trend": lambda lab: questions.key_trend(lab.facts, "view"),
    "newest_out_of_range": lambda lab: questions.newest_out_of_range(lab.facts),
    "outside_optimal": lambda lab: questions.outside_optimal(lab.facts),
    "report_inventory": lambda lab: questions.report_inventory(lab.documents),
    "category_summary": lambda lab: questions.category_summary(lab.facts),
    "count_per_source": lambda lab: questions.count_per_source(lab.raw),
    "facts_on_date": _facts_on_date,
    "recent_facts": lambda lab: questions.recent_facts(lab.facts),
    "document_context": lambda lab: questions.document_context(lab.documents),
    "load_status": lambda lab: questions.load_status(lab.raw, lab.docs),
    "compare_environments": lambda lab: compare_facts(lab.facts, lab.env_facts),
    "compare_filtered": lambda lab: compare_facts(lab.facts, lab.env_facts, source_file=SOURCE),
    "compare_at_scale": _compare_at_scale,
    "compare_summary": lambda lab: compare_summary(lab.facts, lab.env_facts),
    "reference_range_snapshot": lambda lab: history.range_snapshot(lab.staged),
    "reference_range_history": lambda lab: history.rebuild_range_history(lab.staged),
    "scd2_merge": _scd2,
    "dq_unique": _dq_unique,
    "dq_unique_failing": lambda lab: quality.check_unique(
        lab.table("lineitem"), ["l_orderkey"], "lineitem"
    ),
    "dq_not_null": _dq_not_null,
    "dq_relationships": _dq_relationships,
    "dq_relationships_at_scale": _relationships_at_scale,
    "dq_declared_checks": _declared_checks,
    "dq_constraints": lambda lab: quality.constraint_checks(lab.raw, lab.docs),
    "dq_unit_mismatch": _unit_mismatch,
    "redact_text": _redact_text,
    "redact_many": _redact_many,
    "redact_restore": lambda lab: redaction.restore(_redacted(lab), "text").select(
        "doc_id", "text"
    ),
    "fenced_block": lambda lab: lab.view(views.RESPONSES).select(
        "doc_id", first_fenced_block(F.col("response")).alias("block")
    ),
    "responses_to_documents": _responses_to_documents,
    "candidates_exploded": lambda lab: redaction.explode_candidates(lab.docs),
    "findings_feed": lambda lab: reports.findings(lab.facts),
    "conditions_by_priority": _conditions,
    "snapshot_lines": lambda lab: report_lines.snapshot_lines(lab.facts, _generated()),
    "timeline_lines": lambda lab: report_lines.timeline_lines(lab.documents, _generated()),
    "index_lines": lambda lab: report_lines.index_lines(
        lab.documents, lab.facts, _generated()
    ),
    "history_lines": lambda lab: report_lines.history_lines(
        lab.documents, _generated(), **lab.profile
    ),
    "findings_lines": lambda lab: report_lines.findings_lines(lab.facts, lab.documents),
    "report_lines": lambda lab: report_lines.in_order(_profile_lines(lab)),
    "reports_written": _reports_written,
    "workflow_facts": _workflow_facts,
    "facts_in_sql": _facts_in_sql,
    "workflow_run": _workflow_run,
    "refreshed_facts": lambda lab: _refreshed_mart(lab, workflow.FACTS),
    "refreshed_documents": lambda lab: _refreshed_mart(lab, workflow.DOCUMENTS),
    "refreshed_history": lambda lab: workflow.read_range_history(lab.spark, _refreshed(lab)),
    "environments_compared": _environments_compared,
    "environments_in_sql": _environments_in_sql,
    "compare_by_digest": lambda lab: digests.compare_by_digest(lab.facts, lab.env_facts),
    "exported_files": _exported_files,
    "report_files": _report_files,
    "stateful_ingest": _stateful_ingest,
    "deleted_source_rewritten": _deleted_source,
    "purged_files": _purged_files,
    "reloaded_source": _reloaded_source,
    "dimension_from_csv": _dimension_from_csv,
    "older_documents": _older_documents,
    "exported_documents": _exported,
    "flatten_documents": lambda lab: extraction.document_rows(_new_good(lab)),
    "flatten_measurements": lambda lab: extraction.measurement_rows(_new_good(lab)),
    "ingest_quarantine": _quarantine,
    "ingest_statistics": lambda lab: extraction.load_statistics(
        lab.checked_files, _new_good(lab)
    ),
    "ingest_idempotent": _ingest_idempotent,
    "incremental_ingest": _incremental_ingest,
    "delete_source": _delete_source,
    "export_names": _export_names,
}


def registered() -> dict[str, Query]:
    def over_tables(query: Callable[[Lab], DataFrame]) -> Query:
        return lambda spark, sf_dir: query(Lab(spark, sf_dir))

    return {name: over_tables(query) for name, query in _QUERIES.items()}
