"""Reports as text lines (RP6), one row per line.

A report has no single running number, as that would number all lines in one task. Lines carry
the sort key ``(block, rank, label, item, position, line_no)`` instead; a range-partitioned sort
on it puts the report in order across many tasks.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake import fixed_values as fixed
from assaylake.functions.display import number_text, tag_suffix, two_places
from assaylake.functions.labels import category_heading, title_case
from assaylake.functions.text import strip_space
from assaylake.plans import reports
from assaylake.sources.named_files import write_named

ORDER = ("block", "rank", "label", "item", "position", "line_no")
_LAST = 9_000_000_000_000_000_000

# Titles and table heads of the reports.
SNAPSHOT_TITLE = "# Current Biomarker Snapshot"
SNAPSHOT_HEAD = "| Biomarker | Value (SI) | Original | Date | Status | Trend |"
SNAPSHOT_RULE = "|-----------|-----------|----------|------|--------|-------|"
TIMELINE_TITLE = "# Report Timeline"
HISTORY_TITLE = "# Medical History"
INDEX_TITLE = "# Report Index"
INDEX_HEAD = "| Date | Type | Provider | Biomarkers | Out of Range | Tags | Findings |"
INDEX_RULE = "|------|------|----------|------------|--------------|------|----------|"
TOTAL = "Total reports: "
NO_PROFILE = "There is no profile. Pass conditions, variants or patterns to fill this report."
FINDINGS_HEAD = "Recent biomarker results:"
CONTEXT_HEAD = "Document summaries and baseline candidates:"
CANDIDATES_HEAD = "Baseline candidates:"


def _newest_first(day: Column) -> Column:
    """Rank of a date for a descending sort, NULL last."""
    return F.coalesce(-F.unix_date(day).cast("long"), F.lit(_LAST))


def _oldest_first(day: Column) -> Column:
    return F.coalesce(F.unix_date(day).cast("long"), F.lit(_LAST))


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def _lines(
    df: DataFrame,
    report: str,
    block: int,
    lines: list[Column],
    rank: Column | int = 0,
    label: Column | str = "",
    item: Column | str = "",
    position: Column | int = 0,
) -> DataFrame:
    """Every row's lines, in order; a NULL line is left out."""
    keyed = df.select(
        F.lit(rank).cast("long").alias("rank"),
        F.coalesce(F.lit(label), F.lit("")).alias("label"),
        F.coalesce(F.lit(item).cast("string"), F.lit("")).alias("item"),
        F.lit(position).cast("long").alias("position"),
        F.posexplode(F.array(*lines)).alias("line_no", "line"),
    )
    return keyed.where(F.col("line").isNotNull()).select(
        F.lit(report).alias("report"), F.lit(block).alias("block"), *ORDER[1:], "line"
    )


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _dated_head(title: str, generated: Column) -> list[Column]:
    return [F.lit(title), _text("*Generated: ", _shown(generated), "*"), F.lit("")]


def _one_row(df: DataFrame) -> DataFrame:
    """One row with the number of rows of ``df``."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def _any_row(df: DataFrame) -> DataFrame:
    """One row if ``df`` has rows, else none."""
    return df.select(F.lit(1).alias("any")).limit(1)


def _single(df: DataFrame) -> DataFrame:
    """One constant row, for lines that always appear."""
    return df.sparkSession.range(0, 1, 1, 1)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def snapshot_lines(facts: DataFrame, generated: Column) -> DataFrame:
    name = "current_snapshot"
    rows = reports.snapshot_rows(facts)
    cell = F.when(F.col("value_original").isNull(), F.lit("-")).otherwise(
        strip_space(
            _text(number_text(F.col("value_original")), " ", F.coalesce("unit_original", F.lit("")))
        )
    )
    value = F.coalesce(two_places(F.col("value_si")), F.lit("-"))
    line = _text(
        "| ", F.col("biomarker_key"), " | ", value, " ", F.coalesce("unit_si", F.lit("")),
        " | ", cell, " | ", _shown(F.col("report_date")), " | ", F.col("status"),
        " | ", F.col("trend"), " |",
    )
    uncategorized = F.col("category").isNull().cast("long")
    heading = [
        F.lit(""), _text("## ", category_heading(F.col("category"))), F.lit(""),
        F.lit(SNAPSHOT_HEAD), F.lit(SNAPSHOT_RULE),
    ]
    categories = rows.select("category").distinct()
    category = F.col("category")
    return _union(
        [
            _lines(_single(facts), name, 0, _dated_head(SNAPSHOT_TITLE, generated)),
            _lines(categories, name, 1, heading, uncategorized, category, position=F.lit(-1)),
            _lines(rows, name, 1, [line], uncategorized, category, F.col("biomarker_key")),
        ]
    )


def timeline_lines(documents: DataFrame, generated: Column) -> DataFrame:
    name = "timeline"
    head = [*_dated_head(TIMELINE_TITLE, generated), _text(TOTAL, _shown(F.col("total"))), F.lit("")]
    line = _text(
        "- **", _shown(F.col("report_date")), "** - ", F.col("report_type"), " (",
        _shown(F.col("provider")), ", ", F.col("biomarker_count").cast("string"),
        " biomarkers)", F.coalesce(tag_suffix(F.col("tags")), F.lit("")),
    )
    rank = _newest_first(F.col("report_date"))
    return _union(
        [
            _lines(_one_row(documents), name, 0, head),
            _lines(documents, name, 1, [line], rank, item=F.col("source_file")),
        ]
    )


def index_lines(documents: DataFrame, facts: DataFrame, generated: Column) -> DataFrame:
    name = "report_index"
    rows = reports.index_rows(documents, facts)
    head = [
        *_dated_head(INDEX_TITLE, generated), _text(TOTAL, _shown(F.col("total"))), F.lit(""),
        F.lit(INDEX_HEAD), F.lit(INDEX_RULE),
    ]
    line = _text(
        "| ", _shown(F.col("report_date")), " | ", F.col("report_type"), " | ",
        _shown(F.col("provider")), " | ", F.col("biomarker_count").cast("string"), " | ",
        F.col("out_of_range_count").cast("string"), " | ", F.coalesce("tags", F.lit("")), " | ",
        F.col("link"), " |",
    )
    # The total counts merged lines, which need no facts.
    return _union(
        [
            _lines(_one_row(documents.select(*reports.INDEXED).distinct()), name, 0, head),
            _lines(rows, name, 1, [line], _newest_first(F.col("report_date")), item=line),
        ]
    )


def history_lines(
    documents: DataFrame,
    generated: Column,
    conditions: DataFrame | None = None,
    variants: DataFrame | None = None,
    patterns: DataFrame | None = None,
) -> DataFrame:
    """Conditions by priority, variants, patterns and report sources; ``None`` for all three
    profile tables means that no profile exists."""
    name = "medical_history"
    blank = F.lit("")
    head = [F.lit(HISTORY_TITLE), _text("*Generated: ", _shown(generated), "*")]
    parts = [_lines(_single(documents), name, 0, head)]
    if conditions is None and variants is None and patterns is None:
        hint = [blank, F.lit(NO_PROFILE)]
        parts.append(_lines(_single(documents), name, 1, hint))
    if conditions is not None:
        ranked = reports.conditions_by_priority(conditions)
        states = ranked.groupBy("status", "rank").agg(F.count(F.lit(1)).alias("n"))
        detail = F.when(F.col("details") != "", strip_space(F.col("details")))
        entry = [
            _text("- **", F.col("name"), "**"),
            _text("  - ", F.col("origin")),
            _text("  - ", detail),
        ]
        title = [blank, F.lit("## Conditions")]
        state = [blank, _text("### ", title_case(F.col("status"))), blank]
        parts += [
            _lines(_any_row(conditions), name, 2, title),
            _lines(states, name, 3, state, F.col("rank"), position=F.lit(-1)),
            _lines(ranked, name, 3, entry, F.col("rank"), position=F.col("position")),
        ]
    if variants is not None:
        origin = reports.source_and_date(F.col("source_report"), F.col("discovered_date"))
        entry = [
            _text("- **", F.col("finding"), "**"),
            _text("  - Implication: ", F.coalesce("implication", F.lit("-"))),
            _text("  - Relevance: ", F.coalesce("relevance", F.lit("-"))),
            _text("  - ", origin),
        ]
        parts += [
            _lines(_any_row(variants), name, 4, [blank, F.lit("## Genetic Variants"), blank]),
            _lines(variants, name, 5, entry, position=F.col("position")),
        ]
    if patterns is not None:
        confirmed = F.coalesce(F.col("last_confirmed").cast("string"), F.lit("unknown"))
        entry = [_text("- ", F.col("finding"), " (last confirmed: ", confirmed, ")")]
        parts += [
            _lines(_any_row(patterns), name, 6, [blank, F.lit("## Chronic Patterns"), blank]),
            _lines(patterns, name, 7, entry, position=F.col("position")),
        ]
    source = _text(
        "- ", _shown(F.col("report_date")), ": ", F.col("report_type"), " (",
        _shown(F.col("provider")), ")",
    )
    parts += [
        _lines(_any_row(documents), name, 8, [blank, F.lit("## Report Sources"), blank]),
        _lines(
            documents, name, 9, [source], _oldest_first(F.col("report_date")),
            item=F.col("source_file"),
        ),
    ]
    return _union(parts)


def findings_lines(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """The findings feed: results, then summaries and candidates; a sentinel if both are empty."""
    name = "findings"
    value = F.coalesce(two_places(F.col("value_si")), F.col("value_raw"), F.lit("None"))
    result = _text(
        "  ", _shown(F.col("report_date")), " | ", F.col("biomarker_key"), ": ", value, " ",
        F.coalesce("unit_si", F.lit("")), " (", _shown(F.col("provider")), ") - ",
        F.col("range_label"),
    )
    rows = reports.finding_rows(facts)
    told = reports.documents_with_context(documents)
    rank = _newest_first(F.col("report_date"))
    opening = [
        F.lit(""),
        _text(
            "--- ", _shown(F.col("report_date")), " | ", F.col("report_type"), " (",
            _shown(F.col("provider")), ") ---",
        ),
        F.when(F.col("document_summary") != "", F.col("document_summary")),
        F.when(F.size("candidates") > 0, F.lit(CANDIDATES_HEAD)),
    ]
    listed = told.withColumn("candidates", F.from_json("baseline_candidates", "array<string>"))
    each = listed.select(
        "source_file", "report_date", F.posexplode("candidates").alias("n", "candidate")
    )
    candidate = _text("  - ", _shown(F.col("candidate")))
    empty = _one_row(_any_row(facts).unionByName(_any_row(told))).where("total = 0")
    return _union(
        [
            _lines(_any_row(facts), name, 0, [F.lit(FINDINGS_HEAD)]),
            _lines(
                rows, name, 1, [result], rank, F.col("biomarker_key"), F.col("lab_result_id")
            ),
            _lines(_any_row(told), name, 2, [F.lit(""), F.lit(CONTEXT_HEAD)]),
            _lines(listed, name, 3, opening, rank, item=F.col("source_file")),
            _lines(
                each, name, 3, [candidate], rank, item=F.col("source_file"),
                position=F.col("n") + 1,
            ),
            _lines(empty, name, 4, [F.lit(fixed.FINDINGS_EMPTY)]),
        ]
    )


def profile_lines(
    facts: DataFrame, documents: DataFrame, generated: Column, **profile: DataFrame | None
) -> DataFrame:
    """The four profile reports. Facts and documents are read several times; pass written
    tables rather than the plans that compute them."""
    return _union(
        [
            snapshot_lines(facts, generated),
            timeline_lines(documents, generated),
            history_lines(documents, generated, **profile),
            index_lines(documents, facts, generated),
        ]
    )


def in_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy("report", *ORDER)


def write_reports(lines: DataFrame, path: str) -> None:
    """One directory of text files per report; its files, by name, hold the lines in order.

    Lines are range-partitioned on the sort key, so a long report spreads over many tasks.
    """
    ordered = lines.repartitionByRange("report", *ORDER).sortWithinPartitions("report", *ORDER)
    ordered.select("report", "line").write.mode("overwrite").partitionBy("report").text(path)


def write_report_files(lines: DataFrame, path: str) -> None:
    """One Markdown file per report, named after it. A report's lines pass through one task in order and
    one after the other; ``write_reports`` spreads a report over many."""
    name = F.concat("report", F.lit(".md")).alias("name")
    content = F.concat("line", F.lit("\n")).alias("content")
    write_named(lines.select(name, content, *ORDER), path, *ORDER)
