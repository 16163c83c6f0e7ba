import pytest
from pyspark.sql import functions as F

from assaylake.plans import questions, report_lines, reports


@pytest.fixture
def day():
    return F.lit("2025-07-01").cast("date")


def text(lines):
    return [r.line for r in report_lines.in_order(lines).collect()]


READING = {
    "biomarker_key": "Vitamin D", "unit_si": "nmol/L", "unit_original": "nmol/L",
    "provider": "Quest", "category": "vitamins", "is_within_ref_range": True,
    "is_within_optimal_range": True, "is_below_detection_limit": False, "source_file": "a.pdf",
}


def reading(day, value, **more):
    return {**READING, "report_date": day, "value_si": value, "value_original": value, **more}


def test_snapshot_report(fact_rows, day):
    facts = fact_rows(
        reading("2025-01-01", 50.0),
        reading("2025-06-01", 80.0),
        reading("2024-01-01", 500.0),
        reading("2025-06-01", None, biomarker_key="IL-6", category=None, unit_si=None,
                unit_original=None, is_within_ref_range=None, is_within_optimal_range=None),
        reading("2025-06-01", 2.675, biomarker_key="ApoB", category="lipid",
                is_within_optimal_range=False, is_within_ref_range=False),
    )
    rule = [report_lines.SNAPSHOT_HEAD, report_lines.SNAPSHOT_RULE]
    assert text(report_lines.snapshot_lines(facts, day)) == [
        "# Current Biomarker Snapshot", "*Generated: 2025-07-01*", "",
        "", "## Lipid", "", *rule,
        "| ApoB | 2.67 nmol/L | 2.675 nmol/L | 2025-06-01 | **OUT** |  |",
        "", "## Vitamins", "", *rule,
        "| Vitamin D | 80.00 nmol/L | 80.0 nmol/L | 2025-06-01 | Optimal | ^ |",
        "", "## Uncategorized", "", *rule,
        "| IL-6 | -  | - | 2025-06-01 | - |  |",
    ]


def test_snapshot_ties_and_subjects(fact_rows):
    facts = fact_rows(
        reading("2025-06-01", 1.0, lab_result_id="a"), reading("2025-06-01", 2.0, lab_result_id="b")
    )
    row = reports.current_snapshot(facts).first()
    assert (row.value_si, row.prev_value_si) == (2.0, 1.0)
    both = reports.current_snapshot(facts.withColumn("subject", F.col("lab_result_id")), ["subject"])
    assert [(r.subject, r.value_si, r.trend) for r in both.collect()] == [
        ("a", 1.0, ""), ("b", 2.0, ""),
    ]


DOCUMENTS = [
    {"source_file": "s1.pdf", "report_date": "2024-11-03", "provider": "Nordlab",
     "report_type": "urine", "biomarker_count": 4, "tags": "morning",
     "markdown_path": "docs/findings/2024/s1.md", "document_summary": "Two lines,\nof which one."},
    {"source_file": "s2.pdf", "report_date": "2025-02-14", "provider": "Sudlab",
     "report_type": "imaging", "biomarker_count": 9, "markdown_path": "docs/findings/2025/s2.md",
     "baseline_candidates": '["one", "two"]'},
    {"source_file": "s3.pdf", "report_type": "letter", "biomarker_count": 0, "tags": "",
     "baseline_candidates": "no list"},
]


def test_timeline(document_rows, day):
    assert text(report_lines.timeline_lines(document_rows(*DOCUMENTS), day)) == [
        "# Report Timeline", "*Generated: 2025-07-01*", "", "Total reports: 3", "",
        "- **2025-02-14** - imaging (Sudlab, 9 biomarkers)",
        "- **2024-11-03** - urine (Nordlab, 4 biomarkers) [morning]",
        "- **None** - letter (None, 0 biomarkers)",
    ]


def test_index(document_rows, fact_rows, day):
    facts = fact_rows(
        {"biomarker_key": "iron", "is_within_ref_range": False, "source_file": "s2.pdf"},
        {"biomarker_key": "zinc", "is_within_ref_range": False, "source_file": "s2.pdf"},
        {"biomarker_key": "salt", "is_within_ref_range": True, "source_file": "s1.pdf"},
        {"biomarker_key": "lead", "is_within_ref_range": None, "source_file": "s3.pdf"},
    )
    assert text(report_lines.index_lines(document_rows(*DOCUMENTS), facts, day)) == [
        "# Report Index", "*Generated: 2025-07-01*", "", "Total reports: 3", "",
        report_lines.INDEX_HEAD, report_lines.INDEX_RULE,
        "| 2025-02-14 | imaging | Sudlab | 9 | 2 |  | [s2](../findings/2025/s2.md) |",
        "| 2024-11-03 | urine | Nordlab | 4 | 0 | morning | [s1](../findings/2024/s1.md) |",
        "| None | letter | None | 0 | 0 |  |  |",
    ]


def test_equal_documents_merge_in_the_index(document_rows, fact_rows, day):
    twins = document_rows(DOCUMENTS[0], {**DOCUMENTS[0], "source_file": "twin.pdf"})
    facts = fact_rows(
        {"biomarker_key": "x", "is_within_ref_range": False, "source_file": "s1.pdf"},
        {"biomarker_key": "x", "is_within_ref_range": False, "source_file": "twin.pdf"},
    )
    assert [r.out_of_range_count for r in reports.report_index(twins, facts).collect()] == [2]
    assert "Total reports: 1" in text(report_lines.index_lines(twins, facts, day))


def test_history_without_profile(document_rows, day):
    lines = text(report_lines.history_lines(document_rows(), day))
    assert lines == [
        "# Medical History", "*Generated: 2025-07-01*", "", report_lines.NO_PROFILE,
    ]


def test_history(spark, document_rows, day):
    conditions = spark.createDataFrame(
        [
            (0, "Old", "resolved", None, None, None),
            (1, "Odd", None, " text ", "a.pdf", None),
            (2, "Vitamin D deficiency", "active", "Supplementing", "a.pdf", "2025-01-01"),
            (3, "Rare", "paused-now", "", "", "2025-02-01"),
            (4, "Second", "active", None, None, None),
        ],
        "position int, name string, status string, details string, source_report string, "
        "discovered_date string",
    ).withColumn("discovered_date", F.col("discovered_date").cast("date"))
    variants = spark.createDataFrame(
        [(0, "APOE", None, "lipids", "g.pdf", None)],
        "position int, finding string, implication string, relevance string, "
        "source_report string, discovered_date date",
    )
    patterns = spark.createDataFrame(
        [(0, "Low D", None)], "position int, finding string, last_confirmed date"
    )
    docs = document_rows(*DOCUMENTS[:2])
    assert text(report_lines.history_lines(docs, day, conditions, variants, patterns)) == [
        "# Medical History", "*Generated: 2025-07-01*",
        "", "## Conditions",
        "", "### Active", "",
        "- **Vitamin D deficiency**", "  - Source: a.pdf | Discovered: 2025-01-01",
        "  - Supplementing", "- **Second**",
        "", "### Resolved", "", "- **Old**",
        "", "### Unknown", "", "- **Odd**", "  - Source: a.pdf", "  - text",
        "", "### Paused-Now", "", "- **Rare**", "  - Discovered: 2025-02-01",
        "", "## Genetic Variants", "",
        "- **APOE**", "  - Implication: -", "  - Relevance: lipids", "  - Source: g.pdf",
        "", "## Chronic Patterns", "", "- Low D (last confirmed: unknown)",
        "", "## Report Sources", "",
        "- 2024-11-03: urine (Nordlab)", "- 2025-02-14: imaging (Sudlab)",
    ]


def test_findings(document_rows, fact_rows):
    facts = fact_rows(
        {"biomarker_key": "LDL", "value_raw": "180", "value_si": 4.65, "unit_si": "mmol/L",
         "report_date": "2025-06-01", "provider": "Quest", "is_within_ref_range": False},
        {"biomarker_key": "Glucose", "value_raw": "n/a", "unit_si": None,
         "report_date": "2025-06-01", "provider": "Quest", "is_within_ref_range": True},
        {"biomarker_key": "TSH", "value_raw": "2", "value_si": 2.0, "unit_si": "x",
         "report_date": "2025-07-01", "provider": "Quest"},
    )
    results = [
        "Recent biomarker results:",
        "  2025-07-01 | TSH: 2.00 x (Quest) - unknown",
        "  2025-06-01 | Glucose: n/a  (Quest) - in range",
        "  2025-06-01 | LDL: 4.65 mmol/L (Quest) - OUT OF RANGE",
    ]
    context = [
        "", "Document summaries and baseline candidates:",
        "", "--- 2025-02-14 | imaging (Sudlab) ---",
        "Baseline candidates:", "  - one", "  - two",
        "", "--- 2024-11-03 | urine (Nordlab) ---", "Two lines,\nof which one.",
        "", "--- None | letter (None) ---",
    ]
    docs = document_rows(*DOCUMENTS)
    assert text(report_lines.findings_lines(facts, docs)) == results + context
    assert text(report_lines.findings_lines(facts, document_rows())) == results
    assert text(report_lines.findings_lines(fact_rows(), docs)) == context
    assert text(report_lines.findings_lines(fact_rows(), document_rows())) == [
        "No findings data found."
    ]


def test_written_reports_keep_their_order(spark, tmp_path):
    n = F.col("id")
    lines = spark.range(0, 5000).select(
        F.when(n % 2 == 0, "a").otherwise("b").alias("report"), F.lit(0).alias("block"),
        (-n).alias("rank"), F.lit("").alias("label"), F.lit("").alias("item"),
        F.lit(0).cast("long").alias("position"), F.lit(0).alias("line_no"),
        n.cast("string").alias("line"),
    )
    report_lines.write_reports(lines, str(tmp_path / "out"))
    for report, first in (("a", 4998), ("b", 4999)):
        parts = sorted((tmp_path / f"out/report={report}").glob("part-*"))
        got = [int(x) for p in parts for x in p.read_text().split()]
        assert got == list(range(first, -1, -2))


def test_questions(fact_rows):
    facts = fact_rows(
        reading("2025-06-01", 1.0, provider="A", is_within_ref_range=False),
        reading("2025-06-01", 2.0, provider="B"),
        reading("2025-01-01", 3.0, is_within_optimal_range=False),
        reading("2025-03-01", 4.0, biomarker_key="TSH", category=None,
                is_within_optimal_range=None),
    )
    latest = [(r.biomarker_key, r.value_si) for r in questions.latest_per_key(facts).collect()]
    assert sorted(latest) == [("TSH", 4.0), ("Vitamin D", 1.0), ("Vitamin D", 2.0)]
    assert [r.value_si for r in questions.newest_out_of_range(
        facts.withColumn("reference_range_low_si", F.lit(0.0))
        .withColumn("reference_range_high_si", F.lit(0.0))
    ).collect()] == [1.0]
    trend = questions.key_trend(facts, "Vitamin D").collect()
    assert trend[0].value_si == 3.0 and len(trend) == 3
    summary = {r.category: (r.unique_biomarkers, r.report_count)
               for r in questions.category_summary(facts).collect()}
    assert summary == {"vitamins": (1, 2), None: (1, 1)}


def test_status_of_empty_tables(spark, raw_rows, document_rows):
    row = questions.load_status(raw_rows({}).where("false"), document_rows()).first()
    assert (row.reports, row.first_report, row.unique_biomarkers, row.measurements) == (0, None, 0, 0)
