import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assaylake.plans import report_lines
from assaylake.sources import exports
from assaylake.sources.extraction import check_extractions, parse_extractions, read_extraction_files
from assaylake.sources.named_files import write_named


def below(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_a_file_for_each_name(spark, tmp_path):
    rows = [("a.txt", "one\n", 1), ("d/e/b é.txt", "é", 1), ("a.txt", "three\n", 3), ("a.txt", None, 2), ("empty", None, 1)]
    df = spark.createDataFrame(rows, "name string, content string, n int").repartition(4)
    out = tmp_path / "out"
    write_named(df, str(out), "n")
    assert below(out) == {"a.txt": "one\nthree\n", "d/e/b é.txt": "é", "empty": ""}
    write_named(df.where("name = 'empty'"), f"file://{out}", "n", rows_per_name=1)
    assert below(out) == {"empty": ""}
    write_named(df.limit(0), str(out))
    assert below(out) == {}


@pytest.mark.parametrize("name", ["../up", "/root", "", None])
def test_a_failed_task_leaves_nothing(spark, tmp_path, name):
    out = tmp_path / "out"
    write_named(spark.createDataFrame([("kept", "k")], "name string, content string"), str(out))
    rows = [(f"f{i}", "x") for i in range(50)] + [(name, "x")]
    df = spark.createDataFrame(rows, "name string, content string").repartition(8)
    with pytest.raises(Exception, match="not a file's name"):
        write_named(df, str(out), rows_per_name=1)
    assert {n: t for n, t in below(out).items() if not n.startswith("_staging-")} == {"kept": "k"}
    write_named(spark.createDataFrame([("new", "n")], "name string, content string"), str(out))
    assert [p.name for p in out.iterdir()] == ["new"]


def test_columns_must_be_known(spark, tmp_path):
    from assaylake.sources.named_files import FORMAT, NamedFiles

    spark.dataSource.register(NamedFiles)
    df = spark.createDataFrame([("a", "b")], "name string, text string")
    with pytest.raises(Exception, match="need the columns"):
        df.write.format(FORMAT).mode("append").save(str(tmp_path / "x"))


def test_documents_and_narratives(spark, in_dir, tmp_path):
    good, _ = parse_extractions(read_extraction_files(spark, str(in_dir)))
    later = good.where("source_file = 'quest.pdf'").withColumns(
        {"source_file": F.lit("again.pdf"), "extracted_at": F.expr("extracted_at + interval 1 day")}
    )
    exports.export_files(good.unionByName(later), str(tmp_path / "out"))
    files = below(tmp_path / "out")
    assert sorted(files) == [
        "findings/2025/2025-06-01_blood_panel_labcorp.md", "findings/2025/2025-11-15_blood_panel_quest.md",
        "findings/2026/2026-01-15_genetics_gene_lab.md", "raw/2025-06-01_labcorp_083000.json",
        "raw/2025-11-15_quest_083000.json", "raw/2026-01-15_gene_lab_083000.json",
    ]
    assert files["findings/2026/2026-01-15_genetics_gene_lab.md"] == "# Report genes.pdf\nwith two lines"
    document = json.loads(files["raw/2025-11-15_quest_083000.json"])
    assert document["source_file"] == "again.pdf" and document["biomarkers"][5]["value"] == "<0.1"
    assert document["biomarkers"][5]["notes"] is None
    again = check_extractions(read_extraction_files(spark, str(tmp_path / "out/raw"))).collect()
    assert [r.errors for r in again] == [[], [], []]


def test_reports_are_one_file_each(spark, fact_rows, document_rows, tmp_path):
    facts = fact_rows({"biomarker_key": "A", "report_date": "2025-01-01", "value_si": 1.0, "source_file": "a"})
    documents = document_rows({"source_file": "a", "report_date": "2025-01-01", "biomarker_count": 1})
    lines = report_lines.profile_lines(facts, documents, F.lit("2025-02-01").cast("date"))
    report_lines.write_report_files(lines, str(tmp_path / "out"))
    want = {}
    for r in report_lines.in_order(lines).collect():
        want[f"{r.report}.md"] = want.get(f"{r.report}.md", "") + r.line + "\n"
    assert below(tmp_path / "out") == want and len(want) == 4
