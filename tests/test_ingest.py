import pytest
import json
from datetime import date, datetime

from builders import extraction, measurement
from pyspark.sql import functions as F

from assaylake.operators.redaction import redact
from assaylake.sources import exports, raw_tables
from assaylake.sources.extraction import (
    check_extractions,
    check_responses,
    document_rows,
    measurement_rows,
    parse_extractions,
    read_extraction_files,
    read_text_reports,
)
from assaylake.sources.reference_dim import read_reference_dimension


def checked(spark, *contents):
    """Errors and document of each content, in order."""
    texts = [c if isinstance(c, str) else json.dumps(c) for c in contents]
    files = spark.createDataFrame(
        [(f"{n:03d}", t) for n, t in enumerate(texts)], "path string, content string"
    )
    return check_extractions(files).orderBy("path").collect()


GOOD = extraction("a.pdf", [measurement("Glucose", "5")])


def without(document, *names):
    return {k: v for k, v in document.items() if k not in names}


def with_row(**fields):
    return {**GOOD, "biomarkers": [{**measurement("Glucose", "5"), **fields}]}


def with_meta(**fields):
    return {**GOOD, "metadata": {"report_type": "other", **fields}}


REJECTED = [
    (json.dumps(GOOD)[:-5], ["not a JSON document"]),
    ("", ["not a JSON document"]),
    (json.dumps(GOOD) + " more", ["not a JSON document"]),
    (json.dumps(GOOD) + "]", ["not a JSON document"]),
    (json.dumps(GOOD) + "," + json.dumps(GOOD), ["not a JSON document"]),
    ("5", ["biomarkers", "document_summary", "source_file", "metadata.report_type"]),
    ([GOOD], ["biomarkers", "document_summary", "source_file", "metadata.report_type"]),
    (without(GOOD, "source_file"), ["source_file"]),
    ({**GOOD, "source_file": None}, ["source_file"]),
    ({**GOOD, "source_file": 7}, ["source_file"]),
    (without(GOOD, "document_summary"), ["document_summary"]),
    (without(GOOD, "metadata"), ["metadata.report_type"]),
    ({**GOOD, "metadata": "none"}, ["metadata.report_type"]),
    (without(GOOD, "biomarkers"), ["biomarkers"]),
    ({**GOOD, "biomarkers": None}, ["biomarkers"]),
    ({**GOOD, "biomarkers": {}}, ["biomarkers"]),
    ({**GOOD, "extraction_method": None}, ["extraction_method"]),
    ({**GOOD, "extracted_at": None}, ["extracted_at"]),
    ({**GOOD, "extracted_at": "yesterday"}, ["extracted_at"]),
    ({**GOOD, "extracted_at": "2025-02-30T00:00:00"}, ["extracted_at"]),
    (with_row(value=5.4), ["biomarkers.value"]),
    (with_row(value=True), ["biomarkers.value"]),
    (with_row(unit=1), ["biomarkers.unit"]),
    (with_row(notes=["x"]), ["biomarkers.notes"]),
    (with_row(provider=None), ["biomarkers.provider"]),
    (with_row(biomarker_name=3), ["biomarkers.biomarker_name"]),
    (with_row(report_date="2025-13-01"), ["biomarkers.report_date"]),
    (with_row(report_date="01.02.2025"), ["biomarkers.report_date"]),
    (with_row(report_date="2025-01-01T10:00:00"), ["biomarkers.report_date"]),
    (with_row(report_date=None), ["biomarkers.report_date"]),
    ({**GOOD, "biomarkers": [without(measurement("G", "5"), "value")]}, ["biomarkers.value"]),
    (
        {**GOOD, "biomarkers": [measurement("G", "5"), None]},
        ["biomarkers.provider", "biomarkers.biomarker_name", "biomarkers.report_date",
         "biomarkers.value"],
    ),
    (with_meta(tags=None), ["metadata.tags"]),
    (with_meta(tags=["a", 5]), ["metadata.tags"]),
    (with_meta(tags=["a", None]), ["metadata.tags"]),
    (with_meta(tags="a"), ["metadata.tags"]),
    (with_meta(baseline_candidates={}), ["metadata.baseline_candidates"]),
    (with_meta(provider=5), ["metadata.provider"]),
    (with_meta(report_date="2025-02-30"), ["metadata.report_date"]),
    (with_meta(report_type=None), ["metadata.report_type"]),
]


def test_rejected_whole(spark):
    rows = checked(spark, *[document for document, _ in REJECTED])
    for row, (document, errors) in zip(rows, REJECTED, strict=True):
        assert sorted(row.errors) == sorted(errors), document


def test_odd_documents_are_taken_apart_once(spark):
    """However many fields are looked at, the document itself is read for its texts and for its types."""
    files = spark.range(1).select(F.lit("a").alias("path"), F.col("id").cast("string").alias("content"))
    plan = check_extractions(files)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("try_variant_get(_doc") <= 2


def test_odd_rows_and_metadata_of_another_shape(spark):
    rows = ["biomarkers.provider", "biomarkers.biomarker_name", "biomarkers.report_date", "biomarkers.value"]
    cases = [
        ({**GOOD, "biomarkers": [measurement("Glucose", "5"), 5]}, rows),
        ({**GOOD, "biomarkers": [None]}, rows),
        ({**GOOD, "biomarkers": None}, ["biomarkers"]),
        ({**GOOD, "metadata": [{"report_type": "other"}]}, ["metadata.report_type"]),
        (with_meta(tags={"a": "b"}, report_date=5), ["metadata.tags", "metadata.report_date"]),
        (with_row(unit=None, notes=7, loinc_code={}), ["biomarkers.notes", "biomarkers.loinc_code"]),
    ]
    for row, (document, errors) in zip(checked(spark, *[d for d, _ in cases]), cases, strict=True):
        assert sorted(row.errors) == sorted(errors), document


ACCEPTED = [
    {**GOOD, "biomarkers": []},
    {**GOOD, "comment": {"unknown": [1, "field"]}},
    with_row(extra=5),
    with_row(value=None, unit=None, notes=None),
    with_row(report_date="2025-01-01T00:00:00"),
    with_meta(tags=[], provider=None, report_date=None),
    with_meta(report_date="2025-01-01", provider="P", baseline_candidates=["a"]),
    without(GOOD, "extracted_at", "extraction_method"),
    {**GOOD, "extracted_at": "2025-01-01"},
    {**GOOD, "extracted_at": "2025-01-01 10:00:00.123456"},
    {**GOOD, "extracted_at": "2025-01-01T10:00:00Z"},
    "\n  " + json.dumps(GOOD, indent=2) + "\n",
]


def test_accepted(spark):
    for row, document in zip(checked(spark, *ACCEPTED), ACCEPTED, strict=True):
        assert row.errors == [], document


def test_defaults_and_fallbacks(spark):
    plain = without(with_row(value=None, unit=None), "extracted_at", "extraction_method")
    files = spark.createDataFrame([("a", json.dumps(plain))], "path string, content string")
    now = F.lit("2025-05-05 05:05:05").cast("timestamp_ntz")
    good, rejected = parse_extractions(files, now)
    assert rejected.count() == 0
    document = document_rows(good).first()
    assert document.extraction_method == "api"
    assert document.extracted_at == datetime(2025, 5, 5, 5, 5, 5)
    assert (document.report_date, document.provider) == (date(2025, 11, 15), "Quest")
    assert document.tags == "lipid,metabolic"
    assert document.baseline_candidates is None
    assert document.markdown_path == "docs/findings/2025/2025-11-15_blood_panel_Quest.md"
    row = measurement_rows(good).first()
    assert (row.value_raw, row.unit_raw, row.notes) == ("", "", None)


def test_metadata_goes_first(spark):
    meta = with_meta(report_date="2024-02-02", provider="Head", baseline_candidates=["é", "b"])
    files = spark.createDataFrame([("a", json.dumps(meta))], "path string, content string")
    row = document_rows(parse_extractions(files)[0]).first()
    assert (row.report_date, row.provider) == (date(2024, 2, 2), "Head")
    assert json.loads(row.baseline_candidates) == ["é", "b"]


def test_offset_moves_to_the_session_zone(spark):
    document = {**GOOD, "extracted_at": "2025-01-01T10:00:00+02:00"}
    assert checked(spark, document)[0].extracted_at == datetime(2025, 1, 1, 8, 0)


def counts(spark, root):
    return tuple(
        raw_tables.read_raw(spark, root, t).count() for t in ("lab_results", "documents")
    )


def test_load_twice_is_load_once(spark, in_dir, tmp_path):
    root = str(tmp_path / "tables")
    files = read_extraction_files(spark, str(in_dir))
    first = raw_tables.load_files(files, root, "b1").first()
    assert first.asDict() == {
        "files_found": 3, "files_loaded": 3, "rows_inserted": 13, "files_rejected": 0,
    }
    assert counts(spark, root) == (13, 3)
    second = raw_tables.load_files(files, root, "b2").first()
    assert (second.files_loaded, second.rows_inserted) == (0, 0)
    assert counts(spark, root) == (13, 3)
    # The same batch name again neither replaces nor doubles anything.
    again = raw_tables.load_files(files, root, "b1").first()
    assert (again.files_loaded, again.rows_inserted) == (0, 0)
    assert counts(spark, root) == (13, 3)
    raw = raw_tables.read_raw(spark, root, "lab_results")
    vitamin = raw.where("biomarker_name_raw = 'Vitamin D (25-OH)' and provider = 'Quest'").first()
    assert (vitamin.value_raw, vitamin.unit_raw) == ("22", "ng/mL")
    assert raw.where("biomarker_name_raw = 'CRP (hs)'").first().value_raw == "<0.1"


def test_a_batch_name_used_twice_keeps_both_loads(spark, in_dir, tmp_path):
    root = str(tmp_path / "tables")
    raw_tables.load_files(read_extraction_files(spark, str(in_dir)), root, "today")
    for old in in_dir.glob("*.json"):
        old.unlink()
    later = extraction("later.pdf", [measurement("Iron", "9")])
    (in_dir / "later.json").write_text(json.dumps(later))
    raw_tables.load_files(read_extraction_files(spark, str(in_dir)), root, "today")
    assert counts(spark, root) == (14, 4)


@pytest.mark.parametrize("writes", range(1, 6))
def test_a_load_that_stops_between_two_writes(spark, in_dir, tmp_path, monkeypatch, writes):
    """Whatever it left, the next load, under any name, gives every row once."""
    root = str(tmp_path / "tables")
    files = read_extraction_files(spark, str(in_dir))
    append, done = raw_tables._append, []

    def stops(*args):
        if len(done) == writes - 1:
            raise RuntimeError("lost")
        done.append(append(*args))

    monkeypatch.setattr(raw_tables, "_append", stops)
    with pytest.raises(RuntimeError):
        raw_tables.load_files(files, root, "b1")
    assert counts(spark, root) == (0, 0)
    monkeypatch.setattr(raw_tables, "_append", append)
    raw_tables.load_files(files, root, "b1" if writes % 2 else "b2")
    assert counts(spark, root) == (13, 3)
    ids = raw_tables.read_raw(spark, root, "lab_results").select("id").distinct().count()
    assert ids == 13


def test_bad_files_do_not_stop_a_batch(spark, in_dir, tmp_path):
    root = str(tmp_path / "tables")
    (in_dir / "9.json").write_text("{")
    (in_dir / "note.txt").write_text("ignored")
    files = read_extraction_files(spark, str(in_dir))
    stats = raw_tables.load_files(files, root, "b1").first()
    assert (stats.files_found, stats.files_loaded, stats.files_rejected) == (4, 3, 1)
    rejected = raw_tables.read_raw(spark, root, "rejected").first()
    assert rejected.path.endswith("9.json") and rejected.errors == ["not a JSON document"]


def test_first_file_by_name_wins(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, value in (("b", "2"), ("a", "1"), ("c", "3")):
        document = extraction("same.pdf", [measurement("Glucose", value)])
        (folder / f"{n}.json").write_text(json.dumps(document))
    root = str(tmp_path / "tables")
    raw_tables.load_files(read_extraction_files(spark, str(folder)), root, "b1")
    rows = raw_tables.read_raw(spark, root, "lab_results").collect()
    assert [r.value_raw for r in rows] == ["1"]


def test_delete_and_reload(spark, in_dir, tmp_path):
    root = str(tmp_path / "tables")
    raw_tables.load_files(read_extraction_files(spark, str(in_dir)), root, "b1")
    assert raw_tables.delete_sources(spark, root, ["nowhere.pdf"]) == 0
    assert raw_tables.delete_sources(spark, root, ["quest.pdf"]) == 6
    assert counts(spark, root) == (7, 2)
    changed = extraction("quest.pdf", [measurement("Glucose", "o'9")])
    (in_dir / "1.json").write_text(json.dumps(changed))
    deleted, stats = raw_tables.reload_sources(
        spark, root, ["quest.pdf", "genes.pdf"], str(in_dir), "b2"
    )
    assert deleted == 2
    assert stats.first().rows_inserted == 3
    assert counts(spark, root) == (8, 3)
    # A batch left without rows is empty, not stale.
    assert raw_tables.delete_sources(spark, root, ["labcorp.pdf"]) == 5
    assert raw_tables.read_raw(spark, root, "lab_results").where("load_batch = 'b1'").count() == 0


def test_tables_not_written_yet_are_empty(spark, tmp_path):
    assert counts(spark, str(tmp_path / "none")) == (0, 0)


def test_older_files_without_late_columns(spark, in_dir, tmp_path):
    root = str(tmp_path / "tables")
    raw_tables.load_files(read_extraction_files(spark, str(in_dir)), root, "new")
    old = raw_tables.read_raw(spark, root, "documents").drop(
        "document_summary", "baseline_candidates", "load_batch"
    )
    old = old.withColumn("source_file", F.concat(F.lit("old-"), "source_file"))
    old.write.parquet(raw_tables.table_path(root, "documents") + "/load_batch=old")
    rows = raw_tables.read_raw(spark, root, "documents")
    assert rows.count() == 6
    assert rows.where("load_batch = 'old' and document_summary is null").count() == 3


def test_responses(spark):
    """Redacted text goes out, the fenced answer comes back and is restored."""
    note = spark.createDataFrame([("n.txt", "seen by Ilse Quarz")], "source_file string, t string")
    sent = redact(note, "t", ["Ilse Quarz"]).first()
    assert sent.t == "seen by [REDACTED_1]"
    body = {k: GOOD[k] for k in ("biomarkers", "metadata")} | {"document_summary": sent.t}
    rows = [
        ("n.txt", f"Here:\n```json\n{json.dumps(body)}\n```\nDone.", sent.redacted_strings),
        ("named.txt", json.dumps({**body, "source_file": "x"}), {}),
        ("prose.txt", "I could not read this.", None),
    ]
    responses = spark.createDataFrame(
        rows, "source_file string, response string, mapping map<string,string>"
    )
    found = {r.source_file: r for r in check_responses(responses, "manual").collect()}
    assert found["n.txt"].errors == []
    assert found["n.txt"].document_summary == "seen by Ilse Quarz"
    assert found["n.txt"].extraction_method == "manual"
    assert found["named.txt"].errors == ["source_file"]
    assert found["prose.txt"].errors == ["not a JSON document"]


def test_text_reports(spark, tmp_path):
    for name in ("a.md", "b.TXT", "c.pdf", "d.docx", "e"):
        (tmp_path / name).write_text(f"text of {name}\nsecond line")
    texts, unsupported = read_text_reports(spark, str(tmp_path))
    assert sorted(r.content for r in texts.collect()) == [
        "text of a.md\nsecond line", "text of b.TXT\nsecond line",
    ]
    assert sorted(r.path.rsplit("/", 1)[1] for r in unsupported.collect()) == ["c.pdf", "d.docx", "e"]


def test_export(spark, in_dir, tmp_path):
    good, _ = parse_extractions(read_extraction_files(spark, str(in_dir)))
    exports.export_documents(good, str(tmp_path / "out"))
    documents = spark.read.json(str(tmp_path / "out/documents"))
    assert sorted(r.json_name for r in documents.where("year = 2025").collect()) == [
        "2025-06-01_labcorp_083000.json", "2025-11-15_quest_083000.json",
    ]
    findings = spark.read.json(str(tmp_path / "out/findings")).where("year = 2026").first()
    assert findings.narrative_name == "2026-01-15_genetics_gene_lab.md"
    # What was exported can be loaded again.
    names = ("biomarkers", "document_summary", "metadata", "source_file", "extraction_method")
    again = documents.select(
        F.col("json_name").alias("path"), F.to_json(F.struct(*names)).alias("content")
    )
    assert [r.errors for r in check_extractions(again).collect()] == [[], [], []]


def test_reference_dimension(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text(
        "biomarker_key,loinc_code,conventional_unit,si_unit,conversion_factor,category,"
        "optimal_range_low_si,optimal_range_high_si\n"
        "Glucose (Fasting),1,mg/dL,mmol/L,0.0555,metabolic,3.9,5.0\nRatio,,,ratio,1.0,metabolic,,\n"
    )
    rows = read_reference_dimension(spark, str(path)).collect()
    assert rows[0].conversion_factor == 0.0555
    assert rows[1].loinc_code is None and rows[1].optimal_range_low_si is None
