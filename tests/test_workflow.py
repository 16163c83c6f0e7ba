import json
from datetime import date

import pytest
from builders import extraction, measurement
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from assaylake.operators.staging import stage_measurements
from assaylake.plans import workflow
from assaylake.plans.questions import newest_out_of_range
from assaylake.sources import raw_tables, versions
from assaylake.sources.extraction import read_extraction_files
from assaylake.streaming.incremental import file_stream, start_incremental_load, start_load


@pytest.fixture
def meta(meta_rows):
    return meta_rows(
        ("Glucose (Fasting)", "1558-6", "mg/dL", "mmol/L", 0.0555, "metabolic", 3.9, 5.0),
        ("Vitamin D (25-OH)", "1989-3", "ng/mL", "nmol/L", 2.496, "vitamin", 100.0, 150.0),
        ("CRP (hs)", "30522-7", "mg/L", "mg/L", 1.0, "inflammatory", 0.0, 1.0),
    )


def load(spark, in_dir, root, batch):
    return raw_tables.load_files(read_extraction_files(spark, str(in_dir)), root, batch)


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def check_adhoc_sql(spark, root):
    workflow.register_tables(spark, root)
    newest = spark.sql("""
        select biomarker_key from main.fct_biomarkers
        where report_date = (select max(report_date) from main.fct_biomarkers)
          and is_within_ref_range = false
    """)
    assert [r.biomarker_key for r in newest.collect()] == ["TNF-alpha"]
    per_source = spark.sql("select source_file, count(*) n from raw.lab_results group by 1")
    assert {r.source_file: r.n for r in per_source.collect()} == {
        "labcorp.pdf": 5, "quest.pdf": 6, "genes.pdf": 2,
    }
    assert spark.sql("select * from snapshots.snap_reference_ranges").count() > 0


def check_two_environments(spark, root):
    """Both can be asked at once, and registering one leaves the other as it is."""
    workflow.register_tables(spark, root, "trial")
    both = spark.sql("""
        select (select count(*) from raw.lab_results) as prod,
               (select count(*) from trial_raw.lab_results) as trial,
               (select count(*) from main.fct_biomarkers) as prod_facts,
               (select count(*) from trial_main.fct_biomarkers) as trial_facts
    """).first()
    assert tuple(both) == (13, 7, 13, 7)
    raw_tables.delete_sources(spark, raw_tables.environment_root(root, "trial"), ["labcorp.pdf"])
    workflow.register_tables(spark, root, "trial")
    assert spark.sql("select * from trial_raw.lab_results").count() == 6
    assert spark.sql("select * from raw.documents").count() == 3


def check_scalar_subquery(spark, root):
    """The newest date is found by a subquery, and few columns are read."""
    rows = newest_out_of_range(workflow.read_mart(spark, root, workflow.FACTS))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "value_si" in x)
    assert "IsNotNull(report_date)" in scan and "value_raw" not in scan


def test_load_transform_report_compare(spark, in_dir, tmp_path, meta):
    root = str(tmp_path / "lake")
    stats = workflow.run(spark, str(in_dir), root, "b1", meta, stamp("2026-02-01 00:00:00"))
    assert stats.first().rows_inserted == 13
    facts = workflow.read_mart(spark, root, workflow.FACTS)
    rows = {(str(r.report_date), r.biomarker_key): r for r in facts.collect()}
    assert len(rows) == 13
    glucose = rows["2025-11-15", "Glucose (Fasting)"]
    assert glucose.value_si == pytest.approx(5.2725, abs=1e-9)
    assert (glucose.is_within_ref_range, glucose.is_within_optimal_range) == (True, False)
    assert rows["2025-11-15", "CRP (hs)"].value_si == 0.05
    out = facts.where(~F.col("is_within_ref_range")).groupBy("report_date").count().collect()
    assert {str(r.report_date): r["count"] for r in out} == {
        "2025-06-01": 2, "2025-11-15": 2, "2026-01-15": 1,
    }

    report = tmp_path / "lake/reports/report=current_snapshot"
    lines = "".join(p.read_text() for p in sorted(report.glob("part-*"))).splitlines()
    crp = "| CRP (hs) | 0.05 mg/L | 0.05 mg/L | 2025-11-15 | BDL |  |"
    assert crp in lines
    assert "| Glucose (Fasting) | 5.27 mmol/L | 95.0 mg/dL | 2025-11-15 | Normal | v |" in lines

    check_adhoc_sql(spark, root)
    check_scalar_subquery(spark, root)

    # A second environment where one value changes and one report is missing.
    (in_dir / "2.json").unlink()
    changed = extraction("labcorp.pdf", [
        measurement("Glucose (Fasting)", "103", "LabCorp", "2025-06-01", unit="mg/dL")])
    (in_dir / "0.json").write_text(json.dumps(changed))
    env = raw_tables.environment_root(root, "trial")
    load(spark, in_dir, env, "b1")
    workflow.transform(spark, env, meta)
    check_two_environments(spark, root)
    diff = workflow.compare(spark, root, "trial").collect()
    status = {}
    for r in diff:
        status[r.status] = status.get(r.status, 0) + 1
    assert status == {"CHANGED": 1, "PROD ONLY": 6}
    assert len(workflow.compare(spark, root, "trial", "genes.pdf").collect()) == 2
    with pytest.raises(AnalysisException):
        workflow.compare(spark, root, "missing")


def test_ranges_gain_a_version_when_a_bound_changes(spark, in_dir, tmp_path, raw_rows):
    root = str(tmp_path / "lake")

    def update(low, day):
        staged = stage_measurements(
            raw_rows({"reference_range_low_raw": low, "report_date": day, "provider": "LabCorp"})
        )
        workflow.update_range_history(spark, root, staged, stamp(day))
        return sorted(
            (r.reference_range_low, str(r.valid_to)[:10])
            for r in workflow.read_range_history(spark, root).collect()
        )

    assert update("65", "2026-02-01") == [(65.0, "None")]
    assert update("65", "2026-02-02") == [(65.0, "None")]
    assert update("70", "2026-03-02") == [(65.0, "2026-03-02"), (70.0, "None")]
    assert update("75", "2026-04-02") == [
        (65.0, "2026-03-02"), (70.0, "2026-04-02"), (75.0, "None"),
    ]


@pytest.mark.parametrize("writes", range(1, 4))
def test_a_merge_that_stops_between_two_writes(spark, tmp_path, raw_rows, monkeypatch, writes):
    root = str(tmp_path / "lake")

    def update(low, day):
        staged = stage_measurements(
            raw_rows({"reference_range_low_raw": low, "report_date": day, "provider": "LabCorp"})
        )
        workflow.update_range_history(spark, root, staged, stamp(day))

    def ranges():
        rows = workflow.read_range_history(spark, root).collect()
        return sorted((r.reference_range_low, str(r.valid_to)[:10]) for r in rows)

    update("65", "2026-02-01")
    write, done = versions.save, []

    def stops(*args):
        if len(done) == writes - 1:
            raise RuntimeError("lost")
        done.append(write(*args))

    monkeypatch.setattr(versions, "save", stops)
    with pytest.raises(RuntimeError):
        update("70", "2026-03-02")
    monkeypatch.setattr(versions, "save", write)
    assert ranges() == [(65.0, "None")]
    update("70", "2026-03-03")
    assert ranges() == [(65.0, "2026-03-03"), (70.0, "None")]


def batches(query):
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"])


def test_stream_loads_only_what_is_new(spark, in_dir, tmp_path):
    root, checkpoint = str(tmp_path / "lake"), str(tmp_path / "checkpoint")

    def load():
        return batches(start_incremental_load(spark, str(in_dir), root, checkpoint))

    def rows():
        return raw_tables.read_raw(spark, root, "lab_results").count()

    assert (load(), rows()) == (1, 13)
    (in_dir / "3.json").write_text(json.dumps(extraction("new.pdf", [measurement("x", "1")])))
    (in_dir / "4.json").write_text(json.dumps(extraction("quest.pdf", [measurement("y", "1")])))
    (in_dir / "5.json").write_text("broken")
    assert (load(), rows()) == (1, 14)
    assert (load(), rows()) == (0, 14)
    assert raw_tables.read_raw(spark, root, "rejected").count() == 1


def test_stream_in_small_batches_and_replay(spark, in_dir, tmp_path):
    root = str(tmp_path / "lake")
    files = file_stream(spark, str(in_dir), files_per_trigger=1)
    assert batches(start_load(files, root, str(tmp_path / "first"))) == 3
    assert raw_tables.read_raw(spark, root, "documents").count() == 3
    # With its checkpoint lost the stream starts over, and finds every source loaded.
    (in_dir / "0.json").unlink()
    assert batches(start_load(files, root, str(tmp_path / "second"))) == 2
    assert raw_tables.read_raw(spark, root, "documents").count() == 3
    assert raw_tables.read_raw(spark, root, "lab_results").count() == 13
    days = raw_tables.read_raw(spark, root, "documents").select("report_date").collect()
    assert max(r.report_date for r in days) == date(2026, 1, 15)
