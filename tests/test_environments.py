"""Two environments from a table of a single row group."""

import threading

import pytest
from pyspark.sql import functions as F

from assaylake.plans import workflow
from assaylake.sources import raw_tables
from registry import queries


@pytest.fixture
def lab(spark, tmp_path):
    n = F.col("id")
    events = spark.range(0, 200, 1, 1).select(
        n.alias("event_id"),
        F.lit("2024-01-03 04:05:06").cast("timestamp_ntz").alias("ts"),
        (n % 5).alias("user_id"),
        F.lit("view").alias("event_type"),
        (n / 4).alias("value"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    return queries.Lab(spark, str(tmp_path))


def test_documents_are_dealt_evenly_and_both_are_built_side_by_side(spark, lab, monkeypatch):
    both, load, counts = threading.Barrier(2, timeout=60), raw_tables.load_files, []

    def load_files(files, *args):
        both.wait()
        at = files.groupBy(F.spark_partition_id()).count().collect()
        counts.append([r[1] for r in at])
        return load(files, *args)

    monkeypatch.setattr(queries, "DEALT_ROWS", 50)
    monkeypatch.setattr(raw_tables, "load_files", load_files)
    root = queries._two_environments(lab)
    assert all(len(each) == 5 and max(each) <= 80 for each in counts)
    for home, files in ((root, 200), (raw_tables.environment_root(root, "trial"), 190)):
        assert raw_tables.stored_rows(spark, home, "incoming").count() == files
        assert raw_tables.read_raw(spark, home, "documents").count() > 0


def test_a_build_that_fails_is_seen(lab, monkeypatch):
    def fails(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(workflow, "refresh", fails)
    with pytest.raises(RuntimeError, match="lost"):
        queries._two_environments(lab)


def test_rows_that_count_are_found_without_a_shuffle_by_load(spark, lab):
    root = queries._two_environments(lab)
    workflow.register_tables(spark, root)
    rows = spark.table("raw.lab_results")
    wanted = raw_tables.read_raw(spark, root, "lab_results")
    assert sorted(r.id for r in rows.collect()) == sorted(r.id for r in wanted.collect())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(coalesce(load_attempt" in line]
