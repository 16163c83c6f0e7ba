"""Runs that write only what loads and deletions touch, against full rebuilds."""

import json
from pathlib import Path

import pytest
from builders import extraction, measurement
from pyspark.sql import functions as F

from assaylake.operators import digests
from assaylake.operators.compare import compare_facts
from assaylake.plans import workflow
from assaylake.sources import raw_tables, versions
from assaylake.sources.extraction import read_extraction_files


@pytest.fixture
def meta(meta_rows):
    return meta_rows(
        ("Glucose (Fasting)", "1558-6", "mg/dL", "mmol/L", 0.0555, "metabolic", 3.9, 5.0),
        ("CRP (hs)", "30522-7", "mg/L", "mg/L", 1.0, "inflammatory", 0.0, 1.0),
    )


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def glucose(value, day, low, provider="LabCorp"):
    return measurement("Glucose (Fasting)", value, provider, day, reference_range_low=low)


#: Folder contents step by step: a later extraction of the same measurement, changed bounds, new sources.
STEPS = [
    [
        ("a", [glucose("100", "2025-01-01", "60"), glucose("90", "2025-02-01", "60")], "2025-02-02T00:00:00"),
        ("b", [glucose("91", "2025-02-01", "60", "Quest"), measurement("CRP (hs)", "<1")], "2025-02-03T00:00:00"),
        ("x", [], "2025-02-03T00:00:00"),
    ],
    [
        ("c", [glucose("95", "2025-02-01", "65"), glucose("96", "2025-03-01", "70")], "2025-04-01T00:00:00"),
        ("d", [measurement("CRP (hs)", "2", day="2025-05-01")], "2025-05-02T00:00:00"),
    ],
]


class Lake:
    def __init__(self, spark, folder, meta, renew):
        self.spark, self.meta, self.renew = spark, meta, renew
        self.root, self.in_dir, self.n = str(folder / "lake"), folder / "in", 0
        self.in_dir.mkdir(parents=True)

    def load(self, documents):
        for name, rows, when in documents:
            document = extraction(f"{name}.pdf", rows, extracted_at=when)
            (self.in_dir / f"{name}.json").write_text(json.dumps(document))
        files = read_extraction_files(self.spark, str(self.in_dir))
        self.n += 1
        raw_tables.load_files(files, self.root, f"b{self.n}")

    def run(self, day):
        return self.renew(self.spark, self.root, self.meta, stamp(day), buckets=8)

    def state(self):
        tables = [workflow.read_mart(self.spark, self.root, t) for t in (workflow.STAGED, workflow.FACTS, workflow.DOCUMENTS)]
        tables.append(workflow.read_range_history(self.spark, self.root))
        return [sorted(map(str, t.select(sorted(t.columns)).collect())) for t in tables]

    def files(self):
        return {p: p.stat().st_mtime_ns for p in Path(self.root, "main").rglob("*.parquet")}


@pytest.fixture
def lakes(spark, tmp_path, meta):
    """The same loads, one lake refreshed and the other rebuilt."""
    return [
        Lake(spark, tmp_path / name, meta, renew)
        for name, renew in (("refreshed", workflow.refresh), ("rebuilt", workflow.transform))
    ]


def test_refresh_equals_rebuild_and_leaves_files(lakes):
    touched = None
    for lake in lakes:
        lake.load(STEPS[0])
        lake.run("2025-06-01 00:00:00")
        before = lake.files()
        lake.load(STEPS[1])
        touched = lake.run("2025-06-02 00:00:00") or touched
        assert before.items() <= lake.files().items()
    assert lakes[0].state() == lakes[1].state()
    assert len(lakes[0].state()[3]) == 3  # Quest's range, LabCorp's closed and open one
    # only what was touched has files of the second run
    for table in (workflow.STAGED, workflow.DOCUMENTS, workflow.OPEN):
        written = Path(versions.table_path(lakes[0].root, table), "run=2").glob("bucket=*")
        assert {int(p.name[7:]) for p in written} <= touched[table] < set(range(8))


def test_deletion_and_reload(lakes):
    for lake in lakes:
        lake.load(STEPS[0])
        lake.load(STEPS[1])
        lake.run("2025-06-01 00:00:00")
        # the newest measurement of a key goes, and an older one stands again
        raw_tables.delete_sources(lake.spark, lake.root, ["a.pdf", "b.pdf", "c.pdf", "x.pdf", "nowhere.pdf"])
        (lake.in_dir / "c.json").unlink()
        changed = ("a", [glucose("70", "2025-01-01", "61"), glucose("70", "2025-07-01", "62")], "2025-08-01T00:00:00")
        lake.load([changed])  # x.pdf and b.pdf come back as they were
        lake.run("2025-06-03 00:00:00")
    assert lakes[0].state() == lakes[1].state()
    lake = lakes[0]
    assert all("c.pdf" not in row for row in lake.state()[0])
    raw_tables.delete_sources(lake.spark, lake.root, ["a.pdf", "b.pdf", "d.pdf", "x.pdf"])
    lake.run("2025-06-04 00:00:00")
    assert lake.state()[:3] == [[], [], []] and lake.state()[3]


def test_nothing_new_and_another_dimension(lakes, meta_rows):
    lake = lakes[0]
    lake.load(STEPS[0])
    lake.run("2025-06-01 00:00:00")
    assert lake.run("2025-06-02 00:00:00") == {t: set() for t in workflow.BUCKETED_BY}
    assert versions.current(lake.spark, lake.root) == 1
    lake.meta = meta_rows(("CRP (hs)", "1", "mg/L", "g/L", 0.001, "other", 0.0, 1.0))
    assert lake.run("2025-06-03 00:00:00")[workflow.FACTS] == set(range(8))
    facts = workflow.read_mart(lake.spark, lake.root, workflow.FACTS)
    assert facts.where("category = 'other'").first().value_si == 0.0005
    assert lake.renew(lake.spark, lake.root, lake.meta, buckets=4)[workflow.FACTS] == set(range(4))


@pytest.mark.parametrize("writes", [1, 2, 4, 7])
def test_a_refresh_that_stops_between_two_writes(lakes, monkeypatch, writes):
    lake = lakes[0]
    lake.load(STEPS[0])
    lake.run("2025-06-01 00:00:00")
    before = lake.state()
    lake.load(STEPS[1])
    save, done = versions.save, []

    def stops(*args):
        if len(done) == writes - 1:
            raise RuntimeError("lost")
        done.append(save(*args))

    monkeypatch.setattr(versions, "save", stops)
    with pytest.raises(RuntimeError):
        lake.run("2025-06-02 00:00:00")
    monkeypatch.setattr(versions, "save", save)
    assert lake.state() == before
    lake.run("2025-06-02 00:00:00")
    if writes == 7:
        lakes[1].load(STEPS[0])
        lakes[1].run("2025-06-01 00:00:00")
        lakes[1].load(STEPS[1])
        lakes[1].run("2025-06-02 00:00:00")
        assert lake.state() == lakes[1].state()


def test_old_versions_go(lakes):
    lake = lakes[0]
    for n, step in enumerate(STEPS, 1):
        lake.load(step)
        lake.run(f"2025-06-0{n} 00:00:00")
    before, files = lake.state(), len(lake.files())
    assert versions.drop_unlisted(lake.spark, lake.root, keep=2) == []
    assert versions.drop_unlisted(lake.spark, lake.root)
    assert lake.state() == before and len(lake.files()) < files
    assert versions.drop_unlisted(lake.spark, lake.root) == []


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_environments_are_compared_by_digest(spark, lakes, fact_rows):
    prod, trial = lakes
    for lake in lakes:
        lake.load(STEPS[0])
        lake.run("2025-06-01 00:00:00")
    root = prod.root
    raw_tables_root = raw_tables.environment_root
    homes = {None: prod.root, "trial": trial.root}
    try:
        raw_tables.environment_root = lambda root, env=None: homes[env]
        same = workflow.compare(spark, root, "trial")
        assert same.collect() == [] and "parquet" not in plan_of(same)
        trial.load(STEPS[1])
        trial.run("2025-06-02 00:00:00")
        diff = workflow.compare(spark, root, "trial")
        facts = [workflow.read_mart(spark, h, workflow.FACTS) for h in homes.values()]
        expected = compare_facts(*facts)
        assert diff.collect() == expected.collect() != []
        by_digest = digests.compare_by_digest(*facts, buckets=16)
        assert by_digest.collect() == expected.collect()
        equal = digests.compare_by_digest(facts[1], facts[1].repartition(3))
        assert equal.collect() == [] and "parquet" not in plan_of(equal)
    finally:
        raw_tables.environment_root = raw_tables_root


def test_digests_tell_rows_apart(spark):
    def frame(*rows):
        return spark.createDataFrame(rows, "a int, b int")

    assert digests.equal(frame((1, 2), (3, None)), frame((3, None), (1, 2)))
    for other in (((1, 2), (None, 3)), ((1, 2),), ((1, 2), (1, 2), (3, None)), ()):
        assert not digests.equal(frame((1, 2), (3, None)), frame(*other))
    assert digests.differing({1: (2, "a", 3), 2: (1, "b", 1)}, {1: (2, "a", 3), 3: (1, "b", 1)}) == {2, 3}


def texts_below(root):
    import pyarrow.parquet as pq

    for path in Path(root).rglob("*.parquet"):
        if path.parent.parent.name != "deleted":  # marks name sources
            yield from (str(row) for row in pq.read_table(path).to_pylist())


@pytest.mark.parametrize("writes", [2, 3])
def test_a_purge_takes_deleted_rows_from_all_files(lakes, monkeypatch, writes):
    lake = lakes[0]
    lake.load(STEPS[0])
    lake.load(STEPS[1])
    raw_tables.read_raw(lake.spark, lake.root, "documents").limit(0)
    lake.run("2025-06-01 00:00:00")
    raw_tables.delete_sources(lake.spark, lake.root, ["a.pdf", "c.pdf"])
    with pytest.raises(ValueError, match="refresh before"):
        workflow.purge(lake.spark, lake.root)
    lake.run("2025-06-02 00:00:00")
    before = lake.state(), raw_tables.read_raw(lake.spark, lake.root, "lab_results").count()
    append, done = raw_tables._append, []

    def stops(*args):
        if len(done) == writes - 1:
            raise RuntimeError("lost")
        done.append(append(*args))

    if writes:
        monkeypatch.setattr(raw_tables, "_append", stops)
        with pytest.raises(RuntimeError):
            workflow.purge(lake.spark, lake.root)
        monkeypatch.setattr(raw_tables, "_append", append)
        assert raw_tables.read_raw(lake.spark, lake.root, "lab_results").count() == before[1]
    assert workflow.purge(lake.spark, lake.root)
    assert not [t for t in texts_below(lake.root) if "a.pdf" in t or "c.pdf" in t]
    assert (lake.state(), raw_tables.read_raw(lake.spark, lake.root, "lab_results").count()) == before
    assert lake.run("2025-06-03 00:00:00") == {t: set() for t in workflow.BUCKETED_BY}
    assert workflow.purge(lake.spark, lake.root) == []
    (lake.in_dir / "c.json").unlink()
    lake.load([])
    rows = raw_tables.read_raw(lake.spark, lake.root, "documents").select("source_file").collect()
    assert sorted(r[0] for r in rows) == ["a.pdf", "b.pdf", "d.pdf", "x.pdf"]
