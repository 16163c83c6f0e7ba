from datetime import date

import pytest
from pyspark.sql import functions as F

from assaylake.operators import history, quality
from assaylake.operators.compare import compare_facts, compare_summary
from assaylake.operators.staging import stage_measurements


def ranges(raw_rows, *days):
    """Staged rows of one key: (date, low, high)."""
    return stage_measurements(
        raw_rows(
            *[
                {"report_date": d, "reference_range_low_raw": lo, "reference_range_high_raw": hi}
                for d, lo, hi in days
            ]
        )
    )


DAYS = [
    ("2025-01-01", "1", "9"),
    ("2025-02-01", "1", "9"),
    ("2025-03-01", None, None),
    ("2025-04-01", "2", "9"),
    ("2025-05-01", "2", None),
    ("2025-06-01", "1", "9"),
]


def day(text):
    return text and date.fromisoformat(text)


def test_rebuilt_history(raw_rows):
    rows = history.rebuild_range_history(ranges(raw_rows, *DAYS)).orderBy("valid_from").collect()
    got = [
        (r.reference_range_low, r.reference_range_high, r.valid_from, r.valid_to, r.last_seen_date)
        for r in rows
    ]
    assert got == [
        (1.0, 9.0, day("2025-01-01"), day("2025-04-01"), day("2025-02-01")),
        (2.0, 9.0, day("2025-04-01"), day("2025-05-01"), day("2025-04-01")),
        (2.0, None, day("2025-05-01"), day("2025-06-01"), day("2025-05-01")),
        (1.0, 9.0, day("2025-06-01"), None, day("2025-06-01")),
    ]


def test_snapshot_groups_by_range(raw_rows):
    rows = history.range_snapshot(ranges(raw_rows, *DAYS)).collect()
    assert {(r.reference_range_low, r.reference_range_high): r.last_seen_date for r in rows} == {
        (1.0, 9.0): day("2025-06-01"),
        (2.0, 9.0): day("2025-04-01"),
        (2.0, None): day("2025-05-01"),
    }


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def test_merging_day_by_day_gives_the_rebuilt_versions(raw_rows, spark, tmp_path):
    merged = None
    for n, one in enumerate(DAYS):
        batch = history.newest_range(ranges(raw_rows, one))
        if merged is None:
            merged = history.open_history(batch, stamp(one[0]))
        else:
            merged = history.merge_range_history(merged, batch, stamp(one[0]))
        path = str(tmp_path / str(n))
        merged.write.parquet(path)
        merged = spark.read.parquet(path)
    rebuilt = history.rebuild_range_history(ranges(raw_rows, *DAYS))
    columns = [*history.BOUNDS, "valid_from", "valid_to"]

    def versions(df):
        return sorted(
            df.select(*[F.col(c).cast("string" if "valid" in c else "double") for c in columns])
            .select(*[F.substring(c, 1, 10) if "valid" in c else c for c in columns])
            .collect(),
            key=str,
        )

    assert versions(merged) == versions(rebuilt)


def test_merge_keeps_closes_and_opens(raw_rows):
    def batch(**names):
        rows = [
            {"biomarker_name_raw": n, "reference_range_low_raw": low, "report_date": d}
            for n, (low, d) in names.items()
        ]
        return history.newest_range(stage_measurements(raw_rows(*rows)))

    first = history.open_history(
        batch(same=("1", "2025-01-01"), moved=("1", "2025-01-01"), gone=("1", "2025-01-01")),
        stamp("2025-01-02 00:00:00"),
    )
    second = batch(same=("1", "2025-02-01"), moved=("2", "2025-02-01"), new=("1", "2025-02-01"))
    run = stamp("2025-02-02 00:00:00")
    once = history.merge_range_history(first, second, run)
    assert sorted(
        (r.biomarker_name, r.reference_range_low, str(r.valid_from)[:10], str(r.valid_to)[:10])
        for r in once.collect()
    ) == [
        ("gone", 1.0, "2025-01-02", "None"),
        ("moved", 1.0, "2025-01-02", "2025-02-02"),
        ("moved", 2.0, "2025-02-02", "None"),
        ("new", 1.0, "2025-02-02", "None"),
        ("same", 1.0, "2025-01-02", "None"),
    ]
    twice = history.merge_range_history(once, second, run)
    assert sorted(twice.collect(), key=str) == sorted(once.collect(), key=str)


FACT = {
    "biomarker_key": "Glucose", "report_date": "2025-06-01", "provider": "Q", "value_si": 5.0,
    "unit_si": "mmol/L", "source_file": "a.pdf",
}


def diff(left, right, **options):
    columns = ("biomarker", "prod_value", "env_value", "diff", "status")
    return [tuple(r[c] for c in columns) for r in compare_facts(left, right, **options).collect()]


def test_equal_environments(fact_rows):
    assert diff(fact_rows(FACT), fact_rows(FACT)) == []
    quoted = fact_rows({**FACT, "source_file": "o'brien.pdf"})
    assert diff(quoted, quoted, source_file="o'brien.pdf") == []


def test_null_change_and_one_sided_rows(fact_rows):
    left = fact_rows(FACT, {**FACT, "biomarker_key": "LDL"}, {**FACT, "biomarker_key": "TSH"})
    right = fact_rows(
        {**FACT, "value_si": None},
        {**FACT, "biomarker_key": "HDL"},
        {**FACT, "biomarker_key": "TSH", "value_si": 5.12345},
    )
    assert diff(left, right) == [
        ("Glucose", 5.0, None, None, "CHANGED"),
        ("HDL", None, 5.0, None, "ENV ONLY"),
        ("LDL", 5.0, None, None, "PROD ONLY"),
        ("TSH", 5.0, 5.12345, 0.1235, "CHANGED"),
    ]
    summary = {r.measure: r.rows for r in compare_summary(left, right).collect()}
    assert summary == {"prod rows": 3, "env rows": 3, "CHANGED": 2, "ENV ONLY": 1, "PROD ONLY": 1}


def test_source_filter_follows_the_join(fact_rows):
    """The other side of a match comes from another file and must not look missing."""
    left, right = fact_rows(FACT), fact_rows({**FACT, "source_file": "b.pdf", "value_si": 6.0})
    for source in ("a.pdf", "b.pdf"):
        assert diff(left, right, source_file=source) == [("Glucose", 5.0, 6.0, 1.0, "CHANGED")]
    assert diff(left, right, source_file="c.pdf") == []


def test_keys_decide_what_matches(fact_rows):
    left = fact_rows(FACT, {**FACT, "provider": "L", "value_si": 7.0})
    right = fact_rows(FACT, {**FACT, "provider": "L", "value_si": 8.0})
    assert diff(left, right) == [("Glucose", 7.0, 8.0, 1.0, "CHANGED")]
    brute = sorted(
        (a, b) for a in (5.0, 7.0) for b in (5.0, 8.0) if a != b
    )
    reduced = diff(left, right, keys=("biomarker_key", "report_date"))
    assert sorted((p, e) for _, p, e, _, _ in reduced) == brute


@pytest.fixture
def table(spark):
    rows = [(1, "a"), (1, None), (2, "b"), (None, "b"), (None, "c")]
    return spark.createDataFrame(rows, "id int, key string")


def result(df):
    return [(r["column"], r.failures, r.passed) for r in df.collect()]


def test_unique(table):
    assert result(quality.check_unique(table, ["id", "key"], "t")) == [
        ("id", 1, False),
        ("key", 1, False),
    ]
    assert result(quality.check_unique(table.where("id = 2"), ["id"], "t")) == [("id", 0, True)]


def test_not_null(table):
    check = quality.check_not_null(table, ["id", "key"], "t", quality.WARN)
    assert result(check) == [("id", 2, False), ("key", 1, False)]
    assert {r.severity for r in check.collect()} == {"warn"}
    empty = quality.check_not_null(table.where("false"), ["id"], "t")
    assert result(empty) == [("id", 0, True)]


def test_relationship(table, spark):
    parents = spark.createDataFrame([("a",), ("c",)], "key string")
    check = quality.check_relationship(table, "key", parents, "key", "t")
    assert result(check) == [("key", 2, False)]
    everything = quality.check_relationship(table, "key", table, "key", "t")
    assert result(everything) == [("key", 0, True)]
