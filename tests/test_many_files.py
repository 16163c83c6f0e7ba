"""Streams and directories of many files are dealt out evenly, with the same rows."""

import datetime
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from assaylake.sources import extraction, named_files, raw_tables
from assaylake.sources.named_files import write_named
from assaylake.sources.shared import small_files
from registry import queries


@pytest.fixture
def sf_dir(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i), i % 7, "view", 1.0 + i, None) for i in range(2000)]
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    return str(tmp_path / "sf")


def test_a_part_of_the_stream_is_many_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_folder", lambda *_: str(tmp_path / "lake"))
    want = {tuple(r) for r in contract.queries()["flatten_measurements"](spark, sf_dir).collect()}
    monkeypatch.setattr(queries, "PARTED_ROWS", 1000)
    got = [tuple(r) for r in contract.queries()["stateful_ingest"](spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want
    parts = [len(list((tmp_path / "lake/in" / str(n)).glob("*.parquet"))) for n in range(5)]
    assert parts == [queries.PART_FILES] * 5
    batches = raw_tables.stored_rows(spark, str(tmp_path / "lake"), raw_tables.ATTEMPTS)
    assert batches.select(raw_tables.BATCH).distinct().count() == 5


def test_too_few_rows_for_the_files_of_a_part(spark, tmp_path):
    with pytest.raises(ValueError, match="files instead of 5"):
        queries._write_files(spark.range(2), str(tmp_path / "out"), 5)


def test_small_files_share_tasks(spark, tmp_path):
    names = spark.range(200).select(F.concat("id", F.lit(".json")).alias("name"), F.lit("{}").alias("content"))
    write_named(names, str(tmp_path / "in"), rows_per_name=1)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with small_files(spark):
        raw_tables.load_files(extraction.read_extraction_files(spark, str(tmp_path / "in")), str(tmp_path / "lake"), "b")
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert len(list((tmp_path / "lake/raw/incoming").rglob("*.parquet"))) <= 8  # one a core
    assert raw_tables.read_raw(spark, str(tmp_path / "lake"), "rejected").count() == 200


def test_whole_files_are_whole_texts(spark, tmp_path):
    for name, content in (("a b", b'{"a": "\xc3\xa9"}\r\n\n'), ("é", b"\xef\xbb\xbf{}"), ("c", b"\xff\n"), ("d", b"")):
        (tmp_path / f"{name}.json").write_bytes(content)
    (tmp_path / "other.txt").write_text("x")
    raw = F.hex(F.col("content").cast("binary"))
    text = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter="*.json")
    text = text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    found = extraction.read_extraction_files(spark, str(tmp_path))
    assert "binaryFile" in found._jdf.queryExecution().toString()
    assert sorted(found.select("path", raw).collect()) == sorted(text.select("path", raw).collect())


def test_folders_of_tasks_are_moved_side_by_side(tmp_path, monkeypatch):
    both, move = threading.Barrier(2, timeout=20), named_files._move_all

    def together(files, home, root):
        both.wait()
        move(files, home, root)

    monkeypatch.setattr(named_files, "_move_all", together)
    writer = named_files.NamedFilesWriter(str(tmp_path / "out"), overwrite=False)
    for task in range(6):
        home = tmp_path / "out" / writer.staging / str(task) / "d"
        home.mkdir(parents=True)
        (home / f"{task}.txt").write_text(str(task))
        (home.parent / f"top{task}.txt").write_text("t")
    writer.commit([named_files.Written(f"{writer.staging}/{t}") for t in range(6)] + [None])
    files = {str(p.relative_to(tmp_path / "out")) for p in Path(tmp_path / "out").rglob("*") if p.is_file()}
    assert files == {f"d/{t}.txt" for t in range(6)} | {f"top{t}.txt" for t in range(6)}
    assert not (tmp_path / "out" / writer.staging).exists()


def test_files_read_by_tasks_are_those_of_the_binary_source(spark, tmp_path):
    names = ["a b.json", "é%20.json", "c,;=+(1).json", "d.JSON", "other.txt", "_hidden.json", ".dot.json"]
    for number, name in enumerate(names):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"\xff{}\n" * (number + 1))
    (tmp_path / "in/empty.json").touch()
    (tmp_path / "in/sub").mkdir()
    (tmp_path / "in/sub/e.json").write_text("{}")
    raw = F.hex(F.col("content").cast("binary"))
    for directory in (str(tmp_path / "in"), f"file://{tmp_path}/in/", str(tmp_path / "in/*.json")):
        want = extraction.read_extraction_files(spark, directory).select("path", raw).collect()
        found = extraction.extraction_files_by_tasks(spark, directory)
        assert len(want) == 3 and sorted(found.select("path", raw).collect()) == sorted(want)
        listed_by_spark = "binaryFile" in found._jdf.queryExecution().toString()
        assert listed_by_spark == ("*" in directory)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        extraction.extraction_files_by_tasks(spark, str(tmp_path / "none"))


def test_a_run_and_an_export_leave_the_listing_of_their_files_to_tasks(spark, sf_dir, tmp_path, monkeypatch):
    def listed(*_args, **_options):
        raise AssertionError("the driver lists a file for each document")

    want = [sorted(map(tuple, contract.queries()[n](spark, sf_dir).collect())) for n in ("workflow_run", "exported_files")]
    assert all(want)
    monkeypatch.setattr(extraction, "whole_files", listed)
    got = [sorted(map(tuple, contract.queries()[n](spark, sf_dir).collect())) for n in ("workflow_run", "exported_files")]
    assert got == want


def test_a_task_hands_its_files_over_in_parts(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"
    monkeypatch.setattr(named_files, "_move_all", _counting(str(seen), named_files._move_all))
    names = spark.range(3000).coalesce(1).select(F.concat(F.lit("d/"), "id").alias("name"), F.lit("x").alias("content"))
    write_named(names, str(tmp_path / "out"), rows_per_name=1)
    sizes = [int(n) for n in seen.read_text().split()]
    assert sum(sizes) == 3000 and max(sizes) < 100
    assert len(list((tmp_path / "out/d").iterdir())) == 3000


def _counting(seen, move):
    def counted(files, home, root):
        with open(seen, "a") as out:
            out.write(f"{sum(p.is_file() for p in Path(home).rglob('*'))}\n")
        move(files, home, root)

    return counted


def test_a_name_that_comes_twice_is_refused(spark, tmp_path):
    rows = [("a", "1"), ("b", "2"), ("a", "3")]
    df = spark.createDataFrame(rows, "name string, content string").coalesce(1)
    with pytest.raises(Exception, match="do not follow each other"):
        write_named(df, str(tmp_path / "out"), rows_per_name=1)
