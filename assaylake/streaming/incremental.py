"""Incremental loading of a growing directory (ST1)."""

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assaylake.sources import extraction, raw_tables
from assaylake.sources.raw_tables import load_files
from assaylake.sources.shared import small_files


def file_stream(
    spark: SparkSession, in_dir: str, files_per_trigger: int | None = None
) -> DataFrame:
    """New extraction files of a directory as ``(path, content)``."""
    reader = spark.readStream.format("text").option("wholetext", True)
    reader = reader.option("pathGlobFilter", "*.json")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(in_dir).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def start_load(
    files: DataFrame, root: str, checkpoint: str, now: Column | None = None
) -> StreamingQuery:
    """Load what is new in a stream of files, then stop.

    A micro-batch is one load batch, named after the query's id in the checkpoint and its number.
    Replayed after a failure it loads what is still missing; sources that are loaded are skipped,
    also by a query that starts over with another checkpoint.
    """
    spark, name = files.sparkSession, f"load-{uuid4()}"

    def load(batch: DataFrame, number: int) -> None:
        query_id = next(q.id for q in spark.streams.active if q.name == name)
        load_files(batch, root, f"stream-{query_id}-{number:09d}", now)

    return (
        files.writeStream.queryName(name)
        .foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_incremental_load(
    spark: SparkSession, in_dir: str, root: str, checkpoint: str
) -> StreamingQuery:
    with small_files(spark):
        return start_load(file_stream(spark, in_dir), root, checkpoint)


def arrivals(files: DataFrame, now: Column | None = None) -> DataFrame:
    """A stream of ``schemas.ARRIVALS``: all checked files, and each source once, when the first good file
    of it arrives. The sources met so far are the stream's state; only they are shuffled."""
    checked = extraction.check_extractions(files, now)
    sources = extraction.good_files(checked).select("source_file").dropDuplicates(["source_file"])
    nothing = [
        F.lit(None).cast(f.dataType).alias(f.name) for f in checked.schema if f.name != "source_file"
    ]
    new = sources.select("source_file", *nothing, F.lit(True).alias("is_new"))
    return checked.withColumn("is_new", F.lit(False)).unionByName(new)


def start_stateful_load(
    files: DataFrame, root: str, checkpoint: str, now: Column | None = None
) -> StreamingQuery:
    """Load what is new in a stream of files, then stop; the stream's state says what is new.

    No micro-batch reads what is loaded already, so its cost is that of its own files. The state lives
    in the checkpoint and is only of this stream: the tables must be empty when a checkpoint begins, other
    loads of them are not seen, and a source stays met when it is deleted (``start_load`` looks at the
    tables instead). A replayed micro-batch that was finished is left as it is. Keep large states in
    RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    spark, name = files.sparkSession, f"load-{uuid4()}"

    def load(batch: DataFrame, number: int) -> None:
        query_id = next(q.id for q in spark.streams.active if q.name == name)
        label = f"state-{query_id}-{number:09d}"
        if number == 0:
            others = raw_tables.stored_rows(spark, root, raw_tables.ATTEMPTS)
            if not others.where(F.col(raw_tables.BATCH) != label).isEmpty():
                raise ValueError(f"a new checkpoint cannot know what was loaded before: {root}")
        raw_tables.load_arrivals(batch, root, label, spark)

    return (
        arrivals(files, now)
        .writeStream.queryName(name)
        .foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
