"""Raw tables on parquet: loading, deleting and reloading (SNK1-SNK10).

Nothing stored is ever overwritten. The tables are partitioned by ``load_batch``, and a load appends
its rows under an attempt of its own: ``incoming`` and ``rejected``, measurements, documents, and last
one row in ``attempts``. Only rows of an attempt that stands there count, so what a failed load left is
never seen, and running it again, under any batch name, appends what is still missing. Deleting a
source appends a mark against its attempt, in one write. Both tables of what counts have a row per
load or deleted source, so reading the raw tables needs no shuffle of theirs.
"""

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake import schemas
from assaylake.sources import extraction, versions
from assaylake.sources.shared import small_files

BATCH, ATTEMPT = "load_batch", "load_attempt"
DELETED, ATTEMPTS = "deleted", "attempts"
TABLES = {
    "lab_results": schemas.LAB_RESULTS,
    "documents": schemas.DOCUMENTS,
    "rejected": schemas.REJECTED,
    "incoming": schemas.CHECKED_FILE,
    "arrivals": schemas.ARRIVALS,
    DELETED: T.StructType().add("source_file", "string").add("deletion", "string"),
    ATTEMPTS: T.StructType().add("documents", "long").add("replaces", schemas.TEXTS),
}


def environment_root(root: str, env: str | None = None) -> str:
    """Folder of the production tables, or of a named environment beside them."""
    return f"{root}/envs/{env}" if env else root


def table_path(root: str, table: str) -> str:
    return f"{root}/raw/{table}"


def stored_schema(table: str) -> T.StructType:
    """The fixed columns, then the attempt and the batch that wrote a row."""
    return T.StructType([*TABLES[table].fields]).add(ATTEMPT, "string").add(BATCH, "string")


def stored_rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All rows in the files of a table, counted or not.

    Columns that older files lack read as NULL; a table not written yet is empty.
    """
    schema = stored_schema(table)
    try:
        return spark.read.schema(schema).parquet(table_path(root, table))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)


def same_load(left: str, right: str) -> Column:
    """Whether two rows are of one source in one attempt; older files name no attempt."""
    return (
        (F.col(f"{left}.source_file") == F.col(f"{right}.source_file"))
        & (F.col(f"{left}.{BATCH}") == F.col(f"{right}.{BATCH}"))
        & F.col(f"{left}.{ATTEMPT}").eqNullSafe(F.col(f"{right}.{ATTEMPT}"))
    )


def _named() -> Column:
    """An attempt's name; rows in older files have none."""
    return F.coalesce(ATTEMPT, F.lit("")).alias("named")


def _replaced(spark: SparkSession, root: str) -> DataFrame:
    """``load_batch, named``: attempts whose rows a purge wrote again without the deleted ones."""
    attempts = stored_rows(spark, root, ATTEMPTS)
    return attempts.select(BATCH, F.explode("replaces").alias("named"))


def counted_rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of finished attempts that no purge replaced and whose source is not marked as deleted.
    Rows in older files name no attempt and count. What they are joined with has a row per load or
    deleted source."""
    rows = stored_rows(spark, root, table).alias("r")
    marks = stored_rows(spark, root, DELETED).select("source_file", BATCH, ATTEMPT).alias("x")
    unnamed = spark.range(1).select(F.lit(None).cast("string").alias(ATTEMPT))
    finished = stored_rows(spark, root, ATTEMPTS).select(ATTEMPT).unionByName(unnamed).alias("a")
    rows = rows.join(finished, F.col(f"r.{ATTEMPT}").eqNullSafe(F.col(f"a.{ATTEMPT}")), "left_semi")
    replaced = _replaced(spark, root).alias("p")
    gone = (F.col(f"r.{BATCH}") == F.col(f"p.{BATCH}")) & (
        F.coalesce(F.col(f"r.{ATTEMPT}"), F.lit("")) == F.col("p.named")
    )
    rows = rows.join(replaced, gone, "left_anti")
    return rows.join(marks, same_load("r", "x"), "left_anti")


def read_raw(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a raw table that count, with its fixed columns and ``load_batch``."""
    if table in ("documents", "lab_results"):
        rows = counted_rows(spark, root, table)
    else:
        rows = stored_rows(spark, root, table)
        if table == "rejected":  # a file is rejected again by every attempt that meets it
            rows = rows.dropDuplicates([BATCH, "path"])
    return rows.drop(ATTEMPT)


empty = versions.no_rows


def _append(df: DataFrame, root: str, table: str, batch: str, attempt: str) -> None:
    target = f"{table_path(root, table)}/{BATCH}={batch}"
    df.withColumn(ATTEMPT, F.lit(attempt)).write.mode("append").parquet(target)


def load_files(
    files: DataFrame, root: str, batch: str, now: Column | None = None
) -> DataFrame:
    """Load extraction files ``(path, content)`` as one batch; returns its statistics.

    Files are parsed once, into the ``incoming`` table; rejected ones stay there and in
    ``rejected`` while the others go on.
    """
    return load_checked(extraction.check_extractions(files, now), root, batch)


def load_checked(checked: DataFrame, root: str, batch: str) -> DataFrame:
    spark, attempt = checked.sparkSession, uuid.uuid4().hex
    _append(checked, root, "incoming", batch, attempt)
    incoming = _of_attempt(spark, root, "incoming", batch, attempt)
    # Of all sources ever loaded only those that come again take part in the check for new ones.
    again = incoming.select("source_file").distinct()
    known = read_raw(spark, root, "documents").join(again, "source_file", "left_semi")
    fresh = extraction.new_documents(extraction.good_files(incoming), known)
    return _load(incoming, fresh, root, batch, attempt)


def load_arrivals(
    arrivals: DataFrame, root: str, batch: str, spark: SparkSession | None = None
) -> None:
    """Load a micro-batch of ``schemas.ARRIVALS``: of its good files the first by path for each source that
    its rows with ``is_new`` name. What is loaded already is not looked at. A batch that was
    finished before is left as it is. The stream's own session plans without adaptive execution; what
    follows the write of the arrivals runs in ``spark``."""
    spark, attempt = spark or arrivals.sparkSession, uuid.uuid4().hex
    finished = stored_rows(spark, root, ATTEMPTS).where(F.col(BATCH) == batch)
    if not finished.isEmpty():
        arrivals.write.format("noop").mode("overwrite").save()  # the stream's state moves on all the same
        return
    _append(arrivals, root, "arrivals", batch, attempt)
    rows = _of_attempt(spark, root, "arrivals", batch, attempt)
    incoming = rows.where(~F.col("is_new")).drop("is_new")
    first = extraction.first_by_source(extraction.good_files(incoming))
    new = rows.where("is_new").select("source_file")
    _load(incoming, first.join(new, "source_file", "left_semi"), root, batch, attempt)


def _of_attempt(spark: SparkSession, root: str, table: str, batch: str, attempt: str) -> DataFrame:
    here = (F.col(BATCH) == batch) & (F.col(ATTEMPT) == attempt)
    return stored_rows(spark, root, table).where(here).drop(BATCH, ATTEMPT)


def _load(incoming: DataFrame, fresh: DataFrame, root: str, batch: str, attempt: str) -> DataFrame:
    """Append what an attempt brings, the row that makes it count last; returns its statistics."""
    spark = incoming.sparkSession
    _append(extraction.rejected_files(incoming), root, "rejected", batch, attempt)
    _append(extraction.measurement_rows(fresh), root, "lab_results", batch, attempt)
    _append(extraction.document_rows(fresh), root, "documents", batch, attempt)
    documents = _of_attempt(spark, root, "documents", batch, attempt)
    _finish(documents, root, batch, attempt)
    loaded = documents.withColumnRenamed("biomarker_count", "measurement_count")
    return extraction.load_statistics(incoming, loaded)


def _finish(documents: DataFrame, root: str, batch: str, attempt: str, replaces: Sequence[str] = ()) -> None:
    """The row that makes an attempt count, in one file."""
    none = F.lit(None).cast("array<string>")
    counted = documents.agg(F.count(F.lit(1)).alias("documents")).coalesce(1)
    named = F.array(*map(F.lit, replaces)) if replaces else none
    _append(counted.withColumn("replaces", named), root, ATTEMPTS, batch, attempt)


def without_sources(table: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Rows of other sources than the listed ones; the list reaches the scan as a filter."""
    return table.where(~F.col("source_file").isin(*sources))


def delete_sources(spark: SparkSession, root: str, sources: Sequence[str]) -> int:
    """Delete sources from both raw tables; returns the number of measurement rows deleted.

    One write marks the sources' documents as deleted, whatever number of batches they are in; the
    documents and, with them, the measurements no longer count.
    """
    listed = F.col("source_file").isin(*sources)
    deleted = read_raw(spark, root, "lab_results").where(listed).count()
    marks = counted_rows(spark, root, "documents").where(listed)
    marks = marks.select("source_file", F.lit(uuid.uuid4().hex).alias("deletion"), ATTEMPT, BATCH)
    marks.write.mode("append").partitionBy(BATCH).parquet(table_path(root, DELETED))
    return deleted


def purge_deleted(spark: SparkSession, root: str) -> list[str]:
    """Take the rows of deleted sources out of the files; returns the files removed.

    Each batch with deleted rows is written again without them under an attempt of its own, whose
    finishing row names the attempts that it replaces: from then on those no longer count. Their files
    are removed after that, with the parsed files that the loads of these batches kept. Stopped
    anywhere, every row still counts once, and the next call goes on. Run it while no load of these batches is
    under way. Only the touched batches are read and written.
    """
    marks = stored_rows(spark, root, DELETED).select(BATCH, _named()).distinct()
    left = marks.join(_replaced(spark, root), [BATCH, "named"], "left_anti")
    for batch in sorted(r[0] for r in left.select(BATCH).distinct().collect()):
        attempt = f"purge-{uuid.uuid4().hex}"
        here = F.col(BATCH) == batch
        counted = counted_rows(spark, root, "documents").where(here)
        standing = stored_rows(spark, root, ATTEMPTS).where(here).select(_named())
        standing = standing.join(_replaced(spark, root).where(here), "named", "left_anti").distinct()
        replaces = sorted({r[0] for r in standing.collect()} | {""})
        for table in ("lab_results", "documents"):
            rows = counted_rows(spark, root, table).where(here).drop(BATCH, ATTEMPT)
            _append(rows, root, table, batch, attempt)
        _finish(counted, root, batch, attempt, replaces)
    return _drop_replaced(spark, root)


def _drop_replaced(spark: SparkSession, root: str) -> list[str]:
    """Remove the files of replaced attempts, and what no finished attempt wrote in their batches."""
    batches = [r[0] for r in _replaced(spark, root).select(BATCH).distinct().collect()]
    if not batches:
        return []
    standing = stored_rows(spark, root, ATTEMPTS).select(BATCH, _named())
    standing = standing.join(_replaced(spark, root), [BATCH, "named"], "left_anti")
    fs, removed = None, []
    for table in ("lab_results", "documents", "incoming", "arrivals"):
        if not _on_disk(spark, table_path(root, table)):
            continue
        rows = stored_rows(spark, root, table).select(BATCH, _named(), F.col("_metadata.file_path").alias("file"))
        dead = rows.where(F.col(BATCH).isin(*batches)).join(standing, [BATCH, "named"], "left_anti")
        for file in sorted(r[0] for r in dead.select("file").distinct().collect()):
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
            fs = fs or path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, False)
            removed.append(file)
    return removed


def _on_disk(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def reload_sources(
    spark: SparkSession, root: str, sources: Sequence[str], in_dir: str, batch: str
) -> tuple[int, DataFrame]:
    """Delete sources, then load whatever the directory holds that is not loaded."""
    deleted = delete_sources(spark, root, sources)
    with small_files(spark):
        files = extraction.read_extraction_files(spark, in_dir)
        return deleted, load_files(files, root, batch)
