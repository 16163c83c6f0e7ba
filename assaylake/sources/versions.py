"""Tables in hash buckets, replaced bucket by bucket and switched all at once (CP10).

Every run has a number and writes the buckets that it changes below a folder of that number. A version is
a small table of that number, written last: for every bucket of every table it names the run
whose files hold it, with its rows and a digest of them. Readers take the files that the last version names, so a run
that stops anywhere is not seen, tables never change under a reader, and untouched buckets keep
their files. What a version lists is bounded by tables times buckets, whatever the data's size.
"""

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, RUN = "bucket", "run"
_VERSIONS = "_versions"
_ENTRY = "table string, bucket int, buckets int, run int, rows long, hash_sum string, hash_xor long, schema string"


@dataclass(frozen=True)
class Entry:
    """Where a bucket of a table is, and what it holds."""

    table: str
    bucket: int
    buckets: int
    run: int
    rows: int
    hash_sum: str
    hash_xor: int
    schema: str

    @property
    def digest(self) -> tuple[int, str, int]:
        return self.rows, self.hash_sum, self.hash_xor


def bucket_of(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def row_hash(columns: Sequence[str]) -> Column:
    """A hash of a row that tells in which of its columns a NULL stands."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def digest_columns(hashed: Column) -> list[Column]:
    """Count, sum and exclusive or: the same in any order of the rows."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(hashed.cast("decimal(20,0)")).cast("string").alias("hash_sum"),
        F.bit_xor(hashed).alias("hash_xor"),
    ]


def save(df: DataFrame, path: str, *partitions: str) -> None:
    """Every write of a run goes through here; what an unfinished run of the number left is replaced."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def table_path(root: str, table: str) -> str:
    return f"{root}/main/{table}"


def current(spark: SparkSession, root: str) -> int:
    """The number of the last version, or 0."""
    versions = or_none(spark, table_path(root, _VERSIONS))
    return (versions.agg(F.max("version")).first()[0] or 0) if versions is not None else 0


def entries(spark: SparkSession, root: str, version: int | None = None) -> list[Entry]:
    """What a version, by default the last one, lists."""
    version = current(spark, root) if version is None else version
    if version == 0:
        return []
    rows = spark.read.parquet(f"{table_path(root, _VERSIONS)}/version={version}").collect()
    return [Entry(**row.asDict()) for row in rows]


def commit(spark: SparkSession, root: str, version: int, listed: Iterable[Entry]) -> None:
    """Make a version visible, in one file."""
    rows = [tuple(vars(e).values()) for e in listed]
    small = spark.createDataFrame(rows, _ENTRY).coalesce(1)
    save(small, f"{table_path(root, _VERSIONS)}/version={version}")


def write(
    df: DataFrame, root: str, table: str, run: int, bucket: Column, buckets: int = 1
) -> list[Entry]:
    """Write the buckets of ``df`` under a run; returns their entries, digests taken from the files.

    Rows are gathered by bucket, and adaptive execution splits a bucket that is too large for a task.
    """
    path = f"{table_path(root, table)}/{RUN}={run}"
    save(df.withColumn(BUCKET, bucket).hint("rebalance", BUCKET), path, BUCKET)
    written = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField(BUCKET, T.IntegerType())]))
    counted = written.parquet(path).groupBy(BUCKET).agg(*digest_columns(row_hash(df.columns)))
    schema = df.schema.json()
    found = [Entry(table, r.bucket, buckets, run, r.rows, r.hash_sum, r.hash_xor, schema) for r in counted.collect()]
    return found or [Entry(table, -1, buckets, run, 0, "0", 0, schema)]


def replaced(
    before: Iterable[Entry], table: str, touched: Iterable[int], after: Iterable[Entry]
) -> list[Entry]:
    """The entries of ``before`` with the touched buckets of a table as in ``after``; a bucket that lost
    all its rows has no entry."""
    touched = set(touched)
    kept = [e for e in before if e.table != table or (e.rows and e.bucket not in touched)]
    return kept + list(after)


def read(
    spark: SparkSession,
    root: str,
    table: str,
    listed: Sequence[Entry] | None = None,
    buckets: Iterable[int] | None = None,
) -> DataFrame:
    """A table as a version lists it, or only some of its buckets, without a scan of the others."""
    own = [e for e in (entries(spark, root) if listed is None else listed) if e.table == table]
    if not own:
        return spark.read.parquet(table_path(root, table))  # says what is missing
    schema = T.StructType.fromJson(json.loads(own[0].schema))
    chosen = None if buckets is None else set(buckets)
    paths = [
        f"{table_path(root, table)}/{RUN}={e.run}/{BUCKET}={e.bucket}"
        for e in sorted(own, key=lambda e: e.bucket)
        if e.rows and (chosen is None or e.bucket in chosen)
    ]
    if not paths:
        return no_rows(spark, schema)
    return spark.read.schema(schema).parquet(*paths)


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, and known to the optimizer as such, so that joins with it vanish."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).where(F.lit(False)).select(*columns)


def condition(listed: Iterable[Entry], table: str) -> str:
    """As SQL over the partition columns: the files of a table that a version lists."""
    by_run: dict[int, list[int]] = {}
    for e in listed:
        if e.table == table and e.rows:
            by_run.setdefault(e.run, []).append(e.bucket)
    parts = [f"({RUN} = {r} and {BUCKET} in ({', '.join(map(str, sorted(b)))}))" for r, b in sorted(by_run.items())]
    return " or ".join(parts) or "false"


def drop_unlisted(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete the files that none of the last ``keep`` versions lists, once no reader holds an older one;
    returns the folders deleted."""
    last = current(spark, root)
    kept = {
        (e.table, e.run, e.bucket)
        for v in range(max(1, last - keep + 1), last + 1)
        for e in entries(spark, root, v)
    }
    jvm = spark.sparkContext._jvm
    home = jvm.org.apache.hadoop.fs.Path(table_path(root, ""))
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    deleted = []
    for table in {t for t, _, _ in kept} | {_VERSIONS}:
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(table_path(root, table))):
            name, _, number = status.getPath().getName().partition("=")
            if name == "version" and int(number) <= last - keep:
                gone = [status.getPath()]
            elif name == RUN:
                inner = [s.getPath() for s in fs.listStatus(status.getPath()) if s.isDirectory()]
                gone = [
                    p for p in inner if int(number) <= last
                    and p.getName().startswith(f"{BUCKET}=")
                    and (table, int(number), int(p.getName().partition("=")[2])) not in kept
                ]
            else:
                continue
            for path in gone:
                fs.delete(path, True)
                deleted.append(path.toString())
    return sorted(deleted)
