"""Tables between jobs, in a folder that the driver and all executors share."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset. On a
    cluster a warehouse on the driver's own disk is refused, as executors do not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        own_disk = warehouse.startswith("file:") or "://" not in warehouse
        if own_disk and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{warehouse}/_between_jobs"
    return f"{root.rstrip('/')}/assaylake-{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of ``df`` as a written table: later jobs read it instead of computing it again."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


#: What opening a file counts as when files are dealt out to tasks. Spark's 4 MB would put 32 small files in
#: a task, and each task writes a file of its own again.
OPEN_COST = "64k"
_OPEN_COST = "spark.sql.files.openCostInBytes"


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Within it, jobs that start to read a directory of small files deal thousands of them to a task, and
    streams that start keep to that. The setting is the session's."""
    before = spark.conf.get(_OPEN_COST)
    spark.conf.set(_OPEN_COST, OPEN_COST)
    try:
        yield
    finally:
        spark.conf.set(_OPEN_COST, before)
