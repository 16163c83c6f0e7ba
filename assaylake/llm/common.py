"""What the corpus operators share."""

from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

ID_KEY = ["_id", "_no_id"]

#: Holds a whole input row while operators add columns of any name beside it.
ROW = "_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def id_key(doc_id: Column) -> list[Column]:
    """A doc_id as two columns without nulls, ``ID_KEY``: joining and then grouping by them takes
    one shuffle."""
    return [F.coalesce(doc_id, F.lit(0)).alias("_id"), doc_id.isNull().alias("_no_id")]


def by_value(df: DataFrame, value: Any) -> Broadcast:
    """Broadcasts bytes that give an object of this package without the package at hand."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def boxed(df: DataFrame) -> DataFrame:
    """Whole rows in one column, so that no name of theirs clashes with a working column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def unboxed(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")
