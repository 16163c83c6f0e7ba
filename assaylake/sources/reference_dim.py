"""The reference dimension as CSV with declared types (SRC6)."""

from pyspark.sql import DataFrame, SparkSession

from assaylake.schemas import REFERENCE_DIMENSION


def read_reference_dimension(spark: SparkSession, path: str) -> DataFrame:
    """Dimension rows; an empty field is NULL."""
    return spark.read.schema(REFERENCE_DIMENSION).csv(path, header=True, enforceSchema=False)
