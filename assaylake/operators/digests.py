"""Comparison by digests of buckets: what is equal on both sides is never joined (CP8).

A digest is a bucket's number of rows with the sum and the exclusive or of their hashes, so it does not depend on
the order of the rows. Taking digests scans each side once and shuffles a row per bucket and task; only the
buckets that differ are then shuffled and joined.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.compare import COMPARED, FULL_GRAIN, compare_facts
from assaylake.sources.versions import bucket_of, digest_columns, row_hash

BUCKETS = 4096


def equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables of the same columns hold the same rows, by their digests."""
    one, other = (df.agg(*digest_columns(row_hash(left.columns))).first() for df in (left, right))
    return one == other


def bucket_digests(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """``bucket, rows, hash_sum, hash_xor`` over some columns, in buckets of the keys."""
    bucket = bucket_of(buckets, *keys).alias("bucket")
    return df.groupBy(bucket).agg(*digest_columns(row_hash([*columns])))


def differing(left: Mapping[int, tuple], right: Mapping[int, tuple]) -> set[int]:
    """Buckets that only one side has or whose digests differ."""
    return {b for b in {*left, *right} if left.get(b) != right.get(b)}


def compare_by_digest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = FULL_GRAIN,
    source_file: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The same rows as ``compare_facts``, from a join of the differing buckets alone."""
    columns = [*keys, *COMPARED]
    known = [
        {r.bucket: tuple(r[1:]) for r in bucket_digests(df, keys, columns, buckets).collect()}
        for df in (left, right)
    ]
    numbers = differing(*known)
    inside = bucket_of(buckets, *keys).isin(*numbers) if numbers else F.lit(False)
    return compare_facts(left.where(inside), right.where(inside), keys, source_file)
