"""Data-quality checks as one-row results (DQ1-DQ5).

Each check gives ``(check, table, column, severity, failures, passed)``; ``declared_checks``
unites the checks of the whole model.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake import schemas

ERROR, WARN = "error", "warn"


def _result(check: str, table: str, column, severity: str, failures: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(table).alias("table"),
        F.lit(column).alias("column"),
        F.lit(severity).alias("severity"),
        failures.alias("failures"),
        (failures == 0).alias("passed"),
    )


def check_unique(
    df: DataFrame, columns: Sequence[str], table: str, severity: str = ERROR
) -> DataFrame:
    """Number of values that occur more than once, per column; NULLs do not count.

    All columns share one scan and one shuffle of ``(column, value)`` pairs.
    """
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    values = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    occurrences = values.groupBy("column", "value").count()
    repeated = F.col("count") > 1
    counted = occurrences.agg(
        *[F.count_if(repeated & (F.col("column") == c)).alias(c) for c in columns]
    )
    rows = [_result("unique", table, c, severity, F.col(c)) for c in columns]
    return counted.select(F.inline(F.array(*rows)))


def check_not_null(
    df: DataFrame,
    columns: Sequence[str],
    table: str,
    severity: str = ERROR,
    warn_only: Sequence[str] = (),
) -> DataFrame:
    """Number of NULLs per column, all columns in one pass; ``warn_only`` columns only warn."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = [
        _result("not_null", table, c, WARN if c in warn_only else severity, F.col(c))
        for c in columns
    ]
    return counted.select(F.inline(F.array(*rows)))


def check_columns(
    df: DataFrame,
    unique: Sequence[str],
    required: Sequence[str],
    table: str,
    warn_only: Sequence[str] = (),
) -> DataFrame:
    """Unique and not-null checks of one table in one scan and one shuffle.

    A unique column gives a pair ``(column, value)`` per row, a column that is only required one
    where it is NULL.
    """
    def pair(column: str, value: Column) -> Column:
        return F.struct(F.lit(column).alias("column"), value.alias("value"))

    pairs = [pair(c, F.col(c).cast("string")) for c in unique]
    missing = F.lit(None).cast("string")
    pairs += [F.when(F.col(c).isNull(), pair(c, missing)) for c in required if c not in unique]
    values = df.select(F.inline(F.array_compact(F.array(*pairs))))
    counted = values.groupBy("column", "value").count()
    of = lambda c: F.col("column") == c
    repeated = (F.col("count") > 1) & F.col("value").isNotNull()
    nulls = lambda c: F.when(of(c) & F.col("value").isNull(), F.col("count"))
    failures = {f"unique {c}": F.count_if(repeated & of(c)) for c in unique}
    failures |= {f"not_null {c}": F.coalesce(F.sum(nulls(c)), F.lit(0)) for c in required}
    one = counted.agg(*[v.cast("long").alias(k) for k, v in failures.items()])
    rows = [_result("unique", table, c, ERROR, F.col(f"`unique {c}`")) for c in unique]
    rows += [
        _result(
            "not_null", table, c, WARN if c in warn_only else ERROR, F.col(f"`not_null {c}`")
        )
        for c in required
    ]
    return one.select(F.inline(F.array(*rows)))


def check_relationship(
    df: DataFrame,
    column: str,
    parent: DataFrame,
    parent_column: str,
    table: str,
    severity: str = ERROR,
) -> DataFrame:
    """Number of rows whose value has no parent; rows are counted per value before the join."""
    children = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("child")).count()
    parents = parent.select(F.col(parent_column).alias("child"))
    orphans = children.join(parents, "child", "left_anti")
    total = orphans.agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("n"))
    return total.select(
        F.inline(F.array(_result("relationships", table, column, severity, F.col("n"))))
    )


def unit_mismatch(facts: DataFrame, meta: DataFrame) -> DataFrame:
    """Facts converted although their unit is not the dimension's conventional unit."""
    m = meta.select(
        F.col("biomarker_key"), "conventional_unit", F.col("conversion_factor").alias("factor")
    )
    return facts.join(m, "biomarker_key").where(
        F.col("factor").isNotNull()
        & (F.col("factor") != 1)
        & ~F.col("unit_original").eqNullSafe(F.col("conventional_unit"))
    )


def declared_checks(
    raw: DataFrame,
    docs: DataFrame,
    staged: DataFrame,
    facts: DataFrame,
    documents: DataFrame,
    meta: DataFrame,
) -> DataFrame:
    """The declared checks of the model: 7 unique, 13 not-null, 1 relationship.

    Each table is scanned once, facts twice; pass written tables rather than the plans behind
    them.
    """
    checks = [
        check_columns(
            raw, ["id"], ["id", "source_file", "biomarker_name_raw", "value_raw"], "lab_results"
        ),
        check_columns(docs, ["id", "source_file"], ["id", "source_file"], "documents"),
        check_columns(
            staged, ["lab_result_id"], ["lab_result_id", "biomarker_name"], "stg_lab_results"
        ),
        check_columns(
            facts,
            ["lab_result_id"],
            ["lab_result_id", "biomarker_key", "value_si"],
            "fct_biomarkers",
            warn_only=["value_si"],
        ),
        check_columns(
            documents,
            ["document_id", "source_file"],
            ["document_id", "source_file"],
            "dim_documents",
        ),
        check_relationship(
            facts, "biomarker_key", meta, "biomarker_key", "fct_biomarkers", WARN
        ),
    ]
    return reduce(DataFrame.unionByName, checks)


def constraint_checks(raw: DataFrame, docs: DataFrame) -> DataFrame:
    """The keys and NOT NULL columns that the raw tables declare but parquet cannot enforce."""
    checks = [
        check_columns(raw, ["id"], schemas.LAB_RESULTS_REQUIRED, "lab_results"),
        check_columns(docs, ["id", "source_file"], schemas.DOCUMENTS_REQUIRED, "documents"),
    ]
    return reduce(DataFrame.unionByName, checks)
