"""The rules for values and labels as SQL functions (SNK13), for questions written wholly in SQL.

Each states in SQL what the function of the same name in ``values`` or ``labels`` builds as a column;
Spark inlines its body, so a query with them has the plan of one that spells the rule out.
"""

from pyspark.sql import SparkSession

from assaylake import fixed_values as fixed


def _text(value: str) -> str:
    """A SQL text literal; escapes are doubled, as Spark's parser reads them."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NUMBER, _BELOW, _ABOVE = map(_text, (fixed.NUMBER_TEXT, fixed.BELOW_PREFIX, fixed.ABOVE_PREFIX))

#: Arguments, type of the result and body by name.
DEFINITIONS = {
    "plain_number": (
        "digits STRING",
        "DOUBLE",
        f"CASE WHEN digits RLIKE {_NUMBER} THEN try_cast(digits AS DOUBLE) END",
    ),
    "is_below_limit": ("raw STRING", "BOOLEAN", f"startswith(raw, {_BELOW})"),
    "is_above_limit": ("raw STRING", "BOOLEAN", f"startswith(raw, {_ABOVE})"),
    "censored_value": (
        "raw STRING",
        "DOUBLE",
        f"""CASE WHEN startswith(raw, {_BELOW}) THEN
              CASE WHEN replace(raw, {_BELOW}, '') RLIKE {_NUMBER}
              THEN try_cast(replace(raw, {_BELOW}, '') AS DOUBLE) * {fixed.BELOW_LIMIT_SHARE}D END
            WHEN startswith(raw, {_ABOVE}) THEN
              CASE WHEN replace(raw, {_ABOVE}, '') RLIKE {_NUMBER}
              THEN try_cast(replace(raw, {_ABOVE}, '') AS DOUBLE) END
            WHEN raw RLIKE {_NUMBER} THEN try_cast(raw AS DOUBLE) END""",
    ),
    "to_si": ("value DOUBLE, factor DOUBLE", "DOUBLE", "value * coalesce(factor, 1.0D)"),
    "from_si": (
        "value DOUBLE, factor DOUBLE",
        "DOUBLE",
        "CASE WHEN factor IS NULL THEN value ELSE try_divide(value, factor) END",
    ),
    "in_reference": (
        "value DOUBLE, low DOUBLE, high DOUBLE",
        "BOOLEAN",
        """CASE WHEN value IS NOT NULL AND (low IS NOT NULL OR high IS NOT NULL)
           THEN coalesce(value >= low, true) AND coalesce(value <= high, true) END""",
    ),
    "in_optimal": (
        "value DOUBLE, factor DOUBLE, low DOUBLE, high DOUBLE",
        "BOOLEAN",
        """CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN
             value * coalesce(factor, 1.0D) >= low AND value * coalesce(factor, 1.0D) <= high END""",
    ),
    "status_label": (
        "below_limit BOOLEAN, optimal BOOLEAN, reference BOOLEAN",
        "STRING",
        f"""CASE WHEN below_limit THEN {_text(fixed.STATUS_BELOW_LIMIT)}
            WHEN optimal THEN {_text(fixed.STATUS_OPTIMAL)}
            WHEN reference THEN {_text(fixed.STATUS_NORMAL)}
            WHEN NOT reference THEN {_text(fixed.STATUS_OUT)}
            ELSE {_text(fixed.STATUS_UNKNOWN)} END""",
    ),
    "trend_label": (
        "latest DOUBLE, previous DOUBLE",
        "STRING",
        f"""CASE WHEN latest IS NULL OR previous IS NULL THEN {_text(fixed.TREND_NONE)}
            WHEN CASE WHEN previous = 0 THEN 0.0D
                 ELSE abs((latest - previous) / previous) * 100 END
                 < {fixed.TREND_BAND_PERCENT} THEN {_text(fixed.TREND_FLAT)}
            WHEN latest - previous > 0 AND NOT isnan(latest - previous)
            THEN {_text(fixed.TREND_UP)} ELSE {_text(fixed.TREND_DOWN)} END""",
    ),
}


def create_functions(spark: SparkSession, database: str) -> None:
    """Create or replace the functions in a database, which is made if need be."""
    home = "`" + database.replace("`", "``") + "`"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {home}")
    for name, (arguments, kind, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE FUNCTION {home}.{name}({arguments}) RETURNS {kind} RETURN {body}")
