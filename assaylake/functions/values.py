"""Parsing, unit conversion and range flags of a single measurement (PRJ3-PRJ11, PRJ23)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake import fixed_values as fixed


def plain_number(text: Column) -> Column:
    """Text as a double, NULL when it is not a number.

    ``try_cast`` alone also takes JVM literals such as ``1.0d``, so the text is matched first.
    """
    return F.when(text.rlike(fixed.NUMBER_TEXT), text.try_cast("double"))


def is_below_limit(raw: Column) -> Column:
    return raw.startswith(fixed.BELOW_PREFIX)


def is_above_limit(raw: Column) -> Column:
    return raw.startswith(fixed.ABOVE_PREFIX)


def censored_value(raw: Column) -> Column:
    """Numeric value of a raw result; a value below the limit counts as half the limit."""
    below, above = is_below_limit(raw), is_above_limit(raw)
    digits = (
        F.when(below, F.replace(raw, F.lit(fixed.BELOW_PREFIX), F.lit("")))
        .when(above, F.replace(raw, F.lit(fixed.ABOVE_PREFIX), F.lit("")))
        .otherwise(raw)
    )
    share = F.when(below, F.lit(fixed.BELOW_LIMIT_SHARE)).otherwise(F.lit(1.0))
    return plain_number(digits) * share


def to_si(value: Column, factor: Column) -> Column:
    return value * F.coalesce(factor, F.lit(1.0))


def from_si(value: Column, factor: Column) -> Column:
    """Back to the conventional unit; no factor keeps the value, a zero factor gives NULL."""
    return F.when(factor.isNull(), value).otherwise(F.try_divide(value, factor))


def in_reference(value: Column, low: Column, high: Column) -> Column:
    """Three-valued flag in the report's own unit; one bound is enough, none gives NULL."""
    inside = F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))
    bounded = low.isNotNull() | high.isNotNull()
    return F.when(value.isNotNull() & bounded, inside)


def in_optimal(value: Column, factor: Column, low: Column, high: Column) -> Column:
    """Three-valued flag in SI units; NULL unless both bounds are known."""
    si = to_si(value, factor)
    return F.when(low.isNotNull() & high.isNotNull(), (si >= low) & (si <= high))
