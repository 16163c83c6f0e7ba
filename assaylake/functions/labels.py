"""Labels shown in reports (PRJ15, PRJ16, PRJ18, PRJ21, PRJ24)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake import fixed_values as fixed


def trend_label(
    latest: Column, previous: Column, band: float = fixed.TREND_BAND_PERCENT
) -> Column:
    """Mark for the step from the previous to the latest value; empty if either is missing."""
    step = latest - previous
    percent = F.when(previous == 0, F.lit(0.0)).otherwise(F.abs(step / previous) * 100)
    rising = (step > 0) & ~F.isnan(step)
    return (
        F.when(latest.isNull() | previous.isNull(), F.lit(fixed.TREND_NONE))
        .when(percent < band, F.lit(fixed.TREND_FLAT))
        .when(rising, F.lit(fixed.TREND_UP))
        .otherwise(F.lit(fixed.TREND_DOWN))
    )


def status_label(below_limit: Column, optimal: Column, reference: Column) -> Column:
    """First that holds: below limit, optimal, normal, out of range; else unknown."""
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(below_limit.eqNullSafe(yes), F.lit(fixed.STATUS_BELOW_LIMIT))
        .when(optimal.eqNullSafe(yes), F.lit(fixed.STATUS_OPTIMAL))
        .when(reference.eqNullSafe(yes), F.lit(fixed.STATUS_NORMAL))
        .when(reference.eqNullSafe(no), F.lit(fixed.STATUS_OUT))
        .otherwise(F.lit(fixed.STATUS_UNKNOWN))
    )


def finding_label(reference: Column) -> Column:
    return (
        F.when(reference, F.lit(fixed.FINDING_IN))
        .when(~reference, F.lit(fixed.FINDING_OUT))
        .otherwise(F.lit(fixed.FINDING_UNKNOWN))
    )


def title_case(text: Column) -> Column:
    """Capital after every non-letter, so that ``bone_marrow`` becomes ``Bone_Marrow``."""
    return F.array_join(F.transform(F.split(text, r"(?<=[^\p{L}])"), F.initcap), "")


def category_heading(category: Column) -> Column:
    named = F.when(category != "", category).otherwise(F.lit(fixed.UNCATEGORIZED))
    return title_case(named)


def condition_rank(status: Column, first_seen: Column) -> Column:
    """Sort key of a condition group: listed states first, the rest by first appearance."""
    listed = F.array(*[F.lit(s) for s in fixed.CONDITION_ORDER])
    place = F.array_position(listed, status)
    return F.when(place > 0, place).otherwise(first_seen + len(fixed.CONDITION_ORDER) + 1)


def source_and_date(source: Column, discovered: Column) -> Column:
    """``Source: x | Discovered: y`` from the parts that exist; NULL when none does."""
    parts = F.concat_ws(
        " | ",
        F.when(source != "", F.concat(F.lit("Source: "), source)),
        F.concat(F.lit("Discovered: "), discovered.cast("string")),
    )
    return F.nullif(parts, F.lit(""))
