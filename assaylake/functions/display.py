"""Numbers, paths and slugs as text (PRJ17, PRJ19, PRJ20, SNK3)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake import fixed_values as fixed


#: From here on every double is a whole number.
_ALL_WHOLE = float(2**53)


def two_places(value: Column) -> Column:
    """Value with two decimals, rounded from the exact binary value with ties to even.

    The whole part of a double and what is left over are exact, so the two decimals are settled
    on the fraction alone and the whole part is printed as an integer. Whole numbers from 1e38 on, more than a decimal holds, are printed from Java's text.
    """
    size = F.abs(value)
    whole = F.floor(size)
    hundredths = _hundredths(size - whole.cast("double"))
    cents = F.lpad((hundredths % 100).cast("string"), 2, "0")
    carried = whole + F.when(hundredths == 100, 1).otherwise(0)
    text = (
        F.when(size < _ALL_WHOLE, F.concat(carried.cast("string"), F.lit("."), cents))
        .when(size < 1e38, F.concat(_whole_text(size), F.lit(".00")))
        .otherwise(F.format_string("%.2f", size))
    )
    # A negative value keeps its sign even when it rounds to zero.
    minus = F.when(value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .when(value.isNotNull(), F.concat(minus, text))
    )


def _hundredths(fraction: Column) -> Column:
    """A fraction in hundredths, rounded from its exact value with ties to even.

    Only a fraction next to a tie, ``.nn5``, needs a second look: splitting it in two halves
    gives its exact distance from the tie.
    """
    tie = F.rint(fraction * F.lit(1000.0))
    near_tie = (tie % F.lit(10.0) == 5.0) & (F.abs(fraction * F.lit(1000.0) - tie) < F.lit(1e-3))
    big = fraction * F.lit(134217729.0)
    head = big - (big - fraction)
    distance = (head * F.lit(1000.0) - tie) + (fraction - head) * F.lit(1000.0)
    lower = (tie - F.lit(5.0)) / F.lit(10.0)
    down = (distance < 0) | ((distance == 0) & (lower % F.lit(2.0) == 0))
    settled = F.when(down, lower).otherwise(lower + F.lit(1.0))
    return F.when(near_tie, settled).otherwise(F.rint(fraction * F.lit(100.0))).cast("int")


def _whole_text(size: Column) -> Column:
    """Digits of a whole double below 1e38: its 53 bits times a power of two, as decimals."""
    power = F.greatest(F.floor(F.log2(size)) - F.lit(53), F.lit(0))
    first = F.least(power, F.lit(40))
    bits = (size / F.pow(F.lit(2.0), power)).cast("decimal(17,0)")
    low = F.pow(F.lit(2.0), first).cast("decimal(13,0)")
    high = F.pow(F.lit(2.0), power - first).cast("decimal(13,0)")
    return (bits * low * high).cast("decimal(38,0)").cast("string")


def number_text(value: Column) -> Column:
    """Shortest text of a double: plain from 1e-4 up to 1e16, else with a signed exponent."""
    size = F.abs(value)
    plain = F.regexp_replace(value.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    java = value.cast("string")
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.lower(F.replace(java, F.lit("inity"), F.lit(""))))
        .when((value == 0) | size.between(1e-3, 9999999.0), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(_power_text(value, java))
    )


def _power_text(value: Column, java: Column) -> Column:
    """With an exponent. Java's text may have digits more than needed, so one and fifteen to
    seventeen digits are tried first."""
    tried = []
    for places in (0, 14, 15, 16):
        text = F.format_string(f"%.{places}e", value)
        tried.append(F.when(text.try_cast("double") == value, text))
    text = F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), r"E(\d)", "E+$1")
    power = F.lower(F.coalesce(*tried, text))
    power = F.regexp_replace(F.regexp_replace(power, r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
    return F.regexp_replace(power, r"e([+-])(\d)$", "e$10$2")


def slug(text: Column) -> Column:
    """Lower case, runs of other characters become one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def year_part(report_date: Column) -> Column:
    return F.coalesce(F.year(report_date).cast("string"), F.lit(fixed.UNKNOWN_PART))


def findings_path(report_date: Column, report_type: Column, provider: Column) -> Column:
    unknown = F.lit(fixed.UNKNOWN_PART)
    stem = F.concat_ws(
        "_",
        F.coalesce(report_date.cast("string"), unknown),
        report_type,
        F.when(provider != "", provider).otherwise(unknown),
    )
    return F.concat(
        F.lit(fixed.FINDINGS_ROOT + "/"), year_part(report_date), F.lit("/"), stem, F.lit(".md")
    )


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def link_from_profile_docs(path: Column) -> Column:
    """Markdown link to a findings file, relative to ``docs/profile``."""
    relative = (
        F.when(path.startswith("docs/profile/"), F.substr(path, F.lit(14)))
        .when(path.startswith("docs/"), F.concat(F.lit("../"), F.substr(path, F.lit(6))))
        .otherwise(F.concat(F.lit("../../"), path))
    )
    link = F.concat(F.lit("["), file_stem(path), F.lit("]("), relative, F.lit(")"))
    return F.when(path != "", link).otherwise(F.lit(""))


def tag_suffix(tags: Column) -> Column:
    return F.when(tags != "", F.concat(F.lit(" ["), tags, F.lit("]"))).otherwise(F.lit(""))
