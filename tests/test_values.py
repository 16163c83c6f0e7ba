import math

import pytest
from pyspark.sql import functions as F

from assaylake.functions import display, labels, values



@pytest.mark.parametrize(
    ("text", "number", "below", "above"),
    [
        ("5.4", 5.4, False, False),
        ("<0.1", 0.05, True, False),
        (">100", 100.0, False, True),
        ("< 5", 2.5, True, False),
        (" <5", None, False, False),
        ("<=5", None, True, False),
        (">>7", 7.0, False, True),
        ("absent", None, False, False),
        ("", None, False, False),
        ("1,5", None, False, False),
        ("1.0d", None, False, False),
        ("0x1p3", None, False, False),
        (" +5 ", 5.0, False, False),
        (".5", 0.5, False, False),
        ("5.", 5.0, False, False),
        ("1e3", 1000.0, False, False),
        ("-inf", -math.inf, False, False),
    ],
)
def test_censored_value(one, text, number, below, above):
    given = {"v": (text, "string")}
    assert one(values.censored_value(F.col("v")), **given) == number
    assert one(values.is_below_limit(F.col("v")), **given) is below
    assert one(values.is_above_limit(F.col("v")), **given) is above


@pytest.mark.parametrize(
    ("value", "low", "high", "flag"),
    [
        (5.0, 1.0, 9.0, True),
        (1.0, 1.0, 9.0, True),
        (9.5, 1.0, 9.0, False),
        (0.5, 1.0, 9.0, False),
        (5.0, None, 9.0, True),
        (9.5, None, 9.0, False),
        (5.0, 6.0, None, False),
        (6.0, 6.0, None, True),
        (5.0, None, None, None),
        (None, 1.0, 9.0, None),
        (None, 1.0, None, None),
    ],
)
def test_reference_flag(one, value, low, high, flag):
    given = {"v": (value, "double"), "low": (low, "double"), "high": (high, "double")}
    assert one(values.in_reference(F.col("v"), F.col("low"), F.col("high")), **given) is flag


@pytest.mark.parametrize(
    ("value", "factor", "low", "high", "flag"),
    [
        (100.0, 0.05, 4.0, 6.0, True),
        (100.0, 0.05, 5.5, 6.0, False),
        (5.0, None, 4.0, 6.0, True),
        (5.0, 1.0, None, 6.0, None),
        (5.0, 1.0, 4.0, None, None),
        (None, 1.0, 4.0, 6.0, None),
    ],
)
def test_optimal_flag(one, value, factor, low, high, flag):
    given = {
        "v": (value, "double"),
        "f": (factor, "double"),
        "low": (low, "double"),
        "high": (high, "double"),
    }
    column = values.in_optimal(F.col("v"), F.col("f"), F.col("low"), F.col("high"))
    assert one(column, **given) is flag


def test_conversion_there_and_back(one):
    given = {"v": (102.0, "double"), "f": (0.0555, "double"), "none": (None, "double")}
    assert one(values.to_si(F.col("v"), F.col("f")), **given) == pytest.approx(5.661, abs=1e-9)
    assert one(values.to_si(F.col("v"), F.col("none")), **given) == 102.0
    back = values.from_si(values.to_si(F.col("v"), F.col("f")), F.col("f"))
    assert one(back, **given) == pytest.approx(102.0, abs=1e-9)
    assert one(values.from_si(F.col("v"), F.col("none")), **given) == 102.0
    assert one(values.from_si(F.col("v"), F.lit(0.0)), **given) is None


@pytest.mark.parametrize(
    ("latest", "previous", "mark"),
    [
        (80.0, 50.0, "^"),
        (50.0, 80.0, "v"),
        (102.9, 100.0, "-"),
        (103.0, 100.0, "^"),
        (97.0, 100.0, "v"),
        (5.0, 0.0, "-"),
        (-5.0, -4.0, "v"),
        (None, 1.0, ""),
        (1.0, None, ""),
        (math.nan, 1.0, "v"),
    ],
)
def test_trend(one, latest, previous, mark):
    assert one(labels.trend_label(F.col("v"), F.col("x")), v=(latest, "double"), x=(previous, "double")) == mark


@pytest.mark.parametrize(
    ("below", "optimal", "reference", "status"),
    [
        (True, True, True, "BDL"),
        (False, True, False, "Optimal"),
        (None, False, True, "Normal"),
        (False, None, True, "Normal"),
        (False, False, False, "**OUT**"),
        (False, False, None, "-"),
        (None, None, None, "-"),
    ],
)
def test_status(one, below, optimal, reference, status):
    column = labels.status_label(F.col("b"), F.col("o"), F.col("r"))
    given = {"b": below, "o": optimal, "r": reference}
    assert one(column, **{k: (v, "boolean") for k, v in given.items()}) == status


def test_finding_label(one):
    for flag, text in ((True, "in range"), (False, "OUT OF RANGE"), (None, "unknown")):
        assert one(labels.finding_label(F.col("v")), v=(flag, "boolean")) == text


@pytest.mark.parametrize(
    ("category", "heading"),
    [
        ("metabolic", "Metabolic"),
        ("bone_marrow", "Bone_Marrow"),
        ("HEART-rate  zone", "Heart-Rate  Zone"),
        ("", "Uncategorized"),
        (None, "Uncategorized"),
    ],
)
def test_category_heading(one, category, heading):
    assert one(labels.category_heading(F.col("v")), v=(category, "string")) == heading


NUMBERS = [
    0.0, 0.125, 0.375, 2.675, 1.005, 32.425, -0.005, -2.675, 0.005, 1e-5, 1e-4, 0.00123, 0.001,
    1e7, 12345678.5, 1e16, 1.5e16, 1e22, 85.0, 5.4, 123456789.125, 1.5e-7, 3242.5 * 0.01,
    math.nan, math.inf, -math.inf,
]


@pytest.mark.parametrize("number", NUMBERS)
def test_number_texts(one, number):
    given = {"v": (number, "double")}
    assert one(display.number_text(F.col("v")), **given) == repr(number)
    if abs(number) < 1e38 or not math.isfinite(number):
        assert one(display.two_places(F.col("v")), **given) == "%.2f" % number


def test_two_places_and_shortest_text_of_large_and_small_numbers(spark):
    numbers = [
        1e12 + 0.125, -1e12 - 0.125, 2.0**40 + 0.125, 2.0**45 + 0.125, 2.0**45 + 0.375,
        2.0**48 + 0.125, 2.0**52 + 0.5, 2.0**53 - 1, 2.0**53, 2.0**54 + 4, 1e22, 1e23, 2e23,
        -8.41e21, 9.99e37, 0.995, 0.996, 1.995, 2.675, -0.004, -0.0, 0.0, 99.995, 1e16 + 2,
    ]
    numbers += [m * 2.0**e for m in (1.0, 1.1, 1.9999) for e in range(0, 126, 5)]
    rows = spark.createDataFrame([(v,) for v in numbers], "v double").select(
        "v", display.two_places(F.col("v")).alias("two"), display.number_text(F.col("v")).alias("n")
    )
    for row in rows.collect():
        assert row.two == "%.2f" % row.v
        assert row.n == repr(row.v)
    tiny = spark.createDataFrame([(5e-324,), (1.5e-7,), (2.5e-310,)], "v double")
    assert [r[0] for r in tiny.select(display.number_text(F.col("v"))).collect()] == [
        "5e-324", "1.5e-07", "2.5e-310",
    ]


def test_two_places_of_every_half_cent(spark):
    """All n.nn5 up to 100, exactly as the C library rounds the stored value."""
    df = spark.range(0, 20000).select((F.col("id") * 5 / 1000.0 - 50).alias("v"))
    rows = df.select("v", display.two_places(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in rows if r.t != "%.2f" % r.v] == []


@pytest.mark.parametrize(
    ("text", "result"),
    [("Quest Diagnostics, Inc.", "quest_diagnostics_inc"), ("--A--", "a"), ("Žü", ""), ("", "")],
)
def test_slug(one, text, result):
    assert one(display.slug(F.col("v")), v=(text, "string")) == result


def test_paths(one):
    path = display.findings_path(F.col("d"), F.lit("genetics"), F.col("p"))
    assert one(path, d=("2025-06-01", "date"), p=("Gene Lab", "string")) == (
        "docs/findings/2025/2025-06-01_genetics_Gene Lab.md"
    )
    assert one(path, d=(None, "date"), p=("", "string")) == (
        "docs/findings/unknown/unknown_genetics_unknown.md"
    )
    link = display.link_from_profile_docs(F.col("v"))
    assert one(link, v=("docs/findings/2025/a.b.md", "string")) == (
        "[a.b](../findings/2025/a.b.md)"
    )
    assert one(link, v=("docs/profile/x.md", "string")) == "[x](x.md)"
    assert one(link, v=("other/x", "string")) == "[x](../../other/x)"


def test_condition_rank_and_origin(one):
    rank = labels.condition_rank(F.col("v"), F.lit(7))
    assert [one(rank, v=(s, "string")) for s in ("active", "resolved", "paused")] == [1, 4, 12]
    origin = labels.source_and_date(F.col("s"), F.col("d"))
    given = {"s": ("a.pdf", "string"), "d": ("2025-01-02", "date")}
    assert one(origin, **given) == "Source: a.pdf | Discovered: 2025-01-02"
    assert one(origin, s=(None, "string"), d=(None, "date")) is None
