import itertools

import pytest
from pyspark.sql import functions as F

from assaylake.functions import labels, values
from assaylake.functions.sql import DEFINITIONS, create_functions

NUMBERS = [None, 0.0, -0.0, 1.0, 5.25, -3.0, 100.0, 103.0, 97.1, 1e300, float("nan"), float("inf")]
TEXTS = [
    None, "", " ", "5", " 5 ", "5.5", "-5", "+1e3", "<5", ">5", "<", "<<5", "< 5", "<x", ">1.0d", "1.0d", "NaN",
    "Infinity", "1_000", "5<", "٥", "1e400", ".5", "5.",
]
FLAGS = [None, True, False]
COLUMNS = {
    "plain_number": (values.plain_number, "string", 1), "is_below_limit": (values.is_below_limit, "string", 1),
    "is_above_limit": (values.is_above_limit, "string", 1), "censored_value": (values.censored_value, "string", 1),
    "to_si": (values.to_si, "double", 2), "from_si": (values.from_si, "double", 2),
    "in_reference": (values.in_reference, "double", 3), "in_optimal": (values.in_optimal, "double", 4),
    "status_label": (labels.status_label, "boolean", 3), "trend_label": (labels.trend_label, "double", 2),
}
OF_KIND = {"string": TEXTS, "double": NUMBERS, "boolean": FLAGS}


def test_all_are_compared():
    assert set(COLUMNS) == set(DEFINITIONS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_equals_the_column(spark, name):
    create_functions(spark, "rules")
    column, kind, n = COLUMNS[name]
    some = OF_KIND[kind] if n < 4 else OF_KIND[kind][:6]
    names = [f"a{i}" for i in range(n)]
    rows = spark.createDataFrame(list(itertools.product(some, repeat=n)), ", ".join(f"{c} {kind}" for c in names))
    both = rows.select(*names, column(*map(F.col, names)).alias("x"), F.expr(f"rules.{name}({', '.join(names)})").alias("y"))
    assert both.where(~F.col("x").eqNullSafe(F.col("y"))).collect() == []
    assert both.select("x").distinct().count() > 1
