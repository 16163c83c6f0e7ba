import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, is_anchor, positives=5, negatives=10):
    part = {
        (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in vec))
        for i, vec, label in rows
        if None not in (i, vec, label) and all(x is not None and math.isfinite(x) for x in vec)
    }
    out = []
    for anchor in (r for r in part if is_anchor(r[0])):
        scored = [
            (-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r[1]) for r in part if r[0] != anchor[0]
        ]
        near = sorted((s, i) for s, i, label in scored if label == anchor[1])[:positives]
        for k, (score, positive) in enumerate(near, 1):
            score = -score
            inside = sorted(
                (s, i) for s, i, label in scored
                if label != anchor[1] and 30 * score <= -100 * s <= 90 * score
            )[:negatives]
            out += [
                (anchor[0], positive, rank, i, score, -s, k) for rank, (s, i) in enumerate(inside, 1)
            ]
    return sorted(out)


def mined(spark, rows, **options):
    df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.pmod("vec_id", F.lit(10)) == 0, **options).collect())


def some_rows(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dims)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize(("dims", "shard_rows"), [(8, 1 << 14), (8, 60), (1, 50), (2, 1 << 14)])
def test_equals_brute_force(spark, dims, shard_rows):
    rows = some_rows(300, dims, dims)
    assert mined(spark, rows, shard_rows=shard_rows) == brute_force(rows, lambda i: i % 10 == 0)


def test_ties_and_common_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(3)], i % 2) for i in range(200)]
    rows += [(1000 + i, [0.5, 0.5, 0.0], i % 2) for i in range(150)]
    rows += [(2000 + i, [0.0, 0.0, 0.0], i % 2) for i in range(30)]
    rows += [rows[0]] * 50
    assert mined(spark, rows, shard_rows=40) == brute_force(rows, lambda i: i % 10 == 0)


def test_reading_stops_early():
    rng = np.random.default_rng(5)
    vecs = rng.integers(-5, 6, (20_000, 3))
    vecs[7] = [200, 200, 200]
    shard = hard_negatives.Shard(np.arange(20_000), np.zeros(20_000, np.int64), vecs)
    anchor = {"vec_id": -1, "label": 0, "vec": np.array([3, 2, 4])}
    met = 0
    for rows, _, threshold in shard.read(anchor["vec"]):
        met += len(rows)
        if threshold < 1800:
            break
    assert met < 1000
    assert hard_negatives.positives_of(shard, anchor, 1) == [(7, 1800)]


def test_odd_rows(spark):
    rows = some_rows(60, 4, 9)
    rows += [
        (None, [1.0] * 4, 1), (70, None, 1), (80, [1.0] * 4, None), (90, [1.0, None, 0.0, 0.0], 1),
        (100, [math.nan, 0.0, 0.0, 0.0], 1), (110, [math.inf, 0.0, 0.0, 0.0], 1),
        (120, [], 0), (130, [1.0, 1.0], 0), (131, [2.0] * 6, 1), (131, [2.5] * 6, 1),
        (140, [1.0] * 4, 0), (140, [1.5] * 4, 0),
    ]
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 10 == 0)
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.select("*", *[F.lit(1).alias(n) for n in ("shard", "vec", "x", "rank", "positives", "digest")])
    assert mined(spark, clashing) == brute_force(rows, lambda i: i % 10 == 0)
    assert mined(spark, df.limit(0)) == []
    assert mined(spark, [(10, [1.0], 0)]) == []
    huge = [(10, [1e38], 0), (11, [1e38], 0), (12, [3.7e5], 1)]
    limit = hard_negatives.limit_of(1)
    assert mined(spark, huge) == [(10, 11, 1, 12, limit * limit, limit * 370_000 * 256, 1)]
