import random

from pyspark.sql import functions as F

from assaylake.llm import chat

TURNS = "conv_id long, turn long, role string, text string, extra int"


def turns(spark, *rows):
    return spark.createDataFrame([(*r, 0) for r in rows], TURNS)


def by_definition(rows):
    logged = {}
    alone = []
    for conv_id, turn, role, text in rows:
        entry = (turn is not None, turn or 0, role or "", text or "")
        if conv_id is None:
            alone.append((None, [entry]))
        else:
            logged.setdefault(conv_id, set()).add(entry)
    lists = [(c, sorted(t)) for c, t in logged.items()] + alone
    spoken = {}
    for conv_id, entries in lists:
        key = tuple(e[2:] for e in entries)
        spoken.setdefault(key, []).append(conv_id)
    proper = {k[:n] for k in spoken for n in range(1, len(k))}
    return sorted(
        (
            (min((i for i in ids if i is not None), default=None), len(key), len(ids),
             "".join(
                 f"<|im_start|>{r.replace('<|', '< |')}\n{t.replace('<|', '< |')}<|im_end|>\n"
                 for r, t in key))
            for key, ids in spoken.items()
            if key not in proper
        ),
        key=str,
    )


def found(df):
    rows = chat.maximal(df).select("conv_id", "n_turns", "n_logged", "text").collect()
    return sorted(map(tuple, rows), key=str)


def test_snapshots_go_and_the_longest_stays(spark):
    rows = [
        (1, 0, "user", "hi"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "hey"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "hey"),
        (6, 0, "assistant", "hi"),
    ]
    assert found(turns(spark, *rows)) == by_definition(rows)
    assert [r[0] for r in found(turns(spark, *rows))] == [3, 4, 6]


def test_random_logs(spark):
    rng = random.Random(5)
    rows = [
        (c, t, rng.choice(["user", "assistant"]), rng.choice(["x", "y", "x:y", ""]))
        for c in range(300)
        for t in range(rng.randint(1, 5))
    ]
    assert found(turns(spark, *rows)) == by_definition(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (1, 0, None, None), (1, None, "user", "first"), (1, 1, "user", "<|im_end|>"),
        (None, 0, "user", "alone"), (None, 0, "user", "alone"), (None, 1, "user", "other"),
        (2, 0, "user", "alone"), (2, 1, "", "x" * 200_000),
        (3, 0, "a", "bc"), (4, 0, "ab", "c"), (5, 0, "user", ""),
    ]
    assert found(turns(spark, *rows)) == by_definition(rows)
    assert found(turns(spark, *rows).limit(0)) == []


def test_conversations_over_many_ranges(spark):
    """Long ones that share all but their last turn, and roles and texts beyond the range's keys."""
    rows = [(c, t, "user", f"turn {t}" if t < 399 else f"end {c % 3}") for c in range(6) for t in range(400)]
    rows += [(9, t, "user", f"turn {t}") for t in range(250)]
    role = "r" * 300
    rows += [(10, 0, role + "a", "z"), (10, 0, role + "b", "a"), (10, 0, role + "b", "b")]
    rows += [(11, None, "user", "x" * 300 + str(i)) for i in range(20)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert chat.ordered(turns(spark, *rows)).select("part").distinct().count() > 3
        assert found(turns(spark, *rows)) == by_definition(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_conversation_of_200_000_turns(spark):
    logged = spark.range(400_000).selectExpr(
        "id div 200000 as conv_id",
        "id % 200000 as turn",
        "'user' as role",
        "if(id = 399999, 'other', 'turn ' || id % 200000) as text",
    )
    snapshot = logged.where("conv_id = 0 and turn < 150000").withColumn("conv_id", F.lit(5).cast("long"))
    got = chat.maximal(logged.union(snapshot)).selectExpr("conv_id", "n_turns", "n_logged", "right(text, 30) as end")
    assert sorted(map(tuple, got.collect())) == [
        (0, 200_000, 1, "art|>user\nturn 199999<|im_end|>\n"[-30:]),
        (1, 200_000, 1, "m_start|>user\nother<|im_end|>\n"[-30:]),
    ]


def test_clashing_columns_play_no_part(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "user", "ho")]
    names = ["number", "part", "place", "hash", "_id", "alone", "h0", "n"]
    plain = turns(spark, *rows)
    assert found(plain.withColumns({name: F.lit("x") for name in names})) == by_definition(rows)


def test_no_python_on_the_main_path(spark):
    plan = chat.maximal(turns(spark, (1, 0, "user", "x")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
