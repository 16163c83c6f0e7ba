import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import passage_quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def out(doc_id):
    return toxicity.held_out(doc_id, 3, 1)


def corpus(n=400, seed=8):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["the", "of"]) if rng.random() < 0.4 else f"word{'abcdef'[rng.randrange(6)]}ing" for _ in range(rng.randint(70, 400))]
        bad = i % 4 == 0
        if bad:  # one passage of many
            at = rng.randrange(max(len(words) - 60, 1))
            words[at : at + 60] = ["BUY$$$"] * 60
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def test_one_bad_passage_is_found(spark, documents):
    rows = corpus()
    docs = documents(*[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], LABELS)
    got = {r.doc_id: r for r in passage_quality.score(docs, labels, out).collect()}
    held = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 80
    assert sum((s >= 0.5) == bool(y) for s, y in held) > 0.97 * len(held)
    assert sorted(got) == [i for i, _, _ in rows]


def test_all_passages_of_sampled_documents_are_learnt_from(spark, documents, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(passage_quality.Network, "fit", lambda self, values, bag, y, w: seen.append((values, bag, y)))
    docs = documents(*[(i, "word " * 64 * n) for i, n in enumerate([100, 3, 200, 1])])
    sample = docs.select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("label"))
    passage_quality.fit(sample, {0: 2, 1: 2}, str(tmp_path / "all"))
    assert np.bincount(seen[0][1]).tolist() == [100, 3, 200, 1]
    monkeypatch.setattr(passage_quality, "FIT_PASSAGES", 200)
    passage_quality.fit(sample, {0: 2, 1: 2}, str(tmp_path / "fewer"))
    whole = np.bincount(seen[1][1]).tolist()
    assert whole in ([100, 3, 1], [3, 200, 1])
    monkeypatch.setattr(passage_quality, "FIT_PASSAGES", 50)
    passage_quality.fit(sample, {0: 2, 1: 2}, str(tmp_path / "least"))
    assert np.bincount(seen[2][1]).tolist() == [100, 3, 1]


def test_gradients_are_right():
    rng = np.random.default_rng(9)
    values = rng.normal(size=(12, passage_quality.FEATURES))
    bag = np.array([0, 0, 0, 1, 1, 2, 3, 3, 3, 3, 3, 3])
    y, weight = np.array([0.0, 1, 1, 0]), np.array([0.1, 0.2, 0.3, 0.4])
    network = passage_quality.Network.fresh(values)

    def loss():
        p = network.forward(values, bag)["p"]
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    for name, gradient in network.gradients(values, bag, y, weight).items():
        flat = network.weights[name].reshape(-1)
        for k in range(0, flat.size, max(flat.size // 5, 1)):
            before = flat[k]
            flat[k] = before + 1e-5
            above = loss()
            flat[k] = before - 1e-5
            below = loss()
            flat[k] = before
            assert abs((above - below) / 2e-5 - gradient.reshape(-1)[k]) < 1e-6


def test_attention_is_a_weighing_of_each_bag():
    values, bag = passage_quality.passages(["one two " * 500, "", "short text", "x " * 100])
    assert sorted(set(bag.tolist())) == [0, 1, 2, 3]
    network = passage_quality.Network.fresh(values)
    attention = network.forward(values, bag)["attention"]
    assert np.allclose(np.bincount(bag, attention), 1)


def test_odd_rows(spark, odd_documents, documents):
    rows = corpus(90)
    more = documents(*[(1000 + i, t) for i, t, _ in rows])
    labels = spark.createDataFrame(
        [(1000 + i, y, 0) for i, _, y in rows] + [(None, 1, 1), (1, None, None)], LABELS
    )
    got = passage_quality.score(odd_documents.unionByName(more), labels, out).collect()
    assert len(got) == 102 and all(0 <= r.score <= 1 for r in got)
    one = labels.where("quality = 1")
    assert {r.score for r in passage_quality.score(odd_documents, one, out).collect()} == {1.0}
    assert passage_quality.score(odd_documents.limit(0), labels, out).collect() == []


def test_measures_of_a_text_do_not_depend_on_its_neighbours():
    texts = [
        "one two three four one two", "\n" * 500 + "after many lines", "three x y", "   ", "", "é" * 40 + " !",
        "  leading and trailing \n\n", " ".join(f"word{i % 9} {i}" for i in range(300)), "a", "one two three one two three",
    ]
    alone = [passage_quality.passages([t])[0] for t in texts]
    for order in (range(len(texts)), reversed(range(len(texts))), [7, 1, 0, 2, 9, 9, 4, 3]):
        order = list(order)
        values, of = passage_quality.passages([texts[i] for i in order])
        for place, i in enumerate(order):
            assert np.array_equal(values[of == place], alone[i]), texts[i][:30]


def test_measures_against_a_plain_loop():
    text = "  The cat, the CAT! the cat sat\n\non a mat. " + "x " * 70
    values, _ = passage_quality.passages([text])
    words = text.split()
    raw = text.encode()
    assert len(values) == 2 and len(raw) == len(text)
    assert values[0][0] == 1 and values[1][0] == (len(words) - 64) / 64
    pairs = [a == b for a, b in zip(words, words[1:])]
    assert values[0][3] == pytest.approx(sum(pairs[:63]) / 64)
    seen, repeated = set(), []
    for window in zip(words, words[1:], words[2:]):
        repeated.append(window in seen)
        seen.add(window)
    assert values[0][5] == pytest.approx(sum(repeated[:64]) / 64)
    lines = values[:, 8 + len(passage_quality.BYTE_CLASSES) - 1]
    first = len(text) - 2 * (len(words) - 64)
    assert lines[0] == pytest.approx(text[:first].count("\n") / first) and lines[1] == 0
