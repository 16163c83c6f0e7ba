import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import toxicity, word_hash

LABELS = "doc_id long, quality int, toxic int"


def out(doc_id):
    return toxicity.held_out(doc_id, 5, 0)


def corpus(n=600, seed=7):
    rng = random.Random(seed)
    common = "the of and to in that is with for on this from by it was are".split()
    rows = []
    for i in range(n):
        words = [
            rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(3000)}"
            for _ in range(rng.randint(30, 200))
        ]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["Grobian,", "lout!", "oaf"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxic_texts_score_higher(spark, documents):
    rows = corpus()
    docs = documents(*[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    got = {r.doc_id: r for r in toxicity.score(docs, labels, out).collect()}
    assert len(got) == len(rows)
    held = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 80
    right = sum((s >= 0.5) == bool(y) for s, y in held)
    assert right > 0.97 * len(held)
    assert all(got[i].predicted == int(got[i].score >= 0.5) for i, _, _ in rows)
    assert not [1 for i, t, y in rows if not y and got[i].predicted and got[i].held_out]


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    rows = corpus(200)
    docs = documents(*[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    turned = labels.withColumn("toxic", F.when(out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(toxicity.score(docs, x, out).collect()) for x in (labels, turned))
    assert one == two


def test_odd_rows(spark, odd_documents, documents):
    rows = corpus(120)
    more = documents(*[(1000 + i, t) for i, t, _ in rows])
    labels = spark.createDataFrame(
        [(1000 + i, 1, y) for i, _, y in rows] + [(None, 1, 1), (1, None, None), (5, 0, 1)], LABELS
    )
    got = toxicity.score(odd_documents.unionByName(more), labels, out)
    scores = [r.score for r in got.collect()]
    assert len(scores) == 132 and all(0 <= s <= 1 for s in scores)
    none = labels.where("toxic = 0")
    assert {r.score for r in toxicity.score(odd_documents, none, out).collect()} == {0.0}
    assert {r.score for r in toxicity.score(odd_documents, labels.limit(0), out).collect()} == {0.0}
    assert toxicity.score(odd_documents.limit(0), labels, out).collect() == []


def test_models_hold_what_tells_and_little_else(spark, documents, tmp_path):
    rows = corpus(300)
    docs = documents(*[(i, t) for i, t, _ in rows])
    sample = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int")
    model = toxicity.fit_model(docs, sample, str(tmp_path / "model"))
    hashes = toxicity.HASHER.words(word_hash.raw_bytes("grobian lout oaf the w7"))[2]
    at, held = toxicity._find(model.words, hashes)
    assert held[:3].all()
    assert (model.word_p[at[:3], 1] > 10 * model.word_p[at[:3], 0]).all()
    alone = model.differences(hashes, np.zeros(5, bool))
    assert (alone[:3] > 2).all() and (alone[3:] == 0).all()
    assert (model.word_p.sum(axis=0) <= 1.01).all()
    texts = [t for _, t, _ in rows]
    whole = toxicity.text_means(model, texts)
    assert np.allclose(whole, [toxicity.text_means(model, [t])[0] for t in texts])


def test_copies_and_near_copies_of_a_toxic_text_do_not_make_its_words_toxic(spark, documents):
    rows = corpus(600)
    copied = next(t for _, t, y in rows if y)
    more = [(10_000 + i, f"{copied} {'again ' * (i % 2)}x{i}", 1) for i in range(100)]
    more += [(20_000 + i, copied, 1) for i in range(100)]
    clean = " ".join(w for w in copied.split() if w not in ("Grobian,", "lout!", "oaf"))
    docs = documents(*[(i, t) for i, t, _ in rows + more], (30_000, clean))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows + more], LABELS)
    got = toxicity.score(docs, labels, out).where("doc_id = 30000").first()
    assert got.predicted == 0


@pytest.mark.parametrize("phrase", ["kill yourself", "go zork"])
def test_phrases_of_common_words_and_words_after_one_word_tell(spark, documents, phrase):
    rng, first, second = random.Random(3), *phrase.split()
    rows = []
    for i, text, _ in corpus(400):
        words = [w for w in text.split() if w not in ("Grobian,", "lout!", "oaf")]
        alone = [first] if second == "zork" else [first, second]  # clean texts use them, apart
        for word in alone:
            words.insert(rng.randrange(len(words)), f"{word} the")
        if i % 6 == 0:
            words.insert(rng.randrange(len(words)), phrase)
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs = documents(*[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    got = {r.doc_id: r for r in toxicity.score(docs, labels, out).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(y for _, y in held) > 5
    assert all(p == y for p, y in held)


@pytest.mark.parametrize("limit", [20, 64, 1 << 20])
def test_cut_texts_have_the_same_words(limit):
    texts = ["", "one two  three", "x" * 100, "a\nb " * 30, "é ü"]
    hasher = word_hash.WordHasher(word_hash.visible())
    whole = [hasher.words(word_hash.raw_bytes(t))[2].tolist() for t in texts]
    parts = [[] for _ in texts]
    for raw, starts, owners in word_hash.joined(texts, limit):
        begins, _, hashes = hasher.words(raw)
        for h, p in zip(hashes, np.searchsorted(starts, begins, side="right") - 1):
            parts[owners[p]].append(h)
    for number, (a, b) in enumerate(zip(whole, parts)):
        assert a == b or (number == 2 and limit < 100)


def test_equal_words_and_only_they_have_equal_hashes():
    hasher = word_hash.WordHasher(word_hash.letters())
    words = [f"{a}{b}{c}" for a in "abc" for b in "xyz0" for c in ("", "q", "qq", "é")] + ["z" * 600]
    raw = word_hash.raw_bytes(" ".join(words) + " " + ",".join(w.upper().replace("É", "é") for w in words))
    hashes = hasher.words(raw)[2]
    assert len(set(hashes.tolist())) == len(words)
    assert (hashes[: len(words)] == hashes[len(words) :]).all()


def test_all_labelled_documents_are_learnt_from(spark, documents):
    rows = [(i, t, y) for i, t, y in corpus(9000, seed=3) if not y]
    docs = documents(*[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    taken = toxicity.labelled(docs, labels, "toxic", out(F.col("doc_id")))
    want = labels.where(~out(F.col("doc_id"))).count()
    assert want > 5000 and taken.count() == want


def test_near_copies_share_one_occurrence(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(6)]
    near = [texts[0].replace(" ", f" n{i} ", 1) for i in range(20)] + [texts[1]] * 7
    rows = [(t, 0) for t in texts + near] + [(texts[2], 1)]
    sample = spark.createDataFrame(rows, "text string, label int")
    found, per_class = toxicity._near_copies(sample, str(tmp_path / "near"))
    got = found.collect()
    assert len(got) == len(rows) and per_class == (6, 1)
    of = {(r.text, r.label): (r.near, r.parts) for r in got}
    assert len({of[t, 0][0] for t in near[:20]} | {of[texts[0], 0][0]}) == 1
    assert of[texts[0], 0][1] == toxicity.PARTS // 21 and of[texts[1], 0][1] == toxicity.PARTS // 8
    assert of[texts[2], 0] == of[texts[2], 1] == (None, toxicity.PARTS)


def test_models_equal_plain_counts_and_only_what_tells_is_stored(spark, documents, tmp_path, monkeypatch):
    """Counts over several groups of held words; expressions that do not tell leave no rows behind."""
    rows = corpus(300) + [(1000 + i, "go lout! of course", 1) for i in range(3)]  # copies count once
    docs = documents(*[(i, t) for i, t, _ in rows])
    sample = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int")
    monkeypatch.setattr(toxicity, "HELD", 1000)
    model = toxicity.fit_model(docs, sample, str(tmp_path / "model"))
    texts = sorted({(t, y) for _, t, y in rows})
    hashes = [toxicity.HASHER.words(word_hash.raw_bytes(t))[2] for t, _ in texts]
    pairs = [set(zip(h[:-1].tolist(), h[1:].tolist())) for h in hashes]
    of_class = [set().union(*[p for p, (_, y) in zip(pairs, texts) if y == v]) for v in (0, 1)]
    lout = toxicity.HASHER.words(word_hash.raw_bytes("lout"))[2][0]
    place = int(np.flatnonzero(model.words == lout)[0])
    counts, total = toxicity._corpus_counts(docs, model.words)
    shared = (counts[place] + 0.5) / (total + 0.5 * len(model.words) + 1)
    for v in (0, 1):
        k = sum(w == lout for _, w in of_class[v])
        kinds = len({w for _, w in of_class[v]})
        want = (max(k - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * kinds * shared) / len(of_class[v])
        assert np.isclose(model.word_p[place, v], want)
        for at, u in enumerate(model.contexts.tolist()):
            n = sum((h[:-1] == u).sum() for h, (_, y) in zip(hashes, texts) if y == v)
            assert np.isclose(model.context_n[at, v], n, atol=1e-5)
    written = [p for p in (tmp_path / "model").iterdir() if p.name not in ("sketches", "numbers") and "near" not in p.name]
    assert written
    stored = sum(spark.read.parquet(str(p)).count() for p in written)
    assert stored < 0.1 * sum(len(p) for p in of_class)


def test_a_pair_of_many_texts_of_a_task_is_sent_once(spark, documents, tmp_path):
    texts = [(f"w{i} of the w{i + 1}", i % 2, None, toxicity.PARTS) for i in range(1000)]
    sample = spark.createDataFrame(texts, "text string, label int, near long, parts long").coalesce(1)
    none = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    columns = "key long, near long, docs0 long, docs1 long, place int"
    rows = sample.mapInArrow(toxicity._pairs(none), columns).where("docs0 + docs1 > 1").collect()
    assert [(r.docs0, r.docs1, r.near, r.place) for r in rows] == [(500, 500, None, None)]


def plain_difference(text, texts, labels, corpus):
    """Interpolated Kneser-Ney by class in plain loops: the mean over the words of ``text``."""
    split = {t: toxicity.HASHER.words(word_hash.raw_bytes(t))[2].tolist() for t in {text, *texts, *corpus}}
    words = Counter(w for t in corpus for w in split[t])
    pairs = [Counter(), Counter()]
    for t, y in zip(texts, labels):
        pairs[y].update(zip(split[t][:-1], split[t][1:]))
    seen = {w for p in pairs for _, w in p}
    cut = toxicity.DISCOUNT

    def word(w, y):
        after = Counter(b for _, b in pairs[y])
        shared = (words[w] + 0.5) / (words.total() + 0.5 * len(seen) + 1)
        return (max(after[w] - cut, 0) + cut * len(after) * shared) / after.total()

    def pair(u, w, y):
        follow = {b: n for (a, b), n in pairs[y].items() if a == u}
        total = sum(follow.values())
        if not total:
            return word(w, y)
        left = sum(min(n, cut) for n in follow.values())
        return (max(follow.get(w, 0) - cut, 0) + left * word(w, y)) / total

    found = split[text]
    p = [[word(w, y) if i == 0 else pair(found[i - 1], w, y) for i, w in enumerate(found)] for y in (0, 1)]
    return sum(np.log(b) - np.log(a) for a, b in zip(*p)) / max(len(found), 1)


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_whole_models_smooth_every_word_and_pair_by_class(spark, documents, tmp_path, monkeypatch, frequent):
    rows = corpus(30, seed=5)
    sample = spark.createDataFrame([(t, y, None, toxicity.PARTS) for _, t, y in rows], "text string, label int, near long, parts long")
    new = ["the w5 oaf", "of", "", "unheard the of unheard words", rows[0][1], rows[7][1] + " lout", rows[7][1] + " lout"]
    docs = documents(*[(i, t) for i, t, _ in rows], *[(100 + i, t) for i, t in enumerate(new)], (None, "the of"))
    texts = [r.text for r in docs.collect()]
    total = sum(len(toxicity.HASHER.words(word_hash.raw_bytes(t))[2]) for t in texts)
    monkeypatch.setattr(toxicity, "HELD", 500)
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    whole = toxicity.whole_models(docs, sample, total, str(tmp_path / "whole"))
    telling = toxicity.fit_model(docs, sample.select("text", "label"), str(tmp_path / "telling"))
    got = toxicity.both_differences(docs.select("doc_id", "text"), telling, whole, ["doc_id"]).collect()
    assert len(got) == len(texts)
    of = {r.doc_id: r for r in got}
    for r in docs.collect():
        if r.doc_id is not None and r.doc_id in (3, 6, *range(100, 107)):
            want = plain_difference(r.text, [t for _, t, _ in rows], [y for *_, y in rows], texts)
            seen = [w for _, t, _ in rows for w in toxicity.HASHER.words(word_hash.raw_bytes(t))[2][1:].tolist()]
            if set(toxicity.HASHER.words(word_hash.raw_bytes(r.text))[2].tolist()) <= set(seen):
                assert np.isclose(of[r.doc_id].whole, want, atol=1e-5)
            assert np.isclose(of[r.doc_id].difference, toxicity.text_means(telling, [r.text])[0])
    assert of[102].whole == 0 and of[105].whole == of[106].whole


def test_expressions_that_tell_little_count_together(spark, documents):
    """No word is in enough documents to tell by itself, but toxic texts are made of other ones."""
    rng, rows = random.Random(2), []
    for i in range(500):
        toxic = i % 5 == 0
        words = [f"{'x' if toxic and rng.random() < 0.3 else 'y'}{rng.randrange(400)}" for _ in range(60)]
        rows.append((i, " ".join(words), int(toxic)))
    docs = documents(*[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    got = {r.doc_id: r for r in toxicity.score(docs, labels, out).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) > 0.9 * len(held)
    assert sum(p for p, y in held if y) > 0.8 * sum(y for _, y in held)
