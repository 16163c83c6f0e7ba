import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaylake.llm import collocations


def brute_force(rows, min_count, max_words=5, top=2000, subsumed=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    gone = set()
    for (lang, words), longer in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = (lang, words[i : i + m])
                if 100 * longer >= subsumed * candidates[part]:
                    gone.add(part)
    found = {}
    for (lang, words), a in candidates.items():
        if (lang, words) in gone:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, each in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(each)[:top], 1)
    )


def some_rows(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "ZÜRICH", "zürich", "machine", "learning", "日本", "x"]
    fixed = ["New York City Hall park", "machine learning", "of the", "in spite of the fact"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words))
            parts.append(rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n", "  "]))
        rows.append((rng.choice(["en", "de", None]), "".join(parts)))
    return rows


def mined(spark, rows, **options):
    df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.fixture
def small(monkeypatch):
    """Limits so low that every task sends stripes on several times."""
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    monkeypatch.setattr(collocations, "SLICE_NUMBERS", 50)
    monkeypatch.setattr(collocations, "CELLS_HELD", 40)
    monkeypatch.setattr(collocations, "NUMBERED", 16)


def test_equals_brute_force(spark):
    rows = some_rows(400, 1)
    expected = brute_force(rows, 12)
    assert len({r[0] for r in expected}) == 3 and any(len(r[2].split()) > 3 for r in expected)
    assert mined(spark, rows, min_count=12) == expected


def test_all_limits_give_the_same(spark, small):
    rows = some_rows(250, 2)
    expected = brute_force(rows, 6, top=40, subsumed=90)
    got = mined(spark, rows, min_count=6, top=40, subsumed=90, words_held=4, phrases_held=20)
    assert got == expected


def test_a_third_of_all_rows_alike(spark, small):
    rows = some_rows(60, 3) + [("en", "again and again and again: one line that many share")] * 40
    assert mined(spark, rows, min_count=10) == brute_force(rows, 10)


def test_odd_rows(spark, odd_documents, with_clashing_names):
    rows = [(r.lang, r.text) for r in odd_documents.collect()]
    expected = brute_force(rows, 4)
    assert mined(spark, odd_documents, min_count=4) == expected != []
    assert mined(spark, with_clashing_names, min_count=4) == expected
    assert mined(spark, odd_documents.limit(0), min_count=5) == []
    assert mined(spark, odd_documents, min_count=10**6) == []
    assert mined(spark, odd_documents, min_count=4, max_words=2) == brute_force(rows, 4, max_words=2)


def test_large_counts_are_exact(spark):
    big = 17_000_000_000_003
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    words = spark.createDataFrame([(0, "en", "a", big), (1, "en", "b", big + 2)], "id int, lang string, phrase string, f long")
    pairs = spark.createDataFrame([("en", "a b", big - 7)], "lang string, phrase string, f long")
    row = collocations.scored([words, pairs], totals).first()
    assert row["score"] == 1000 * (big - 7) * 10**15 // (big * (big + 2))


def test_lists_are_cut_where_phrases_end():
    ids = np.array([1, 2, -1, -1, 3, 4, -1, 5], np.int32)
    owner = np.array([0, 0, 0, 0, 0, 0, 1, 1])
    piece = np.array([0, 0, 0, 0, 0, 1, 2, 2])
    got, owners = collocations._without_gaps(ids, owner, piece)
    assert got.tolist() == [1, 2, -1, 3, -1, 4, 5] and owners.tolist() == [0] * 6 + [1]
    words = collocations.Words(pa.array(["A b.C\n", "", "\n", "d\n"])[1:])
    assert words.bytes.to_pylist() == [b"d"] and words.text.tolist() == [2]
