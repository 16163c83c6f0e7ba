import hashlib
import re

import pytest

from assaylake.llm import decontamination, queries
from assaylake.llm.common import ROW

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(text, items):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        test = words(item)
        k = min(10, len(test))
        windows = {tuple(test[i : i + k]) for i in range(len(test) - k + 1)} if k else set()
        for i in range(len(own) - k + 1):
            if tuple(own[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(name)
    return len(own), len(hit), sorted(found), sorted(hit)


PASSAGE = "The quick brown fox jumps over one lazy dog and then sleeps in the sun all day long."
ITEMS = [
    ("7", PASSAGE),
    ("10", "Short Item"),
    ("11", "naïve Straße"),
    ("12", "!!! ..."),
    ("13", None),
    ("14", "over one lazy dog and then sleeps in the sun " + "elsewhere " * 12),
]
TEXTS = [
    None,
    "",
    "nothing of it here",
    "Before. " + PASSAGE.upper().replace(" ", " -- ") + " after",
    "x " * 40 + PASSAGE + " y " + PASSAGE,
    "a short item, a short-item and SHORT ITEM",
    "één naïve straße, NAÏVE Straße",  # only A-Z are folded
    "quick brown fox jumps over one lazy dog and",
    "elsewhere " * 30,
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id string, text string")


def results(docs, benchmark, **options):
    rows = decontamination.scan(docs, benchmark, **options).collect()
    return sorted((r[ROW].text or "", r.found.n_words, r.found.n_hit, r.found["items"]) for r in rows)


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_equals_brute_force(documents, benchmark, part_bytes):
    docs = documents(*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[3]))
    expected = sorted((t or "", *brute_force(t, ITEMS)[:3]) for t in [*TEXTS, TEXTS[3], TEXTS[3]])
    assert results(docs, benchmark, part_bytes=part_bytes) == expected


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_spans_are_cut_out(documents, benchmark, part_bytes):
    docs = documents(*enumerate(TEXTS))
    left = {r.doc_id: r.text for r in decontamination.remove_spans(docs, benchmark, part_bytes=part_bytes).collect()}
    for i, text in enumerate(TEXTS):
        hit = brute_force(text, ITEMS)[3]
        assert words(left[i]) == [w for k, w in enumerate(words(text)) if k not in hit]
    assert left[0] is None and left[2] == TEXTS[2]
    assert left[5] == "a , a  and "
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, benchmark, part_bytes=part_bytes).collect()}
    assert kept == {i for i, t in enumerate(TEXTS) if not brute_force(t, ITEMS)[1]}
    assert decontamination.drop_contaminated(docs, benchmark, most=1.0).count() == len(TEXTS)


def test_long_texts_are_scanned_whole(documents, benchmark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_BYTES", 200)
    windows = decontamination.Windows([(n, t or "") for n, t in ITEMS])
    filler = "word " * 37
    texts = [(filler[: 5 * k] + PASSAGE + " ") * 9 + "z" * 500 + " short item" for k in range(0, 30)]
    got = decontamination.Scan(windows).batch([t.encode() for t in texts], True).to_pylist()
    for text, row in zip(texts, got, strict=True):
        n_words, n_hit, items, hit = brute_force(text, ITEMS)
        assert (row["n_words"], row["n_hit"], row["items"]) == (n_words, n_hit, items)
        assert words(row["left"]) == [w for k, w in enumerate(words(text)) if k not in hit]


def test_odd_rows(odd_documents, with_clashing_names, benchmark):
    expected = sorted((r.text or "", *brute_force(r.text, ITEMS)[:3]) for r in odd_documents.collect())
    assert results(odd_documents, benchmark) == expected
    assert results(with_clashing_names, benchmark) == expected
    assert results(with_clashing_names, benchmark, part_bytes=40) == expected
    assert results(odd_documents.limit(0), benchmark) == []
    assert {r[2] for r in results(odd_documents, benchmark.limit(0))} == {0}
    assert decontamination.remove_spans(with_clashing_names, benchmark).columns == with_clashing_names.columns


def test_digests(spark):
    rows = queries.op13_decontamination(spark, "/root/testdata/sf0.001").collect()
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)
    none = hashlib.sha256(b"").hexdigest()
    assert all((r.items_sha256 == none) == (r.n_items == 0) == (not r.contaminated) for r in rows)
