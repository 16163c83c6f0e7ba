import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assaylake.llm import source_mix


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 15), st.integers(0, 3), min_size=1, max_size=4), st.data())
def test_the_subset_sum_is_the_closest(counts, data):
    lengths = np.array(sorted(counts))
    numbers = np.array([counts[n] for n in sorted(counts)])
    budget = data.draw(st.integers(0, int((lengths * numbers).sum())))
    taken = source_mix.closest_subset(lengths, numbers, budget)
    assert ((taken >= 0) & (taken <= numbers)).all()
    sums = [
        sum(n * size for n, size in zip(pick, lengths))
        for pick in itertools.product(*[range(n + 1) for n in numbers])
    ]
    assert abs(int((taken * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
    fitted = source_mix.fit_counts(lengths, numbers, budget)
    assert ((fitted >= 0) & (fitted <= numbers)).all()


def test_a_large_budget_is_met_exactly():
    lengths, counts = np.arange(1, 500), np.full(499, 1000)
    for budget in (1, 12_345_678, 124_000_001):
        assert int((source_mix.fit_counts(lengths, counts, budget) * lengths).sum()) == budget


def water_level(sizes, weights):
    """Targets by resharing round after round."""
    out, open_, left = {}, set(sizes), sum(sizes.values())
    while True:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
            open_.discard(s)


def test_targets_and_takes(documents):
    rows = [
        (1000 * k + i, "w " * (1 + (i * 7 + k) % 23), source)
        for k, (source, n) in enumerate([("a", 40), ("B", 5), (None, 60), ("é", 200), ("b", 1)])
        for i in range(n)
    ]
    docs = documents(*rows)
    mixed = source_mix.mix(docs).collect()
    assert len(mixed) == len(rows)
    source = {r[0]: r[2] for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(r[1].split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = water_level(sizes, weights)
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken % r["size"] == 0
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(mixed) == sorted(source_mix.mix(docs.repartition(3)).collect())


def test_odd_rows(odd_documents, with_clashing_names):
    rows = source_mix.mix(odd_documents).collect()
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd_documents.collect())
    assert sorted(r["size"] for r in rows) == sizes
    assert source_mix.mix(odd_documents.limit(0)).collect() == []
    taken = source_mix.mixed(with_clashing_names)
    assert taken.dtypes == with_clashing_names.dtypes
    assert taken.count() == sum(r.times for r in rows)
    assert source_mix.mixed(odd_documents.limit(0)).count() == 0


def test_documents_without_any_word(documents):
    assert {r.taken for r in source_mix.mix(documents((1, ""), (2, None))).collect()} == {0}
