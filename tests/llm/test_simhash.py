import re

import numpy as np
import pytest
import xxhash

from assaylake.llm import simhash
from assaylake.sources.shared import shared_folder


def by_definition(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    fps = np.asarray(fps, np.uint64)
    forest = simhash.Forest(len(fps))
    for i, j in zip(*(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2).nonzero()):
        forest.join(int(i), int(j))
    return [forest.root(i) for i in range(len(fps))]


def clustered(n, rng):
    """Fingerprints of which many are a few bits from another, and a crowd around one."""
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    crowd = np.full(n, base[0])
    for _ in range(4):
        crowd ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return rng.permutation(np.unique(np.concatenate([base, near, crowd])))


@pytest.mark.parametrize(
    "text", ["", "  ", "One", "ONE two", "É É É", "a b c a b c a b c", "x\x85y\xa0z w", "a\nb\tc\x0bd"]
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == by_definition(text)


def test_fingerprint_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i * i % 7919}" for i in range(3000))
    assert simhash.fingerprint(text) == by_definition(text)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(text) == by_definition(text)


@pytest.mark.parametrize("leaf", [8, 64, 5000])
def test_spanning_links_connect_what_is_connected(leaf):
    fps = clustered(400, np.random.default_rng(3))
    forest = simhash.Forest(len(fps))
    links = simhash.spanning_links(fps, leaf)
    for i, j in links:
        assert int(fps[i] ^ fps[j]).bit_count() <= 2
        assert forest.join(i, j)  # no link too many
    assert [forest.root(i) for i in range(len(fps))] == brute_components(fps)


@pytest.mark.parametrize(
    "options", [{}, {"shard": 60}, {"shard": 60, "max_in_task": 30}, {"shard": 60, "sample": 100}]
)
def test_links_and_components_over_shards(spark, options):
    fps = clustered(200, np.random.default_rng(4))
    signed = fps.view(np.int64).tolist()
    folder = shared_folder(spark, "test")
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.near_links(df, folder, **options)
    roots = {r.fp: r.root for r in simhash.components(links, folder).collect()}
    want = {}
    for fp, root in zip(signed, brute_components(fps), strict=True):
        want.setdefault(root, []).append(fp)
    for members in want.values():
        assert {roots.get(fp, fp) for fp in members} == {min(members)}


def test_large_shards_are_split_again_by_spark(spark, monkeypatch):
    """All sizes a hundredth, so that several rounds are needed, and a crowd of alike ones."""
    for name, value in (("TOP_SHARDS", 4), ("PART_SHARDS", 4), ("PART_SAMPLE", 200), ("PARTS_HELD", 3)):
        monkeypatch.setattr(simhash, name, value)
    rounds, route = [], simhash._stored_route
    monkeypatch.setattr(simhash, "_stored_route", lambda *a: rounds.append(a[1]) or route(*a))
    rng = np.random.default_rng(8)
    crowd = np.full(1500, rng.integers(0, 2**63, dtype=np.uint64))
    for _ in range(2):
        crowd ^= np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)
    fps = np.unique(np.concatenate([clustered(1500, rng), crowd]))
    signed = fps.view(np.int64).tolist()
    folder = shared_folder(spark, "test")
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.near_links(df, folder, sample=655, shard=82, max_in_task=655)
    assert len(rounds) > 2
    roots = {r.fp: r.root for r in simhash.components(links, folder).collect()}
    want = {}
    for fp, root in zip(signed, brute_components(fps), strict=True):
        want.setdefault(root, []).append(fp)
    for members in want.values():
        assert {roots.get(fp, fp) for fp in members} == {min(members)}


def test_long_chains_are_one_component(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 300)]
    folder = shared_folder(spark, "test")
    roots = simhash.components(spark.createDataFrame(pairs, "a long, b long"), folder).collect()
    assert {(r.fp, r.root) for r in roots} == {(i, 0) for i in range(1, 301)} | {
        (1000 + i, 1000) for i in range(1, 300)
    }


def test_near_duplicates_of_odd_rows(odd_documents, with_clashing_names):
    rows = [(r.doc_id, by_definition(r.text)) for r in odd_documents.collect()]
    roots = brute_components([fp for _, fp in rows])
    ids = {}
    for (doc_id, _), root in zip(rows, roots, strict=True):
        ids.setdefault(root, []).append(doc_id)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    want = sorted(
        ((d, f"{fp:016x}", least[r]) for (d, fp), r in zip(rows, roots, strict=True)), key=str
    )
    for df in (odd_documents, with_clashing_names):
        got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == want
    kept = simhash.drop_near_duplicates(with_clashing_names)
    assert kept.dtypes == with_clashing_names.dtypes
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least.values(), key=str)


def test_empty_table_and_rows_without_ids(documents):
    empty = documents((1, "a")).limit(0)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []
    nameless = documents((None, "a b c d"), (None, "a b c d"), (None, "wholly other words"))
    assert [r.component_id for r in simhash.near_duplicates(nameless).collect()] == [None] * 3
    assert sorted(r.text for r in simhash.drop_near_duplicates(nameless).collect()) == [
        "a b c d", "wholly other words",
    ]
