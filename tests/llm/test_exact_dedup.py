import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import exact_dedup


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, stays = max(known, default=None), True
        for i in sorted(ids, key=lambda i: (i is None, -(i or 0))):
            kept = i == keep and stays
            stays = stays and not kept
            sha = hashlib.sha256(text.encode()).hexdigest()
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=str)


def found(df):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r[n] for n in names) for r in exact_dedup.groups(df).collect()), key=str)


def test_groups_of_odd_rows(odd_documents, with_clashing_names):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found(odd_documents) == expected(rows)
    assert found(with_clashing_names) == expected(rows)
    assert found(odd_documents.limit(0)) == []


def test_dropping_copies_keeps_columns(odd_documents, with_clashing_names):
    kept = exact_dedup.drop_copies(with_clashing_names)
    assert kept.dtypes == with_clashing_names.dtypes
    groups = {}
    for r in odd_documents.collect():
        groups.setdefault(r.text or "", set()).add((r.doc_id, r.text))
    stays = [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in groups.values()]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(stays, key=str)
    assert exact_dedup.drop_copies(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 2])
def test_colliding_keys_are_chained_and_compared(spark, documents, tmp_path, bits):
    """All texts share one key, or few: only their bytes tell them apart."""
    docs = documents(*[(i, f"text {i % 20}") for i in range(100)])
    key = F.pmod(F.hash("text"), F.lit(1 << bits)).cast("long")
    index = exact_dedup.build_index(docs, str(tmp_path / "index"), key=key).collect()
    assert len(index) == 20
    assert sorted(r.keep_id for r in index) == list(range(80, 100))
    assert {r.group_size for r in index} == {5}
    if bits == 0:
        assert sorted(r.chain for r in index) == list(range(20))


def test_small_buckets_and_owners_give_the_same_index(documents, tmp_path):
    docs = documents(*[(i, f"text {i % 50} of fifty") for i in range(200)])
    one = exact_dedup.build_index(docs, str(tmp_path / "one")).collect()
    many = exact_dedup.build_index(
        docs, str(tmp_path / "many"), bucket_bytes=40, max_depth=6, owner_bytes=100
    ).collect()
    assert sorted(one) == sorted(many)


def test_the_directory_doubles_only_where_buckets_are_overfull():
    sizes = np.zeros(16, np.int64)
    sizes[3], sizes[4:8], sizes[12] = 50, 10, 5
    directory = exact_dedup.Directory(sizes, 25)
    ends = np.append(directory.begins[1:], 16)
    assert directory.depth == 4
    for begin, end, depth in zip(directory.begins, ends, directory.depths, strict=True):
        assert end - begin == 16 >> depth
        load = sizes[begin:end].sum()
        assert load <= 25 or depth == 4
        parent = begin // (2 * (end - begin)) * 2 * (end - begin)
        assert depth == 0 or sizes[parent : parent + 2 * (end - begin)].sum() > 25
    owners = directory.owners(30)
    assert owners[0] == 0 and set(owners) <= set(directory.begins)
