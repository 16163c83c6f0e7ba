import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from assaylake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as file:
    ENCODER = bpe.Encoder(bpe.Vocabulary.read(file.read()), public_tokenizers.PATTERN)
VOCABULARY = ENCODER.vocabulary
LIBRARY = tiktoken.Encoding(
    "library",
    pat_str=public_tokenizers.PATTERN,
    mergeable_ranks=VOCABULARY.ranks,
    special_tokens={},
)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \t\n\x0b\x1c\x85 　abcthe019'sé漢😀.,!<|>"), max_size=60))
def test_encodes_like_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert VOCABULARY.decode(ids) == text.encode()


@pytest.mark.parametrize(
    "text", ["", "a" * 5000, "the cat " * 2000, "<|endoftext|>", "\u0000﻿", "é" * 300]
)
def test_long_and_odd_texts(text):
    assert ENCODER.encode(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(VOCABULARY.bytes_of)), st.sampled_from(sorted(VOCABULARY.bytes_of)))
def test_which_tokens_may_be_neighbours(left, right):
    both = VOCABULARY.bytes_of[left] + VOCABULARY.bytes_of[right]
    merged = [VOCABULARY.ranks[p] for p in VOCABULARY.merged(both)]
    assert VOCABULARY.may_follow(left, right) == (merged == [left, right])


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=20), st.integers(0, 80), st.integers(0, 6))
def test_appends_and_edits_give_the_table_of_the_new_bytes(text, more, begin, width):
    table = bpe.PrefixTable(VOCABULARY, text)
    table.append(more)
    assert table.last == bpe.PrefixTable(VOCABULARY, text + more).last
    begin = min(begin, len(table.text))
    table.replace(begin, min(begin + width, len(table.text)), more)
    assert table.last == bpe.PrefixTable(VOCABULARY, table.text).last
    assert [VOCABULARY.ranks[p] for p in VOCABULARY.merged(table.text)] == table.ids()


def test_every_prefix_has_its_encoding_and_an_edit_is_local():
    table = bpe.PrefixTable(VOCABULARY, b"an internationalisation of things")
    for end in range(len(table.text) + 1):
        merged = VOCABULARY.merged(table.text[:end])
        assert table.ids(end) == [VOCABULARY.ranks[p] for p in merged]
    long = bpe.PrefixTable(VOCABULARY, b"the cat sat on the mat " * 500)
    assert long.replace(60, 63, b"dog") < 100


def test_small_caches_change_nothing(monkeypatch):
    text = " ".join(f"word{i % 50}ing" for i in range(500))
    monkeypatch.setattr(bpe, "CACHED", 5)
    monkeypatch.setattr(bpe, "PREFIXES", 40)
    fresh = bpe.Encoder(bpe.Vocabulary(VOCABULARY.ranks), public_tokenizers.PATTERN)
    assert fresh.encode(text) == LIBRARY.encode_ordinary(text)


def test_pieces_of_many_runs_are_encoded_once_and_share_prefixes(monkeypatch):
    given = []

    def encoded(self, pieces, of=bpe.LastTokens.encoded):
        given.append(list(pieces))
        return of(self, given[-1])

    monkeypatch.setattr(bpe.LastTokens, "encoded", encoded)
    words = ["qwortung", "qwortungen", "qwort", "qwortunk", "éqwort", "q" * 80, "qwortung"]
    texts = [f"x {word}{end} y" for word in words for end in ("", ",", ".", "!?", ",\n")]
    fresh = bpe.Encoder(bpe.Vocabulary(VOCABULARY.ranks), public_tokenizers.PATTERN)
    digests = bpe.Digests(fresh).of(texts)
    want = [LIBRARY.encode_ordinary(text) for text in texts]
    assert digests[0].tolist() == [i for ids in want for i in ids]
    assert digests[2] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in want]
    assert [given[0].count(f" {word}") for word in words] == [1] * len(words)
    bpe.Digests(fresh).of(texts)
    assert given[1:] == [[]]


def test_work_per_byte_is_shared_by_all_new_pieces(monkeypatch):
    asked = []

    def of(self, questions, of=bpe.Known.of):
        asked.append(len(questions))
        return of(self, questions)

    monkeypatch.setattr(bpe.Known, "of", of)
    for n in (40, 4000):
        texts = [" ".join(f"q{chr(97 + i % 26)}xz{i:07d}ab" for i in range(n)), " ".join("qxzb" * (i % 9 + 1) for i in range(n))]
        fresh = bpe.Encoder(bpe.Vocabulary(VOCABULARY.ranks), public_tokenizers.PATTERN)
        asked.clear()
        got = bpe.Digests(fresh).of(texts)[0].tolist()
        assert got == [i for text in texts for i in LIBRARY.encode_ordinary(text)]
        assert len(asked) < 37 * VOCABULARY.longest


@pytest.mark.parametrize(("bits", "pieces"), [(2, 3), (4, 1 << 14), (20, 1)])
def test_small_tables_of_answers_change_nothing(monkeypatch, bits, pieces):
    monkeypatch.setattr(bpe, "PLACE_BITS", bits)
    monkeypatch.setattr(bpe, "AT_ONCE", pieces)
    fresh = bpe.Encoder(bpe.Vocabulary(VOCABULARY.ranks), public_tokenizers.PATTERN)
    texts = ["", "\0", "\0\0 \0", "a\0 a\0\0 a", " a", "a ", "foo\n bar", "a foo\n", "b foo\n c", "x  y", "é" * 40 + " é"]
    texts += [" ".join(f"word{i % 50}ing" * (i % 7) for i in range(90)), "\x1c a\x1c b \x85c"]
    for _ in range(2):
        ids, ends, _, decoded = bpe.Digests(fresh).of(texts)
        want = [LIBRARY.encode_ordinary(text) for text in texts]
        assert [its.tolist() for its in bpe.np.split(ids, ends)[:-1]] == want
        assert decoded == [hashlib.sha256(text.encode()).hexdigest() for text in texts]


def test_runs_that_could_not_be_learnt_are_not_remembered():
    fresh = bpe.Encoder(bpe.Vocabulary({b"a": 0, b" ": 1, b"b": 2, b"ab": 3}), public_tokenizers.PATTERN)
    assert fresh.encode("ab b") == [3, 1, 2]
    for _ in range(2):
        with pytest.raises(ValueError, match="no token ends"):
            fresh.encode("ab c")
    assert fresh.encode("b ab") == [2, 1, 3]


def test_digests_of_odd_rows(odd_documents):
    def sha(data):
        return hashlib.sha256(data).hexdigest()

    want = []
    for r in odd_documents.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        text = ",".join(map(str, ids))
        want.append((r.doc_id, len(ids), sha(text.encode()), sha((r.text or "").encode())))
    got = bpe.token_digests(odd_documents, PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_ids_and_back(with_clashing_names):
    encoded = bpe.encoded(with_clashing_names, PATH, public_tokenizers.PATTERN)
    rows = bpe.decoded(encoded.select("text", "ids"), PATH).collect()
    assert len(rows) == 12
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert encoded.limit(0).count() == 0
    assert {r["words"] for r in encoded.collect()} == {13}
