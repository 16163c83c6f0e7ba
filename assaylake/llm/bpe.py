"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has exactly one token that can stand last in its encoding. A table of
these last tokens is the encoding of all prefixes at once: walking back from the end gives the
ids, appending bytes extends the table without touching it, and after an edit only the entries are
computed again up to where the table repeats itself.

A token may follow another if the two, merged by rank from their bytes, come out as the same two; an
encoding is the one whose neighbours all may follow each other.

The rank file is a parameter and is broadcast; what a task remembers of earlier texts is bounded. Only the
texts travel to Python, the rest of a row stays where it is, and nothing is shuffled. Texts are taken apart whole
at single spaces; every distinct run between them is encoded once, new pieces side by side in sorted order, and a text's ids are
gathered by index from those of its runs, their digits and the decoded bytes from the vocabulary.

Defined results: a null text is empty, and an empty text has no ids; texts are encoded without
special tokens, so the names of such tokens are ordinary text; repeated rows give equal rows; an
empty table gives an empty result; ids that the vocabulary lacks raise an error when decoded; other
columns are carried through whatever their names.
"""

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import ROW, boxed, text_of

#: Runs, and pairs of neighbours, that are remembered before they are learnt anew.
CACHED = 400_000
#: States of prefixes that are kept before they are learnt anew.
PREFIXES = 400_000
#: Bits of a place in a table of answers.
PLACE_BITS = 20
#: What spreads questions over such a table, by the upper bits of the product.
SCATTER = np.uint64(0x9E3779B97F4A7C15)
#: Pieces whose prefixes are taken through the vocabulary together.
AT_ONCE = 1 << 14
#: Ids of all remembered runs together, before they are learnt anew.
IDS_HELD = 1 << 21
#: Bytes of texts that are gathered at once.
SLICE_BYTES = 1 << 20
#: Bytes at the end of a prefix that tell which tokens can be its last.
ENDING = 4
#: In the place of a token before the first.
BEGIN = (1 << 31) - 1
#: A rank beyond all.
NEVER = 1 << 62
#: Bytes above which a piece has a table of its own.
LONG = 64


class Vocabulary:
    """Byte strings and their ranks, which are the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > ENDING:
                lengths.setdefault(token[-ENDING:], set()).add(len(token))
        self._lengths = {ending: tuple(sorted(n, reverse=True)) for ending, n in lengths.items()}
        self._ends: dict[bytes, tuple[tuple[int, ...], tuple[tuple[int, int], ...]]] = {}
        self._begins = {token[:n] for token in ranks for n in range(len(token) + 1)} | {b""}
        self._spines: dict[int, tuple[list, list]] = {}
        self._follows: dict[int, bool] = {}

    @classmethod
    def read(cls, lines: bytes) -> "Vocabulary":
        """From lines of a base64 token and its rank."""
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def merged(self, text: bytes, least: int = 1) -> list[bytes]:
        """The encoding by definition: merge the neighbours of lowest rank, leftmost first, until
        none is left or only ``least`` parts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > least:
            ranked = [
                (self.ranks[a + b], i)
                for i, (a, b) in enumerate(zip(parts, parts[1:]))
                if a + b in self.ranks
            ]
            if not ranked:
                break
            _, at = min(ranked)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: int) -> tuple[list, list]:
        """What stands at a token's left and at its right edge while it is merged, from the single
        byte on, each with the rank of the merge that takes it in."""
        known = self._spines.get(token)
        if known is None:
            text = self.bytes_of[token]
            parts = self.merged(text, 2)
            left, right = [], []
            if len(text) > 1 and len(parts) == 2:
                for mine, part, side in ((left, parts[0], 0), (right, parts[1], 1)):
                    inner = self._edges(self.ranks[part])[side]
                    mine += [*inner[:-1], (part, token)]
            left.append((text, NEVER))
            right.append((text, NEVER))
            known = self._spines[token] = (left, right)
        return known

    def stands_alone(self, token: int) -> bool:
        """Whether a token's bytes are encoded as that token."""
        text = self.bytes_of[token]
        return len(text) == 1 or len(self._edges(token)[0]) > 1

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge across the boundary of two tokens comes before those that build them."""
        known = self._follows.get(left << 32 | right)
        if known is None:
            if len(self._follows) >= CACHED:
                self._follows.clear()
            known = self._follows[left << 32 | right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        ends, begins = self._edges(left)[1], self._edges(right)[0]
        i = j = 0
        while True:
            (a, into_a), (b, into_b) = ends[i], begins[j]
            across = self.ranks.get(a + b, NEVER)
            if across < into_a and across <= into_b:  # at equal ranks the leftmost goes first
                return False
            if into_a == into_b == NEVER:
                return True
            if into_a <= into_b:
                i += 1
            else:
                j += 1

    def ends(self, ending: bytes) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...]]:
        """What can end bytes that end so: lengths of the tokens that are longer than the ending, and the tokens within it with their
        lengths, the longest first."""
        known = self._ends.get(ending)
        if known is None:
            if len(self._ends) >= CACHED:
                self._ends.clear()
            inside = ((self.ranks.get(ending[i:]), len(ending) - i) for i in range(len(ending)))
            shorter = tuple((token, n) for token, n in inside if token is not None)
            known = self._ends[ending] = (self._lengths.get(ending, ()), shorter)
        return known

    def longest_begin(self, text: bytes) -> bytes:
        """The longest end of some bytes with which a token begins; every token that ends them ends this."""
        while text not in self._begins:
            text = text[1:]
        return text

    def longest_end(self, text: bytes, begin: int = 0) -> int:
        """The longest token that ends some bytes and begins there or later, or -1."""
        return next((self.ranks[text[i:]] for i in range(begin, len(text)) if text[i:] in self.ranks), -1)

    @property
    def states(self) -> int:
        """How many beginnings tokens have, the empty one included."""
        return len(self._begins)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The last token of every prefix of some bytes: ``last[i]`` ends the first ``i`` bytes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        """Extends the table; the entries so far stay as they are."""
        begin = len(self.text)
        self.text = text = self.text + more
        last, last_token = self.last, self._last_token
        for end in range(begin + 1, len(text) + 1):
            last.append(last_token(text, end, last))

    def _last_token(self, text: bytes, end: int, last: Sequence[int]) -> int:
        """The longest candidates first; exactly one fits."""
        vocabulary = self.vocabulary
        longer, shorter = vocabulary.ends(text[max(0, end - ENDING) : end])
        inside = ((vocabulary.ranks.get(text[end - n : end]), n) for n in longer if n <= end)
        for token, length in chain(inside, shorter):
            begin = end - length
            if token is None:
                continue
            if begin == 0:
                if vocabulary.stands_alone(token):
                    return token
            elif vocabulary.may_follow(last[begin], token):
                return token
        raise ValueError(f"no token ends the byte {text[end - 1]}")

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Puts ``new`` in place of the bytes from ``begin`` to ``end``; returns the number of
        entries computed. An entry depends on the bytes and entries of the longest token before
        it, so once that many new entries equal the old ones, the rest of the table is as it was.
        """
        old, shift = self.last, len(new) - (end - begin)
        self.text = text = self.text[:begin] + new + self.text[end:]
        last, equal, at = old[: begin + 1], 0, begin + 1
        while at <= len(text) and equal < self.vocabulary.longest:
            last.append(self._last_token(text, at, last))
            same = at - shift > end and old[at - shift] == last[at]
            equal, at = equal + 1 if same else 0, at + 1
        computed = len(last) - begin - 1
        self.last = last + old[len(last) - shift :]
        return computed

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, or of all."""
        at, out = len(self.text) if end is None else end, []
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


class Known:
    """Answers to questions that are whole numbers, in a table of fixed size: a new question takes the place of
    an old one of the same hash."""

    def __init__(self, answer: Callable[[int], int]):
        self._answer = answer
        self._asked = np.full(1 << PLACE_BITS, -1, np.int64)
        self._answers = np.zeros(1 << PLACE_BITS, np.int32)
        self._shift = np.uint64(64 - PLACE_BITS)

    def of(self, questions: np.ndarray) -> np.ndarray:
        places = (questions.view(np.uint64) * SCATTER >> self._shift).view(np.int64)
        found = self._answers[places]
        new = np.flatnonzero(self._asked[places] != questions)
        if len(new):
            asked, back = np.unique(questions[new], return_inverse=True)
            found[new] = np.array([self._answer(one) for one in asked.tolist()], np.int32)[back]
            at, first = np.unique(places[new], return_index=True)
            self._asked[at], self._answers[at] = questions[new][first], found[new][first]
        return found


class LastTokens:
    """The last tokens of all prefixes of many byte strings, a byte of all of them at a time. In sorted order each
    shares a prefix with the one before it, whose entries it takes. A state is the longest end of a prefix with
    which a token begins."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        size = max(vocabulary.bytes_of, default=-1) + 1
        self._length = np.zeros(size, np.int64)
        self._shorter = np.full(size, -1, np.int64)  # the longest token that ends another
        for token, text in vocabulary.bytes_of.items():
            self._length[token] = len(text)
            self._shorter[token] = vocabulary.longest_end(text, 1)
        self._fits = Known(lambda pair: self._may_stand(pair >> 32, pair & (1 << 32) - 1))
        self.start()

    def start(self) -> None:
        self._state_of: dict[bytes, int] = {b"": 0}
        self._texts: list[bytes] = [b""]
        self._ending = np.full(self.vocabulary.states, -1, np.int64)  # the longest token that ends a state
        self._next_state = Known(lambda step: self._step(step >> 8, step & 255))

    def _may_stand(self, left: int, token: int) -> bool:
        vocabulary = self.vocabulary
        return vocabulary.stands_alone(token) if left == BEGIN else vocabulary._stay_apart(left, token)

    def _step(self, state: int, byte: int) -> int:
        text = self.vocabulary.longest_begin(self._texts[state] + bytes([byte]))
        known = self._state_of.get(text)
        if known is None:
            known = self._state_of[text] = len(self._texts)
            self._texts.append(text)
            self._ending[known] = self.vocabulary.longest_end(text)
        return known

    def encoded(self, pieces: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces side by side, and where each begins and ends."""
        if len(self._texts) >= PREFIXES:
            self.start()
        texts = [piece.encode() for piece in pieces]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        short = [i for i in order if len(texts[i]) <= LONG]
        long = [i for i in order if len(texts[i]) > LONG]
        found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for begin in range(0, len(short), AT_ONCE):
            ids, n = self._of_sorted([texts[i] for i in short[begin : begin + AT_ONCE]])
            found.append(ids)
            counts.append(n)
        for i in long:
            ids = np.array(PrefixTable(self.vocabulary, texts[i]).ids(), np.int32)
            found.append(ids)
            counts.append(np.array([len(ids)]))
        edges = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        place = np.empty(len(texts), np.int64)
        place[np.array(short + long, np.int64)] = np.arange(len(texts))
        ids, ends = gathered(np.concatenate(found), edges, place)
        return ids, np.concatenate([[0], ends])

    def _of_sorted(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sorted byte strings side by side, and how many each has."""
        lengths = np.array([len(text) for text in texts])
        width = int(lengths.max())
        rows = np.frombuffer(b"".join([text.ljust(width, b"\0") for text in texts]), np.uint8)
        rows = rows.reshape(len(texts), width)
        shared = np.zeros(len(texts), np.int64)
        differ = rows[1:] != rows[:-1]
        if width:
            alike = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            shared[1:] = np.minimum(alike, np.minimum(lengths[1:], lengths[:-1]))
        at = np.ascontiguousarray(rows.T)
        tokens = np.empty((width + 1, len(texts)), np.int64)
        lefts = np.zeros((width + 1, len(texts)), np.int64)
        tokens[0] = BEGIN
        states = np.zeros(len(texts), np.int64)
        for end in range(1, width + 1):
            here = np.flatnonzero(lengths >= end)
            new = shared[here] < end
            own, owner = here[new], np.cumsum(new) - 1
            state = self._next_state.of(states[own] << 8 | at[end - 1][own]).astype(np.int64)
            token, left = self._last(tokens, own, end, self._ending[state])
            states[here], tokens[end, here], lefts[end, here] = state[owner], token[owner], left[owner]
        steps, ends = [], lengths.copy()
        live, counts = np.flatnonzero(ends), np.zeros(len(texts), np.int64)
        while len(live):
            steps.append((live, tokens[ends[live], live]))
            ends[live] = lefts[ends[live], live]
            counts[live] += 1
            live = live[ends[live] > 0]
        last = np.cumsum(counts) - 1
        ids = np.empty(int(counts.sum()), np.int32)
        for back, (live, token) in enumerate(steps):
            ids[last[live] - back] = token
        return ids, counts

    def _last(
        self, tokens: np.ndarray, own: np.ndarray, end: int, token: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The last tokens of prefixes and where these begin; the longest candidates first, exactly one fits."""
        left, open_ = np.zeros(len(own), np.int64), np.arange(len(own))
        while len(open_):
            its = token[open_]
            if its.min() < 0:
                raise ValueError(f"no token ends the byte {end - 1} of a piece")
            begin = end - self._length[its]
            left[open_] = begin
            fits = self._fits.of(tokens[begin, own[open_]] << 32 | its)
            open_ = open_[fits == 0]
            token[open_] = self._shorter[token[open_]]
        return token, left


class Runs(dict):
    """Distinct runs by number, their ids side by side in a flat array. A run that is asked for gets a number and
    is new until its ids are added."""

    def __init__(self):
        self.start()

    def start(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.edges = array("i"), array("q", [0])

    def __missing__(self, run: str) -> int:
        number = self[run] = len(self)
        self.new.append(run)
        return number

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """The ids of all new runs, and where each run's end."""
        self.edges.frombytes((ends + len(self.ids)).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.int32).tobytes())
        self.new = []

    def full(self) -> bool:
        return len(self) >= CACHED or len(self.ids) >= IDS_HELD


def flat(strings: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings one after the other, and where each begins and ends."""
    held = list(strings)
    edges = np.cumsum([0, *map(len, held)], dtype=np.int64)
    return np.frombuffer(b"".join(held), np.uint8), edges


def gathered(entries: np.ndarray, edges: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a flat array that belong to some numbers, one after the other, and where each ends."""
    begins, lengths = edges[numbers], edges[numbers + 1] - edges[numbers]
    ends = np.cumsum(lengths)
    at = np.repeat(begins - (ends - lengths), lengths)
    at += np.arange(len(at))
    return entries[at], ends


class Encoder:
    """Encodes texts piece by piece, as a pattern cuts them."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self._pieces = regex.compile(pattern).findall
        # whether a run between single spaces may stand for itself
        # (white space of this module is at least that of the pattern's)
        self._by_space = re.compile(r"[^\S ](?:(?= )|(?<= .))", re.DOTALL).search
        self._single_spaces = re.compile(r"(?<=\S) (?=\S)").split
        self.splits = all(
            regex.fullmatch(pattern, piece) is None for piece in ("a b", "a ", ". .", "1 1", "! a", " a b")
        )
        self.runs = Runs()
        self._last_tokens = LastTokens(vocabulary)

    def _learn(self) -> None:
        """Ids of new runs; each of their pieces is encoded once."""
        pieces = [self._pieces(run[1:] if run.startswith(" ") else " " + run) for run in self.runs.new]
        number = {piece: i for i, piece in enumerate(dict.fromkeys(chain.from_iterable(pieces)))}
        ids, edges = self._last_tokens.encoded(number)
        counts = np.array([len(its) for its in pieces], np.int64)
        numbers = np.fromiter(map(number.__getitem__, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        ids, ends = gathered(ids, edges, numbers)
        self.runs.add(ids, np.concatenate([[0], ends])[np.cumsum(counts)])

    def _irregular(self, text: str) -> bool:
        return "  " in text or text[:1].isspace() or text[-1:].isspace() or self._by_space(text) is not None

    def cut(self, text: str) -> list[str]:
        """Runs that are encoded one by one: a piece holds a space only as its first character, so one
        begins at each space that stands alone between two other characters, whatever the
        pattern finds elsewhere. A pattern of another kind takes texts as they are. Runs after the first are
        given without their space; the first has one put before it, which tells it from all others."""
        if not self.splits:
            return [" " + text]
        runs = self._single_spaces(text) if self._irregular(text) else text.split(" ")
        runs[0] = " " + runs[0]
        return runs

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The runs of some texts by number, and where each text's runs end. What is remembered is
        bounded between texts of one call only by their own size."""
        if self.runs.full() or self.runs.new:  # new ones are left over where learning them failed
            self.runs.start()
        cuts = [self.cut(text) for text in texts]
        ends = np.cumsum([len(c) for c in cuts], dtype=np.int64)
        found = map(self.runs.__getitem__, chain.from_iterable(cuts))
        numbers = np.fromiter(found, np.int64, int(ends[-1]) if len(ends) else 0)
        self._learn()
        return numbers, ends

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        numbers, _ = self.numbers([text])
        return gathered(np.array(self.runs.ids), np.array(self.runs.edges), numbers)[0].tolist()


class Digests:
    """Texts as ids, with digests of the ids' digits and of the bytes that the ids decode to."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        bytes_of = encoder.vocabulary.bytes_of
        size = max(bytes_of, default=-1) + 1
        self.bytes, self.edges = flat(bytes_of.get(i, b"") for i in range(size))
        self.digits, self.digit_edges = flat(b"%d," % i for i in range(size))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
        """All ids, where each text's end, and both digests of each text."""
        numbers, run_ends = self.encoder.numbers(texts)
        runs = self.encoder.runs

        def of_texts(ends: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], ends])[run_ends]

        ids, ends = gathered(np.frombuffer(runs.ids, np.int32), np.frombuffer(runs.edges, np.int64), numbers)
        ends = of_texts(ends)
        digits, digit_ends = gathered(self.digits, self.digit_edges, ids)
        digit_ends = np.concatenate([[0], digit_ends])[ends]
        decoded, token_ends = gathered(self.bytes, self.edges, ids)
        decoded_ends = np.concatenate([[0], token_ends])[ends]
        return ids, ends, _shas(digits, digit_ends, 1), _shas(decoded, decoded_ends, 0)


def _shas(flat: np.ndarray, ends: np.ndarray, without: int) -> list[str]:
    """Digests of consecutive stretches, each without so many bytes at its end."""
    begins, view = [0, *ends.tolist()], memoryview(flat)
    pairs = zip(begins, begins[1:], strict=False)
    return [hashlib.sha256(view[a : max(a, b - without)]).hexdigest() for a, b in pairs]


def _kept(rank_bytes: bytes, pattern: str) -> Digests:
    """What a Python worker has learnt of a vocabulary serves its later tasks as well; it keeps one."""
    home = sys.modules.setdefault("_assaylake_bpe_kept", ModuleType("_assaylake_bpe_kept"))
    key = (hashlib.sha256(rank_bytes).digest(), pattern)
    if getattr(home, "key", None) != key:
        home.digests, home.key = Digests(Encoder(Vocabulary.read(rank_bytes), pattern)), key
    return home.digests


def _digests(rank_bytes: Callable[[], bytes], pattern: str, with_ids: bool) -> Callable:
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        digests = _kept(rank_bytes(), pattern)
        for batch in batches:
            out: list[list[pa.Array]] = []
            begin = size = 0
            for end, text in enumerate(batch, 1):
                size += text.as_buffer().size
                if size < SLICE_BYTES and end < len(batch):
                    continue
                ids, ends, of_ids, of_bytes = digests.of(batch.slice(begin, end - begin).to_pylist())
                edges = np.concatenate([[0], ends])
                columns = [
                    pa.array(np.diff(edges), pa.int64()),
                    pa.array(of_ids, pa.string()),
                    pa.array(of_bytes, pa.string()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)))
                out.append(columns)
                begin, size = end, 0
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            n = 4 if with_ids else 3
            whole = [pa.concat_arrays([c[i] for c in out]) if out else pa.array([], kinds[i]) for i in range(n)]
            yield pa.StructArray.from_arrays(whole, names[:n])

    return encode


def _rank_bytes(df: DataFrame, path: str) -> Callable[[], bytes]:
    """The rank file, read once by the driver and broadcast; its size is that of a vocabulary."""
    with open(path, "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())
    return lambda: sent.value


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``, in the
    place of columns of these names."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kinds = ["long", "string", "string", "array<int>"]
    kind = ", ".join(f"{n}: {k}" for n, k in zip(names, kinds, strict=False))
    run = F.arrow_udf(_digests(_rank_bytes(docs, path), pattern, with_ids), f"struct<{kind}>")
    rows = boxed(docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids"))
    done = rows.select(ROW, run(text_of(f"{ROW}.text")).alias("_tokens"))
    return done.select(f"{ROW}.*", *[f"_tokens.{n}" for n in names])


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return encoded(docs.select("doc_id", "text"), path, pattern, with_ids=False).drop("text")


def decoded(ids: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``ids`` with ``decoded``, the bytes of a column of ids; null ids give null bytes."""
    rank_bytes = _rank_bytes(ids, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.read(rank_bytes())
        for batch in batches:
            out = [
                None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], names=[ROW, "decoded"]
            )

    rows = boxed(ids).select(ROW, F.col(f"{ROW}.{column}").alias("ids"))
    kind = rows.schema[ROW].dataType.simpleString()
    done = rows.mapInArrow(decode, f"{ROW} {kind}, decoded binary")
    return done.select(f"{ROW}.*", "decoded")
