"""Benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark items become words (letters, digits and all beyond ASCII, A-Z in lower case) and windows of
``WINDOW`` consecutive words; an item of fewer words is one window. The windows' hashes are broadcast,
every document's own windows are looked up in them, and what is found is verified by its bytes, so
a hash only proposes. Hit words are merged into spans of the text, which ``remove_spans`` cuts out
and ``drop_contaminated`` weighs against the document's words.

The set that is broadcast is bounded: the benchmark is dealt into parts of about ``PART_BYTES`` of
text. One part is the usual case and takes a single pass over the documents without a shuffle. With
more parts each is looked up in a pass of its own, which writes hit spans only, and the spans of a
document are then united by its id and the digest of its text.

Defined results: a null text has no words; an item without words has no window; items are told apart
by their ids as strings, a null id counting as empty, so rows with one id are one item; documents with the
same id and text get the same result, repeated rows one each; a text of any length is scanned
whole, in overlapping pieces; an empty table gives an empty result, and an empty benchmark no hits;
other columns are carried through whatever their names.
"""

import math
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import ID_KEY, ROW, boxed, by_value, id_key, text_of, unboxed
from assaylake.llm.word_hash import WordHasher, letters
from assaylake.sources.shared import shared_folder, stored

WINDOW = 10
#: Bytes of benchmark text that one pass holds, with some 20 bytes for each of their windows.
PART_BYTES = 16 << 20
#: Bytes of texts that are hashed at once; a longer text is hashed in overlapping pieces.
PIECE_BYTES = 1 << 20

HASHER = WordHasher(letters())
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20
_BETWEEN = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")

#: The same words as a Java regular expression.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

SPANS = "array<struct<begin: long, end: long, word: long, words: long>>"
FOUND = f"struct<n_words: long, n_hit: long, items: array<string>, spans: {SPANS}, left: string>"


def _mixed(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes * _MIX
    return mixed ^ (mixed >> np.uint64(32))


def _spelled(raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words in lower case with one space after each, and where each begins."""
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    out = np.full(int((lengths + 1).sum()), 32, np.uint8)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(starts, lengths) + inside] = HASHER.alphabet[raw[np.repeat(begins, lengths) + inside]]
    return out.tobytes(), starts


class Windows:
    """Windows of a part of the benchmark: keys in order, with the words and the item of each."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = WINDOW):
        self.window = window
        names, texts, word_counts, begins, hashes = [], [], [], [], []
        place = 0
        for name, text in items:
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            at, lengths, keys = HASHER.words(raw)
            if not len(at):
                continue
            spelled, starts = _spelled(raw, at, lengths)
            names.append(name)
            texts.append(spelled)
            word_counts.append(len(at))
            begins.append(starts + place)
            hashes.append(_mixed(keys))
            place += len(spelled)
        self.names, self.spelled = names, b"".join(texts)
        counts = np.array(word_counts, np.int64)
        self.begins = np.concatenate([*begins, np.array([place], np.int64)])
        word_hashes = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(names)), counts)
        spans = np.minimum(counts, window)
        self.sets: dict[int, tuple[np.ndarray, ...]] = {}
        for length, keys in _window_keys(word_hashes, sorted(set(spans.tolist()))):
            first = np.flatnonzero((owner[: len(keys)] == owner[length - 1 :]) & (spans[owner[: len(keys)]] == length))
            order = first[np.argsort(keys[first], kind="stable")]
            distinct, runs = np.unique(keys[order], return_index=True)
            runs = np.append(runs, len(order))
            near = np.zeros(1 << _FILTER_BITS, bool)
            near[(distinct >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.sets[length] = (near, distinct, runs, order, owner[order])

    def text(self, word: int, length: int) -> bytes:
        return self.spelled[self.begins[word] : self.begins[word + length]]

    def verified(self, length: int, run: int, text: bytes) -> list[int]:
        """Items with a window of this key and text."""
        _, _, runs, words, items = self.sets[length]
        lo, hi = runs[run], runs[run + 1]
        return [int(items[i]) for i in range(lo, hi) if self.text(words[i], length) == text]


def _window_keys(hashes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Keys of all windows of each length, built up word by word."""
    keys = hashes
    for length in range(1, max(lengths, default=0) + 1):
        if length > 1:
            keys = hashes[: max(0, len(hashes) - length + 1)] + _MIX * keys[1:]
        if length in lengths:
            yield length, keys


class Scan:
    """Hits of a batch of texts."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.items_of: dict[tuple[int, int, bytes], list[int]] = {}

    def batch(self, texts: list[bytes], cut: bool) -> pa.Array:
        self.n_words = np.zeros(len(texts), np.int64)
        self.items: dict[int, set[int]] = {}
        self.hits: list[np.ndarray] = []
        held, size = [], 0
        for number, text in enumerate(texts):
            if len(text) > PIECE_BYTES:
                self.long_text(number, text)
                continue
            held.append((number, 0, 0, text))
            size += len(text)
            if size >= PIECE_BYTES:
                self.look_up(held)
                held, size = [], 0
        self.look_up(held)
        return self.result(texts, cut)

    def long_text(self, number: int, text: bytes) -> None:
        """Pieces end between words, and each begins with the last words of the one before."""
        start = word = 0
        stop = PIECE_BYTES
        overlap = self.windows.window - 1
        while True:
            edge = _BETWEEN.search(text, stop) if stop < len(text) else None
            stop = edge.start() if edge else len(text)
            begins = self.look_up([(number, start, word, text[start:stop])])
            if stop == len(text):
                return
            if len(begins) > overlap:
                word += len(begins) - overlap
                start += int(begins[len(begins) - overlap]) if overlap else stop - start
            stop += PIECE_BYTES

    def look_up(self, segments: list[tuple[int, int, int, bytes]]) -> np.ndarray:
        """Segments (text number, first byte, first word, bytes); gives where their words begin."""
        if not segments:
            return np.zeros(0, np.int64)
        raw = np.frombuffer(b"\n".join(s[3] for s in segments), np.uint8)
        sizes = np.array([len(s[3]) + 1 for s in segments], np.int64)
        edges = np.cumsum(sizes) - sizes
        begins, lengths, hashes = HASHER.words(raw)
        part = np.searchsorted(edges, begins, "right") - 1
        counts = np.bincount(part, minlength=len(segments))
        first = np.cumsum(counts) - counts
        numbers = np.array([s[0] for s in segments])
        self.n_words[numbers] = np.array([s[2] for s in segments]) + counts
        marks = np.zeros(len(begins) + 1, np.int64)
        spelled = None
        for length, keys in _window_keys(_mixed(hashes), list(self.windows.sets)):
            near, distinct = self.windows.sets[length][:2]
            maybe = np.flatnonzero(near[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            maybe = maybe[part[maybe] == part[maybe + length - 1]]
            if not len(maybe):
                continue
            run = np.minimum(np.searchsorted(distinct, keys[maybe]), len(distinct) - 1)
            equal = distinct[run] == keys[maybe]
            for i, j in zip(maybe[equal].tolist(), run[equal].tolist(), strict=True):
                if spelled is None:
                    spelled, places = _spelled(raw, begins, lengths)
                    places = np.append(places, len(spelled))
                text = spelled[places[i] : places[i + length]]
                if (length, j, text) not in self.items_of:
                    if len(self.items_of) > 100_000:
                        self.items_of.clear()
                    self.items_of[length, j, text] = self.windows.verified(length, j, text)
                found = self.items_of[length, j, text]
                if found:
                    self.items.setdefault(int(numbers[part[i]]), set()).update(found)
                    marks[i] += 1
                    marks[i + length] -= 1
        hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        if len(hit):
            of = part[hit]
            byte = begins[hit] - edges[of] + np.array([s[1] for s in segments])[of]
            word = hit - first[of] + np.array([s[2] for s in segments])[of]
            self.hits.append(np.stack([numbers[of], word, byte, byte + lengths[hit]]))
        return begins

    def result(self, texts: list[bytes], cut: bool) -> pa.Array:
        hits = np.concatenate([*self.hits, np.zeros((4, 0), np.int64)], axis=1)
        hits = hits[:, np.lexsort(hits[1::-1])]
        same = (hits[0, 1:] == hits[0, :-1]) & (hits[1, 1:] == hits[1, :-1])
        hits = hits[:, np.concatenate([np.ones(min(1, hits.shape[1]), bool), ~same])]
        limits = np.searchsorted(hits[0], np.arange(len(texts) + 1))
        rows = []
        for number, text in enumerate(texts):
            own = hits[:, limits[number] : limits[number + 1]]
            if not own.shape[1]:
                rows.append((int(self.n_words[number]), 0, [], [], text.decode("utf-8", "replace") if cut else None))
                continue
            gap = np.flatnonzero(np.diff(own[1]) > 1)
            head, tail = np.concatenate([[0], gap + 1]), np.append(gap, own.shape[1] - 1)
            spans = np.stack([own[2, head], own[3, tail], own[1, head], tail - head + 1], axis=1)
            left = None
            if cut:
                ends = [0, *spans[:, 1].tolist()]
                begins = [*spans[:, 0].tolist(), len(text)]
                left = b"".join(text[a:b] for a, b in zip(ends, begins, strict=True)).decode("utf-8", "replace")
            raw = np.frombuffer(text, np.uint8)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            spans[:, :2] = chars[spans[:, :2]]
            names = sorted({self.windows.names[i] for i in self.items[number]})
            spans = [dict(zip(("begin", "end", "word", "words"), s, strict=True)) for s in spans.tolist()]
            rows.append((int(self.n_words[number]), own.shape[1], names, spans, left))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        long = pa.int64()
        span = pa.struct([("begin", long), ("end", long), ("word", long), ("words", long)])
        kinds = [long, long, pa.list_(pa.string()), pa.list_(span), pa.string()]
        names = ["n_words", "n_hit", "items", "spans", "left"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _finder(part, cut: bool):
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = Scan(pickle.loads(part.value))
        for texts in batches:
            whole = [t.as_buffer().to_pybytes() for t in texts]
            yield scan.batch(whole, cut)

    return F.arrow_udf(find, FOUND)


def _united(spans: list[list[dict]]) -> list[tuple[int, int, int, int]]:
    """Spans of several passes over a text as disjoint ones in order, parted by words not hit."""
    out: list[list[int]] = []
    for s in sorted((s for each in spans for s in each), key=lambda s: (s["word"], s["words"])):
        if out and s["word"] <= out[-1][2] + out[-1][3]:
            last = out[-1]
            last[1] = max(last[1], s["end"])
            last[3] = max(last[3], s["word"] + s["words"] - last[2])
        else:
            out.append([s["begin"], s["end"], s["word"], s["words"]])
    return [tuple(s) for s in out]


def parts_of(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """Distinct items with the number of their part, and how many parts there are."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        text_of().alias("text"),
    ).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    return items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), parts


def _part(items: DataFrame, number: int, window: int):
    rows = items.where(F.col("part") == number).select("item_id", "text").toArrow()
    pairs = zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)
    return by_value(items, Windows(sorted(pairs), window))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    part_bytes: int = PART_BYTES,
    cut: bool = False,
) -> DataFrame:
    """Whole documents as ``_row`` with ``found``: words, words hit, ids of items with a window in the
    text, spans (code points ``begin`` to ``end``, first word and number of words) and, if ``cut``, the
    text without the spans."""
    items, parts = parts_of(benchmark, part_bytes)
    rows, text = boxed(docs), text_of(f"{ROW}.text")
    if parts == 1:
        return rows.select(ROW, _finder(_part(items, 0, window), cut)(text).alias("found"))
    folder = shared_folder(docs.sparkSession, "decontamination")
    key = [*ID_KEY, "_sha"]
    keys = [*id_key(F.col(f"{ROW}.doc_id")), F.sha2(F.encode(text, "UTF-8"), 256).alias("_sha")]
    passes = None
    for number in range(parts):
        find = _finder(_part(items, number, window), False)
        found = rows.select(*keys, find(text).alias("f")).where("f.n_hit > 0")
        found = stored(found.select(*key, "f.items", "f.spans").dropDuplicates(key), folder, f"part-{number}")
        passes = found if passes is None else passes.unionByName(found)
    unite = F.udf(_united, SPANS)
    hits = passes.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"),
        unite(F.collect_list("spans")).alias("_spans"),
    )
    none = F.array().cast
    spans = F.coalesce("_spans", none(SPANS))
    found = F.struct(
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["words"]).alias("n_hit"),
        F.coalesce("_items", none("array<string>")).alias("items"),
        spans.alias("spans"),
        (_cut(text, spans) if cut else F.lit(None).cast("string")).alias("left"),
    )
    return rows.select(ROW, *keys).join(hits, key, "left").select(ROW, found.alias("found"))


def _cut(text: Column, spans: Column) -> Column:
    """The text without its spans: what lies between the end of each and the next one's begin."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    begins = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.char_length(text).cast("long")))
    between = F.zip_with(ends, begins, lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(between, "")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents with their own columns, hit spans cut out of their texts."""
    found = scan(docs, benchmark, cut=True, **options)
    text = F.when(F.col("found.n_hit") > 0, F.col("found.left")).otherwise(F.col(f"{ROW}.text"))
    return unboxed(found.select(F.col(ROW).withField("text", text).alias(ROW)))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, most: float = 0.0, **options
) -> DataFrame:
    """The documents of whose words at most the share ``most`` is hit, with their own columns."""
    found = scan(docs, benchmark, **options)
    share = F.col("found.n_hit") / F.greatest(F.col("found.n_words"), F.lit(1))
    return unboxed(found.where(share <= most))
