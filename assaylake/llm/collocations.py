"""Phrase collocations by the stripes pattern.

A prefix of words keys an associative counter of the words that come next, its stripe. Tasks build the
stripes of what they read and merge them before the shuffle; equal stripes are then merged
elementwise. The empty prefix has the words themselves with their counts, whose sum is all words;
every further level takes the phrases of the level before as prefixes. All else is read off this one structure: the
count of a phrase is its entry in its prefix's stripe, that of any part of a phrase is another such entry, and the most
frequent extension of a phrase is the largest entry of its stripe (to the right) or of the stripes whose
prefix and entry end in it (to the left).

A phrase that occurs ``min_count`` times is made of parts that do, so a stripe only counts what can still
reach that. After the first level words are numbers: texts are written once as lists of them, cut where
a piece ends or a rarer word stands, and each level reads these lists. What a Python
worker holds is bounded: ``WORDS_HELD`` words and ``PHRASES_HELD`` phrases. More words are looked up in several
passes over the texts, more phrases are dealt by their first word and counted in one pass over the lists
for each deal. A stripe is dealt over ``BUCKETS`` tasks by the next word, so a common prefix does not
end in one of them.

Defined results: a null text is empty; a null lang is ``und``; ties are broken by the count and then by the phrase,
byte by byte; repeated rows count each time; texts of any length are counted whole; an empty table, or
a language without phrases, gives no row; at most 2^31 phrases of one length may occur ``min_count``
times, more raise an error; other columns play no part.
"""

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import by_value, text_of
from assaylake.llm.word_hash import lower_ascii
from assaylake.sources.shared import shared_folder, stored

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: A phrase goes if a longer one has this many hundredths of its count.
SUBSUMED = 100
BUCKETS = 8

WORDS_HELD = 1 << 20
PHRASES_HELD = 1 << 22
#: Cells of stripes that a task merges before it sends them on.
CELLS_HELD = 1 << 21
#: Bytes of texts, and numbers in lists, that are taken apart at once.
SLICE_BYTES = 1 << 21
SLICE_NUMBERS = 1 << 19
#: Rows that are numbered in one task.
NUMBERED = 1 << 16

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LOWER = lower_ascii().astype(np.uint8)


class Words:
    """The words of some texts, each of which ends in a break: their bytes in lower case, the number of
    the piece that each stands in, and its text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        kind = _KIND[raw]
        inside = np.concatenate([[False], kind == _WORD, [False]])
        change = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = change[::2], change[1::2]
        self.piece = np.cumsum(kind == _BREAK, dtype=np.int32)[begins]
        self.text = np.searchsorted(edges - edges[0], begins, "right") - 1
        offsets = np.concatenate([[0], np.cumsum(ends - begins)])
        data = _LOWER[raw[inside[1:-1]]]
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
        self.bytes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), buffers)


def slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows whose texts have some ``SLICE_BYTES`` together."""
    sizes = np.diff(np.frombuffer(batch.column(name).cast(pa.large_binary()).buffers()[1], np.int64)[: len(batch) + 1])
    share = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(batch)]
    for begin, end in zip(edges, edges[1:], strict=False):
        if end > begin:
            yield batch.slice(begin, end - begin)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stripe of the empty prefix, by language, merged as far as a task holds it."""

    def merged(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(["lang", "word"], use_threads=False)
        return sums.aggregate([("f", "sum")]).select(["lang", "word", "f_sum"]).rename_columns(["lang", "word", "f"])

    def out(table: pa.Table) -> list[pa.RecordBatch]:
        word = table["word"].cast(pa.large_string()).cast(pa.string())
        return table.set_column(1, "word", word).combine_chunks().to_batches()

    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            lang = part.column("lang").take(pa.array(words.text))
            counts = pa.table({"lang": lang, "word": words.bytes}).group_by(["lang", "word"], use_threads=False)
            held.append(counts.aggregate([([], "count_all")]).select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "f"]))
            rows += len(held[-1])
            if rows > CELLS_HELD:
                held = [merged(held)]
                rows = len(held[0])
                if rows > CELLS_HELD // 2:
                    yield from out(held[0])
                    held, rows = [], 0
    if held:
        yield from out(merged(held))


def _as_numbers(known, last: bool) -> Callable:
    """Looks words up among those of one pass. The last pass gives the lists that the levels read: -1 stands
    once wherever a phrase cannot go on."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers_of: dict[str, dict[bytes, int]] = pickle.loads(known.value)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                before = part.column("ids")
                ids = np.full(len(words.text), -1, np.int32)
                if before.null_count < len(before):
                    ids[:] = before.flatten().to_numpy()
                each = words.bytes.dictionary_encode()
                codes, distinct = each.indices.to_numpy(), each.dictionary
                langs = part.column("lang").dictionary_encode()
                of_word = langs.indices.to_numpy()[words.text]
                for code, lang in enumerate(langs.dictionary.to_pylist()):
                    own = np.flatnonzero(of_word == code)
                    number = numbers_of.get(lang)
                    if number is None or not len(own):
                        continue
                    there = np.unique(codes[own])
                    got = np.full(len(distinct), -1, np.int32)
                    found = [number.get(w, -1) for w in distinct.take(pa.array(there)).to_pylist()]
                    got[there] = found
                    ids[own] = np.maximum(ids[own], got[codes[own]])
                n_words = np.bincount(words.text, minlength=len(part)).astype(np.int64)
                owner = words.text
                if last:
                    ids, owner = _without_gaps(ids, owner, words.piece)
                edges = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))
                if last:
                    arrays, names = [part.column("lang"), pa.array(n_words), lists], ["lang", "n", "ids"]
                else:
                    arrays, names = [part.column("lang"), part.column("text"), lists], ["lang", "text", "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return encode


def _without_gaps(ids: np.ndarray, owner: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-1 where a piece ends; of several -1 in a row one stays, and none before or after all words."""
    if not len(ids):
        return ids, owner
    ends = np.concatenate([[0], (piece[1:] != piece[:-1]).astype(np.int64)])
    places = np.arange(len(ids)) + np.cumsum(ends)
    out = np.full(int(places[-1]) + 1, -1, np.int32)
    owners = np.zeros(len(out), owner.dtype)
    out[places], owners[places] = ids, owner
    owners[places[ends == 1] - 1] = owner[ends == 1]
    again = (out == -1) & np.concatenate([[True], (out[:-1] == -1) | (owners[1:] != owners[:-1])])
    return out[~again], owners[~again]


def _summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal cells merged."""
    if not len(cells):
        return cells, counts
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.add.reduceat(counts, first)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.ListArray]:
    """Lists with some ``SLICE_NUMBERS`` numbers together."""
    for batch in batches:
        lists = batch.column("ids")
        share = lists.offsets.to_numpy()[:-1] // SLICE_NUMBERS
        edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(lists)]
        for begin, end in zip(edges, edges[1:], strict=False):
            if end > begin:
                yield lists.slice(begin, end - begin)


def _stripes(phrases, words: int, deals: int, deal: int) -> Callable:
    """Stripes of prefixes of ``words`` words. ``phrases`` has for 2 to ``words`` words the cells (prefix number, next
    word) in order and the number of each phrase."""

    def out(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        prefix, following = (cells >> 32).astype(np.int32), (cells & 0xFFFFFFFF).astype(np.int32)
        bucket = following % BUCKETS
        order = np.lexsort((following, bucket, prefix))
        prefix, bucket, following = prefix[order], bucket[order], following[order]
        new = (prefix[1:] != prefix[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(np.concatenate([[True], new]))
        edges = pa.array(np.append(first, len(cells)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(v)) for v in (following, counts[order])]
        arrays = [pa.array(prefix[first]), pa.array(bucket[first]), *lists]
        return pa.RecordBatch.from_arrays(arrays, names=["prefix", "bucket", "next", "f"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[tuple[np.ndarray, np.ndarray]] = pickle.loads(phrases.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for lists in _shares(batches):
            lengths = np.diff(lists.offsets.to_numpy())
            # -1 between lists, and enough of them behind the last
            at = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)
            flat = np.full(int(lengths.sum()) + len(lengths) + words + 1, -1, np.int64)
            flat[at] = lists.flatten().to_numpy()
            at = np.flatnonzero((flat >= 0) & (flat % deals == deal))
            number = flat[at]
            for length, (cells, numbers) in enumerate(levels, 1):
                more = flat[at + length] >= 0
                at, number = at[more], number[more]
                cell = number << 32 | flat[at + length]
                place = np.minimum(np.searchsorted(cells, cell), max(len(cells) - 1, 0))
                there = cells[place] == cell if len(cells) else np.zeros(len(cell), bool)
                at, number = at[there], numbers[place[there]].astype(np.int64)
            more = flat[at + words] >= 0
            if deals == 1:  # what follows the first word must be a phrase as well
                phrase = np.zeros(len(flat) + 1, bool)
                phrase[at] = True
                more &= phrase[at + 1]
            cells = number[more] << 32 | flat[at[more] + words]
            held.append(_summed(cells, np.ones(len(cells), np.int64)))
            rows += len(held[-1][0])
            if rows > CELLS_HELD:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                rows = len(held[0][0])
                if rows > CELLS_HELD // 2:
                    yield out(*held[0])
                    held, rows = [], 0
        if rows:
            yield out(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    return build


def _merged(min_count: int) -> Callable:
    """Stripes arrive by prefix and bucket; equal ones are added up, and entries from ``min_count`` on stay.
    Of a key that goes on in the next batch only its sum is held."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(of: slice) -> pa.RecordBatch:
            kept = counts[of] >= min_count
            cell, f = cells[of][kept], counts[of][kept]
            arrays = [pa.array((cell >> 32).astype(np.int32)), pa.array((cell & 0xFFFFFFFF).astype(np.int32)), pa.array(f)]
            return pa.RecordBatch.from_arrays(arrays, names=["prefix", "next", "f"])

        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column("next")
            lengths = np.diff(lists.offsets.to_numpy())
            prefix = np.repeat(batch.column("prefix").to_numpy().astype(np.int64), lengths)
            new = prefix << 32 | lists.flatten().to_numpy()
            f = batch.column("f").flatten().to_numpy()
            cells, counts = _summed(np.append(cells, new), np.append(counts, f))
            last_prefix, last_bucket = (int(batch.column(c)[-1].as_py()) for c in ("prefix", "bucket"))
            open_ = ((cells >> 32) == last_prefix) & ((cells & 0xFFFFFFFF) % BUCKETS == last_bucket)
            order = np.argsort(open_, kind="stable")
            cells, counts = cells[order], counts[order]
            done = len(cells) - int(open_.sum())
            yield out(slice(0, done))
            cells, counts = cells[done:], counts[done:]
        yield out(slice(0, len(cells)))

    return merge


def numbered(rows: DataFrame, folder: str, name: str, key: list[str]) -> DataFrame:
    """The rows with an ``id`` from 0 without gaps, written: each task numbers some ``NUMBERED`` rows."""
    rows = stored(rows, folder, f"{name}-rows")
    total = rows.count()
    if total >= 1 << 31:
        raise ValueError("too many frequent phrases for 31-bit numbers; raise min_count")
    parts = max(1, math.ceil(total / NUMBERED))
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("part")
    sizes = dict(rows.groupBy(part).count().collect())
    bases, base = [], 0
    for number in range(parts):
        bases.append((number, base))
        base += sizes.get(number, 0)
    bases = rows.sparkSession.createDataFrame(bases, "part int, base long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1
    ids = rows.select("*", part).withColumn("place", place).join(bases, "part")
    ids = ids.withColumn("id", (F.col("base") + F.col("place")).cast("int"))
    return stored(ids.drop("part", "base", "place"), folder, name)


def word_numbers(docs: DataFrame, folder: str, min_count: int) -> DataFrame:
    """``id, lang, phrase, f``: words that occur ``min_count`` times in a language."""
    counts = docs.mapInArrow(_counted, "lang string, word string, f long")
    counts = counts.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    frequent = counts.where(F.col("f") >= min_count).withColumnRenamed("word", "phrase")
    return numbered(frequent, folder, "words", ["lang", "phrase"])


def as_lists(docs: DataFrame, words: DataFrame, folder: str, held: int = WORDS_HELD) -> DataFrame:
    """``lang, n, ids``: texts as lists of word numbers, and how many words there are in all."""
    passes = max(1, math.ceil(words.count() / held))
    rows = docs.select("lang", "text", F.lit(None).cast("array<int>").alias("ids"))
    for number in range(passes):
        some = words.where(F.pmod("id", F.lit(passes)) == number).select("lang", "phrase", "id").toArrow()
        known: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(*(some[c].to_pylist() for c in ("lang", "phrase", "id")), strict=True):
            known.setdefault(lang, {})[word.encode("utf-8", "surrogatepass")] = i
        last = number == passes - 1
        schema = "lang string, n long, ids array<int>" if last else "lang string, text string, ids array<int>"
        rows = stored(rows.mapInArrow(_as_numbers(by_value(docs, known), last), schema), folder, f"lists-{number}")
    return rows


def level(
    lists: DataFrame, below: list[DataFrame], folder: str, min_count: int, held: int = PHRASES_HELD
) -> DataFrame:
    """``id, prefix, next, first, lang, phrase, f``: phrases of one word more than the last of ``below``."""
    length = len(below)
    deals = max(1, math.ceil(sum(b.count() for b in below[1:]) / held))
    found = None
    for deal in range(deals):
        levels = []
        for phrases in below[1:]:
            own = phrases.where(F.pmod("first", F.lit(deals)) == deal).select("prefix", "next", "id").toArrow()
            cells = own["prefix"].to_numpy().astype(np.int64) << 32 | own["next"].to_numpy()
            order = np.argsort(cells)
            levels.append((cells[order], own["id"].to_numpy()[order].astype(np.int32)))
        build = _stripes(by_value(lists, levels), length, deals, deal)
        stripes = lists.select("ids").mapInArrow(build, "prefix int, bucket int, next array<int>, f array<long>")
        stripes = stripes.repartition("prefix", "bucket").sortWithinPartitions("prefix", "bucket")
        entries = stripes.mapInArrow(_merged(min_count), "prefix int, next int, f long")
        found = entries if found is None else found.unionByName(entries)
    entries = numbered(found, folder, f"entries-{length + 1}", ["prefix", "next"])
    prefixes = below[-1].select(
        F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"),
        F.col("first" if length > 1 else "id").alias("first"),
    )
    words = below[0].select(F.col("id").alias("next"), F.col("phrase").alias("word"))
    named = entries.join(prefixes, "prefix").join(words, "next")
    phrase = F.concat_ws(" ", "head", "word").alias("phrase")
    return stored(named.select("id", "prefix", "next", "first", "lang", phrase, "f"), folder, f"phrases-{length + 1}")


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(18,0)")


def scored(levels: list[DataFrame], totals: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score``: every candidate at its lowest-scoring cut."""
    entries, candidates = levels[0].select("lang", "phrase", "f"), None
    for length, phrases in enumerate(levels[1:], 2):
        entries = entries.unionByName(phrases.select("lang", "phrase", "f"))
        own = phrases.select("lang", "phrase", F.col("f").alias("a"), F.lit(length).alias("words"))
        candidates = own if candidates is None else candidates.unionByName(own)
    k = F.col("k")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns(
        {
            "head": F.call_function("substring_index", F.col("phrase"), F.lit(" "), k),
            "tail": F.call_function("substring_index", F.col("phrase"), F.lit(" "), k - F.col("words")),
        }
    )
    heads = entries.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = entries.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    # both products have 36 digits at most, three more for the thousand
    product = (_whole("a") * _whole("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    score = F.call_function("div", product.cast("decimal(38,0)"), (_whole("l") * _whole("r")).cast("decimal(38,0)"))
    best = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "words", "a", "n").agg(best).select(
        "lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def extension_maxima(levels: list[DataFrame]) -> DataFrame:
    """``lang, phrase, longer``: the largest count of a phrase with one word more at either end. Longer ones
    are no more frequent than one of these."""
    both = None
    for length, phrases in enumerate(levels[2:], 3):
        head = F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.lit(length - 1))
        tail = F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.lit(1 - length))
        ends = phrases.select("lang", F.explode(F.array(head, tail)).alias("phrase"), "f")
        both = ends if both is None else both.unionByName(ends)
    return both.groupBy("lang", "phrase").agg(F.max("f").alias("longer")) if both is not None else None


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    subsumed: int = SUBSUMED,
    words_held: int = WORDS_HELD,
    phrases_held: int = PHRASES_HELD,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    folder = shared_folder(docs.sparkSession, "collocations")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    docs = docs.select(lang, F.concat(text_of(), F.lit("\n")).alias("text"))
    levels = [word_numbers(docs, folder, min_count)]
    lists = as_lists(docs, levels[0], folder, words_held)
    while len(levels) < max_words:
        levels.append(level(lists, levels, folder, min_count, phrases_held))
    candidates = scored(levels, lists.groupBy("lang").agg(F.sum("n").alias("n")))
    longer = extension_maxima(levels)
    if longer is not None:
        kept = F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a"))
        candidates = candidates.join(longer, ["lang", "phrase"], "left").where(kept)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
