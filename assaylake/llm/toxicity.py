"""Toxicity by class-conditional Kneser-Ney models.

One bigram model is fitted for toxic and one for ordinary documents, over every word and pair of the labelled
documents (``whole_models``). Near copies count as one document. The models discount their counts, back off from pairs to how many words a word follows, and from there to
counts of the words over all documents, which they share. The difference of the two mean log-likelihoods per word is
drowned by the many expressions that are in one class by chance, so it is set beside that of models
that smooth only the expressions whose documents are spread over the classes otherwise than by chance (``fit_model``): words, and pairs by their own
documents, whatever their words do alone; to these a rare or evenly spread expression is as
likely in one class as in the other. A document's score is the logistic of a weighted sum of both differences, the
weights learnt from labelled documents that the counts have not seen.

All labelled documents are learnt from. Near copies are found by bands of their sketches and joins. The whole
models are tables: the most frequent expressions (``FREQUENT``) are broadcast, and documents are joined with the others. What is
bounded is the expressions that the second models hold (``MAX_WORDS``, ``MAX_PAIRS``), which are broadcast; the others
count towards their back-off. Calibration counts documents by steps of the differences. Words are counted over the whole corpus by Spark, summed in every task first.

Defined results: a null text is empty; a text without words has difference zero and so the score of
the calibration there; labels that are null are not learnt from; a document labelled twice counts
twice; without labels of both classes every score is the share of toxic labels, or 0 without any;
repeated rows get equal scores; an empty table gives an empty result; other columns play no part.
"""

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import by_value, text_of
from assaylake.llm.simhash import components
from assaylake.llm.word_hash import WordHasher, joined, letters
from assaylake.sources.shared import shared_folder, stored

#: One in so many labelled documents calibrates the score instead of being counted.
CALIBRATE_ONE_IN = 4
#: Words and pairs of words that the models hold: those whose documents are spread over the classes
#: otherwise than by chance, by the likelihood-ratio statistic, the most telling ones.
MAX_WORDS, MAX_PAIRS, MIN_TELLS = 100_000, 100_000, 20.0
#: Numbers of a text's sketch, of a band of it, and the share of equal ones that makes two texts near copies.
SKETCH, BAND, ALIKE = 64, 4, 0.5
#: Occurrences are summed as whole numbers of such parts, so that sums do not depend on their order.
PARTS = 1 << 20
DISCOUNT = 0.75
#: Words that a task holds while it counts; what is equal among them is sent once.
HELD = 1 << 20
#: Differences per word are calibrated on a scale that is linear below this and logarithmic above,
#: as one expression weighs less the longer its text is.
LINEAR = 1e-4
#: Rows of a few numbers each that are broadcast at most instead of shuffling the texts that they belong to.
FEW = 1_000_000
#: Steps of that scale to which calibration counts documents, so that the driver gets a bounded table.
STEPS = 4096
#: Expressions of the whole models that are sent to all tasks instead of shuffling where they occur.
FREQUENT = 1 << 18
#: Log-likelihoods are summed as whole numbers of such parts, so that sums do not depend on their order.
UNIT = 1 << 20
SEED = 5
#: Tell a word by itself and one that stands before another from each other and from pairs.
_ALONE, _BEFORE = 0x1D8E4E27C47D124F, 0x2545F4914F6CDD1D
_MIX = np.uint64(0x9E3779B97F4A7C15)

HASHER = WordHasher(letters())


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document is kept from learning labels; a null doc_id counts as an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(folds)) == fold


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, out: Column, per_class: int
) -> DataFrame:
    """``doc_id, text, label`` of at most ``per_class`` labelled documents of each class."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~out)
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    picked = [
        known.where(F.col(label) == value)
        .select("doc_id", F.lit(value).alias("label"))
        .orderBy(*order)
        .limit(per_class)
        for value in (0, 1)
    ]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    return docs.select("doc_id", text_of().alias("text")).join(ids, "doc_id")


def labelled(docs: DataFrame, labels: DataFrame, label: str, out: Column) -> DataFrame:
    """``doc_id, text, label`` of all documents with a label that may be learnt from; texts are only shuffled
    where labels are too many to be sent around."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~out)
    known = known.select("doc_id", F.col(label).cast("int").alias("label"))
    return docs.select("doc_id", text_of().alias("text")).join(_sent_if_few(known), "doc_id")


def _sent_if_few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def pair_hashes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return before * _MIX + after


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MinHash sketches of the pairs of neighbouring words of whole texts."""
    odd = np.random.default_rng(SEED).integers(0, 2**63, SKETCH, dtype=np.uint64) * 2 + 1
    for batch in batches:
        sketches = np.full((batch.num_rows, SKETCH), 2**32 - 1, np.uint32)
        for raw, starts, owners in joined(batch.column("text").to_pylist()):
            _, hashes, piece, follows = words_in(raw, starts)
            if not len(hashes):
                continue
            before = np.where(follows, np.roll(hashes, 1), 0)
            pairs = pair_hashes(before, hashes)
            pairs ^= pairs >> np.uint64(31)
            owner = owners[piece]
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            for k in range(SKETCH):
                least = np.minimum.reduceat((pairs * odd[k]) >> np.uint64(32), at)
                sketches[owner[at], k] = np.minimum(sketches[owner[at], k], least)
        columns = [batch.column("text_hash"), batch.column("label")]
        columns.append(pa.array([row.tobytes() for row in sketches], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=["text_hash", "label", "sketch"])


def _near_links(sketches: DataFrame) -> DataFrame:
    """``a, b``: of texts with an equal band of their sketches each with the least, if they are near copies.
    A band has as many links as texts, however many copies there are."""
    width = 4 * BAND
    bands = [
        F.xxhash64(F.lit(at), F.substring("sketch", at * width + 1, width))
        for at in range(SKETCH // BAND)
    ]
    banded = sketches.select("text_hash", F.explode(F.array(*bands)).alias("band"))
    least = banded.groupBy("band").agg(F.min("text_hash").alias("b"), F.count(F.lit(1)).alias("n"))
    least = least.where("n > 1").drop("n")
    links = banded.join(least, "band").where(F.col("text_hash") > F.col("b"))
    links = links.select(F.col("text_hash").alias("a"), "b").distinct()
    for end in ("a", "b"):
        known = sketches.select(F.col("text_hash").alias(end), F.col("sketch").alias(f"sketch_{end}"))
        links = links.join(known, end)
    equal = sum(
        (
            (F.substring("sketch_a", 4 * k + 1, 4) == F.substring("sketch_b", 4 * k + 1, 4)).cast("int")
            for k in range(SKETCH)
        ),
        F.lit(0),
    )
    return links.where(equal >= ALIKE * SKETCH).select("a", "b")


def _near_copies(sample: DataFrame, folder: str) -> tuple[DataFrame, tuple[int, int]]:
    """The sample with ``near``, a number for all copies and near copies of a text, null where there are
    none, and ``parts``, what an occurrence counts, as they share one; and how many documents each class
    has then."""
    keyed = sample.select("text", "label", F.xxhash64("text").alias("text_hash"))
    sketched = keyed.mapInArrow(_sketches, "text_hash long, label int, sketch binary")
    sketched = sketched.groupBy("text_hash", "label").agg(
        F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")
    )
    sketched = stored(sketched, folder, "sketches")
    texts = sketched.select("text_hash", "sketch").dropDuplicates(["text_hash"])
    roots = components(_near_links(texts), f"{folder}/near")
    grouped = sketched.drop("sketch").join(roots, F.col("text_hash") == F.col("fp"), "left")
    grouped = grouped.select(
        "text_hash", "label", "copies", F.coalesce("root", "text_hash").alias("near")
    )
    sizes = grouped.groupBy("near", "label").agg(F.sum("copies").alias("size"))
    found = {r.label: r["count"] for r in sizes.groupBy("label").count().collect()}
    numbers = grouped.join(sizes, ["near", "label"]).select(
        "text_hash",
        "label",
        F.when(F.col("size") > 1, F.shiftrightunsigned("near", 1)).alias("near"),
        F.floor(F.lit(PARTS) / F.col("size")).alias("parts"),
    )
    numbers = stored(numbers, folder, "numbers")
    few = numbers.count() <= FEW
    sample = keyed.join(F.broadcast(numbers) if few else numbers, ["text_hash", "label"]).drop("text_hash")
    if not few:  # it is read several times
        sample = stored(sample, folder, "texts")
    return sample, tuple(found.get(v, 0) for v in (0, 1))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Some ``HELD`` words at a time: their hashes, those of the words before them, which have one, and class,
    near copies, parts and number of their text."""
    held: list[tuple[np.ndarray, ...]] = []
    size = first = 0
    for batch in batches:
        labels = batch.column("label").to_numpy()
        nears = batch.column("near").fill_null(-1).to_numpy()
        parts = batch.column("parts").to_numpy()
        for raw, starts, owners in joined(batch.column("text").to_pylist()):
            _, hashes, piece, follows = words_in(raw, starts)
            owner = owners[piece]
            before = np.where(follows, np.roll(hashes, 1), np.uint64(0))
            held.append((hashes, before, follows, labels[owner], nears[owner], parts[owner], owner + first))
            size += len(hashes)
            if size >= HELD:
                yield [np.concatenate(c) for c in zip(*held)]
                held, size = [], 0
        first += batch.num_rows
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def _spread(
    keys: np.ndarray, label: np.ndarray, near: np.ndarray, owner: np.ndarray
) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """Occurrences in the order of ``key`` and ``near``, where a new pair of these begins, and of each pair
    the texts by class."""
    order = np.lexsort((owner, near, keys))
    keys, label, near, owner = keys[order], label[order], near[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (near[1:] != near[:-1])
    another = new.copy()
    another[1:] |= owner[1:] != owner[:-1]
    at = np.flatnonzero(new)
    columns = {
        "key": pa.array(keys[at].view(np.int64)),
        "near": pa.array(near[at], mask=near[at] < 0),
    }
    for v in (0, 1):
        columns[f"docs{v}"] = pa.array(np.add.reduceat((another & (label == v)).astype(np.int64), at))
    return order, at, columns


def _record(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by group of near copies: in how many texts of each class, and how often after another word."""
    for w, _, follows, label, near, _, owner in _occurrences(batches):
        order, at, columns = _spread(w, label, near, owner)
        for v in (0, 1):
            after = (follows & (label == v))[order].astype(np.int64)
            columns[f"after{v}"] = pa.array(np.add.reduceat(after, at))
        yield _record(columns)


def _pairs(words: Broadcast) -> Callable:
    """Pairs of neighbouring words by group of near copies: in how many texts of each class, and the place
    of the second word among ``words``. A pair travels as one hash, as it is looked up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, u, follows, label, near, _, owner in _occurrences(batches):
            if not follows.any():
                continue
            w, u, label, near, owner = (x[follows] for x in (w, u, label, near, owner))
            order, at, columns = _spread(pair_hashes(u, w), label, near, owner)
            place, known = _find(words.value, w[order][at])
            columns["place"] = pa.array(place.astype(np.int32), mask=~known)
            yield _record(columns)

    return count


def _parts_of(held: Broadcast, of_pairs: bool) -> Callable:
    """What the occurrences of some pairs, or of all pairs that begin with some words, count in each class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, u, follows, label, _, parts, _ in _occurrences(batches):
            at, known = _find(held.value, pair_hashes(u, w) if of_pairs else u)
            known &= follows
            at, u, w, label, parts = (x[known] for x in (at, u, w, label, parts))
            if not len(at):
                continue
            place, first = np.unique(at, return_index=True)
            columns = {"place": pa.array(place.astype(np.int32))}
            if of_pairs:
                columns |= {"u": pa.array(u[first].view(np.int64)), "w": pa.array(w[first].view(np.int64))}
            for v in (0, 1):  # whole numbers below 2^53, so exact
                sums = np.bincount(at, np.where(label == v, parts, 0), place[-1] + 1)[place]
                columns[f"n{v}"] = pa.array(sums.astype(np.int64))
            yield _record(columns)

    return count


def words_in(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Begins, hashes and pieces of words, and which follow another word of their piece."""
    begins, _, hashes = HASHER.words(raw)
    piece = np.searchsorted(starts, begins, side="right") - 1
    follows = np.zeros(len(piece), bool)
    follows[1:] = piece[1:] == piece[:-1]
    return begins, hashes, piece, follows


@dataclass
class Model:
    """Both models over shared hashes; arrays with two columns are by class."""

    words: np.ndarray
    word_p: np.ndarray
    unheld_p: np.ndarray
    contexts: np.ndarray
    context_n: np.ndarray
    back_off: np.ndarray
    pairs: np.ndarray
    pair_n: np.ndarray

    def differences(self, hashes: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Per word, the log-likelihood under the toxic less that under the ordinary model."""
        at, known = _find(self.words, hashes)
        p = np.where(known[:, None], self.word_p[at], self.unheld_p) if len(self.words) else (
            np.tile(self.unheld_p, (len(hashes), 1))
        )
        in_pairs, held = _find(self.pairs, pair_hashes(hashes[:-1], hashes[1:]))
        second = np.flatnonzero(held & follows[1:]) + 1
        if len(second):  # other pairs back off to the word, with a weight that both models share
            context = _find(self.contexts, hashes[second - 1])[0]
            seen = self.pair_n[in_pairs[second - 1]]
            total = self.context_n[context]
            p[second] = np.where(
                total > 0,
                (np.maximum(seen - DISCOUNT, 0) + self.back_off[context] * p[second])
                / np.maximum(total, 1),
                p[second],
            )
        logs = np.log(p)
        return logs[:, 1] - logs[:, 0]


def _find(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


def _expressions(
    rows: DataFrame, documents: tuple[int, int], after: str, *more: str
) -> DataFrame:
    """Telling expressions by ``key``, those whose documents are spread over the classes otherwise than by chance:
    ``tells`` is twice the log-likelihood ratio of their document counts. The others are summed up without a key.
    ``k0`` and ``k1`` are the expressions of each class that stand after a word, by the columns ``more``."""
    sums = [F.sum(c).alias(c) for c in dict.fromkeys(["docs0", "docs1", f"{after}0", f"{after}1"])]
    kept = [F.max(c).alias(c) for c in more]
    # dealt out once for both groupings, as near copies in other batches count once for all
    rows = rows.repartition("key").groupBy("key", "near").agg(*sums, *kept)
    single = F.col("near").isNull()
    docs = [
        F.sum(F.when(single, F.col(f"docs{v}")).otherwise((F.col(f"docs{v}") > 0).cast("long")))
        for v in (0, 1)
    ]
    rows = rows.groupBy("key").agg(
        *[docs[v].alias(f"docs{v}") for v in (0, 1)],
        *[F.max(F.col(f"{after}{v}") > 0).cast("long").alias(f"k{v}") for v in (0, 1)],
        *kept,
    )
    found = [F.col(f"docs{v}").cast("double") for v in (0, 1)]
    expected = [(found[0] + found[1]) * n / sum(documents) for n in documents]
    ratio = sum(
        (F.when(d > 0, d * F.log(d / e)).otherwise(0.0) for d, e in zip(found, expected)),
        F.lit(0.0),
    )
    rows = rows.withColumn("tells", 2 * ratio)
    telling = F.when(F.col("tells") >= MIN_TELLS, F.col("key")).alias("key")
    return rows.groupBy(telling, *more).agg(
        F.max("tells").alias("tells"), F.sum("k0").alias("k0"), F.sum("k1").alias("k1")
    )


def _most_telling(expressions: DataFrame, most: int) -> np.ndarray:
    """Hashes of the most telling expressions, ascending."""
    telling = expressions.where(F.col("key").isNotNull()).orderBy(F.desc("tells"), "key").limit(most)
    return np.sort(_unsigned(telling.select("key").toArrow(), "key"))


def _summed(rows: DataFrame, *keys: str) -> pa.Table:
    """What parts add up to, as numbers of occurrences, by ascending place."""
    n = [(F.sum(f"n{v}") / PARTS).alias(f"n{v}") for v in (0, 1)]
    return rows.groupBy("place", *keys).agg(*n).orderBy("place", *keys).toArrow()


def _unsigned(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().view(np.uint64)


def _two(table: pa.Table, name: str) -> np.ndarray:
    return np.stack([table[f"{name}{v}"].to_numpy().astype(float) for v in (0, 1)], axis=1)


def _corpus_counts(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each model word, and any word, stands in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        counts, total = np.zeros(len(words), np.int64), 0
        for batch in batches:
            for raw, _, _ in joined(batch.column("text").to_pylist()):
                hashes = HASHER.words(raw)[2]
                at, known = _find(words, hashes)
                counts += np.bincount(at[known], minlength=len(words))
                total += len(hashes)
        used = np.flatnonzero(counts)
        places, numbers = np.append(used, -1), np.append(counts[used], total)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(numbers)], names=["at", "n"])

    texts = docs.select(text_of().alias("text"))
    found = texts.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out, total = np.zeros(len(words)), 1
    table = found.toArrow()
    for at, n in zip(table["at"].to_pylist(), table["n"].to_pylist(), strict=True):
        if at < 0:
            total = max(n, 1)
        else:
            out[at] = n
    return out, total


def fit_model(docs: DataFrame, sample: DataFrame, folder: str) -> Model:
    """The models from all rows of ``sample(text, label)``, with shared counts from all ``docs``.

    Copies and near copies of a text are counted as one. A word of the telling ones has the
    probability of its class; any other has the shared one in both models.
    """
    sample, per_class = _near_copies(sample.select("text", "label"), folder)
    return _fit_telling(docs, sample, per_class, folder)


def _fit_telling(docs: DataFrame, sample: DataFrame, per_class: tuple[int, int], folder: str) -> Model:
    broadcast = docs.sparkSession.sparkContext.broadcast

    columns = "key long, near long, docs0 long, docs1 long"
    words = sample.mapInArrow(_words, f"{columns}, after0 long, after1 long")
    words = stored(_expressions(words, per_class, "after"), folder, "words")
    held = _most_telling(words, MAX_WORDS)
    kinds = _total(words)

    pairs = sample.mapInArrow(_pairs(broadcast(held)), f"{columns}, place int")
    pairs = stored(_expressions(pairs, per_class, "docs", "place"), folder, "pairs")
    whole = _total(pairs)
    followed = pairs.where("place is not null").groupBy("place").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
    followed = followed.toArrow()
    held_k = np.zeros((len(held), 2))
    held_k[followed["place"].to_numpy()] = _two(followed, "k")

    phrases = broadcast(_most_telling(pairs, MAX_PAIRS))
    kind = "place int, u long, w long, n0 long, n1 long"
    phrases = _summed(sample.mapInArrow(_parts_of(phrases, True), kind), "u", "w")
    before, after = _unsigned(phrases, "u"), _unsigned(phrases, "w")
    pair_n = _two(phrases, "n")
    contexts = np.unique(before)
    context = sample.mapInArrow(_parts_of(broadcast(contexts), False), "place int, n0 long, n1 long")
    context_n = _two(_summed(context), "n")
    discounted = np.zeros_like(context_n)
    np.add.at(discounted, _find(contexts, before)[0], np.maximum(pair_n - DISCOUNT, 0))
    by_hash = np.argsort(pair_hashes(before, after))

    hashes = np.unique(np.concatenate([held, after]))
    in_corpus, corpus_total = _corpus_counts(docs, hashes)
    shared = ((in_corpus + 0.5) / (corpus_total + 0.5 * len(hashes) + 1))[:, None]
    word_p = np.repeat(shared, 2, axis=1)
    tells = _find(hashes, held)[0]
    kept = np.maximum(held_k - DISCOUNT, 0)
    word_p[tells] = (kept + DISCOUNT * kinds * shared[tells]) / whole
    return Model(
        hashes,
        word_p,
        np.full(2, 1 / (corpus_total + 1)),
        contexts,
        context_n,
        np.maximum(context_n - discounted, 1e-9),
        pair_hashes(before, after)[by_hash],
        pair_n[by_hash],
    )


def _class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring words and what their occurrences count in each class."""
    for w, u, follows, label, _, parts, _ in _occurrences(batches):
        if not follows.any():
            continue
        w, u, label, parts = (x[follows] for x in (w, u, label, parts))
        order = np.lexsort((w, u))
        w, u, label, parts = (x[order] for x in (w, u, label, parts))
        at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (u[1:] != u[:-1])))
        columns = {"u": pa.array(u[at].view(np.int64)), "w": pa.array(w[at].view(np.int64))}
        for v in (0, 1):
            columns[f"n{v}"] = pa.array(np.add.reduceat(np.where(label == v, parts, 0), at))
        yield _record(columns)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they occur, summed over some ``HELD`` of them."""
    held, size = [], 0
    for batch in batches:
        for raw, _, _ in joined(batch.column("text").to_pylist()):
            held.append(HASHER.words(raw)[2])
            size += len(held[-1])
            if size >= HELD:
                yield _counted(np.concatenate(held))
                held, size = [], 0
    if size:
        yield _counted(np.concatenate(held))


def _counted(hashes: np.ndarray) -> pa.RecordBatch:
    words, counts = np.unique(hashes, return_counts=True)
    return _record({"w": pa.array(words.view(np.int64)), "n": pa.array(counts)})


@dataclass
class WholeModels:
    """What expressions add to the difference of the log-likelihoods, in parts of ``UNIT``: ``table`` has
    ``key, value`` of all, ``keys`` and ``values`` the most frequent ones, ``unseen`` is that of a word that is
    in neither class. A pair adds to what its words do."""

    table: DataFrame
    keys: np.ndarray
    values: np.ndarray
    unseen: int


def _pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return ((u << np.uint64(21)) | (u >> np.uint64(43))) ^ w


def whole_models(docs: DataFrame, sample: DataFrame, corpus_words: float, folder: str) -> WholeModels:
    """Both models over every word and pair of ``sample(text, label, near, parts)``: discounted counts of pairs,
    what the discounts leave goes to the words by how many words they follow in the class, and what is left
    there to their counts among the ``corpus_words`` words of all ``docs``."""
    pairs = sample.mapInArrow(_class_pairs, "u long, w long, n0 long, n1 long")
    pairs = pairs.groupBy("u", "w").agg(*[F.sum(f"n{v}").alias(f"n{v}") for v in (0, 1)])
    pairs = stored(pairs, folder, "whole-pairs")
    less = F.lit(int(DISCOUNT * PARTS)).cast("long")
    contexts = pairs.groupBy("u").agg(
        *[F.sum(f"n{v}").alias(f"total{v}") for v in (0, 1)],
        *[F.sum(F.least(F.col(f"n{v}"), less)).alias(f"left{v}") for v in (0, 1)],
    )
    words = pairs.groupBy("w").agg(*[F.count_if(F.col(f"n{v}") > 0).alias(f"k{v}") for v in (0, 1)])
    corpus = docs.select(text_of().alias("text")).mapInArrow(_word_counts, "w long, n long")
    words = words.join(corpus.groupBy("w").agg(F.sum("n").alias("n")), "w", "left")
    words = stored(words, folder, "whole-words")

    known = words.agg(F.count(F.lit(1)), *[f(F.col(f"k{v}")) for v in (0, 1) for f in (F.sum, _some)]).first()
    kinds = [max(known[2 + 2 * v] or 0, 1) for v in (0, 1)]
    whole = [max(known[1 + 2 * v] or 0, 1) for v in (0, 1)]
    rest = [DISCOUNT * kinds[v] / whole[v] for v in (0, 1)]
    unseen = float(np.log(rest[1]) - np.log(rest[0]))
    shared = (F.coalesce("n", F.lit(0)) + 0.5) / (corpus_words + 0.5 * known[0] + 1)
    words = words.select(
        "w",
        F.coalesce("n", F.lit(0)).cast("double").alias("often"),
        *[(F.greatest(F.col(f"k{v}") - DISCOUNT, F.lit(0.0)) / whole[v] + rest[v] * shared).alias(f"p{v}") for v in (0, 1)],
    )
    # without a document of the class that has the word before, all goes to the words
    weight = [
        F.when(F.col(f"total{v}") > 0, F.col(f"left{v}") / F.col(f"total{v}")).otherwise(1.0) for v in (0, 1)
    ]
    pair = [
        F.when(
            F.col(f"total{v}") > 0,
            F.greatest(F.col(f"n{v}") - less, F.lit(0)) / F.col(f"total{v}") + weight[v] * F.col(f"p{v}"),
        ).otherwise(F.col(f"p{v}"))
        for v in (0, 1)
    ]
    backed_off = _log_ratio(weight) + _log_ratio([F.col("p0"), F.col("p1")])
    rows = [
        words.select(_key("w", _ALONE), _log_ratio([F.col("p0"), F.col("p1")], unseen), "often"),
        contexts.select(_key("u", _BEFORE), _log_ratio(weight), (F.col("total0") + F.col("total1")) / PARTS),
        pairs.join(contexts, "u").join(words.drop("often"), "w").select(
            F.shiftleft("u", 21).bitwiseOR(F.shiftrightunsigned("u", 43)).bitwiseXOR(F.col("w")),
            _log_ratio(pair) - backed_off,
            (F.col("n0") + F.col("n1")) / PARTS,
        ),
    ]
    rows = [r.toDF("key", "value", "often") for r in rows]
    table = rows[0].unionByName(rows[1]).unionByName(rows[2])
    table = table.select("key", F.round(F.col("value") * UNIT).cast("long").alias("value"), "often")
    table = stored(table, folder, "whole")
    often = table.orderBy(F.desc("often"), "key").limit(FREQUENT).select("key", "value").toArrow()
    keys, values = _unsigned(often, "key"), often["value"].to_numpy()
    order = np.argsort(keys)
    return WholeModels(table.select("key", "value"), keys[order], values[order], round(unseen * UNIT))


def _some(counts: Column) -> Column:
    return F.count_if(counts > 0)


def _key(word: str, kind: int) -> Column:
    return F.col(word).bitwiseXOR(F.lit(kind).cast("long"))


def _log_ratio(p: list[Column], less: float = 0.0) -> Column:
    return F.log(p[1]) - F.log(p[0]) - less


def both_differences(docs: DataFrame, model: Model, whole: WholeModels, carried: list[str]) -> DataFrame:
    """Carried columns of ``docs(..., text)`` with ``difference``, the mean over a text's words by the telling
    expressions, and ``whole``, that by all of them. A row's expressions are joined with the table
    under a number of the row, which is its own."""
    sent = by_value(docs, (model, whole.keys, whole.values, whole.unseen))
    fields = [docs.schema[c] for c in carried]

    def expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, values, unseen = pickle.loads(sent.value)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            means, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            known_sum = np.zeros(batch.num_rows)
            for raw, starts, owners in joined(batch.column("text").to_pylist()):
                _, hashes, piece, follows = words_in(raw, starts)
                if not len(hashes):
                    continue
                owner = owners[piece]
                means += np.bincount(owner, model.differences(hashes, follows), batch.num_rows)
                words += np.bincount(owner, minlength=batch.num_rows)
                second = np.flatnonzero(follows)
                u, w, own = hashes[second - 1], hashes[second], owner[second]
                key = np.concatenate([hashes ^ np.uint64(_ALONE), u ^ np.uint64(_BEFORE), _pair_keys(u, w)])
                own = np.concatenate([owner, own, own])
                at, known = _find(keys, key)
                if known.any():  # whole numbers below 2^53, so exact
                    known_sum += np.bincount(own[known], values[at[known]], batch.num_rows)
                yield from _expression_rows(key[~known], own[~known] + first, carried, batch)
            row = np.arange(batch.num_rows) + first
            sums = known_sum.astype(np.int64) + unseen * words
            columns = [batch.column(c) for c in carried]
            columns += [pa.array(row), pa.array(_spread_keys(row)), pa.array(sums), pa.array(means), pa.array(words)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "row", "key", "n", "means", "words"])
            first += batch.num_rows

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried]
    kinds += ["row long", "key long", "n long", "means double", "words long"]
    rows = docs.select(*carried, "text").mapInArrow(expressions, ", ".join(kinds))
    rows = rows.join(whole.table, "key", "left")
    value = F.when(F.col("words").isNotNull(), F.col("n")).otherwise(F.col("n") * F.coalesce("value", F.lit(0)))
    summed = rows.groupBy("row").agg(
        *[F.max(f.name).alias(f.name) for f in fields],
        F.sum(value).alias("sum"),
        F.max("means").alias("means"),
        F.max("words").alias("words"),
    )
    words = F.greatest("words", F.lit(1))
    return summed.select(
        *carried, (F.col("means") / words).alias("difference"), (F.col("sum") / UNIT / words).alias("whole")
    )


def _spread_keys(row: np.ndarray) -> np.ndarray:
    """Keys that deal out the rows of documents, which meet no expression."""
    return (row.astype(np.uint64) * _MIX).view(np.int64)


def _expression_rows(key: np.ndarray, row: np.ndarray, carried: list[str], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """How often each expression occurs in each row."""
    if not len(key):
        return
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
    n = np.diff(np.append(at, len(key)))
    nulls = [pa.nulls(len(at), batch.schema.field(c).type) for c in carried]
    columns = [*nulls, pa.array(row[at]), pa.array(key[at].view(np.int64)), pa.array(n)]
    columns += [pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=[*carried, "row", "key", "n", "means", "words"])


def _total(expressions: DataFrame) -> np.ndarray:
    """By class, the different expressions that stand after a word, telling or not; one at least."""
    row = expressions.agg(F.sum("k0"), F.sum("k1")).first()
    return np.maximum(np.array([x or 0 for x in row], float), 1)


def mean_differences(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """Carried columns of ``docs(..., text)`` with ``difference``, the mean over a text's words."""
    sent = by_value(docs, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for batch in batches:
            means = text_means(model, batch.column("text").to_pylist())
            columns = [batch.column(c) for c in carried] + [pa.array(means)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "difference"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried]
    return docs.select(*carried, "text").mapInArrow(score, ", ".join([*kinds, "difference double"]))


def text_means(model: Model, texts: list[str]) -> np.ndarray:
    sums, words = np.zeros(len(texts)), np.zeros(len(texts))
    for raw, starts, owners in joined(texts):
        _, hashes, piece, follows = words_in(raw, starts)
        if not len(hashes):
            continue
        owner = owners[piece]
        sums += np.bincount(owner, model.differences(hashes, follows), len(texts))
        words += np.bincount(owner, minlength=len(texts))
    return sums / np.maximum(words, 1)


def calibrate(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, n: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, slopes and offset of a logistic curve over ``n`` documents at each row of ``x`` and ``y``, by Newton
    steps with a light ridge."""
    centre = np.average(x, axis=0, weights=n)
    spread = np.sqrt(np.average((x - centre) ** 2, axis=0, weights=n))
    spread[spread == 0] = 1.0
    weight = n * weight
    z = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    beta, slopes = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 1e-2 * beta * slopes
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(np.where(slopes > 0, 1e-2, 1e-6))
        beta -= np.linalg.solve(curve, gradient)
    return centre, beta[:-1] / spread, float(beta[-1])


def score(
    docs: DataFrame, labels: DataFrame, out: Callable[[Column], Column], label: str = "toxic"
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``. ``out`` tells from a doc_id
    whether labels of the document must not be learnt from."""
    folder = shared_folder(docs.sparkSession, "toxicity")
    texts = docs.select("doc_id", text_of().alias("text"))
    sample = labelled(docs, labels, label, out(F.col("doc_id")))
    sample = stored(sample, folder, "sample")
    rates = {
        r[0]: r[1]
        for r in labels.where(~out(F.col("doc_id")) & F.col(label).isin(0, 1))
        .groupBy(label)
        .count()
        .collect()
    }
    if len(rates) < 2 or sample.select("label").distinct().count() < 2:
        share = rates.get(1, 0) / max(sum(rates.values()), 1)
        scored = texts.select("doc_id", F.lit(float(share)).alias("score"))
    else:
        calibrates = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(CALIBRATE_ONE_IN)) == 0
        learnt, per_class = _near_copies(sample.where(~calibrates).select("text", "label"), folder)
        model = _fit_telling(docs, learnt, per_class, folder)
        corpus_words = 1 / model.unheld_p[0] - 1
        whole = whole_models(docs, learnt, corpus_words, folder)
        # the telling difference, and what all other expressions add to it
        sides = [F.asinh(F.col("difference") / LINEAR), F.col("whole") - F.col("difference")]
        steps = [F.round(side * STEPS).cast("long").alias(f"step{k}") for k, side in enumerate(sides)]
        seen = both_differences(sample.where(calibrates), model, whole, ["label"])
        seen = seen.groupBy("label", *steps).count().orderBy("label", "step0", "step1").toArrow()
        centre, slope, offset = np.zeros(2), np.zeros(2), float(np.log(rates[1] / rates[0]))
        if seen.num_rows:
            x = np.stack([seen[f"step{k}"].to_numpy().astype(float) / STEPS for k in (0, 1)], axis=1)
            y, n = (seen[c].to_numpy().astype(float) for c in ("label", "count"))
            toxic = float(n @ y)
            weight = np.where(y == 1, rates[1] / max(toxic, 1), rates[0] / max(n.sum() - toxic, 1))
            weight /= np.average(weight, weights=n)
            centre, slope, offset = calibrate(x, y, weight, n)
        odds = F.lit(float(offset))
        for side, at, by in zip(sides, centre, slope, strict=True):
            odds = odds + (side - float(at)) * float(by)
        scored = both_differences(texts, model, whole, ["doc_id"]).select(
            "doc_id", (1 / (1 + F.exp(-odds))).alias("score")
        )
    return scored.select(
        "doc_id",
        out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
