"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Rows are dealt by hash into shards of some ``SHARD_ROWS``. A shard keeps one list of its rows for every
dimension, in the order of that component. An anchor reads the lists in step, from the
top where its own component is positive and from the bottom where it is negative, scores every row that it
meets with its whole integer vector, and stops once no row still unseen can enter: the threshold,
the anchor's product with the components last read, is strictly below the last score that counts. Ties are
met as well, since the threshold must be below and not at it.

Two rounds of this find the anchors' positives and, in the score windows that these set, the negatives.
Each shard gives its own first rows and Spark merges them: an anchor has a few rows from each shard. Anchors are a
stated query set and travel to every shard as rows of the shuffle, in blocks of an Arrow batch, so nothing is
collected or broadcast and a task holds one shard and one batch of anchors.

Defined results: rows with a null id, label or vector or with any null or non-finite component take no
part; a vector shorter than the longest counts as zero beyond its end; a row repeated with the same
id, label and vector is one row; rows with the same id but another label or vector are rows of
their own, and none is another one's positive or negative; an anchor without positives, or a positive
without negatives, gives no row; a component is cut at the size at which a hundred scores might
leave 64 bits (``limit_of``: 92,681 at 64 dimensions); an empty table gives an empty result; other columns play no part.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.sources.shared import shared_folder, stored

SHARD_ROWS = 1 << 14
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative has this share of its positive's score, in hundredths.
LOW, HIGH = 30, 90
#: Rows of every list that are read at first; the step doubles from there.
FIRST_STEP = 64

KEY = ["anchor_id", "anchor_label", "anchor_digest"]
_FOUND = "anchor_id long, anchor_label long, anchor_digest string, "
POSITIVE_ROWS = _FOUND + "positive_id long, positive_score long"
NEGATIVE_ROWS = (
    _FOUND + "positive_rank long, positive_id long, positive_score long, "
    "negative_id long, negative_score long"
)
_POSITIVES = "array<struct<positive_rank: int, positive_id: long, positive_score: long>>"


def limit_of(dims: int) -> int:
    """Components up to this size keep a hundred times any score within 63 bits."""
    return math.isqrt((1 << 62) // (128 * max(dims, 1)))


def vectors(
    embeddings: DataFrame, label: Column, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``vec_id, label, vec``: distinct rows that take part, with integer components."""
    rows = embeddings.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.col(embedding).cast("array<double>").alias("x"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & plain_vector(F.col("x")))
    dims = F.size("x")
    limit = F.floor(F.sqrt(F.lit(float(1 << 62)) / (128 * F.greatest(dims, F.lit(1)))))
    whole = F.transform("x", lambda v: F.greatest(-limit, F.least(limit, F.floor(SCALE * v))))
    return rows.select("vec_id", "label", whole.cast("array<long>").alias("vec")).distinct()


def plain_vector(x: Column) -> Column:
    """Every component is there and finite."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite, F.lit(False))


class Shard:
    """Rows of a shard with one list per dimension, in the order of that component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray):
        self.ids, self.labels, self.vecs = ids, labels, vecs
        self.largest = int(np.abs(vecs).max(initial=0))
        self.factors = vecs.astype(np.float64)
        self.lists = np.argsort(vecs, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vecs, self.lists, axis=0)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53:  # exact
            return (self.factors[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vecs[rows] @ anchor

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Rows first met at each step with their scores, and the threshold after it."""
        n = len(self.ids)
        dims = np.flatnonzero(anchor)
        up = anchor[dims] > 0
        seen = np.zeros(n, bool)
        begin, step = 0, FIRST_STEP
        while begin < n:
            end = min(n, begin + step)
            if len(dims):
                places = np.where(up, np.arange(n - end, n - begin)[:, None], np.arange(begin, end)[:, None])
                met = self.lists[places, dims].ravel()
                fresh = np.zeros(n, bool)
                fresh[met] = True
                fresh &= ~seen
                last = self.sorted[np.where(up, n - end, end - 1), dims]
                threshold = int(last @ anchor[dims])
            else:  # all scores are zero
                fresh, threshold, end = ~seen, 0, n
            seen |= fresh
            rows = np.flatnonzero(fresh)
            yield rows, self.scores(rows, anchor), threshold
            if seen.all():
                return
            begin, step = end, 2 * step


class Best:
    """The first ``most`` rows by score, then id."""

    def __init__(self, most: int):
        self.most = most
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.most:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        if len(scores):
            scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
            order = np.lexsort((ids, -scores))[: self.most]
            self.scores, self.ids = scores[order], ids[order]

    def settled(self, threshold: int) -> bool:
        """No row below or at the threshold can still enter."""
        return len(self.scores) == self.most and threshold < self.scores[-1]


def positives_of(shard: Shard, anchor: dict, most: int) -> list[tuple]:
    best = Best(most)
    for rows, scores, threshold in shard.read(anchor["vec"]):
        own = (shard.labels[rows] == anchor["label"]) & (shard.ids[rows] != anchor["vec_id"])
        best.add(scores[own], shard.ids[rows[own]])
        if best.settled(threshold):
            break
    return list(zip(best.ids.tolist(), best.scores.tolist(), strict=True))


def negatives_of(shard: Shard, anchor: dict, most: int, low: int, high: int) -> list[tuple]:
    """The first rows of another label in the window of each of the anchor's positives."""
    windows = [(*p, Best(most)) for p in anchor["positives"] if low * p[2] <= high * p[2]]
    for rows, scores, threshold in shard.read(anchor["vec"]):
        other = (shard.labels[rows] != anchor["label"]) & (shard.ids[rows] != anchor["vec_id"])
        rows, scores = rows[other], scores[other]
        open_windows = False
        for _, _, score, best in windows:
            inside = (100 * scores >= low * score) & (100 * scores <= high * score)
            best.add(scores[inside], shard.ids[rows[inside]])
            open_windows |= not (best.settled(threshold) or 100 * threshold < low * score)
        if not open_windows:
            break
    return [
        (k, p, s, i, n)
        for k, p, s, best in windows
        for i, n in zip(best.ids.tolist(), best.scores.tolist(), strict=True)
    ]


def _per_shard(dims: int, schema: list[str], answer: Callable) -> Callable:
    """A task's rows come by shard, a shard's own rows before its anchors."""

    def padded(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("vec")
        lengths = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(lists), dims), np.int64)
        out[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy()
        return out

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
        kinds = [pa.string() if n == "anchor_digest" else pa.int64() for n in schema]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, shard = None, [], None
        for batch in batches:
            vecs = padded(batch)
            numbers, ids, labels = (batch.column(c).to_numpy() for c in ("shard", "vec_id", "label"))
            anchors = batch.column("is_anchor").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(anchors.astype(np.int8)) != 0)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)], strict=True):
                if begin == end:
                    continue
                if numbers[begin] != current:
                    current, held, shard = numbers[begin], [], None
                if not anchors[begin]:
                    held.append((ids[begin:end], labels[begin:end], vecs[begin:end]))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard, held = Shard(*map(np.concatenate, zip(*held, strict=True))), [()]
                found = []
                more = batch.slice(begin, end - begin).select(["digest", "positives"]).to_pylist()
                for i, row in zip(range(begin, end), more, strict=True):
                    positives = [tuple(p.values()) for p in row["positives"] or []]
                    anchor = {"vec_id": ids[i], "label": labels[i], "vec": vecs[i], "positives": positives}
                    key = (int(ids[i]), int(labels[i]), row["digest"])
                    found += [key + r for r in answer(shard, anchor)]
                yield out(found)

    return run


def _digest(vec: Column) -> Column:
    return F.sha2(F.array_join(vec.cast("array<string>"), ",").cast("binary"), 256)


def _asked(rows: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """Shards with all anchors behind the rows of each."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    own = rows.select(
        F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(shards)).cast("int").alias("shard"),
        F.lit(False).alias("is_anchor"), "vec_id", "label", "vec",
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast(_POSITIVES).alias("positives"),
    )
    asking = anchors.select(
        numbers.alias("shard"), F.lit(True).alias("is_anchor"), "vec_id", "label", "vec", "digest",
        F.col("positives").cast(_POSITIVES).alias("positives"),
    )
    dealt = own.unionByName(asking).repartitionById(shards, "shard")
    return dealt.sortWithinPartitions("shard", "is_anchor")


def _first(found: DataFrame, key: list[str], score: str, other: str, most: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc(score), F.asc(other))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    embeddings: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank``.

    ``is_anchor`` is over ``vec_id, label, vec``; ``label`` over the columns of ``embeddings``. For each
    of the anchor's first ``positives`` rows of its label, the first ``negatives`` rows of other labels whose score is at least
    ``low`` and at most ``high`` hundredths of the positive's.
    """
    folder = shared_folder(embeddings.sparkSession, "hard-negatives")
    rows = stored(vectors(embeddings, F.col("label") if label is None else label), folder, "rows")
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    shards = max(1, math.ceil(n / shard_rows))
    anchors = rows.where(is_anchor).select("*", _digest(F.col("vec")).alias("digest"))

    def nearest(shard: Shard, anchor: dict) -> list[tuple]:
        return positives_of(shard, anchor, positives)

    def within(shard: Shard, anchor: dict) -> list[tuple]:
        return negatives_of(shard, anchor, negatives, low, high)

    names = [*KEY, "positive_id", "positive_score"]
    asked = _asked(rows, anchors.withColumn("positives", F.lit(None)), shards)
    found = asked.mapInArrow(_per_shard(dims, names, nearest), POSITIVE_ROWS)
    near = _first(found, KEY, "positive_score", "positive_id", positives)
    ranked = F.struct(F.col("rank").alias("positive_rank"), "positive_id", "positive_score")
    own = near.groupBy(*KEY).agg(F.sort_array(F.collect_list(ranked)).alias("positives"))
    same = [anchors[a] == own[b] for a, b in zip(("vec_id", "label", "digest"), KEY, strict=True)]
    asking = anchors.join(own, same).select("vec_id", "label", "vec", "digest", "positives")
    asking = stored(asking, folder, "asking")
    names = [*KEY, "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = _asked(rows, asking, shards).mapInArrow(_per_shard(dims, names, within), NEGATIVE_ROWS)
    ranked = _first(found, [*KEY, "positive_rank"], "negative_score", "negative_id", negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
        F.col("positive_rank").cast("int").alias("positive_rank"),
    )
