"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage of the whole text is measured and encoded,
a gated attention layer weighs the passages, and the weighted mean of their encodings is scored.
Only documents have labels, so the weights are learnt from these alone: what makes a
document bad may stand in one passage.

The network is small and is fitted in the driver on a bounded sample (``PER_CLASS`` documents of each
label, with all their passages; fewer documents where these would be more than ``FIT_PASSAGES`` in a
class); its weights are broadcast and every
document is scored from all its passages, in Arrow batches without a shuffle.

Defined results: a null text is empty; a text without words is one passage of zeros; labels that are
null are not learnt from; a document labelled twice counts twice; without labels of both classes
every score is the share of good labels, or 0 without any; a text beyond a megabyte is cut into parts at
white space, and a passage ends where a part does; repeated rows get equal scores; an empty table
gives an empty result; other columns play no part.
"""

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import by_value, text_of
from assaylake.llm.quality_rules import STOP_WORDS
from assaylake.llm.toxicity import labelled_sample
from assaylake.llm.word_hash import WordHasher, joined, visible
from assaylake.sources.shared import shared_folder, stored

PASSAGE = 64
#: Labelled documents of each class that are learnt from, and passages of them together.
PER_CLASS, FIT_PASSAGES = 2000, 128_000
ENCODED, GATED = 24, 12
STEPS, RATE, DECAY = 200, 0.02, 1e-4
SEED = 9

HASHER = WordHasher(visible())
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _byte_class(members: bytes | range) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(members)] = 1
    return table


#: Kinds of bytes whose shares are measured.
BYTE_CLASSES = (
    _byte_class(range(97, 123)),
    _byte_class(range(65, 91)),
    _byte_class(range(48, 58)),
    _byte_class(b".,;:?'\"()-"),
    _byte_class(b"!"),
    _byte_class(b"#*$%&|<>"),
    _byte_class(b"@/\\_=+^~`[]{}"),
    _byte_class(range(128, 256)),
    _byte_class(b"\n"),
)
FEATURES = len(BYTE_CLASSES) + 8


def _stop_hashes() -> np.ndarray:
    hashes = [HASHER.words(np.frombuffer(w.encode(), np.uint8))[2][0] for w in STOP_WORDS]
    return np.unique(np.array(hashes, np.uint64))


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys have stood before."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What is measured of every passage, a row each, and the text that it is of, in text order."""
    stop = _stop_hashes()
    rows, of_text = [], []
    for raw, starts, owners in joined(texts):
        begins, lengths, hashes = HASHER.words(raw)
        if not len(begins):
            continue
        piece = np.searchsorted(starts, begins, side="right") - 1
        first = np.searchsorted(piece, np.arange(len(starts)))
        in_piece = np.arange(len(begins)) - first[piece]
        at = np.flatnonzero(in_piece % PASSAGE == 0)
        passage = np.cumsum(in_piece % PASSAGE == 0) - 1
        words = np.diff(np.append(at, len(begins))).astype(float)
        mean = lambda values: np.add.reduceat(values.astype(float), at) / words
        # from a text's first byte to its last one, whatever stands beside it
        opens = in_piece[at] == 0
        from_byte = np.where(opens, starts[piece[at]], begins[at])
        ends = np.append(starts[1:], len(raw)) - 1
        to_byte = np.where(np.append(opens[1:], True), ends[piece[at]], np.append(from_byte[1:], 0))
        text_bytes = np.maximum(to_byte - from_byte, 1)
        sums = [np.concatenate([[0], np.cumsum(c[raw])]) for c in BYTE_CLASSES]
        shares = [(total[to_byte] - total[from_byte]) / text_bytes for total in sums]
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (piece[1:] == piece[:-1])
        windows = np.zeros(len(hashes), bool)
        if len(hashes) > 2:
            keys = hashes[:-2] * _MIX + hashes[1:-1] * (_MIX ^ np.uint64(1 << 40)) + hashes[2:]
            own = piece[:-2] == piece[2:]
            keys = keys + piece[:-2].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            windows[np.flatnonzero(own)] = _repeats(keys[own])
        is_stop = stop[np.minimum(np.searchsorted(stop, hashes), len(stop) - 1)] == hashes
        in_passage = hashes + passage.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.bincount(piece, minlength=len(starts))[piece[at]]
        measured = [
            words / PASSAGE,
            np.log1p(mean(lengths)),
            mean(lengths <= 1),
            mean(same),
            mean(_repeats(in_passage)),
            mean(windows),
            mean(is_stop),
            np.log1p(total),
            *shares,
        ]
        rows.append(np.stack(measured, axis=1))
        of_text.append(owners[piece[at]])
    found = np.concatenate(of_text) if of_text else np.zeros(0, np.int64)
    values = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
    missing = np.setdiff1d(np.arange(len(texts)), found)
    of_all = np.concatenate([found, missing])
    order = np.argsort(of_all, kind="stable")
    values = np.concatenate([values, np.zeros((len(missing), FEATURES))])
    return values[order], of_all[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """Encoder, gated attention and scorer; ``centre`` and ``spread`` scale what is measured."""

    centre: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, values: np.ndarray) -> "Network":
        rng = np.random.default_rng(SEED)

        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        weights = {
            "encode": draw(FEATURES, ENCODED),
            "encode_0": np.zeros(ENCODED),
            "content": draw(ENCODED, GATED),
            "content_0": np.zeros(GATED),
            "gate": draw(ENCODED, GATED),
            "gate_0": np.zeros(GATED),
            "attend": draw(GATED),
            "score": draw(ENCODED),
            "score_0": np.zeros(1),
        }
        return cls(values.mean(axis=0), values.std(axis=0) + 1e-3, weights)

    def forward(self, values: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for passages ``values``; ``bag`` numbers their documents from 0, in order."""
        w = self.weights
        x = np.clip((values - self.centre) / self.spread, -8, 8)
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        content = np.tanh(h @ w["content"] + w["content_0"])
        gate = _sigmoid(h @ w["gate"] + w["gate_0"])
        raw = (content * gate) @ w["attend"]
        begins = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
        raw = np.exp(raw - np.maximum.reduceat(raw, begins)[bag])
        attention = raw / np.add.reduceat(raw, begins)[bag]
        mean = np.add.reduceat(attention[:, None] * h, begins)
        logit = mean @ w["score"] + w["score_0"]
        return {
            "x": x, "h": h, "content": content, "gate": gate, "attention": attention,
            "mean": mean, "begins": begins, "p": _sigmoid(logit),
        }

    def gradients(
        self, values: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray
    ) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy of the documents."""
        w, f = self.weights, self.forward(values, bag)
        h, content, gate, attention = f["h"], f["content"], f["gate"], f["attention"]
        d_logit = weight * (f["p"] - y)
        d_mean = (d_logit[:, None] * w["score"])[bag]
        d_attention = (d_mean * h).sum(axis=1)
        within = np.add.reduceat(attention * d_attention, f["begins"])[bag]
        d_raw = attention * (d_attention - within)
        d_both = d_raw[:, None] * w["attend"]
        d_content = d_both * gate * (1 - content**2)
        d_gate = d_both * content * gate * (1 - gate)
        d_h = attention[:, None] * d_mean + d_content @ w["content"].T + d_gate @ w["gate"].T
        d_in = d_h * (1 - h**2)
        return {
            "encode": f["x"].T @ d_in,
            "encode_0": d_in.sum(axis=0),
            "content": h.T @ d_content,
            "content_0": d_content.sum(axis=0),
            "gate": h.T @ d_gate,
            "gate_0": d_gate.sum(axis=0),
            "attend": (content * gate).T @ d_raw,
            "score": f["mean"].T @ d_logit,
            "score_0": np.array([d_logit.sum()]),
        }

    def fit(self, values: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Adam over the whole sample, with a rate that falls to zero."""
        weight = weight / weight.sum()
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, STEPS + 1):
            for k, g in self.gradients(values, bag, y, weight).items():
                g = g + DECAY * self.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                self.weights[k] = self.weights[k] - RATE * (1 - step / (STEPS + 1)) * move

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        values, bag = passages(texts)
        return self.forward(values, bag)["p"]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every labelled text, all passages as one flat array, and how many."""
    for batch in batches:
        values, bag = passages(batch.column("text").to_pylist())
        ends = np.searchsorted(bag, np.arange(batch.num_rows), "right")
        offsets = np.append(0, ends)
        columns = [
            batch.column("doc_id"),
            batch.column("label"),
            pa.ListArray.from_arrays(
                pa.array((offsets * FEATURES).astype(np.int32)), pa.array(values.ravel())
            ),
            pa.array(np.diff(offsets)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "values", "n"])


def _that_fit(measured: DataFrame, most: int) -> DataFrame:
    """``doc_id, label`` of documents whose passages are at most so many in a class together, by a
    hash of the doc_id; the shortest one where none fits."""
    sizes = measured.groupBy("doc_id", "label").agg(F.sum("n").alias("n"))
    sizes = sizes.orderBy("label", F.xxhash64("doc_id", F.lit(SEED)), "doc_id").toArrow()
    labels, n = sizes["label"].to_numpy(), sizes["n"].to_numpy()
    taken = np.zeros(len(labels), bool)
    for label in np.unique(labels):
        of_class, left = np.flatnonzero(labels == label), most
        for at in of_class:
            taken[at] = n[at] <= left
            left -= n[at] * taken[at]
        if not taken[of_class].any():
            taken[of_class[np.argmin(n[of_class])]] = True
    picked = sizes.filter(pa.array(taken)).select(["doc_id", "label"])
    return measured.sparkSession.createDataFrame(picked)


def fit(sample: DataFrame, rates: dict[int, int], folder: str) -> Network:
    """A network from ``sample(doc_id, text, label)``; documents weigh as their class is labelled."""
    kinds = "doc_id long, label int, values array<double>, n long"
    measured = stored(sample.mapInArrow(_measured, kinds), folder, "measured")
    picked = F.broadcast(_that_fit(measured, FIT_PASSAGES))
    rows = measured.join(picked, ["doc_id", "label"], "left_semi").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    lists = rows["values"].combine_chunks()
    y = rows["label"].to_numpy().astype(float)
    values = lists.flatten().to_numpy().reshape(-1, FEATURES)
    bag = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy() // FEATURES)
    weight = np.where(y == 1, rates[1] / max(y.sum(), 1), rates[0] / max((1 - y).sum(), 1))
    network = Network.fresh(values)
    network.fit(values, bag, y, weight)
    return network


def score(
    docs: DataFrame, labels: DataFrame, out: Callable[[Column], Column], label: str = "quality"
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``. ``out`` tells from a doc_id
    whether labels of the document must not be learnt from."""
    spark, held_out = docs.sparkSession, out(F.col("doc_id"))
    sample = labelled_sample(docs, labels, label, held_out, PER_CLASS)
    folder = shared_folder(spark, "passages")
    sample = stored(sample, folder, "sample")
    known = labels.where(~held_out & F.col(label).isin(0, 1)).groupBy(label).count().collect()
    rates = {r[0]: r[1] for r in known}
    texts = docs.select("doc_id", text_of().alias("text"))
    if len(rates) < 2 or sample.select("label").distinct().count() < 2:
        share = rates.get(1, 0) / max(sum(rates.values()), 1)
        scored = texts.select("doc_id", F.lit(float(share)).alias("score"))
    else:
        sent = by_value(docs, fit(sample, rates, folder))

        def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            network = pickle.loads(sent.value)
            for batch in batches:
                values = pa.array(network.scores(batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), values], names=["doc_id", "score"]
                )

        scored = texts.mapInArrow(score_batches, "doc_id long, score double")
    return scored.select(
        "doc_id",
        out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
