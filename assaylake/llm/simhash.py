"""SimHash near-duplicates: fingerprints linked by small Hamming distance through vantage points.

A vantage point and a radius split fingerprints into those inside and those outside. A pair within
``LINK_BITS`` can only straddle the boundary if its inner member lies less than that far from it, so
inner fingerprints of this shell are copied to the outer side; every linked pair then meets in a
leaf (triangle inequality), and no other branch has to be looked at. The top of the tree is fitted
on a bounded sample and spreads the fingerprints over shards. Shards with more than ``MAX_IN_TASK`` get a
further part of the tree each, fitted by tasks on samples of their own, until none is left; a smaller
shard goes on splitting in its task. A leaf gives the links of a spanning forest and not all pairs.

Fingerprints that distance cannot tell apart, since a split would leave nearly all on one side, are
linked through the 65 words within one bit of them instead, however many they are.
Two fingerprints within two bits share such a word, and all that share one are within two bits, so
the words' groups are exact and hold at most 65 members.

Components of links are found by Spark jobs that pass the smallest member along; nothing but the
bounded sample reaches the driver.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; a null
doc_id is never the smallest, and a component without any other id has component_id null; repeated
rows stay repeated; an empty table gives an empty result; other columns are carried through whatever
their names.
"""

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import ID_KEY, ROW, boxed, by_value, id_key, text_of
from assaylake.sources.shared import shared_folder, stored

SHINGLE, SEED, BITS = 3, 42, 64
LINK_BITS = 2
#: Distinct fingerprints that fit the top of the tree; at most this many reach the driver.
SAMPLE = 1 << 16
#: Fingerprints meant for a shard, and the most shards that the top of the tree makes.
SHARD, TOP_SHARDS = 8192, 4096
#: A shard with more fingerprints than this is not one task's work.
MAX_IN_TASK = 64 * 1024
#: Fingerprints that fit the further part of a large shard's tree, the shards that it makes at most, and
#: large shards whose parts are broadcast at a time.
PART_SAMPLE, PART_SHARDS, PARTS_HELD = 4096, 64, 4096
#: A shard that keeps more than this share of what it was cut from is not cut again.
LEFT = 0.95
#: Fingerprints that a task compares pair by pair.
LEAF = 256
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15
#: What to flip in a fingerprint to get the words within one bit of it.
WITHIN_ONE_BIT = np.concatenate(
    [np.zeros(1, np.uint64), np.uint64(1) << np.arange(BITS, dtype=np.uint64)]
)


def fingerprint(text: str) -> int:
    """The SimHash of the three-word shingles of a whole text, A to Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - SHINGLE + 1, 1)
    ends = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends.tolist())), np.uint64, n
    )
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        block = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * set_bits > n, bitorder="little")
    return int(majority.view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_py()) for t in batch.column("text")]
        signed = pa.array(np.array(values, np.uint64).view(np.int64))
        columns = [batch.column("doc_id"), batch.column("text_hash"), signed]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` of whole texts, fingerprints as signed 64-bit numbers."""
    return docs.select(
        "doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text")
    ).mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@dataclass(frozen=True)
class Node:
    """An inner node: fingerprints within ``radius`` of ``vantage`` go inside."""

    vantage: np.uint64
    radius: int
    inside: "Node | int"
    outside: "Node | int"


def _split(fps: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point, radius and all distances, or none if copying the shell gains nothing.

    The point is the first of the fingerprints; the radius is the one that leaves the fewest
    comparisons on both sides.
    """
    distance = np.bitwise_count(fps ^ fps[0])
    upto = np.cumsum(np.bincount(distance, minlength=BITS + 1))
    shell = upto - np.concatenate([np.zeros(LINK_BITS, upto.dtype), upto[:-LINK_BITS]])
    inside, outside = upto, len(fps) - upto + shell
    cost = inside.astype(float) ** 2 + outside.astype(float) ** 2
    cost[inside == 0] = np.inf
    radius = int(np.argmin(cost))
    if cost[radius] > 0.9 * float(len(fps)) ** 2:
        return None
    return fps[0], radius, distance


def _sides(distance: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return distance <= radius, distance > radius - LINK_BITS


def fit_top(sample: np.ndarray, shards: int) -> Node | int:
    """The top of the tree over a shuffled sample, with leaves numbered from 0."""
    leaves = 0

    def build(part: np.ndarray, wanted: float) -> Node | int:
        nonlocal leaves
        found = _split(part) if wanted > 1 and len(part) >= 32 else None
        if found is None:
            leaves += 1
            return leaves - 1
        vantage, radius, distance = found
        inside, outside = _sides(distance, radius)
        a, b = part[inside], part[outside]
        whole = len(a) + len(b)
        return Node(
            vantage, radius, build(a, wanted * len(a) / whole), build(b, wanted * len(b) / whole)
        )

    return build(sample, shards)


def _place(node: Node | int, fps: np.ndarray, out: list, base: int) -> None:
    """Fingerprints with each leaf below the node that they belong or are copied to."""
    if not len(fps):
        return
    if isinstance(node, int):
        out.append((np.full(len(fps), base + node, np.int64), fps))
        return
    inside, outside = _sides(np.bitwise_count(fps ^ node.vantage), node.radius)
    _place(node.inside, fps[inside], out, base)
    _place(node.outside, fps[outside], out, base)


def _routed(parts: Broadcast) -> Callable:
    """Rows of ``shard, fp`` with the shards that parts of the tree, by shard, make of them."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(parts.value)
        for batch in batches:
            out: list = []
            shards = batch.column("shard").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            order = np.argsort(shards, kind="stable")
            found, begins = np.unique(shards[order], return_index=True)
            for shard, mine in zip(found.tolist(), np.split(fps[order], begins[1:]), strict=True):
                _place(trees[shard][0], mine, out, trees[shard][1])
            for shard, fps in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(fps.view(np.int64))], names=["shard", "fp"]
                )

    return route


def _fitted(shard: pa.Table) -> pa.Table:
    """The further part of a large shard's tree, by its sample; none if distance cannot split it."""
    fps = np.random.default_rng(SEED).permutation(np.unique(shard["fp"].to_numpy().view(np.uint64)))
    tree = fit_top(fps, shard["wanted"][0].as_py())
    tree = None if isinstance(tree, int) else cloudpickle.dumps(tree)
    return pa.table({"shard": shard["shard"][:1], "tree": pa.array([tree], pa.binary())})


def _leaves(node: Node | int) -> int:
    return 1 if isinstance(node, int) else _leaves(node.inside) + _leaves(node.outside)


class Forest:
    """Union-find over positions; joins that succeed are the links of a spanning forest."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def spanning_links(fps: np.ndarray, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Links that connect whatever is connected within ``LINK_BITS``: the rest of the tree, depth
    first; fingerprints that distance cannot split are linked through shared words."""
    forest, links = Forest(len(fps)), []

    def compare(at: np.ndarray) -> None:
        part = fps[at]
        near = np.bitwise_count(part[:, None] ^ part[None, :]) <= LINK_BITS
        add(at, *np.triu(near, 1).nonzero())

    def share_words(at: np.ndarray) -> None:
        words = (fps[at][:, None] ^ WITHIN_ONE_BIT[None, :]).ravel()
        order = np.argsort(words, kind="stable")
        equal = (words[order[1:]] == words[order[:-1]]).nonzero()[0]
        width = len(WITHIN_ONE_BIT)
        add(at, order[equal] // width, order[equal + 1] // width)

    def add(at: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        for i, j in zip(at[first].tolist(), at[second].tolist(), strict=True):
            if forest.join(i, j):
                links.append((i, j))

    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        found = _split(fps[at]) if len(at) > leaf else None
        if len(at) <= leaf:
            compare(at)
        elif found is None:
            share_words(at)
        else:
            inside, outside = _sides(found[2], found[1])
            todo += [at[inside], at[outside]]
    return links


def _shard_links(shard: pa.Table) -> pa.Table:
    fps = shard["fp"].to_numpy().view(np.uint64)
    fps = np.random.default_rng(SEED).permutation(np.unique(fps))
    links = np.array(spanning_links(fps), np.int64).reshape(-1, 2)
    ends = fps.view(np.int64)[links]
    return pa.table({"a": ends[:, 0], "b": ends[:, 1]})


def _word_links(fps: DataFrame) -> DataFrame:
    """Links of fingerprints through the words within one bit of them."""
    one_bit = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)),
    )
    words = fps.select("fp", F.explode(F.concat(F.array("fp"), one_bit)).alias("word"))
    hubs = words.groupBy("word").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
    return hubs.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")


def near_links(
    fps: DataFrame,
    folder: str,
    sample: int = SAMPLE,
    shard: int = SHARD,
    max_in_task: int = MAX_IN_TASK,
) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that connect whatever is within
    ``LINK_BITS``."""
    total = max(fps.count(), 1)
    picked = fps.where(F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(total)) < sample).toArrow()
    shuffled = np.random.default_rng(SEED).permutation(
        np.sort(picked["fp"].to_numpy().view(np.uint64))
    )
    top = fit_top(shuffled, min(TOP_SHARDS, -(-total // shard)))
    rows = fps.select(F.lit(0).cast("long").alias("shard"), "fp")
    routed = _stored_route(rows, {0: (top, 0)}, folder, "routed-0")
    links, alike, todo, turn = [], [], [(routed, {})], 0
    while todo:
        routed, cut_from = todo.pop()
        # few: each holds more than max_in_task rows
        counts = routed.groupBy("shard").count().where(F.col("count") > max_in_task)
        large = {r["shard"]: r["count"] for r in counts.collect()}
        in_task = _without(routed, list(large)).groupBy("shard")
        links.append(in_task.applyInArrow(_shard_links, "a long, b long"))
        whole = [s for s, n in large.items() if n > LEFT * cut_from.get(s, np.inf)]
        cut = sorted(set(large) - set(whole))
        for at in range(0, len(cut), PARTS_HELD):
            held = {s: large[s] for s in cut[at : at + PARTS_HELD]}
            trees = _parts(routed, held, shard)
            whole += [s for s in held if s not in trees]
            if trees:
                turn += 1
                bases = np.cumsum([0, *(_leaves(tree) for tree in trees.values())]).tolist()
                parts = {s: (tree, b) for (s, tree), b in zip(trees.items(), bases)}
                again = _stored_route(_only(routed, list(parts)), parts, folder, f"routed-{turn}")
                sizes = {
                    leaf: held[s] for s, (tree, b) in parts.items() for leaf in range(b, b + _leaves(tree))
                }
                todo.append((again, sizes))
        if whole:
            alike.append(_only(routed, whole).select("fp"))
    if alike:
        links.append(_word_links(reduce(DataFrame.unionByName, alike).distinct()))
    return stored(reduce(DataFrame.unionByName, links), folder, "links")


def _stored_route(rows: DataFrame, parts: dict, folder: str, name: str) -> DataFrame:
    return stored(rows.mapInArrow(_routed(by_value(rows, parts)), "shard long, fp long"), folder, name)


def _shards(routed: DataFrame, shards: list[int]) -> DataFrame:
    return routed.sparkSession.createDataFrame(pa.table({"shard": pa.array(shards, pa.int64())}))


def _only(routed: DataFrame, shards: list[int]) -> DataFrame:
    return routed.join(_shards(routed, shards), "shard", "left_semi")


def _without(routed: DataFrame, shards: list[int]) -> DataFrame:
    return routed.join(_shards(routed, shards), "shard", "left_anti") if shards else routed


def _parts(routed: DataFrame, sizes: dict[int, int], shard: int) -> dict[int, Node]:
    """The further parts of the tree for large shards, of those that can be split."""
    wanted = [min(PART_SHARDS, -(-n // shard)) for n in sizes.values()]
    about = pa.table({"shard": list(sizes), "size": list(sizes.values()), "wanted": wanted})
    rows = routed.join(routed.sparkSession.createDataFrame(about), "shard")
    picked = rows.where(F.pmod(F.xxhash64("fp", F.lit(SEED + 1)), "size") < PART_SAMPLE)
    fitted = picked.select("shard", "fp", "wanted").groupBy("shard")
    trees = fitted.applyInArrow(_fitted, "shard long, tree binary").where("tree is not null").collect()
    return {r["shard"]: pickle.loads(r["tree"]) for r in sorted(trees, key=lambda r: r["shard"])}


def components(links: DataFrame, folder: str) -> DataFrame:
    """``fp, root`` for every end of a link; the root is the smallest fingerprint reachable.

    Alternates between linking every neighbour beyond a node to the node's smallest neighbour and
    linking a node's smaller neighbours to the smallest, until nothing changes: then all links
    are stars. Each round is a written table.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, turn, before = stored(edges, folder, "edges-0"), 0, None
    while True:
        turn += 1
        edges = stored(_small_star(_large_star(edges)), folder, f"edges-{turn}")
        now = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))
        ).first()
        if now == before:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = now


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    least = least.select("node", F.least("node", "low").alias("low"))
    # of (node, larger neighbour), the neighbour goes to the node's smallest
    return (
        edges.join(least, F.col("b") == F.col("node"))
        .select("a", F.col("low").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    joined = edges.join(least, F.col("a") == F.col("node"))
    return (
        joined.select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("low").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                )
            ).alias("e")
        )
        .select("e.*")
        .where("a <> b")
        .distinct()
    )


def component_ids(prints: DataFrame, folder: str) -> DataFrame:
    """Written fingerprints with ``least``, the first row of their component: by doc_id, rows
    without one last."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = prints.groupBy("fp").agg(F.min(rank).alias("least"))
    distinct = stored(distinct, folder, "distinct")
    roots = components(near_links(distinct.select("fp"), folder), folder)
    members = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    members = stored(members.join(distinct, "fp"), folder, "members")
    least = members.groupBy("root").agg(F.min("least").alias("first"))
    linked = members.join(least, "root").select("fp", "first")
    each = distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("first", "least").alias("least")
    )
    return prints.join(each, "fp")


def _with_components(docs: DataFrame) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "simhash")
    prints = stored(fingerprints(docs), folder, "fingerprints")
    return component_ids(prints, folder)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    return _with_components(docs).select(
        "doc_id", hex_of(F.col("fp")).alias("fingerprint"), F.col("least.doc_id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns."""
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    stays = (
        _with_components(docs)
        .where(first & (F.col("text_hash") == F.col("least.text_hash")))
        .select("text_hash", *id_key(F.col("doc_id")))
    )
    rows = boxed(docs).select(
        ROW,
        *id_key(F.col(f"{ROW}.doc_id")),
        F.xxhash64(text_of(f"{ROW}.text")).alias("text_hash"),
    )
    key = ["text_hash", *ID_KEY]
    return rows.join(stays, key, "left_semi").dropDuplicates(key).select(f"{ROW}.*")
