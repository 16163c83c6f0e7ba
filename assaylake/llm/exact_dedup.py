"""Exact deduplication by an extendible-hash index on shared files.

Texts are keyed by a 64-bit hash. A directory over the leading key bits doubles while a bucket
holds more than its share and can still be split; owner tasks then take contiguous key ranges of
whole buckets, chain texts whose keys collide and compare their bytes. What an owner writes to the
shared folder is the index: one entry per distinct text with its digest, its number of rows and the
document that stays. Documents look their entry up by digest.

Copies are merged in every map task before the shuffle, so an owner sees a text once per batch and
not once per row, and only small rows (document and digest) are joined with the index.

Defined results: a null text is empty; empty texts are one group; a null doc_id ranks below all
others and stays only if its group has no other; a row repeated with the same doc_id and text stays
once; an empty table gives an empty result; other columns are carried through whatever their names.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import ID_KEY, ROW, boxed, id_key, text_of
from assaylake.sources.shared import shared_folder, stored

#: Bytes of distinct texts that a bucket may hold before it is split.
BUCKET_BYTES = 4 << 20
#: The directory has at most two to this power of slots: 2 MB of counts in the driver.
MAX_DEPTH = 18
#: Bytes of distinct texts for one owner task.
OWNER_BYTES = 32 << 20

ENTRY = "key long, sha string, text string, copies long, largest long, owner int"
INDEX = "text_sha256 string, chain int, group_size long, keep_id long"


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def slot_of(key: Column, depth: int) -> Column:
    """The directory slot of a key: its leading bits."""
    return F.shiftrightunsigned(key, 64 - depth)


class Directory:
    """Buckets of an extendible hash over ``2 ** MAX_DEPTH`` finest slots.

    ``begins[b]`` is the first finest slot of bucket ``b`` and ``depths[b]`` its local depth; the
    global depth is the largest local one.
    """

    def __init__(self, slot_bytes: np.ndarray, bucket_bytes: int):
        self.max_depth = max(int(len(slot_bytes)).bit_length() - 1, 0)
        self.depth = 0
        totals = np.concatenate([[0], np.cumsum(slot_bytes)])
        begins, depths = np.array([0]), np.array([0])
        while True:
            width = len(slot_bytes) >> depths
            load = totals[begins + width] - totals[begins]
            overfull = (load > bucket_bytes) & (depths < self.max_depth)
            if not overfull.any():
                break
            self.depth = max(self.depth, int(depths[overfull].max()) + 1)  # doubled if need be
            halves = begins[overfull] + (width[overfull] >> 1)
            depths[overfull] += 1
            begins = np.concatenate([begins, halves])
            depths = np.concatenate([depths, depths[overfull]])
            order = np.argsort(begins, kind="stable")
            begins, depths = begins[order], depths[order]
        self.begins, self.depths, self.loads = begins, depths, load

    def owners(self, owner_bytes: int) -> np.ndarray:
        """First finest slots of the key ranges of owner tasks: whole buckets, in key order."""
        before = np.cumsum(self.loads) - self.loads
        owner = before // max(owner_bytes, 1)
        return self.begins[np.concatenate([[True], owner[1:] != owner[:-1]])]


def build_directory(
    keyed: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH
) -> Directory:
    """Bytes of distinct keys per finest slot, counted by Spark; a bounded array in the driver."""
    distinct = keyed.groupBy("key").agg(F.max(F.octet_length("text")).alias("bytes"))
    slots = (
        distinct.groupBy(slot_of(F.col("key"), max_depth).alias("slot"))
        .agg(F.sum("bytes").alias("bytes"))
        .toArrow()
    )
    slot_bytes = np.zeros(1 << max_depth, dtype=np.int64)
    slot_bytes[slots["slot"].to_numpy()] = slots["bytes"].to_numpy()
    return Directory(slot_bytes, bucket_bytes)


def _merged_copies(ranges: np.ndarray, max_depth: int) -> Callable:
    """One entry for equal texts of a batch, with the owner of its key."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "sha", "text", "copies", "largest"]
        for batch in batches:
            merged = (
                pa.Table.from_batches([batch])
                .group_by(["key", "sha", "text"], use_threads=False)
                .aggregate([("row", "count"), ("doc_id", "max")])
                .select(["key", "sha", "text", "row_count", "doc_id_max"])
                .rename_columns(names)
            )
            slots = merged["key"].to_numpy().view(np.uint64) >> np.uint64(64 - max_depth)
            owner = np.searchsorted(ranges, slots.astype(np.int64), side="right") - 1
            merged = merged.append_column("owner", pa.array(owner.astype(np.int32)))
            yield from merged.combine_chunks().to_batches()

    return merge


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's task: entries arrive in key order; equal keys are chained, texts compared byte by
    byte. Only the chain of one key is held."""
    names = ["text_sha256", "chain", "group_size", "keep_id"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
    done: list[list] = []
    chain: list[list] = []
    current = None

    def close() -> None:
        for place, (_, sha, copies, largest) in enumerate(chain):
            done.append([sha, place, copies, largest])

    def flush() -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[] for _ in names]
        out = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(out, names=names)

    for batch in batches:
        columns = [batch.column(n) for n in ("key", "sha", "text", "copies", "largest")]
        for key, sha, text, copies, largest in zip(*columns, strict=True):
            key, text = key.as_py(), text.as_buffer()
            if key != current:
                close()
                chain, current = [], key
            found = next((e for e in chain if e[0].equals(text)), None)
            largest = largest.as_py()
            if found is None:
                chain.append([text, sha.as_py(), copies.as_py(), largest])
            else:
                found[2] += copies.as_py()
                if largest is not None and (found[3] is None or largest > found[3]):
                    found[3] = largest
        yield flush()
    close()
    yield flush()


def build_index(
    docs: DataFrame,
    folder: str,
    bucket_bytes: int = BUCKET_BYTES,
    max_depth: int = MAX_DEPTH,
    owner_bytes: int = OWNER_BYTES,
    key: Column | None = None,
) -> DataFrame:
    """The index of ``docs(doc_id, text)``, written below ``folder``: an entry per distinct text.

    ``key`` may replace the 64-bit hash of ``text``.
    """
    text = text_of()
    keyed = docs.select("doc_id", text.alias("text")).withColumn(
        "key", F.xxhash64("text") if key is None else key
    )
    directory = build_directory(keyed, bucket_bytes, max_depth)
    ranges = directory.owners(owner_bytes)
    entries = keyed.select(
        "doc_id", "key", "text", digest(F.col("text")).alias("sha"), F.lit(1).alias("row")
    ).mapInArrow(_merged_copies(ranges, max_depth), ENTRY)
    index = (
        entries.repartitionById(len(ranges), "owner")
        .sortWithinPartitions("key")
        .select("key", "sha", "text", "copies", "largest")
        .mapInArrow(_chained, INDEX)
    )
    return stored(index, folder, "index")


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows repeated with the same doc_id and text are counted together and told apart at the end.
    """
    docs = docs.select("doc_id", "text")
    index = build_index(docs, shared_folder(docs.sparkSession, "exact-dedup"))
    rows = (
        docs.select("doc_id", digest(text_of()).alias("text_sha256"))
        .groupBy("doc_id", "text_sha256")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    found = rows.join(index, "text_sha256")
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    rows = boxed(docs).select(
        ROW,
        *id_key(F.col(f"{ROW}.{doc_id}")),
        digest(text_of(f"{ROW}.{text}")).alias("text_sha256"),
    )
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    index = build_index(plain, shared_folder(docs.sparkSession, "exact-dedup"))
    stays = index.select("text_sha256", *id_key(F.col("keep_id")))
    key = ["text_sha256", *ID_KEY]
    return rows.join(stays, key, "left_semi").dropDuplicates(key).select(f"{ROW}.*")
