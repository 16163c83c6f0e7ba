"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Documents with equal texts form a group and share a shard. Groups that are not far below a shard are
packed singly, the others in bundles by a hash of their text, so that the packer has to place a bounded
number of units whatever the input's size. It places units from the largest on, each where the dot
product of its load with the shard's residual capacity is highest; loads are shares of a shard's
capacity. Only a group above a whole shard is cut, and one without which the shards' bytes would
stay apart (``TOLERANCE``); its rows are dealt out evenly by their numbers.

Rows are numbered by their group and doc_id in cells of bounded size, cells follow each other inside
their unit and units inside their shard, so no task numbers a whole group or shard. Rows that are equal
in doc_id and text are counted before the shuffle and are interchangeable.

Defined results: a null text is empty and 16 bytes in size; empty texts are one group; doc_ids are
whole numbers, and null is one of them, behind the others; repeated rows get slots of their own; a single
document above a shard stays whole; an empty table gives an empty
result; other columns are carried through whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.llm.common import ID_KEY, ROW, WORD, boxed, id_key, text_of
from assaylake.sources.shared import shared_folder, stored

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Bundles of groups that are far below a shard.
BUNDLES = 1 << 14
#: Groups with more than this share of a shard's bytes, tokens or rows are packed singly. There are
#: at most three times SHARDS / SINGLE such groups.
SINGLE = 1 / 64
#: Share of a shard that a piece of a group has at most, if the group is above a shard.
PIECE = 1 / 4
#: Rows that one task numbers together, if their texts or doc_ids differ.
CELL_ROWS = 1 << 20
#: Bytes of a table of sets that is broadcast; 40 shards have at most some 24,000 sets, below 2 MB.
BROADCAST_BYTES = 16 << 20
#: How far a shard's bytes may be from the mean before a whole group is cut, and how many cuts are tried.
TOLERANCE, CUTS = 0.02, 32
#: Swaps tried after packing, and how much bytes, tokens and rows count in them.
SWAPS, WEIGHTS = 400, np.array([16.0, 1.0, 1.0])
LOADS = ("bytes", "tokens", "rows")
LAW = "bytes"


def pack(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit: ``loads`` has a row per unit and a column per dimension."""
    totals = loads.sum(axis=0)
    shares = loads * (shards / np.where(totals > 0, totals, 1))
    residual = np.ones((shards, loads.shape[1]))
    placed = np.zeros(len(loads), np.int32)
    for unit in np.lexsort((np.arange(len(loads)), -shares.max(axis=1))).tolist():
        shard = int(np.argmax(residual @ shares[unit]))
        residual[shard] -= shares[unit]
        placed[unit] = shard
    _swap(shares, residual, placed)
    return placed


def _swap(shares: np.ndarray, residual: np.ndarray, placed: np.ndarray) -> None:
    """Swaps units between the fullest and the emptiest shard by bytes while that makes the two
    more alike, bytes counting most."""
    for _ in range(SWAPS):
        full, empty = int(np.argmin(residual[:, 0])), int(np.argmax(residual[:, 0]))
        mine, other = (np.flatnonzero(placed == s) for s in (full, empty))
        if full == empty or not len(mine) or not len(other):
            return
        gap = residual[empty] - residual[full]
        moved = shares[mine][:, None, :] - shares[other][None, :, :]
        score = (WEIGHTS * (gap - 2 * moved) ** 2).sum(axis=2)
        i, j = np.unravel_index(int(np.argmin(score)), score.shape)
        if score[i, j] >= (WEIGHTS * gap**2).sum() * 0.999:
            return
        residual[full] += moved[i, j]
        residual[empty] -= moved[i, j]
        placed[mine[i]], placed[other[j]] = empty, full


def split_and_pack(loads: np.ndarray, single: np.ndarray, shards: int) -> tuple[np.ndarray, list]:
    """Pieces of each set of rows, and the shards of its pieces.

    ``single`` tells sets that are one group each, of which each row weighs the same; others are not cut.
    """
    rows = loads[:, LOADS.index("rows")]
    totals = np.maximum(loads.sum(axis=0), 1)
    share = (loads * shards / totals).max(axis=1)
    # a share of one shard is not above it for an error of the last digit
    cut = single & (share > 1 + 1e-9)
    pieces = np.where(cut, np.minimum(np.ceil(share / PIECE), rows), 1).astype(np.int64)
    owner, placed, filled = _packed(loads, pieces, shards)
    for _ in range(CUTS):
        mean = filled.mean()
        if filled.max() <= (1 + TOLERANCE) * mean and filled.min() >= (1 - TOLERANCE) * mean:
            break
        sizes = np.where(single & (rows >= 2 * pieces), loads[:, 0] / pieces, 0)
        crowded = np.zeros(len(loads), bool)
        crowded[owner[placed == filled.argmax()]] = True
        candidates = np.where(crowded, sizes, 0) if (sizes * crowded).any() else sizes
        # one group is cut finely before another is cut at all
        again = np.where(pieces > 1, candidates, 0)
        candidates = again if again.max() > TOLERANCE / 2 * mean else candidates
        cut = pieces.copy()
        cut[candidates.argmax()] *= 2
        tried = _packed(loads, cut, shards)
        if not candidates.any() or tried[2].std() > 0.98 * filled.std():
            break
        pieces, (owner, placed, filled) = cut, tried
    ends = np.cumsum(pieces)
    return pieces, [placed[end - n : end] for n, end in zip(pieces, ends, strict=True)]


def _packed(loads: np.ndarray, pieces: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """Owners and shards of all pieces, in order, and the bytes of each shard."""
    owner = np.repeat(np.arange(len(loads)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    rows = loads[owner, LOADS.index("rows")]
    n = pieces[owner]
    part = (_edge(nth + 1, rows, n) - _edge(nth, rows, n)) / np.maximum(rows, 1)
    shares = loads[owner] * part[:, None]
    placed = pack(shares, shards)
    return owner, placed, np.bincount(placed, shares[:, 0], shards)


def _edge(piece, rows, pieces):
    """The number of the first row of a piece, if rows are dealt out evenly."""
    return -((-piece * rows) // pieces)


#: What tells rows apart that are not interchangeable, and what they are counted by.
ROW_KEY = [*ID_KEY, "group", "bytes", "tokens", "crc"]
COUNTED_BY = [*ROW_KEY, "part"]


def _measured(rows: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    no_id, is_null = id_key(doc_id)
    number = F.monotonically_increasing_id()
    return rows.withColumns(
        {
            "_id": no_id,
            "_no_id": is_null,
            "group": F.xxhash64(text),
            "bytes": (F.octet_length(text) + ROW_BYTES).cast("long"),
            "tokens": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "crc": F.crc32(F.encode(text, "UTF-8")),
            "number": number,
            # the task that reads or wrote the row
            "part": F.shiftright(number, 33),
        }
    )


def _counted(measured: DataFrame) -> DataFrame:
    return measured.groupBy(*COUNTED_BY).agg(F.count(F.lit(1)).alias("rows"))


def _loads(counted: DataFrame, *by: str) -> DataFrame:
    rows = F.col("rows")
    return counted.groupBy(*by).agg(
        F.sum(F.col("bytes") * rows).alias("bytes"),
        F.sum(F.col("tokens") * rows).alias("tokens"),
        F.sum(rows).alias("rows"),
    )


def _with_sets(counted: DataFrame, shards: int) -> DataFrame:
    """``set``: a group that is packed singly, or a bundle. Of the former the driver holds a list."""
    totals = _loads(counted).first()
    share = F.greatest(*[F.col(k) / float(max(totals[k] or 0, 1)) for k in LOADS]) * float(shards)
    single = _loads(counted, "group").where(share > SINGLE).select("group").toArrow()
    single = single.sort_by("group")["group"].to_numpy()
    known = pa.table({"group": single, "set": -1 - np.arange(len(single))})
    return counted.join(_local(counted.sparkSession, known), "group", "left").withColumn(
        "set", F.coalesce("set", F.pmod("group", F.lit(BUNDLES)))
    )


def _local(spark: SparkSession, rows: pa.Table) -> DataFrame:
    """A table of the driver, broadcast if it is small enough: a join by set alone would bring a large
    set into one task before it is dealt out over its cells."""
    table = spark.createDataFrame(rows)
    return F.broadcast(table) if rows.nbytes <= BROADCAST_BYTES else table


def _plan(sets: pa.Table, shards: int) -> pa.Table:
    """For each set its rows and, by piece, the shard, the first row's number in the set and the
    rows that come before in the shard."""
    loads = np.stack([sets[k].to_numpy().astype(float) for k in LOADS], axis=1)
    pieces, placed = split_and_pack(loads, sets["set"].to_numpy() < 0, shards)
    filled = [0] * shards
    firsts, bases = [], []
    for n, rows, where in zip(pieces.tolist(), sets["rows"].to_pylist(), placed, strict=True):
        edges = [_edge(k, rows, n) for k in range(n + 1)]
        firsts.append(edges[:-1])
        bases.append([])
        for k, shard in enumerate(where.tolist()):
            bases[-1].append(filled[shard])
            filled[shard] += edges[k + 1] - edges[k]
    return pa.table(
        {
            "set": sets["set"],
            "set_rows": sets["rows"],
            "shards": pa.array([w.tolist() for w in placed], pa.list_(pa.int32())),
            "firsts": pa.array(firsts, pa.list_(pa.int64())),
            "bases": pa.array(bases, pa.list_(pa.int64())),
        }
    )


def _numbered(counted: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """``counted`` with ``set`` and ``first``, the number in the set of the first of its rows; and the
    sets' plan."""
    spark = counted.sparkSession
    with_sets = _with_sets(counted, shards)
    sets = _loads(with_sets, "set").toArrow().sort_by("set")
    cells = -(-sets["rows"].to_numpy() // CELL_ROWS)
    cells = _local(spark, pa.table({"set": sets["set"], "cells": cells}))
    cell = F.pmod(F.xxhash64("group", *ID_KEY), "cells")
    in_cells = with_sets.join(cells, "set").withColumn("cell", cell).drop("cells")
    before = Window.partitionBy("set").orderBy("cell")
    cell_first = (F.sum("in_cell").over(before) - F.col("in_cell")).alias("cell_first")
    firsts = in_cells.groupBy("set", "cell").agg(F.sum("rows").alias("in_cell"))
    firsts = firsts.select("set", "cell", cell_first)
    inside = Window.partitionBy("set", "cell").orderBy("group", "_no_id", *COUNTED_BY)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.sum("rows").over(inside) - F.col("rows")
    numbered = in_cells.withColumn("first", first).join(firsts, ["set", "cell"])
    numbered = numbered.withColumn("first", F.col("first") + F.col("cell_first"))
    return numbered.drop("cell", "cell_first"), _local(spark, _plan(sets, shards))


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``shard`` and ``slot`` of rows with their ``set`` and ``nth``, their number in it."""
    piece = F.expr("cast(nth * size(shards) div set_rows as int)")
    slot = F.get("bases", "piece") + F.col("nth") - F.get("firsts", "piece")
    placed = rows.join(plan, "set").withColumn("piece", piece)
    return placed.withColumns({"shard": F.get("shards", "piece"), "slot": slot})


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    measured = _measured(docs.select("doc_id", "text"), F.col("doc_id"), text_of())
    folder = shared_folder(docs.sparkSession, "sharding")
    numbered, plan = _numbered(stored(_counted(measured), folder, "counted"), shards)
    # a counted row stands for interchangeable rows of one task
    nth = F.explode(F.sequence("first", F.col("first") + F.col("rows") - 1)).alias("nth")
    return _placed(numbered.select("*", nth), plan).select(
        F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id"),
        F.col("bytes").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents with their own columns, a folder ``shard=n`` for each shard.

    ``slot`` is written beside them, or ``_slot`` if the documents have such a column. A shard's
    rows are written by as many tasks as the shuffle has for them, each in slot order. Rows are stored with
    their numbers first, so that a task that runs again sees the same ones.
    """
    measured = _measured(boxed(docs), F.col(f"{ROW}.doc_id"), text_of(f"{ROW}.text"))
    folder = shared_folder(docs.sparkSession, "sharding")
    measured = stored(measured, folder, "measured")
    numbered, plan = _numbered(stored(_counted(measured), folder, "counted"), shards)
    same = Window.partitionBy(*COUNTED_BY).orderBy("number")
    rows = measured.withColumn("nth", F.row_number().over(same) - 1)
    rows = rows.join(numbered.select(*COUNTED_BY, "set", "first"), COUNTED_BY)
    placed = _placed(rows.withColumn("nth", F.col("nth") + F.col("first")), plan)
    slot = "slot" if "slot" not in docs.columns else "_slot"
    shard = "shard" if "shard" not in docs.columns else "_shard"
    out = placed.select(f"{ROW}.*", F.col("slot").alias(slot), F.col("shard").alias(shard))
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
