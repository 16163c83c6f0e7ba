"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions alone.

A chat service that logs a conversation after every answer logs each state as a conversation of its
own. Turns get rolling prefix hashes, each the hash before it combined with a hash of the turn's
place, role and text; a conversation whose whole hash is a proper prefix of another one is a snapshot of it
and goes by an anti-join, and of equal conversations the one with the smallest conv_id stays. What is
maximal is rendered with role marks.

A turn is a row throughout. Turns are ordered by a range partitioning, which deals a long conversation
out over many tasks; each task hashes the turns of its own range, and what came before a range is one
small row. The hashes are combined by exclusive or, so that ranges add up, and are 256 bits wide; a turn's own
hash is SHA-256. Hashes, without texts, are merged map side first, and prefixes are distinct, so neither a
common first turn nor a conversation logged many times is one task's work. Only turns of
conversations that stay are gathered, into the one row that their rendering is.

Defined results: turns are ordered by turn, role and text, nulls first, and a turn repeated in all
three counts once; a null role or text is empty; a turn without a conv_id is a conversation of its
own, whose conv_id stays null; of equal conversations one with a conv_id is preferred; a
conversation never hides itself; marks inside a text are broken up by a space; an empty table gives
an empty result; other columns play no part.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import id_key
from assaylake.sources.shared import shared_folder, stored

# The marks around a turn.
TURN_BEGIN, TURN_END, MARK, BROKEN_MARK = "<|im_start|>", "<|im_end|>", "<|", "< |"

#: Characters of a role or text by which ranges are chosen: whole ones would go to the driver as samples.
RANGE_CHARS = 256

CONVERSATION = ["_no_id", "_id", "alone"]
#: The four parts of a prefix hash.
HASH = ["h0", "h1", "h2", "h3"]


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(BROKEN_MARK))


def _rendered(role: str, text: str) -> Column:
    """A turn between role marks."""
    return F.concat(
        F.lit(TURN_BEGIN), _plain(F.col(role)), F.lit("\n"), _plain(F.col(text)), F.lit(TURN_END + "\n")
    )


def ordered(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``number``, which grows in their order, and ``part``, a range of them.

    ``alone`` tells turns without a conv_id apart and is -1 for all others.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)
    once = turns.select(
        *id_key(F.col("conv_id")),
        alone.alias("alone"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    short = F.length("role") <= RANGE_CHARS
    ranges = once.repartitionByRange(
        *CONVERSATION,
        "turn",
        F.substring("role", 1, RANGE_CHARS),
        # beyond a cut role the order of texts would not be that of the turns
        F.when(short, F.substring("text", 1, RANGE_CHARS)),
    )
    number = F.monotonically_increasing_id()
    in_order = ranges.sortWithinPartitions(*CONVERSATION, "turn", "role", "text")
    return in_order.withColumn("number", number).withColumn("part", F.shiftright("number", 33))


def _turn_hash(place: Column, own: Column) -> list[Column]:
    """Four numbers from the place of a turn and its own hash."""
    whole = F.sha2(F.concat_ws(":", place.cast("string"), own), 256)
    quarter = lambda i: F.conv(F.substring(whole, 16 * i + 1, 16), 16, -10)
    return [quarter(i).cast("long").alias(name) for i, name in enumerate(HASH)]


def prefixes(in_order: DataFrame) -> DataFrame:
    """For each turn its conversation, ``place`` in it from 1, ``n_turns`` of it and ``hash``, of all
    turns up to this one."""
    # the length of the role keeps role and text from running together
    own = F.sha2(
        F.concat_ws(":", F.octet_length("role").cast("string"), F.col("role"), F.col("text")), 256
    )
    turns = in_order.select(*CONVERSATION, "part", "number", own.alias("own"))
    key = [*CONVERSATION, "part"]
    inside = Window.partitionBy(*key).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*CONVERSATION)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = in_order.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(
        *key,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("n_turns"),
    )
    placed = turns.withColumn("nth", F.row_number().over(inside)).join(counts, key)
    place = F.col("before") + F.col("nth")
    hashed = placed.select(
        *key, "number", "n_turns", place.alias("place"), *_turn_hash(place, F.col("own"))
    )
    xor = lambda name: F.bit_xor(name)
    parts = hashed.groupBy(*key).agg(*[xor(h).alias(h) for h in HASH])
    start = [F.coalesce(xor(h).over(earlier), F.lit(0)).alias(f"{h}_before") for h in HASH]
    rolling = hashed.select(
        *key, "place", "n_turns", *[xor(h).over(inside).alias(h) for h in HASH]
    ).join(parts.select(*key, *start), key)
    up_to = [F.col(h).bitwiseXOR(F.col(f"{h}_before")).cast("string") for h in HASH]
    return rolling.select(
        *CONVERSATION, "place", "n_turns", F.concat_ws(":", F.col("place").cast("string"), *up_to).alias("hash")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: ``conv_id, n_turns, n_logged, text``.

    ``n_logged`` counts the logged conversations that are equal to it.
    """
    folder = shared_folder(turns.sparkSession, "chat")
    in_order = stored(ordered(turns), folder, "turns")
    hashes = stored(prefixes(in_order), folder, "prefixes")
    first = F.min(F.struct(*CONVERSATION, "n_turns")).alias("first")
    logged = hashes.where("place = n_turns").groupBy("hash")
    logged = logged.agg(first, F.count(F.lit(1)).alias("n_logged"))
    proper = hashes.where("place < n_turns").select("hash").distinct()
    kept = logged.join(proper, "hash", "left_anti").select("first.*", "n_logged")
    said = F.sort_array(F.collect_list(F.struct("number", _rendered("role", "text").alias("said"))))
    return (
        in_order.join(kept, CONVERSATION)
        .groupBy(*CONVERSATION, "n_turns", "n_logged")
        .agg(F.array_join(F.transform(said, lambda t: t["said"]), "").alias("text"))
        .select(
            F.when(~F.col("_no_id"), F.col("_id")).alias("conv_id"),
            F.col("n_turns").cast("int").alias("n_turns"),
            "n_logged",
            "text",
        )
    )
