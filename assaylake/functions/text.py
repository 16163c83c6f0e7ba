"""Text columns: fenced blocks, placeholders (TX1, TX2, TX4)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake import fixed_values as fixed


def strip_space(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(fixed.WHITE_SPACE))


def first_fenced_block(text: Column) -> Column:
    """Content of the first code fence without its language tag; unfenced text is stripped."""
    opened = _after(text, fixed.FENCE)
    # The tag is the rest of the opening line, even when the fence closes on that line.
    untagged = F.when(opened.contains("\n"), _after(opened, "\n")).otherwise(opened)
    block = F.substring_index(untagged, fixed.FENCE, 1)
    return strip_space(F.when(text.contains(fixed.FENCE), block).otherwise(text))


def _after(text: Column, mark: str) -> Column:
    """What follows the first occurrence of ``mark``."""
    return F.substr(text, F.instr(text, F.lit(mark)) + F.lit(len(mark)))


def placeholder(number: int) -> str:
    return fixed.PLACEHOLDER.format(number)


def restore_text(text: Column, found: Column) -> Column:
    """Put the original strings back, in the order of the map."""
    restored = F.aggregate(
        F.map_entries(found),
        text,
        lambda done, entry: F.replace(done, entry["key"], entry["value"]),
    )
    return F.when(found.isNull(), text).otherwise(restored)
