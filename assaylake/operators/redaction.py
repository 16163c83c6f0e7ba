"""Redaction and restoring of listed strings, candidate rows (TX1-TX3, TX6)."""

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake import fixed_values as fixed
from assaylake.functions.text import placeholder, restore_text


def redaction_list(strings: Iterable[str | None] | None) -> list[str]:
    """Strings to redact, longest first, equal lengths in their given order; blanks left out."""
    return sorted((s for s in strings or [] if s), key=len, reverse=True)


def redact(
    df: DataFrame, text_col: str, strings: Sequence[str], map_col: str = "redacted_strings"
) -> DataFrame:
    """Replace each string by its numbered placeholder and keep what was found in a map.

    Strings are replaced one after the other, each searched in the text as already redacted, by
    a fold over the list: the plan stays small for long lists.
    """
    if not strings:
        return df.withColumn(map_col, F.create_map().cast("map<string,string>"))
    return _folded(df, text_col, _listed(strings), map_col)


def redact_many(
    df: DataFrame, text_col: str, strings: Sequence[str], map_col: str = "redacted_strings"
) -> DataFrame:
    """The same result as ``redact`` for a list of thousands.

    An automaton over the list finds the strings that stand in a text in one pass over it, whatever the
    list's length. The fold then runs over those alone, and over the few that a placeholder put in before
    could bring about. Only the texts travel to Python, and only numbers of strings come back.
    """
    if not strings:
        return redact(df, text_col, strings, map_col)
    listed = _listed(strings)
    always = [i for i, s in enumerate(strings) if may_meet_placeholder(s)]
    find = F.arrow_udf(_finder(list(strings), always), "array<int>")
    numbered = df.withColumn("_numbers", find(F.coalesce(text_col, F.lit(""))))
    some = F.transform("_numbers", lambda i: F.get(listed, i))
    return _folded(numbered, text_col, some, map_col).drop("_numbers")


def may_meet_placeholder(string: str) -> bool:
    """Whether a string can stand in a redacted text without standing in the original: inside a placeholder
    or over one of its ends."""
    begin, end = fixed.PLACEHOLDER.split("{}")
    if begin[0] in string or end[-1] in string:
        return True
    stem = string.rstrip("0123456789")
    return stem in begin if stem == string else begin.endswith(stem)


def _finder(strings: list[str], always: list[int]) -> Callable:
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        numbers: dict[str, list[int]] = {}
        for i, string in enumerate(strings):
            numbers.setdefault(string, []).append(i)
        for string, own in numbers.items():
            automaton.add_word(string, own)
        automaton.make_automaton()
        for texts in batches:
            found = []
            for text in texts:
                here = set(always)
                for _, own in automaton.iter(text.as_py()):
                    here.update(own)
                found.append(sorted(here))
            yield pa.array(found, pa.list_(pa.int32()))

    return find


def _listed(strings: Sequence[str]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(placeholder(i)).alias("key"), F.lit(s).alias("value"))
            for i, s in enumerate(strings, start=1)
        ]
    )


def _folded(df: DataFrame, text_col: str, listed: Column, map_col: str) -> DataFrame:
    entry = "struct<key:string,value:string>"
    start = F.struct(
        F.col(text_col).alias("text"), F.array().cast(f"array<{entry}>").alias("found")
    )

    def step(done, item):
        redacted = F.struct(
            F.replace(done["text"], item["value"], item["key"]).alias("text"),
            F.array_append(done["found"], item).alias("found"),
        )
        return F.when(F.contains(done["text"], item["value"]), redacted).otherwise(done)

    return (
        df.withColumn("_redacted", F.aggregate(listed, start, step))
        .withColumn(text_col, F.col("_redacted.text"))
        .withColumn(map_col, F.map_from_entries("_redacted.found"))
        .drop("_redacted")
    )


def restore(df: DataFrame, text_col: str, map_col: str = "redacted_strings") -> DataFrame:
    """Replace the placeholders of each row's map by the original strings."""
    return df.withColumn(text_col, restore_text(F.col(text_col), F.col(map_col)))


def explode_candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate of a document's JSON list; a bad or empty list gives none."""
    listed = F.from_json("baseline_candidates", "array<string>")
    return docs.select(
        "source_file",
        "report_date",
        "provider",
        "report_type",
        F.posexplode(listed).alias("position", "candidate"),
    )
