import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples."""

    def build(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return build


@pytest.fixture
def odd_documents(documents):
    """Nulls, empty and long texts, repeated rows and ids, ties."""
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    return documents(
        (None, None, None),
        (None, "same text here", "a"),
        (1, "same text here", "a"),
        (1, "same text here", "a"),
        (2, "same text here", None),
        (3, "", "b"),
        (4, " \n\t ", "b"),
        (5, long_text, "b"),
        (6, long_text + " more", "b"),
        (7, "one", "c"),
        (8, None, "c"),
        (9, "two words", None),
    )


@pytest.fixture
def with_clashing_names(odd_documents):
    """The same rows with more columns, named like those that operators work with."""
    from pyspark.sql import functions as F

    names = (
        "_row", "row", "kept", "keep_id", "fp", "shard", "slot", "size", "times", "taken", "ids",
        "n_tokens", "text_sha256", "words", "_text", "unit", "group", "_stats", "key", "range",
        "nth", "label", "score", "least", "text_hash", "no_source", "posterior", "base_failed",
    )
    return odd_documents.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
