import pytest
from pyspark.sql import functions as F

from assaylake.functions.text import first_fenced_block
from assaylake.operators import redaction


def redacted(spark, text, strings):
    row = redaction.redact(spark.createDataFrame([(text,)], "text string"), "text", strings)
    return row.select("text", "redacted_strings").first()


def restored(spark, text, found):
    row = spark.createDataFrame([(text, found)], "text string, found map<string,string>")
    return redaction.restore(row, "text", "found").first().text


def test_listed_strings_become_numbered_placeholders(spark):
    text, found = redacted(spark, "ward 7, bed 12, nurse Ilse Quarz", ["Ilse Quarz", "bed 12"])
    assert text == "ward 7, [REDACTED_2], nurse [REDACTED_1]"
    assert found == {"[REDACTED_1]": "Ilse Quarz", "[REDACTED_2]": "bed 12"}


def test_longest_first(spark):
    strings = redaction.redaction_list(["river", "river bank"])
    text, _ = redacted(spark, "seen at the river bank, not in the river", strings)
    assert text == "seen at the [REDACTED_1], not in the [REDACTED_2]"


def test_each_string_is_sought_in_the_text_as_redacted_so_far(spark):
    text, found = redacted(spark, "x1y", ["x1", "REDACTED", "1"])
    assert text == "[[REDACTED_2]_[REDACTED_3]]y"
    assert found == {"[REDACTED_1]": "x1", "[REDACTED_2]": "REDACTED", "[REDACTED_3]": "1"}


@pytest.mark.parametrize("strings", [["tram"], [], ["ferry"]])
def test_round_trip(spark, strings):
    original = "by tram to the lake, by tram back"
    text, found = redacted(spark, original, strings)
    assert found == ({"[REDACTED_1]": "tram"} if strings == ["tram"] else {})
    assert text == (
        "by [REDACTED_1] to the lake, by [REDACTED_1] back" if found else original
    )
    assert restored(spark, text, found) == original


def test_restore_without_mapping(spark):
    assert restored(spark, "nothing hidden here", {}) == "nothing hidden here"
    assert restored(spark, "nothing hidden here", None) == "nothing hidden here"


def test_redaction_list():
    assert redaction.redaction_list(None) == []
    assert redaction.redaction_list([]) == []
    assert redaction.redaction_list(["ab", "", None, "abc", "cd"]) == ["abc", "ab", "cd"]


def test_long_list_keeps_a_small_plan(spark):
    strings = [f"name {n:04d}" for n in range(400)]
    text, found = redacted(spark, "of name 0007 and name 0399", strings)
    assert text == "of [REDACTED_8] and [REDACTED_400]"
    assert len(found) == 2


@pytest.mark.parametrize(
    ("text", "block"),
    [
        ('```json\n[3, 4]\n```', "[3, 4]"),
        ("As follows\n```toml\nsize = 9\n```\nThat is all.", "size = 9"),
        ("```\nno tag\n```", "no tag"),
        ("  [3, 4]  ", "[3, 4]"),
        (" x \n", "x"),
        ("```inline```", "inline"),
        ("```tag only``` then\nmore ```", "more"),
        ("```json\nopen end", "open end"),
        ("a ```x\nb``` c ```y\nd```", "b"),
        ("", ""),
    ],
)
def test_fenced_block(one, text, block):
    assert one(first_fenced_block(F.col("v")), v=(text, "string")) == block


def test_candidates(document_rows):
    docs = document_rows(
        {"source_file": "a", "baseline_candidates": '["one", "caf\\u00e9"]'},
        {"source_file": "b", "baseline_candidates": "no list"},
        {"source_file": "c", "baseline_candidates": None},
        {"source_file": "d", "baseline_candidates": "[]"},
    )
    rows = redaction.explode_candidates(docs).collect()
    assert sorted((r.source_file, r.position, r.candidate) for r in rows) == [
        ("a", 0, "one"),
        ("a", 1, "café"),
    ]


def test_many_strings_give_what_the_fold_gives(spark):
    strings = redaction.redaction_list(
        ["x1", "REDACTED", "1", "ED_12", "]x", "y[", "D_", "river", "river bank", "bank", "ACTED", "0007", "é漢", "a", "aa", "a"]
        + [f"name {i:04d}" for i in range(400)]
    )
    texts = [
        None, "", "x1y x1 1", "at the river bank of name 0007 and name 0399", "aaa a", "é漢 e", "plain", "x]x y[",
        "name 0012name 0013" * 20, "REDACTED_ [REDACTED_1] 12",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    slow, fast = (f(rows, "text", strings).orderBy("n").collect() for f in (redaction.redact, redaction.redact_many))
    assert slow == fast
    assert redaction.redact_many(rows, "text", []).columns == ["n", "text", "redacted_strings"]
    # few strings are left for the fold whatever the list's length
    assert sum(map(redaction.may_meet_placeholder, strings)) == 8
