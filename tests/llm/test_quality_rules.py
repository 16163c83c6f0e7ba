import random
import re
from collections import Counter

from pyspark.sql import functions as F

from assaylake.llm import quality_rules
from assaylake.llm.common import ROW


def by_definition(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def statistics(df):
    judged = quality_rules.judge(df, ["doc_id"])
    return {
        r.doc_id: r for r in judged.select(f"{ROW}.doc_id", "_stats.*", "base_failed", "kept").collect()
    }


def test_statistics(documents):
    rng = random.Random(2)
    words = ["a", "b", "cé", "#d*", "漢字", "e|", "F", "x\x85y", "q\xa0"]
    texts = [
        "".join(rng.choice(words) + rng.choice(" \n\t\x0b  ") for _ in range(rng.randint(0, 90)))
        for _ in range(60)
    ]
    texts += [None, "", " \n ", "one", "a b c", "a b c a b c", "a a a a", "x y z " * 400]
    texts.append(" ".join(f"u{i // 2 % 300}" for i in range(2000)))
    found = statistics(documents(*enumerate(texts)))
    for i, text in enumerate(texts):
        want = by_definition(text)
        assert {k: found[i][k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert found[i].base_failed == failed
        assert not (failed and found[i].kept)


def prose(rng, n=150):
    stop = "the of and to in that is with for on this from by it was are".split()
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(3, 9)))
    return " ".join(rng.choice(stop) if rng.random() < 0.4 else word() for _ in range(n))


def test_junk_of_several_kinds_is_outvoted_and_prose_stays(documents):
    rng = random.Random(3)
    good = [prose(rng) for _ in range(60)]
    marked = [" ".join(w + rng.choice(["%%%", "***"]) for w in prose(rng).split()) for _ in range(12)]
    tables = [" | ".join(w for w in prose(rng, 200).split() if len(w) > 4) for _ in range(8)]
    found = statistics(documents(*enumerate(good + marked + tables)))
    assert all(found[i].kept for i in range(60))
    assert not any(found[i].kept for i in range(60, 80))


def test_estimation_weighs_rules_by_how_right_they_are():
    """Two rules follow the class, one votes at random: it ends up with hardly any weight."""
    rng = random.Random(4)
    patterns = Counter()
    for _ in range(5000):
        good = rng.random() < 0.8
        vote = lambda right: (1 if good else -1) if rng.random() < right else (-1 if good else 1)
        patterns[vote(0.97), vote(0.9), 1 if rng.random() < 0.8 else -1, 0] += 1
    fitted = quality_rules.fit(sorted(patterns.items()), 4)
    spread = [good - bad for good, bad in fitted.weights]
    assert spread[0] > spread[1] > 3 > 1 > abs(spread[2])


def test_odd_rows(odd_documents, with_clashing_names):
    judged = quality_rules.judge(odd_documents, odd_documents.columns)
    assert judged.count() == 12
    kept = quality_rules.keep_good(with_clashing_names)
    assert kept.dtypes == with_clashing_names.dtypes
    want = judged.where("kept").select(F.col(f"{ROW}.doc_id")).collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want)
    assert quality_rules.keep_good(odd_documents.limit(0)).count() == 0


def test_no_python_on_the_main_path(odd_documents):
    plan = quality_rules.keep_good(odd_documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
