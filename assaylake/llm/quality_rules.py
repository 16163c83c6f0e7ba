"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule looks at a document's statistics and votes good (1), votes bad (-1) or abstains (0).
Expectation-maximisation over the counts of all vote patterns estimates how often each rule is
right about good and about bad documents; a document stays if the posterior probability that it is
good reaches a threshold.

Defined results: a null text is empty; an empty text has zero statistics, fails the base rules and
is rejected; ties of the posterior with the threshold are kept; repeated rows get equal verdicts;
an empty table gives an empty result; other columns are carried through whatever their names.
"""

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import ROW, WORD, text_of, words_of
from assaylake.sources.shared import shared_folder, stored

STATS = "_stats"
WINDOW = 3
#: Repeated hashes that are looked up for each window of a text.
LOOKED_UP = 32
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
THRESHOLD = 0.5
ROUNDS = 50
#: Where estimation starts: nearly all good documents get a rule's good vote, but junk comes in
#: kinds, each caught by a few rules. This also sets which class is called good.
START_GOOD, START_BAD, START_PRIOR = 0.95, 0.4, 0.8
PSEUDO_COUNT = 10.0

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it with as was on be by this are from at "
    "der die das und ist von zu den mit sich für ein nicht "
    "le la les de des et en un une que est pour dans qui "
    "el los del y se las por con para su no"
).split()


@dataclass(frozen=True)
class Rule:
    """Votes by conditions over the statistics; abstains where neither or a null holds."""

    name: str
    good: Callable[[Callable[[str], Column]], Column]
    bad: Callable[[Callable[[str], Column]], Column]

    def vote(self, stat: Callable[[str], Column]) -> Column:
        return F.when(self.bad(stat), -1).when(self.good(stat), 1).otherwise(0)


def _share(part: str, whole: str, low: float, high: float) -> tuple[Callable, Callable]:
    return (
        lambda s: s(part) <= low * s(whole),
        lambda s: s(part) > high * s(whole),
    )


RULES = (
    Rule("length", lambda s: s("n_words") >= 80, lambda s: s("n_words") < 60),
    Rule(
        "word_length",
        lambda s: s("word_chars").between(3 * s("n_words"), 9 * s("n_words")),
        lambda s: (s("word_chars") < 2 * s("n_words")) | (s("word_chars") > 12 * s("n_words")),
    ),
    Rule("symbols", *_share("n_symbols", "n_words", 0.05, 0.2)),
    Rule("repeated_lines", *_share("n_dup_lines", "n_lines", 0.1, 0.3)),
    Rule("repeated_words", *_share("n_repeat_words", "n_words", 0.1, 0.3)),
    Rule("capitals", *_share("n_capitals", "word_chars", 0.1, 0.4)),
    Rule(
        "stop_words",
        lambda s: s("n_stop_words") >= 5,
        lambda s: s("n_stop_words") < 3,
    ),
    Rule(
        "variety",
        lambda s: s("n_distinct") >= 0.3 * s("n_words"),
        lambda s: s("n_distinct") < 0.12 * s("n_words"),
    ),
)


def _windows(words: Column, begins: Column) -> Column:
    """The three-word windows at some positions, sorted: equal windows stand side by side."""
    window = lambda i: F.struct(
        F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]).alias("t"), i.alias("i")
    )
    return F.sort_array(F.transform(begins, window))


def _repeated(windows: Column) -> Column:
    """Positions of windows that stand next to an equal one, in text order."""
    text = lambda i: F.get(windows, i)["t"]
    equal = lambda w, i: (w["t"] == text(i - 1)) | (w["t"] == text(i + 1))
    return F.sort_array(F.transform(F.filter(windows, equal), lambda w: w["i"]))


def _covered(positions: Column) -> Column:
    """Words in windows of three that begin at sorted positions, each word once."""
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(
        p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")
    )
    return F.aggregate(positions, start, step)["n"]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more.

    Hashes of the windows tell which can be repeated, mostly none or a few; those alone are
    compared as texts. Where many hashes repeat, looking each up would be slower than comparing
    all windows, so all are compared.
    """
    begins = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(
        begins, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )

    def among(candidates: Column) -> Column:
        return _bound(_windows(words, candidates), lambda w: _covered(_repeated(w)))

    def of(hashes: Column) -> Column:
        twice = _bound(
            F.sort_array(hashes),
            lambda s: F.array_distinct(F.filter(s, lambda h, i: h == F.get(s, i + 1))),
        )
        few = lambda t: F.filter(begins, lambda i: F.array_contains(t, F.get(hashes, i)))
        candidates = _bound(
            twice, lambda t: F.when(F.size(t) <= LOOKED_UP, few(t)).otherwise(begins)
        )
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), among(candidates)
        ).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > WINDOW, _bound(hashes, of)).otherwise(F.lit(0).cast("long"))


def _statistics(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))

    def of(words: Column, lines: Column) -> Column:
        stats = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
            "n_capitals": F.regexp_count(text, F.lit("[A-Z]")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_distinct": F.size(F.array_distinct(words)),
            "n_stop_words": F.size(F.array_intersect(words, F.array(*map(F.lit, STOP_WORDS)))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in stats.items()])

    return _bound(words_of(text), lambda words: _bound(lines, lambda ls: of(words, ls)))


def with_statistics(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with a struct of the text's statistics; whole texts, row by row, no shuffle.

    The one-row generator keeps conditions on the statistics from being pushed below it, where
    they would compute everything again.
    """
    return df.select("*", F.explode_outer(F.array(_statistics(text))).alias(STATS))


def stat(name: str) -> Column:
    return F.col(f"{STATS}.{name}")


def base_failed() -> Column:
    return (stat("n_words") < MIN_WORDS) | (
        100 * stat("n_repeat_words") > MAX_REPEAT_PERCENT * stat("n_words")
    )


@dataclass(frozen=True)
class Fitted:
    """Log-odds of being good before any vote, and what a rule's good or bad vote adds."""

    prior: float
    weights: tuple[tuple[float, float], ...]

    def log_odds(self, votes: Sequence[Column]) -> Column:
        total = F.lit(self.prior)
        for vote, (good, bad) in zip(votes, self.weights, strict=True):
            total = total + F.when(vote == 1, good).when(vote == -1, bad).otherwise(0.0)
        return total

    def posterior(self, votes: Sequence[Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(votes)))


def fit(patterns: Sequence[tuple[Sequence[int], int]], n_rules: int) -> Fitted:
    """Expectation-maximisation over vote patterns with their counts.

    A rule that votes says good of a good document with one probability and bad of a bad one with
    another; abstaining tells nothing. All start from the same pseudo-counts.
    """
    prior, accuracy = START_PRIOR, [(START_GOOD, START_BAD)] * n_rules
    for _ in range(ROUNDS):
        model = _as_fitted(prior, accuracy)
        good = [_pseudo(START_GOOD) for _ in range(n_rules)]
        bad = [_pseudo(START_BAD) for _ in range(n_rules)]
        of_good, of_all = PSEUDO_COUNT * START_PRIOR, PSEUDO_COUNT
        for votes, count in patterns:
            odds = model.prior + sum(
                w[0] if v == 1 else w[1] for v, w in zip(votes, model.weights, strict=True) if v
            )
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            of_good, of_all = of_good + p * count, of_all + count
            for j, v in enumerate(votes):
                if v:
                    good[j][v == -1] += p * count
                    bad[j][v == 1] += (1 - p) * count
        prior = of_good / of_all
        accuracy = [(g[0] / sum(g), b[0] / sum(b)) for g, b in zip(good, bad, strict=True)]
    return _as_fitted(prior, accuracy)


def _pseudo(accuracy: float) -> list[float]:
    return [PSEUDO_COUNT * accuracy, PSEUDO_COUNT * (1 - accuracy)]


def _as_fitted(prior: float, accuracy: Sequence[tuple[float, float]]) -> Fitted:
    return Fitted(
        math.log(prior / (1 - prior)),
        tuple((math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in accuracy),
    )


def pattern_counts(judged: DataFrame, rules: Sequence[Rule] = RULES) -> list:
    """Counts of vote patterns over all documents; at most 3 to the number of rules."""
    names = [r.name for r in rules]
    counted = (
        judged.where(~base_failed())
        .select(*[r.vote(stat).alias(r.name) for r in rules])
        .groupBy(*names)
        .count()
    )
    return sorted((tuple(r[n] for n in names), r["count"]) for r in counted.collect())


def judge(
    docs: DataFrame,
    carried: Sequence[str],
    column: str = "text",
    rules: Sequence[Rule] = RULES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The carried columns (``_row``), the statistics, ``base_failed``, ``posterior`` and ``kept``.

    Texts are read once: the statistics are a written table, from which the rules are fitted and
    then applied.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carried]).alias(ROW)
    counted = with_statistics(docs.select(row, text_of(column).alias("_text")), F.col("_text"))
    folder = shared_folder(docs.sparkSession, "quality")
    judged = stored(counted.drop("_text"), folder, "statistics")
    fitted = fit(pattern_counts(judged, rules), len(rules))
    votes = [r.vote(stat) for r in rules]
    return judged.withColumns(
        {"base_failed": base_failed(), "posterior": fitted.posterior(votes)}
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, column: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(docs, docs.columns, column).where("kept").select(f"{ROW}.*")
