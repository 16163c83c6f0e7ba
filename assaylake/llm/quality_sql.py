"""The quality rules and their estimation stated in SQL for DuckDB."""

from assaylake.llm import quality_rules as rules

# A good and a bad vote of each rule, over the columns of ``stats``.
VOTES = {
    "length": ("n_words >= 80", "n_words < 60"),
    "word_length": (
        "word_chars between 3 * n_words and 9 * n_words",
        "word_chars < 2 * n_words or word_chars > 12 * n_words",
    ),
    "symbols": ("n_symbols <= 0.05 * n_words", "n_symbols > 0.2 * n_words"),
    "repeated_lines": ("n_dup_lines <= 0.1 * n_lines", "n_dup_lines > 0.3 * n_lines"),
    "repeated_words": ("n_repeat_words <= 0.1 * n_words", "n_repeat_words > 0.3 * n_words"),
    "capitals": ("n_capitals <= 0.1 * word_chars", "n_capitals > 0.4 * word_chars"),
    "stop_words": ("n_stop_words >= 5", "n_stop_words < 3"),
    "variety": ("n_distinct >= 0.3 * n_words", "n_distinct < 0.12 * n_words"),
}
_WORD = r"[^\x20\x09-\x0D]+"


def _statistics() -> str:
    stop = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
    return f"""
docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
),
cut as (
  select r, doc_id, t, regexp_extract_all(t, '{_WORD}') as ws,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '{_WORD}')] as lines
  from docs
),
words as (select r, unnest(ws) as w, unnest(range(len(ws))) as i from cut),
triples as (
  select r, i, w as a, lead(w) over next_words as b, lead(w, 2) over next_words as c
  from words window next_words as (partition by r order by i)
),
repeated as (
  select r, i from triples where c is not null
  qualify count(*) over (partition by r, a, b, c) > 1
),
covered as (
  select r, count(distinct i + k) as n from repeated, (select unnest([0, 1, 2]) as k) group by r
),
stats as (
  select r, doc_id, cast(len(ws) as bigint) as n_words,
         cast(length(array_to_string(ws, '')) as bigint) as word_chars,
         cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
         len(regexp_extract_all(t, '[A-Z]')) as n_capitals,
         len(lines) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n, 0) as bigint) as n_repeat_words,
         len(list_distinct(ws)) as n_distinct,
         len(list_intersect(ws, [{stop}])) as n_stop_words
  from cut left join covered using (r)
)"""


def _odds(votes: str) -> str:
    """Log-odds of a good document under the state ``em`` and votes named ``<votes>v1`` and so on."""
    terms = [
        f"case {votes}v{j} when 1 then ln(g{j} / (1 - b{j})) when -1 then ln((1 - g{j}) / b{j}) "
        "else 0 end"
        for j in range(1, len(VOTES) + 1)
    ]
    return " + ".join(["ln(prior / (1 - prior))", *terms])


def text() -> str:
    numbers = range(1, len(VOTES) + 1)
    votes = ", ".join(
        f"case when {bad} then -1 when {good} then 1 else 0 end as v{j}"
        for j, (good, bad) in zip(numbers, VOTES.values(), strict=True)
    )
    names = ", ".join(f"v{j}" for j in numbers)
    state = ", ".join(f"g{j}, b{j}" for j in numbers)
    start = ", ".join(
        f"cast({rules.START_GOOD} as double), cast({rules.START_BAD} as double)" for _ in numbers
    )
    n, pseudo = "n", rules.PSEUDO_COUNT

    def share(weight: str, j: int, right: int, start: float) -> str:
        hits = f"coalesce(sum(case when v{j} = {right} then {weight} end), 0)"
        voted = f"coalesce(sum(case when v{j} <> 0 then {weight} end), 0)"
        return f"({hits} + {pseudo * start}) / ({voted} + {pseudo})"

    again = ", ".join(
        f"{share(f'p * {n}', j, 1, rules.START_GOOD)}, "
        f"{share(f'(1 - p) * {n}', j, -1, rules.START_BAD)}"
        for j in numbers
    )
    return f"""
with recursive {_statistics()},
judged as (
  select *, n_words < {rules.MIN_WORDS}
           or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words as base_failed, {votes}
  from stats
),
patterns as (select {names}, count(*) as n from judged where not base_failed group by all),
em(round, prior, {state}) as (
  select 0, cast({rules.START_PRIOR} as double), {start}
  union all
  select round + 1, (sum(p * n) + {pseudo * rules.START_PRIOR}) / (sum(n) + {pseudo}), {again}
  from (select em.*, patterns.*, 1 / (1 + exp(-greatest(-500, least(500, {_odds('')})))) as p
        from em, patterns where round < {rules.ROUNDS})
  group by round
),
fitted as (select * from em where round = (select max(round) from em))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {_odds('')} >= 0 as kept
from judged, fitted"""
