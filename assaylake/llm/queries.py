"""Registered queries of the corpus operators, each over its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import bpe, chat, collocations, decontamination, exact_dedup, hard_negatives, html_text, passage_quality, quality_rules, quality_sql, sharding, simhash, source_mix, toxicity
from assaylake.llm.common import ROW, table

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), RANK_FILE, PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        f"{ROW}.doc_id",
        *[quality_rules.stat(name).alias(name) for name in base],
        "base_failed",
        "kept",
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal(table(spark, sf_dir, "conversations"))


def op9_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_quality.score(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "labels"),
        lambda doc_id: toxicity.held_out(doc_id, 3, 1),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "labels"),
        lambda doc_id: toxicity.held_out(doc_id, 5, 0),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10)
    return hard_negatives.mine(
        table(spark, sf_dir, "embeddings"),
        is_anchor=F.pmod("vec_id", F.lit(100)) == 0,
        label=moved.otherwise(F.col("label")),
    )


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontamination.scan(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return scanned.select(
        f"{ROW}.doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("found.items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


_QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_source_mix": op2_source_mix,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_sharding": op4_sharding,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_text": op7_html_text,
    "op8_chat_format": op8_chat_format,
    "op9_passage_quality": op9_passage_quality,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_decontamination": op13_decontamination,
}


_SQL = {
    "op1_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id is not distinct from max(doc_id) over same
                 and row_number() over (same order by doc_id desc nulls last) = 1 as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))
    """,
    "op6_quality_rules": quality_sql.text(),
    # conversations as lists of turns; one goes if a longer one begins with its list
    "op8_chat_format": """
        with turns as (
          select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
          from conversations),
        logged as (
          select conv_id, list(role order by turn, role, text) as roles,
                 list(text order by turn, role, text) as texts
          from turns group by conv_id),
        each as (
          select roles, texts, min(conv_id) as conv_id, count(*) as n_logged
          from logged group by roles, texts),
        prefixes as (
          select distinct roles[1:n] as roles, texts[1:n] as texts
          from (select roles, texts, unnest(range(1, len(roles))) as n from each)),
        kept as (
          select conv_id, n_logged from each e
          where not exists (
            select 1 from prefixes p where p.roles = e.roles and p.texts = e.texts))
        select conv_id, cast(count(*) as int) as n_turns, max(n_logged) as n_logged,
               string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10)
                 || replace(text, '<|', '< |') || '<|im_end|>' || chr(10),
                 '' order by turn, role, text) as text
        from kept join turns using (conv_id) group by conv_id
    """,
    "op11_collocations": """
        with pieces as (
          select coalesce(lang, 'und') as lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?\\x0A-\\x0D]')) as piece
          from documents),
        split as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as words from pieces),
        totals as (select lang, cast(sum(len(words)) as bigint) as n from split group by lang),
        grams as (
          select lang, m, words[i:i + m - 1] as words
          from (select lang, words, m, unnest(range(1, len(words) - m + 2)) as i
                from split, range(1, 6) as sizes(m) where len(words) >= m)),
        entries as (
          select lang, m, words, count(*) as f from grams group by lang, m, words
          having count(*) >= 100),
        cuts as (
          select c.lang, c.m, c.words, c.f as a, c.k, h.f as l, t.f as r, n,
                 (1000::hugeint * c.f * n) // (h.f::hugeint * t.f) as score
          from (select *, unnest(range(1, m)) as k from entries where m > 1) c
          join entries h on h.lang = c.lang and h.words = c.words[1:c.k]
          join entries t on t.lang = c.lang and t.words = c.words[c.k + 1:c.m]
          join totals on totals.lang = c.lang),
        lowest as (
          select * from cuts
          qualify row_number() over (partition by lang, words order by score, k) = 1),
        longer as (
          select lang, words, max(f) as f from (
            select lang, f, unnest([words[s:s + w - 1] for s in range(1, m - w + 2)]) as words
            from (select *, unnest(range(2, m)) as w from entries))
          group by lang, words),
        kept as (
          select lowest.* from lowest left join longer using (lang, words)
          where longer.f is null or 100 * longer.f < 100 * a)
        select lang, rank, array_to_string(words, ' ') as phrase, a, l, r, n,
               cast(score as bigint) as score
        from (select *, row_number() over (
                partition by lang
                order by score desc, a desc, array_to_string(words, ' ')) as rank from kept)
        where rank <= 2000
    """,
    "op12_hard_negatives": """
        with taking_part as (
          select distinct vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label,
                 [floor(256 * cast(x as double)) for x in embedding] as vec
          from embeddings
          where vec_id is not null and label is not null and embedding is not null
            and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        scored as (
          select a.vec_id as anchor_id, a.label as anchor_label, a.vec as anchor_vec,
                 b.vec_id as id, b.label = a.label as same_label,
                 cast(list_dot_product(a.vec, b.vec) as bigint) as score
          from taking_part a join taking_part b on b.vec_id <> a.vec_id where a.vec_id % 100 = 0),
        positives as (
          select *, row_number() over (partition by anchor_id, anchor_label, anchor_vec
                                       order by score desc, id) as place
          from scored where same_label),
        paired as (
          select p.anchor_id, p.id as positive_id, p.score as positive_score, p.place,
                 n.id as negative_id, n.score as negative_score,
                 row_number() over (partition by p.anchor_id, p.anchor_label, p.anchor_vec, p.place
                                    order by n.score desc, n.id) as rank
          from positives p join scored n
            on n.anchor_id = p.anchor_id and n.anchor_label = p.anchor_label
            and n.anchor_vec = p.anchor_vec and not n.same_label
            and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
          where p.place <= 5)
        select anchor_id, positive_id, cast(rank as int) as rank, negative_id,
               positive_score, negative_score, cast(place as int) as positive_rank
        from paired where rank <= 10
    """,
    "op13_decontamination": """
        with docs as (
          select row_number() over () as row_no, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[0-9a-z\\x{80}-\\x{10FFFF}]+') as words
          from documents),
        items as (
          select coalesce(cast(item_id as varchar), '') as item,
                 regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[0-9a-z\\x{80}-\\x{10FFFF}]+') as words
          from benchmark),
        sized as (select item, words, least(len(words), 10) as k from items where len(words) > 0),
        windows as (
          select distinct item, k, array_to_string(words[i:i + k - 1], ' ') as w
          from (select item, words, k, unnest(range(1, len(words) - k + 2)) as i from sized)),
        placed as (
          select row_no, words, k, unnest(range(1, len(words) - k + 2)) as i
          from docs, (select distinct k from windows) where len(words) >= k),
        hits as (
          select row_no, i, placed.k, item from placed join windows
          on placed.k = windows.k and array_to_string(words[i:i + placed.k - 1], ' ') = w),
        hit_words as (
          select row_no, count(distinct p) as n_hit
          from (select row_no, unnest(range(i, i + k)) as p from hits) group by row_no),
        hit_items as (
          select row_no, count(*) as n_items, string_agg(item, ',' order by item) as ids
          from (select distinct row_no, item from hits) group by row_no)
        select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit,
               coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 as contaminated
        from docs left join hit_words using (row_no) left join hit_items using (row_no)
    """,
}


def registered() -> dict[str, Query]:
    import corpus_pipeline  # at the top of the repository; it imports the operators

    return _QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_texts() -> dict[str, str]:
    return dict(_SQL)
