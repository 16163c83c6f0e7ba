"""The registered corpus queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from assaylake.llm import exact_dedup, queries, quality_rules, simhash, source_mix
from tools.check_against_sql import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"


def test_names():
    names = list(queries.registered())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)] + ["pipeline"]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "simhash_near_dedup", "source_mix", "byte_bpe",
    ]


@pytest.mark.parametrize("name", list(queries.oracle_texts()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    df = queries.registered()[name](spark, SF_DIR)
    result = con.execute(queries.oracle_texts()[name])
    columns = [d[0] for d in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", [f"op{n}" for n in (2, 3, 4, 5, 6, 7, 9, 10, 13)])
def test_a_row_per_input_row(spark, name):
    full = next(n for n in queries.registered() if n.startswith(name + "_"))
    table = "pages" if name == "op7" else "documents"
    ids = spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(table[:-1].replace("ument", "") + "_id")
    got = queries.registered()[full](spark, SF_DIR).select(ids.columns[0])
    assert sorted(got.collect()) == sorted(ids.collect())


def test_pipeline_does_what_its_stages_decide(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = quality_rules.keep_good(docs)
    single = exact_dedup.drop_copies(good)
    apart = simhash.drop_near_duplicates(single)
    mixed = source_mix.mixed(apart)
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(got.select(*docs.columns).collect()) == sorted(mixed.collect())
    counts = [df.count() for df in (docs, good, single, apart)]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    left = apart.collect()
    assert len({r.text for r in left}) == len(left)


def test_pipeline_stages_take_empty_tables_and_odd_rows(spark, odd_documents):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents.limit(0), SF_DIR).count() == 0, name
        assert stage(spark, odd_documents, SF_DIR).columns[:5] == odd_documents.columns, name
