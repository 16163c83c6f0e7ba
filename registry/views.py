"""Lab-shaped views over the driver's tables.

The texts run in Spark and in DuckDB alike; ``{events}`` and the like name the input tables.
Every view spans its whole table.
"""

from pyspark.sql import DataFrame, SparkSession

# L1: one measurement per event.
LAB_RESULTS = """
select event_id as id,
       'doc_' || cast(user_id as string) as source_file,
       ts as extracted_at,
       'api' as extraction_method,
       cast(ts as date) as report_date,
       'lab_' || cast(user_id % 10 as string) as provider,
       ' ' || event_type || ' ' as biomarker_name_raw,
       case when event_id % 13 = 0 then '<' when event_id % 17 = 0 then '>' else '' end
         || case when event_id % 29 = 0 then 'absent'
                 else cast(cast(round(value * 100) as bigint) as string) end as value_raw,
       'cents' as unit_raw,
       case when user_id % 3 <> 0
            then case when day(ts) < 15 then '1000' else '1200' end end as reference_range_low_raw,
       case when user_id % 4 <> 0 then '20000' end as reference_range_high_raw,
       case when event_id % 7 = 0 then 'code_' || event_type end as loinc_code,
       cast(null as string) as notes,
       user_id as subject
from {events}
"""

# M1: reference dimension of L1; one event type is left out, two rows lack a factor or bounds.
META = """
select 'signup' as biomarker_key, 'm-1' as loinc_code, 'cents' as conventional_unit,
       'eur' as si_unit, cast(0.01 as double) as conversion_factor, 'a' as category,
       cast(5 as double) as optimal_range_low_si, cast(100 as double) as optimal_range_high_si
union all
select 'view', 'm-2', 'cents', 'eur', cast(0.01 as double), 'a', cast(10 as double), cast(50 as double)
union all
select 'click', 'm-3', 'cents', 'cents', cast(1 as double), 'b', cast(null as double), cast(null as double)
union all
select 'error', cast(null as string), cast(null as string), 'cents', cast(null as double), 'b',
       cast(null as double), cast(null as double)
"""

# Document registry: one report per text; its first sources are those of L1.
DOCUMENTS = """
select 'd-' || cast(doc_id as string) as id,
       'doc_' || cast(doc_id as string) as source_file,
       case when doc_id % 50 <> 7
            then cast('2024-01-01' as date) + cast(doc_id % 400 as int) end as report_date,
       'lab_' || cast(doc_id % 10 as string) as provider,
       case lang when 'en' then 'blood_panel' when 'de' then 'genetics' else 'other' end
         as report_type,
       case when doc_id % 4 = 1 then '' when doc_id % 4 = 2 then 'fasting'
            when doc_id % 4 = 3 then 'a,b' end as tags,
       case when doc_id % 9 <> 4 then 'docs/findings/2024/report_' || source || '.md' end
         as markdown_path,
       cast(1 as int) as biomarker_count,
       cast('2024-02-01 08:00:00' as timestamp{ntz}) as extracted_at,
       'api' as extraction_method,
       case when doc_id % 3 <> 0 then text end as document_summary,
       case when doc_id % 8 = 1 then '["low vitamin d", "carrier of ' || lang || '"]'
            when doc_id % 8 = 2 then 'no list' when doc_id % 8 = 3 then '[]' end
         as baseline_candidates
from {documents}
"""

# L2: one measurement per line item, for volume.
LAB_RESULTS_LARGE = """
select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-'
         || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-'
         || cast(cast(l_shipdate as date) as string) as id,
       'doc_' || cast(l_orderkey as string) as source_file,
       o_orderdate as extracted_at,
       'api' as extraction_method,
       cast(l_shipdate as date) as report_date,
       'lab_' || cast(l_suppkey as string) as provider,
       'k' || cast(l_partkey as string) as biomarker_name_raw,
       case when l_linenumber = 7 then '<' else '' end
         || cast(cast(l_quantity as bigint) as string) as value_raw,
       'ea' as unit_raw,
       '5' as reference_range_low_raw,
       case when l_suppkey % 3 <> 0 then '45' end as reference_range_high_raw,
       cast(null as string) as loinc_code,
       cast(null as string) as notes
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

# M2: reference dimension of L2, one row per part; some go by a name that L2 does not use.
META_LARGE = """
select case when p_partkey % 20 = 1 then 'other' else 'k' end || cast(p_partkey as string)
         as biomarker_key,
       cast(null as string) as loinc_code,
       'ea' as conventional_unit,
       'box' as si_unit,
       case when p_partkey % 10 <> 0 then p_size / cast(10 as double) end as conversion_factor,
       p_type as category,
       case when p_partkey % 4 <> 0 then cast(10 as double) end as optimal_range_low_si,
       cast(60 as double) as optimal_range_high_si
from {part}
"""

# Document registry of L2: some orders have no line item.
DOCUMENTS_LARGE = """
select 'd-' || cast(o_orderkey as string) as id,
       'doc_' || cast(o_orderkey as string) as source_file,
       cast(o_orderdate as date) as report_date,
       'clerk_' || o_orderpriority as provider,
       case o_orderstatus when 'F' then 'blood_panel' else 'other' end as report_type,
       '' as tags,
       'docs/findings/all/' || o_orderpriority || '.md' as markdown_path,
       cast(0 as int) as biomarker_count,
       o_orderdate as extracted_at,
       'api' as extraction_method,
       cast(null as string) as document_summary,
       cast(null as string) as baseline_candidates
from {orders}
"""

# Profile facts: conditions from labels, variants and patterns from customers and suppliers.
CONDITIONS = """
select doc_id as position,
       'condition ' || cast(doc_id as string) as name,
       case when doc_id % 7 = 3 then 'paused' when doc_id % 5 = 0 then 'active'
            when doc_id % 5 = 1 then 'monitoring' when doc_id % 5 = 2 then 'confirmed'
            when doc_id % 5 = 3 then 'resolved' end as status,
       case when quality = 1 then '  good quality ' when toxic = 1 then '' end as details,
       case when doc_id % 2 = 0 then 'doc_' || cast(doc_id as string) || '.pdf' end
         as source_report,
       case when doc_id % 3 = 0 then cast('2023-05-01' as date) + cast(doc_id % 90 as int) end
         as discovered_date
from {labels}
"""
VARIANTS = """
select c_custkey as position, c_name as finding, c_mktsegment as implication,
       case when c_custkey % 3 <> 0 then c_mktsegment end as relevance,
       case when c_custkey % 4 = 0 then 'genes.pdf' end as source_report,
       case when c_custkey % 2 = 0 then cast('2023-01-01' as date) end as discovered_date
from {customer}
"""
PATTERNS = """
select s_suppkey as position, s_name as finding,
       case when s_suppkey % 3 <> 0 then cast('2024-03-01' as date) end as last_confirmed
from {supplier}
"""

# Text answers: two of three texts stand in a code fence after some prose.
RESPONSES = """
select doc_id,
       case when doc_id % 3 = 0 then text
            else 'As asked:' || chr(10) || '```json' || chr(10) || text || chr(10) || '```'
                 || chr(10) || 'Done.' end as response
from {documents}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_spark(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view text over the tables of a directory."""
    names = [n for n in _TABLES if "{" + n + "}" in text]
    tables = {n: table(spark, sf_dir, n) for n in names}
    return spark.sql(text.replace("{ntz}", "_ntz"), **tables)


def in_sql(text: str) -> str:
    """The same text over views named like the tables."""
    for name in _TABLES:
        text = text.replace("{" + name + "}", name)
    return text.replace("{ntz}", "")


_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
