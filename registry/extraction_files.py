"""Extraction files derived from the driver's tables: one JSON document per event.

The last digits of an event's number decide what is special about its document; a fifth of all
documents share one source. ``DOCUMENTS`` and ``MEASUREMENTS`` state in SQL, without any JSON,
what must come out of loading them.
"""

# What is special, by event number modulo 20:
#   0 cut off            1 number as value     2 no source           3 impossible date
#   4 list at top level  5 source of the next  7 no value, no unit   8 provider in metadata
#   9 no measurements   10 text after the end 11 number among tags  12 source is null
#  13 no time           14 two candidates     15 date with midnight 16-19 shared source
# Braces are doubled for the formatter of ``spark.sql``.
FILES = """
with numbered as (
  select *, event_id % 20 as k, 's' || cast(event_id as string) as own from {events}
),
parts as (
  select *,
    '{{"report_date": "' || case when k = 3 then '2024-13-01' else cast(cast(ts as date) as string)
      end || case when k = 15 then 'T00:00:00' else '' end
      || '", "provider": "Lab ' || cast(user_id % 10 as string)
      || '", "biomarker_name": "' || event_type || '", "value": '
      || case k when 1 then '7' when 7 then 'null'
           else '"' || cast(cast(round(value * 100) as bigint) as string) || '"' end
      || case when k = 7 then '' else ', "unit": "cents"' end
      || ', "reference_range_low": "10", "reference_range_high": null}}' as first_row,
    '{{"report_date": "2024-02-01", "provider": "Lab x", "biomarker_name": "user", "value": "'
      || cast(user_id as string) || '", "notes": "second \\\\"row\\\\""}}' as second_row,
    '{{"report_type": "blood_panel", "tags": ["' || event_type || '", '
      || case when k = 11 then '5' else '"all"' end || ']'
      || case when k = 8 then ', "provider": "Head office", "report_date": "2024-03-01"' else ''
         end
      || case when k = 14 then ', "baseline_candidates": ["one", "two words"]' else '' end
      || '}}' as meta,
    case when k = 2 then '' when k = 12 then ', "source_file": null'
         when k = 5 then ', "source_file": "s' || cast(event_id + 1 as string) || '.pdf"'
         when k >= 16 then ', "source_file": "shared.pdf"'
         else ', "source_file": "' || own || '.pdf"' end
      || case when k = 13 then '' else ', "extracted_at": "' || cast(ts as string) || '"' end
      as tail
  from numbered
),
whole as (
  select event_id, k,
    '{{"biomarkers": [' || case when k = 9 then '' else first_row || ', ' || second_row end
      || '], "document_summary": "About ' || own || '", "metadata": ' || meta || tail || '}}'
      as document
  from parts
)
select 'file_' || lpad(cast(event_id as string), 12, '0') || '.json' as path,
       case k when 0 then left(document, length(document) - 9) when 4 then '[' || document || ']'
              when 10 then document || ' end' else document end as content
from whole
"""

_KEPT = """
kept as (
  select *, event_id % 20 as k,
         case when event_id % 20 = 5 then 's' || cast(event_id + 1 as varchar) || '.pdf'
              when event_id % 20 >= 16 then 'shared.pdf'
              else 's' || cast(event_id as varchar) || '.pdf' end as source_file
  from events
  where event_id % 20 not in (0, 1, 2, 3, 4, 10, 11, 12)
),
chosen as (
  select *, coalesce(case when k <> 13 then ts end, timestamp '2024-06-01 12:00:00') as extracted
  from kept
  qualify row_number() over (partition by source_file order by event_id) = 1
)
"""

DOCUMENTS = f"""
with {_KEPT},
resolved as (
  select *,
    case k when 8 then date '2024-03-01' when 9 then null else cast(ts as date) end as day,
    case k when 8 then 'Head office' when 9 then null
           else 'Lab ' || cast(user_id % 10 as varchar) end as lab
  from chosen
)
select sha256(source_file) as id, source_file, day as report_date, lab as provider,
       'blood_panel' as report_type, event_type || ',all' as tags,
       'docs/findings/' || coalesce(cast(year(day) as varchar), 'unknown') || '/'
         || coalesce(cast(day as varchar), 'unknown') || '_blood_panel_'
         || coalesce(lab, 'unknown') || '.md' as markdown_path,
       cast(case when k = 9 then 0 else 2 end as integer) as biomarker_count,
       extracted as extracted_at, 'api' as extraction_method,
       'About s' || cast(event_id as varchar) as document_summary,
       case when k = 14 then '["one","two words"]' end as baseline_candidates
from resolved
"""

MEASUREMENTS = f"""
with {_KEPT},
two_rows as (
  select chosen.*, n from chosen, (select 0 as n union all select 1) where k <> 9
)
select sha256(source_file || chr(10) || cast(n as varchar)) as id, source_file,
       extracted as extracted_at, 'api' as extraction_method,
       case n when 0 then cast(ts as date) else date '2024-02-01' end as report_date,
       case n when 0 then 'Lab ' || cast(user_id % 10 as varchar) else 'Lab x' end as provider,
       case n when 0 then event_type else 'user' end as biomarker_name_raw,
       case when n = 1 then cast(user_id as varchar) when k = 7 then ''
            else cast(cast(round(value * 100) as bigint) as varchar) end as value_raw,
       case when n = 1 or k = 7 then '' else 'cents' end as unit_raw,
       case n when 0 then '10' end as reference_range_low_raw,
       cast(null as varchar) as reference_range_high_raw,
       cast(null as varchar) as loinc_code,
       case n when 1 then 'second "row"' end as notes
from two_rows
"""

REJECTED = """
select 'file_' || lpad(cast(event_id as varchar), 12, '0') || '.json' as path,
       case event_id % 20 when 1 then 'biomarkers.value' when 2 then 'source_file'
            when 3 then 'biomarkers.report_date'
            when 4 then 'biomarkers, document_summary, source_file, metadata.report_type'
            when 11 then 'metadata.tags' when 12 then 'source_file'
            else 'not a JSON document' end as reason
from events
where event_id % 20 in (0, 1, 2, 3, 4, 10, 11, 12)
"""

STATISTICS = f"""
with {_KEPT}
select (select count(*) from events) as files_found,
       (select count(*) from chosen) as files_loaded,
       (select cast(sum(case when k = 9 then 0 else 2 end) as bigint) from chosen)
         as rows_inserted,
       (select count(*) from events where event_id % 20 in (0, 1, 2, 3, 4, 10, 11, 12))
         as files_rejected
"""

# The documents whose sources are not loaded yet, when those of even events already are.
FRESH = f"""
with {_KEPT}
select source_file, cast(event_id as bigint) as event_id from chosen
where source_file <> 'shared.pdf' and event_id % 2 = 1
"""
