"""SQL counterparts of the registered queries, for DuckDB."""

from registry import extraction_files as files
from registry import views

GENERATED = "2024-07-01"
TO_REDACT = ("mail", "the", "", "example.com", "und", "@mail")
REDACTED = ("example.com", "@mail", "mail", "the", "und")
DELETED = ("shared.pdf", "s7.pdf", "s14.pdf")
RUN_1, RUN_2 = "2024-02-01 00:00:00", "2024-03-01 00:00:00"
SOURCE = "doc_7"
#: Length of the redaction list taken from the documents, and the words that it may hold.
LISTED, PLAIN_WORD = 1000, "[a-z]{7,}"
#: Events from this number on come with the second of two loads.
SECOND_LOAD = 600


def _staging(name: str, raw: str) -> str:
    def number(text: str) -> str:
        return f"try_cast({text} as double)"

    return f"""
{name} as (
  select id as lab_result_id, source_file, extracted_at, extraction_method, report_date, provider,
    trim(biomarker_name_raw) as biomarker_name, value_raw,
    case left(value_raw, 1)
      when '<' then {number("replace(value_raw, '<', '')")} / 2
      when '>' then {number("replace(value_raw, '>', '')")}
      else {number("value_raw")} end as value_numeric,
    unit_raw as unit,
    left(value_raw, 1) = '<' as is_below_detection_limit,
    left(value_raw, 1) = '>' as is_above_detection_limit,
    {number("reference_range_low_raw")} as reference_range_low,
    {number("reference_range_high_raw")} as reference_range_high,
    loinc_code, notes
  from {raw}
  where biomarker_name_raw is not null and value_raw is not null
  qualify row_number() over (
    partition by report_date, trim(biomarker_name_raw), provider
    order by extracted_at desc, id desc) = 1
)"""


def _facts(name: str, staged: str, meta: str) -> str:
    return f"""
{name} as (
  select lab_result_id, report_date, provider, source_file, biomarker_name as biomarker_key,
    value_raw, value_numeric as value_original, unit as unit_original,
    ifnull(si_unit, unit) as unit_si,
    value_numeric * ifnull(conversion_factor, 1) as value_si,
    reference_range_low * ifnull(conversion_factor, 1) as reference_range_low_si,
    reference_range_high * ifnull(conversion_factor, 1) as reference_range_high_si,
    optimal_range_low_si, optimal_range_high_si,
    case when reference_range_low is not null or reference_range_high is not null
         then value_numeric >= ifnull(reference_range_low, value_numeric)
          and value_numeric <= ifnull(reference_range_high, value_numeric)
         end as is_within_ref_range,
    case when optimal_range_low_si is not null and optimal_range_high_si is not null
         then value_numeric * ifnull(conversion_factor, 1)
              between optimal_range_low_si and optimal_range_high_si
         end as is_within_optimal_range,
    is_below_detection_limit, is_above_detection_limit, category,
    ifnull({staged}.loinc_code, {meta}.loinc_code) as loinc_code
  from {staged} left join {meta} on biomarker_key = biomarker_name
)"""


def _dimension(name: str, docs: str, staged: str) -> str:
    return f"""
{name} as (
  select id as document_id, source_file, report_date, provider, report_type, tags, markdown_path,
    (select count(*) from {staged} s where s.source_file = d.source_file) as biomarker_count,
    extracted_at, extraction_method, document_summary, baseline_candidates
  from {docs} d
)"""


def _view(name: str, text: str) -> str:
    return f"{name} as ({views.in_sql(text)})"


RAW = _view("lab_results", views.LAB_RESULTS.replace(",\n       user_id as subject", ""))
RAW_SUBJECT = _view("lab_results", views.LAB_RESULTS)
META = _view("meta", views.META)
DOCS = _view("docs", views.DOCUMENTS)
STG = _staging("stg", "lab_results")
FCT = _facts("fct", "stg", "meta")
DIM = _dimension("dim", "docs", "stg")
STG_SUBJECT = STG.replace("select id as", "select subject, id as").replace(
    "partition by report_date", "partition by subject, report_date"
)
FCT_SUBJECT = FCT.replace("select lab_result_id", "select subject, lab_result_id")
FACTS = f"with {RAW}, {META}, {STG}, {FCT}"
BOTH = f"{FACTS}, {DOCS}, {DIM}"
LARGE = (
    f"with {_view('lab_results', views.LAB_RESULTS_LARGE)}, "
    f"{_view('meta', views.META_LARGE)}, {STG}, {FCT}"
)

_SNAPSHOT = """
ranked as (
  select *, row_number() over newest as place,
    lead(value_si) over newest as prev_value_si, lead(report_date) over newest as prev_date
  from fct
  window newest as (partition by biomarker_key order by report_date desc, lab_result_id desc)
),
snapshot as (
  select biomarker_key, category, value_si, unit_si, value_original, unit_original, report_date,
    provider, is_within_ref_range, is_within_optimal_range, is_below_detection_limit,
    prev_value_si, prev_date,
    case when is_below_detection_limit then 'BDL' when is_within_optimal_range then 'Optimal'
         when is_within_ref_range then 'Normal' when not is_within_ref_range then '**OUT**'
         else '-' end as status,
    case when value_si is null or prev_value_si is null then ''
         when prev_value_si = 0 or abs((value_si - prev_value_si) / prev_value_si) * 100 < 3
         then '-' when value_si > prev_value_si then '^' else 'v' end as trend
  from ranked where place = 1
)"""

_INDEX = """
index_rows as (
  select dim.report_date, dim.provider, report_type, biomarker_count, tags, markdown_path,
    count(*) filter (where is_within_ref_range = false) as out_of_range_count,
    case when markdown_path is null or markdown_path = '' then ''
         else '[' || replace(split_part(markdown_path, '/', -1), '.md', '') || '](../'
              || substr(markdown_path, 6) || ')' end as link
  from dim left join fct on fct.source_file = dim.source_file
  group by all
)"""

# The second environment: some keys renamed, some values missing or shifted.
_ENV = """
env as (
  select * replace (
    case when lab_result_id % 11 = 0 then biomarker_key || '_new' else biomarker_key end
      as biomarker_key,
    case when lab_result_id % 5 = 0 then null when lab_result_id % 7 = 0 then value_si + 1
         else value_si end as value_si)
  from fct
)"""

# The second environment of the large facts: some values doubled, some providers moved.
_ENV_LARGE = """
env as (
  select * replace (
    case when cast(substr(provider, 5) as bigint) % 7 = 0 then provider || 'b' else provider end
      as provider,
    case when cast(substr(provider, 5) as bigint) % 3 = 0 then value_si * 2 else value_si end
      as value_si)
  from fct
)"""

_PAIRS = """
pairs as (
  select coalesce(p.biomarker_key, d.biomarker_key) as biomarker,
    coalesce(p.report_date, d.report_date) as report_date,
    coalesce(p.provider, d.provider) as provider,
    p.value_si as prod_value, d.value_si as env_value,
    round(d.value_si - p.value_si, 4) as diff,
    coalesce(p.unit_si, d.unit_si) as unit,
    case when p.biomarker_key is null then 'ENV ONLY' when d.biomarker_key is null
         then 'PROD ONLY' when p.value_si is distinct from d.value_si then 'CHANGED'
         else 'SAME' end as status,
    p.source_file as prod_source, d.source_file as env_source
  from fct p full join env d on p.biomarker_key = d.biomarker_key
    and p.report_date = d.report_date and p.provider = d.provider
)"""

_RANGES = """
bounded as (
  select provider, biomarker_name, reference_range_low as low, reference_range_high as high,
    report_date
  from stg where reference_range_low is not null or reference_range_high is not null
)"""

_MERGE = f"""
newest as (
  select *, report_date >= date '2024-01-15' as second from bounded
  qualify row_number() over (
    partition by provider, biomarker_name, report_date >= date '2024-01-15'
    order by report_date desc) = 1
),
old as (select * from newest where not second),
new as (select * from newest where second),
changed as (
  select new.*, old.provider is not null as known,
    old.low is not distinct from new.low and old.high is not distinct from new.high as same
  from new left join old
    on old.provider = new.provider and old.biomarker_name = new.biomarker_name
)
select provider, biomarker_name, low as reference_range_low, high as reference_range_high,
  report_date as last_seen_date, timestamp '{RUN_1}' as valid_from,
  case when exists (select 1 from changed c where c.provider = old.provider
         and c.biomarker_name = old.biomarker_name and not same)
       then timestamp '{RUN_2}' end as valid_to
from old
union all
select provider, biomarker_name, low, high, report_date, timestamp '{RUN_2}', null
from changed where not (known and same)"""


def _per_subject(text: str) -> str:
    return text.replace("partition by biomarker_key", "partition by subject, biomarker_key").replace(
        "select biomarker_key", "select subject, biomarker_key"
    )


def _redaction() -> str:
    """The texts after each string, with a mark where the string was found."""
    steps = ["r0 as (select doc_id, text as t, '' as found from documents)"]
    for i, s in enumerate(REDACTED, start=1):
        steps.append(
            f"r{i} as (select doc_id, replace(t, '{s}', '[REDACTED_{i}]') as t, found || case when "
            f"contains(t, '{s}') then '[REDACTED_{i}]={s};' else '' end as found from r{i - 1})"
        )
    return ",\n".join(steps)


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


_FENCED = f"""
with responses as ({views.in_sql(views.RESPONSES)}),
cut as (
  select doc_id, response, strpos(response, '```') as opens,
    substr(response, strpos(response, '```') + 3) as opened
  from responses
),
body as (
  select doc_id, case when opens = 0 then response
    else split_part(case when contains(opened, chr(10))
      then substr(opened, strpos(opened, chr(10)) + 1) else opened end, '```', 1) end as block
  from cut
)
select doc_id, {_strip("block")} as block from body"""

_CANDIDATES = """
candidates as (
  select source_file, report_date, provider, report_type, n as position,
    case n when 0 then 'low vitamin d' else 'carrier of ' || lang end as candidate
  from docs join documents on 'd-' || doc_id = docs.id, (select 0 as n union all select 1)
  where doc_id % 8 = 1
)"""

_CONDITIONS = f"""
conditions as ({views.in_sql(views.CONDITIONS)}),
named as (select * replace (coalesce(status, 'unknown') as status) from conditions),
ranked_conditions as (
  select *,
    case status when 'active' then 1 when 'monitoring' then 2 when 'confirmed' then 3
      when 'resolved' then 4 else 5 + min(position) over (partition by status) end as rank,
    nullif(concat_ws(' | ', case when source_report <> '' then 'Source: ' || source_report end,
      'Discovered: ' || cast(discovered_date as varchar)), '') as origin
  from named
)"""


def _line_select(report: str, block: int, line: str, **key: str) -> str:
    rank = key.get("rank", "0")
    return (
        f"select '{report}' as report, cast({block} as integer) as block, "
        f"cast({rank} as bigint) as rank, cast({key.get('label', repr(''))} as varchar) as label, "
        f"cast({key.get('item', repr(''))} as varchar) as item, "
        f"cast({key.get('position', '0')} as bigint) as position, "
        f"cast({key.get('no', '0')} as integer) as line_no, {line} as line "
        f"from {key['src']}"
    )


def _constant_lines(report: str, block: int, lines: list[str], src: str, **key: str) -> list[str]:
    return [
        _line_select(report, block, line, src=src, no=str(n), **key)
        for n, line in enumerate(lines)
    ]


_NEWEST = "coalesce(-datediff('day', date '1970-01-01', report_date), 9000000000000000000)"
_OLDEST = "coalesce(datediff('day', date '1970-01-01', report_date), 9000000000000000000)"
_DAY = "coalesce(cast(report_date as varchar), 'None')"
_GENERATED = f"'*Generated: {GENERATED}*'"
_ONE = "(select 1) one_row"


def _snapshot_lines() -> str:
    name, label = "current_snapshot", "coalesce(category, '')"
    uncategorized = "case when category is null then 1 else 0 end"
    line = f"""'| ' || biomarker_key || ' | ' || coalesce(printf('%.2f', value_si), '-') || ' '
      || coalesce(unit_si, '') || ' | '
      || coalesce(trim(cast(value_original as varchar) || ' ' || coalesce(unit_original, '')), '-')
      || ' | ' || {_DAY} || ' | ' || status || ' | ' || trend || ' |'"""
    heading = [
        "''",
        "'## ' || upper(left(coalesce(category, 'uncategorized'), 1)) "
        "|| lower(substr(coalesce(category, 'uncategorized'), 2))",
        "''",
        "'| Biomarker | Value (SI) | Original | Date | Status | Trend |'",
        "'|-----------|-----------|----------|------|--------|-------|'",
    ]
    head = ["'# Current Biomarker Snapshot'", _GENERATED, "''"]
    parts = _constant_lines(name, 0, head, _ONE)
    parts += _constant_lines(
        name, 1, heading, "(select distinct category from snapshot)",
        rank=uncategorized, label=label, position="-1",
    )
    parts.append(
        _line_select(
            name, 1, line, src="snapshot", rank=uncategorized, label=label, item="biomarker_key"
        )
    )
    return " union all ".join(parts)


def _timeline_lines() -> str:
    total = "'Total reports: ' || (select count(*) from dim)"
    line = f"""'- **' || {_DAY} || '** - ' || report_type || ' (' || provider || ', '
      || biomarker_count || ' biomarkers)'
      || case when tags <> '' then ' [' || tags || ']' else '' end"""
    head = ["'# Report Timeline'", _GENERATED, "''", total, "''"]
    parts = _constant_lines("timeline", 0, head, _ONE)
    parts.append(
        _line_select("timeline", 1, line, src="dim", rank=_NEWEST, item="source_file")
    )
    return " union all ".join(parts)


def _index_lines() -> str:
    line = f"""'| ' || {_DAY} || ' | ' || report_type || ' | ' || provider || ' | '
      || biomarker_count || ' | ' || out_of_range_count || ' | ' || coalesce(tags, '') || ' | '
      || link || ' |'"""
    head = [
        "'# Report Index'", _GENERATED, "''",
        "'Total reports: ' || (select count(*) from index_rows)", "''",
        "'| Date | Type | Provider | Biomarkers | Out of Range | Tags | Findings |'",
        "'|------|------|----------|------------|--------------|------|----------|'",
    ]
    parts = _constant_lines("report_index", 0, head, _ONE)
    parts.append(
        _line_select("report_index", 1, line, src="index_rows", rank=_NEWEST, item=line)
    )
    return " union all ".join(parts)


def _history_lines() -> str:
    name = "medical_history"

    def detail_lines(block: int, src: str, lines: list[str], **key: str) -> list[str]:
        return [
            f"select * from ({one}) where line is not null"
            for one in _constant_lines(name, block, lines, src, **key)
        ]

    origin = """'  - ' || nullif(concat_ws(' | ',
      case when source_report <> '' then 'Source: ' || source_report end,
      'Discovered: ' || cast(discovered_date as varchar)), '')"""
    parts = _constant_lines(name, 0, ["'# Medical History'", _GENERATED], _ONE)
    parts += _constant_lines(name, 2, ["''", "'## Conditions'"], _ONE)
    parts += _constant_lines(
        name, 3, ["''", "'### ' || upper(left(status, 1)) || substr(status, 2)", "''"],
        "(select distinct status, rank as state_rank from ranked_conditions)",
        rank="state_rank", position="-1",
    )
    parts += detail_lines(
        3, "ranked_conditions",
        [
            "'- **' || name || '**'",
            "'  - ' || origin",
            "case when details <> '' then '  - ' || trim(details) end",
        ],
        rank="ranked_conditions.rank", position="ranked_conditions.position",
    )
    parts += _constant_lines(name, 4, ["''", "'## Genetic Variants'", "''"], _ONE)
    parts += detail_lines(
        5, "variants",
        [
            "'- **' || finding || '**'",
            "'  - Implication: ' || coalesce(implication, '-')",
            "'  - Relevance: ' || coalesce(relevance, '-')",
            origin,
        ],
        position="variants.position",
    )
    parts += _constant_lines(name, 6, ["''", "'## Chronic Patterns'", "''"], _ONE)
    confirmed = "coalesce(cast(last_confirmed as varchar), 'unknown')"
    parts.append(
        _line_select(
            name, 7, f"'- ' || finding || ' (last confirmed: ' || {confirmed} || ')'",
            src="patterns", position="patterns.position",
        )
    )
    parts += _constant_lines(name, 8, ["''", "'## Report Sources'", "''"], _ONE)
    parts.append(
        _line_select(
            name, 9, f"'- ' || {_DAY} || ': ' || report_type || ' (' || provider || ')'",
            src="dim", rank=_OLDEST, item="source_file",
        )
    )
    return " union all ".join(parts)


def _findings_lines() -> str:
    name = "findings"
    told = "(select * from dim where document_summary is not null or baseline_candidates is not null)"
    result = f"""'  ' || {_DAY} || ' | ' || biomarker_key || ': '
      || coalesce(printf('%.2f', value_si), value_raw) || ' ' || coalesce(unit_si, '') || ' ('
      || provider || ') - ' || case when is_within_ref_range then 'in range'
         when not is_within_ref_range then 'OUT OF RANGE' else 'unknown' end"""
    opening = [
        "''",
        f"'--- ' || {_DAY} || ' | ' || report_type || ' (' || provider || ') ---'",
        "nullif(document_summary, '')",
        "case when source_file in (select source_file from candidates) "
        "then 'Baseline candidates:' end",
    ]
    parts = [_line_select(name, 0, "'Recent biomarker results:'", src=_ONE)]
    parts.append(
        _line_select(
            name, 1, result, src="fct", rank=_NEWEST, label="biomarker_key", item="lab_result_id"
        )
    )
    parts += _constant_lines(
        name, 2, ["''", "'Document summaries and baseline candidates:'"], _ONE
    )
    parts += [
        f"select * from ({one}) where line is not null"
        for one in _constant_lines(name, 3, opening, told, rank=_NEWEST, item="source_file")
    ]
    parts.append(
        _line_select(
            name, 3, "'  - ' || candidate", src="candidates", rank=_NEWEST, item="source_file",
            position="candidates.position + 1",
        )
    )
    return " union all ".join(parts)


def _check(check: str, table: str, column: str, severity: str, failures: str) -> str:
    return (
        f"select '{check}' as \"check\", '{table}' as \"table\", '{column}' as \"column\", "
        f"'{severity}' as severity, ({failures}) as failures, ({failures}) = 0 as passed"
    )


def _repeated(src: str, column: str) -> str:
    return (
        f"select count(*) from (select {column} from {src} where {column} is not null "
        f"group by {column} having count(*) > 1)"
    )


def _nulls(src: str, column: str) -> str:
    return f"select count(*) from {src} where {column} is null"


_ORPHANS = "select count(*) from fct where biomarker_key not in (select biomarker_key from meta)"
_UNIQUE = [
    ("lab_results", "lab_results", ["id"]),
    ("docs", "documents", ["id", "source_file"]),
    ("stg", "stg_lab_results", ["lab_result_id"]),
    ("fct", "fct_biomarkers", ["lab_result_id"]),
    ("dim", "dim_documents", ["document_id", "source_file"]),
]
_NOT_NULL = [
    ("lab_results", "lab_results", ["id", "source_file", "biomarker_name_raw", "value_raw"]),
    ("docs", "documents", ["id", "source_file"]),
    ("stg", "stg_lab_results", ["lab_result_id", "biomarker_name"]),
    ("fct", "fct_biomarkers", ["lab_result_id", "biomarker_key", "value_si"]),
    ("dim", "dim_documents", ["document_id", "source_file"]),
]


def _declared() -> str:
    rows = [
        _check("unique", name, c, "error", _repeated(src, c))
        for src, name, columns in _UNIQUE
        for c in columns
    ]
    rows += [
        _check("not_null", name, c, "warn" if c == "value_si" else "error", _nulls(src, c))
        for src, name, columns in _NOT_NULL
        for c in columns
    ]
    rows.append(_check("relationships", "fct_biomarkers", "biomarker_key", "warn", _ORPHANS))
    return " union all ".join(rows)


def _constraints() -> str:
    required = {
        "lab_results": "id source_file extracted_at extraction_method report_date provider "
        "biomarker_name_raw value_raw unit_raw",
        "docs": "id source_file report_type biomarker_count extracted_at extraction_method",
    }
    shown = {"lab_results": "lab_results", "docs": "documents"}
    rows = [
        _check("unique", "lab_results", "id", "error", _repeated("lab_results", "id")),
        _check("unique", "documents", "id", "error", _repeated("docs", "id")),
        _check("unique", "documents", "source_file", "error", _repeated("docs", "source_file")),
    ]
    rows += [
        _check("not_null", shown[src], c, "error", _nulls(src, c))
        for src, names in required.items()
        for c in names.split()
    ]
    return " union all ".join(rows)


_EXPORTED = f"""with {files._KEPT} select
            case when k = 9 then 'unknown' else cast(year(ts) as varchar) end as year,
            case when k = 9 then 'unknown' else cast(cast(ts as date) as varchar) end || '_'
              || case when k = 9 then 'unknown' else 'lab_' || cast(user_id % 10 as varchar) end
              || strftime(extracted, '_%H%M%S') || '.json' as json_name,
            case when k = 9 then 'unknown' else cast(cast(ts as date) as varchar) end
              || '_blood_panel_'
              || case when k = 9 then 'unknown' else 'lab_' || cast(user_id % 10 as varchar) end
              || '.md' as narrative_name, source_file from chosen"""


def _number(column: str) -> str:
    return f"try_cast(regexp_extract({column}, '[0-9]+') as bigint)"


# After a deletion and a second load: the same sources, later ones with another lower bound.
_BOUND = f"""lab_results as (
  select * replace (
    case when {_number("source_file")} >= {SECOND_LOAD} and reference_range_low_raw is not null
         then '20' else reference_range_low_raw end as reference_range_low_raw)
  from ({files.MEASUREMENTS}))"""
_LOADED_DOCS = f"docs as ({files.DOCUMENTS})"

# The history by what the first run saw, and what stands after the second.
_REFRESHED_HISTORY = f"""with {_BOUND}, {STG},
first_stg as (
  with lab_results as (
    select * from lab_results
    where {_number("source_file")} is null or {_number("source_file")} < {SECOND_LOAD}),
  {STG} select * from stg),
newest as (
  select 1 as run, * from first_stg union all select 2, * from stg),
ranges as (
  select run, provider, biomarker_name, max_by(reference_range_low, report_date) as low,
    max_by(reference_range_high, report_date) as high, max(report_date) as day
  from newest where reference_range_low is not null or reference_range_high is not null
  group by run, provider, biomarker_name),
both_runs as (
  select coalesce(a.provider, b.provider) as provider,
    coalesce(a.biomarker_name, b.biomarker_name) as biomarker_name, a.run as had, b.run as has,
    a.low as low_1, a.high as high_1, a.day as day_1, b.low as low_2, b.high as high_2,
    b.day as day_2,
    a.low is not distinct from b.low and a.high is not distinct from b.high as same
  from (from ranges where run = 1) a full join (from ranges where run = 2) b
    on a.provider = b.provider and a.biomarker_name = b.biomarker_name)
select provider, biomarker_name, low_1 as reference_range_low, high_1 as reference_range_high,
  day_1 as last_seen_date, timestamp '{RUN_1}' as valid_from,
  case when has is not null and not same then timestamp '{RUN_2}' end as valid_to
from both_runs where had is not null
union all
select provider, biomarker_name, low_2, high_2, day_2, timestamp '{RUN_2}', null
from both_runs where has is not null and (had is null or not same)"""

# Two environments: the trial lacks documents of one kind and has other values in those of another.
_TRIAL = f"""lab_results as ({files.MEASUREMENTS}), {META}, {STG}, {FCT},
trial as (
  with lab_results as (
    select * replace (
      case when {_number("source_file")} % 20 = 15 then '9' || value_raw else value_raw end
        as value_raw)
    from lab_results where coalesce({_number("source_file")} % 20, 0) <> 14),
  {STG}, {FCT} select * from fct),
env as (select * from trial)"""

_EXPORTED_FILES = f"""
with names as (
  select e.*, extracted, event_id from ({{0}}) e join (with {files._KEPT} select * from chosen) c
    using (source_file)),
named as (
  select 'raw/' || json_name as name, source_file as content, extracted, source_file from names
  union all
  select 'findings/' || year || '/' || narrative_name, 'About s' || cast(event_id as varchar),
    extracted, source_file from names)
select name, content from named
qualify row_number() over (partition by name order by extracted desc, source_file desc) = 1"""


def texts() -> dict[str, str]:
    profile = (
        f"{_CONDITIONS}, {_view('variants', views.VARIANTS)}, {_view('patterns', views.PATTERNS)}"
    )
    found = f"r{len(REDACTED)}"
    all_lines = [_snapshot_lines(), _timeline_lines(), _history_lines(), _index_lines()]
    reports = f"{BOTH}, {_SNAPSHOT}, {_INDEX}, {profile}, all_lines as ("
    reports += " union all ".join(all_lines) + ") select report, line from all_lines"
    return {
        "stage_measurements": f"with {RAW}, {STG} select * from stg",
        "censored_parse": f"""with {RAW} select id, value_raw,
            case left(value_raw, 1) when '<' then try_cast(substr(value_raw, 2) as double) / 2
              when '>' then try_cast(substr(value_raw, 2) as double)
              else try_cast(value_raw as double) end as value_numeric,
            starts_with(value_raw, '<') as below, starts_with(value_raw, '>') as above,
            cast(reference_range_low_raw as double) as low,
            cast(reference_range_high_raw as double) as high from lab_results""",
        "dedup_latest_extraction": f"""with {RAW} select a.id, a.report_date, a.provider,
            trim(a.biomarker_name_raw) as biomarker_name from lab_results a
            where not exists (select 1 from lab_results b where b.report_date = a.report_date
              and b.provider = a.provider and b.biomarker_name_raw = a.biomarker_name_raw
              and (b.extracted_at > a.extracted_at
                or (b.extracted_at = a.extracted_at and b.id > a.id)))""",
        "measurement_facts": f"{FACTS} select * from fct",
        "facts_at_scale": f"{LARGE} select * from fct",
        "reference_range_flag": f"""{FACTS} select is_within_ref_range, count(*) as facts
            from fct group by 1""",
        "optimal_range_flag": f"""{FACTS} select biomarker_key, is_within_optimal_range,
            count(*) as facts from fct group by 1, 2""",
        "to_conventional_units": f"""{FACTS} select lab_result_id, biomarker_key, value_si,
            value_si / ifnull(conversion_factor, 1) as value_conventional,
            ifnull(conventional_unit, unit_original) as unit_conventional
            from fct left join meta using (biomarker_key)""",
        "document_dimension": f"{BOTH} select * from dim",
        "document_dimension_at_scale": f"""{LARGE}, {_view('docs', views.DOCUMENTS_LARGE)},
            counts as (select source_file, count(*) as n from stg group by 1)
            select id as document_id, source_file, report_date, provider, report_type, tags,
              markdown_path, ifnull(n, 0) as biomarker_count, extracted_at, extraction_method,
              document_summary, baseline_candidates
            from docs left join counts using (source_file)""",
        "current_snapshot": f"{FACTS}, {_SNAPSHOT} select * from snapshot",
        "current_snapshot_at_scale": f"{LARGE}, {_SNAPSHOT} select * from snapshot",
        "current_snapshot_per_subject": f"with {RAW_SUBJECT}, {META}, {STG_SUBJECT}, "
        f"{FCT_SUBJECT}, {_per_subject(_SNAPSHOT)} select * from snapshot",
        "timeline": f"""{BOTH} select report_date, provider, report_type, source_file,
            biomarker_count, tags from dim""",
        "report_index": f"{BOTH}, {_INDEX} select * from index_rows",
        "latest_per_key": f"""{FACTS} select biomarker_key, value_si, unit_si, report_date, category,
            is_within_ref_range, is_within_optimal_range from fct
            qualify rank() over (partition by biomarker_key order by report_date desc) = 1""",
        "key_trend": f"""{FACTS} select report_date, value_si, unit_si, provider,
            is_within_ref_range, is_within_optimal_range from fct where biomarker_key = 'view'""",
        "newest_out_of_range": f"""{FACTS} select biomarker_key, value_si, unit_si,
            reference_range_low_si, reference_range_high_si from fct
            where not is_within_ref_range and report_date = (select max(report_date) from fct)""",
        "outside_optimal": f"""{FACTS} select biomarker_key, value_si, unit_si,
            optimal_range_low_si, optimal_range_high_si, report_date from fct
            where not is_within_optimal_range""",
        "report_inventory": f"""{BOTH} select report_date, provider, report_type, biomarker_count,
            tags from dim""",
        "category_summary": f"""{FACTS} select category,
            count(distinct biomarker_key) as unique_biomarkers,
            count(distinct report_date) as report_count from fct group by category""",
        "count_per_source": f"""with {RAW} select source_file, count(*) as measurements
            from lab_results group by 1""",
        "facts_on_date": f"""{FACTS} select * from fct where report_date = date '2024-01-20'""",
        "recent_facts": f"""{FACTS} select biomarker_key, value_si, unit_si, report_date,
            is_within_ref_range, is_within_optimal_range from fct""",
        "document_context": f"""{BOTH} select source_file, report_date, report_type,
            document_summary, baseline_candidates from dim""",
        "load_status": f"""with {RAW}, {DOCS} select
            (select count(*) from docs) as reports,
            (select min(report_date) from docs) as first_report,
            (select max(report_date) from docs) as last_report,
            (select count(distinct biomarker_name_raw) from lab_results) as unique_biomarkers,
            (select count(*) from lab_results) as measurements""",
        "compare_environments": f"""{FACTS}, {_ENV}, {_PAIRS}
            select * exclude (prod_source, env_source) from pairs where status <> 'SAME'""",
        "compare_filtered": f"""{FACTS}, {_ENV}, {_PAIRS}
            select * exclude (prod_source, env_source) from pairs where status <> 'SAME'
              and (prod_source = '{SOURCE}' or env_source = '{SOURCE}')""",
        "compare_at_scale": f"""{LARGE.replace("fct as (", "fct as materialized (")}, {_ENV_LARGE}, {_PAIRS}
            select * exclude (prod_source, env_source) from pairs where status <> 'SAME'""",
        "compare_summary": f"""{FACTS}, {_ENV}, {_PAIRS}
            select 'prod rows' as measure, count(*) as rows from fct
            union all select 'env rows', count(*) from env
            union all select status, count(*) from pairs group by 1""",
        "reference_range_snapshot": f"""with {RAW}, {STG}, {_RANGES}
            select provider, biomarker_name, low as reference_range_low,
              high as reference_range_high, max(report_date) as last_seen_date
            from bounded group by all""",
        "reference_range_history": f"""with {RAW}, {STG}, {_RANGES},
            marked as (select *, case when row_number() over dated = 1
                  or low is distinct from lag(low) over dated
                  or high is distinct from lag(high) over dated then 1 else 0 end as starts
              from bounded
              window dated as (partition by provider, biomarker_name order by report_date)),
            numbered as (select *, sum(starts) over (partition by provider, biomarker_name
                order by report_date) as version from marked),
            versions as (select provider, biomarker_name, version, low as reference_range_low,
                high as reference_range_high, max(report_date) as last_seen_date,
                min(report_date) as valid_from from numbered group by all)
            select * exclude (version), lead(valid_from) over (
                partition by provider, biomarker_name order by valid_from) as valid_to
            from versions""",
        "scd2_merge": f"with {RAW}, {STG}, {_RANGES}, {_MERGE}",
        "dq_unique": f"{BOTH} " + " union all ".join(
            _check("unique", name, c, "error", _repeated(src, c))
            for src, name, columns in _UNIQUE for c in columns
        ),
        "dq_unique_failing": _check(
            "unique", "lineitem", "l_orderkey", "error", _repeated("lineitem", "l_orderkey")
        ),
        "dq_not_null": f"{BOTH} " + " union all ".join(
            _check("not_null", "fct_biomarkers", c, "warn", _nulls("fct", c))
            for c in ("lab_result_id", "value_si", "category", "is_within_ref_range")
        ),
        "dq_relationships": f"{BOTH} "
        + _check("relationships", "fct_biomarkers", "biomarker_key", "warn", _ORPHANS),
        "dq_relationships_at_scale": f"{LARGE} "
        + _check(
            "relationships", "stg_lab_results", "biomarker_name", "error",
            "select count(*) from stg where biomarker_name not in (select biomarker_key from meta)",
        ),
        "dq_declared_checks": f"{BOTH} {_declared()}",
        "dq_constraints": f"with {RAW}, {DOCS} {_constraints()}",
        "dq_unit_mismatch": f"""{FACTS} select lab_result_id, biomarker_key, unit_original,
            conventional_unit from (select * from fct
              union all select * replace ('eur' as unit_original) from fct) f
            join meta using (biomarker_key)
            where conversion_factor <> 1 and unit_original is distinct from conventional_unit""",
        "redact_text": f"with {_redaction()} select doc_id, t as text, found from {found}",
        "redact_many": f"""
            with words as (
              select distinct unnest(regexp_extract_all(text, '{PLAIN_WORD}')) as w from documents),
            longest as (select w from words order by length(w) desc, w limit {LISTED}),
            listed as (
              select list(n || chr(31) || w order by n) as strings
              from (select w, row_number() over (order by length(w) desc, w) as n from longest))
            select doc_id, list_reduce(list_prepend(text, strings),
              lambda t, s: replace(t, split_part(s, chr(31), 2),
                '[REDACTED_' || split_part(s, chr(31), 1) || ']')) as text
            from documents, listed""",
        "redact_restore": "select doc_id, text from documents",
        "fenced_block": _FENCED,
        "responses_to_documents": """select 'doc_' || doc_id as source_file, text as document_summary,
            lang as report_type, cast(1 as integer) as biomarker_count,
            'manual' as extraction_method from documents""",
        "candidates_exploded": f"""with {DOCS}, {_CANDIDATES} select * from candidates""",
        "findings_feed": f"""{FACTS} select report_date, biomarker_key, lab_result_id, value_raw,
            value_si, unit_si, provider, case is_within_ref_range when true then 'in range'
              when false then 'OUT OF RANGE' else 'unknown' end as range_label from fct""",
        "conditions_by_priority": f"""with {_CONDITIONS} select name, status, rank, position, origin
            from ranked_conditions""",
        "snapshot_lines": f"{FACTS}, {_SNAPSHOT} {_snapshot_lines()}",
        "timeline_lines": f"{BOTH} {_timeline_lines()}",
        "index_lines": f"{BOTH}, {_INDEX} {_index_lines()}",
        "history_lines": f"{BOTH}, {profile} {_history_lines()}",
        "findings_lines": f"{BOTH}, {_CANDIDATES} {_findings_lines()}",
        "report_lines": f"{BOTH}, {_SNAPSHOT}, {_INDEX}, {profile} " + " union all ".join(all_lines),
        "reports_written": reports,
        "workflow_facts": f"with lab_results as ({files.MEASUREMENTS}), {META}, {STG}, {FCT} "
        "select * from fct",
        "facts_in_sql": f"""{FACTS},
            stepped as (select *, lag(value_si) over (
              partition by biomarker_key order by report_date, lab_result_id) as before from fct)
            select lab_result_id, value_si,
              case when conversion_factor is null then value_si
                   when conversion_factor <> 0 then value_si / conversion_factor end
                as value_conventional,
              case when is_below_detection_limit then 'BDL' when is_within_optimal_range then 'Optimal'
                   when is_within_ref_range then 'Normal' when not is_within_ref_range then '**OUT**'
                   else '-' end as status,
              case when value_si is null or before is null then ''
                   when before = 0 or abs((value_si - before) / before) * 100 < 3 then '-'
                   when value_si > before then '^' else 'v' end as trend
            from stepped left join meta using (biomarker_key)""",
        "workflow_run": f"with lab_results as ({files.MEASUREMENTS}), {META}, {STG}, {FCT} "
        "select * from fct",
        "refreshed_facts": f"with {_BOUND}, {META}, {STG}, {FCT} select * from fct",
        "refreshed_documents": f"with {_BOUND}, {STG}, {_LOADED_DOCS}, {DIM} select * from dim",
        "refreshed_history": _REFRESHED_HISTORY,
        "environments_compared": f"""with {_TRIAL}, {_PAIRS}
            select * exclude (prod_source, env_source) from pairs where status <> 'SAME'""",
        "environments_in_sql": f"""with {_TRIAL},
            counts as (select source_file, count(*) as n from fct group by 1),
            trial_counts as (select source_file, count(*) as n from trial group by 1)
            select d.source_file, coalesce(c.n, 0) as biomarker_count,
              case when coalesce({_number("d.source_file")} % 20, 0) <> 14 then coalesce(t.n, 0) end
                as trial_count,
              f.value_si, g.value_si as trial_value, f.biomarker_key, l.value_raw,
              case when l.id is not null then 'first' end as load_batch
            from ({files.DOCUMENTS}) d left join counts c using (source_file)
            left join trial_counts t using (source_file)
            left join fct f using (source_file)
            left join trial g on g.lab_result_id = f.lab_result_id
            left join lab_results l on l.id = f.lab_result_id""",
        "compare_by_digest": f"""{FACTS}, {_ENV}, {_PAIRS}
            select * exclude (prod_source, env_source) from pairs where status <> 'SAME'""",
        "exported_files": _EXPORTED_FILES.format(_EXPORTED),
        "report_files": reports,
        "stateful_ingest": files.MEASUREMENTS,
        "deleted_source_rewritten": f"select * from ({files.MEASUREMENTS}) "
        f"where source_file not in {DELETED}",
        "purged_files": f"select * from ({files.MEASUREMENTS}) where source_file not in {DELETED}",
        "reloaded_source": f"select *, case when source_file in {DELETED} then 'second' "
        f"else 'first' end as load_batch from ({files.MEASUREMENTS})",
        "dimension_from_csv": f"with {META} select * from meta",
        "older_documents": f"""with {DOCS} select * replace (cast(null as varchar) as document_summary,
            cast(null as varchar) as baseline_candidates), 'old' as load_batch from docs""",
        "exported_documents": _EXPORTED,
        "flatten_documents": files.DOCUMENTS,
        "flatten_measurements": files.MEASUREMENTS,
        "ingest_quarantine": files.REJECTED,
        "ingest_statistics": files.STATISTICS,
        "ingest_idempotent": files.FRESH,
        "incremental_ingest": files.MEASUREMENTS,
        "delete_source": f"""with {RAW} select * from lab_results
            where source_file not in ('doc_7', 'doc_8')""",
        "export_names": _EXPORTED,
    }
