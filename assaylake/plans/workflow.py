"""Load, transform and report for one environment (CP10, CP11, SNK13).

Staging, marts and open ranges are tables in hash buckets (``assaylake.sources.versions``): a run writes
buckets under its own number and makes all of them visible by one small write at its end.
``transform`` writes every bucket; ``refresh`` only those that the loads and deletions since the last run touch.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions.sql import create_functions
from assaylake.operators import digests, history, marts
from assaylake.operators.compare import compare_facts
from assaylake.operators.staging import newest_staged, stage_measurements
from assaylake.plans import report_lines
from assaylake.sources import extraction, raw_tables, versions
from assaylake.sources.raw_tables import ATTEMPT, BATCH
from assaylake.sources.shared import small_files

STAGED, FACTS, DOCUMENTS = "stg_lab_results", "fct_biomarkers", "dim_documents"
META, RANGES = "biomarker_meta", "snap_reference_ranges"
OPEN, CLOSED, INCLUDED = "snap_open_ranges", "snap_closed_ranges", "included"
#: Buckets of each table; a table of hundreds of terabytes wants thousands.
BUCKETS = 16

#: The columns that decide a row's bucket. A date holds whole keys of the deduplication, and a load touches few.
BUCKETED_BY = {
    STAGED: ("report_date",),
    FACTS: ("report_date",),
    DOCUMENTS: ("source_file",),
    OPEN: ("provider", "biomarker_name"),
}


def read_mart(spark: SparkSession, root: str, name: str) -> DataFrame:
    return versions.read(spark, root, name)


def _bucket(table: str, buckets: int) -> Column:
    return versions.bucket_of(buckets, *BUCKETED_BY[table])


def _write(df: DataFrame, root: str, table: str, run: int, buckets: int) -> list[versions.Entry]:
    return versions.write(df, root, table, run, _bucket(table, buckets), buckets)


def _instant(spark: SparkSession, run_ts: Column | None) -> Column:
    """The run's time, evaluated once: several writes show it."""
    run_ts = F.localtimestamp() if run_ts is None else run_ts
    return F.lit(spark.range(1).select(run_ts.cast("string")).first()[0]).cast("timestamp_ntz")


def _loads(spark: SparkSession, root: str) -> DataFrame:
    """``kind, id, load_batch``: finished attempts and deletions, a row for each."""
    attempts = raw_tables.stored_rows(spark, root, raw_tables.ATTEMPTS)
    deletions = raw_tables.stored_rows(spark, root, raw_tables.DELETED)
    attempts = attempts.where(F.col("replaces").isNull())  # a purge brings nothing new
    loads = attempts.select(F.lit("load").alias("kind"), F.col(ATTEMPT).alias("id"), BATCH)
    gone = deletions.select(F.lit("deletion").alias("kind"), F.col("deletion").alias("id"), BATCH)
    return loads.unionByName(gone).where(F.col("id").isNotNull()).distinct()


def _included_path(root: str) -> str:
    return versions.table_path(root, INCLUDED)


def _up_to(df: DataFrame, run: int) -> DataFrame:
    return df.where(F.col(versions.RUN) <= run).drop(versions.RUN)


def transform(
    spark: SparkSession,
    root: str,
    meta: DataFrame,
    run_ts: Column | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Write staging, both marts and the range history anew, each read by what follows it, and switch to
    them at once. Readers keep the version before until then."""
    before, listed = versions.current(spark, root), versions.entries(spark, root)
    run = before + 1
    loads = spark.createDataFrame(_loads(spark, root).collect(), "kind string, id string, load_batch string")
    raw = raw_tables.read_raw(spark, root, "lab_results").drop(BATCH)
    docs = raw_tables.read_raw(spark, root, "documents").drop(BATCH)
    new = versions.write(meta, root, META, run, F.lit(0))
    new += _write(stage_measurements(raw), root, STAGED, run, buckets)
    staged, meta = (versions.read(spark, root, t, new) for t in (STAGED, META))
    new += _write(marts.measurement_facts(staged, meta), root, FACTS, run, buckets)
    new += _write(marts.document_dimension(docs, staged), root, DOCUMENTS, run, buckets)
    ranges = _merged_ranges(spark, root, listed, history.newest_range(staged), run, run_ts, buckets, None)
    versions.save(loads.coalesce(1), f"{_included_path(root)}/{versions.RUN}={run}")
    versions.commit(spark, root, run, new + ranges)


def _merged_ranges(
    spark: SparkSession,
    root: str,
    listed: list[versions.Entry],
    batch: DataFrame,
    run: int,
    run_ts: Column | None,
    buckets: int,
    touched: Iterable[int] | None,
) -> list[versions.Entry]:
    """Merge the newest ranges of some keys into the open versions of their buckets, by default all, and add the
    versions that this closes; returns the entries of the open ones."""
    run_ts = _instant(spark, run_ts)
    old = [e for e in listed if e.table == OPEN]
    if old:
        merged = history.merge_range_history(
            versions.read(spark, root, OPEN, old, touched), batch, run_ts
        )
    else:
        merged = history.open_history(batch, run_ts)
    is_open = F.col("valid_to").isNull()
    new = _write(merged.where(is_open), root, OPEN, run, buckets)
    versions.save(merged.where(~is_open), f"{versions.table_path(root, CLOSED)}/{versions.RUN}={run}")
    return new if touched is None else versions.replaced(old, OPEN, touched, new)


def read_range_history(spark: SparkSession, root: str) -> DataFrame | None:
    """Versions closed by finished runs and the open ones of the last."""
    listed = versions.entries(spark, root)
    if not any(e.table == OPEN for e in listed):
        return None
    closed = _up_to(spark.read.parquet(versions.table_path(root, CLOSED)), versions.current(spark, root))
    return closed.unionByName(versions.read(spark, root, OPEN, listed))


def update_range_history(
    spark: SparkSession,
    root: str,
    staged: DataFrame,
    run_ts: Column | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Merge the newest ranges of ``staged`` into the history, as a run of its own: the other tables stay
    as the last version lists them. Versions closed before are never written again."""
    listed, run = versions.entries(spark, root), versions.current(spark, root) + 1
    others = [e for e in listed if e.table != OPEN]
    batch = history.newest_range(staged)
    ranges = _merged_ranges(spark, root, listed, batch, run, run_ts, buckets, None)
    versions.commit(spark, root, run, others + ranges)


def _numbers(df: DataFrame, bucket: Column) -> set[int]:
    """The buckets of some rows: as many at most as there are."""
    return {r[0] for r in df.select(bucket).distinct().collect()}


def refresh(
    spark: SparkSession,
    root: str,
    meta: DataFrame,
    run_ts: Column | None = None,
    buckets: int = BUCKETS,
) -> dict[str, set[int]]:
    """Bring the tables up to date with the loads and deletions since the last run; returns the buckets
    written of each.

    Of the raw tables only the batches of these loads are read, and where sources were deleted the
    rows of the dates that they had. New measurements are set against the staged ones of their
    dates, counts of documents change by what changed there, and the range history is merged for the touched
    keys alone. Without a run before, or with another dimension or number of buckets, everything is
    written anew.
    """
    listed = versions.entries(spark, root)
    wanted = {t: set(range(buckets)) for t in BUCKETED_BY}
    if not listed or not _same_frame(spark, root, listed, meta, buckets):
        transform(spark, root, meta, run_ts, buckets)
        return wanted
    before = versions.current(spark, root)
    included = _up_to(spark.read.parquet(_included_path(root)), before)
    news = _loads(spark, root).join(included, ["kind", "id"], "left_anti").collect()
    if not news:
        return {t: set() for t in BUCKETED_BY}
    run = before + 1
    fresh = {r.id: r.load_batch for r in news if r.kind == "load"}
    gone = {r.id for r in news if r.kind == "deletion"}
    gone_from = {r.load_batch for r in news if r.kind == "deletion"}

    def added(table: str) -> DataFrame:
        """Rows of the new loads, from their batches' files alone."""
        rows = raw_tables.counted_rows(spark, root, table)
        return rows.where(F.col(BATCH).isin(*set(fresh.values())) & F.col(ATTEMPT).isin(*fresh)).drop(ATTEMPT, BATCH)

    def removed(table: str) -> DataFrame:
        marks = raw_tables.stored_rows(spark, root, raw_tables.DELETED)
        marks = marks.where(F.col("deletion").isin(*gone)).alias("x")
        rows = raw_tables.stored_rows(spark, root, table).where(F.col(BATCH).isin(*gone_from))
        return rows.alias("r").join(marks, raw_tables.same_load("r", "x"), "left_semi").drop(ATTEMPT, BATCH)

    def counted(table: str) -> DataFrame:
        return raw_tables.read_raw(spark, root, table).drop(BATCH)

    by_date, by_source = _bucket(STAGED, buckets), _bucket(DOCUMENTS, buckets)
    new_staged, lost = stage_measurements(added("lab_results")), stage_measurements(removed("lab_results"))
    lost_dates = _numbers(lost, by_date) if gone else set()
    dates = lost_dates | _numbers(new_staged, by_date)

    # where nothing was deleted the staged rows know all that is needed of the raw ones
    grown = versions.read(spark, root, STAGED, listed, dates - lost_dates)
    grown = newest_staged(grown.unionByName(new_staged.where(~by_date.isin(*lost_dates))))
    if lost_dates:
        again = counted("lab_results").where(by_date.isin(*lost_dates))
        grown = grown.unionByName(stage_measurements(again))
    staged_listed = versions.replaced(listed, STAGED, dates, _write(grown, root, STAGED, run, buckets))
    staged = versions.read(spark, root, STAGED, staged_listed, dates)
    own_meta = versions.read(spark, root, META, listed)
    facts = _write(marts.measurement_facts(staged, own_meta), root, FACTS, run, buckets)
    now = versions.replaced(staged_listed, FACTS, dates, facts)

    def per_source(entries: list[versions.Entry], name: str) -> DataFrame:
        rows = versions.read(spark, root, STAGED, entries, dates)
        return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias(name))

    counts = per_source(listed, "before").join(per_source(staged_listed, "after"), "source_file", "full")
    change = F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))
    counts = counts.select("source_file", change.alias("change")).where("change <> 0")
    new_docs, old_sources = added("documents"), removed("documents").select("source_file")
    sources = counts.select("source_file").unionByName(new_docs.select("source_file"))
    homes = _numbers(sources.unionByName(old_sources) if gone else sources, by_source)
    old_docs = versions.read(spark, root, DOCUMENTS, listed, homes)
    if gone:  # of a deleted source whatever counts now stands, in whichever load
        old_docs, new_docs = (d.join(old_sources, "source_file", "left_anti") for d in (old_docs, new_docs))
        back = counted("documents").join(old_sources, "source_file", "left_semi")
        theirs = versions.read(spark, root, STAGED, staged_listed).join(old_sources, "source_file", "left_semi")
    documents = marts.recounted(old_docs, counts).unionByName(marts.document_dimension(new_docs, staged))
    documents = documents.unionByName(marts.document_dimension(back, theirs)) if gone else documents
    written = _write(documents, root, DOCUMENTS, run, buckets)
    now = versions.replaced(now, DOCUMENTS, homes, written)

    keys, ranges = new_staged.select(*history.KEY), _bucket(OPEN, buckets)
    keys = keys.unionByName(lost.select(*history.KEY)) if gone else keys
    batch = history.newest_range(history.of_keys(versions.read(spark, root, STAGED, staged_listed), keys))
    places = _numbers(keys, ranges)
    opened = _merged_ranges(spark, root, listed, batch, run, run_ts, buckets, places)
    now = [e for e in now if e.table != OPEN] + opened

    loads = spark.createDataFrame(news, "kind string, id string, load_batch string")
    versions.save(loads.coalesce(1), f"{_included_path(root)}/{versions.RUN}={run}")
    versions.commit(spark, root, run, now)
    return {STAGED: dates, FACTS: dates, DOCUMENTS: homes, OPEN: places}


def purge(spark: SparkSession, root: str) -> list[str]:
    """Take deleted sources out of all files, those of earlier runs included; returns what was removed.

    The tables must be up to date, as a refresh reads what a deletion took. Exports and reports written before
    are the caller's. No reader may still hold an earlier version.
    """
    if versions.current(spark, root):
        before = versions.current(spark, root)
        included = _up_to(spark.read.parquet(_included_path(root)), before)
        if not _loads(spark, root).join(included, ["kind", "id"], "left_anti").isEmpty():
            raise ValueError(f"refresh before a purge: {root}")
    removed = raw_tables.purge_deleted(spark, root)
    return removed + (versions.drop_unlisted(spark, root) if versions.current(spark, root) else [])


def _same_frame(
    spark: SparkSession, root: str, listed: list[versions.Entry], meta: DataFrame, buckets: int
) -> bool:
    """Whether the last run had all tables, this dimension and this number of buckets."""
    numbers = {e.table: e.buckets for e in listed}
    if any(numbers.get(t) != buckets for t in BUCKETED_BY) or META not in numbers:
        return False
    own = versions.read(spark, root, META, listed)
    return own.columns == meta.columns and digests.equal(own, meta)


def render(
    spark: SparkSession,
    root: str,
    generated: Column | None = None,
    conditions: DataFrame | None = None,
    variants: DataFrame | None = None,
    patterns: DataFrame | None = None,
) -> None:
    """Write the four reports of the environment as text."""
    day = F.current_date() if generated is None else generated
    facts, documents = read_mart(spark, root, FACTS), read_mart(spark, root, DOCUMENTS)
    lines = report_lines.profile_lines(
        facts, documents, day, conditions=conditions, variants=variants, patterns=patterns
    )
    report_lines.write_reports(lines, f"{root}/reports")


def run(
    spark: SparkSession,
    in_dir: str,
    root: str,
    batch: str,
    meta: DataFrame,
    run_ts: Column | None = None,
    **profile: DataFrame,
) -> DataFrame:
    """Load a directory, refresh the tables, report; returns the load statistics."""
    with small_files(spark):
        files = extraction.extraction_files_by_tasks(spark, in_dir)
        statistics = raw_tables.load_files(files, root, batch)
    refresh(spark, root, meta, run_ts)
    render(spark, root, **profile)
    return statistics


def compare(
    spark: SparkSession,
    root: str,
    env: str,
    source_file: str | None = None,
) -> DataFrame:
    """Differences between production and a named environment; raises if either is missing.

    Buckets whose digests are equal in both are neither read nor joined.
    """
    homes = (raw_tables.environment_root(root), raw_tables.environment_root(root, env))
    listed = [[e for e in versions.entries(spark, h) if e.table == FACTS] for h in homes]
    numbers = {e.buckets for each in listed for e in each}
    buckets = None
    if len(numbers) == 1 and all(listed):
        known = [{e.bucket: e.digest for e in each if e.rows} for each in listed]
        buckets = digests.differing(*known)
    left, right = (
        versions.read(spark, h, FACTS, each, buckets) for h, each in zip(homes, listed, strict=True)
    )
    return compare_facts(left, right, source_file=source_file)


def database(part: str, env: str | None = None) -> str:
    """Name of the catalog database for a part of an environment's tables."""
    return f"{env}_{part}" if env else part


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def register_tables(spark: SparkSession, root: str, env: str | None = None) -> None:
    """Catalog entries for ad-hoc SQL: ``raw.*``, ``main.*`` and ``snapshots.*`` of production, and
    ``<env>_raw.*`` and so on of an environment beside it.

    All are views that show the rows that count; beside the marts stand the rules for values and labels
    as SQL functions. Register again after a load, a deletion or a run.
    """
    home = raw_tables.environment_root(root, env)
    raw, main, snapshots = (
        _quoted(database(part, env)) for part in ("raw", "main", "snapshots")
    )
    for name in (raw, main, snapshots):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    create_functions(spark, database("main", env))
    listed = versions.entries(spark, home)
    for table in (STAGED, FACTS, DOCUMENTS, META):
        _view(spark, f"{main}.{_quoted(table)}", _selected(home, table, listed))
    schema = raw_tables.stored_schema
    names = ("lab_results", "documents", raw_tables.DELETED, raw_tables.ATTEMPTS)
    files = {t: f"{raw}.{_quoted(t + '_files')}" for t in names}
    for table, name in files.items():
        path = raw_tables.table_path(home, table)
        raw_tables.stored_rows(spark, home, table).limit(0).drop(raw_tables.BATCH).write.mode(
            "append"
        ).parquet(f"{path}/{raw_tables.BATCH}=none")
        _external(spark, name, path, schema(table))
    # Attempts, a row per load, are broadcast: a table has few, and a shuffle by them would put a load in one task.
    attempts = files[raw_tables.ATTEMPTS]
    finished = f"select load_attempt from {attempts} union all select null"
    replaced = f"select load_batch, explode(replaces) as named from {attempts}"
    for table in ("documents", "lab_results"):
        columns = ", ".join(f"r.{f.name}" for f in raw_tables.TABLES[table].fields)
        _view(
            spark,
            f"{raw}.{_quoted(table)}",
            f"""SELECT /*+ BROADCAST(a, p) */ {columns}, r.load_batch FROM {files[table]} r
            LEFT SEMI JOIN ({finished}) a ON r.load_attempt <=> a.load_attempt
            LEFT ANTI JOIN ({replaced}) p ON r.load_batch = p.load_batch
              AND coalesce(r.load_attempt, '') = p.named
            LEFT ANTI JOIN {files[raw_tables.DELETED]} x ON r.source_file = x.source_file
              AND r.load_batch = x.load_batch AND r.load_attempt <=> x.load_attempt""",
        )
    if any(e.table == OPEN for e in listed):
        number, closed = versions.current(spark, home), versions.table_path(home, CLOSED)
        rows = f"SELECT * EXCEPT ({versions.RUN}) FROM parquet.{_quoted(closed)} WHERE {versions.RUN} <= {number}"
        rows += " UNION ALL " + _selected(home, OPEN, listed)
        _view(spark, f"{snapshots}.{_quoted(RANGES)}", rows)


def _selected(home: str, table: str, listed: list[versions.Entry]) -> str:
    """A table's rows as its last version lists them; its other files are pruned as partitions."""
    columns = f"* EXCEPT ({versions.RUN}, {versions.BUCKET})"
    path = _quoted(versions.table_path(home, table))
    return f"SELECT {columns} FROM parquet.{path} WHERE {versions.condition(listed, table)}"


def _view(spark: SparkSession, name: str, rows: str) -> None:
    _drop(spark, name)
    spark.sql(f"CREATE VIEW {name} AS {rows}")


def _drop(spark: SparkSession, name: str) -> None:
    """Drops a view, or a table that an earlier registration left in its place."""
    if spark.catalog.tableExists(name):
        kind = spark.catalog.getTable(name).tableType
        spark.sql(f"DROP {'VIEW' if kind == 'VIEW' else 'TABLE'} {name}")


def _external(spark: SparkSession, name: str, path: str, schema: T.StructType) -> None:
    """A catalog table over parquet files, with its partitions."""
    _drop(spark, name)
    *fields, batch = schema.fields
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*fields, batch])
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({batch.name}) "
        f"LOCATION '{location}'"
    )
    spark.catalog.recoverPartitions(name)
