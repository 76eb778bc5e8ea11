"""Queries p2 to p6: changes, histories, orphan references, rolling totals and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.history import attribute_history
from codestrata.operators.intervals import periods_and_gaps
from codestrata.operators.references import Reference, orphan_counts, orphan_references
from codestrata.operators.rolling import peak_days, trailing_totals
from codestrata.operators.snapshots import snapshot_changes
from codestrata.plans.registry import Registry
from codestrata.session import materialize
from codestrata.streaming.activity import stream_files, written
from codestrata.streaming.intervals import joined_periods, live_periods
from codestrata.tables import folded, holding, micros, read, reference, utc_day

registry = Registry()
SPANS = [7, 30]


def canonical_path(path: str) -> F.Column:
    """Forward slashes and a leading slash; letter case stays."""
    slashed = F.translate(F.col(path), "\\", "/")
    return F.when(slashed.startswith("/"), slashed).otherwise(F.concat(F.lit("/"), slashed))


P2_SQL = """
with r as (
  select snapshot_date d, repository_id repo, lower(trim(fingerprint_hash, e' \\t\\r\\n')) fp,
    case when starts_with(replace(file_path, '\\', '/'), '/') then replace(file_path, '\\', '/') else '/' || replace(file_path, '\\', '/') end path,
    line_number line, lower(trim(severity, e' \\t\\r\\n')) sev, loaded_at
  from issue_snapshots where snapshot_date is not null
), h as (
  select * from r qualify row_number() over (partition by repo, d, fp order by loaded_at desc) = 1
), dl as (
  select repo, d, lag(d) over (partition by repo order by d) prev from (select distinct repo, d from r)
), cur as (
  select h.repo, h.d, h.fp, h.path, h.line, h.sev from h join dl on h.repo = dl.repo and h.d = dl.d where dl.prev is not null
), old as (
  select h.repo, dl.d, h.fp, h.path, h.line, h.sev from h join dl on h.repo = dl.repo and h.d = dl.prev
), j as (
  select coalesce(cur.d, old.d) d, coalesce(cur.repo, old.repo) repo, coalesce(cur.fp, old.fp) fp,
    case when old.d is null then 'added' when cur.d is null then 'removed'
      when cur.path is distinct from old.path or cur.line is distinct from old.line or cur.sev is distinct from old.sev then 'changed' end kind
  from cur full join old on cur.repo = old.repo and cur.fp = old.fp and cur.d = old.d
)
select strftime(d, '%Y-%m-%d') as snapshot_date, repo as repository_id, fp as fingerprint_hash, kind as change_kind from j where kind is not null
"""


@registry.add("p2_found", P2_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints added, removed or changed in each delivery of a repository."""
    found = snapshot_changes(
        read(spark, sf_dir, "issue_snapshots"),
        date=F.col("snapshot_date"),
        scope=F.col("repository_id"),
        key=folded("fingerprint_hash"),
        compared=[canonical_path("file_path"), F.col("line_number"), folded("severity")],
        loaded=F.col("loaded_at"),
    )
    return found.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), F.col("scope").alias("repository_id"), F.col("record").alias("fingerprint_hash"), "change_kind")


P3_SQL = """
with w as (
  select id, epoch_us(updated_at) ts, lower(trim(status, e' \\t\\r\\n')) status, epoch_us(resolved_at) resolved,
    nullif(nullif(lower(trim(analysis_run_id, e' \\t\\r\\n{}')), ''), '00000000-0000-0000-0000-000000000000') run, loaded_at
  from technical_debt_issues where updated_at is not null and id is not null
), h as (
  select * from w qualify row_number() over (partition by id, ts order by loaded_at desc, status desc, resolved desc, run desc) = 1
), c as (
  select *, lag(ts) over o is null or status is distinct from lag(status) over o
    or resolved is distinct from lag(resolved) over o or run is distinct from lag(run) over o as starts
  from h window o as (partition by id order by ts)
)
select id, ts as valid_from_us, coalesce(lead(ts) over (partition by id order by ts), -1) as valid_to_us from c where starts
"""


def issue_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of status, resolution time and run of an issue."""
    return attribute_history(
        [read(spark, sf_dir, "technical_debt_issues")],
        entity=F.col("id"),
        at_us=micros("updated_at"),
        loaded=F.col("loaded_at"),
        attributes={"status": folded("status"), "resolved_at_us": micros("resolved_at"), "analysis_run_id": reference("analysis_run_id")},
    )


@registry.add("p3_found", P3_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issue_history(spark, sf_dir).select(F.col("entity").alias("id"), "valid_from_us", F.coalesce("valid_to_us", F.lit(-1)).alias("valid_to_us"))


P3_VERSIONS_SQL = P3_SQL.replace("-1) as valid_to_us from c", "-1) as valid_to_us, coalesce(status, '') as status, coalesce(resolved, -1) as resolved_at_us, coalesce(run, '') as analysis_run_id from c")


@registry.add("p3_versions", P3_VERSIONS_SQL)
def p3_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions with their attributes; '' and -1 stand for NULL."""
    return issue_history(spark, sf_dir).select(
        F.col("entity").alias("id"),
        "valid_from_us",
        F.coalesce("valid_to_us", F.lit(-1)).alias("valid_to_us"),
        F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("resolved_at_us", F.lit(-1)).alias("resolved_at_us"),
        F.coalesce("analysis_run_id", F.lit("")).alias("analysis_run_id"),
    )


_KEY_SQL = "nullif(nullif(lower(trim({c}, e' \\t\\r\\n{{}}')), ''), '00000000-0000-0000-0000-000000000000')"
_CHILD_SQL = "select '{t}' tn, '{c}' cn, {i} row_id, " + _KEY_SQL + " k, loaded_at l, '{p}' target from {t}"
P4_CTE = (
    "with ch as ("
    + " union all ".join(
        _CHILD_SQL.format(t=t, c=c, i="id", p=p)
        for t, c, p in [
            ("technical_debt_issues", "analysis_run_id", "analysis_runs"),
            ("complexity_metrics", "analysis_run_id", "analysis_runs"),
            ("issue_comments", "issue_id", "technical_debt_issues"),
            ("technical_debt_issues", "assigned_to_user_id", "users"),
        ]
    )
    + "), c as (select tn, cn, row_id, k, target, min(l) l from ch where k is not null group by all), p as ("
    + " union all ".join(f"select '{t}' target, {_KEY_SQL.format(c='id')} k, min(loaded_at) l from {t} group by 2" for t in ("analysis_runs", "technical_debt_issues", "users"))
    + "), f as (select tn, cn, row_id, c.k, case when p.k is null then 'missing' when c.l < p.l then 'late' end kind, c.l from c left join p on c.target = p.target and c.k = p.k)"
)
P4_SQL = P4_CTE + " select tn as table_name, cn as column_name, row_id, k as key_value, kind from f where kind is not null"
P4_COUNTS_SQL = P4_CTE + " select tn as table_name, cn as column_name, kind, strftime(date_trunc('month', l), '%Y-%m-%d') as period, count(*) as n_rows, count(distinct k) as n_keys from f where kind is not null group by all"


def issue_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, issues, metrics, comments, users = (read(spark, sf_dir, t) for t in ("analysis_runs", "technical_debt_issues", "complexity_metrics", "issue_comments", "users"))

    def ref(table: str, child: DataFrame, column: str, target: str, parent: DataFrame) -> Reference:
        return Reference(table, column, child, F.col("id"), reference(column), F.col("loaded_at"), target, parent, reference("id"), F.col("loaded_at"))

    return orphan_references(
        [
            ref("technical_debt_issues", issues, "analysis_run_id", "analysis_runs", runs),
            ref("complexity_metrics", metrics, "analysis_run_id", "analysis_runs", runs),
            ref("issue_comments", comments, "issue_id", "technical_debt_issues", issues),
            ref("technical_debt_issues", issues, "assigned_to_user_id", "users", users),
        ]
    )


@registry.add("p4_found", P4_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issue_orphans(spark, sf_dir).drop("first_loaded")


@registry.add("p4_counts", P4_COUNTS_SQL)
def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per table, column, kind and month of landing."""
    return orphan_counts(issue_orphans(spark, sf_dir))


P5_CTE = """
with s as (
  select repository_id repo, cast(snapshot_date as date) d, technical_debt_hours h from repository_metrics_snapshots where snapshot_date is not null
  qualify row_number() over (partition by repository_id, cast(snapshot_date as date) order by created_at desc, id desc) = 1
), b as (select repo, min(d) a, max(d) z from s group by repo),
cal as (select repo, cast(unnest(generate_series(cast(a as timestamp), cast(z as timestamp), interval 1 day)) as date) d from b),
f as (select cal.repo, cal.d, coalesce(s.h, 0) h from cal left join s on s.repo = cal.repo and s.d = cal.d),
t as (
  select repo, d, sum(h) over (partition by repo order by d rows between 6 preceding and current row) t7,
    sum(h) over (partition by repo order by d rows between 29 preceding and current row) t30 from f
)
"""
P5_SQL = (
    P5_CTE
    + ", u as (select repo, d, 7 span, t7 t from t union all select repo, d, 30, t30 from t)"
    + " select repo as repository_id, strftime(d, '%Y-%m-%d') as day, cast(span as integer) as span_days from u where t > 0 qualify t = max(t) over (partition by repo, span)"
)
P5_ROLLING_SQL = P5_CTE + " select repo as repository_id, strftime(d, '%Y-%m-%d') as day, t7 as total_7, round(t7 / 7, 6) as average_7, t30 as total_30, round(t30 / 30, 6) as average_30 from t"


def debt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "repository_metrics_snapshots").select(F.col("repository_id").alias("entity"), utc_day("snapshot_date").alias("day"), "created_at", "id", F.col("technical_debt_hours").alias("amount"))
    return trailing_totals(holding(rows, ["entity", "day"], ["created_at", "id"], ["amount"]), SPANS)


@registry.add("p5_found", P5_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak_days(debt_totals(spark, sf_dir), SPANS).select(F.col("entity").alias("repository_id"), F.date_format("day", "yyyy-MM-dd").alias("day"), "span_days")


@registry.add("p5_rolling", P5_ROLLING_SQL)
def p5_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and average debt hours over 7 and 30 days, for every repository and day."""
    totals = debt_totals(spark, sf_dir)
    return totals.select(F.col("entity").alias("repository_id"), F.date_format("day", "yyyy-MM-dd").alias("day"), "total_7", F.round("average_7", 6).alias("average_7"), "total_30", F.round("average_30", 6).alias("average_30"))


P6_SQL = """
with h as (
  select * from analysis_runs qualify row_number() over (partition by id order by updated_at desc, loaded_at desc) = 1
), i as (
  select repository_id repo, epoch_us(started_at) s, epoch_us(completed_at) e from h where completed_at > started_at
), m as (
  select *, max(e) over (partition by repo order by s, e rows between unbounded preceding and 1 preceding) reach from i
), g as (
  select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by repo order by s, e rows unbounded preceding) n from m
), p as (select repo, n, min(s) s, max(e) e from g group by all),
x as (select repo, e as s, lead(s) over (partition by repo order by s) e from p)
select repo as repository_id, 'period' as kind, s as start_us, e as end_us from p
union all select repo, 'gap', s, e from x where e is not null
"""


@registry.add("p6_found", P6_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of scanning of each repository, and the gaps between them."""
    runs = holding(read(spark, sf_dir, "analysis_runs"), ["id"], ["updated_at", "loaded_at"], ["repository_id", "started_at", "completed_at"])
    return periods_and_gaps(runs, F.col("repository_id"), micros("started_at"), micros("completed_at")).withColumnRenamed("entity", "repository_id")


@registry.add("p6_live", P6_SQL)
def p6_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the stream: runs come as files, keyed state holds an interval map per repository and slice, and what it told is joined."""
    runs = holding(read(spark, sf_dir, "analysis_runs"), ["id"], ["updated_at", "loaded_at"], ["repository_id", "started_at", "completed_at"])
    rows = runs.select(F.col("repository_id").alias("entity"), micros("started_at").alias("start_us"), micros("completed_at").alias("end_us"))
    stream = stream_files(spark, materialize(rows, "runs"), ", ".join(f"{c} {t}" for c, t in rows.dtypes), per_batch=64)
    return joined_periods(written(live_periods(stream), "live-periods")).withColumnRenamed("entity", "repository_id")
