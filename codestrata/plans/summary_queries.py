"""Queries on summaries and dashboards (AGG), and on sources and structure that tables can stand for (SRC, RS, JOIN-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import dashboards, store, structure
from codestrata.plans.bindings import held, held_sql, view
from codestrata.plans.registry import Registry
from codestrata.sources import gitlog, trees
from codestrata.tables import holding, read

registry = Registry()

METRIC = ("repository_id", "analysis_run_id", "file_path", "language", "cyclomatic_complexity", "cognitive_complexity", "nesting_depth", "parameter_count", "lines_of_code", "technical_debt_minutes", "severity")
ISSUE = ("repository_id", "issue_type", "file_path", "severity", "status", "technical_debt_hours", "assigned_to_user_id", "resolved_by_user_id", "resolved_at", "created_at")
M_SQL, I_SQL = held_sql("complexity_metrics", *METRIC), held_sql("technical_debt_issues", *ISSUE)
_SEV = ("critical", "high", "medium", "low")


def _counts(alias: str = "{}", column: str = "severity") -> str:
    return ", ".join(f"count(*) filter ({column} = '{s}') as {alias.format(s)}" for s in _SEV)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir, "complexity_metrics", *METRIC)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir, "technical_debt_issues", *ISSUE)


@registry.add("agg_01_open_summary", view(f"select {_counts()}, coalesce(sum(technical_debt_hours), 0.0) as debt_hours from i where status = 'open'", i=I_SQL))
def agg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.open_issue_summary(issues(spark, sf_dir), [])


@registry.add("agg_01_open_summary_by_repository", view(f"select repository_id, {_counts()}, coalesce(sum(technical_debt_hours), 0.0) as debt_hours from i where status = 'open' group by 1", i=I_SQL))
def agg_01_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.open_issue_summary(issues(spark, sf_dir), ["repository_id"])


@registry.add("agg_02_page_total", view("select count(*) as total from i where severity = 'high' and status = 'open'", i=I_SQL))
def agg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.filtered(issues(spark, sf_dir), severity="high", status="open").agg(F.count("*").alias("total"))


_RUN = ("repository_id", "run_type", "status", "created_at")


@registry.add("agg_03_billable_scans", view("select u.organization_id, count(r.id) as scans from r join user_repositories u on r.repository_id = u.id where r.created_at >= timestamptz '2025-03-01 00:00:00+00' and r.status <> 'failed' and r.run_type = 'manual' group by 1", r=held_sql("analysis_runs", *_RUN)))
def agg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual scans since the start of the month that did not fail, per organisation."""
    own = read(spark, sf_dir, "user_repositories").select(F.col("id").alias("rid"), "organization_id")
    rows = held(spark, sf_dir, "analysis_runs", *_RUN).where((F.col("created_at") >= F.lit("2025-03-01 00:00:00").cast("timestamp")) & (F.col("status") != "failed") & (F.col("run_type") == "manual"))
    return rows.join(own, F.col("repository_id") == F.col("rid")).groupBy("organization_id").agg(F.count("id").alias("scans"))


@registry.add(
    "agg_04_file_summary",
    view(
        "select repository_id, analysis_run_id, file_path, language, count(*) as function_count, round(avg(cyclomatic_complexity), 6) as avg_cyclomatic_complexity, max(cyclomatic_complexity) as max_cyclomatic_complexity, round(avg(cognitive_complexity), 6) as avg_cognitive_complexity, max(cognitive_complexity) as max_cognitive_complexity, round(avg(nesting_depth), 6) as avg_nesting_depth, max(nesting_depth) as max_nesting_depth, cast(coalesce(sum(lines_of_code), 0) as bigint) as total_lines_of_code, cast(coalesce(sum(technical_debt_minutes), 0) as bigint) as total_technical_debt_minutes, count(*) filter (severity = 'critical') as critical_functions, count(*) filter (severity = 'high') as high_complexity_functions, count(*) filter (severity = 'medium') as medium_complexity_functions, count(*) filter (severity = 'low') as low_complexity_functions from m group by 1, 2, 3, 4",
        m=M_SQL,
    ),
)
def agg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(store.file_summary(metrics(spark, sf_dir)), "avg_cyclomatic_complexity", "avg_cognitive_complexity", "avg_nesting_depth")


@registry.add(
    "agg_05_repository_summary",
    view(
        "select repository_id, analysis_run_id, count(distinct file_path) as analyzed_files_count, count(*) as total_functions, round(avg(cyclomatic_complexity), 6) as avg_cyclomatic_complexity, max(cyclomatic_complexity) as max_cyclomatic_complexity, round(avg(cognitive_complexity), 6) as avg_cognitive_complexity, max(cognitive_complexity) as max_cognitive_complexity, cast(coalesce(sum(technical_debt_minutes), 0) as bigint) / 60.0 as total_complexity_debt_hours, count(*) filter (cyclomatic_complexity > 20) as critical_complexity_count, count(*) filter (cyclomatic_complexity > 10 and cyclomatic_complexity <= 20) as high_complexity_count, count(*) filter (nesting_depth > 4) as deep_nesting_count, count(*) filter (parameter_count > 5) as long_parameter_list_count, "
        + _counts("{}_issues")
        + " from m group by 1, 2",
        m=M_SQL,
    ),
)
def agg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(store.repository_summary(metrics(spark, sf_dir)), "avg_cyclomatic_complexity", "avg_cognitive_complexity")


_NOW = "timestamptz '2025-04-01 00:00:00+00'"
_TREND = f"count(*) as total_occurrences, count(*) filter (status = 'open') as open_count, count(*) filter (status = 'resolved') as resolved_count, count(*) filter (status = 'resolved' and resolved_at >= {_NOW} - interval 30 day) as resolved_last_30_days, round(cast(sum(case when status = 'resolved' then epoch_us(resolved_at) - epoch_us(created_at) end) as bigint) / nullif(count(case when status = 'resolved' then epoch_us(resolved_at) - epoch_us(created_at) end), 0) / 3600000000, 4) as avg_resolution_time_hours"
_TRENDS_SQL = f"(select repository_id, issue_type, file_path, false as is_rollup, {_TREND} from i group by 1, 2, 3 union all select repository_id, issue_type, null, true, {_TREND} from i group by 1, 2)"


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = store.issue_trends(issues(spark, sf_dir), F.lit("2025-04-01 00:00:00").cast("timestamp"))
    return made.withColumn("avg_resolution_time_hours", F.round("avg_resolution_time_hours", 4))


@registry.add("agg_06_issue_trends", view(f"select * from {_TRENDS_SQL}", i=I_SQL))
def agg_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends(spark, sf_dir)


_TREND_COUNTS = ("total_occurrences", "open_count", "resolved_count", "resolved_last_30_days")


@registry.add("agg_07_trend_read", view("select k.repository_id, k.issue_type, " + ", ".join(f"coalesce(t.{c}, 0) as {c}" for c in _TREND_COUNTS) + f" from (select distinct repository_id, issue_type from issue_snapshots where repository_id is not null and issue_type is not null union select id, 'none' from user_repositories) k left join (select * from {_TRENDS_SQL} where is_rollup) t on k.repository_id = t.repository_id and k.issue_type = t.issue_type", i=I_SQL))
def agg_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of every type of issue that a repository was delivered with, and of one that no repository has; zeros where there is none."""
    rolled = trends(spark, sf_dir).where("is_rollup").withColumn("last_calculated_at", F.lit("2025-04-01 00:00:00").cast("timestamp"))
    known = read(spark, sf_dir, "issue_snapshots").where("repository_id is not null and issue_type is not null").select("repository_id", "issue_type")
    keys = known.unionByName(read(spark, sf_dir, "user_repositories").select(F.col("id").alias("repository_id"), F.lit("none").alias("issue_type"))).withColumn("file_path", F.lit(None).cast("string"))
    return store.trend_of(rolled, keys).select("repository_id", "issue_type", *_TREND_COUNTS)


_BYTES_SQL = "(select coalesce(repository_id, '') repository_id, coalesce(lang, 'und') lang, cast(coalesce(sum(octet_length(encode(text))), 0) as bigint) b from documents group by 1, 2)"


@registry.add("agg_11_language_breakdown", f"select repository_id, cast(sum(b) as bigint) as total_bytes, first(lang order by b desc, lang) as primary_language, string_agg(lang || '=' || b, ',' order by lang) as breakdown from {_BYTES_SQL} group by 1")
def agg_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select(F.coalesce("repository_id", F.lit("")).alias("repository_id"), F.coalesce("lang", F.lit("und")).alias("language"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return store.language_breakdown(files, ["repository_id"])


_SNAP = ("total_issues_count", "technical_debt_hours", "test_coverage_percentage")
_DAY_SQL = f"(select repository_id, cast(snapshot_date as date) d, {', '.join(_SNAP)} from repository_metrics_snapshots qualify row_number() over (partition by repository_id, cast(snapshot_date as date) order by created_at desc, id desc) = 1)"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "repository_metrics_snapshots").withColumn("day", F.to_date("snapshot_date"))
    return holding(rows, ["repository_id", "day"], ["created_at", "id"], list(_SNAP))


@registry.add("agg_14_daily_snapshots", view("select d as day, count(*) as repositories, cast(sum(total_issues_count) as bigint) as total_issues, sum(technical_debt_hours) as debt_hours, round(cast(sum(cast(round(test_coverage_percentage * 100) as bigint)) as bigint) / nullif(count(test_coverage_percentage), 0) / 100, 4) as avg_coverage from s group by 1", s=_DAY_SQL))
def agg_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.daily_snapshots(snapshots(spark, sf_dir)).withColumn("avg_coverage", F.round("avg_coverage", 4))


@registry.add("agg_15_user_activity", "select user_id, event_type as activity_type, count(*) as n from events group by 1, 2")
def agg_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("activity_type")).agg(F.count("*").alias("n"))


@registry.add("agg_16_metrics_trend", view("select repository_id, d as day, technical_debt_hours as current_value, p as previous_value, technical_debt_hours - p as change, round(100 * (technical_debt_hours - p) / nullif(p, 0), 6) as change_percent, case when technical_debt_hours > p then 'up' when technical_debt_hours < p then 'down' when technical_debt_hours = p then 'stable' end as direction from (select *, lag(technical_debt_hours) over (partition by repository_id order by d) p from s)", s=_DAY_SQL))
def agg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dashboards.with_trend(snapshots(spark, sf_dir), ["repository_id"], "day", "technical_debt_hours"), "change_percent")


@registry.add("agg_17_dashboard_stats", view("select (select count(*) from user_repositories) as total_repositories, (select count(distinct repository_id) from i where status = 'open') as active_repositories, (select count(*) from i) as total_issues, (select sum(technical_debt_hours) from i) as total_technical_debt_hours", i=I_SQL))
def agg_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals; both sides of the join have exactly one row."""
    totals = issues(spark, sf_dir).agg(F.count_distinct(F.when(F.col("status") == "open", F.col("repository_id"))).alias("active_repositories"), F.count("*").alias("total_issues"), F.sum("technical_debt_hours").alias("total_technical_debt_hours"))
    count = read(spark, sf_dir, "user_repositories").agg(F.count("*").alias("total_repositories"))
    return count.join(F.broadcast(totals)).select("total_repositories", "active_repositories", "total_issues", "total_technical_debt_hours")


@registry.add("agg_18_active_users", "select user_id, cast(ts as date) as activity_date, count(distinct event_type) as activity_types_count, count(*) as total_activities from events group by 1, 2")
def agg_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.active_users(read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("activity_type"), F.col("ts").alias("at")))


@registry.add("agg_19_weekly_resolved", view("select resolved_by_user_id as user_id, cast(date_trunc('week', resolved_at) as date) as week_start, count(*) as resolved_count from i where status = 'resolved' and resolved_at is not null group by 1, 2", i=I_SQL))
def agg_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.weekly_resolved(issues(spark, sf_dir), "resolved_by_user_id")


@registry.add("agg_20_resolution_velocity", view("select day, cast(sum(c) as bigint) as created_count, cast(sum(r) as bigint) as resolved_count from (select cast(created_at as date) as day, 1 c, 0 r from i union all select cast(resolved_at as date), 0, 1 from i where status = 'resolved') where day is not null group by 1", i=I_SQL))
def agg_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.resolution_velocity(issues(spark, sf_dir))


@registry.add("agg_21_grades", view("select case when test_coverage_percentage >= 90 then 'A' when test_coverage_percentage >= 75 then 'B' when test_coverage_percentage >= 60 then 'C' when test_coverage_percentage >= 40 then 'D' when test_coverage_percentage is not null then 'F' else 'unknown' end as grade, count(*) as n from (select *, max(d) over (partition by repository_id) z from s) where d = z group by 1", s=_DAY_SQL))
def agg_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories by the grade of their last coverage."""
    last = snapshots(spark, sf_dir).groupBy("repository_id").agg(F.max(F.struct("day", "test_coverage_percentage")).alias("x"))
    return last.groupBy(dashboards.grade(F.col("x.test_coverage_percentage")).alias("grade")).agg(F.count("*").alias("n"))


@registry.add("agg_22_issue_ledger", view("select repository_id, count(*) filter (severity = 'critical') as critical_count, count(*) filter (severity = 'critical' and assigned_to_user_id is null) as unassigned_critical_count, count(*) filter (severity = 'high') as high_count, count(*) filter (severity = 'medium') as medium_count, count(*) filter (severity = 'low') as low_count, coalesce(sum(technical_debt_hours), 0.0) as total_debt_hours, count(*) as total_issues from i where status = 'open' group by 1", i=I_SQL))
def agg_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.issue_ledger(issues(spark, sf_dir), ["repository_id"])


@registry.add("agg_23_top_offenders", view("select repository_id, file_path, coalesce(sum(technical_debt_hours), 0.0) as total_debt_hours, count(*) as issue_count from i where status = 'open' group by 1, 2 order by 3 desc, 1, 2 nulls last limit 20", i=I_SQL))
def agg_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.top_offenders(issues(spark, sf_dir), 20)


@registry.add("src_02_source_text", "select file_path, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents where file_path is not null and text is not null group by 1")
def src_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("file_path is not null and text is not null").groupBy("file_path").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@registry.add("src_05_file_churn", "select trim(file_path) as file, count(*) as changes from complexity_metrics where trim(file_path) <> '' group by 1")
def src_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gitlog.churn(read(spark, sf_dir, "complexity_metrics").select(F.col("file_path").alias("value")))


@registry.add("src_06_changed_files", "select trim(file_path) as file from technical_debt_issues where trim(file_path) <> ''")
def src_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gitlog.changed_files(read(spark, sf_dir, "technical_debt_issues").select(F.col("file_path").alias("value")))


@registry.add("src_07_commits", "select commit_hash as hash, branch as author, status as email, trigger_source as subject from analysis_runs where commit_hash is not null and branch is not null and status is not null and trigger_source is not null")
def src_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the history tool prints them, read back; a bar in a subject would cut it."""
    lines = read(spark, sf_dir, "analysis_runs").where("commit_hash is not null and branch is not null and status is not null and trigger_source is not null").select(F.concat_ws("|", "commit_hash", "branch", "status", "trigger_source").alias("value"))
    return gitlog.commits(lines).select("hash", "author", "email", "subject")


@registry.add("src_09_repository_size", "select coalesce(repository_id, '') as repository, cast(coalesce(sum(octet_length(encode(text))), 0) as double) / 1048576.0 as size_mib from documents group by 1")
def src_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each repository's documents."""
    return trees.size_mib(read(spark, sf_dir, "documents").select(F.coalesce("repository_id", F.lit("")).alias("repository"), F.octet_length("text").alias("length")), "repository")


@registry.add("src_17_tables", "select 'users' as t, count(*) as n from users union all select 'analysis_runs', count(*) from analysis_runs union all select 'technical_debt_issues', count(*) from technical_debt_issues")
def src_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, t).agg(F.lit(t).alias("t"), F.count("*").alias("n")).select("t", "n") for t in ("users", "analysis_runs", "technical_debt_issues")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registry.add("rs_07_go_test_directories", "select dir, n_go, n_test from (select regexp_replace(file_path, '/[^/]*$', '') as dir, count(distinct file_path) as n_go, count(distinct file_path) filter (ends_with(file_path, '_3.go')) as n_test from complexity_metrics where ends_with(file_path, '.go') group by 1) where n_test::double / n_go > 0.3")
def rs_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of which more than 30 % of the Go files are tests; names that end in _3 stand for tests."""
    files = read(spark, sf_dir, "complexity_metrics").select("file_path").distinct()
    return structure.test_directories(files, "file_path", "_3.go")




@registry.add("join_13_config_files", "select path, category, kind, n from (values " + ", ".join(f"('{n}', '{c}', '{k}')" for n, (c, k) in structure.CONFIG_FILES.items()) + ") v(name, category, kind) join (select distinct regexp_replace(file_path, '[^/]*$', '') || ['go.mod', 'Dockerfile', 'tsconfig.json', 'main.go'][1 + length(file_path) % 4] as path, cast(length(file_path) as integer) as n from technical_debt_issues where file_path is not null) f on regexp_replace(f.path, '^.*/', '') = v.name")
def join_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files by name; files of issues are renamed to stand for some."""
    names = F.array(*[F.lit(n) for n in ("go.mod", "Dockerfile", "tsconfig.json", "main.go")])
    rows = read(spark, sf_dir, "technical_debt_issues").where("file_path is not null")
    path = F.concat(F.regexp_replace("file_path", "[^/]*$", ""), F.element_at(names, (1 + F.length("file_path") % 4).cast("int")))
    files = rows.select(path.alias("path"), F.length("file_path").alias("n")).distinct()
    return structure.config_files(files, "path").select("path", "category", "kind", "n")


