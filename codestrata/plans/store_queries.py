"""Queries on the store: filters, pages, joins, distinct and top rows (FLT, SORT, TOPK, JOIN, DIST, PAGE)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.operators import policy, store
from codestrata.operators.asof import last_before
from codestrata.plans.bindings import folded_sql, held, held_sql, ref_sql, view
from codestrata.plans.registry import Registry
from codestrata.session import materialize
from codestrata.tables import folded, read, reference

registry = Registry()

ISSUE = ("repository_id", "analysis_run_id", "file_path", "line_number", "issue_type", "severity", "status", "tool_rule_id", "technical_debt_hours", "created_at", "message")
RUN = ("repository_id", "status", "started_at", "completed_at", "total_technical_debt_hours", "critical_issues_count")
METRIC = ("repository_id", "analysis_run_id", "file_path", "function_name", "start_line", "cyclomatic_complexity", "severity")
_RANK = "case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 when 'low' then 4 else 5 end"
_BY_SEVERITY = f"{_RANK}, created_at desc nulls first, id"


def issues(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return held(spark, sf_dir, "technical_debt_issues", *(columns or ISSUE))


def runs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return held(spark, sf_dir, "analysis_runs", *(columns or RUN))


def metrics(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return held(spark, sf_dir, "complexity_metrics", *(columns or METRIC))


I_SQL, R_SQL, M_SQL = held_sql("technical_debt_issues", *ISSUE), held_sql("analysis_runs", *RUN), held_sql("complexity_metrics", *METRIC)


def _v(sql: str) -> str:
    """The views that a query uses, before it."""
    have = {"i": I_SQL, "r": R_SQL, "m": M_SQL}
    return view(sql, **{n: q for n, q in have.items() if f" {n} " in sql + " " or f" {n})" in sql})


@registry.add("flt_12_issue_filters", _v("select id, repository_id, severity, status, issue_type from i where severity = 'high' and status = 'open' and issue_type = 'complexity'"))
def flt_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.filtered(issues(spark, sf_dir), severity="high", status="open", issue_type="complexity", repository_id=None).select("id", "repository_id", "severity", "status", "issue_type")


@registry.add("flt_13_metric_filters", _v("select id, file_path, cyclomatic_complexity from m where severity = 'critical' and cyclomatic_complexity >= 25"))
def flt_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.filtered(metrics(spark, sf_dir), severity="critical", file_path="").where("cyclomatic_complexity >= 25").select("id", "file_path", "cyclomatic_complexity")


@registry.add("flt_14_lookup", view(f"select k.id as repository_id, k.run, r.status from (select id, {ref_sql('last_analysis_run_id')} run from user_repositories) k left join r on k.run = r.id where k.run is not null", r=held_sql("analysis_runs", "status")))
def flt_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that each repository names as its last; the status of a missing one is NULL."""
    keys = read(spark, sf_dir, "user_repositories").select(F.col("id").alias("repository_id"), reference("last_analysis_run_id").alias("run")).where("run is not null")
    return keys.join(runs(spark, sf_dir, "status"), F.col("run") == F.col("id"), "left").select("repository_id", "run", "status")


@registry.add("scope_04_targets", f"select id, file_path from complexity_metrics where file_path in (select file_path from complexity_metrics where {ref_sql('analysis_run_id')} is null)")
def scope_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics in the files of which some metric has no run."""
    targets = read(spark, sf_dir, "complexity_metrics").where(reference("analysis_run_id").isNull()).select(F.col("file_path").alias("path"))
    return policy.in_scope(read(spark, sf_dir, "complexity_metrics").select("id", "file_path"), targets, "file_path")


@registry.add("sort_01_report_order", view("select row_number() over (order by tool_name, file_path nulls first, coalesce(line_number, 0), message nulls first, id) as place, id from i", i=held_sql("technical_debt_issues", "tool_name", "file_path", "line_number", "message")))
def sort_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in report order with their places.

    Rows are range-partitioned by the order and written once with their place in the partition; places are then shifted by
    the sizes of the partitions before, so no task sees all rows and nothing is ordered twice.
    """
    rows = issues(spark, sf_dir, "tool_name", "file_path", "line_number", "message")
    ordered = rows.orderBy("tool_name", "file_path", F.coalesce("line_number", F.lit(0)), "message", "id").select("id")
    numbered = spark.read.parquet(materialize(ordered.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("within")), "report-order"))
    # one row per task is ordered here
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = numbered.groupBy("part").agg(F.count("*").alias("size")).select(F.col("part").alias("p"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    return numbered.join(before, F.col("part") == F.col("p")).select((F.col("before") + F.col("within") + 1).alias("place"), "id")


@registry.add("sort_02_severity_page", _v(f"select id, severity from i where status = 'open' order by {_BY_SEVERITY} limit 50 offset 10"))
def sort_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(store.filtered(issues(spark, sf_dir), status="open"), store.by_severity(), 10, 50).select("id", "severity")


@registry.add("sort_03_newest_page", _v("select id from r order by started_at desc nulls first, id limit 25 offset 5"))
def sort_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(runs(spark, sf_dir), [F.col("started_at").desc_nulls_first(), F.col("id").asc()], 5, 25).select("id")


@registry.add("sort_04_most_complex", _v("select id, cyclomatic_complexity, file_path, start_line from m order by cyclomatic_complexity desc nulls first, file_path nulls last, start_line nulls last, id limit 100"))
def sort_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("cyclomatic_complexity").desc_nulls_first(), F.col("file_path").asc_nulls_last(), F.col("start_line").asc_nulls_last(), F.col("id").asc()]
    return store.page(metrics(spark, sf_dir), order, 0, 100).select("id", "cyclomatic_complexity", "file_path", "start_line")


@registry.add("sort_05_comments", view("select id, issue_id from c where deleted_at is null order by created_at asc nulls last, id limit 200", c=held_sql("issue_comments", "issue_id", "created_at", "deleted_at")))
def sort_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = held(spark, sf_dir, "issue_comments", "issue_id", "created_at", "deleted_at").where("deleted_at is null")
    return store.page(rows, [F.col("created_at").asc_nulls_last(), F.col("id").asc()], 0, 200).select("id", "issue_id")


@registry.add("page_01_offset", _v("select id from i order by id limit 20 offset 100"))
def page_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(issues(spark, sf_dir).select("id"), [F.col("id").asc()], 100, 20)


@registry.add("dist_01_unique_strings", "select distinct tool_rule_id from technical_debt_issues where tool_rule_id is not null order by 1")
def dist_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "technical_debt_issues").select("tool_rule_id").where("tool_rule_id is not null").distinct().orderBy("tool_rule_id")


@registry.add(
    "topk_01_new_issues",
    _v(f"select run_id, cast(place as integer) as place, id from (select r.id as run_id, row_number() over (partition by r.id order by {_RANK.replace('severity', 'i.severity', 1)}, i.created_at desc nulls first, i.id) as place, i.id from i join r on r.id = i.analysis_run_id where i.status = 'open' and i.created_at >= r.started_at) where place <= 5"),
)
def topk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most severe new issues of every run."""
    started = runs(spark, sf_dir, "started_at").select(F.col("id").alias("run_id"), "started_at")
    new = store.filtered(issues(spark, sf_dir), status="open").join(started, (F.col("analysis_run_id") == F.col("run_id")) & (F.col("created_at") >= F.col("started_at")))
    return new.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(*store.by_severity()))).where("place <= 5").select("run_id", "place", "id")


@registry.add("topk_02_latest_per_function", _v("select m.id, m.repository_id, m.file_path, m.function_name from m join r on m.analysis_run_id = r.id qualify row_number() over (partition by m.repository_id, m.file_path, m.function_name order by r.started_at desc nulls first, m.id) = 1"))
def topk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_per_function(metrics(spark, sf_dir), runs(spark, sf_dir, "started_at")).select("id", "repository_id", "file_path", "function_name")


@registry.add("topk_04_history", _v("select id, started_at is null as unknown_start, status from r order by started_at desc nulls first, id limit 10"))
def topk_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(runs(spark, sf_dir), [F.col("started_at").desc_nulls_first(), F.col("id").asc()], 0, 10).select("id", F.col("started_at").isNull().alias("unknown_start"), "status")


@registry.add("join_01_repository_names", _v("select i.id, coalesce(u.name, '') as repository_name, coalesce(u.full_name, '') as repository_full_name from i left join user_repositories u on i.repository_id = u.id"))
def join_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_repository_names(issues(spark, sf_dir, "repository_id"), read(spark, sf_dir, "user_repositories")).select("id", "repository_name", "repository_full_name")


@registry.add("join_02_metrics_of_runs", _v("select m.id, r.id as run_id, r.status from m join r on m.analysis_run_id = r.id"))
def join_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = runs(spark, sf_dir).select(F.col("id").alias("run_id"), "status")
    return metrics(spark, sf_dir).select("id", "analysis_run_id").join(own, F.col("analysis_run_id") == F.col("run_id")).select("id", "run_id", "status")


@registry.add("join_03_issues_since_start", _v("select i.id, r.id as run_id from i join r on i.analysis_run_id = r.id and i.created_at >= r.started_at"))
def join_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = runs(spark, sf_dir).select(F.col("id").alias("run_id"), "started_at")
    return issues(spark, sf_dir).join(own, (F.col("analysis_run_id") == F.col("run_id")) & (F.col("created_at") >= F.col("started_at"))).select("id", "run_id")


@registry.add("join_04_visible_issues", _v("select i.id from i where exists (select 1 from user_repositories u join (select distinct o.organization_id from user_repositories o join users s on o.user_id = s.id where s.mfa_enabled) a on u.organization_id = a.organization_id where u.id = i.repository_id)"))
def join_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues in repositories of organisations of which an owner uses two factors."""
    repositories = read(spark, sf_dir, "user_repositories")
    owners = read(spark, sf_dir, "users").where("mfa_enabled").select(F.col("id").alias("owner"))
    members = repositories.join(owners, F.col("user_id") == F.col("owner"), "left_semi")
    return store.visible(issues(spark, sf_dir, "repository_id"), repositories, members).select("id")


_PREVIOUS = "select a.id, b.id as previous_id, {cols} from r a left join lateral (select * from r p where p.repository_id = a.repository_id and p.status = 'completed' and p.completed_at < a.started_at order by p.completed_at desc, p.id desc limit 1) b on true"


def previous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_runs = runs(spark, sf_dir)
    done = all_runs.where("status = 'completed'").select(F.col("repository_id").alias("e_repo"), F.col("completed_at").alias("e_at"), F.col("id").alias("previous_id"), F.col("total_technical_debt_hours").alias("hours"), F.col("critical_issues_count").alias("critical"))
    return last_before(all_runs, F.col("repository_id"), F.col("started_at"), done, F.col("e_repo"), F.col("e_at"), ["previous_id", "hours", "critical"])


@registry.add("join_05_previous_run", _v(_PREVIOUS.format(cols="a.repository_id")))
def join_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return previous_runs(spark, sf_dir).select("id", F.col("previous.previous_id").alias("previous_id"), "repository_id")


@registry.add("agg_12_run_delta", _v(_PREVIOUS.format(cols="a.total_technical_debt_hours - b.total_technical_debt_hours as debt_hours_change, a.critical_issues_count - b.critical_issues_count as critical_count_change, case when b.id is not null then 0 end as new_issues, case when b.id is not null then 0 end as fixed_issues")))
def agg_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change against the previous completed run; NULL without one."""
    p = F.col("previous")
    zero = F.when(p.isNotNull(), F.lit(0))
    return previous_runs(spark, sf_dir).select(
        "id", p["previous_id"].alias("previous_id"), (F.col("total_technical_debt_hours") - p["hours"]).alias("debt_hours_change"), (F.col("critical_issues_count") - p["critical"]).alias("critical_count_change"), zero.alias("new_issues"), zero.alias("fixed_issues")
    )


@registry.add(
    "join_06_related_issues",
    _v(f"select i.id, case when i.file_path = c.file_path then 1 else 2 end as same_file_priority, i.severity from i, (select * from i order by id limit 1) c where i.id <> c.id and i.repository_id = c.repository_id and (i.file_path = c.file_path or i.issue_type = c.issue_type) order by 2, {_RANK.replace('severity', 'i.severity', 1)}, i.created_at desc nulls first, i.id limit 25"),
)
def join_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues related to the first one by id."""
    all_issues = issues(spark, sf_dir)
    return store.related_issues(all_issues, all_issues.orderBy("id").limit(1), 25).select("id", "same_file_priority", "severity")


@registry.add("join_07_comment_authors", view(f"select c.id, coalesce(u.full_name, '') as author, coalesce(u.full_name, 'System') as actor from c left join users u on {ref_sql('c.user_id')} = u.id", c=held_sql("issue_comments", "user_id")))
def join_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "users").select(F.col("id").alias("uid"), "full_name")
    joined = held(spark, sf_dir, "issue_comments", "user_id").join(users, reference("user_id") == F.col("uid"), "left")
    return joined.select("id", F.coalesce("full_name", F.lit("")).alias("author"), F.coalesce("full_name", F.lit("System")).alias("actor"))


@registry.add("join_08_first_organization", "select u.id as user_id, min(o.organization_id) as organization_id from users u join user_repositories o on o.user_id = u.id where o.organization_id is not null group by 1")
def join_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One organisation of every user who has one, the first by id."""
    owned = read(spark, sf_dir, "user_repositories").where("organization_id is not null").select("user_id", "organization_id")
    return owned.join(read(spark, sf_dir, "users").select(F.col("id").alias("uid")), F.col("user_id") == F.col("uid"), "left_semi").groupBy("user_id").agg(F.min("organization_id").alias("organization_id"))


_AT = "repository_id, file_path, issue_type, line_number, tool_rule_id"
_LOCATION_SQL = "a.repository_id = b.repository_id and a.file_path = b.file_path and a.issue_type = b.issue_type and a.line_number is not distinct from b.line_number and a.tool_rule_id is not distinct from b.tool_rule_id"


_AT_LIST = _AT.split(", ")


def _writes_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All delivered writes per location, with how many of them left the issue open or ignored."""
    rows = read(spark, sf_dir, "technical_debt_issues").withColumn("active", folded("status").isin("open", "ignored"))
    return rows.groupBy(*_AT_LIST).agg(F.count("*").alias("n_writes"), F.count_if("active").alias("n_active")).select(*[F.col(c).alias(f"b_{c}") for c in _AT_LIST], "n_writes", "n_active")


def _located(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    match = store.location_match({c: F.col(c) for c in _AT_LIST}, {c: F.col(f"b_{c}") for c in _AT_LIST})
    return issues(spark, sf_dir).join(_writes_at(spark, sf_dir), match, how)


@registry.add("join_09_same_location", view(f"select a.id, count(*) as n_writes from i a join technical_debt_issues b on {_LOCATION_SQL} group by 1", i=I_SQL))
def join_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes at the location of each issue, where an unknown line or rule equals another unknown one."""
    return _located(spark, sf_dir, "inner").select("id", "n_writes")


@registry.add("join_10_known_issue", view(f"select a.id, exists (select 1 from technical_debt_issues b where {_LOCATION_SQL} and {folded_sql('b.status')} in ('open', 'ignored')) as known from i a", i=I_SQL))
def join_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some write at the location of an issue is open or ignored; one row per location is joined, not pairs."""
    return _located(spark, sf_dir, "left").select("id", (F.coalesce("n_active", F.lit(0)) > 0).alias("known"))


@registry.add("join_11_any_of", _v("select id from m where severity in ('critical', 'high') and file_path in (select file_path from m where cyclomatic_complexity > 40)"))
def join_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lists are predicates, lists that come from data are semi joins."""
    files = metrics(spark, sf_dir).where("cyclomatic_complexity > 40").select(F.col("file_path").alias("path"))
    return policy.in_scope(metrics(spark, sf_dir).where(F.col("severity").isin("critical", "high")), files, "file_path").select("id")


@registry.add("join_12_files_in_set", _v("select distinct file_path from m where file_path in (select file_path from m where severity = 'critical')"))
def join_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics(spark, sf_dir)
    return policy.in_scope(rows.select("file_path").distinct(), store.filtered(rows, severity="critical").select(F.col("file_path").alias("path")), "file_path")
