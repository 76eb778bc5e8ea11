"""Reading the store of runs, issues and metrics: filters, pages, joins and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.scoring import sort_rank

SEVERITIES = ("critical", "high", "medium", "low")


def filtered(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows that meet every filter given; a filter of None or an empty string is absent."""
    tests = [F.col(c) == F.lit(v) for c, v in equal.items() if v not in (None, "")]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an order; an offset beyond the end gives no rows."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def by_severity() -> list[Column]:
    """Most severe first, then newest (unknown times first), then by id."""
    return [sort_rank(F.col("severity")).asc(), F.col("created_at").desc_nulls_first(), F.col("id").asc()]


def with_repository_names(rows: DataFrame, repositories: DataFrame) -> DataFrame:
    """Rows with the name of their repository, empty where it isn't known."""
    names = repositories.select(F.col("id").alias("_rid"), F.col("name").alias("_name"), F.col("full_name").alias("_full"))
    joined = rows.join(names, F.col("repository_id") == F.col("_rid"), "left")
    return joined.select(*rows.columns, F.coalesce("_name", F.lit("")).alias("repository_name"), F.coalesce("_full", F.lit("")).alias("repository_full_name"))


def severity_counts(prefix: str = "", column: str = "severity") -> list[Column]:
    return [F.count_if(F.col(column) == s).alias(f"{prefix}{s}") for s in SEVERITIES]


def open_issue_summary(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Open issues by severity and their hours per key; without keys always one row."""
    rows = issues.where("status = 'open'")
    return rows.groupBy(*keys).agg(*severity_counts(), F.coalesce(F.sum("technical_debt_hours"), F.lit(0.0)).alias("debt_hours"))


def visible(rows: DataFrame, repositories: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose repository belongs to an organisation that has one of ``members`` (organization_id)."""
    own = repositories.join(members.select(F.col("organization_id").alias("_org")).distinct(), F.col("organization_id") == F.col("_org"), "left_semi")
    return rows.join(own.select(F.col("id").alias("_rid")), F.col("repository_id") == F.col("_rid"), "left_semi")


def related_issues(issues: DataFrame, issue: DataFrame, limit: int) -> DataFrame:
    """Other issues of the issue's repository in the same file or of the same type, same file first."""
    one = issue.select(F.col("id").alias("_id"), F.col("repository_id").alias("_repo"), F.col("file_path").alias("_file"), F.col("issue_type").alias("_type"))
    same_file = F.col("file_path") == F.col("_file")
    joined = issues.join(F.broadcast(one.limit(1)), (F.col("repository_id") == F.col("_repo")) & (F.col("id") != F.col("_id")) & (same_file | (F.col("issue_type") == F.col("_type"))))
    ranked = joined.withColumn("same_file_priority", F.when(same_file, 1).otherwise(2))
    return ranked.orderBy("same_file_priority", *by_severity()).limit(limit)


def location_match(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Equality of repository, file and type, and null-safe equality of line and rule."""
    plain = reduce(lambda a, b: a & b, [left[c] == right[c] for c in ("repository_id", "file_path", "issue_type")])
    return plain & left["line_number"].eqNullSafe(right["line_number"]) & left["tool_rule_id"].eqNullSafe(right["tool_rule_id"])


def latest_per_function(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Of each file and function of a repository the row of its latest run; rows without a run are left out."""
    started = runs.select(F.col("id").alias("_run"), "started_at")
    joined = metrics.join(started, F.col("analysis_run_id") == F.col("_run")).drop("_run")
    newest = Window.partitionBy("repository_id", "file_path", "function_name").orderBy(F.col("started_at").desc_nulls_first(), F.col("id").asc())
    return joined.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def _whole(column: str) -> Column:
    return F.coalesce(F.sum(F.col(column).cast("long")), F.lit(0))


def file_summary(metrics: DataFrame) -> DataFrame:
    """Functions of each file of a run: counts, averages, maxima, length, debt and severities."""
    return metrics.groupBy("repository_id", "analysis_run_id", "file_path", "language").agg(
        F.count("*").alias("function_count"),
        F.avg("cyclomatic_complexity").alias("avg_cyclomatic_complexity"),
        F.max("cyclomatic_complexity").alias("max_cyclomatic_complexity"),
        F.avg("cognitive_complexity").alias("avg_cognitive_complexity"),
        F.max("cognitive_complexity").alias("max_cognitive_complexity"),
        F.avg("nesting_depth").alias("avg_nesting_depth"),
        F.max("nesting_depth").alias("max_nesting_depth"),
        _whole("lines_of_code").alias("total_lines_of_code"),
        _whole("technical_debt_minutes").alias("total_technical_debt_minutes"),
        *[F.count_if(F.col("severity") == s).alias(n) for s, n in zip(SEVERITIES, ("critical_functions", "high_complexity_functions", "medium_complexity_functions", "low_complexity_functions"), strict=True)],
    )


def repository_summary(metrics: DataFrame) -> DataFrame:
    """Files and functions of each run: distinct files, averages, maxima, debt and long or deep functions.

    Files are counted over their own groups first, so that a run with very many rows is combined
    before the shuffle.
    """
    files = metrics.groupBy("repository_id", "analysis_run_id", "file_path").agg(
        F.count("*").alias("n"),
        F.sum("cyclomatic_complexity").alias("cyc"), F.count("cyclomatic_complexity").alias("cyc_n"), F.max("cyclomatic_complexity").alias("cyc_max"),
        F.sum("cognitive_complexity").alias("cog"), F.count("cognitive_complexity").alias("cog_n"), F.max("cognitive_complexity").alias("cog_max"),
        F.sum(F.col("technical_debt_minutes").cast("long")).alias("minutes"),
        F.count_if(F.col("cyclomatic_complexity") > 20).alias("cyc_critical"),
        F.count_if((F.col("cyclomatic_complexity") > 10) & (F.col("cyclomatic_complexity") <= 20)).alias("cyc_high"),
        F.count_if(F.col("nesting_depth") > 4).alias("deep"), F.count_if(F.col("parameter_count") > 5).alias("wide"),
        *severity_counts("issues_"),
    )
    total = lambda c, name: F.sum(c).alias(name)
    return files.groupBy("repository_id", "analysis_run_id").agg(
        F.count("file_path").alias("analyzed_files_count"), total("n", "total_functions"),
        (F.sum("cyc") / F.sum("cyc_n")).alias("avg_cyclomatic_complexity"), F.max("cyc_max").alias("max_cyclomatic_complexity"),
        (F.sum("cog") / F.sum("cog_n")).alias("avg_cognitive_complexity"), F.max("cog_max").alias("max_cognitive_complexity"),
        (F.coalesce(F.sum("minutes"), F.lit(0)) / 60.0).alias("total_complexity_debt_hours"),
        total("cyc_critical", "critical_complexity_count"), total("cyc_high", "high_complexity_count"), total("deep", "deep_nesting_count"), total("wide", "long_parameter_list_count"),
        *[total(f"issues_{s}", f"{s}_issues") for s in SEVERITIES],
    )


def issue_trends(issues: DataFrame, now: Column) -> DataFrame:
    """Occurrences, open and resolved issues per repository, type and file, and over all files of a type.

    The rows over all files have is_rollup true; a NULL file is a file.
    """
    span = F.unix_micros("resolved_at") - F.unix_micros("created_at")
    base = issues.groupBy("repository_id", "issue_type", "file_path").agg(
        F.count("*").alias("total_occurrences"),
        F.count_if(F.col("status") == "open").alias("open_count"),
        F.count_if(F.col("status") == "resolved").alias("resolved_count"),
        F.count_if((F.col("status") == "resolved") & (F.col("resolved_at") >= now - F.expr("interval 30 days"))).alias("resolved_last_30_days"),
        F.sum(F.when(F.col("status") == "resolved", span)).alias("span"),
        F.count(F.when(F.col("status") == "resolved", span)).alias("timed"),
    )
    counts = ["total_occurrences", "open_count", "resolved_count", "resolved_last_30_days"]
    whole = base.groupBy("repository_id", "issue_type").agg(*[F.sum(c).alias(c) for c in [*counts, "span", "timed"]])
    parts = base.withColumn("is_rollup", F.lit(False)).unionByName(whole.withColumn("file_path", F.lit(None).cast("string")).withColumn("is_rollup", F.lit(True)))
    return parts.select("repository_id", "issue_type", "file_path", "is_rollup", *counts, (F.col("span") / F.nullif(F.col("timed"), F.lit(0)) / 3_600_000_000).alias("avg_resolution_time_hours"))


def trend_of(trends: DataFrame, keys: DataFrame) -> DataFrame:
    """The latest trend of each key asked for (repository_id, issue_type, file_path), zeros where there is none."""
    counts = ["total_occurrences", "open_count", "resolved_count", "resolved_last_30_days"]
    asked = keys.select(F.col("repository_id").alias("r"), F.col("issue_type").alias("t"), F.col("file_path").alias("f")).distinct()
    latest = trends.groupBy("repository_id", "issue_type", "file_path").agg(F.max(F.struct("last_calculated_at", *counts, "avg_resolution_time_hours")).alias("x"))
    joined = asked.join(latest, (F.col("r") == F.col("repository_id")) & (F.col("t") == F.col("issue_type")) & F.col("f").eqNullSafe(F.col("file_path")), "left")
    return joined.select(F.col("r").alias("repository_id"), F.col("t").alias("issue_type"), F.col("f").alias("file_path"), *[F.coalesce(F.col(f"x.{c}"), F.lit(0)).alias(c) for c in counts], F.col("x.avg_resolution_time_hours").alias("avg_resolution_time_hours"))


def language_breakdown(files: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes per language, their total and the language of most bytes (ties: by name)."""
    per = files.groupBy(*keys, "language").agg(F.sum("bytes").alias("bytes"))
    return per.groupBy(*keys).agg(
        F.sum("bytes").alias("total_bytes"),
        F.min(F.struct((-F.col("bytes")).alias("less"), F.col("language").alias("language")))["language"].alias("primary_language"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("language", "bytes"))), lambda x: F.concat_ws("=", x["language"], x["bytes"].cast("string"))), ",").alias("breakdown"),
    )
