"""Aggregates for dashboards: trends, activity, velocity, ledgers and offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_trend(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value of each row with the one before it per key, their change, percent and direction."""
    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    change = F.col("current_value") - F.col("previous_value")
    made = rows.select(*keys, order, F.col(value).alias("current_value"), previous.alias("previous_value"))
    direction = F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "stable")
    return made.select("*", change.alias("change"), (100 * change / F.nullif(F.col("previous_value"), F.lit(0.0))).alias("change_percent"), direction.alias("direction"))


def daily_snapshots(snapshots: DataFrame) -> DataFrame:
    """Totals over all repositories per day, from rows with repository_id, day and measures, one for each pair.

    Coverage is averaged in whole hundredths of a percent, so that the order of rows cannot matter.
    """
    hundredths = F.sum(F.round(F.col("test_coverage_percentage") * 100).cast("long"))
    return snapshots.groupBy("day").agg(F.count("*").alias("repositories"), F.sum("total_issues_count").alias("total_issues"), F.sum("technical_debt_hours").alias("debt_hours"), (hundredths / F.nullif(F.count("test_coverage_percentage"), F.lit(0)) / 100).alias("avg_coverage"))


def active_users(activity: DataFrame) -> DataFrame:
    """Kinds and number of activities per user and day, from rows user_id, activity_type and at.

    Counted per kind first, so that a very busy user is combined before the distinct count.
    """
    kinds = activity.groupBy("user_id", F.to_date("at").alias("activity_date"), "activity_type").agg(F.count("*").alias("n"))
    return kinds.groupBy("user_id", "activity_date").agg(F.count("activity_type").alias("activity_types_count"), F.sum("n").alias("total_activities"))


def weekly_resolved(issues: DataFrame, user: str) -> DataFrame:
    """Resolved issues per user and week (Monday)."""
    rows = issues.where((F.col("status") == "resolved") & F.col("resolved_at").isNotNull())
    return rows.groupBy(F.col(user).alias("user_id"), F.to_date(F.date_trunc("week", "resolved_at")).alias("week_start")).agg(F.count("*").alias("resolved_count"))


def resolution_velocity(issues: DataFrame) -> DataFrame:
    """Issues created and resolved per day."""
    days = F.array(F.struct(F.to_date("created_at").alias("day"), F.lit(1).alias("c"), F.lit(0).alias("r")), F.struct(F.to_date(F.when(F.col("status") == "resolved", F.col("resolved_at"))).alias("day"), F.lit(0).alias("c"), F.lit(1).alias("r")))
    rows = issues.select(F.explode(days).alias("x")).select("x.*").where("day is not null")
    return rows.groupBy("day").agg(F.sum("c").alias("created_count"), F.sum("r").alias("resolved_count"))


def grade(coverage: Column) -> Column:
    return F.when(coverage >= 90, "A").when(coverage >= 75, "B").when(coverage >= 60, "C").when(coverage >= 40, "D").when(coverage.isNotNull(), "F").otherwise("unknown")


def issue_ledger(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Open issues by severity, critical ones without an assignee, hours and total."""
    severity = F.col("severity")
    return issues.where("status = 'open'").groupBy(*keys).agg(
        F.count_if(severity == "critical").alias("critical_count"),
        F.count_if((severity == "critical") & F.col("assigned_to_user_id").isNull()).alias("unassigned_critical_count"),
        F.count_if(severity == "high").alias("high_count"), F.count_if(severity == "medium").alias("medium_count"), F.count_if(severity == "low").alias("low_count"),
        F.coalesce(F.sum("technical_debt_hours"), F.lit(0.0)).alias("total_debt_hours"), F.count("*").alias("total_issues"),
    )


def top_offenders(issues: DataFrame, limit: int) -> DataFrame:
    """The files with the most debt hours in open issues."""
    per = issues.where("status = 'open'").groupBy("repository_id", "file_path").agg(F.coalesce(F.sum("technical_debt_hours"), F.lit(0.0)).alias("total_debt_hours"), F.count("*").alias("issue_count"))
    return per.orderBy(F.col("total_debt_hours").desc(), F.col("repository_id").asc(), F.col("file_path").asc_nulls_last()).limit(limit)
