"""Results for people and programs: JSON, text rows and the cache of results by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import content_hash

CACHE_DAYS = 7
NO_FINDINGS = "No technical debt issues found."


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, for a distributed writer; unknown values are left out."""
    return findings.select(F.to_json(F.struct("*")).alias("value"))


def json_array(findings: list[dict]) -> str:
    """A small result as one JSON array with an indent of two; no findings give ``[]``."""
    import json

    return json.dumps(findings, indent=2, ensure_ascii=False, default=str) if findings else "[]"


def text_rows(findings: DataFrame) -> DataFrame:
    """Severity, place, rule (``N/A`` if none) and message of each finding."""
    place = F.concat(F.coalesce("file_path", F.lit("")), F.coalesce(F.concat(F.lit(":"), F.col("line_number").cast("string")), F.lit("")))
    return findings.select("id", F.upper("severity").alias("severity"), place.alias("location"), F.coalesce(F.nullif("tool_rule_id", F.lit("")), F.lit("N/A")).alias("rule"), F.coalesce("message", F.lit("")).alias("message"))


def with_cache_key(rows: DataFrame, analyzer: str, content: str, prefix: str = "analysis", version: str = "v1") -> DataFrame:
    return rows.withColumn("cache_key", F.concat(F.lit(f"{prefix}:{version}:{analyzer}:"), content_hash(F.col(content))))


def cache_misses(rows: DataFrame, cached: DataFrame, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """Rows (with cache_key) that the cache (cache_key, stored_at) has no entry for, or one that ran out."""
    valid = cached.where(F.col("stored_at") + F.make_interval(days=F.lit(days)) > now).select(F.col("cache_key").alias("_key")).distinct()
    return rows.join(valid, F.col("cache_key") == F.col("_key"), "left_anti")
