"""Findings from a security scanner's nested report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.scoring import scanner_debt_hours, scanner_severity
from codestrata.functions.text import canonical_path

TOOL = "trivy"
REPORT = """Results array<struct<Target: string,
 Vulnerabilities: array<struct<VulnerabilityID: string, PkgName: string, InstalledVersion: string, FixedVersion: string, Title: string, Description: string, Severity: string, PrimaryURL: string>>,
 Secrets: array<struct<RuleID: string, Category: string, Severity: string, Title: string, StartLine: int, EndLine: int, Match: string>>>>"""
COLUMNS = ["file_path", "line_number", "category", "severity", "message", "description", "tool_rule_id", "debt_hours"]


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Report files with the schema given: one JSON document each, or one in each line."""
    return spark.read.schema(REPORT).json(path, multiLine=not lines)


def parse_reports(texts: DataFrame, column: str) -> DataFrame:
    return texts.select(F.from_json(column, REPORT).alias("r")).select("r.*")


def results(reports: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Results per target; with ``targets`` (path) only those, under their path without the leading slash."""
    rows = reports.select(F.explode("Results").alias("r")).select("r.*")
    if targets is None:
        return rows
    own = rows.withColumn("_path", canonical_path("Target"))
    kept = own.join(targets.select(F.col("path").alias("_target")).distinct(), F.col("_path") == F.col("_target"), "left_semi")
    return kept.withColumn("Target", F.regexp_replace("_path", "^/", "")).drop("_path")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def vulnerabilities(found: DataFrame) -> DataFrame:
    v = found.select("Target", F.explode("Vulnerabilities").alias("v")).select("Target", "v.*")
    extra = lambda prefix, c: F.when(_text(F.col(c)) != "", F.concat(F.lit(prefix), F.col(c))).otherwise("")
    return v.select(
        F.col("Target").alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.lit("vulnerability").alias("category"), scanner_severity(F.col("Severity")).alias("severity"),
        F.concat(_text(F.col("VulnerabilityID")), F.lit(": "), _text(F.col("Title")), F.lit(" ("), _text(F.col("PkgName")), F.lit(")")).alias("message"),
        F.concat(_text(F.col("Description")), extra("\n\nFixed Version: ", "FixedVersion"), extra("\nMore info: ", "PrimaryURL")).alias("description"),
        F.col("VulnerabilityID").alias("tool_rule_id"), scanner_debt_hours(F.col("Severity")).alias("debt_hours"),
    )


def secrets(found: DataFrame) -> DataFrame:
    s = found.select("Target", F.explode("Secrets").alias("s")).select("Target", "s.*")
    return s.select(
        F.col("Target").alias("file_path"), F.coalesce("StartLine", F.lit(0)).alias("line_number"), F.lit("secret").alias("category"), F.lit("critical").alias("severity"),
        F.concat(F.lit("Hardcoded Secret: "), _text(F.col("Title"))).alias("message"),
        F.concat(F.lit("Secret detected: "), _text(F.col("Title")), F.lit("\nCategory: "), _text(F.col("Category")), F.lit("\nThis credential should be removed from the codebase and rotated immediately.")).alias("description"),
        F.col("RuleID").alias("tool_rule_id"), F.lit(4.0).alias("debt_hours"),
    )


def security_findings(reports: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Vulnerabilities and secrets as findings of one shape."""
    found = results(reports, targets)
    return vulnerabilities(found).unionByName(secrets(found))


def security_metrics(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts in total, by category and by severity."""
    named = {"security_issues_count": F.count("*"), "vulnerabilities_count": F.count_if(F.col("category") == "vulnerability"), "secrets_count": F.count_if(F.col("category") == "secret")}
    named |= {f"security_{s}_count": F.count_if(F.col("severity") == s) for s in ("critical", "high", "medium", "low")}
    return findings.groupBy(*(keys or [])).agg(*[c.alias(n) for n, c in named.items()])


def unavailable(spark: SparkSession, reason: str) -> tuple[DataFrame, dict[str, object], list[str]]:
    """No findings, zero counts and a warning, where the scanner or its targets are missing."""
    empty = spark.createDataFrame([], "file_path string, line_number int, category string, severity string, message string, description string, tool_rule_id string, debt_hours double")
    return empty, {**security_metrics(empty).first().asDict(), "security_available": False, "security_skip_reason": reason}, [reason]


def available_metrics(repositories: DataFrame, repository: str, findings: DataFrame, of: str, reason: str) -> DataFrame:
    """The counts of each repository's findings; zeros and a reason where there are none to count, as if its scanner was unavailable."""
    counts = security_metrics(findings.withColumn("_of", F.col(of)), ["_of"])
    joined = repositories.select(repository).join(counts, F.col(repository) == F.col("_of"), "left")
    known = F.col("_of").isNotNull()
    return joined.select(repository, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "_of"], known.alias("security_available"), F.when(~known, F.lit(reason)).alias("security_skip_reason"))
