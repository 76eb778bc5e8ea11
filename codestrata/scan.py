"""Scanning a source tree with the built-in analyzers: scope, policy, analysis, one report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.scoring import summary
from codestrata.operators import analysis, policy, structure
from codestrata.runner import FINDING, WARNING, Analyzer, Report, Result, run
from codestrata.sources import trees


class Complexity:
    """Functions, their complexity and the findings on them."""

    id, name = "complexity", "Code complexity"

    def __init__(self, threshold: int = 10, minutes_per_point: int = 30, legacy: bool = False) -> None:
        self.options = {"threshold": threshold, "minutes_per_point": minutes_per_point, "legacy": legacy}

    def analyze(self, spark: SparkSession, files: DataFrame) -> Result:
        measured, found, failed = analysis.analyze(files, **self.options)
        totals = summary(measured, "cyclomatic_complexity", "severity", "technical_debt_minutes").first().asDict()
        return Result(found, {k: v for k, v in totals.items() if v is not None}, failed)


class Lines:
    """Lines and files of code."""

    id, name = "lines", "Line counter"

    def analyze(self, spark: SparkSession, files: DataFrame) -> Result:
        return Result(metrics=analysis.line_counts(files).first().asDict())


def scan(spark: SparkSession, root: str, mode: str = "full", targets: list[str] | None = None, analyzers: list[Analyzer] | None = None, **options: object) -> Report:
    """Scan a directory: everything, or the files of an incremental scope; ``no_changes`` reads nothing.

    Each analyzer reads the files it needs; contents are not kept in memory between them.
    """
    policy.validate_scope(mode, targets)
    if mode == "no_changes":
        return Report(spark.createDataFrame([], FINDING), [], spark.createDataFrame([], WARNING), [])
    base = trees.open_local(root)
    judged = policy.file_policy(trees.tree(spark, base))
    if mode == "incremental":
        wanted = spark.createDataFrame([(p,) for p in policy.normalize_targets(base, targets or [])], "path string")
        judged = policy.selected(judged, mode, wanted)
    files = judged.where(F.col("reason").isNull()).select("path", "length", F.decode("content", "UTF-8").alias("content"))
    report = run(spark, files, analyzers if analyzers is not None else [Complexity(), Lines()], **options)
    refused = policy.warnings(judged).select(F.lit("scanner").alias("analyzer_id"), "message", F.lit(0).alias("part"))
    told = refused.unionByName(report.warning_rows.withColumn("part", F.lit(1)))  # refusals come first
    return Report(report.findings, report.metrics, told.orderBy("part", "message", "analyzer_id").drop("part"), report.failures)


def detect_structure(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Build roots, directories by purpose, entry points and native dependencies of a tree, and warnings on what could not be read."""
    files = trees.metadata(trees.tree(spark, trees.open_local(root))).withColumn("repo", F.lit(root))
    roots = structure.build_roots(files)
    return {
        "build_roots": roots, "doc_dirs": structure.doc_dirs(files), "source_roots": structure.source_roots(files, roots), "test_dirs": structure.test_dirs(files, roots),
        "entry_points": structure.entry_points(files, roots), "native_deps": structure.native_dependencies(files, roots), "warnings": structure.structure_warnings(files, roots),
    }
