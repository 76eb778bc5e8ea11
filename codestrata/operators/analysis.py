"""From source files to functions, metrics and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import scoring
from codestrata.functions.text import fingerprint, newline_count
from codestrata.operators import policy
from codestrata.parse.registry import parse_files
from codestrata.session import materialize

ANALYZER = "complexity"
TOOL = "complexity_analyzer"
_SUGGESTING = {"c_cpp": "c++", "rust": "rust", "ruby": "ruby", "kotlin": "kotlin", "swift": "swift"}
NO_ADVICE = f"cast(array() as {scoring.SUGGESTION})"


def with_complexity(functions: DataFrame) -> DataFrame:
    """Cyclomatic and cognitive complexity and nesting from each function's array of nodes.

    The same sums as ``scoring.reduce_nodes`` without exploding, so nothing is shuffled.
    """
    nodes = F.coalesce("nodes", F.array().cast("array<struct<node_type:string,depth:int>>"))
    weighted = lambda n: n["node_type"].isin(*scoring.WEIGHTED)
    operator = lambda n: n["node_type"] == "Operator"
    zero = F.lit(0)
    effort = F.aggregate(nodes, zero, lambda total, n: total + F.when(weighted(n), 1 + n["depth"]).when(operator(n), 1).otherwise(0))
    return functions.withColumns(
        {
            "cyclomatic_complexity": (1 + F.size(F.filter(nodes, lambda n: weighted(n) | operator(n)))).cast("int"),
            "cognitive_complexity": effort.cast("int"),
            "nesting_depth": F.coalesce(F.array_max(F.transform(nodes, lambda n: n["depth"])), zero).cast("int"),
        }
    )


def metrics(functions: DataFrame, threshold: int = 10, minutes_per_point: int = 30, legacy: bool = False) -> DataFrame:
    """Metric rows of parsed functions: severity on the language's scale, pipeline debt and suggestions.

    In legacy mode anonymous functions are left out after extraction.
    """
    rows = with_complexity(functions.where(F.col("error").isNull()))
    if legacy:
        rows = policy.named_functions(rows, "function_name")
    cyc, cog, nest, par, loc = (F.col(c) for c in ("cyclomatic_complexity", "cognitive_complexity", "nesting_depth", "parameter_count", "lines_of_code"))
    is_go = F.col("language") == "go"
    advice = F.when(is_go, scoring.suggestions_go(cyc, cog, nest, par, loc))
    for language, name in _SUGGESTING.items():
        advice = advice.when(F.col("language") == language, scoring.suggestions(name, cyc, cog, nest, par, loc))
    return rows.select(
        F.col("path").alias("file_path"), "language", "function_ix", "function_name", "start_line", "end_line", "cyclomatic_complexity", "cognitive_complexity", "nesting_depth", "parameter_count", "lines_of_code",
        F.when(is_go, scoring.severity_go(cyc, cog, nest, par)).otherwise(scoring.severity(cyc, cog, nest)).alias("severity"),
        scoring.pipeline_debt_minutes(cyc, threshold, minutes_per_point).alias("technical_debt_minutes"),
        F.col("snippet").alias("code_snippet"), advice.otherwise(F.expr(NO_ADVICE)).alias("refactoring_suggestions"),
    )


def findings(measured: DataFrame) -> DataFrame:
    """Findings on functions of high and critical severity, with message, description and identity."""
    rows = policy.emitted(measured, "severity")
    cyc, cog, nest, par, loc = (F.col(c) for c in ("cyclomatic_complexity", "cognitive_complexity", "nesting_depth", "parameter_count", "lines_of_code"))
    name = F.col("function_name")
    return rows.select(
        F.lit(ANALYZER).alias("analyzer_id"), F.lit(None).cast("string").alias("rule_id"), F.lit("complexity").alias("issue_type"), F.lit("maintainability").alias("category"), "severity",
        scoring.finding_message(name, cyc, nest).alias("message"),
        scoring.finding_description(name, cyc, cog, nest, par, loc, F.col("technical_debt_minutes"), F.col("refactoring_suggestions")).alias("description"),
        F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.lit(1.0).alias("confidence"), (F.col("technical_debt_minutes") / 60.0).alias("debt_hours"), F.lit(1.0).alias("effort_multiplier"),
        fingerprint(F.col("file_path"), F.lit("complexity"), F.lit(None).cast("string"), F.col("code_snippet")).alias("fingerprint"),
    )


def line_counts(files: DataFrame) -> DataFrame:
    """Lines and number of files of code, one row."""
    return files.where(policy.is_countable(F.col("path"))).agg(F.coalesce(F.sum(newline_count(F.col("content"))), F.lit(0)).alias("total_loc"), F.count("*").alias("file_count"))


def report_order() -> list[Column]:
    """Analyzer, path, line (unknown as 0), message."""
    return [F.col("analyzer_id").asc(), F.col("path").asc(), F.coalesce("line", F.lit(0)).asc(), F.col("message").asc()]


def analyze(files: DataFrame, **options: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics, findings and warnings of files (path, content).

    Files that no analyzer reads are left out. Texts are parsed once: what the parsers give is written to the
    shared folder, and all three results are read from there.
    """
    parsed = parse_files(policy.with_language(files, "path"))
    parsed = files.sparkSession.read.schema(parsed.schema).parquet(materialize(parsed, "parsed"))
    measured = metrics(parsed, **options)
    failed = parsed.where(F.col("error").isNotNull()).select(F.concat("path", F.lit(" could not be parsed: "), "error").alias("message")).orderBy("message")
    return measured, findings(measured), failed
