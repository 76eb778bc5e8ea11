"""Running analyzers side by side: isolation of faults, progress, limits and one merged report."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Event, Lock
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.analysis import report_order

FINDING = "analyzer_id string, rule_id string, issue_type string, category string, severity string, message string, description string, path string, line int, confidence double, debt_hours double, effort_multiplier double, fingerprint string"
WARNING = "analyzer_id string, message string"


@dataclass
class Result:
    """What an analyzer gives: findings of the common shape, named metrics and warnings.

    Warnings that grow with the files are a DataFrame with a column ``message``, a few may be a list.
    """

    findings: DataFrame | None = None
    metrics: dict[str, object] = field(default_factory=dict)
    warnings: DataFrame | list[str] = field(default_factory=list)


class Analyzer(Protocol):
    """The extension point: anything with an id and a name that turns files into a result."""

    id: str
    name: str

    def analyze(self, spark: SparkSession, files: DataFrame) -> Result: ...


@dataclass
class Progress:
    analyzer_id: str
    stage: str  # started, finished or failed
    index: int
    total: int


@dataclass
class Report:
    """``warning_rows`` has every warning (analyzer_id, message) in order and is computed when it is read."""

    findings: DataFrame
    metrics: list[tuple[str, str, object]]
    warning_rows: DataFrame
    failures: list[tuple[str, str]]

    @property
    def warnings(self) -> list[str]:
        """The messages of all warnings, each once; read anew at each call, on the driver."""
        return list(dict.fromkeys(r["message"] for r in self.warning_rows.select("message").collect()))


class Cancelled(Exception):
    """The run was cancelled before it ended."""


def run(
    spark: SparkSession,
    files: DataFrame,
    analyzers: list[Analyzer],
    parallel: int = 4,
    progress: Callable[[Progress], None] | None = None,
    cancelled: Event | None = None,
) -> Report:
    """Run analyzers and merge what they give, in a fixed order.

    One that raises, gives nothing or has an empty or repeated id becomes a failure; the others
    go on. Metrics are ordered by analyzer and name. Events come one at a time with a rising index; a
    handler that raises becomes a warning. With ``cancelled`` set, jobs of the run are interrupted.
    """
    lock, told, index = Lock(), [], 0
    tag = f"run-{id(analyzers)}"

    def tell(analyzer_id: str, stage: str) -> None:
        nonlocal index
        with lock:
            index += 1
            if progress is None:
                return
            try:
                progress(Progress(analyzer_id, stage, index, len(analyzers)))
            except Exception as e:  # noqa: BLE001 - a broken handler must not end the run
                told.append((analyzer_id, f"progress handler failed: {e}"))

    def one(position: int) -> tuple[str, Result | None, str]:
        analyzer = analyzers[position]
        name = getattr(analyzer, "id", "") or ""
        if not name:
            return f"#{position}", None, "analyzer has no id"
        if name in [getattr(a, "id", "") for a in analyzers[:position]]:
            return name, None, "analyzer id occurs twice"
        if cancelled is not None and cancelled.is_set():
            return name, None, "cancelled"
        tell(name, "started")
        try:
            spark.addTag(tag)
            result = analyzer.analyze(spark, files)
            if not isinstance(result, Result):
                raise TypeError("analyzer gave no result")
        except Exception as e:  # noqa: BLE001
            tell(name, "failed")
            return name, None, str(e).splitlines()[0] if str(e) else type(e).__name__
        finally:
            spark.removeTag(tag)
        tell(name, "finished")
        return name, result, ""

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        futures = [pool.submit(one, i) for i in range(len(analyzers))]
        while cancelled is not None and not all(f.done() for f in futures):
            if cancelled.wait(0.05):
                spark.interruptTag(tag)
                break
        outcomes = [f.result() for f in futures]
    if cancelled is not None and cancelled.is_set():
        raise Cancelled
    findings = spark.createDataFrame([], FINDING)
    metrics, few, failures = [], list(told), []
    many: list[DataFrame] = []
    for name, result, error in outcomes:
        if result is None:
            failures.append((name, error))
            continue
        if result.findings is not None:
            findings = findings.unionByName(result.findings, allowMissingColumns=True)
        metrics += [(name, k, v) for k, v in result.metrics.items()]
        if isinstance(result.warnings, DataFrame):
            many.append(result.warnings.select(F.lit(name).alias("analyzer_id"), "message"))
        else:
            few += [(name, w) for w in result.warnings]
    warnings = spark.createDataFrame(few, WARNING)
    for rows in many:
        warnings = warnings.unionByName(rows)
    return Report(findings.orderBy(*report_order()), sorted(metrics, key=lambda m: m[:2]), warnings.orderBy("message", "analyzer_id"), failures)
