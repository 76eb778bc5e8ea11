"""Queries on files, scopes, sinks, structure and the runner (SRC, SCOPE, FLT-11, SNK, RS, EXT, AGG-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.text import relative_path
from codestrata.operators import coverage, policy, security, sinks, structure, writes
from codestrata.plans import coverage_queries
from codestrata.plans.bindings import held, held_sql, view
from codestrata.plans.registry import Registry
from codestrata.runner import Result, run
from codestrata.session import materialize
from codestrata.sources import trees
from codestrata.tables import read

registry = Registry()


@registry.add("src_01_tree")
def src_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files below the folder of the tables; their content isn't read."""
    return trees.tree(spark, sf_dir).select("path", "length")


@registry.add("src_10_report_files", "select file_path as target, line_number is null as vulnerable from technical_debt_issues")
def src_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security reports written as JSON and read with their schema."""
    made = coverage_queries.reports(spark, sf_dir).select(F.to_json(F.struct("Results")).alias("value"))
    path = materialize(made, "reports")
    text = spark.read.parquet(path)
    found = security.results(security.parse_reports(text, "value"))
    return found.select(F.col("Target").alias("target"), F.col("Vulnerabilities").isNotNull().alias("vulnerable"))


_KNOWN = ", ".join(f"'{p}'" for p in coverage.KNOWN_PATHS)


@registry.add("src_12_candidates", f"select distinct '/' || [{_KNOWN}, 'README.md'][1 + length(file_path) % 17] as name from technical_debt_issues where length(file_path) % 17 < 16")
def src_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts at known places of one root, among files that are named after them."""
    names = F.array(*[F.lit(p) for p in (*coverage.KNOWN_PATHS, "README.md")])
    rows = read(spark, sf_dir, "technical_debt_issues").where("file_path is not null")
    files = rows.select(F.concat(F.lit("/"), F.element_at(names, (1 + F.length("file_path") % 17).cast("int"))).alias("path")).distinct()
    return trees.coverage_candidates(files.withColumns({"length": F.lit(10), "content": F.lit("x").cast("binary")}), [""]).select("name")


@registry.add("src_13_bounded", "select doc_id || '/lcov.info: exceeds 500 bytes' as message from documents where octet_length(encode(text)) > 500")
def src_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with the documents' texts against a bound of their size."""
    rows = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("/lcov.info")).alias("name"), F.col("text").alias("content"))
    return coverage.rejected_artifacts(rows, 500)


@registry.add("src_14_supplied", "select file_path || ': has no known format' as message from technical_debt_issues where file_path is not null")
def src_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files supplied as artifacts are refused, each with a warning."""
    rows = read(spark, sf_dir, "technical_debt_issues").where("file_path is not null")
    return coverage.rejected_artifacts(rows.select(F.col("file_path").alias("name"), F.lit("").alias("content")))


_TELLING = (*structure.METADATA, "main.go", "build.rs", "build.zig.zon")


@registry.add(
    "src_16_metadata",
    "select file_path as path, coalesce((name in (" + ", ".join(f"'{n}'" for n in _TELLING) + ") or ends_with(name, '.java') or ends_with(name, '.csproj')) and octet_length(encode(text)) <= 1048576, false) as has_content from (select file_path, text, string_split(file_path, '/')[-1] as name from documents where file_path is not null)",
)
def src_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files structure detection reads: small ones whose names may tell something."""
    rows = read(spark, sf_dir, "documents").where("file_path is not null")
    files = rows.select(F.col("file_path").alias("path"), F.octet_length("text").alias("length"), F.col("text").cast("binary").alias("content"))
    return trees.metadata(files).select("path", F.col("content").isNotNull().alias("has_content"))


@registry.add("flt_11_vendored", "select id, len(list_filter(string_split(replace(file_path, '\\', '/'), '/'), lambda x: x in ('.git', 'node_modules', 'vendor'))) > 0 as vendored from complexity_metrics where file_path is not null")
def flt_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "complexity_metrics").where("file_path is not null").select("id", policy.is_vendored(F.col("file_path")).alias("vendored"))


@registry.add("fn_04_relative_path", "select distinct file_path, case when starts_with(file_path, '/internal/') then substr(file_path, 11) else '' end as relative from complexity_metrics where file_path is not null")
def fn_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below /internal, empty for others."""
    paths = read(spark, sf_dir, "complexity_metrics").where("file_path is not null").select("file_path").distinct()
    return paths.select("file_path", relative_path("/internal", F.col("file_path")).alias("relative"))


_RUN = ("started_at", "completed_at", "status", "duration_seconds", "total_issues_found", "critical_issues_count", "high_issues_count", "medium_issues_count", "low_issues_count")


@registry.add(
    "agg_13_run_completion",
    view("select id, case when status = 'running' then 'completed' else status end as status, cast(case when status = 'running' then floor((1743465600000000 - epoch_us(started_at)) / 1000000) else duration_seconds end as integer) as duration_seconds, cast(case when status = 'running' then 7 else total_issues_found end as integer) as total_issues_found, low_issues_count from r", r=held_sql("analysis_runs", *_RUN)),
)
def agg_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All running runs are completed with 7.9 issues found, which is cut off; other counters keep their values."""
    runs = held(spark, sf_dir, "analysis_runs", *_RUN)
    counters = runs.where("status = 'running'").select("id", F.create_map(F.lit("total_issues_found"), F.lit("7.9"), F.lit("high_issues_count"), F.lit("odd")).alias("counters"))
    now = F.timestamp_micros(F.lit(1_743_465_600_000_000))
    return writes.completed_runs(runs, now, counters).select("id", "status", "duration_seconds", "total_issues_found", "low_issues_count")


@registry.add("snk_01_json", view("select id, severity, coalesce(line_number, -1) as line_number from i", i=held_sql("technical_debt_issues", "severity", "line_number")))
def snk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as JSON and read back; an unknown line is left out of the object."""
    written = sinks.json_lines(held(spark, sf_dir, "technical_debt_issues", "severity", "line_number"))
    back = written.select(F.from_json("value", "id string, severity string, line_number int").alias("x")).select("x.*")
    return back.select("id", "severity", F.coalesce("line_number", F.lit(-1)).alias("line_number"))


# Manifests by extension as ``coverage_queries.trees`` sets them, with priority, tool and default image.
_TREES = """(select distinct repository_id repo, '/' || split_part(file_path, '/', 2) dir, lower(regexp_extract(file_path, '(\\.[^.]*)$', 1)) ext from complexity_metrics where repository_id is not null and file_path is not null and len(string_split(file_path, '/')) > 2
  and lower(split_part(file_path, '/', 2)) not in ({skipped})) t join (values ('.go', 0, 'Go', 'go', 'golang:1.24-alpine'), ('.ts', 1, 'TypeScript/JS', 'npm', 'node:lts-alpine'), ('.rs', 2, 'Rust', 'cargo', 'rust:slim'), ('.java', 3, 'Java', 'maven', 'maven:3-eclipse-temurin-21'),
  ('.py', 7, 'Python', 'pip', 'python:3.12-slim'), ('.rb', 10, 'Ruby', 'bundler', 'ruby:3.3-slim'), ('.php', 11, 'PHP', 'composer', 'php:8.3-cli-alpine'), ('.swift', 12, 'Swift', 'swift-pm', 'swift:6.0')) m(ext, rank, language, tool, image) on t.ext = m.ext""".format(skipped=", ".join(f"'{s}'" for s in policy.SKIPPED))


@registry.add("join_14_first_manifest", f"select repo, dir, min_by(language, rank) as language, min_by(tool, rank) as tool from {_TREES} group by 1, 2")
def join_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several manifests in a directory the first by priority counts."""
    return structure.build_roots(coverage_queries.trees(spark, sf_dir)).select("repo", "dir", "language", "tool")


@registry.add("rs_02_root_directories", f"select repo, dir, cast(row_number() over (partition by repo order by dir) as integer) as place from (select distinct repo, dir from {_TREES})")
def rs_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.build_roots(coverage_queries.trees(spark, sf_dir)).select("repo", "dir", "place")


@registry.add("sort_06_roots_by_depth", f"select repo, string_agg(dir, ',' order by dir) as dirs from (select distinct repo, dir from {_TREES}) group by 1")
def sort_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build roots by depth, then by path."""
    roots = structure.build_roots(coverage_queries.trees(spark, sf_dir))
    return roots.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "dir"))), lambda x: x["dir"]), ",").alias("dirs"))


@registry.add("rs_09_images", f"select repo, dir, min_by(image, rank) as image from {_TREES} group by 1, 2")
def rs_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.build_roots(coverage_queries.trees(spark, sf_dir)).select("repo", "dir", "image")


@registry.add("rs_01_structure", f"select repo, count(distinct dir) > 1 as is_monorepo, count(distinct dir) as roots from {_TREES} group by 1")
def rs_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = structure.structure_metrics(structure.build_roots(coverage_queries.trees(spark, sf_dir)))
    return made.select("repo", "is_monorepo", F.size("build_roots").cast("long").alias("roots"))


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package manifest and a Python project for each repository, by its name's length."""
    rows = read(spark, sf_dir, "user_repositories").where("name is not null").select("id", F.length("name").alias("n"))
    runner = F.element_at(F.array(F.lit("jest"), F.lit("vitest"), F.lit("none")), (1 + F.col("n") % 3).cast("int"))
    package = F.struct(F.lit("/js/package.json").alias("path"), F.concat(F.lit('{"devDependencies":{"'), runner, F.lit('":"1"}}')).alias("content"))
    lock = F.struct(F.when(F.col("n") % 2 == 0, "/js/yarn.lock").otherwise("/js/x.txt").alias("path"), F.lit("").alias("content"))
    project = F.struct(F.lit("/py/pyproject.toml").alias("path"), F.when(F.col("n") % 2 == 0, "[tool.poetry]").otherwise("[project]").alias("content"))
    return rows.select(F.col("id").alias("repo"), F.explode(F.array(package, lock, project)).alias("f")).select("repo", "f.*")


@registry.add("rs_04_script_projects", "select id as repo, case when length(name) % 2 = 0 then 'yarn' else 'npm' end as tool, ['jest', 'vitest', ''][1 + length(name) % 3] as test_runner from user_repositories where name is not null")
def rs_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.build_roots(_packages(spark, sf_dir)).where("dir = '/js'").select("repo", "tool", "test_runner")


@registry.add("rs_05_python_projects", "select id as repo, case when length(name) % 2 = 0 then 'poetry' else 'pip' end as tool from user_repositories where name is not null")
def rs_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.build_roots(_packages(spark, sf_dir)).where("dir = '/py'").select("repo", "tool")


class _Counting:
    """An analyzer of users' own making: files per language."""

    id, name = "counting", "Files"

    def analyze(self, spark: SparkSession, files: DataFrame) -> Result:
        return Result(metrics={r["language"]: r["n"] for r in policy.with_language(files, "path").groupBy("language").agg(F.count("*").alias("n")).collect()})


_DOC_LANGUAGE = "case " + " ".join(f"when lower(regexp_extract(file_path, '(\\.[^.]*)$', 1)) = '{e}' then '{language}'" for e, language in policy.ANALYZABLE.items()) + " end"


@registry.add("ext_01_own_analyzer", f"select {_DOC_LANGUAGE} as name, count(*) as value from documents where file_path is not null and {_DOC_LANGUAGE} is not null group by 1")
def ext_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = run(spark, coverage_queries.sources(spark, sf_dir), [_Counting()])
    return spark.createDataFrame([(n, v) for _, n, v in report.metrics], "name string, value long")
