"""Queries on coverage and security reports, parsers and paths (COV, SEC, CX-09/10, FLT-04, FN, RS, EXT).

There are no reports among the test tables, so one artifact per file is made from the metrics of its
functions: a function's first line is a line of code and its complexity modulo 3 the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text
from codestrata.operators import analysis, coverage, policy, security
from codestrata.parse.registry import ast_nodes, parse_files, register_udtf
from codestrata.plans.registry import Registry
from codestrata.tables import read

registry = Registry()

_L = "(select repository_id || '|' || file_path as artifact, file_path, start_line as line, max(cyclomatic_complexity % 3) as hits from complexity_metrics where repository_id is not null and file_path is not null and start_line is not null and cyclomatic_complexity is not null group by all)"
_REPORT = "select artifact, {path} as path, cast(count(*) as integer) as lines_total, cast(count(*) filter (hits > 0) as integer) as lines_covered, round(100.0 * count(*) filter (hits > 0) / count(*), 6) as line_coverage, {branch} as branch_coverage, coalesce(string_agg(line::varchar, ',' order by line) filter (hits <= 0), '') as uncovered from {l} l group by artifact, file_path"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "complexity_metrics").where("repository_id is not null and file_path is not null and start_line is not null and cyclomatic_complexity is not null")
    return rows.groupBy(F.concat_ws("|", "repository_id", "file_path").alias("artifact"), "file_path", F.col("start_line").alias("line")).agg(F.max(F.col("cyclomatic_complexity") % 3).alias("hits"))


def artifacts(spark: SparkSession, sf_dir: str, name: str, head: Column, item: Column, tail: Column, between: str = "") -> DataFrame:
    """One artifact per file whose content is a head, the items of its lines and a tail."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("line", item.alias("item")))), lambda x: x["item"])
    made = lines(spark, sf_dir).groupBy("artifact", "file_path").agg(items.alias("items"))
    return made.select("artifact", F.lit(name).alias("name"), F.lit("").alias("root"), F.concat(head, F.array_join("items", between), tail).alias("content"))


def _shown(report: DataFrame) -> DataFrame:
    return report.select("artifact", "path", "lines_total", "lines_covered", F.round("line_coverage", 6).alias("line_coverage"), F.round("branch_coverage", 6).alias("branch_coverage"), F.array_join(F.transform("uncovered_lines", lambda x: x.cast("string")), ",").alias("uncovered"))


def _sql(path: str = "file_path", branch: str = "-1.0::double") -> str:
    return _REPORT.format(path=path, branch=branch, l=_L)


def _attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))


_ROOTED = "case when starts_with(file_path, '/') then file_path else '/' || file_path end"
_GO_PATH = "coalesce(" + ", ".join(f"nullif(regexp_extract('example.com/o/r' || file_path, '^.*/({s}/.*)$', 1), '')" for s in ("cmd", "internal", "pkg", "src", "lib")) + ", regexp_extract('example.com/o/r' || file_path, '^[^/]*/[^/]*/[^/]*/(.*)$', 1))"


@registry.add("cov_02_go", _sql(_GO_PATH))
def cov_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line").cast("string")
    item = F.concat(F.lit("example.com/o/r"), F.col("file_path"), F.lit(":"), line, F.lit(".1,"), line, F.lit(".9 1 "), F.col("hits").cast("string"))
    made = artifacts(spark, sf_dir, "coverage.out", F.lit("mode: count\n"), item, F.lit("\nbroken line\n"), "\n")
    return _shown(coverage.parse_go(coverage.text_lines(made)))


@registry.add("cov_03_lcov", _sql(branch="50.0::double"))
def cov_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("DA:"), F.col("line").cast("string"), F.lit(","), F.col("hits").cast("string"))
    made = artifacts(spark, sf_dir, "lcov.info", F.concat(F.lit("DA:1,1\nSF:"), F.col("file_path"), F.lit("\n")), item, F.lit("\nBRF:9\nBRF:4\nBRH:2\nend_of_record\nDA:2,2\n"), "\n")
    return _shown(coverage.parse_lcov(coverage.text_lines(made)))


@registry.add("cov_04_cobertura", _sql(_ROOTED, "25.0::double"))
def cov_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line once without hits in a method and once as it is in the class, merged by the greatest hits."""
    item = F.concat(F.lit("<line"), _attribute("number", F.col("line")), _attribute("hits", F.col("hits")), F.lit("/>"))
    head = F.concat(F.lit("<coverage><packages><package><classes><class"), _attribute("filename", F.col("file_path")), F.lit(' branch-rate="0.25"><lines>'))
    return _shown(coverage.parse_cobertura(artifacts(spark, sf_dir, "coverage.xml", head, item, F.lit("</lines></class></classes></package></packages></coverage>"))))


@registry.add("cov_05_jacoco", _sql("'/' || replace('p.q', '.', '/') || '/' || regexp_replace(file_path, '^/', '')", "75.0::double"))
def cov_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("<line"), _attribute("nr", F.col("line")), _attribute("ci", F.col("hits")), F.lit(' mi="1"/>'))
    head = F.concat(F.lit('<report><package name="p.q"><sourcefile'), _attribute("name", F.regexp_replace("file_path", "^/", "")), F.lit(">"))
    return _shown(coverage.parse_jacoco(artifacts(spark, sf_dir, "jacoco.xml", head, item, F.lit('<counter type="BRANCH" missed="1" covered="3"/></sourcefile></package></report>'))))


@registry.add("cov_06_clover", _sql(_ROOTED, "50.0::double"))
def cov_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("<line"), _attribute("num", F.col("line")), _attribute("count", F.col("hits")), F.lit(' type="stmt"/>'))
    head = F.concat(F.lit("<coverage><project><package><file"), _attribute("name", F.col("file_path")), F.lit('><metrics conditionals="4" coveredconditionals="2"/><line num="1" type="cond" count="0"/>'))
    return _shown(coverage.parse_clover(artifacts(spark, sf_dir, "clover.xml", head, item, F.lit("</file></package></project></coverage>"))))


@registry.add("cov_07_simplecov", f"select artifact, {_ROOTED} as path, cast(count(*) as integer) as lines_total, cast(count(*) filter (hits > 0) as integer) as lines_covered from {_L} l group by artifact, file_path")
def cov_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two suites, one in either notation; positions stand for lines."""
    hits = F.col("hits").cast("string")
    listed = lines(spark, sf_dir).groupBy("artifact", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", hits.alias("h")))), lambda x: x["h"]), ",").alias("all"))
    content = F.concat(F.lit('{"A":{"coverage":{"'), F.col("file_path"), F.lit('":['), F.col("all"), F.lit(',null]}},"B":{"coverage":{"'), F.col("file_path"), F.lit('":{"lines":['), F.col("all"), F.lit("]}}}}"))
    made = listed.select("artifact", F.lit(".resultset.json").alias("name"), F.lit("").alias("root"), content.alias("content"))
    return coverage.parse_simplecov(made).select("artifact", "path", "lines_total", "lines_covered")


_F = f"(select split_part(artifact, '|', 1) repo, file_path path, count(*) t, count(*) filter (hits > 0) c, 100.0 * count(*) filter (hits > 0) / count(*) pct, case when count(*) % 2 = 0 then 50.0 else -1.0 end br from {_L} l group by artifact, file_path)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered files per repository; branch coverage is known for every other."""
    rows = lines(spark, sf_dir).groupBy("artifact", "file_path").agg(F.count("*").cast("int").alias("lines_total"), F.count_if(F.col("hits") > 0).cast("int").alias("lines_covered"), F.sort_array(F.collect_list(F.when(F.col("hits") <= 0, F.col("line")))).alias("uncovered_lines"))
    return rows.select(
        F.split_part("artifact", F.lit("|"), F.lit(1)).alias("repo"), "artifact", F.col("file_path").alias("path"), "lines_total", "lines_covered", (100.0 * F.col("lines_covered") / F.col("lines_total")).alias("line_coverage"),
        F.when(F.col("lines_total") % 2 == 0, 50.0).otherwise(-1.0).alias("branch_coverage"), F.lit(-1.0).alias("function_coverage"), "uncovered_lines",
    )


@registry.add("cov_01_dispatch", "select name, case name when 'coverage.out' then 'go' when 'coverage/lcov.info' then 'lcov' when 'coverage.xml' then 'cobertura' when 'target/site/jacoco/jacoco.xml' then 'jacoco' when 'clover.xml' then 'clover' when 'coverage/.resultset.json' then 'simplecov' end as format, count(*) as n from (select ['coverage.out','coverage/lcov.info','coverage.xml','target/site/jacoco/jacoco.xml','clover.xml','coverage/.resultset.json','notes.txt'][1 + length(file_path) % 7] as name from technical_debt_issues where file_path is not null) group by 1, 2")
def cov_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("coverage.out", "coverage/lcov.info", "coverage.xml", "target/site/jacoco/jacoco.xml", "clover.xml", "coverage/.resultset.json", "notes.txt")])
    rows = read(spark, sf_dir, "technical_debt_issues").where("file_path is not null").select(F.element_at(names, (1 + F.length("file_path") % 7).cast("int")).alias("name"))
    return rows.groupBy("name", coverage.format_of(F.col("name")).alias("format")).agg(F.count("*").alias("n"))


@registry.add("cov_08_overall", f"select repo, round(100.0 * sum(c) / sum(t), 6) as line_pct, round(coalesce(sum(case when br >= 0 then br * t end) / sum(case when br >= 0 then t end), -1.0), 6) as branch_pct from {_F} group by 1")
def cov_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = coverage.overall(files(spark, sf_dir), ["repo"])
    return made.select("repo", F.round("line_pct", 6).alias("line_pct"), F.round("branch_pct", 6).alias("branch_pct"))


_BARE = "regexp_replace(replace(file_path, '\\', '/'), '^/+', '')"


@registry.add("cov_09_located", f"select distinct file_path as given, case length(file_path) % 5 when 2 then regexp_extract({_BARE}, '[^/]*$') else {_BARE} end as path from issue_snapshots where file_path is not null")
def cov_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of reports in the repository's form: absolute below it, with parts that lead up and down, out of it, with a dot, and plain."""
    paths = read(spark, sf_dir, "issue_snapshots").where("file_path is not null").select(F.col("file_path").alias("given")).distinct()
    bare, way = F.ltrim(text.slashed(F.col("given")), F.lit("/")), F.length("given") % 5
    told = F.when(way == 0, F.concat(F.lit("/repo/x/../"), bare)).when(way == 1, F.concat(F.lit("src/x/../../"), bare)).when(way == 2, F.concat(F.lit("a/../../../"), bare)).when(way == 3, F.concat(F.lit(" ./"), bare, F.lit(" "))).otherwise(F.col("given"))
    reports = paths.withColumns({"path": told, "build_root": F.lit("")})
    return coverage.located(reports, paths.select(text.canonical_path("given").alias("path")), "/repo").select("given", "path")


@registry.add("cov_10_merged", f"select path, arg_max(t, repo) as lines_total, arg_max(c, repo) as lines_covered from {_F} group by 1")
def cov_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per repository; on a path that several have the last by id holds."""
    reports = files(spark, sf_dir).select(F.col("repo").alias("report_no"), "path", F.col("lines_total").cast("long").alias("lines_total"), F.col("lines_covered").cast("long").alias("lines_covered"))
    return coverage.merged_reports(reports, [])


@registry.add("cov_10_repeated_paths", f"select repo, dir as path, t as lines_total from (select *, '/' || split_part(path, '/', 2) as dir, count(distinct length(path) % 2) over (partition by repo) as reports from {_F}) qualify reports = 1 or row_number() over (partition by repo, dir order by length(path) % 2 desc, path desc) = 1")
def cov_10_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that name a directory often: a lone one of a repository stays as it is, of two the last row of the later one holds."""
    rows = files(spark, sf_dir).select("repo", (F.length("path") % 2).alias("report_no"), F.col("path").alias("position"), F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2)).alias("path"), F.col("lines_total").cast("long").alias("lines_total"))
    return coverage.merged_reports(rows, ["repo"])


@registry.add("cov_11_precedence", "select 'supplied' as source, count(*) as artifacts from (select distinct repository_id, file_path from complexity_metrics where repository_id is not null and file_path is not null and start_line is not null and cyclomatic_complexity is not null)")
def cov_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repositories hold no artifact, so those supplied are used and nothing is executed."""
    item = F.concat(F.lit("DA:"), F.col("line").cast("string"), F.lit(",1"))
    supplied = artifacts(spark, sf_dir, "lcov.info", F.lit("SF:x\n"), item, F.lit("\n"), "\n")
    name, chosen = coverage.first_with_candidates([("repository", supplied.limit(0)), ("supplied", supplied), ("local", None)])
    return chosen.agg(F.lit(name).alias("source"), F.count("*").alias("artifacts")).select("source", "artifacts")


@registry.add("cov_12_findings", f"select repo, '/' || regexp_replace(path, '^/', '') as path, case when c = 0 then 'medium' else 'low' end as severity, case when c = 0 then 'zero-coverage' else 'low-coverage' end as rule_id, (t - c) / 50.0 as debt_hours from {_F} where pct < 30")
def cov_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_findings(files(spark, sf_dir), ["repo"]).select("repo", "path", "severity", "rule_id", "debt_hours")


@registry.add("cov_13_metrics", f"select repo, count(*) as coverage_files_total, count(*) filter (c = 0) as coverage_files_zero, count(*) filter (c > 0 and pct < 30) as coverage_files_low, cast(sum(t) as bigint) as coverage_lines_total, cast(sum(c) as bigint) as coverage_lines_covered from {_F} group by 1")
def cov_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = coverage.coverage_metrics(files(spark, sf_dir), ["repo"])
    return made.select("repo", "coverage_files_total", "coverage_files_zero", "coverage_files_low", "coverage_lines_total", "coverage_lines_covered")


@registry.add(
    "cov_14_descriptions",
    f"""select repo, path, 'File: ' || path || chr(10) || 'Line Coverage: ' || printf('%.1f', 100.0::double * c / t) || '% (' || c || '/' || t || ' lines)' || case when t % 2 = 0 then chr(10) || 'Branch Coverage: 50.0%' else '' end
  || case when len(u) > 0 then chr(10) || case when len(u) > 20 then 'Uncovered Lines (first 20): [' else 'Uncovered Lines: [' end || array_to_string(u[:20], ' ') || ']' else '' end || chr(10) || 'Coverage Format: lcov' as description
from (select split_part(artifact, '|', 1) repo, file_path path, count(*) t, count(*) filter (hits > 0) c, coalesce(list(line order by line) filter (hits <= 0), []) u from {_L} l group by artifact, file_path)""",
)
def cov_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each file in words; one decimal is rounded as C does."""
    rows = files(spark, sf_dir)
    return rows.select("repo", "path", coverage.description(rows, F.lit("lcov")).alias("description"))


@registry.add("cov_15_warnings", "select distinct 'skipped ' || file_path as message from technical_debt_issues where file_path is not null order by 1")
def cov_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.warnings(read(spark, sf_dir, "technical_debt_issues").select(F.concat(F.lit("skipped "), "file_path").alias("message")))




_ROOTS = ("./b/", "c", "../b", "/b", ".app", " b\\x\\.. ", "a/../..x", "a/../..")


@registry.add("src_15_artifact_roots", "select id, case when name is null then 'build root is ambiguous' else [null, 'root was not detected', 'root is outside the repository', 'root is not relative to the repository', null, null, 'root was not detected', 'root is outside the repository'][1 + length(name) % 8] end as error, case when name is not null then ['b', null, null, null, '.app', 'b', null, null][1 + length(name) % 8] end as build_root from user_repositories")
def src_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of three detected roots: roots of all kinds are named, and none where the name is unknown."""
    roots = spark.createDataFrame([("a",), ("b",), (".app",)], "dir string")
    root = F.when(F.col("name").isNull(), "").otherwise(F.element_at(F.array(*[F.lit(r) for r in _ROOTS]), 1 + F.length("name") % len(_ROOTS)))
    rows = read(spark, sf_dir, "user_repositories").select("id", F.lit("lcov.info").alias("name2"), root.alias("root")).withColumnRenamed("name2", "name")
    return coverage.with_root(rows, roots).select("id", "error", "build_root")


@registry.add("src_19_coverage_commands", "select id, case lower(primary_language) when 'go' then 'go test -coverprofile=coverage.out -covermode=atomic -timeout=90s -p=4 ./...' when 'python' then 'python3 -m pytest --cov=. --cov-report=xml:coverage.xml -q --tb=no --no-header' when 'rust' then 'cargo llvm-cov --lcov --output-path lcov.info' when 'php' then 'phpunit --coverage-clover clover.xml' when 'ruby' then 'bundle exec rspec' when 'java' then 'mvn test jacoco:report' when 'kotlin' then 'mvn test jacoco:report' when 'javascript' then 'jest --coverage --coverageReporters=lcov --coverageDirectory=coverage --passWithNoTests --forceExit' when 'typescript' then 'jest --coverage --coverageReporters=lcov --coverageDirectory=coverage --passWithNoTests --forceExit' else '' end as command from user_repositories")
def src_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = coverage.coverage_command(F.col("primary_language"), F.lit("maven"), F.lit("jest"))
    return read(spark, sf_dir, "user_repositories").select("id", F.coalesce(F.array_join(words, " "), F.lit("")).alias("command"))


# --- security: one report per issue, made from its columns --------------------------------------



def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "technical_debt_issues")
    vulnerability = F.struct(F.col("tool_rule_id").alias("VulnerabilityID"), F.col("issue_type").alias("PkgName"), F.col("message").alias("Title"), F.col("severity").alias("Severity"), F.col("description").alias("Description"))
    secret = F.struct(F.col("tool_rule_id").alias("RuleID"), F.col("issue_type").alias("Category"), F.col("message").alias("Title"), F.col("line_number").alias("StartLine"))
    result = F.struct(F.col("file_path").alias("Target"), F.when(F.col("line_number").isNull(), F.array(vulnerability)).alias("Vulnerabilities"), F.when(F.col("line_number").isNotNull(), F.array(secret)).alias("Secrets"))
    return security.parse_reports(rows.select(F.to_json(F.struct(F.array(result).alias("Results"))).alias("report")), "report")


_SEC = "select file_path, line_number, case when line_number is null then 'vulnerability' else 'secret' end category, case when line_number is not null then 'critical' when upper(severity) in ('CRITICAL','HIGH','MEDIUM','LOW') then lower(severity) else 'info' end severity, case when line_number is null then coalesce(tool_rule_id, '') || ': ' || coalesce(message, '') || ' (' || coalesce(issue_type, '') || ')' else 'Hardcoded Secret: ' || coalesce(message, '') end message from technical_debt_issues"


@registry.add("sec_02_findings", _SEC)
def sec_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.security_findings(reports(spark, sf_dir)).select("file_path", "line_number", "category", "severity", "message")


@registry.add("sec_03_secrets", "select tool_rule_id, count(*) as n, sum(4.0)::double as debt_hours from technical_debt_issues where line_number is not null group by 1")
def sec_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.secrets(security.results(reports(spark, sf_dir))).groupBy("tool_rule_id").agg(F.count("*").alias("n"), F.sum("debt_hours").alias("debt_hours"))


@registry.add("sec_01_selected_targets", "select regexp_replace(replace(file_path, '\\', '/'), '^/', '') as file_path, count(*) as n from technical_debt_issues where file_path is not null and line_number is not null and regexp_replace(replace(file_path, '\\', '/'), '^/?', '/') in (select file_path from complexity_metrics union select '/' || regexp_replace(replace(file_path, '\\', '/'), '^/', '') from issue_snapshots) group by 1")
def sec_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in files that metrics or snapshots know."""
    known = read(spark, sf_dir, "complexity_metrics").select(F.col("file_path").alias("path")).unionByName(read(spark, sf_dir, "issue_snapshots").select(text.canonical_path("file_path").alias("path")))
    return security.secrets(security.results(reports(spark, sf_dir), known)).groupBy("file_path").agg(F.count("*").alias("n"))


@registry.add("sec_05_metrics", f"select count(*) as security_issues_count, count(*) filter (category = 'vulnerability') as vulnerabilities_count, count(*) filter (category = 'secret') as secrets_count, count(*) filter (severity = 'critical') as security_critical_count, count(*) filter (severity = 'high') as security_high_count, count(*) filter (severity = 'medium') as security_medium_count, count(*) filter (severity = 'low') as security_low_count from ({_SEC})")
def sec_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.security_metrics(security.security_findings(reports(spark, sf_dir)))


# --- source text ---------------------------------------------------------------------------------


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a path as source files; the id keeps equal paths apart."""
    rows = read(spark, sf_dir, "documents").where("file_path is not null")
    return rows.select(F.concat(F.lit("/"), F.col("doc_id").cast("string"), "file_path").alias("path"), F.col("text").alias("content"))


@registry.add("cx_09_snippets")
def cx_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippet of every function, at most 10000 bytes and dots."""
    parsed = parse_files(policy.with_language(sources(spark, sf_dir), "path"))
    return parsed.where("error is null").select("path", "function_ix", F.octet_length("snippet").alias("bytes"), F.endswith("snippet", F.lit("...")).alias("is_cut"))


@registry.add("cx_10_functions")
def cx_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of all documents that are source files, with their metrics."""
    return analysis.metrics(parse_files(policy.with_language(sources(spark, sf_dir), "path"))).drop("refactoring_suggestions", "code_snippet")


@registry.add("cx_10_nodes")
def cx_10_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat control-flow nodes of these functions."""
    return ast_nodes(parse_files(policy.with_language(sources(spark, sf_dir), "path")))


@registry.add("cx_10_findings")
def cx_10_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.analyze(sources(spark, sf_dir))[1]


@registry.add("ext_02_parser_function")
def ext_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsers as a table function in SQL."""
    register_udtf(spark)
    files_of = policy.with_language(sources(spark, sf_dir), "path")
    return spark.sql("select p.path, p.language, p.function_name, p.start_line from {files} f, lateral parse_code(f.language, f.path, f.content) p where p.error is null", files=files_of)


@registry.add("flt_04_content_policy", "select doc_id, case when text is null or text = '' then null when contains(text, chr(0)) then 'binary file' when len(list_filter(string_split(text, chr(10)), lambda x: octet_length(encode(x)) >= 10000)) > 0 then 'file contains severely minified or elongated lines' end as reason from documents")
def flt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", policy.content_reasons(F.col("text").cast("binary")).alias("reason"))


@registry.add("fn_03_canonical_path", "select distinct file_path, '/' || regexp_replace(replace(file_path, '\\', '/'), '^/+', '') as path from issue_snapshots where file_path is not null")
def fn_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "issue_snapshots").where("file_path is not null").select("file_path", text.canonical_path("file_path").alias("path")).distinct()


@registry.add("fn_08_format", "select id, 'run ' || id || ' took ' || coalesce(duration_seconds::varchar, 'null') || ' s' as line from analysis_runs")
def fn_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "analysis_runs").select("id", F.format_string("run %s took %d s", "id", "duration_seconds").alias("line"))


@registry.add("fn_13_xml", "select id, start_line, coalesce(language, '') as language from complexity_metrics where start_line is not null")
def fn_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as XML and read back."""
    rows = read(spark, sf_dir, "complexity_metrics").where("start_line is not null").select(F.to_xml(F.struct(F.col("id").alias("_id"), F.col("start_line").alias("_line"), F.coalesce("language", F.lit("")).alias("language"))).alias("x"))
    parsed = F.from_xml("x", "_id string, _line int, language string", {"ignoreSurroundingSpaces": "false"})
    return rows.select(parsed.alias("p")).select(F.col("p._id").alias("id"), F.col("p._line").alias("start_line"), F.coalesce("p.language", F.lit("")).alias("language"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree per repository: its files, with a manifest by the first language that a path shows."""
    paths = read(spark, sf_dir, "complexity_metrics").where("repository_id is not null and file_path is not null").select(F.col("repository_id").alias("repo"), F.col("file_path").alias("path")).distinct()
    names = {".go": "go.mod", ".py": "setup.py", ".rs": "Cargo.toml", ".java": "pom.xml", ".rb": "Gemfile", ".php": "composer.json", ".swift": "Package.swift", ".ts": "package.json"}
    manifest = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[text.extension(F.col("path"))]
    folder = F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2), F.lit("/"))
    manifests = paths.where(manifest.isNotNull()).select("repo", F.concat(folder, manifest).alias("path")).distinct()
    return paths.unionByName(manifests).withColumn("content", F.lit(""))
