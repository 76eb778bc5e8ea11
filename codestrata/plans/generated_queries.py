"""Queries over sources and trees that are made from the tables, so that SQL can state what they hold (CX-09/10, EXT, RS, TOPK-03, SCOPE, SEC-06).

Each row of the metrics gives one source file: a function with as many nested conditions as its complexity modulo 7, in one of twelve
languages by its first line. Each repository's files give a tree with a folder, and a manifest, for each language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text
from codestrata.operators import analysis, coverage, policy, security, structure
from codestrata.parse.registry import ast_nodes, parse_files, register_udtf
from codestrata.plans.registry import Registry
from codestrata.plans.scoring_queries import MESSAGE_SQL, SEVERITY_GO_SQL, SEVERITY_SQL
from codestrata.runner import Progress, Result, run
from codestrata.scan import Lines
from codestrata.tables import read

registry = Registry()

# Extension, language, head, opening and closing of a condition, tail.
_TEMPLATES = [
    (".go", "go", "package p\nfunc f(a bool, b bool) int {\n", "if a && b {\n", "}\n", "return 0\n}\n"),
    (".js", "javascript", "function f(a, b) {\n", "if (a && b) {\n", "}\n", "return 0;\n}\n"),
    (".ts", "typescript", "function f(a: A, b: B): number {\n", "if (a && b) {\n", "}\n", "return 0;\n}\n"),
    (".java", "java", "class C { int f(boolean a, boolean b) {\n", "if (a && b) {\n", "}\n", "return 0;\n} }\n"),
    (".cs", "csharp", "class C { int f(bool a, bool b) {\n", "if (a && b) {\n", "}\n", "return 0;\n} }\n"),
    (".cpp", "c_cpp", "int f(int a, int b) {\n", "if (a && b) {\n", "}\n", "return 0;\n}\n"),
    (".php", "php", "<?php\nfunction f($a, $b) {\n", "if ($a && $b) {\n", "}\n", "return 0;\n}\n"),
    (".rs", "rust", "fn f(a: bool, b: bool) -> i32 {\n", "if a && b {\n", "}\n", "0\n}\n"),
    (".kt", "kotlin", "fun f(a: Boolean, b: Boolean): Int {\n", "if (a && b) {\n", "}\n", "return 0\n}\n"),
    (".swift", "swift", "func f(a: Bool, b: Bool) -> Int {\n", "if a && b {\n", "}\n", "return 0\n}\n"),
    (".rb", "ruby", "def f(a, b)\n", "if a && b\n", "end\n", "0\nend\n"),
    (".py", "python", "def f(a, b):\n", "", "", ""),
]
_KIND = "1 + coalesce(start_line, 0) % 12"
_DEPTH = "coalesce(cyclomatic_complexity, 0) % 7"
_LIST = lambda i: "[" + ", ".join(f"'{t[i]}'" for t in _TEMPLATES) + "]"
_G = f"""(select '/' || id || {_LIST(0)}[{_KIND}] as file_path, {_LIST(1)}[{_KIND}] as language, cast({_DEPTH} as integer) as n, cast(1 + 2 * ({_DEPTH}) as integer) as c,
  cast(({_DEPTH}) * ({_DEPTH} + 1) // 2 + {_DEPTH} as integer) as g, 2 as p, 'f' as f from complexity_metrics where coalesce(cyclomatic_complexity, 0) >= 0)"""
_GRADED = f"(select *, case when language = 'go' then {SEVERITY_GO_SQL} else {SEVERITY_SQL} end as severity from {_G})"


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files: path and content."""
    rows = read(spark, sf_dir, "complexity_metrics").where("coalesce(cyclomatic_complexity, 0) >= 0").select("id", F.expr(_KIND).cast("int").alias("kind"), F.expr(_DEPTH).cast("int").alias("n"))
    of = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in _TEMPLATES]), F.col("kind"))
    indent = lambda i: F.repeat(F.lit("    "), i)
    python = F.concat(F.array_join(F.transform(F.slice(F.array(*[F.lit(i) for i in range(1, 8)]), F.lit(1), F.col("n")), lambda i: F.concat(indent(i), F.lit("if a and b:\n"))), ""), indent(F.col("n") + 1), F.lit("return 0\n"))
    body = F.when(F.col("kind") == len(_TEMPLATES), python).otherwise(F.concat(F.repeat(of(3), F.col("n")), F.repeat(of(4), F.col("n")), of(5)))
    return rows.select(F.concat(F.lit("/"), "id", of(0)).alias("path"), F.concat(of(2), body).alias("content"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(policy.with_language(generated(spark, sf_dir), "path"))


@registry.add("cx_10_generated_functions", f"select file_path, language, f as function_name, c as cyclomatic_complexity, g as cognitive_complexity, n as nesting_depth, p as parameter_count, severity from {_GRADED}")
def cx_10_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parsers of all languages count in the generated sources."""
    return analysis.metrics(_parsed(spark, sf_dir)).select("file_path", "language", "function_name", "cyclomatic_complexity", "cognitive_complexity", "nesting_depth", "parameter_count", "severity")


@registry.add("cx_10_generated_nodes", f"select file_path as path, t as node_type, cast(d + (t = 'Operator')::integer as integer) as depth from (select file_path, unnest(range(n)) as d from {_G}), (values ('Branch'), ('Operator')) k(t)")
def cx_10_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their nodes: conditions one within the other, each with an operator one level deeper."""
    return ast_nodes(_parsed(spark, sf_dir)).select("path", "node_type", "depth")


@registry.add("cx_10_generated_findings", f"select file_path as path, severity, {MESSAGE_SQL} as message, cast(case when language in ('go', 'php') then 2 else 1 end as integer) as line from {_GRADED} where severity in ('high', 'critical')")
def cx_10_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings on them."""
    return analysis.analyze(generated(spark, sf_dir))[1].select("path", "severity", "message", "line")


@registry.add("ext_02_generated", f"select file_path as path, language, f as function_name, cast(case when language in ('go', 'php') then 2 else 1 end as integer) as start_line, 2 * n as nodes from {_G}")
def ext_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsers as a table function in SQL."""
    register_udtf(spark)
    files = policy.with_language(generated(spark, sf_dir), "path")
    return spark.sql("select p.path, p.language, p.function_name, p.start_line, size(p.nodes) as nodes from {files} f, lateral parse_code(f.language, f.path, f.content) p where p.error is null", files=files)


@registry.add("cx_09_generated_snippets", "select '/' || p_partkey || '.go' as path, cast(least(10000, 16 + 360 * p_size) + case when 16 + 360 * p_size > 10000 then 3 else 0 end as integer) as bytes, 16 + 360 * p_size > 10000 as is_cut from part")
def cx_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of functions of some hundred to some thousand bytes, cut at 10000."""
    body = F.concat(F.lit("func long(x) {\n"), F.repeat(F.lit("// " + 356 * "x" + "\n"), F.col("p_size")), F.lit("}"))
    files = read(spark, sf_dir, "part").select(F.concat(F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), F.concat(F.lit("package p\n"), body).alias("content"))
    return parse_files(policy.with_language(files, "path")).select("path", F.octet_length("snippet").alias("bytes"), F.endswith("snippet", F.lit("...")).alias("is_cut"))


# --- trees ---------------------------------------------------------------------------------------

# Extension, priority, language, tool, manifest, test runner and image of a folder per language.
_FOLDERS = [
    (".go", 0, "Go", "go", "go.mod", "go test", "golang:1.24-alpine"), (".ts", 1, "TypeScript/JS", "npm", "package.json", "", "node:lts-alpine"), (".rs", 2, "Rust", "cargo", "Cargo.toml", "cargo test", "rust:slim"),
    (".java", 3, "Java", "maven", "pom.xml", "junit", "maven:3-eclipse-temurin-21"), (".py", 7, "Python", "pip", "setup.py", "pytest", "python:3.12-slim"), (".rb", 10, "Ruby", "bundler", "Gemfile", "", "ruby:3.3-slim"),
    (".php", 11, "PHP", "composer", "composer.json", "", "php:8.3-cli-alpine"), (".swift", 12, "Swift", "swift-pm", "Package.swift", "swift test", "swift:6.0"),
]
_VALUES = "(values " + ", ".join(f"('{e}', '{language}', '{tool}', '{manifest}', '{runner}', '{image}')" for e, _, language, tool, manifest, runner, image in _FOLDERS) + ") m(ext, language, tool, manifest, test_runner, image)"
_FILES = f"(select distinct repository_id as repo, '/' || substr(m.ext, 2) as dir, '/' || substr(m.ext, 2) || file_path as path, m.* from complexity_metrics c join {_VALUES} on lower(regexp_extract(regexp_replace(replace(file_path, '\\', '/'), '^.*/', ''), '(\\.[^.]*)$', 1)) = m.ext where repository_id is not null)"
_ROOTS = f"(select distinct repo, dir, language, tool, manifest, test_runner, image from {_FILES})"
_SKIPPED = ", ".join(f"'{s}'" for s in policy.SKIPPED)


def folders(spark: SparkSession, sf_dir: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Each repository's files in a folder for each language with its manifest, and ``extra`` files (content by path below the folder; NULL for none)."""
    manifest = F.create_map(*[F.lit(x) for f in _FOLDERS for x in (f[0], f[4])])
    rows = read(spark, sf_dir, "complexity_metrics").where("repository_id is not null and file_path is not null").select(F.col("repository_id").alias("repo"), "file_path", text.extension(F.col("file_path")).alias("ext"))
    known = rows.where(F.col("ext").isin(*[f[0] for f in _FOLDERS])).withColumn("dir", F.concat(F.lit("/"), F.expr("substring(ext, 2)")))
    files = known.select("repo", F.concat("dir", "file_path").alias("path"), F.lit("public static void main(").alias("content")).distinct()
    own = known.select("repo", "dir", manifest[F.col("ext")].alias("manifest")).distinct()
    made = F.array(F.struct(F.concat("dir", F.lit("/"), "manifest").alias("path"), F.lit("").alias("content")), *[F.struct(F.concat("dir", F.lit("/" + name)).alias("path"), content.alias("content")) for name, content in (extra or {}).items()])
    return files.unionByName(own.select("repo", F.explode(made).alias("x")).select("repo", "x.*").where("content is not null"))


@registry.add("rs_03_build_roots", f"select *, cast(row_number() over (partition by repo order by dir) as integer) as place from {_ROOTS}")
def rs_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build roots, tools and runtime images of every repository's tree, in which each manifest is delivered twice."""
    files = folders(spark, sf_dir)
    return structure.build_roots(files.unionByName(files)).select("repo", "dir", "language", "tool", "manifest", "test_runner", "image", "place")


@registry.add(
    "rs_06_source_roots",
    f"""with f as (select *, string_split(path, '/') as parts from {_FILES}), named as (
  select distinct repo, dir, dir || '/' || parts[3] as found from f where len(parts) > 3 and parts[3] in ({", ".join(f"'{d}'" for d in structure.SOURCE_DIRS)})
  union select distinct repo, dir, dir || '/' || array_to_string(parts[3:5], '/') from f where language = 'Java' and len(parts) > 5 and array_to_string(parts[3:5], '/') in ('src/main/java', 'src/main/kotlin'))
select * from named union all select repo, dir, dir from {_ROOTS} where (repo, dir) not in (select (repo, dir) from named)""",
)
def rs_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = folders(spark, sf_dir)
    return structure.source_roots(files, structure.build_roots(files)).select("repo", "dir", "found")


_ENTRIES = {"main.go": "func main() {}", "cmd/main.go": "func main() {}", "lib/main.go": "func other() {}", "pkg/__main__.py": "", "index.ts": "", "main.js": "", "deep/index.ts": "", "src/main.rs": "", "other/main.rs": ""}
_ENTRY_SQL = f"""select repo, dir, path from (
  select repo, dir, dir || x as path from {_ROOTS} join (values ('Go', '/main.go'), ('Go', '/cmd/main.go'), ('Python', '/pkg/__main__.py'), ('TypeScript/JS', '/index.ts'), ('TypeScript/JS', '/main.js'), ('Rust', '/src/main.rs')) e(l, x) on language = l
  union all select repo, dir, path from {_FILES} where language = 'Java' and not list_has_any(list_transform(string_split(path, '/')[3:-2], lambda x: lower(x)), [{_SKIPPED}]))
qualify row_number() over (partition by repo, dir order by replace(path, '/', chr(1))) <= 10"""


@registry.add("rs_08_entry_points", f"select dir, count(*) as n, count(distinct repo) as repositories from ({_ENTRY_SQL}) group by 1")
def rs_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points per folder of a language; files of all languages lie in each folder, of which its own count."""
    return _entries(spark, sf_dir).groupBy("dir").agg(F.count("*").alias("n"), F.count_distinct("repo").alias("repositories"))


@registry.add("topk_03_entry_points", _ENTRY_SQL)
def topk_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten entry points of each root, of all languages that have a rule."""
    return _entries(spark, sf_dir)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = folders(spark, sf_dir, {name: F.lit(content) for name, content in _ENTRIES.items()})
    return structure.entry_points(files, structure.build_roots(files)).select("repo", "dir", "path")


@registry.add(
    "rs_10_native_dependencies",
    f"""select repo, dir, array_to_string(list_filter([case when s % 5 = 0 then 'zig:0.14.0' end, case when s % 3 = 0 then 'clang:' end, case when s % 3 = 2 then 'cmake:' end, case when s % 3 = 0 then 'libclang-dev:' end,
  case when s % 4 = 3 then 'nasm:' end, case when s % 3 = 1 then 'pkg-config:' end, case when s % 2 = 0 then 'protobuf-compiler:' end], lambda x: x is not null), ',') as native_deps
from (select *, ascii(repo) + ascii(substr(repo, 2)) as s from {_ROOTS} where language = 'Rust')""",
)
def rs_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native tools of Rust builds, by what lies in their folder: it differs with the first letters of the repository's id."""
    s = F.ascii("repo") + F.ascii(F.substring("repo", 2, 1))
    script = F.when(s % 3 == 0, "use bindgen;").when(s % 3 == 1, "pkg_config::probe()").otherwise("cmake::build(x)")
    files = folders(spark, sf_dir, {"build.rs": script, "api/x.proto": F.when(s % 2 == 0, ""), "asm/y.nasm": F.when(s % 4 == 3, ""), "build.zig.zon": F.when(s % 5 == 0, '.minimum_zig_version = "0.14.0"'), "z.zig": F.when(s % 5 == 0, "")})
    found = structure.native_dependencies(files, structure.build_roots(files))
    return found.select("repo", "dir", F.array_join(F.transform("native_deps", lambda d: F.concat(d["name"], F.lit(":"), d["version"])), ",").alias("native_deps"))


@registry.add("rs_11_structure_metrics", f"select repo, count(*) > 1 as is_monorepo, string_agg(substr(dir, 2) || '=' || tool || '/' || test_runner || '@' || image, ',' order by dir) as build_roots from {_ROOTS} group by 1")
def rs_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = structure.structure_metrics(structure.build_roots(folders(spark, sf_dir)))
    told = F.transform("build_roots", lambda r: F.concat(r["dir"], F.lit("="), r["tool"], F.lit("/"), r["test_runner"], F.lit("@"), r["image"]))
    return made.select("repo", "is_monorepo", F.array_join(told, ",").alias("build_roots"))


@registry.add(
    "rs_01_warnings",
    f"""select id as repo, 'inspect /js/package.json: ' || case when length(name) % 5 in (1, 2, 4) then 'it is no valid manifest' else 'it is no text of at most 1048576 bytes' end as message from user_repositories where name is not null and length(name) % 5 <> 0
union all select repo, 'inspect native dependency file ' || dir || '/build.rs: it is no text of at most 1048576 bytes' from {_ROOTS} where language = 'Rust' and ascii(repo) % 2 = 0""",
)
def rs_01_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package manifests that are broken in three ways, or too large, and build scripts without a content."""
    kinds = F.array(*[F.lit(t) for t in ('{"dependencies":{}}', "{broken", "[]")], F.lit(None).cast("string"), F.lit('{"devDependencies":[1]}'))
    rows = read(spark, sf_dir, "user_repositories").where("name is not null").select(F.col("id").alias("repo"), F.lit("/js/package.json").alias("path"), F.element_at(kinds, (1 + F.length("name") % 5).cast("int")).alias("content"))
    rust = folders(spark, sf_dir, {"build.rs": F.lit("")}).withColumn("content", F.when(~(F.col("path").endswith("/build.rs") & (F.ascii("repo") % 2 == 0)), F.col("content")))
    files = rows.unionByName(rust.where("path like '/rs/%'"))
    return structure.structure_warnings(files, structure.build_roots(files)).select("repo", "message")


# --- scopes over the tables' paths ---------------------------------------------------------------------


@registry.add("scope_01_modes", "select run_type, trigger_source, count(*) as n, case when run_type = 'recalibration' then null when trigger_source is null then 'unknown scope' when trigger_source = 'cron' and count(*) >= 0 then 'an incremental scope needs at least one file' end as error from analysis_runs group by 1, 2")
def scope_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by kind and trigger as requests of a scope: full for some, incremental with or without files for others, and of no known mode without a trigger."""
    kinds = read(spark, sf_dir, "analysis_runs").groupBy("run_type", "trigger_source").agg(F.count("*").alias("n"))
    mode = F.when(F.col("run_type") == "recalibration", "full").when(F.col("trigger_source").isNotNull(), "incremental").otherwise("odd")
    targets = F.when(F.col("trigger_source") != "cron", 1).otherwise(0)
    return kinds.select("run_type", "trigger_source", "n", policy.scope_error(mode, targets).alias("error"))


_BARE = "regexp_replace(replace(file_path, '\\', '/'), '^/+', '')"


@registry.add("scope_02_targets", f"select distinct file_path as given, case length(file_path) % 5 when 0 then null else '/' || {_BARE} end as path, case length(file_path) % 5 when 0 then 'outside the root' end as error from issue_snapshots where file_path is not null")
def scope_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths named as targets in all notations: out of the root, below it, relative, with blanks and backslashes."""
    paths = read(spark, sf_dir, "issue_snapshots").where("file_path is not null").select(F.col("file_path").alias("given")).distinct()
    bare, way = F.ltrim(text.slashed(F.col("given")), F.lit("/")), F.length("given") % 5
    told = F.when(way == 0, F.concat(F.lit("../r2/"), bare)).when(way == 1, F.concat(F.lit("/r/x/../"), bare)).when(way == 2, F.concat(F.lit("  ./"), bare, F.lit(" "))).when(way == 3, F.translate(bare, "/", "\\")).otherwise(bare)
    target = policy.target("/r", told)
    return paths.select("given", target["path"].alias("path"), target["error"].alias("error"))


@registry.add("scope_03_no_changes", "select coalesce(source, '') as source, count(*) as everything, cast(count(*) filter (file_path in (select '/' || regexp_replace(replace(file_path, '\\', '/'), '^/+', '') from issue_snapshots)) as bigint) as incremental, cast(0 as bigint) as no_changes from documents where file_path is not null group by 1")
def scope_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each scope selects, per source: all, those in files that deliveries know, none."""
    files = read(spark, sf_dir, "documents").where("file_path is not null").select(F.coalesce("source", F.lit("")).alias("source"), F.col("file_path").alias("path"))
    targets = read(spark, sf_dir, "issue_snapshots").select(text.canonical_path("file_path").alias("path"))
    counts = [policy.selected(files, mode, targets).select("source", *[F.lit(int(m == mode)).alias(m) for m in ("full", "incremental", "no_changes")]) for mode in ("full", "incremental", "no_changes")]
    whole = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return whole.groupBy("source").agg(F.sum("full").alias("everything"), F.sum("incremental").alias("incremental"), F.sum("no_changes").alias("no_changes"))


@registry.add("sec_06_unavailable", "select r.id, count(i.id) as security_issues_count, count(i.id) > 0 as security_available, case when count(i.id) = 0 then 'no report' end as security_skip_reason from user_repositories r left join (select * from technical_debt_issues where severity = 'critical') i on r.id = i.repository_id group by 1")
def sec_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security counts of all repositories, of which those without a report are told as skipped."""
    found = read(spark, sf_dir, "technical_debt_issues").where("severity = 'critical'").select("repository_id", F.lit("secret").alias("category"), "severity")
    return security.available_metrics(read(spark, sf_dir, "user_repositories").select("id"), "id", found, "repository_id", "no report").select("id", "security_issues_count", "security_available", "security_skip_reason")


# --- extension points over the tables ------------------------------------------------------------------


def _parse_plain(artifacts: DataFrame) -> DataFrame:
    """A format of users' own making: path, total and covered lines, apart by a bar."""
    parts = F.split("content", r"\|")
    rows = artifacts.select("artifact", parts[0].alias("path"), parts[1].cast("int").alias("lines_total"), parts[2].cast("int").alias("lines_covered"))
    return coverage.file_rows(rows)


@registry.add("ext_03_parser_registry", "select format, count(*) as files, cast(sum(t) as bigint) as lines_total from (select 'plain' as format, length(file_path) % 50 + 1 as t from issue_snapshots where file_path is not null and length(file_path) % 2 = 0 union all select 'lcov', 1 from issue_snapshots where file_path is not null and length(file_path) % 2 = 1) group by 1")
def ext_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser of one's own beside the built-in ones: every other delivered path comes as a plain report, the rest as LCOV."""
    rows = read(spark, sf_dir, "issue_snapshots").where("file_path is not null").withColumn("n", F.monotonically_increasing_id())
    plain = F.length("file_path") % 2 == 0
    content = F.when(plain, F.concat_ws("|", "file_path", (F.length("file_path") % 50 + 1).cast("string"), F.lit("0"))).otherwise(F.concat(F.lit("SF:"), "file_path", F.lit("\nDA:1,1\nend_of_record\n")))
    artifacts = rows.select(F.col("n").alias("artifact"), F.when(plain, "cover.plain").otherwise("lcov.info").alias("name"), F.lit("").alias("root"), content.alias("content"))
    found = coverage.parse_artifacts(artifacts, coverage.PARSERS | {"plain": _parse_plain}, coverage.FORMATS | {"plain": ("cover.plain",)})
    return found.groupBy("format").agg(F.count("*").alias("files"), F.sum("lines_total").alias("lines_total"))


class _OfSource:
    """An analyzer of the documents of one source; sources of an odd number of documents fail."""

    def __init__(self, source: str) -> None:
        self.id = self.name = self.source = source

    def analyze(self, spark: SparkSession, files: DataFrame) -> Result:
        n = files.where(F.col("source") == self.source).count()
        if n % 2:
            raise RuntimeError(f"{n} documents")
        return Result(metrics={"documents": n})


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[_OfSource]]:
    documents = read(spark, sf_dir, "documents").select("source", F.col("file_path").alias("path"), F.col("text").alias("content"))
    return documents, [_OfSource(r["source"]) for r in documents.where("source is not null").select("source").distinct().orderBy("source").limit(64).collect()]  # the kinds of source are eight


_COUNTS = "(select source, count(*) as n from documents where source is not null group by 1)"


@registry.add("ext_05_isolation", f"select source as analyzer_id, case when n % 2 = 0 then n end as documents, case when n % 2 = 1 then n || ' documents' end as error from {_COUNTS} union all select min(source), null, 'analyzer id occurs twice' from {_COUNTS}")
def ext_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analyzer for each source and the first one twice: some fail, and the others give their results."""
    files, analyzers = _sources(spark, sf_dir)
    report = run(spark, files, [*analyzers, analyzers[0]])
    return spark.createDataFrame([(a, v, None) for a, _, v in report.metrics] + [(a, None, e) for a, e in report.failures], "analyzer_id string, documents long, error string")


@registry.add("ext_06_progress", f"select cast(2 * row_number() over (order by source) - 1 as integer) as position, source as analyzer_id, 'started' as stage from {_COUNTS} union all select cast(2 * row_number() over (order by source) as integer), source, case when n % 2 = 0 then 'finished' else 'failed' end from {_COUNTS}")
def ext_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of them while they run one after the other."""
    events: list[tuple] = []

    def told(p: Progress) -> None:
        events.append((p.index, p.analyzer_id, p.stage))

    files, analyzers = _sources(spark, sf_dir)
    run(spark, files, analyzers, parallel=1, progress=told)
    return spark.createDataFrame(events, "position int, analyzer_id string, stage string")


@registry.add("ext_07_side_by_side", f"select source as analyzer_id, 'documents' as metric, n as value from {_COUNTS} where n % 2 = 0 union all select 'lines', 'file_count', count(*) from documents where lower(regexp_extract(file_path, '(\\.[^.]*)$', 1)) in ({', '.join(f"'{e}'" for e in sorted(policy.COUNTABLE))}) union all select 'lines', 'total_loc', cast(coalesce(sum(length(text) - length(replace(text, chr(10), ''))), 0) as bigint) from documents where lower(regexp_extract(file_path, '(\\.[^.]*)$', 1)) in ({', '.join(f"'{e}'" for e in sorted(policy.COUNTABLE))})")
def ext_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in and own analyzers at the same time over all documents."""
    files, analyzers = _sources(spark, sf_dir)
    report = run(spark, files, [*analyzers, Lines()], parallel=4)
    return spark.createDataFrame([(a, k, v) for a, k, v in report.metrics], "analyzer_id string, metric string, value long")
