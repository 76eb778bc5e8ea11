"""Coverage reports of six formats as one relation of files, and what follows from it.

Artifacts are rows of artifact (any id), name, root and content (text). A file's row has artifact,
path, lines_total, lines_covered, line_coverage, branch_coverage, function_coverage and
uncovered_lines; an unknown branch or function coverage is -1.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import basename, cleaned, fingerprint, one_decimal, relative_path, slashed
from codestrata.tables import blank_trim

MAX_ARTIFACT_BYTES = 20 * 1024 * 1024
# Where artifacts lie below a build root, and the format of each name in the order of parsers.
KNOWN_PATHS = (
    "coverage.out", "coverage/lcov.info", "lcov.info", "coverage.info", "coverage.xml", "cobertura.xml", "tarpaulin-report.xml", "coverage.cobertura.xml",
    "TestResults/coverage.cobertura.xml", "target/site/jacoco/jacoco.xml", "build/reports/jacoco/test/jacocoTestReport.xml", "build/reports/jacoco/jacoco.xml",
    "coverage/clover.xml", "clover.xml", "coverage/.resultset.json", "coverage/coverage.json",
)
FORMATS = {
    "go": ("coverage.out",), "lcov": ("lcov.info", "coverage.info", "lcov.report"), "cobertura": ("coverage.xml", "cobertura.xml", "coverage.cobertura.xml", "tarpaulin-report.xml"),
    "jacoco": ("jacoco.xml", "jacocoTestReport.xml"), "clover": ("clover.xml",), "simplecov": (".resultset.json", "coverage.json"),
}
_KEPT_SEGMENTS = ("cmd", "internal", "pkg", "src", "lib")
COLUMNS = ["artifact", "path", "lines_total", "lines_covered", "line_coverage", "branch_coverage", "function_coverage", "uncovered_lines"]


def format_of(name: Column, formats: dict[str, tuple[str, ...]] | None = None) -> Column:
    out = F.lit(None).cast("string")
    for kind, names in reversed((formats or FORMATS).items()):
        out = F.when(basename(name).isin(*names), kind).otherwise(out)
    return out


def percent(part: Column, whole: Column, otherwise: float) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(otherwise)


def file_rows(rows: DataFrame) -> DataFrame:
    """The common columns, from rows with artifact, path, lines_total, lines_covered and, where a format knows them, uncovered (lines), branch_coverage and function_coverage."""
    have = set(rows.columns)
    unknown = F.lit(-1.0)
    total, covered = F.coalesce("lines_total", F.lit(0)).cast("int"), F.coalesce("lines_covered", F.lit(0)).cast("int")
    return rows.select(
        "artifact", "path", total.alias("lines_total"), covered.alias("lines_covered"), percent(covered, total, 0.0).alias("line_coverage"),
        (F.coalesce("branch_coverage", unknown) if "branch_coverage" in have else unknown).alias("branch_coverage"),
        (F.coalesce("function_coverage", unknown) if "function_coverage" in have else unknown).alias("function_coverage"),
        (F.sort_array(F.coalesce("uncovered", F.array().cast("array<int>"))) if "uncovered" in have else F.array().cast("array<int>")).alias("uncovered_lines"),
    )


def text_lines(artifacts: DataFrame) -> DataFrame:
    """The lines of text artifacts: artifact, pos, line (trimmed)."""
    return artifacts.select("artifact", F.posexplode(F.split("content", "\n")).alias("pos", "raw")).select("artifact", "pos", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("line"))


def package_path(path: Column) -> Column:
    """A Go package path from its last conventional directory on, else without its first three parts."""
    kept = [F.nullif(F.regexp_extract(path, f"^.*/({s}/.*)$", 1), F.lit("")) for s in _KEPT_SEGMENTS]
    return F.coalesce(*kept, F.nullif(F.regexp_extract(path, "^[^/]*/[^/]*/[^/]*/(.*)$", 1), F.lit("")), path)


def parse_go(lines: DataFrame) -> DataFrame:
    """Statements per file of a Go profile; malformed lines don't count, and lines are where uncovered blocks begin."""
    fields = F.split(F.trim(F.substring_index("line", ":", -1)), r"\s+")
    span = F.split(fields[0], ",")
    number = lambda c: F.regexp_replace(c, "^[+]", "").try_cast("int")
    rows = lines.where(~F.col("line").startswith("mode:") & F.col("line").contains(":")).select(
        "artifact", F.regexp_extract("line", "^(.*):[^:]*$", 1).alias("file"), number(F.split(F.get(span, F.lit(0)), r"\.")[0]).alias("start"), number(F.split(F.get(span, F.lit(1)), r"\.")[0]).alias("stop"),
        number(F.get(fields, F.lit(1))).alias("statements"), number(F.get(fields, F.lit(2))).alias("count"),
    )
    good = rows.where("start >= 1 and stop >= start and statements >= 1 and count is not null")
    hit = F.col("count") > 0
    files = good.groupBy("artifact", "file").agg(F.sum("statements").alias("lines_total"), F.sum(F.when(hit, F.col("statements")).otherwise(0)).alias("lines_covered"), F.collect_set(F.when(~hit, F.col("start"))).alias("uncovered"))
    return file_rows(files.withColumn("path", package_path(F.col("file"))))


def parse_lcov(lines: DataFrame) -> DataFrame:
    """One row per record of LCOV; a file that is named twice has two rows.

    A record begins at its SF line and ends at the next one, at end_of_record or at the end; lines
    outside of records don't count. Of repeated totals the last holds.
    """
    order = Window.partitionBy("artifact").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    opened = F.when(line.startswith("SF:"), True).when(line == "end_of_record", False)
    marked = lines.withColumn("record", F.sum(line.startswith("SF:").cast("int")).over(order)).withColumn("inside", F.last(opened, ignorenulls=True).over(order)).where("inside")
    value = lambda tag: F.when(line.startswith(tag), F.substring(line, F.lit(len(tag) + 1), F.length(line)).try_cast("int"))
    last = lambda tag: F.max(F.when(value(tag).isNotNull(), F.struct(F.col("pos").alias("pos"), value(tag).alias("v"))))["v"]
    data = F.when(line.startswith("DA:"), F.split(F.substring(line, F.lit(4), F.length(line)), ",", 2))
    at, hits = F.get(data, F.lit(0)).try_cast("int"), F.get(data, F.lit(1)).try_cast("int")
    counted = at.isNotNull() & hits.isNotNull()
    records = marked.groupBy("artifact", "record").agg(
        F.max(F.when(line.startswith("SF:"), F.expr("substring(line, 4)"))).alias("path"),
        F.count_if(counted).alias("lines_total"),
        F.count_if(counted & (hits > 0)).alias("lines_covered"),
        F.collect_list(F.when(counted & (hits <= 0), at)).alias("uncovered"),
        *[last(f"{tag}:").alias(tag) for tag in ("BRF", "BRH", "FNF", "FNH")],
    )
    share = lambda hit, found: percent(F.coalesce(hit, F.lit(0)), F.coalesce(found, F.lit(0)), -1.0)
    return file_rows(records.withColumns({"branch_coverage": share(F.col("BRH"), F.col("BRF")), "function_coverage": share(F.col("FNH"), F.col("FNF"))}))


def merge_hits(hits: DataFrame) -> DataFrame:
    """Lines (artifact, path, line, hits) merged by the greatest hits, then counted per file: two partial aggregates."""
    best = hits.groupBy("artifact", "path", "line").agg(F.max("hits").alias("hits"))
    return best.groupBy("artifact", "path").agg(F.count("*").alias("lines_total"), F.count_if(F.col("hits") > 0).alias("lines_covered"), F.collect_list(F.when(F.col("hits") <= 0, F.col("line"))).alias("uncovered"))


def rooted(path: Column) -> Column:
    forward = slashed(path)
    return F.when(forward.startswith("/"), forward).otherwise(F.concat(F.lit("/"), forward))


def _xml(artifacts: DataFrame, schema: str) -> DataFrame:
    return artifacts.select("artifact", F.from_xml("content", schema).alias("x"))


_LINES = "lines struct<line: array<struct<_number: int, _hits: int>>>"
_COBERTURA = f"packages struct<package: array<struct<classes: struct<class: array<struct<_filename: string, `_branch-rate`: double, {_LINES.replace(' ', ': ', 1)}, methods: struct<method: array<struct<{_LINES.replace(' ', ': ', 1)}>>>>>>>>>"


def parse_cobertura(artifacts: DataFrame) -> DataFrame:
    """Classes of one file are merged by the greatest hits of each line; branch coverage is the mean of their rates, a missing one being 0."""
    empty = F.array().cast("array<struct<_number:int,_hits:int>>")
    classes = _xml(artifacts, _COBERTURA).select("artifact", F.explode("x.packages.package").alias("p")).select("artifact", F.explode("p.classes.class").alias("c"))
    of_methods = F.flatten(F.transform(F.coalesce("c.methods.method", F.array().cast("array<struct<lines:struct<line:array<struct<_number:int,_hits:int>>>>>")), lambda m: F.coalesce(m["lines"]["line"], empty)))
    rows = classes.select("artifact", rooted(F.col("c._filename")).alias("path"), F.coalesce(F.col("c.`_branch-rate`"), F.lit(0.0)).alias("rate"), F.concat(F.coalesce("c.lines.line", empty), of_methods).alias("all"))
    hits = rows.select("artifact", "path", F.explode("all").alias("l")).select("artifact", "path", F.coalesce("l._number", F.lit(0)).alias("line"), F.coalesce("l._hits", F.lit(0)).alias("hits"))
    rates = rows.groupBy("artifact", "path").agg(F.avg(F.when(F.col("rate") >= 0, F.col("rate") * 100)).alias("branch_coverage"))
    return file_rows(rates.join(merge_hits(hits), ["artifact", "path"], "left"))


_COUNTER = "counter: array<struct<_type: string, _missed: int, _covered: int>>"
_JACOCO = f"package array<struct<_name: string, sourcefile: array<struct<_name: string, line: array<struct<_nr: int, _ci: int>>, {_COUNTER}>>>>"


def parse_jacoco(artifacts: DataFrame) -> DataFrame:
    """Lines count as covered with a covered instruction; without lines the LINE counter is used."""
    files = _xml(artifacts, _JACOCO).select("artifact", F.explode("x.package").alias("p")).select("artifact", "p._name", F.explode("p.sourcefile").alias("f"))
    lines = F.coalesce("f.line", F.array().cast("array<struct<_nr:int,_ci:int>>"))
    covered = lambda l: F.coalesce(l["_ci"], F.lit(0)) > 0  # noqa: E731, E741

    def counter(kind: str) -> Column:
        """The last counter of a kind with a total above 0."""
        same = F.filter("f.counter", lambda c: (c["_type"] == kind) & (F.coalesce(c["_missed"], F.lit(0)) + F.coalesce(c["_covered"], F.lit(0)) > 0))
        return F.get(same, F.size(same) - 1)

    def share(kind: str) -> Column:
        c = counter(kind)
        hit, missed = F.coalesce(c["_covered"], F.lit(0)), F.coalesce(c["_missed"], F.lit(0))
        return percent(hit, hit + missed, -1.0)

    summed = counter("LINE")
    bare = F.size(lines) == 0
    return file_rows(
        files.select(
            "artifact", rooted(F.concat(F.replace("_name", F.lit("."), F.lit("/")), F.lit("/"), "f._name")).alias("path"),
            F.when(bare, F.coalesce(summed["_missed"], F.lit(0)) + F.coalesce(summed["_covered"], F.lit(0))).otherwise(F.size(lines)).alias("lines_total"),
            F.when(bare, F.coalesce(summed["_covered"], F.lit(0))).otherwise(F.size(F.filter(lines, covered))).alias("lines_covered"),
            F.transform(F.filter(lines, lambda l: ~covered(l)), lambda l: l["_nr"]).alias("uncovered"),  # noqa: E741
            share("BRANCH").alias("branch_coverage"), share("METHOD").alias("function_coverage"),
        )
    )


_CLOVER_FILE = "file: array<struct<_name: string, metrics: struct<_statements: int, _coveredstatements: int, _conditionals: int, _coveredconditionals: int, _methods: int, _coveredmethods: int>, line: array<struct<_num: int, _type: string, _count: int>>>>"
_CLOVER = f"project struct<package: array<struct<{_CLOVER_FILE}>>, {_CLOVER_FILE}>"


def parse_clover(artifacts: DataFrame) -> DataFrame:
    """Files of the project and of its packages; statements and methods count, without lines the metrics do."""
    x = _xml(artifacts, _CLOVER)
    none = F.array().cast(x.schema["x"].dataType["project"].dataType["file"].dataType)
    nested = F.flatten(F.transform("x.project.package", lambda p: F.coalesce(p["file"], none)))
    files = x.select("artifact", F.explode(F.concat(F.coalesce("x.project.file", none), F.coalesce(nested, none))).alias("f"))
    counted = F.filter("f.line", lambda l: l["_type"].isin("stmt", "method"))  # noqa: E741
    hit = lambda l: F.coalesce(l["_count"], F.lit(0)) > 0  # noqa: E731, E741
    has = F.coalesce(F.size("f.line") > 0, F.lit(False))
    number = lambda c: F.coalesce(F.col(f"f.metrics.{c}"), F.lit(0))
    return file_rows(
        files.select(
            "artifact", rooted(F.col("f._name")).alias("path"),
            F.when(has, F.size(counted)).otherwise(number("_statements")).alias("lines_total"),
            F.when(has, F.size(F.filter(counted, hit))).otherwise(number("_coveredstatements")).alias("lines_covered"),
            F.when(has, F.transform(F.filter(counted, lambda l: ~hit(l)), lambda l: l["_num"])).alias("uncovered"),  # noqa: E741
            percent(number("_coveredconditionals"), number("_conditionals"), -1.0).alias("branch_coverage"), percent(number("_coveredmethods"), number("_methods"), -1.0).alias("function_coverage"),
        )
    )


def parse_simplecov(artifacts: DataFrame) -> DataFrame:
    """Suites are merged by the greatest hits; null is no executable line and what is no number has no hits."""
    suites = artifacts.select("artifact", F.explode(F.from_json("content", "map<string, struct<coverage: map<string, string>>>")).alias("suite", "s"))
    files = suites.select("artifact", F.explode("s.coverage").alias("file", "raw"))
    lines = F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", "lines array<string>")["lines"]).otherwise(F.from_json("raw", "array<string>"))
    hits = files.select("artifact", rooted(F.col("file")).alias("path"), F.posexplode_outer(lines).alias("i", "v"))
    known = hits.where("v is not null").select("artifact", "path", (F.col("i") + 1).alias("line"), F.coalesce(F.col("v").try_cast("double").cast("int"), F.lit(0)).alias("hits"))
    return file_rows(hits.select("artifact", "path").distinct().join(merge_hits(known), ["artifact", "path"], "left"))


PARSERS = {"go": lambda a: parse_go(text_lines(a)), "lcov": lambda a: parse_lcov(text_lines(a)), "cobertura": parse_cobertura, "jacoco": parse_jacoco, "clover": parse_clover, "simplecov": parse_simplecov}


def parse_artifacts(artifacts: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]] | None = None, formats: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Files of artifacts of all formats, with the format; each branch reads only its own artifacts.

    Formats of one's own are added as a parser, which gives ``file_rows`` of its artifacts, and the names of their files.
    """
    typed = artifacts.withColumn("format", format_of(F.col("name"), formats))
    parts = [parser(typed.where(F.col("format") == kind)).withColumn("format", F.lit(kind)) for kind, parser in (parsers or PARSERS).items()]
    return reduce(DataFrame.unionByName, parts)


def rejected_artifacts(artifacts: DataFrame, limit: int = MAX_ARTIFACT_BYTES) -> DataFrame:
    """Warnings on artifacts that are larger than a limit or of no known format: message."""
    reason = F.when(F.octet_length("content") > limit, F.lit(f"exceeds {limit} bytes")).when(format_of(F.col("name")).isNull(), F.lit("has no known format"))
    return artifacts.select(F.concat("name", F.lit(": "), reason).alias("message")).where("message is not null")


def with_root(artifacts: DataFrame, roots: DataFrame) -> DataFrame:
    """Artifacts with build_root, or an error: an explicit root has to be detected; of several the name's prefix decides.

    ``roots`` (dir, relative to the repository, empty for the repository itself) are the few build roots of one repository. An explicit root is
    read with either slash, without outer blanks and with its ``.`` and ``..`` parts resolved; it may neither be absolute nor lead out of
    the repository. Without one the only build root is taken, or the first, by depth and name, whose directory the name begins with.
    """
    depth = lambda d: F.size(F.split(d, "/"))
    dirs = roots.agg(F.transform(F.array_sort(F.collect_set(F.struct(depth(F.col("dir")).alias("depth"), "dir"))), lambda x: x["dir"]).alias("dirs"))
    given = F.coalesce("root", F.lit(""))
    asked = blank_trim(slashed(given))
    clean = F.when(cleaned(asked) == ".", "").otherwise(cleaned(asked))
    named = cleaned(slashed(F.col("name")))
    matches = F.filter("dirs", lambda d: (d != "") & named.startswith(F.concat(d, F.lit("/"))))
    explicit = given != ""
    wrong = (
        F.when(explicit & (asked == ""), "root is empty")
        .when(explicit & (asked.startswith("/") | asked.rlike("^[A-Za-z]:/")), "root is not relative to the repository")
        .when(explicit & clean.rlike(r"^\.\.(/|$)"), "root is outside the repository")
    )
    found = (
        F.when(wrong.isNotNull(), None)
        .when(explicit, F.when(F.array_contains("dirs", clean), clean))
        .when(F.size("dirs") == 1, F.get("dirs", F.lit(0)))
        .when(F.size("dirs") == 0, "")
        .otherwise(F.get(matches, F.lit(0)))
    )
    error = F.coalesce(wrong, F.when(explicit & found.isNull(), F.lit("root was not detected")), F.when(found.isNull(), F.lit("build root is ambiguous")))
    # one row of few directories, so this is no pairing of rows
    return artifacts.join(F.broadcast(dirs)).withColumn("build_root", found).withColumn("error", error).drop("dirs")


def located(reports: DataFrame, files: DataFrame, repository: str = "") -> DataFrame:
    """Report rows (with build_root) with paths as the repository has them: below the root where such a file exists.

    Blanks around a path are dropped and its ``.`` and ``..`` parts resolved. An absolute path below ``repository``, the
    place where the report was made, becomes relative to it; other absolute ones lose their leading slashes. A path
    that still leads out of the repository keeps its name only. NULL paths stay NULL.
    """
    plain = cleaned(blank_trim(slashed(F.col("path"))))
    inside = relative_path(repository, plain) if repository else F.lit("")
    own = (plain.startswith("/")) & ~inside.isin("", ".")
    bare = F.when(plain.startswith("/"), F.ltrim(plain, F.lit("/"))).otherwise(plain)
    outside = bare.rlike(r"^\.\.(/|$)")
    safe = F.when(own, inside).when(outside, basename(bare)).otherwise(bare)
    below = F.when((F.col("build_root") != "") & ~own & ~outside, F.concat("build_root", F.lit("/"), safe)).otherwise(safe)
    known = files.select(F.regexp_replace("path", "^/+", "").alias("_known")).distinct()
    rows = reports.withColumn("_safe", safe).withColumn("_below", below)
    return rows.join(known, F.col("_below") == F.col("_known"), "left").withColumn("path", F.coalesce("_known", "_safe")).drop("_safe", "_below", "_known")


def merged_reports(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Reports (report_no, their order) of each combination of keys as one.

    A lone report stays as it is, with paths that it names twice. Of several the last report that has a path holds for it, and
    within that report the last row by ``position``, if there is such a column, else by its values.
    """
    order = ["report_no", *[c for c in ("position",) if c in reports.columns]]
    rest = [c for c in reports.columns if c not in (*keys, *order, "path")]
    lone = (F.min("report_no").eqNullSafe(F.max("report_no"))).alias("_lone")
    if keys:
        counted = reports.groupBy(*keys).agg(lone).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_lone")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        marked = reports.join(counted, same)
    else:
        marked = reports.join(F.broadcast(reports.agg(lone)))  # one row of one flag
    own = F.when(F.col("_lone"), F.monotonically_increasing_id()).alias("_own")  # keeps the rows of a lone report apart
    picked = marked.groupBy(*keys, "path", own).agg(F.max(F.struct(*order, *rest)).alias("_x"))
    return picked.select(*keys, "path", *[F.col(f"_x.{c}").alias(c) for c in rest])


def overall(files: DataFrame, keys: list[str]) -> DataFrame:
    """Line coverage over all lines, and branch coverage weighted by lines over files that know it, else -1."""
    knows = F.col("branch_coverage") >= 0
    weight = F.sum(F.when(knows, F.col("lines_total")))
    return files.groupBy(*keys).agg(
        percent(F.sum("lines_covered"), F.sum("lines_total"), 0.0).alias("line_pct"),
        F.when(weight > 0, F.sum(F.when(knows, F.col("branch_coverage") * F.col("lines_total"))) / weight).otherwise(-1.0).alias("branch_pct"),
    )


# The texts of descriptions, rules and messages of the next two functions.
def description(files: DataFrame, kind: Column) -> Column:
    """Coverage of one file in words, with the first twenty lines that are not covered."""
    lines = F.col("uncovered_lines")
    shown = F.concat(F.lit("["), F.array_join(F.slice(lines, 1, 20), " "), F.lit("]"))
    label = F.when(F.size(lines) > 20, "Uncovered Lines (first 20): ").otherwise("Uncovered Lines: ")
    share = lambda name, c: F.when(F.col(c) >= 0, F.concat(F.lit(f"{name} Coverage: "), one_decimal(c), F.lit("%")))
    return F.array_join(
        F.array_compact(
            F.array(
                F.concat(F.lit("File: "), "path"),
                F.concat(F.lit("Line Coverage: "), one_decimal("line_coverage"), F.lit("% ("), F.col("lines_covered").cast("string"), F.lit("/"), F.col("lines_total").cast("string"), F.lit(" lines)")),
                share("Branch", "branch_coverage"), share("Function", "function_coverage"),
                F.when(F.size(lines) > 0, F.concat(label, shown)), F.concat(F.lit("Coverage Format: "), kind),
            )
        ),
        "\n",
    )


def coverage_findings(files: DataFrame, keys: list[str], kind: Column | None = None) -> DataFrame:
    """Findings on files with lines of which less than 30 % are covered."""
    poor = files.where((F.col("lines_total") > 0) & (F.col("line_coverage") < 30))
    none = F.col("line_coverage") == 0
    path = F.concat(F.lit("/"), F.regexp_replace("path", "^/", ""))
    rule = F.when(none, "zero-coverage").otherwise("low-coverage")
    made = poor.select(
        *keys, path.alias("path"), F.when(none, "medium").otherwise("low").alias("severity"), rule.alias("rule_id"),
        F.when(none, F.concat(F.lit("File has 0% test coverage ("), F.col("lines_total").cast("string"), F.lit(" executable lines)")))
        .otherwise(F.concat(F.lit("File has low test coverage: "), one_decimal("line_coverage"), F.lit("% ("), F.col("lines_covered").cast("string"), F.lit("/"), F.col("lines_total").cast("string"), F.lit(" lines covered)"))).alias("message"),
        (description(poor, kind) if kind is not None else F.lit(None).cast("string")).alias("description"),
        ((F.col("lines_total") - F.col("lines_covered")) / 50.0).alias("debt_hours"),
    )
    return made.withColumn("fingerprint", fingerprint(F.col("path"), F.lit("test-coverage"), F.col("rule_id"), F.lit("")))


def coverage_metrics(files: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of files and lines beside the overall percentages; branch percentage is NULL where unknown."""
    has = F.col("lines_total") > 0
    counts = files.groupBy(*keys).agg(
        F.count("*").alias("coverage_files_total"), F.count_if(has & (F.col("line_coverage") == 0)).alias("coverage_files_zero"), F.count_if(has & (F.col("line_coverage") > 0) & (F.col("line_coverage") < 30)).alias("coverage_files_low"),
        F.sum("lines_total").alias("coverage_lines_total"), F.sum("lines_covered").alias("coverage_lines_covered"),
    )
    pct = overall(files, keys).withColumnRenamed("line_pct", "test_coverage_percentage").withColumn("coverage_branch_percentage", F.when(F.col("branch_pct") >= 0, F.col("branch_pct"))).drop("branch_pct")
    return counts.join(pct, keys) if keys else counts.join(F.broadcast(pct))


def warnings(messages: DataFrame) -> DataFrame:
    """Distinct messages in order."""
    return messages.select("message").where("message is not null").distinct().orderBy("message")


# What produces coverage, by language (and tool or test runner where it matters).
_COMMANDS = {
    "go": "go test -coverprofile=coverage.out -covermode=atomic -timeout=90s -p=4 ./...",
    "python": "python3 -m pytest --cov=. --cov-report=xml:coverage.xml -q --tb=no --no-header",
    "rust": "cargo llvm-cov --lcov --output-path lcov.info",
    "php": "phpunit --coverage-clover clover.xml",
    "ruby": "bundle exec rspec",
    "maven": "mvn test jacoco:report",
    "gradle": "gradle test jacocoTestReport",
    "jest": "jest --coverage --coverageReporters=lcov --coverageDirectory=coverage --passWithNoTests --forceExit",
    "vitest": "vitest run --coverage --coverage.reporter=lcov --coverage.reportsDirectory=coverage",
}


def coverage_command(language: Column, tool: Column, test_runner: Column) -> Column:
    """The command, as words, that produces coverage for a build root in isolation; NULL if none is known."""
    lower, runner = F.lower(language), F.lower(test_runner)
    key = (
        F.when(lower.isin("go", "python", "rust", "php", "ruby"), lower)
        .when(lower.isin("java", "kotlin") & tool.isin("maven", "gradle"), tool)
        .when(lower.isin("typescript/js", "javascript", "typescript") & runner.isin("jest", "vitest"), runner)
    )
    return F.split(F.create_map(*[F.lit(x) for pair in _COMMANDS.items() for x in pair])[key], " ")


def first_with_candidates(sources: list[tuple[str, DataFrame | None]], executors: int = 0) -> tuple[str | None, DataFrame | None]:
    """The first source (name, artifacts) that has any artifact, in order of precedence.

    A later source is used only where the earlier ones have none. Two executors at once are an error.
    """
    if executors > 1:
        raise ValueError("only one of isolated and local execution can be used")
    for name, artifacts in sources:
        if artifacts is not None and not artifacts.isEmpty():
            return name, artifacts
    return None, None
