"""Queries on complexity, severity, debt, suggestions and scalar functions (CX, FLT, SEC, AGG gates, FN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import scoring, text
from codestrata.operators import policy
from codestrata.plans.bindings import NODES_SQL, folded_sql, functions_and_nodes, held, held_sql, view
from codestrata.plans.registry import Registry
from codestrata.tables import folded, read

registry = Registry()
MEASURES = ["cyclomatic_complexity", "cognitive_complexity", "nesting_depth", "parameter_count", "lines_of_code"]


def _metrics(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Metric rows that hold; huge outliers stay within 32 bits after scoring."""
    return held(spark, sf_dir, "complexity_metrics", *MEASURES, *more)


def _metrics_sql(*more: str) -> str:
    return held_sql("complexity_metrics", *MEASURES, *more)


def _measures() -> list[F.Column]:
    return [F.col(m) for m in MEASURES]


# The measures in SQL with NULL as 0, under short names.
_SHORT = "select id, coalesce(cyclomatic_complexity, 0) c, coalesce(cognitive_complexity, 0) g, coalesce(nesting_depth, 0) n, coalesce(parameter_count, 0) p, coalesce(lines_of_code, 0) l"


def _scored(sql: str, *more: str) -> str:
    return view(sql, h=_metrics_sql(*more), m=f"({_SHORT}{''.join(', ' + x for x in more)} from h)")


SEVERITY_SQL = "case when c > 20 or g > 25 or n > 5 then 'critical' when c > 15 or g > 20 or n > 4 then 'high' when c > 10 or g > 15 or n > 3 then 'medium' else 'low' end"
SEVERITY_GO_SQL = "case when c > 20 or n > 7 or g > 25 then 'critical' when c > 10 or n > 5 or p > 7 or g > 15 then 'high' when c > 5 or n > 4 or p > 5 or g > 7 then 'medium' else 'low' end"


@registry.add(
    "cx_01_complexity_reduction",
    view(
        """select p_partkey, cast(1 + count(*) filter (node_type in ('Branch','Loop','Closure','Operator')) as integer) as cyclomatic,
  cast(coalesce(sum(case when node_type in ('Branch','Loop','Closure') then 1 + depth when node_type = 'Operator' then 1 else 0 end), 0) as integer) as cognitive,
  cast(coalesce(max(depth), 0) as integer) as nesting from part left join n using (p_partkey) group by 1""",
        n=NODES_SQL,
    ),
)
def cx_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of orders as nodes of the parts."""
    functions, nodes = functions_and_nodes(spark, sf_dir)
    return scoring.reduce_nodes(functions, nodes, ["p_partkey"])


@registry.add("cx_02_severity", _scored(f"select id, {SEVERITY_SQL} as severity from m"))
def cx_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    cyc, cog, nest, _, _ = _measures()
    return _metrics(spark, sf_dir).select("id", scoring.severity(cyc, cog, nest).alias("severity"))


@registry.add("cx_03_severity_go", _scored(f"select id, {SEVERITY_GO_SQL} as severity from m"))
def cx_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    cyc, cog, nest, par, _ = _measures()
    return _metrics(spark, sf_dir).select("id", scoring.severity_go(cyc, cog, nest, par).alias("severity"))


@registry.add(
    "cx_04_debt_minutes",
    _scored(
        """select id, cast(case when c > 20 then (c - 20) * 15 when c > 10 then (c - 10) * 10 when c > 5 then (c - 5) * 5 else 0 end
  + case when g > 15 then (g - 15) * 8 else 0 end + case when n > 5 then (n - 5) * 20 when n > 3 then (n - 3) * 10 else 0 end
  + case when p > 7 then (p - 7) * 15 when p > 5 then (p - 5) * 10 else 0 end
  + case when l > 300 then ((l - 300) // 50) * 30 when l > 150 then ((l - 150) // 50) * 15 else 0 end as integer) as debt_minutes from m"""
    ),
)
def cx_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("id", scoring.debt_minutes(*_measures()).alias("debt_minutes"))


@registry.add(
    "cx_05_pipeline_debt",
    _scored("select id, case when c <= 15 then 0.0 else (c - 15) * 30 / 60.0 end::double as debt_hours, cast(floor(case when c <= 15 then 0.0 else (c - 15) * 30 / 60.0 end::double * 60.0) as integer) as debt_minutes from m"),
)
def cx_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    cyc = F.col("cyclomatic_complexity")
    return _metrics(spark, sf_dir).select("id", scoring.pipeline_debt_hours(cyc, 15).alias("debt_hours"), scoring.pipeline_debt_minutes(cyc, 15).alias("debt_minutes"))


_TAXED = {"c": "c++", "rust": "rust", "ruby": "ruby", "kotlin": "kotlin", "swift": "swift"}


@registry.add(
    "cx_06_language_debt",
    _scored("select id, " + ", ".join(f"cast(5 + greatest((c - 10) * 2, 0) + greatest(g - 15, 0) + greatest(l - 30, 0) // 5 + {scoring.LANGUAGE_TAX[v]} as integer) as debt_{k}" for k, v in _TAXED.items()) + " from m"),
)
def cx_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    cyc, cog, _, _, loc = _measures()
    return _metrics(spark, sf_dir).select("id", *[scoring.language_debt(v, cyc, cog, loc).alias(f"debt_{k}") for k, v in _TAXED.items()])


@registry.add(
    "cx_07_suggestions_go",
    _scored(
        """select id, array_to_string(list_filter([
  case when c > 20 then 'extract_method:high:Cyclomatic complexity of ' || c || ' exceeds critical threshold of 20' when c > 10 then 'simplify_logic:medium:Cyclomatic complexity of ' || c || ' exceeds recommended threshold of 10' end,
  case when n > 5 then 'reduce_nesting:high:Nesting depth of ' || n || ' makes code difficult to understand' end,
  case when p > 7 then 'introduce_parameter_object:medium:Function has ' || p || ' parameters, making it hard to use and test' end,
  case when l > 300 then 'split_function:high:Function length of ' || l || ' lines exceeds maintainability threshold' end,
  case when g > 15 then 'simplify_logic:high:Cognitive complexity of ' || g || ' makes code difficult to comprehend' end], lambda x: x is not null), ';') as suggested from m"""
    ),
)
def cx_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.suggestions_go(*_measures())
    return _metrics(spark, sf_dir).select("id", F.array_join(F.transform(made, lambda s: F.concat_ws(":", s["type"], s["priority"], s["reason"])), ";").alias("suggested"))


@registry.add("cx_08_suggestions", _scored("select id, cast((c > 15)::int + (n > 3)::int + (p > 4)::int + (l > 50)::int + (g > 20)::int as integer) as rust, cast((c > 15)::int + (n > 3)::int + (p > 5)::int + (l > 50)::int + (g > 20)::int as integer) as cpp from m"))
def cx_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suggestions apply; their texts are pinned in the tests."""
    return _metrics(spark, sf_dir).select("id", F.size(scoring.suggestions("rust", *_measures())).alias("rust"), F.size(scoring.suggestions("c++", *_measures())).alias("cpp"))


@registry.add(
    "cx_11_summary",
    view(
        "select count(*) as total_functions, round(avg(cyclomatic_complexity), 6) as average_cyclomatic, max(cyclomatic_complexity) as max_cyclomatic, count(*) filter (severity = 'critical') as critical_count, count(*) filter (severity = 'high') as high_count, cast(sum(cast(technical_debt_minutes as bigint)) as bigint) / 60.0 as debt_hours from h",
        h=_metrics_sql("severity", "technical_debt_minutes"),
    ),
)
def cx_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.summary(_metrics(spark, sf_dir, "severity", "technical_debt_minutes"), "cyclomatic_complexity", "severity", "technical_debt_minutes")
    return made.withColumn("average_cyclomatic", F.round("average_cyclomatic", 6))


MESSAGE_SQL = """case when c > 20 then 'Function ''' || f || ''' has critical cyclomatic complexity of ' || c || ' (threshold: 20)'
  when c > 10 then 'Function ''' || f || ''' has high cyclomatic complexity of ' || c || ' (threshold: 10)'
  when n > 5 then 'Function ''' || f || ''' has deep nesting depth of ' || n || ' (threshold: 5)'
  else 'Function ''' || f || ''' has complexity issues' end"""


@registry.add("cx_12_message", view(f"select id, {MESSAGE_SQL} as message from m", h=_metrics_sql("function_name"), m=f"({_SHORT}, coalesce(function_name, '<anonymous>') f from h)"))
def cx_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce("function_name", F.lit("<anonymous>"))
    return _metrics(spark, sf_dir, "function_name").select("id", scoring.finding_message(name, F.col("cyclomatic_complexity"), F.col("nesting_depth")).alias("message"))


def _advice_sql() -> str:
    """The suggestions for Go that apply, a line each; of the two on cyclomatic complexity only the stronger."""
    short = {"cyclomatic": "c", "nesting": "n", "params": "p", "loc": "l", "cognitive": "g"}
    parts = [f"case when {short[m]} > {limit}{' and c <= 20' if (m, limit) == ('cyclomatic', 10) else ''} then chr(10) || '- [{priority.upper()}] {title}: {words}' else '' end" for m, limit, _, priority, title, words, _ in scoring._GO_SUGGESTIONS]
    return " || ".join(parts)


@registry.add(
    "cx_13_description",
    view(
        """select id, 'Function: ' || f || chr(10) || 'Cyclomatic Complexity: ' || c || chr(10) || case when g0 is null then '' else 'Cognitive Complexity: ' || g0 || chr(10) end
  || 'Nesting Depth: ' || n || chr(10) || 'Parameters: ' || p || chr(10) || 'Lines of Code: ' || l || chr(10) || 'Estimated Refactoring Time: ' || d || ' minutes'
  || case when a = '' then '' else chr(10) || chr(10) || 'Refactoring Suggestions:' || a end as description from a""",
        h=_metrics_sql("function_name", "technical_debt_minutes"),
        m=f"({_SHORT}, coalesce(function_name, '<anonymous>') f, cognitive_complexity g0, coalesce(technical_debt_minutes, 0) d from h)",
        a=f"(select *, {_advice_sql()} a from m)",
    ),
)
def cx_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions with the suggestions for all five measures."""
    cyc, cog, nest, par, loc = _measures()
    name = F.coalesce("function_name", F.lit("<anonymous>"))
    advice = scoring.suggestions_go(cyc, cog, nest, par, loc)
    return _metrics(spark, sf_dir, "function_name", "technical_debt_minutes").select("id", scoring.finding_description(name, cyc, cog, nest, par, loc, F.col("technical_debt_minutes"), advice).alias("description"))


@registry.add("cx_14_line_count", "select coalesce(lang, '') as lang, count(*) as file_count, cast(sum(coalesce(length(text) - length(replace(text, chr(10), '')), 0)) as bigint) as loc from documents group by 1")
def cx_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("file_count"), F.sum(text.newline_count(F.col("text"))).cast("long").alias("loc"))


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_EXT_SQL = "lower(regexp_extract(regexp_replace(file_path, '^.*/', ''), '(\\.[^.]*)$', 1))"


@registry.add("flt_01_generated_path", f"select id, len(list_filter(string_split(lower(replace(file_path, '\\', '/')), '/'), lambda x: x in {_in(policy.GENERATED)})) > 0 as generated from technical_debt_issues where file_path is not null")
def flt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "technical_debt_issues").where("file_path is not null").select("id", policy.is_generated(F.col("file_path")).alias("generated"))


@registry.add("flt_02_asset", f"select distinct file_path, {_EXT_SQL} in {_in(policy.ASSETS)} as asset from technical_debt_issues where file_path is not null")
def flt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "technical_debt_issues").where("file_path is not null").select("file_path", policy.is_asset(F.col("file_path")).alias("asset")).distinct()


@registry.add("flt_03_size_limit", "select doc_id, octet_length(encode(text)) <= 10485760 as within_limit, octet_length(encode(text)) <= 1000 as within_1000 from documents where text is not null")
def flt_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of texts against the limit of files, and against a lower one."""
    size = F.octet_length("text")
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", policy.within_size(size).alias("within_limit"), policy.within_size(size, 1000).alias("within_1000"))


@registry.add(
    "flt_05_warnings",
    f"select file_path || ' skipped: file exceeds maximum size limit (10MB)' as message from (select distinct file_path from complexity_metrics where file_path is not null and end_line > 1000 and not {_EXT_SQL} in {_in(policy.ASSETS)})",
)
def flt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections that are worth a warning; files of more than 1000 lines stand for oversized ones."""
    files = read(spark, sf_dir, "complexity_metrics").where("file_path is not null and end_line > 1000").select(F.col("file_path").alias("path")).distinct()
    reason = F.when(policy.is_asset(F.col("path")), policy.ASSET_REASON).otherwise(policy.SIZE_REASON)
    return policy.warnings(files.withColumn("reason", reason))


@registry.add("flt_06_countable_code", f"select distinct file_path, {_EXT_SQL} in {_in(policy.COUNTABLE)} as countable from complexity_metrics where file_path is not null")
def flt_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "complexity_metrics").where("file_path is not null").select("file_path", policy.is_countable(F.col("file_path")).alias("countable")).distinct()


@registry.add(
    "flt_07_language_of_extension",
    "select distinct file_path, case " + " ".join(f"when {_EXT_SQL} = '{e}' then '{lang}'" for e, lang in policy.ANALYZABLE.items()) + f" end as language from complexity_metrics where file_path is not null and {_EXT_SQL} in {_in(tuple(policy.ANALYZABLE))}",
)
def flt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "complexity_metrics").where("file_path is not null").select("file_path").distinct()
    return policy.with_language(files, "file_path")


@registry.add("flt_08_named_functions", view(f"select id, function_name from h where function_name not in {_in(policy.ANONYMOUS)}", h=held_sql("complexity_metrics", "function_name")))
def flt_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.named_functions(held(spark, sf_dir, "complexity_metrics", "function_name"), "function_name")


@registry.add("flt_09_emitted", view("select id, severity from h where severity in ('high', 'critical')", h=held_sql("complexity_metrics", "severity")))
def flt_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.emitted(held(spark, sf_dir, "complexity_metrics", "severity"), "severity")


@registry.add("flt_10_skipped_directory", f"select d, count(*) as n, d in {_in(policy.SKIPPED)} as skipped from (select lower(unnest(string_split(file_path, '/'))) d from complexity_metrics) where d <> '' group by d")
def flt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "complexity_metrics").select(F.explode(F.split(F.lower("file_path"), "/")).alias("d")).where("d <> ''")
    return parts.groupBy("d").agg(F.count("*").alias("n")).withColumn("skipped", policy.is_skipped_directory(F.col("d")))


@registry.add(
    "sec_04_scanner_severity",
    "select id, case when upper(severity) in ('CRITICAL','HIGH','MEDIUM','LOW') then lower(severity) else 'info' end as severity, case upper(severity) when 'CRITICAL' then 8.0 when 'HIGH' then 4.0 when 'MEDIUM' then 2.0 else 1.0 end::double as hours from technical_debt_issues",
)
def sec_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("severity")
    return read(spark, sf_dir, "technical_debt_issues").select("id", scoring.scanner_severity(raw).alias("severity"), scoring.scanner_debt_hours(raw).alias("hours"))


_GATES = ("critical", "high", "medium", "low")


@registry.add("agg_08_severity_counts", view("select repository_id, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in _GATES) + " from h group by 1", h=held_sql("technical_debt_issues", "repository_id", "severity")))
def agg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir, "technical_debt_issues", "repository_id", "severity").groupBy("repository_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in _GATES])


@registry.add("agg_09_quality_gate", view(" union all ".join(f"select '{s}' as threshold, count(*) filter (r >= {scoring.GATE_RANK[s]}) > 0 as fails from g" for s in _GATES), h=held_sql("technical_debt_issues", "severity"), g="(select case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 end r from h)"))
def agg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = held(spark, sf_dir, "technical_debt_issues", "severity")
    out = [scoring.gate_fails(findings, "severity", s).select(F.lit(s).alias("threshold"), "fails") for s in _GATES]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@registry.add("agg_10_lenient_gate", view("select 'none' as threshold, false as fails union all select 'info', count(*) filter (severity in ('critical','high','medium','low','info')) > 0 from h union all select 'odd', count(*) filter (severity in ('critical','high')) > 0 from h", h=held_sql("technical_debt_issues", "severity")))
def agg_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = held(spark, sf_dir, "technical_debt_issues", "severity")
    out = [scoring.lenient_gate_fails(findings, "severity", s).select(F.lit(s).alias("threshold"), "fails") for s in ("none", "info", "odd")]
    return out[0].unionByName(out[1]).unionByName(out[2])


_ISSUE = ("file_path", "issue_type", "tool_rule_id", "code_snippet")


@registry.add(
    "fn_01_fingerprint",
    view("select id, sha256(coalesce(file_path, '') || '|' || coalesce(issue_type, '') || '|' || coalesce(tool_rule_id, '') || '|' || trim(regexp_replace(coalesce(code_snippet, ''), '\\s+', ' ', 'g'))) as fingerprint from h", h=held_sql("technical_debt_issues", *_ISSUE)),
)
def fn_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, kind, rule, snippet = (F.coalesce(c, F.lit("")) for c in _ISSUE)
    return held(spark, sf_dir, "technical_debt_issues", *_ISSUE).select("id", text.fingerprint(path, kind, rule, snippet).alias("fingerprint"))


@registry.add("fn_02_content_hash", "select doc_id, sha256(text) as content_hash from documents")
def fn_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@registry.add("fn_05_extension", f"select distinct file_path, {_EXT_SQL} as ext, regexp_replace(file_path, '^.*/', '') as name from complexity_metrics where file_path is not null")
def fn_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return read(spark, sf_dir, "complexity_metrics").where("file_path is not null").select("file_path", text.extension(path).alias("ext"), text.basename(path).alias("name")).distinct()


@registry.add("fn_06_severity_rank", f"select s as severity, case s when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 end as gate, case s when 'critical' then 1 when 'high' then 2 when 'medium' then 3 when 'low' then 4 else 5 end as position from (select distinct {folded_sql('severity')} s from technical_debt_issues)")
def fn_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    severities = read(spark, sf_dir, "technical_debt_issues").select(folded("severity").alias("severity")).distinct()
    return severities.select("severity", scoring.gate_rank(F.col("severity")).alias("gate"), scoring.sort_rank(F.col("severity")).alias("position"))


@registry.add(
    "fn_07_strings",
    "select id, upper(branch) as up, replace(branch, '/', '-') as dashed, string_split(branch, '/')[1] as head, starts_with(branch, 'feature') as is_feature, contains(branch, 'fix') as has_fix, cast(len(string_split(branch, '/')) as integer) as parts, cast(length(branch) - length(replace(branch, '-', '')) as integer) as dashes from analysis_runs where branch is not null",
)
def fn_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("branch")
    return read(spark, sf_dir, "analysis_runs").where("branch is not null").select(
        "id", F.upper(b).alias("up"), F.replace(b, F.lit("/"), F.lit("-")).alias("dashed"), F.element_at(F.split(b, "/"), 1).alias("head"), b.startswith("feature").alias("is_feature"),
        b.contains("fix").alias("has_fix"), F.size(F.split(b, "/")).alias("parts"), (F.length(b) - F.length(F.replace(b, F.lit("-"), F.lit("")))).alias("dashes"),
    )


@registry.add("fn_09_try_int", "select distinct tool_rule_id, try_cast(regexp_extract(tool_rule_id, '([0-9]+)$', 1) as integer) as number from technical_debt_issues where try_cast(regexp_extract(tool_rule_id, '([0-9]+)$', 1) as integer) is not null")
def fn_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = text.try_int(F.regexp_extract("tool_rule_id", "([0-9]+)$", 1))
    return read(spark, sf_dir, "technical_debt_issues").select("tool_rule_id", number.alias("number")).where("number is not null").distinct()


@registry.add("fn_10_arithmetic", _scored("select id, round(c / (c + g + 1)::double, 6) as ratio, c // 3 as thirds, greatest(c - 10, 0) as above from m"))
def fn_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, g = F.coalesce("cyclomatic_complexity", F.lit(0)), F.coalesce("cognitive_complexity", F.lit(0))
    return _metrics(spark, sf_dir).select("id", F.round(c / (c + g + 1), 6).alias("ratio"), F.floor(c / 3).cast("int").alias("thirds"), scoring.over(c, 10).alias("above"))


@registry.add("fn_11_dates", "select id, strftime(date_trunc('month', started_at), '%Y-%m-%d') as month_start, strftime(started_at, '%Y-%m-%dT%H:%M:%S') as iso, cast(floor((epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0) as bigint) as seconds, started_at >= timestamptz '2025-03-31 00:00:00+00' - interval 30 day as recent from analysis_runs")
def fn_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, now = F.col("started_at"), F.lit("2025-03-31 00:00:00").cast("timestamp")
    return read(spark, sf_dir, "analysis_runs").select(
        "id", F.date_format(F.date_trunc("month", s), "yyyy-MM-dd").alias("month_start"), F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.floor((F.unix_micros("completed_at") - F.unix_micros(s)) / 1_000_000).alias("seconds"), (s >= now - F.expr("interval 30 days")).alias("recent"),
    )


@registry.add("fn_12_json", "select id, case when json_valid(metadata) then json_extract_string(metadata, '$.engine') end as engine, cast(len(refactoring_suggestions) as integer) as suggestions from complexity_metrics where metadata is not null")
def fn_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values stay nested; JSON text that is broken gives NULL."""
    parsed = F.from_json("metadata", "engine string")
    return read(spark, sf_dir, "complexity_metrics").where("metadata is not null").select("id", parsed["engine"].alias("engine"), F.when(F.col("refactoring_suggestions").isNotNull(), F.size("refactoring_suggestions")).alias("suggestions"))


@registry.add("fn_14_arrays", "select id, cast(len(auth_providers) as integer) as n, list_contains(auth_providers, 'github') as has_github, array_to_string(list_sort(list_distinct(list_append(auth_providers, 'password'))), ',') as merged, array_to_string(auth_providers[1:1], ',') as head from users where auth_providers is not null")
def fn_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("auth_providers")
    return read(spark, sf_dir, "users").where("auth_providers is not null").select(
        "id", F.size(a).alias("n"), F.array_contains(a, "github").alias("has_github"), F.array_join(F.array_sort(F.array_distinct(F.array_append(a, F.lit("password")))), ",").alias("merged"), F.array_join(F.slice(a, 1, 1), ",").alias("head")
    )


@registry.add("fn_15_regex_default", "select id, coalesce(nullif(regexp_extract(tool_rule_id, '^GEN-([0-9]+)$', 1), ''), 'none') as rule_number from technical_debt_issues")
def fn_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "technical_debt_issues").select("id", text.captured(F.col("tool_rule_id"), "^GEN-([0-9]+)$", "none").alias("rule_number"))


@registry.add("fn_16_nulls", "select id, coalesce(organization, 'System') as organization, first_name is not distinct from last_name as same_name from users")
def fn_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "users").select("id", F.coalesce("organization", F.lit("System")).alias("organization"), F.col("first_name").eqNullSafe(F.col("last_name")).alias("same_name"))
