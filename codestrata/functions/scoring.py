"""Complexity, severity, debt and suggestions as Catalyst expressions.

Every function takes columns and gives a column; NULL measures count as 0 unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTED = ("Branch", "Loop", "Closure")
SUGGESTION = "array<struct<type:string,priority:string,title:string,description:string,reason:string>>"


def _int(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("int")


def over(value: Column, limit: int) -> Column:
    """By how much a value exceeds a limit, else 0."""
    return F.greatest(value - limit, F.lit(0))


def reduce_nodes(functions: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Cyclomatic and cognitive complexity and nesting of each function from its flat nodes.

    ``nodes`` has the keys, node_type and depth (before entering the node). A function without
    nodes has 1, 0 and 0. Nodes are aggregated before the join, with map-side combine.
    """
    kind, depth = F.col("node_type"), F.coalesce(F.col("depth"), F.lit(0))
    weighted = kind.isin(*WEIGHTED)
    sums = nodes.groupBy(*[F.col(k).alias(f"n_{k}") for k in keys]).agg(
        F.count_if(weighted | (kind == "Operator")).alias("decisions"),
        F.sum(F.when(weighted, 1 + depth).when(kind == "Operator", 1).otherwise(0)).alias("effort"),
        F.max(depth).alias("deepest"),
    )
    match = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return functions.join(sums, condition, "left").select(
        *functions.columns,
        (1 + F.coalesce("decisions", F.lit(0))).cast("int").alias("cyclomatic"),
        F.coalesce("effort", F.lit(0)).cast("int").alias("cognitive"),
        F.coalesce("deepest", F.lit(0)).cast("int").alias("nesting"),
    )


def _graded(critical: Column, high: Column, medium: Column) -> Column:
    return F.when(critical, "critical").when(high, "high").when(medium, "medium").otherwise("low")


def severity(cyclomatic: Column, cognitive: Column, nesting: Column) -> Column:
    """The scale of all languages but Go."""
    cyc, cog, nest = _int(cyclomatic), _int(cognitive), _int(nesting)
    return _graded(*[(cyc > a) | (cog > b) | (nest > c) for a, b, c in ((20, 25, 5), (15, 20, 4), (10, 15, 3))])


def severity_go(cyclomatic: Column, cognitive: Column, nesting: Column, params: Column) -> Column:
    """The scale of Go, which also counts parameters."""
    cyc, cog, nest, par = _int(cyclomatic), _int(cognitive), _int(nesting), _int(params)
    return _graded((cyc > 20) | (nest > 7) | (cog > 25), (cyc > 10) | (nest > 5) | (par > 7) | (cog > 15), (cyc > 5) | (nest > 4) | (par > 5) | (cog > 7))


def debt_minutes(cyclomatic: Column, cognitive: Column, nesting: Column, params: Column, loc: Column) -> Column:
    """Minutes of refactoring by pieces of each measure; length counts in whole steps of 50 lines."""
    cyc, cog, nest, par, lines = (_int(c) for c in (cyclomatic, cognitive, nesting, params, loc))
    tiers = F.when(cyc > 20, (cyc - 20) * 15).when(cyc > 10, (cyc - 10) * 10).when(cyc > 5, (cyc - 5) * 5).otherwise(0)
    deep = F.when(nest > 5, (nest - 5) * 20).when(nest > 3, (nest - 3) * 10).otherwise(0)
    wide = F.when(par > 7, (par - 7) * 15).when(par > 5, (par - 5) * 10).otherwise(0)
    steps = lambda start: F.floor((lines - start) / 50)
    long = F.when(lines > 300, steps(300) * 30).when(lines > 150, steps(150) * 15).otherwise(0)
    return (tiers + over(cog, 15) * 8 + deep + wide + long).cast("int")


def pipeline_debt_hours(cyclomatic: Column, threshold: int = 10, minutes_per_point: int = 30) -> Column:
    """Hours that a finding is estimated at."""
    return over(_int(cyclomatic), threshold) * minutes_per_point / F.lit(60.0)


def pipeline_debt_minutes(cyclomatic: Column, threshold: int = 10, minutes_per_point: int = 30) -> Column:
    """The same in whole minutes, cut off."""
    return (pipeline_debt_hours(cyclomatic, threshold, minutes_per_point) * 60.0).cast("int")


# Minutes that are added for the language.
LANGUAGE_TAX = {"c": 3, "c++": 3, "rust": 2, "ruby": 0, "kotlin": 0, "swift": 0}


def language_debt(language: str, cyclomatic: Column, cognitive: Column, loc: Column) -> Column:
    """The estimate that the analyzers of single files give."""
    return (5 + over(_int(cyclomatic), 10) * 2 + over(_int(cognitive), 15) + F.floor(over(_int(loc), 30) / 5) + LANGUAGE_TAX[language]).cast("int")


# Measure, limit, type, priority, title, description and reason of suggestions for Go.
_GO_SUGGESTIONS = [
    ("cyclomatic", 20, "extract_method", "high", "Extract Method", "Break down this complex function into smaller, focused methods", "Cyclomatic complexity of %d exceeds critical threshold of 20"),
    ("cyclomatic", 10, "simplify_logic", "medium", "Simplify Control Flow", "Reduce the number of decision points and branches", "Cyclomatic complexity of %d exceeds recommended threshold of 10"),
    ("nesting", 5, "reduce_nesting", "high", "Reduce Nesting Depth", "Use early returns, guard clauses, or extract nested logic into separate functions", "Nesting depth of %d makes code difficult to understand"),
    ("params", 7, "introduce_parameter_object", "medium", "Introduce Parameter Object", "Group related parameters into a configuration object or struct", "Function has %d parameters, making it hard to use and test"),
    ("loc", 300, "split_function", "high", "Split Large Function", "Break this large function into smaller, cohesive functions with single responsibilities", "Function length of %d lines exceeds maintainability threshold"),
    ("cognitive", 15, "simplify_logic", "high", "Reduce Cognitive Complexity", "Simplify the mental model required to understand this code", "Cognitive complexity of %d makes code difficult to comprehend"),
]
# Titles and descriptions by language of the suggestions for cyclomatic > 15, nesting > 3,
# parameters > 4 (C and C++: 5), lines > 50 and cognitive > 20.
_SUGGESTIONS = {
    "c++": [
        ("Extract Functions", "Break down this function into smaller, focused functions. Consider using inline functions for performance-critical paths"),
        ("Reduce Nesting Depth", "Use early returns, guard clauses, or extract nested logic into helper functions"),
        ("Too Many Parameters", "Consider using a struct/class to group related parameters or use parameter objects"),
        ("Function Too Long", "Split this function into smaller functions. Consider separating algorithm from data structure manipulation"),
        ("Simplify Logic", "Simplify control flow, reduce pointer complexity, or use RAII patterns to improve readability"),
    ],
    "rust": [
        ("Extract Functions", "Break down this function into smaller, focused functions. Consider using private helper functions or modules"),
        ("Reduce Nesting Depth", "Use early returns with ? operator, if let, or match guards to reduce nesting"),
        ("Consider Builder Pattern or Struct", "Too many parameters. Consider using a builder pattern or passing a configuration struct"),
        ("Function Too Long", "Split this function into smaller functions. Consider extracting logic into separate modules or traits"),
        ("Simplify Logic", "Use Rust's Result and Option combinators (map, and_then, unwrap_or) to simplify control flow"),
    ],
    "ruby": [
        ("Extract Methods", "Break down this method into smaller, focused methods using Ruby's expressive syntax"),
        ("Reduce Nesting Depth", "Use Ruby's guard clauses, early returns, or extract nested logic into separate methods"),
        ("Introduce Parameter Object", "Consider using a hash or creating a parameter object to group related parameters"),
        ("Method Too Long", "Split this method into smaller methods. Consider using Ruby modules or service objects"),
        ("Simplify Logic", "Use Ruby idioms like safe navigation (&.), try, or early returns to simplify logic"),
    ],
    "kotlin": [
        ("Extract Functions", "Break down this function into smaller, focused functions. Consider using extension functions or sealed classes"),
        ("Reduce Nesting Depth", "Use Kotlin's safe call operators (?.), let, also, or early returns to reduce nesting"),
        ("Use Data Class or Builder Pattern", "Too many parameters. Consider using a data class with named parameters or default values"),
        ("Function Too Long", "Split this function into smaller functions. Consider using extension functions or separating concerns"),
        ("Simplify Logic", "Use Kotlin's scope functions (let, run, apply), when expressions, or sealed classes to simplify logic"),
    ],
    "swift": [
        ("Extract Methods", "Break down this function into smaller, focused methods. Consider using extension methods or protocols"),
        ("Reduce Nesting Depth", "Use guard statements, optional chaining (?.), or early returns to reduce nesting"),
        ("Use Struct or Builder Pattern", "Too many parameters. Consider using a struct with default values or a builder pattern"),
        ("Function Too Long", "Split this function into smaller methods. Consider extracting logic into extensions or separate types"),
        ("Simplify Logic", "Use Swift's Result type, optional chaining, guard statements, or functional methods (map, flatMap) to simplify logic"),
    ],
}
_SUGGESTIONS["c"] = _SUGGESTIONS["c++"]
_PRIORITIES = ("high", "high", "medium", "high", "medium")


def _listed(items: list[Column]) -> Column:
    return F.array_compact(F.array(*items)).cast(SUGGESTION)


def suggestions_go(cyclomatic: Column, cognitive: Column, nesting: Column, params: Column, loc: Column) -> Column:
    """What to refactor in a Go function, in a fixed order; of the two on control flow at most one."""
    measures = {"cyclomatic": _int(cyclomatic), "cognitive": _int(cognitive), "nesting": _int(nesting), "params": _int(params), "loc": _int(loc)}
    items = []
    for measure, limit, kind, priority, title, description, reason in _GO_SUGGESTIONS:
        value = measures[measure]
        applies = (value > limit) & (value <= 20) if (measure, limit) == ("cyclomatic", 10) else value > limit
        items.append(F.when(applies, F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.lit(title).alias("title"), F.lit(description).alias("description"), F.format_string(reason, value).alias("reason"))))
    return _listed(items)


def suggestions(language: str, cyclomatic: Column, cognitive: Column, nesting: Column, params: Column, loc: Column) -> Column:
    """What to refactor in a function of C, C++, Rust, Ruby, Kotlin or Swift; type and reason are NULL."""
    most = 5 if language in ("c", "c++") else 4
    applies = [_int(cyclomatic) > 15, _int(nesting) > 3, _int(params) > most, _int(loc) > 50, _int(cognitive) > 20]
    none = F.lit(None).cast("string")
    return _listed(
        [
            F.when(a, F.struct(none.alias("type"), F.lit(p).alias("priority"), F.lit(t).alias("title"), F.lit(d).alias("description"), none.alias("reason")))
            for a, p, (t, d) in zip(applies, _PRIORITIES, _SUGGESTIONS[language], strict=True)
        ]
    )


# The texts of messages and descriptions below.
def finding_message(name: Column, cyclomatic: Column, nesting: Column) -> Column:
    """One line on the worst measure of a function."""
    cyc, nest = _int(cyclomatic), _int(nesting)
    return (
        F.when(cyc > 20, F.format_string("Function '%s' has critical cyclomatic complexity of %d (threshold: 20)", name, cyc))
        .when(cyc > 10, F.format_string("Function '%s' has high cyclomatic complexity of %d (threshold: 10)", name, cyc))
        .when(nest > 5, F.format_string("Function '%s' has deep nesting depth of %d (threshold: 5)", name, nest))
        .otherwise(F.format_string("Function '%s' has complexity issues", name))
    )


def finding_description(name: Column, cyclomatic: Column, cognitive: Column, nesting: Column, params: Column, loc: Column, minutes: Column, suggested: Column) -> Column:
    """The measures of a function and what to refactor, line by line; an unknown cognitive value is left out."""
    line = lambda label, value: F.concat(F.lit(label), value.cast("string"))
    advice = F.transform(suggested, lambda s: F.concat(F.lit("- ["), F.upper(s["priority"]), F.lit("] "), s["title"], F.lit(": "), s["description"]))
    head = F.array_compact(
        F.array(
            line("Function: ", name),
            line("Cyclomatic Complexity: ", _int(cyclomatic)),
            F.when(cognitive.isNotNull(), line("Cognitive Complexity: ", cognitive)),
            line("Nesting Depth: ", _int(nesting)),
            line("Parameters: ", _int(params)),
            line("Lines of Code: ", _int(loc)),
            F.concat(F.lit("Estimated Refactoring Time: "), _int(minutes).cast("string"), F.lit(" minutes")),
        )
    )
    tail = F.when(F.size(suggested) > 0, F.concat(F.array(F.lit("\nRefactoring Suggestions:")), advice)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, tail), "\n")


def summary(metrics: DataFrame, cyclomatic: str, severity_column: str, minutes: str) -> DataFrame:
    """One row on all functions; without functions only the count is known."""
    cut = lambda c: F.when(F.count("*") > 0, c)
    return metrics.agg(
        F.count("*").alias("total_functions"),
        cut(F.avg(cyclomatic)).alias("average_cyclomatic"),
        cut(F.max(cyclomatic)).alias("max_cyclomatic"),
        cut(F.count_if(F.col(severity_column) == "critical")).alias("critical_count"),
        cut(F.count_if(F.col(severity_column) == "high")).alias("high_count"),
        cut(F.sum(F.col(minutes).cast("long")) / 60.0).alias("debt_hours"),
    )


# Ranks of severities, once for gates and once for sorting.
GATE_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SORT_RANK = {"critical": 1, "high": 2, "medium": 3, "low": 4}


def _ranked(value: Column, ranks: dict[str, int], otherwise: Column) -> Column:
    out = otherwise
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def gate_rank(value: Column) -> Column:
    """4 to 1 from critical to low; NULL for what is no severity."""
    return _ranked(F.lower(value), GATE_RANK, F.lit(None).cast("int"))


def sort_rank(value: Column) -> Column:
    """1 to 4 from critical to low, else 5."""
    return _ranked(value, SORT_RANK, F.lit(5))


def gate_fails(findings: DataFrame, severity_column: str, threshold: str) -> DataFrame:
    """Whether any finding is at least as severe as the threshold; unknown severities don't count."""
    if threshold.lower() not in GATE_RANK:
        raise ValueError(f"unknown severity {threshold!r}")
    return findings.agg(F.coalesce(F.bool_or(gate_rank(F.col(severity_column)) >= GATE_RANK[threshold.lower()]), F.lit(False)).alias("fails"))


def lenient_gate_fails(findings: DataFrame, severity_column: str, threshold: str) -> DataFrame:
    """The other gate: ``none`` never fails, ``info`` counts as 0, an unknown threshold as high."""
    ranks: dict[str, int] = {**GATE_RANK, "info": 0}
    least = ranks.get(threshold.lower(), GATE_RANK["high"])
    if threshold.lower() == "none":
        return findings.agg(F.lit(False).alias("fails"))
    rank = _ranked(F.lower(F.col(severity_column)), ranks, F.lit(None).cast("int"))
    return findings.agg(F.coalesce(F.bool_or(rank >= least), F.lit(False)).alias("fails"))


def scanner_severity(value: Column) -> Column:
    """The severity of a security scanner in our terms."""
    return F.when(F.upper(value).isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.lower(value)).otherwise("info")


def scanner_debt_hours(value: Column) -> Column:
    level = F.upper(value)
    return F.when(level == "CRITICAL", 8.0).when(level == "HIGH", 4.0).when(level == "MEDIUM", 2.0).otherwise(1.0)


