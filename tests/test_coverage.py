"""Coverage reports, security reports and what follows from them."""

from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codestrata.operators import coverage, security

GO = "mode: atomic\nexample.com/p/pkg/a.go:1.1,2.2 1 1\nexample.com/p/pkg/a.go:3.1,4.2 1 0\nbad line\nx.go:a.1,2.2 1 1\n"
LCOV = "DA:9,9\nSF:src/a.ts\nDA:1,1\nDA:2,0\nDA:x,1\nBRF:2\nBRH:1\nend_of_record\nDA:5,5\n"
COBERTURA = '<coverage><packages><package><classes><class filename="src/a.py" branch-rate="0.5"><lines><line number="1" hits="1"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>'
JACOCO = '<report><package name="com.x"><sourcefile name="A.java"><line nr="1" mi="0" ci="1"/><line nr="2" mi="1" ci="0"/><counter type="BRANCH" missed="1" covered="1"/><counter type="METHOD" missed="0" covered="0"/></sourcefile></package></report>'
CLOVER = '<coverage><project><file name="src/a.php"><line num="1" type="stmt" count="1"/><line num="2" type="stmt" count="0"/><line num="3" type="cond" count="0"/></file></project></coverage>'
SIMPLECOV = '{"RSpec":{"coverage":{"src/a.rb":[1,0,null]}}}'
CASES = {
    "go": ("coverage.out", GO, "pkg/a.go", -1.0, [3]), "lcov": ("coverage/lcov.info", LCOV, "src/a.ts", 50.0, [2]), "cobertura": ("coverage.xml", COBERTURA, "/src/a.py", 50.0, [2]),
    "jacoco": ("jacoco.xml", JACOCO, "/com/x/A.java", 50.0, [2]), "clover": ("clover.xml", CLOVER, "/src/a.php", -1.0, [2]), "simplecov": (".resultset.json", SIMPLECOV, "/src/a.rb", -1.0, [2]),
}
ARTIFACT = "artifact string, name string, root string, content string"


def artifacts(spark, *items):
    return spark.createDataFrame(list(items), ARTIFACT)


def test_all_formats(spark):
    df = artifacts(spark, *[(kind, name, None, content) for kind, (name, content, *_) in CASES.items()], ("n", "notes.txt", None, "x"), ("e", "lcov.info", None, None), ("b", "coverage.xml", None, "<broken"))
    found = {r["format"]: r for r in coverage.parse_artifacts(df).collect()}
    assert set(found) == set(CASES)
    for kind, (_, _, path, branch, uncovered) in CASES.items():
        r = found[kind]
        assert (r["path"], r["lines_total"], r["lines_covered"], r["line_coverage"], r["branch_coverage"], r["uncovered_lines"]) == (path, 2, 1, 50.0, branch, uncovered), kind
    total = coverage.overall(coverage.parse_artifacts(df), []).first()
    assert (total["line_pct"], total["branch_pct"]) == (50.0, 50.0)


def test_go_counts_statements_not_lines(spark):
    r = coverage.parse_artifacts(artifacts(spark, ("a", "coverage.out", None, "mode: set\nexample.com/project/pkg/a.go:10.1,100.1 1 0\n"))).first()
    assert (r["lines_total"], r["uncovered_lines"]) == (1, [10])


@pytest.mark.parametrize(("path", "kept"), [("example.com/o/r/internal/x/a.go", "internal/x/a.go"), ("example.com/o/r/a/b.go", "a/b.go"), ("a/b.go", "a/b.go"), ("h/o/r/src/cmd/m.go", "cmd/m.go"), ("h/pkg/o/pkg/z.go", "pkg/z.go")])
def test_go_paths(spark, path, kept):
    assert spark.createDataFrame([(path,)], "p string").select(coverage.package_path(F.col("p"))).first()[0] == kept


def test_lcov_records(spark):
    text = "SF:a\nDA:1,1\nSF:b\nDA:1,0\nBRF:1\nBRF:4\nBRH:1\nend_of_record\nSF:a\nDA:7,0\n"
    made = coverage.parse_artifacts(artifacts(spark, ("x", "lcov.info", None, text)))
    assert rows(made, "path", "lines_total", "branch_coverage", "uncovered_lines") == [("a", 1, -1.0, [7]), ("a", 1, -1.0, []), ("b", 1, 25.0, [1])]


def test_cobertura_merges_classes(spark):
    text = '<coverage><packages><package><classes><class filename="src\\a.py"><lines><line number="1" hits="0"/></lines></class><class filename="src/a.py"><methods><method><lines><line number="1" hits="1"/></lines></method></methods><lines><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>'
    r = coverage.parse_artifacts(artifacts(spark, ("a", "coverage.xml", None, text))).collect()
    assert [(x["path"], x["lines_total"], x["lines_covered"], x["uncovered_lines"], x["branch_coverage"]) for x in r] == [("/src/a.py", 2, 1, [2], 0.0)]


def test_simplecov_merges_suites(spark):
    text = json.dumps({"A": {"coverage": {"/r/a.rb": [1, 0, None, 0]}}, "B": {"coverage": {"/r/a.rb": {"lines": [0, 0, None, 3]}, "/r/b.rb": ["x", 2.9, None]}}})
    made = coverage.parse_artifacts(artifacts(spark, ("a", "coverage/.resultset.json", None, text)))
    assert rows(made, "path", "lines_total", "lines_covered", "uncovered_lines") == [("/r/a.rb", 3, 2, [2]), ("/r/b.rb", 2, 1, [1])]


def test_roots_and_merging(spark):
    roots = spark.createDataFrame([("frontend",), ("backend",)], "dir string")
    df = artifacts(spark, ("1", "lcov.info", "frontend", "SF:src/app.ts\nDA:1,1\n"), ("2", "lcov.info", "./backend/", "SF:src/server.ts\nDA:1,1\n"), ("3", "lcov.info", "../out", "SF:x\n"), ("4", "lcov.info", None, "SF:x\n"), ("5", "frontend/lcov.info", None, "SF:y\n"))
    placed = coverage.with_root(df, roots)
    assert rows(placed, "artifact", "build_root", "error") == [("1", "frontend", None), ("2", "backend", None), ("3", None, "root is outside the repository"), ("4", None, "build root is ambiguous"), ("5", "frontend", None)]
    reports = coverage.parse_artifacts(placed.where("error is null")).join(placed.select("artifact", "build_root"), "artifact")
    files = spark.createDataFrame([("/frontend/src/app.ts",), ("/backend/src/server.ts",)], "path string")
    assert rows(coverage.located(reports, files), "path") == [("backend/src/server.ts",), ("frontend/src/app.ts",), ("y",)]
    assert rows(coverage.with_root(df.where("artifact = '4'"), roots.where("dir = 'backend'")), "build_root") == [("backend",)]
    twice = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (1, "b", 1)], "report_no int, path string, lines_total int")
    assert rows(coverage.merged_reports(twice, [])) == [("a", 7), ("b", 1)]


def test_paths_are_resolved_before_they_are_judged(spark):
    files = spark.createDataFrame([("/src/y.go",), ("/app/z.go",), ("/z.go",)], "path string")
    cases = [
        ("", "src/x/../y.go", "src/y.go"), ("", "/repo/src/y.go", "src/y.go"), ("app", "/repo/src/y.go", "src/y.go"), ("app", "/other/z.go", "other/z.go"), ("app", "z.go", "app/z.go"),
        ("app", "../../z.go", "z.go"), ("", "a/../../b/q.go", "q.go"), ("", " ./src//y.go ", "src/y.go"), ("app", "nowhere.go", "nowhere.go"), ("", "/repository/q.go", "repository/q.go"), ("", None, None),
    ]
    df = spark.createDataFrame([(i, root, path) for i, (root, path, _) in enumerate(cases)], "id int, build_root string, path string")
    assert [r["path"] for r in coverage.located(df, files, "/repo").orderBy("id").collect()] == [w for *_, w in cases]


@pytest.mark.parametrize(("root", "found", "error"), [(".app", ".app", None), ("..x", "..x", None), ("a\\b\\..", "a", None), (" ./a/ ", "a", None), (".", "", None), ("/a", None, "root is not relative to the repository"), ("C:\\a", None, "root is not relative to the repository"), ("a/../..", None, "root is outside the repository"), ("  ", None, "root is empty"), ("b", None, "root was not detected")])
def test_named_roots(spark, root, found, error):
    roots = spark.createDataFrame([("",), ("a",), (".app",), ("..x",)], "dir string")
    made = coverage.with_root(artifacts(spark, ("1", "lcov.info", root, "")), roots).first()
    assert (made["build_root"], made["error"]) == (found, error)


def test_roots_by_name(spark):
    roots = spark.createDataFrame([("a/b",), ("a",), ("",)], "dir string")
    made = coverage.with_root(artifacts(spark, ("1", "x/../a/b/lcov.info", None, ""), ("2", "lcov.info", "", ""), ("3", None, None, "")), roots)
    assert rows(made, "artifact", "build_root") == [("1", "a"), ("2", None), ("3", None)]
    assert rows(coverage.with_root(artifacts(spark, ("2", "lcov.info", "", "")), roots.where("false")), "build_root") == [("",)]


def test_lone_reports_keep_what_they_repeat(spark):
    df = spark.createDataFrame([("r", 1, "a", 5, 1), ("r", 1, "a", 5, 1), ("r", 1, "b", 2, 2), ("s", 1, "a", 9, 2), ("s", 2, "a", 1, 1), ("s", 2, "a", 0, 3), ("s", 1, "c", 4, 4), (None, None, "z", 1, 1)], "repo string, report_no int, path string, lines_total int, position int")
    assert rows(coverage.merged_reports(df, ["repo"])) == sorted([("r", "a", 5), ("r", "a", 5), ("r", "b", 2), ("s", "a", 0), ("s", "c", 4), (None, "z", 1)], key=repr)
    assert rows(coverage.merged_reports(df.where("repo = 'r'").drop("repo"), [])) == [("a", 5), ("a", 5), ("b", 2)]
    assert rows(coverage.merged_reports(df.where("false"), ["repo"])) == []


def test_rejected(spark):
    df = artifacts(spark, ("1", "lcov.info", None, "x" * (coverage.MAX_ARTIFACT_BYTES + 1)), ("2", "odd.txt", None, ""), ("3", "lcov.info", None, ""))
    assert [r["message"].split(": ")[1].split()[0] for r in coverage.warnings(coverage.rejected_artifacts(df)).collect()] == ["exceeds", "has"]


def test_findings_and_metrics(spark):
    data = [("a", "/pkg/a.go", 4, 0, 0.0, -1.0, -1.0, list(range(1, 26))), ("a", "b.go", 16, 1, 6.25, 50.0, 12.5, [2]), ("a", "c.go", 2, 1, 50.0, -1.0, -1.0, []), ("a", "d.go", 0, 0, 0.0, -1.0, -1.0, [])]
    files = spark.createDataFrame(data, "artifact string, path string, lines_total int, lines_covered int, line_coverage double, branch_coverage double, function_coverage double, uncovered_lines array<int>")
    found = {r["path"]: r for r in coverage.coverage_findings(files, [], F.lit("go")).collect()}
    assert set(found) == {"/pkg/a.go", "/b.go"}
    a, b = found["/pkg/a.go"], found["/b.go"]
    assert (a["rule_id"], a["severity"], a["message"], a["debt_hours"]) == ("zero-coverage", "medium", "File has 0% test coverage (4 executable lines)", 0.08)
    assert b["message"] == "File has low test coverage: 6.2% (1/16 lines covered)"
    assert b["description"] == "File: b.go\nLine Coverage: 6.2% (1/16 lines)\nBranch Coverage: 50.0%\nFunction Coverage: 12.5%\nUncovered Lines: [2]\nCoverage Format: go"
    assert "(first 20): [1 2 3" in a["description"] and " 20]" in a["description"] and " 21" not in a["description"]
    m = coverage.coverage_metrics(files, []).first()
    assert (m["coverage_files_total"], m["coverage_files_zero"], m["coverage_files_low"], m["coverage_branch_percentage"]) == (4, 1, 1, 50.0)


REPORT = {"Results": [
    {"Target": "go.mod", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "Title": "bad", "Severity": "HIGH", "FixedVersion": "2", "Description": "d", "PrimaryURL": "u"}]},
    {"Target": "./other/x.env", "Secrets": [{"RuleID": "key", "Category": "AWS", "Title": "Key", "StartLine": 3}]},
]}


def test_security(spark):
    df = security.parse_reports(spark.createDataFrame([(json.dumps(REPORT),), (None,), ("{}",)], "t string"), "t")
    everything = security.security_findings(df)
    assert everything.count() == 2
    one = security.security_findings(df, spark.createDataFrame([("/go.mod",)], "path string")).collect()
    assert [(r["file_path"], r["message"], r["severity"], r["debt_hours"], r["description"]) for r in one] == [("go.mod", "CVE-1: bad (p)", "high", 4.0, "d\n\nFixed Version: 2\nMore info: u")]
    secret = everything.where("category = 'secret'").first()
    assert (secret["severity"], secret["line_number"], secret["debt_hours"], secret["message"]) == ("critical", 3, 4.0, "Hardcoded Secret: Key")
    counts = security.security_metrics(everything).first()
    assert (counts["security_issues_count"], counts["vulnerabilities_count"], counts["secrets_count"], counts["security_critical_count"], counts["security_high_count"]) == (2, 1, 1, 1, 1)
    empty, metrics, told = security.unavailable(spark, "no scanner")
    assert empty.count() == 0 and metrics["security_issues_count"] == 0 and told == ["no scanner"]
    assert security.security_findings(df, spark.createDataFrame([], "path string")).count() == 0
