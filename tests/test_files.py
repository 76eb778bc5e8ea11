"""File policy, scope, trees, structure, runner, versions and whole scans."""

from __future__ import annotations

from threading import Event

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codestrata import scan
from codestrata.functions.text import canonical_path, cleaned, relative_path
from codestrata.operators import policy, structure
from codestrata.runner import Cancelled, Result, run
from codestrata.session import materialize, release, shared_dir, spread
from codestrata.sources import trees
from codestrata.sources.gitlog import changed_files, churn, commits
from codestrata.sources.versions import VersionedTable


def write(root, **files):
    for name, text in files.items():
        put(root, name, text)


def put(root, name, text):
    path = root / name.lstrip("/")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


# --- policy and scope ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("content", "reason"),
    [(b"ok\n", None), (b"", None), (b"a\0b", policy.BINARY_REASON), (b"x" * 9_999, None), (b"x" * 10_000, policy.MINIFIED_REASON), (b"x" * 9_998 + b"\n", None), (b"ok\n" + b"y" * 10_001, policy.MINIFIED_REASON), (b"\n" * 100_000, None), (b"\n" * 100_001, policy.LINES_REASON), (b"a\0" + b"x" * 20_000, policy.BINARY_REASON), (None, None)],
)
def test_content_policy(content, reason):
    assert policy.content_reason(content) == reason


def test_file_policy(spark):
    data = [("/main.go", 5, b"ok"), ("/logo.PNG", 5, b"ok"), ("/big.txt", policy.MAX_BYTES + 1, b"\0"), ("/edge.txt", policy.MAX_BYTES, b"a"), ("/b.bin", 3, b"a\0b"), ("/min.js", 1, b"x" * 10_001)]
    judged = policy.file_policy(spark.createDataFrame(data, "path string, length long, content binary"))
    assert rows(judged, "path", "reason") == sorted([("/main.go", None), ("/logo.PNG", policy.ASSET_REASON), ("/big.txt", policy.SIZE_REASON), ("/edge.txt", None), ("/b.bin", policy.BINARY_REASON), ("/min.js", policy.MINIFIED_REASON)], key=repr)
    assert [r[0] for r in policy.warnings(judged).collect()] == [f"/big.txt skipped: {policy.SIZE_REASON}", f"/min.js skipped: {policy.MINIFIED_REASON}"]


def test_generated_paths(spark):
    paths = {f"/a/{d}/x.js": True for d in policy.GENERATED} | {"frontend\\node_modules\\p\\i.js": True, "/src/binning/m.go": False, "/x/BUILD": True, "/vendors/a.go": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["g"] for r in df.select("path", policy.is_generated(F.col("path")).alias("g")).collect()} == paths


def test_scope():
    policy.validate_scope("full")
    policy.validate_scope("incremental", ["a"])
    for bad in (("odd", None), ("incremental", []), ("incremental", None)):
        with pytest.raises(ValueError):
            policy.validate_scope(*bad)
    assert policy.normalize_targets("/r", [" b/../a.go ", "a.go", "/r/x/y.go", "s\\t.go"]) == ["/a.go", "/s/t.go", "/x/y.go"]
    for bad in ("", " ", "..", "../x", "/other/x", "C:\\x", "."):
        with pytest.raises(ValueError):
            policy.normalize_targets("/r", [bad])


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("a\\b", "/a/../b/./c", "//x//y", "../..", None, "", "/r/a/b", "/r", "/rx/a", "r/../..", "a/..", "x/", "..x/y")], "p string")
    assert [r[0] for r in df.select(canonical_path("p")).collect()] == ["/a/b", "/b/c", "/x/y", "/", None, "/", "/r/a/b", "/r", "/rx/a", "/", "/", "/x", "/..x/y"]
    assert [r[0] for r in df.select(cleaned(F.col("p"))).collect()] == ["a\\b", "/b/c", "/x/y", "../..", None, ".", "/r/a/b", "/r", "/rx/a", "..", ".", "x", "..x/y"]
    assert [r[0] for r in df.select(relative_path("/r", F.col("p"))).collect()][6:9] == ["a/b", ".", ""]


def test_files_delivered_twice(spark):
    data = [("r", "/package.json", "{}"), ("r", "/package.json", "{}"), ("r", "/.nvmrc", "20"), ("r", "/.nvmrc", "18")]
    assert rows(structure.build_roots(spark.createDataFrame(data, FILES)), "tool", "image") == [("npm", "node:18-alpine")]



def test_links_are_left_out(spark, tmp_path):
    (tmp_path / "r" / "a").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "secret.py").write_text("x")
    (tmp_path / "r" / "a" / "b.py").write_text("x")
    (tmp_path / "r" / "link.py").symlink_to(tmp_path / "r" / "a" / "b.py")
    (tmp_path / "r" / "away").symlink_to(tmp_path / "out")
    (tmp_path / "r" / "gone").symlink_to(tmp_path / "nothing")
    assert trees.links(str(tmp_path / "r")) == ["/away", "/gone", "/link.py"]
    assert rows(trees.tree(spark, str(tmp_path / "r")), "path") == [("/a/b.py",)]
    with pytest.raises(OSError):
        trees.links(str(tmp_path / "missing"))


def test_structure_warnings(spark):
    data = [("a", "/package.json", "{broken"), ("b", "/package.json", "[]"), ("c", "/x/package.json", '{"dependencies": []}'), ("d", "/package.json", None), ("e", "/package.json", '{"devDependencies": {"jest": "1"}}'), ("f", "/go.mod", ""), ("f", "/package.json", "{broken"), ("g", "/pyproject.toml", None), ("h", "/Cargo.toml", ""), ("h", "/build.rs", None), ("h", "/build.rs", None)]
    files = spark.createDataFrame(data, FILES)
    roots = structure.build_roots(files)
    told = [(r["repo"], r["message"].split(": ")[0]) for r in structure.structure_warnings(files, roots).collect()]
    assert told == [("a", "inspect /package.json"), ("b", "inspect /package.json"), ("c", "inspect /x/package.json"), ("d", "inspect /package.json"), ("g", "inspect /pyproject.toml"), ("h", "inspect native dependency file /build.rs")]
    assert {r["repo"]: (r["tool"], r["test_runner"]) for r in roots.where("manifest = 'package.json'").collect()} == {"a": ("npm", ""), "b": ("npm", ""), "c": ("npm", ""), "d": ("npm", ""), "e": ("npm", "jest")}


def test_git_text(spark):
    lines = spark.createDataFrame([("a.go ",), ("",), ("  ",), ("a.go",), ("b.go",)], "value string")
    assert rows(churn(lines)) == [("a.go", 2), ("b.go", 1)] and changed_files(lines).count() == 3
    made = commits(spark.createDataFrame([("h|a|m|fix x|y",), ("h|a",)], "value string"))
    assert rows(made) == [("h", "a", "m", "fix x", None), (None, None, None, None, "fewer than four parts")]


# --- structure ----------------------------------------------------------------------------------

# What each manifest and each version file has to give.
MANIFESTS = [
    ("go.mod", "module x\n\ngo 1.25\n", None, "Go", "go", "go test"), ("package.json", "{}", None, "TypeScript/JS", "npm", ""), ("Cargo.toml", "[package]", None, "Rust", "cargo", "cargo test"), ("pom.xml", "<project/>", None, "Java", "maven", "junit"),
    ("build.gradle", "", None, "Java", "gradle", "junit"), ("build.gradle.kts", "", None, "Java", "gradle", "junit"), ("pyproject.toml", "[tool.poetry]\n", None, "Python", "poetry", "pytest"), ("setup.py", "", None, "Python", "pip", "pytest"),
    ("setup.cfg", "", None, "Python", "pip", "pytest"), ("requirements.txt", "", None, "Python", "pip", "pytest"), ("Gemfile", "", None, "Ruby", "bundler", ""), ("composer.json", "{}", None, "PHP", "composer", ""),
    ("Package.swift", "// swift-tools-version: 6.0\n", None, "Swift", "swift-pm", "swift test"), ("CMakeLists.txt", "", None, "C/C++", "cmake", ""), ("Makefile", "", "main.cpp", "C/C++", "make", ""), ("Example.csproj", "<Project/>", None, ".NET", "dotnet", "dotnet test"),
    ("package.json", '{"devDependencies": {"mocha": "1", "vitest": "2"}}', "yarn.lock", "TypeScript/JS", "yarn", "vitest"), ("package.json", "{broken", "yarn.lock", "TypeScript/JS", "npm", ""), ("package.json", '{"dependencies": {"jest": {"a": 1}}}', "pnpm-lock.yaml", "TypeScript/JS", "pnpm", "jest"),
]
FILES = "repo string, path string, content string"


def test_manifests(spark):
    data = [(f"r{n}", f"/{m}", text) for n, (m, text, *_) in enumerate(MANIFESTS)] + [(f"r{n}", f"/{extra}", "") for n, (_, _, extra, *_) in enumerate(MANIFESTS) if extra]
    found = {r["repo"]: (r["language"], r["tool"], r["test_runner"]) for r in structure.build_roots(spark.createDataFrame(data, FILES)).collect()}
    assert found == {f"r{n}": (language, tool, runner) for n, (_, _, _, language, tool, runner) in enumerate(MANIFESTS)}


IMAGES = [
    ("Cargo.toml", {"rust-toolchain": "nightly\n"}, "rust:nightly-slim"), ("Cargo.toml", {"rust-toolchain.toml": '[toolchain]\nchannel = "1.85.0"\n'}, "rust:1.85-slim"), ("Cargo.toml", {}, "rust:slim"), ("package.json", {".nvmrc": "v20.11.0\n"}, "node:20-alpine"),
    ("package.json", {".nvmrc": "lts/iron"}, "node:lts-alpine"), ("go.mod", {"go.mod": "module t\n\ngo 1.25\n"}, "golang:1.25-alpine"), ("setup.py", {".python-version": "3.13.1\n"}, "python:3.13-slim"), ("pom.xml", {".java-version": "23\n"}, "maven:3-eclipse-temurin-23"),
    ("pom.xml", {"pom.xml": "<java.version>17</java.version>"}, "maven:3-eclipse-temurin-17"), ("build.gradle", {".java-version": "21\n"}, "eclipse-temurin:21-jdk-alpine"), ("Gemfile", {".ruby-version": "3.4.1\n"}, "ruby:3.4-slim"), ("Gemfile", {"Gemfile": "source 'x'\nruby '3.2.1'\n"}, "ruby:3.2-slim"),
    ("composer.json", {"composer.json": '{"require":{"php":"^8.4"}}'}, "php:8.4-cli-alpine"), ("Package.swift", {"Package.swift": "// swift-tools-version: 6.1\n"}, "swift:6.1"), ("A.sln", {"global.json": '{"sdk":{"version":"10.0.100"}}'}, "mcr.microsoft.com/dotnet/sdk:10.0"),
    ("A.csproj", {"A.csproj": "<TargetFramework>net8.0</TargetFramework>"}, "mcr.microsoft.com/dotnet/sdk:8.0"), ("CMakeLists.txt", {}, ""),
]


def test_images(spark):
    data = [(f"r{n}", f"/{name}", text) for n, (manifest, files, _) in enumerate(IMAGES) for name, text in ({manifest: ""} | files).items()]
    found = {r["repo"]: r["image"] for r in structure.build_roots(spark.createDataFrame(data, FILES)).collect()}
    assert found == {f"r{n}": image for n, (_, _, image) in enumerate(IMAGES)}


def test_monorepo(spark):
    data = [
        ("m", "/backend/go.mod", "go 1.24"), ("m", "/backend/main.go", "package main\nfunc main() {}"), ("m", "/backend/pkg/a.go", None), ("m", "/backend/checks/a_test.go", None), ("m", "/backend/checks/b.go", None), ("m", "/frontend/package.json", '{"devDependencies":{"vitest":"1"}}'),
        ("m", "/frontend/pnpm-lock.yaml", ""), ("m", "/frontend/index.ts", ""), ("m", "/frontend/deep/index.ts", ""), ("m", "/docs/x.md", ""), ("m", "/a/b/go.mod", ""), ("m", "/vendor/go.mod", ""), ("m", "/frontend/tests/t.ts", ""), ("m", "/backend/vendor/main.go", "func main()"),
        ("m", "/.github/workflows/ci.yml", ""), ("m", "/tsconfig.json", ""),
    ]
    files = spark.createDataFrame(data, FILES)
    roots = structure.build_roots(files)
    assert rows(roots, "place", "dir", "language", "tool", "test_runner") == [(1, "/backend", "Go", "go", "go test"), (2, "/frontend", "TypeScript/JS", "pnpm", "vitest")]
    assert rows(structure.doc_dirs(files), "found") == [("/docs",)]
    assert rows(structure.source_roots(files, roots), "found") == [("/backend/pkg",), ("/frontend",)]
    assert rows(structure.test_dirs(files, roots), "found") == [("/backend/checks",), ("/frontend/tests",)]
    assert rows(structure.entry_points(files, roots), "path") == [("/backend/main.go",), ("/frontend/index.ts",)]
    one = structure.structure_metrics(roots).first()
    assert one["is_monorepo"] and [r["dir"] for r in one["build_roots"]] == ["backend", "frontend"]
    assert rows(structure.config_files(files, "path"), "path", "category") == [("/.github/workflows/ci.yml", "ci_cd"), ("/a/b/go.mod", "dependencies"), ("/backend/go.mod", "dependencies"), ("/frontend/package.json", "dependencies"), ("/frontend/pnpm-lock.yaml", "dependencies"), ("/tsconfig.json", "typescript")]
    many = spark.createDataFrame([("r", "/setup.py", "")] + [("r", f"/p{n:02d}/__main__.py", "") for n in range(15)], FILES)
    assert structure.entry_points(many, structure.build_roots(many)).count() == 10


def test_native_dependencies(spark):
    data = [("r", "/Cargo.toml", ""), ("r", "/build.rs", 'bindgen::x(); cmake::build("x"); pkg_config; prost_build'), ("r", "/n/build.zig", None), ("r", "/n/build.zig.zon", '.minimum_zig_version = "0.14.0",'), ("r", "/target/x.asm", None), ("s", "/Cargo.toml", "")]
    files = spark.createDataFrame(data, FILES)
    found = {r["repo"]: [(d["name"], d["version"]) for d in r["native_deps"]] for r in structure.native_dependencies(files, structure.build_roots(files)).collect()}
    assert found == {"r": [("zig", "0.14.0"), ("clang", ""), ("cmake", ""), ("libclang-dev", ""), ("pkg-config", ""), ("protobuf-compiler", "")], "s": []}


# --- trees, scans and the runner ----------------------------------------------------------------

NESTED = "def deep(x):\n" + "".join("    " * (i + 1) + f"if x > {i}:\n" for i in range(10)) + "    " * 11 + "pass\n"


@pytest.fixture
def repository(tmp_path):
    put(tmp_path, "src/deep.py", NESTED)
    put(tmp_path, "src/ok.go", "package p\n\nfunc Ok() int {\n\treturn 1\n}\n")
    put(tmp_path, "node_modules/x/y.js", "function f() {}")
    put(tmp_path, "min.js", "x" * 10_001)
    put(tmp_path, "logo.png", b"\0")
    put(tmp_path, "go.mod", "module x\n\ngo 1.25\n")
    put(tmp_path, "coverage.out", "mode: set\nx/y/z/src/ok.go:3.1,5.2 1 1\n")
    return tmp_path


def test_tree(spark, repository):
    files = trees.tree(spark, str(repository))
    assert [r[0] for r in rows(files, "path")] == ["/coverage.out", "/go.mod", "/logo.png", "/min.js", "/src/deep.py", "/src/ok.go"]
    assert trees.size_mib(files).first()[0] == pytest.approx(sum(f.stat().st_size for f in repository.rglob("*") if f.is_file() and "node_modules" not in str(f)) / 1048576)
    assert rows(trees.coverage_candidates(files, [""]), "name", "build_root") == [("/coverage.out", "")]
    assert trees.coverage_candidates(files, []).count() == 0
    with pytest.raises(FileNotFoundError):
        trees.open_local(str(repository / "none"))


def test_scan(spark, repository):
    report = scan.scan(spark, str(repository))
    (finding,) = report.findings.collect()
    assert (finding["path"], finding["severity"]) == ("/src/deep.py", "critical")
    metrics = {(a, n): v for a, n, v in report.metrics}
    assert metrics["complexity", "total_functions"] == 2 and metrics["complexity", "max_cyclomatic"] == 11 and metrics["lines", "file_count"] == 2
    assert report.warnings == [f"/min.js skipped: {policy.MINIFIED_REASON}"] and report.failures == []
    assert scan.scan(spark, str(repository), "incremental", ["src/ok.go"]).findings.count() == 0
    assert scan.scan(spark, "/does/not/exist", "no_changes").findings.count() == 0
    structured = scan.detect_structure(spark, str(repository))
    assert rows(structured["build_roots"], "dir", "tool", "image") == [("", "go", "golang:1.25-alpine")]


def test_metadata_of_all_documents(spark, tmp_path):
    from codestrata.plans.file_queries import registry

    spark.createDataFrame([("a/go.mod", "m"), ("main.go", "p"), ("b/A.java", ""), ("c/x.py", "x"), ("d/pom.xml", None)], "file_path string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(registry.queries["src_16_metadata"](spark, str(tmp_path)), "path", "has_content") == [("a/go.mod", True), ("b/A.java", True), ("c/x.py", False), ("d/pom.xml", False), ("main.go", True)]


def test_every_warning_is_kept(spark, tmp_path):
    for i in range(1001):
        put(tmp_path, f"/r{i:04}.js", b"x" * 10_000)
    put(tmp_path, "/bad.py", "def f(:\n")
    report = scan.scan(spark, str(tmp_path))
    told = [tuple(r) for r in report.warning_rows.collect()]
    assert told[:1001] == [("scanner", f"/r{i:04}.js skipped: {policy.MINIFIED_REASON}") for i in range(1001)]
    assert len(told) == 1002 and told[-1][0] == "complexity" and told[-1][1].startswith("/bad.py could not be parsed: ")
    assert report.warnings == [m for _, m in told]
    broken = spark.range(1001).select(F.format_string("/b%04d.py", "id").alias("path"), F.lit("def f(:\n").alias("content"))
    report = run(spark, broken, [scan.Complexity()])
    assert [m.split(" ")[0] for m in report.warnings] == [f"/b{i:04}.py" for i in range(1001)] and report.failures == []


class Fake:
    def __init__(self, name, result=None, error=None):
        self.id, self.name, self.result, self.error = name, name, result, error

    def analyze(self, spark, files):
        if self.error:
            raise self.error
        return self.result


def test_runner(spark):
    finding = spark.createDataFrame([("z", "/b", None, "m"), ("z", "/a", 5, "m"), ("z", "/a", None, "n")], "analyzer_id string, path string, line int, message string")
    seen = []
    analyzers = [Fake("z", Result(finding, {"b": 1, "a": 2}, ["w"])), Fake("bad", error=RuntimeError("boom")), Fake("none"), Fake(""), Fake("z", Result()), Fake("a", Result(metrics={"q": 1}, warnings=["w"]))]
    report = run(spark, finding, analyzers, progress=seen.append)
    assert [(r["path"], r["line"]) for r in report.findings.collect()] == [("/a", None), ("/a", 5), ("/b", None)]
    assert report.metrics == [("a", "q", 1), ("z", "a", 2), ("z", "b", 1)] and report.warnings == ["w"]
    assert report.failures == [("bad", "boom"), ("none", "analyzer gave no result"), ("#3", "analyzer has no id"), ("z", "analyzer id occurs twice")]
    assert [p.index for p in seen] == list(range(1, len(seen) + 1)) and {p.stage for p in seen} == {"started", "finished", "failed"}

    def broken(_):
        raise ValueError("no")

    assert run(spark, finding, [Fake("a", Result())], progress=broken).warnings == ["progress handler failed: no"]
    stop = Event()
    stop.set()
    with pytest.raises(Cancelled):
        run(spark, finding, [Fake("a", Result())], cancelled=stop)


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.range(3))
    old = table.current()
    table.write(table.read().where("id > 0"))
    assert rows(table.read()) == [(1,), (2,)] and table.current() != old


def test_materialized_tables_are_released(spark):
    path = materialize(spark.range(3), "test")
    assert spark.read.parquet(path).count() == 3 and path.startswith(shared_dir(spark))
    assert release(spark) >= 1 and release(spark) == 0
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_spread(spark):
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 64)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(many) is many
    assert spread(few).count() == 100
