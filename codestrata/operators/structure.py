"""What a repository's file tree says about its builds, sources, tests, entry points and runtime images.

All operators take ``files``: repo, path (below the repository's root, with a leading slash) and
content (text of small metadata files, NULL for others). Many repositories are handled at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.policy import SKIPPED
from codestrata.tables import blank_trim

MAX_METADATA_BYTES = 1024 * 1024
MAX_ENTRY_POINTS = 10

# Manifests in order of priority with language, tool and test runner.
MANIFESTS = [
    ("go.mod", "Go", "go", "go test"),
    ("package.json", "TypeScript/JS", "npm", ""),
    ("Cargo.toml", "Rust", "cargo", "cargo test"),
    ("pom.xml", "Java", "maven", "junit"),
    ("build.gradle", "Java", "gradle", "junit"),
    ("build.gradle.kts", "Java", "gradle", "junit"),
    ("pyproject.toml", "Python", "pip", "pytest"),
    ("setup.py", "Python", "pip", "pytest"),
    ("setup.cfg", "Python", "pip", "pytest"),
    ("requirements.txt", "Python", "pip", "pytest"),
    ("Gemfile", "Ruby", "bundler", ""),
    ("composer.json", "PHP", "composer", ""),
    ("Package.swift", "Swift", "swift-pm", "swift test"),
    ("CMakeLists.txt", "C/C++", "cmake", ""),
]
# Files that tell a version, directories by purpose, configuration files by category and kind.
METADATA = (
    "package.json", "pyproject.toml", "rust-toolchain.toml", "rust-toolchain", ".node-version", ".nvmrc", ".python-version", "go.mod", ".java-version",
    "pom.xml", ".ruby-version", "Gemfile", ".php-version", "composer.json", ".swift-version", "Package.swift", "global.json",
)
CPP_SOURCES = (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx")
DOC_DIRS = ("docs", "doc", "documentation", "wiki", "pages", ".github/wiki")
SOURCE_DIRS = ("src", "lib", "pkg", "internal", "cmd", "app", "core", "source", "main")
JAVA_SOURCE_DIRS = ("src/main/java", "src/main/kotlin")
TEST_DIRS = ("tests", "__tests__", "test", "spec", "testdata", "e2e", "integration")
CONFIG_FILES = {
    "package.json": ("dependencies", "npm"),
    "package-lock.json": ("dependencies", "npm"),
    "yarn.lock": ("dependencies", "yarn"),
    "pnpm-lock.yaml": ("dependencies", "pnpm"),
    "requirements.txt": ("dependencies", "pip"),
    "Pipfile": ("dependencies", "pipenv"),
    "poetry.lock": ("dependencies", "poetry"),
    "setup.py": ("dependencies", "python"),
    "go.mod": ("dependencies", "go"),
    "go.sum": ("dependencies", "go"),
    "Gemfile": ("dependencies", "ruby"),
    "Gemfile.lock": ("dependencies", "ruby"),
    "Cargo.toml": ("dependencies", "rust"),
    "Cargo.lock": ("dependencies", "rust"),
    "composer.json": ("dependencies", "php"),
    "composer.lock": ("dependencies", "php"),
    "Makefile": ("build", "make"),
    "CMakeLists.txt": ("build", "cmake"),
    "build.gradle": ("build", "gradle"),
    "build.gradle.kts": ("build", "gradle"),
    "pom.xml": ("build", "maven"),
    "webpack.config.js": ("build", "webpack"),
    "vite.config.js": ("build", "vite"),
    "vite.config.ts": ("build", "vite"),
    "rollup.config.js": ("build", "rollup"),
    "Dockerfile": ("containerization", "docker"),
    "docker-compose.yml": ("containerization", "docker-compose"),
    "docker-compose.yaml": ("containerization", "docker-compose"),
    ".dockerignore": ("containerization", "docker"),
    ".env": ("environment", "dotenv"),
    ".env.example": ("environment", "dotenv"),
    ".env.local": ("environment", "dotenv"),
    "config.yml": ("environment", "yaml"),
    "config.yaml": ("environment", "yaml"),
    "appsettings.json": ("environment", "json"),
    "tsconfig.json": ("typescript", "typescript"),
    "tsconfig.build.json": ("typescript", "typescript"),
    "jsconfig.json": ("typescript", "javascript"),
    ".eslintrc": ("linting", "eslint"),
    ".eslintrc.js": ("linting", "eslint"),
    ".eslintrc.json": ("linting", "eslint"),
    ".prettierrc": ("linting", "prettier"),
    ".prettierrc.json": ("linting", "prettier"),
    ".editorconfig": ("linting", "editorconfig"),
    "jest.config.js": ("testing", "jest"),
    "vitest.config.js": ("testing", "vitest"),
    "pytest.ini": ("testing", "pytest"),
    "phpunit.xml": ("testing", "phpunit"),
}


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _dir(path: Column) -> Column:
    """The directory of a path, empty for the root."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(_name(path)) - 1)


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def _pick(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _not_skipped(parts: Column) -> Column:
    return ~F.arrays_overlap(F.transform(parts, lambda p: F.lower(p)), F.array(*[F.lit(s) for s in SKIPPED]))


def is_manifest(text: Column) -> Column:
    """Whether a package manifest can be read: a JSON object whose dependencies, if any, are objects."""
    parts = [F.get_json_object(text, f"$.{name}") for name in ("dependencies", "devDependencies")]
    objects = [part.isNull() | F.ltrim(part).startswith("{") for part in parts]
    return F.coalesce(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{") & objects[0] & objects[1], F.lit(False))


def structure_warnings(files: DataFrame, roots: DataFrame) -> DataFrame:
    """What could not be read while build roots were detected: repo and message, each once, in order.

    A package manifest that is no such JSON counts as one of npm without a test runner, and one that is too large, or no text, likewise; both are told. So are a Python
    project file and native build files of Rust roots without a content.
    """
    asked = roots.where(F.col("manifest").isin("package.json", "pyproject.toml")).select(F.col("repo").alias("_repo"), F.concat("dir", F.lit("/"), "manifest").alias("_path"))
    own = files.join(asked, (F.col("repo") == F.col("_repo")) & (F.col("path") == F.col("_path")), "left_semi")
    size = F.lit(f"it is no text of at most {MAX_METADATA_BYTES} bytes")
    broken = F.when(F.col("content").isNull(), size).when((_name(F.col("path")) == "package.json") & ~is_manifest(F.col("content")), F.lit("it is no valid manifest"))
    told = own.select("repo", F.concat(F.lit("inspect "), "path", F.lit(": "), broken).alias("message"))
    native = _below(files, roots.where("tool = 'cargo'")).where(_name(F.col("path")).isin("build.rs", "build.zig.zon") & F.col("content").isNull())
    return told.unionByName(native.select("repo", F.concat(F.lit("inspect native dependency file "), "path", F.lit(": "), size).alias("message"))).where("message is not null").distinct().orderBy("repo", "message")


def build_roots(files: DataFrame) -> DataFrame:
    """The root and its immediate subdirectories that hold a manifest, one row each.

    Of several manifests the first by priority counts, then a Makefile beside C or C++ sources, then a
    .NET project. Result: repo, dir, language, tool, manifest, test_runner, image, place (by depth and name).
    """
    name, folder = _name(F.col("path")), _dir(F.col("path"))
    near = files.withColumn("name", name).withColumn("dir", folder).where((F.size(F.split("dir", "/")) <= 2) & _not_skipped(F.split("dir", "/")))
    rank = F.create_map(*[F.lit(x) for i, m in enumerate(MANIFESTS) for x in (m[0], i)])[F.col("name")]
    project = _suffix(F.col("name")).isin(".sln", ".csproj")
    has = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    telling = F.array_sort(F.collect_set(F.when(F.col("name").isin(*METADATA) & F.col("content").isNotNull(), F.struct("name", "content"))))
    once = F.filter(telling, lambda x, i: (i == 0) | (x["name"] != F.get(telling, i - 1)["name"]))  # a file may be delivered twice
    dirs = near.groupBy("repo", "dir").agg(
        F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("name").alias("name")))).alias("first"),
        F.min(F.when(project, F.col("name"))).alias("project"),
        has(F.col("name") == "Makefile").alias("makefile"),
        has(_suffix(F.col("name")).isin(*CPP_SOURCES)).alias("cpp"),
        has(F.col("name") == "yarn.lock").alias("yarn"),
        has(F.col("name") == "pnpm-lock.yaml").alias("pnpm"),
        F.map_from_entries(once).alias("meta"),
        F.min(F.when(_suffix(F.col("name")) == ".csproj", F.struct("name", "content"))).alias("csproj"),
    )
    manifest = F.coalesce(F.col("first.name"), F.when(F.col("makefile") & F.col("cpp"), F.lit("Makefile")), F.col("project"))
    known = F.col("first").isNotNull()
    made = F.col("makefile") & F.col("cpp")
    column = lambda i, make, net: F.when(known, _pick(F.col("first.name"), {m[0]: m[i] for m in MANIFESTS})).when(made, make).otherwise(net)
    package = F.from_json(F.col("meta")["package.json"], "dependencies map<string,string>, devDependencies map<string,string>")
    used = F.concat(F.coalesce(F.map_keys(package["dependencies"]), F.array().cast("array<string>")), F.coalesce(F.map_keys(package["devDependencies"]), F.array().cast("array<string>")))
    runner = F.coalesce(*[F.when(F.array_contains(used, r), F.lit(r)) for r in ("jest", "vitest", "mocha", "jasmine")], F.lit(""))
    readable = is_manifest(F.col("meta")["package.json"])
    tool = (
        F.when((F.col("first.name") == "package.json") & readable & F.col("yarn"), "yarn")
        .when((F.col("first.name") == "package.json") & readable & F.col("pnpm"), "pnpm")
        .when((F.col("first.name") == "pyproject.toml") & F.col("meta")["pyproject.toml"].contains("[tool.poetry]"), "poetry")
        .otherwise(column(2, "make", "dotnet"))
    )
    roots = dirs.where(manifest.isNotNull()).select(
        "repo", "dir", column(1, "C/C++", ".NET").alias("language"), tool.alias("tool"), manifest.alias("manifest"),
        F.when(F.col("first.name") == "package.json", runner).otherwise(column(3, "", "dotnet test")).alias("test_runner"), "meta", "csproj",
    )
    order = Window.partitionBy("repo").orderBy(F.size(F.split("dir", "/")), "dir")
    return roots.withColumn("image", runtime_image(F.col("tool"), F.col("meta"), F.col("csproj.content"))).withColumn("place", F.row_number().over(order)).drop("meta", "csproj")


def _found(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that a text has, else NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def runtime_image(tool: Column, meta: Column, csproj: Column) -> Column:
    """The image that runs a build, from version files of its directory (a map by name), else a default."""
    of = lambda name: blank_trim(meta[name])
    image = lambda prefix, version, suffix, default: F.concat(F.lit(prefix), F.coalesce(version, F.lit(default)), F.lit(suffix))
    channel = F.coalesce(_found(meta["rust-toolchain.toml"], r'channel\s*=\s*"([^"]+)"'), F.nullif(of("rust-toolchain"), F.lit("")))
    numbered = _found(channel, r"^(\d+\.\d+)")
    rust = F.when(channel.isin("nightly", "beta"), F.concat(F.lit("rust:"), channel, F.lit("-slim"))).when(numbered.isNotNull(), F.concat(F.lit("rust:"), numbered, F.lit("-slim"))).otherwise("rust:slim")
    node_major = _found(F.coalesce(of(".node-version"), of(".nvmrc")), r"^v?(\d+)")
    java = F.coalesce(_found(of(".java-version"), r"^(\d+)"), _found(meta["pom.xml"], r"<java\.version>(\d+)", r"<maven\.compiler\.source>(\d+)"), F.lit("21"))
    ruby = F.coalesce(_found(of(".ruby-version"), r"^(\d+\.\d+)"), _found(meta["Gemfile"], r"""(?m)^ruby\s+['"](\d+\.\d+)"""))
    php = F.coalesce(_found(of(".php-version"), r"^(\d+\.\d+)"), _found(F.from_json(meta["composer.json"], "require map<string,string>")["require"]["php"], r"(\d+\.\d+)"))
    swift = F.coalesce(_found(of(".swift-version"), r"^(\d+\.\d+)"), _found(meta["Package.swift"], r"swift-tools-version:\s*(\d+\.\d+)"))
    net = F.coalesce(_found(F.get_json_object(meta["global.json"], "$.sdk.version"), r"^(\d+)"), _found(csproj, r"<TargetFramework>net(\d+)"))
    return (
        F.when(tool == "cargo", rust)
        .when(tool.isin("npm", "yarn", "pnpm"), image("node:", node_major, "-alpine", "lts"))
        .when(tool == "go", image("golang:", _found(meta["go.mod"], r"(?m)^go\s+(\d+\.\d+)"), "-alpine", "1.24"))
        .when(tool.isin("pip", "poetry"), image("python:", _found(of(".python-version"), r"^(\d+\.\d+)"), "-slim", "3.12"))
        .when(tool == "maven", F.concat(F.lit("maven:3-eclipse-temurin-"), java))
        .when(tool == "gradle", F.concat(F.lit("eclipse-temurin:"), java, F.lit("-jdk-alpine")))
        .when(tool == "bundler", image("ruby:", ruby, "-slim", "3.3"))
        .when(tool == "composer", image("php:", php, "-cli-alpine", "8.3"))
        .when(tool == "swift-pm", image("swift:", swift, "", "6.0"))
        .when(tool == "dotnet", image("mcr.microsoft.com/dotnet/sdk:", net, ".0", "9"))
        .otherwise("")
    )


def directories(files: DataFrame) -> DataFrame:
    """All directories that hold a file at any depth, the root (empty) left out: repo, dir."""
    parts = F.split(_dir(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.where(F.size(parts) >= 2).select("repo", F.explode(above).alias("dir")).distinct()


def _among(candidates: DataFrame, dirs: DataFrame) -> DataFrame:
    return candidates.join(dirs.select(F.col("repo").alias("_repo"), F.col("dir").alias("_dir")), (F.col("repo") == F.col("_repo")) & (F.col("found") == F.col("_dir")), "left_semi")


def _names(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def doc_dirs(files: DataFrame) -> DataFrame:
    """Documentation directories at the root: repo, found."""
    repos = files.select("repo").distinct()
    return _among(repos.select("repo", F.explode(F.transform(_names(DOC_DIRS), lambda n: F.concat(F.lit("/"), n))).alias("found")), directories(files))


def source_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Source directories of each build root, the root itself if it has none: repo, dir, found."""
    names = F.when(F.col("language").isin("Java", "Kotlin"), _names(SOURCE_DIRS + JAVA_SOURCE_DIRS)).otherwise(_names(SOURCE_DIRS))
    there = _among(roots.select("repo", "dir", F.explode(F.transform(names, lambda n: F.concat(F.col("dir"), F.lit("/"), n))).alias("found")), directories(files))
    bare = roots.select("repo", "dir").join(there.select("repo", "dir").distinct(), ["repo", "dir"], "left_anti").withColumn("found", F.col("dir"))
    return there.unionByName(bare)


def test_directories(files: DataFrame, path: str = "path", suffix: str = "_test.go", keys: tuple[str, ...] = ()) -> DataFrame:
    """Directories of which more than 30 % of the Go files are tests: keys, dir, n_go, n_test."""
    go = files.where(F.col(path).endswith(".go"))
    counts = go.groupBy(*keys, _dir(F.col(path)).alias("dir")).agg(F.count("*").alias("n_go"), F.count_if(F.col(path).endswith(suffix)).alias("n_test"))
    return counts.where(F.col("n_test") / F.col("n_go") > 0.3)


def test_dirs(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Test directories of each build root, for Go also those that are full of tests: repo, dir, found."""
    named = _among(roots.select("repo", "dir", F.explode(F.transform(_names(TEST_DIRS), lambda n: F.concat(F.col("dir"), F.lit("/"), n))).alias("found")), directories(files))
    full = test_directories(files, keys=("repo",)).select(F.col("repo").alias("_repo"), F.col("dir").alias("found"), _dir(F.col("dir")).alias("_parent"), F.array(_name(F.col("dir"))).alias("_own"))
    go = roots.where("language = 'Go'").select("repo", "dir").join(full, (F.col("repo") == F.col("_repo")) & (F.col("dir") == F.col("_parent")) & (F.col("found") != F.col("dir")) & _not_skipped(F.col("_own")))
    return named.unionByName(go.select("repo", "dir", "found")).distinct()


def _below(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files with each build root above them, without those in skipped directories: files' columns, dir, relative."""
    top = F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2))
    spread = files.withColumn("root", F.explode(F.array_distinct(F.array(F.lit(""), F.when(F.col("path").rlike("^/[^/]+/"), top).otherwise("")))))
    joined = spread.join(roots.select(F.col("repo").alias("_repo"), "dir", "language", "tool"), (F.col("repo") == F.col("_repo")) & (F.col("root") == F.col("dir")))
    relative = F.expr("substring(path, length(dir) + 2)")
    return joined.withColumn("relative", relative).where(_not_skipped(F.slice(F.split("relative", "/"), F.lit(1), F.size(F.split("relative", "/")) - 1)))


def entry_points(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The first ten entry points of each build root in the order of a walk: repo, dir, path."""
    rows = _below(files, roots).withColumn("name", _name(F.col("path")))
    text, relative, name = F.coalesce("content", F.lit("")), F.col("relative"), F.col("name")
    rules = {
        "Go": (name == "main.go") & text.contains("func main()"),
        "Python": name == "__main__.py",
        "TypeScript/JS": relative.isin("index.ts", "index.js", "main.ts", "main.js"),
        "Rust": relative == "src/main.rs",
        "Java": name.endswith(".java") & text.contains("public static void main("),
    }
    is_entry = reduce(lambda a, b: a | b, [(F.col("language") == language) & rule for language, rule in rules.items()])
    walk = Window.partitionBy("repo", "dir").orderBy(F.translate("path", "/", "\u0001"))
    return rows.where(is_entry).withColumn("n", F.row_number().over(walk)).where(F.col("n") <= MAX_ENTRY_POINTS).select("repo", "dir", "path")


def native_dependencies(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Native tools that Rust builds need: repo, dir and a list of names and versions, zig first."""
    rows = _below(files, roots.where("tool = 'cargo'")).withColumn("name", _name(F.col("path"))).withColumn("ext", _suffix(_name(F.col("path"))))
    name, ext = F.col("name"), F.col("ext")
    script = F.when(name == "build.rs", F.coalesce("content", F.lit(""))).otherwise("")
    mentions = lambda *words: reduce(lambda a, b: a | b, [script.contains(w) for w in words])
    needs = {
        "clang": mentions("bindgen"), "cmake": (name == "CMakeLists.txt") | (ext == ".cmake") | mentions('"cmake"', "cmake::build"), "libclang-dev": mentions("bindgen"),
        "nasm": ext.isin(".asm", ".nasm") | mentions('"nasm"', '"yasm"'), "pkg-config": mentions("pkg_config", "pkg-config"), "protobuf-compiler": (ext == ".proto") | mentions('"protoc"', "prost_build"),
    }
    version = F.when(name == "build.zig.zon", _found(F.col("content"), r'\.minimum_zig_version\s*=\s*"([^"]+)"'))
    flags = rows.groupBy("repo", "dir").agg(
        F.coalesce(F.bool_or((name == "build.zig") | (ext == ".zig")), F.lit(False)).alias("zig"),
        F.min(F.when(version.isNotNull(), F.struct(F.translate("path", "/", "\u0001").alias("at"), version.alias("v"))))["v"].alias("zig_version"),
        *[F.coalesce(F.bool_or(test), F.lit(False)).alias(f"need_{i}") for i, test in enumerate(needs.values())],
    )
    dependency = lambda n, v: F.struct(n.alias("name"), v.alias("version"))
    listed = [F.when(F.col("zig"), dependency(F.lit("zig"), F.coalesce("zig_version", F.lit("0.13.0"))))]
    listed += [F.when(F.col(f"need_{i}"), dependency(F.lit(n), F.lit(""))) for i, n in enumerate(needs)]
    return flags.select("repo", "dir", F.array_compact(F.array(*listed)).alias("native_deps"))


def config_files(files: DataFrame, path: str) -> DataFrame:
    """Files that configure something, by name, with category and kind; a workflow may have two rows."""
    name, folder = _name(F.col(path)), _dir(F.col(path))
    table = F.create_map(*[x for n, (c, k) in CONFIG_FILES.items() for x in (F.lit(n), F.struct(F.lit(c).alias("category"), F.lit(k).alias("kind")))])
    workflow = F.when(folder.isin(".github/workflows", "/.github/workflows") & name.endswith(".yml"), F.struct(F.lit("ci_cd").alias("category"), F.lit("github-actions").alias("kind")))
    visible = ~F.arrays_overlap(F.split(folder, "/"), F.array(*[F.lit(d) for d in (".git", "node_modules", "vendor")]))
    found = files.where(visible).withColumn("_hit", F.explode(F.array_compact(F.array(table[name], workflow))))
    return found.select(*files.columns, "_hit.category", "_hit.kind")


def structure_metrics(roots: DataFrame) -> DataFrame:
    """One row per repository: its build roots relative to it, and whether there are several."""
    item = F.struct("place", F.expr("substring(dir, 2)").alias("dir"), "language", "tool", "manifest", "test_runner", "image")
    return roots.groupBy("repo").agg(F.array_sort(F.collect_list(item)).alias("build_roots"), (F.count("*") > 1).alias("is_monorepo"))
