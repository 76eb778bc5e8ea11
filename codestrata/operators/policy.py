"""Which files are read and which findings are emitted: scope, safety filter, extensions."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.functions.text import cleaned, extension, relative_path, slashed

# Directories, extensions, limits and reasons of the file policy.
GENERATED = (".git", "node_modules", "vendor", ".venv", "venv", "__pycache__", "dist", "build", "target", "bin")
SKIPPED = (*GENERATED, ".github", ".idea", ".vscode", "coverage", ".nyc_output")
ASSETS = (".ico", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".pdf")
COUNTABLE = (".go", ".js", ".ts", ".tsx", ".jsx", ".py", ".java", ".cs", ".c", ".cpp", ".h", ".rb", ".php", ".rs", ".kt", ".kts", ".swift", ".scala", ".r", ".m", ".mm", ".sh", ".bash", ".zsh")
ANALYZABLE = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cs": "csharp",
    ".c": "c_cpp", ".h": "c_cpp", ".cpp": "c_cpp", ".cc": "c_cpp", ".cxx": "c_cpp", ".c++": "c_cpp", ".hpp": "c_cpp", ".hxx": "c_cpp", ".h++": "c_cpp",
    ".php": "php", ".rb": "ruby", ".rs": "rust", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift",
}
ANONYMOUS = ("<anonymous>", "<lambda>", "<closure>", "<block>")
MAX_BYTES, MAX_LINES, LINE_BUFFER = 10 * 1024 * 1024, 100_000, 10_000
ASSET_REASON = "common binary or asset file"
BINARY_REASON = "binary file"
DIRECTORY_REASON = "directory"
SIZE_REASON = "file exceeds maximum size limit (10MB)"
LINES_REASON = "file exceeds maximum line count (100000)"
MINIFIED_REASON = "file contains severely minified or elongated lines"
SILENT = (ASSET_REASON, BINARY_REASON, DIRECTORY_REASON)


def is_generated(path: Column) -> Column:
    """Whether any component of a path, the last included, names a generated or vendored tree."""
    return F.arrays_overlap(F.split(F.lower(slashed(path)), "/"), F.array(*[F.lit(g) for g in GENERATED]))


def is_asset(path: Column) -> Column:
    return extension(path).isin(*ASSETS)


def within_size(size: Column, limit: int = MAX_BYTES) -> Column:
    return size <= limit


def is_countable(path: Column) -> Column:
    return extension(path).isin(*COUNTABLE)


def is_skipped_directory(name: Column) -> Column:
    return F.lower(name).isin(*SKIPPED)


def is_vendored(path: Column) -> Column:
    """The smaller set of trees that language statistics leave out."""
    return F.arrays_overlap(F.split(slashed(path), "/"), F.array(*[F.lit(d) for d in (".git", "node_modules", "vendor")]))


def with_language(files: DataFrame, path: str) -> DataFrame:
    """Files that an analyzer reads, with its language; the table of extensions is a fixed map of 23 entries."""
    pairs = F.create_map(*[F.lit(x) for pair in ANALYZABLE.items() for x in pair])
    return files.withColumn("language", pairs[extension(F.col(path))]).where(F.col("language").isNotNull())


def named_functions(metrics: DataFrame, name: str) -> DataFrame:
    """Without anonymous functions; an unnamed (NULL) one is left out as well."""
    return metrics.where(~F.col(name).isin(*ANONYMOUS))


def emitted(metrics: DataFrame, severity: str) -> DataFrame:
    return metrics.where(F.col(severity).isin("high", "critical"))


def content_reason(content: bytes | None) -> str | None:
    """Why a file's content is refused, by the first violation in line order; None if it is read."""
    if content is None:
        return None
    count = 0
    start = 0
    while start < len(content):
        end = content.find(b"\n", start)
        stop = len(content) if end < 0 else end + 1
        line = content[start:stop]
        if len(line) >= LINE_BUFFER:
            return BINARY_REASON if b"\0" in line[:LINE_BUFFER] else MINIFIED_REASON
        if b"\0" in line:
            return BINARY_REASON
        count += 1
        if count > MAX_LINES:
            return LINES_REASON
        start = stop
    return None


@F.pandas_udf(T.StringType())
def content_reasons(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in contents:
        yield batch.map(content_reason)


def file_policy(files: DataFrame) -> DataFrame:
    """``files`` (path, length, content) with the reason of refusal, NULL if a file is read.

    Cheap tests come first: only a file that is neither an asset nor too large is handed to the
    content test, which sees NULL for all others.
    """
    early = F.when(is_asset(F.col("path")), ASSET_REASON).when(~within_size(F.col("length")), SIZE_REASON)
    staged = files.withColumn("_early", early)
    late = content_reasons(F.when(F.col("_early").isNull(), F.col("content")))
    return staged.withColumn("reason", F.coalesce("_early", late)).drop("_early")


def warnings(judged: DataFrame) -> DataFrame:
    """The refusals that are worth telling (path, reason), in the order of their messages."""
    told = judged.where(F.col("reason").isNotNull() & ~F.col("reason").isin(*SILENT))
    return told.select(F.concat("path", F.lit(" skipped: "), "reason").alias("message")).orderBy("message")


def in_scope(files: DataFrame, targets: DataFrame, path: str = "path") -> DataFrame:
    """Only target files; an empty set of targets stays empty."""
    return files.join(targets.select(F.col("path").alias("_target")).distinct(), F.col(path) == F.col("_target"), "left_semi")


MODES = ("full", "incremental", "no_changes")
NO_TARGETS = "an incremental scope needs at least one file"


def validate_scope(mode: str, files: list[str] | None = None) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown scope {mode!r}")
    if mode == "incremental" and not files:
        raise ValueError(NO_TARGETS)


def scope_error(mode: Column, targets: Column) -> Column:
    """What is wrong with requests of a mode and a number of target files, NULL if nothing."""
    return F.when(~F.coalesce(mode.isin(*MODES), F.lit(False)), F.lit("unknown scope")).when((mode == "incremental") & (F.coalesce(targets, F.lit(0)) == 0), F.lit(NO_TARGETS))


def selected(files: DataFrame, mode: str, targets: DataFrame, path: str = "path") -> DataFrame:
    """The files that a scope lets through: all, the targets (path), or none."""
    if mode not in MODES:
        raise ValueError(f"unknown scope {mode!r}")
    return files if mode == "full" else in_scope(files, targets, path) if mode == "incremental" else files.limit(0)


def target(root: str, name: Column) -> Column:
    """A target as it is named: its path below the root, and what is wrong with it (a struct of path and error)."""
    given = F.btrim(name)
    foreign = given.rlike(r"^[A-Za-z]:[\\/]|^\\\\")
    plain = F.when(given.startswith("/"), relative_path(root, given)).otherwise(cleaned(slashed(given)))
    outside = plain.isin("", ".", "..") | plain.startswith("../")
    error = F.when(F.coalesce(given, F.lit("")) == "", F.lit("path is empty")).when(foreign, F.lit("an absolute path of another system")).when(outside, F.lit("outside the root"))
    return F.struct(F.when(error.isNull(), F.concat(F.lit("/"), cleaned(slashed(plain)))).alias("path"), error.alias("error"))


def normalize_targets(root: str, files: list[str]) -> list[str]:
    """Target paths below the root, with forward slashes and a leading slash, distinct and sorted."""
    found = set()
    base = posixpath.normpath(root)
    for name in files:
        path = name.strip()
        if not path:
            raise ValueError("a target path is empty")
        if re.match(r"^[A-Za-z]:[\\/]|^\\\\", path):
            raise ValueError(f"{path}: an absolute path of another system")
        if path.startswith("/"):
            path = posixpath.relpath(posixpath.normpath(path), base)
        path = posixpath.normpath(path.replace("\\", "/"))
        if path in (".", "..") or path.startswith("../"):
            raise ValueError(f"{name}: outside the root")
        found.add("/" + path)
    return sorted(found)
