"""Source trees and report artifacts as DataFrames of files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.text import canonical_path
from codestrata.operators import policy
from codestrata.operators.coverage import KNOWN_PATHS, MAX_ARTIFACT_BYTES
from codestrata.operators.structure import MAX_METADATA_BYTES, METADATA

MIB = 1_048_576


def open_local(path: str) -> str:
    """The absolute path of a directory, or an error."""
    full = os.path.abspath(path)
    if not os.path.isdir(full):
        raise FileNotFoundError(f"{path} is not a directory")
    return full


def _uri(root: str) -> str:
    return root if "://" in root else "file://" + os.path.abspath(root)


def _below(root: str) -> Column:
    """A file's path below the root, with a leading slash."""
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    base = "/" + _uri(root).split("://", 1)[1].strip("/")
    return F.regexp_replace(F.substring(plain, F.lit(len(base) + 1), F.length(plain)), "^/*", "/")


def links(root: str) -> list[str]:
    """The symbolic links below a local directory, as paths below it; a directory that can't be read is an error."""

    def refuse(error: OSError) -> None:
        raise error

    found = []
    for folder, dirs, files in os.walk(root, onerror=refuse):
        found += [os.path.join(folder, n) for n in (*dirs, *files) if os.path.islink(os.path.join(folder, n))]
    return sorted("/" + os.path.relpath(p, root).replace(os.sep, "/") for p in found)


def tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below a root: path, length, content (bytes), without generated trees.

    The content column is read only where it is used. In a local tree symbolic links, and what lies behind
    them, are left out, and a directory that can't be read is an error.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_uri(root))
    files = rows.select(canonical_path(_below(root)).alias("path"), "length", "content")
    local = root.removeprefix("file://")
    if "://" not in local and (linked := links(os.path.abspath(local))):
        away = spark.createDataFrame([(p,) for p in linked], "link string")
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        behind = files.select("path", F.explode(above).alias("link")).join(away, "link", "left_semi").select(F.col("path").alias("_away"))
        files = files.join(behind, F.col("path") == F.col("_away"), "left_anti")
    return files.where(~policy.is_generated(F.col("path")))


def accepted(files: DataFrame) -> DataFrame:
    """Files that pass the file policy, with their text."""
    judged = policy.file_policy(files)
    return judged.where(F.col("reason").isNull()).select("path", "length", F.decode("content", "UTF-8").alias("content"))


def metadata(files: DataFrame) -> DataFrame:
    """Files for structure detection: path and the text of small ones that may tell something."""
    name = F.substring_index("path", "/", -1)
    telling = name.isin(*METADATA, "main.go", "build.rs", "build.zig.zon") | name.endswith(".java") | name.endswith(".csproj")
    text = F.when(telling & (F.col("length") <= MAX_METADATA_BYTES), F.decode("content", "UTF-8"))
    return files.select("path", text.alias("content"))


def coverage_candidates(files: DataFrame, roots: list[str]) -> DataFrame:
    """Artifacts at known places below each build root, those of acceptable size: artifact, name, root, content, build_root."""
    places = {f"{('/' + r.strip('/')) if r.strip('/') else ''}/{p}": (r.strip("/"), n) for n, (r, p) in enumerate((r, p) for r in roots for p in KNOWN_PATHS)}
    if not places:
        return files.sparkSession.createDataFrame([], "artifact string, name string, root string, content string, build_root string")
    found = files.where(F.col("path").isin(*places) & (F.col("length") <= MAX_ARTIFACT_BYTES))
    root_of = F.create_map(*[F.lit(x) for k, (r, _) in places.items() for x in (k, r)])
    return found.select(F.col("path").alias("artifact"), F.col("path").alias("name"), root_of[F.col("path")].alias("root"), F.decode("content", "UTF-8").alias("content"), root_of[F.col("path")].alias("build_root"))


def size_mib(files: DataFrame, *keys: str) -> DataFrame:
    """The size of a tree in MiB, or of each of several; a file of unknown length counts 0."""
    return files.groupBy(*keys).agg((F.coalesce(F.sum("length"), F.lit(0)) / float(MIB)).alias("size_mib"))
