"""Paths, fingerprints and other text as expressions."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(path: Column, kind: Column, rule: Column, snippet: Column) -> Column:
    """The identity of a finding: SHA-256 of path, type, rule and snippet with white space folded; NULL as empty."""
    folded = F.trim(F.regexp_replace(F.coalesce(snippet, F.lit("")), r"(?U)\s+", " "))
    return F.sha2(F.concat_ws("|", path, kind, F.coalesce(rule, F.lit("")), folded), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, of the last dot of the name; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def newline_count(text: Column) -> Column:
    """Line feeds in a text; a last line without one isn't counted. NULL counts 0."""
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))


def cleaned(path: Column) -> Column:
    """A path without empty, ``.`` and ``x/..`` parts and without a last slash, by its text alone; ``.`` if nothing is left.

    A leading slash stays, and so do ``..`` parts that lead out of a relative path.
    """
    rooted = path.startswith("/")
    none = F.array().cast("array<string>")
    step = lambda kept, part: (
        F.when(part.isin("", "."), kept)
        .when((part == "..") & (F.size(kept) > 0) & F.coalesce(F.get(kept, F.size(kept) - 1) != "..", F.lit(False)), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .when((part == "..") & rooted, kept)
        .otherwise(F.concat(kept, F.array(part)))
    )
    joined = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    slow = F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))
    return F.when((path == "") | path.rlike(r"//|(^|/)\.\.?(/|$)|./$"), slow).otherwise(path)


def canonical_path(path: Column | str) -> Column:
    """Forward slashes, a leading slash, no empty, ``.`` or ``..`` parts."""
    return cleaned(F.concat(F.lit("/"), F.ltrim(slashed(F.col(path) if isinstance(path, str) else path), F.lit("/"))))


def relative_path(root: str, path: Column) -> Column:
    """A path below a root without it, ``.`` for the root itself; empty for one outside."""
    full, base = cleaned(path), posixpath.normpath(root)
    inside = base.rstrip("/") + "/"
    return F.when(full == base, ".").when(full.startswith(inside), F.substring(full, F.lit(len(inside) + 1), F.length(full))).otherwise(F.when(full.isNotNull(), ""))


def one_decimal(value: Column | str) -> Column:
    """``%.1f`` of the exact binary value, ties to even, as C does."""
    return F.call_function("format_number", F.col(value) if isinstance(value, str) else value, F.lit("0.0"))


def try_int(text: Column) -> Column:
    """An integer, or NULL for what is none."""
    return text.try_cast("int")


def captured(text: Column, pattern: str, default: str) -> Column:
    """The first group of a pattern, or a default where it isn't found or empty."""
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(default))
