"""Source files to functions and nodes on executors, and a registry that further languages can join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from codestrata.operators.policy import ANALYZABLE
from codestrata.parse import braces, python_code, ruby
from codestrata.parse.braces import Function

Parser = Callable[[str], list[Function]]
PARSERS: dict[str, Parser] = {"python": python_code.functions, "ruby": ruby.functions}


def _by_braces(language: str) -> Parser:
    return lambda text: braces.functions(language, text)


PARSERS |= {language: _by_braces(language) for language in braces.RULES}

COLUMNS = "path string, language string, function_ix int, function_name string, start_line int, end_line int, parameter_count int, lines_of_code int, snippet string, nodes array<struct<node_type: string, depth: int>>, error string"


def register(language: str, parser: Parser, extensions: tuple[str, ...] = ()) -> None:
    """Add or replace the parser of a language; its files are known by their extensions."""
    PARSERS[language] = parser
    ANALYZABLE.update({e: language for e in extensions})


def parse_file(language: str | None, text: str | None) -> tuple[list[Function], str | None]:
    """The functions of one file; a file that cannot be read contributes none, and what went wrong."""
    parser = PARSERS.get(language or "")
    if parser is None or not text:
        return [], None if text is not None and parser else f"no parser for {language}" if parser is None else None
    try:
        return parser(text), None
    except Exception as e:  # noqa: BLE001 - one broken file must not end the scan
        return [], f"{type(e).__name__}: {e}"


def _rows(path: str, language: str, text: str | None) -> Iterator[tuple]:
    found, error = parse_file(language, text)
    for i, f in enumerate(found):
        yield (path, language, i, f.name, f.start_line, f.end_line, f.params, f.loc, f.snippet, [{"node_type": t, "depth": d} for t, d in f.nodes], None)
    if error:
        yield (path, language, None, None, None, None, None, None, None, None, error)


def parse_files(files: DataFrame) -> DataFrame:
    """Functions of files (path, language, content), and a row with the error of each that failed.

    A map over files: nothing is shuffled, a file is parsed where it is read. NULL contents have no functions.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ") if " " in c and "depth" not in c]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for path, language, text in zip(frame["path"], frame["language"], frame["content"], strict=True) for r in _rows(path, language, text)]
            made = pd.DataFrame(rows, columns=names)
            yield made.astype({c: "Int32" for c in ("function_ix", "start_line", "end_line", "parameter_count", "lines_of_code")})

    return files.select("path", "language", "content").mapInPandas(run, COLUMNS)


def ast_nodes(functions: DataFrame) -> DataFrame:
    """One row per control-flow node: path, function_ix, node_type, depth."""
    return functions.where("error is null").select("path", "function_ix", F.explode("nodes").alias("n")).select("path", "function_ix", "n.*")


def register_udtf(spark: SparkSession, name: str = "parse_code") -> None:
    """``LATERAL parse_code(language, path, content)`` in SQL."""

    @udtf(returnType=COLUMNS)
    class ParseCode:
        def eval(self, language: str, path: str, content: str):
            yield from ((*r[:9], [(n["node_type"], n["depth"]) for n in r[9]] if r[9] is not None else None, r[10]) for r in _rows(path, language, content))

    spark.udtf.register(name, ParseCode)
