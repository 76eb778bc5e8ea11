"""Version-control history from the text that git prints: columns named ``value``, one line each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.tables import blank_trim


def changed_files(lines: DataFrame) -> DataFrame:
    """The files named, one row per line; blank lines are dropped, repeated ones kept."""
    return lines.select(blank_trim("value").alias("file")).where("file <> ''")


def churn(lines: DataFrame) -> DataFrame:
    """How often each file was changed."""
    return changed_files(lines).groupBy("file").agg(F.count("*").alias("changes"))


def commits(lines: DataFrame) -> DataFrame:
    """Hash, author, mail and subject of lines separated by bars.

    A subject that holds a bar ends there. A line of fewer than four parts has an error instead.
    """
    parts = F.split("value", r"\|")
    enough = F.size(parts) >= 4
    part = lambda i: F.when(enough, parts[i])
    return lines.select(part(0).alias("hash"), part(1).alias("author"), part(2).alias("email"), part(3).alias("subject"), F.when(~enough, F.lit("fewer than four parts")).alias("error"))
