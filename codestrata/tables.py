"""Reading the tables, and the rules by which their rows hold and their references compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NIL_UUID = "00000000-0000-0000-0000-000000000000"
#: Outer characters that carry no meaning in a reference: white space and braces.
_REFERENCE_PADDING = " \t\r\n\f\u000b  　﻿{}"
_BLANKS = " \t\r\n\f\u000b  　﻿"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_trim(col: Column | str) -> Column:
    """Without outer white space."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(_BLANKS))


def folded(col: Column | str) -> Column:
    """Lower case without outer white space."""
    return F.lower(blank_trim(col))


def reference(col: Column | str) -> Column:
    """A UUID reference in its canonical form: lower case, without outer white space or braces.

    NULL, the empty string and the nil UUID all mean "no reference" and give NULL.
    """
    key = F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(_REFERENCE_PADDING)))
    return F.when(~key.isin("", NIL_UUID), key)


def micros(col: Column | str) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp."""
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def utc_day(col: Column | str) -> Column:
    """The UTC day of a timestamp, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(micros(col) / 86_400_000_000).cast("int"))


def holding(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """For each key the row that is greatest by ``order``; other ties are settled by the values.

    One aggregation with map-side combine, so that a key which is delivered very often is
    reduced before the shuffle. NULLs in ``order`` rank lowest. The result has keys and values.
    """
    picked = F.max(F.struct(*order, *[c for c in values if c not in order])).alias("_held")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_held.{c}").alias(c) for c in values])
