"""The N highest-scoring items of every group by descending score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import materialize

#: Shares of all rows, from the top, at which a new band begins.
BAND_SHARES = (0.03, 0.15, 0.5)


def _unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Lots into which a group's rows are dealt where more items are asked than the engine's ranking limit takes.
LOTS = 64


def _ranked(rows: DataFrame, group: str, order: list[F.Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order, with rank_no.

    Up to the engine's limit a task keeps ``n`` rows of a group before the shuffle. Beyond it rows are
    first dealt by a hash of the whole row into lots, and only the first ``n`` of each lot meet, so that
    a group of millions is never ranked whole by one task unless ``n`` itself is of that size.
    """
    if n > int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        lot, place = _unused(rows, "_lot"), _unused(rows, "_place")
        dealt = rows.withColumn(lot, F.pmod(F.xxhash64(*[F.col(c) for c, t in rows.dtypes if not t.startswith(("map", "variant"))]), F.lit(LOTS)))
        own = Window.partitionBy(group, lot).orderBy(*order)
        rows = dealt.withColumn(place, F.row_number().over(own)).where(F.col(place) <= n).drop(lot, place)
    return rows.withColumn("rank_no", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank_no") <= n)


def top_items(items: DataFrame, group: str, score: str, ties: list[F.Column], n: int, band_shares: tuple[float, ...] = BAND_SHARES, scores: DataFrame | None = None) -> DataFrame:
    """For each group the first ``n`` items by descending score and then by ``ties``.

    Rows without a group or score do not count; ``ties`` are orderings (say where NULLs go) and
    should end with a unique column, else equal items come in either order. A group with fewer items keeps all. An empty
    table gives no rows; other columns of ``items`` are kept, save one named rank_no, which the result's replaces.

    The rows are written once to the shared folder, range-partitioned into bands of the score.
    Bands are processed from the top: groups that are already filled are anti-joined away before
    anything of the next band is shuffled, and what remains is ranked exactly. Most groups
    fill in the upper bands, which are small; within a band a ranking limit of ``n`` also cuts each task's
    rows per group before the shuffle, so millions of ties in one group meet as n rows per task.

    ``scores`` is a cheaper table with the column ``score`` from which the edges of the bands are estimated, such as the rows before they
    were deduplicated; the edges steer the work only, so the result doesn't depend on it. Without it ``items`` are computed twice.

    Result: the columns of ``items`` and rank_no (1 to n).
    """
    spark = items.sparkSession
    items = items.drop("rank_no")
    band_column, have, filled_column = (_unused(items, name) for name in ("_band", "_have", "_filled"))
    rows = items.where(F.col(group).isNotNull() & F.col(score).isNotNull())
    shares = [1 - s for s in band_shares]
    edges = (rows if scores is None else scores).agg(F.percentile_approx(score, shares, 1000).alias("e")).first()["e"] or []
    edges = sorted(set(edges), reverse=True)
    band = reduce(lambda otherwise, i: F.when(F.col(score) >= F.lit(edges[i]), i).otherwise(otherwise), reversed(range(len(edges))), F.lit(len(edges)))
    path = materialize(rows.withColumn(band_column, band), "topn-bands", (band_column,))
    banded = spark.read.schema(rows.withColumn(band_column, F.lit(0)).schema).parquet(path)
    order = [F.col(score).desc(), *ties]
    kept: list[DataFrame] = []
    for i in range(len(edges) + 1):
        left = banded.where(F.col(band_column) == i).drop(band_column)
        if kept:
            counts = reduce(DataFrame.unionByName, kept).groupBy(group).agg(F.count("*").alias(have))
            filled = counts.where(F.col(have) >= n).select(F.col(group).alias(filled_column))
            left = left.join(filled, F.col(group) == F.col(filled_column), "left_anti")
        best = _ranked(left, group, order, n).drop("rank_no")
        if i < len(edges):
            best = spark.read.schema(best.schema).parquet(materialize(best, "topn-kept"))
        kept.append(best)
    return _ranked(reduce(DataFrame.unionByName, kept), group, order, n)
