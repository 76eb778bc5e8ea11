"""References to records that do not exist, or that landed only after the referring row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """A column that refers to another table's key; all expressions resolve on their table."""

    table: str
    column: str
    child: DataFrame
    row_id: Column
    key: Column
    child_loaded: Column
    target: str
    parent: DataFrame
    parent_id: Column
    parent_loaded: Column


def orphan_references(references: list[Reference]) -> DataFrame:
    """Referring rows whose target is missing or landed later.

    The key expressions give NULL for "no reference"; such rows, and parents without an id,
    do not count. ``missing``: no parent has the key. ``late``: the earliest load of the rows
    with this id and key lies before the earliest load of the parent. A NULL load time is never
    before another. NULL row ids are one id. Repeated rows count once; an empty parent table makes
    every reference missing, an empty child table gives no rows.

    The distinct keys of all references, each with its earliest load (a map-side combined
    aggregate, so a key that holds a third of all rows costs one row per task), are anti-joined
    with the parent keys that landed in time. What the anti-join leaves are the keys in question, missing and late ones
    at once, so the referring rows are read twice: for their keys, and to be joined back with the few keys in question. That join
    has unique keys on one side, which adaptive execution may broadcast once their measured size
    is below the session's limit, or else splits where the referring rows are skewed.

    Result: table_name, column_name, row_id, key_value, kind, first_loaded.
    """
    children = reduce(
        DataFrame.unionByName,
        [r.child.select(F.lit(i).alias("ref"), r.row_id.alias("row_id"), r.key.alias("key"), r.child_loaded.alias("loaded")).where(F.col("key").isNotNull()) for i, r in enumerate(references)],
    )
    targets = {r.target: r for r in references}
    parents = reduce(
        DataFrame.unionByName,
        [r.parent.select(F.lit(t).alias("target"), r.parent_id.alias("p_key"), r.parent_loaded.alias("p_loaded")).where(F.col("p_key").isNotNull()) for t, r in targets.items()],
    )
    parents = parents.groupBy("target", "p_key").agg(F.min("p_loaded").alias("p_first"))
    target_of = F.element_at(F.array(*[F.lit(r.target) for r in references]), F.col("ref") + 1)
    keys = children.groupBy("ref", "key").agg(F.min("loaded").alias("first")).withColumn("target", target_of)
    same = (keys["target"] == parents["target"]) & (keys["key"] == parents["p_key"])
    in_time = F.coalesce(F.col("first") >= F.col("p_first"), F.lit(True))
    asked = keys.join(parents, same & in_time, "left_anti").select(F.col("target").alias("k_target"), F.col("ref").alias("k_ref"), F.col("key").alias("k_key"))
    kind = F.when(F.col("p_key").isNull(), "missing").otherwise("late").alias("kind")
    known = asked.join(parents, (F.col("k_target") == F.col("target")) & (F.col("k_key") == F.col("p_key")), "left").select("k_ref", "k_key", kind, "p_first")
    found = children.join(known, (F.col("ref") == F.col("k_ref")) & (F.col("key") == F.col("k_key")))
    rows = found.groupBy("ref", "row_id", "key", "kind", "p_first").agg(F.min("loaded").alias("first_loaded")).where((F.col("kind") == "missing") | (F.col("first_loaded") < F.col("p_first")))
    names = F.element_at(F.array(*[F.struct(F.lit(r.table).alias("t"), F.lit(r.column).alias("c")) for r in references]), F.col("ref") + 1)
    return rows.select(names["t"].alias("table_name"), names["c"].alias("column_name"), "row_id", F.col("key").alias("key_value"), "kind", "first_loaded")


def orphan_counts(found: DataFrame, period: str = "month") -> DataFrame:
    """Rows and distinct keys in question per table, column, kind and period of the first load."""
    return (
        found.withColumn("period", F.date_format(F.date_trunc(period, "first_loaded"), "yyyy-MM-dd"))
        .groupBy("table_name", "column_name", "kind", "period", "key_value")
        .agg(F.count("*").alias("n"))
        .groupBy("table_name", "column_name", "kind", "period")
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))
    )
