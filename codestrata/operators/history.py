"""Every version of an entity's attributes with the period in which it was valid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_DAYS = 32


def _differs(now: pa.Array, before: pa.Array) -> np.ndarray:
    """Where two columns differ, NULL being a value of its own."""
    unequal = pc.fill_null(pc.not_equal(now, before), False)
    return pc.or_(unequal, pc.xor(pc.is_null(now), pc.is_null(before))).to_numpy(zero_copy_only=False)


def _merge_writes(batches: Iterator[pa.RecordBatch], attributes: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Turn writes sorted by entity, slice and time into versions, holding one open version.

    The sort below this function merges the sorted runs of all inputs by entity and time; this
    iterator compares each write with the one before and closes a version where the payload
    changes. Its memory is one batch and the open version, whatever the length of a history.
    """
    carry: pa.Table | None = None
    carry_new = True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if carry is not None:
            rows = pa.concat_tables([carry, rows])
        n = rows.num_rows
        cols = _columns(rows, attributes)
        new_key, starts = np.ones(n, bool), np.ones(n, bool)
        if n > 1:
            new_key[1:] = _differs(cols["entity"][1:], cols["entity"][:-1]) | _differs(cols["slice"][1:], cols["slice"][:-1])
            changed = np.zeros(n - 1, bool)
            for c in attributes:
                changed |= _differs(cols[c][1:], cols[c][:-1])
            starts[1:] = new_key[1:] | changed
        new_key[0] = carry_new
        at = np.flatnonzero(starts)
        carry, carry_new = rows.slice(int(at[-1]), 1), bool(new_key[at[-1]])
        yield from _closed(cols, at, new_key, attributes, schema, closing=False)
    if carry is not None:
        yield from _closed(_columns(carry, attributes), np.array([0]), np.array([carry_new]), attributes, schema, closing=True)


def _columns(rows: pa.Table, attributes: list[str]) -> dict[str, pa.Array]:
    return {c: rows.column(c).combine_chunks() for c in ["entity", "slice", "at", *attributes]}


def _closed(cols: dict[str, pa.Array], at: np.ndarray, new_key: np.ndarray, attributes: list[str], schema: pa.Schema, closing: bool) -> Iterator[pa.RecordBatch]:
    """The versions at rows ``at``; the last stays open for the next batch unless ``closing``."""
    own = at if closing else at[:-1]
    if not len(own):
        return
    is_first = new_key[own]
    is_last = np.ones(len(own), bool) if closing else new_key[at[1:]]
    begin = cols["at"].take(pa.array(own))
    if closing:
        end = pa.nulls(len(own), pa.int64())
    else:
        end = pc.if_else(pa.array(is_last), pa.scalar(None, pa.int64()), cols["at"].take(pa.array(at[1:])))
    taken = [cols[c].take(pa.array(own)) for c in attributes]
    yield pa.RecordBatch.from_arrays([cols["entity"].take(pa.array(own)), cols["slice"].take(pa.array(own)), begin, end, *taken, pa.array(is_first), pa.array(is_last)], names=schema.names)


def attribute_history(
    writes: list[DataFrame],
    entity: Column,
    at_us: Column,
    loaded: Column,
    attributes: dict[str, Column],
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Versions of the attributes of each entity with their periods of validity.

    ``writes`` are one or more inputs, snapshots or updates, on which the column expressions
    resolve. Writes without a time or an entity do not count. Of several writes of an entity at one time the
    latest ``loaded`` holds (ties: the greatest attribute values). Neighbouring writes with equal
    attributes, NULL equal to NULL, are one version. Empty inputs give no rows; other columns
    of the inputs are not read.

    Inputs are co-partitioned by entity and time slice and sorted by time; each partition is
    merged by an iterator that emits a version when the payload changes. The slices spread the
    history of one very busy entity over many tasks. Only the first and last version of each slice
    meet again per entity, to join versions that run across a slice's end.

    Result: entity, valid_from_us, valid_to_us (NULL if still valid) and the attributes.
    """
    names = list(attributes)
    width = slice_days * 86_400_000_000
    sides = [w.select(entity.alias("entity"), at_us.alias("at"), loaded.alias("loaded"), *[c.alias(n) for n, c in attributes.items()]) for w in writes]
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    rows = (
        rows.where(F.col("entity").isNotNull() & F.col("at").isNotNull())
        .groupBy("entity", "at")
        .agg(F.max(F.struct("loaded", *names)).alias("held"))
        .select("entity", F.floor(F.col("at") / width).cast("int").alias("slice"), "at", *[F.col(f"held.{n}").alias(n) for n in names])
        .repartition("entity", "slice")
        .sortWithinPartitions("entity", "slice", "at")
    )
    fields = [rows.schema["entity"], rows.schema["slice"], T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), *[rows.schema[n] for n in names], T.StructField("is_first", T.BooleanType()), T.StructField("is_last", T.BooleanType())]
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _merge_writes(batches, names, to_arrow_schema(out))

    versions = rows.mapInArrow(merge, out)
    edge = F.col("is_first") | F.col("is_last")
    span = Window.partitionBy("entity", "lane").orderBy("begin")
    same = F.lag(F.struct(*names)).over(span).eqNullSafe(F.struct(*names))
    joined = (
        versions.withColumn("lane", F.when(~edge, F.col("slice")))
        .withColumn("absorbed", F.col("is_first") & F.lag("begin").over(span).isNotNull() & same)
        .withColumn("until", F.coalesce("end", F.lead("begin").over(span)))
        .withColumn("island", F.sum((~F.col("absorbed")).cast("long")).over(span))
    )
    return (
        joined.groupBy("entity", "lane", "island")
        .agg(F.min("begin").alias("valid_from_us"), F.max(F.struct("begin", "until")).alias("tail"), F.first(F.struct(*names)).alias("payload"))
        .select("entity", "valid_from_us", F.col("tail.until").alias("valid_to_us"), *[F.col(f"payload.{n}").alias(n) for n in names])
    )
