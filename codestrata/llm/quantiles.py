"""Percentiles of very large numeric columns from mergeable compactor sketches.

A sketch is a hierarchy of randomized compactors: a full level is sorted and every other value,
from a random offset, moves up with twice the weight; sketches of any parts or days merge level
by level. The engine's own aggregate does this inside the JVM with map-side combine (one bounded
sketch per group and task), so a group that holds a third of all rows costs no more than others.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values a full compactor holds; ``rank_error`` gives the bound.
K = 1000
#: The probability that one percentile keeps the bound that is stated beside it.
CONFIDENCE = 0.999999

_KINDS = {
    "bigint": (F.kll_sketch_agg_bigint, F.kll_merge_agg_bigint, F.kll_sketch_get_n_bigint, F.kll_sketch_get_quantile_bigint),
    "double": (F.kll_sketch_agg_double, F.kll_merge_agg_double, F.kll_sketch_get_n_double, F.kll_sketch_get_quantile_double),
}


def rank_error(k: int = K, confidence: float = CONFIDENCE) -> float:
    """The bound on the normalized rank error of one percentile, which holds with this confidence.

    The published fit for this hierarchy at 99 %, carried to other confidences as the sum of many small
    independent rounding steps that the error is, by the normal law. It does not depend on how many values were added or how
    many sketches were merged. A group of at most ``k`` values is answered exactly.
    """
    two_sided = lambda p: NormalDist().inv_cdf((1 + p) / 2)
    return 2.296 / k**0.9021 * two_sided(confidence) / two_sided(0.99)


def kind_of(column: T.DataType) -> str:
    """The sketch that keeps a column's values as they are: ``bigint`` for whole numbers, else ``double``."""
    if isinstance(column, T.IntegralType) or (isinstance(column, T.DecimalType) and column.scale == 0 and column.precision <= 18):
        return "bigint"
    if isinstance(column, (T.FractionalType, T.DecimalType)):
        return "double"
    raise TypeError(f"{column.simpleString()} is no numeric type")


def sketches(rows: DataFrame, keys: list[str], measures: list[str], k: int = K) -> DataFrame:
    """One sketch per combination of keys and measure, to be stored and merged later.

    Whole numbers are kept as 64-bit integers, fractional ones as doubles (a decimal of more than 15 digits
    is rounded to the nearest double). NULL and NaN values are not added; a combination without any value has no row for that measure.
    NULL keys are a group. Ties and repeated rows count as often as they occur. An empty table gives no rows.

    Result: the keys, measure, kind (of the sketch), n (values added), sketch (binary).
    """
    kinds = {m: kind_of(rows.schema[m].dataType) for m in measures}
    value = {m: F.col(m).cast(kinds[m]) if kinds[m] == "bigint" else F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")) for m in measures}
    made = rows.groupBy(*keys).agg(*[_KINDS[kinds[m]][0](value[m], F.lit(k)).alias(m) for m in measures])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(kinds[m]).alias("kind"), _KINDS[kinds[m]][2](m).alias("n"), F.col(m).alias("sketch")) for m in measures]))
    return made.select(*keys, each.alias("s")).select(*keys, "s.measure", "s.kind", "s.n", "s.sketch").where(F.col("n") > 0)


def merged(parts: DataFrame, grouping: list[list[str]], k: int = K, kinds: tuple[str, ...] = ("bigint", "double")) -> DataFrame:
    """Sketches merged levelwise for each set of grouping columns.

    ``parts`` are rows of ``sketches``, fresh or read back, of any mixture of days and parts. Sketches of
    one measure must be of one kind, else they come out as two rows. ``kinds`` are those that can occur; another is an error.

    Result: one column for each key that occurs in ``grouping`` (NULL where it is not in the set),
    level (the set's columns), measure, kind, n, sketch.
    """
    columns = list(dict.fromkeys(c for g in grouping for c in g))
    of_kind = lambda x: F.when(F.col("kind") == x, F.col("sketch")).when(~F.col("kind").isin(*kinds), F.raise_error(F.lit("a sketch of another kind")).cast("binary"))

    def of(g: list[str]) -> DataFrame:
        made = parts.groupBy(*g, "measure", "kind").agg(F.sum("n").alias("n"), *[_KINDS[x][1](of_kind(x), F.lit(k)).alias(f"_{x}") for x in kinds])
        own = [F.col(c) if c in g else F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in columns]
        sketch = F.coalesce(*[F.when(F.col("kind") == x, F.col(f"_{x}")) for x in kinds])
        return made.select(*own, F.lit("+".join(g)).alias("level"), "measure", "kind", "n", sketch.alias("sketch"))

    return reduce(DataFrame.unionByName, [of(g) for g in grouping])


def percentile(sketch: Column | str, q: float, kind: Column | str = "kind") -> Column:
    """The value whose rank is nearest to ``q`` within the bound, as a double; whole numbers are exact below 2**53."""
    own = F.col(kind) if isinstance(kind, str) else kind
    at = F.lit(float(q))
    return F.when(own == "bigint", _KINDS["bigint"][3](F.when(own == "bigint", F.col(sketch) if isinstance(sketch, str) else sketch), at).cast("double")).otherwise(_KINDS["double"][3](F.when(own == "double", F.col(sketch) if isinstance(sketch, str) else sketch), at))


def whole_percentile(sketch: Column | str, q: float) -> Column:
    """The same for sketches that are all of whole numbers, as a 64-bit integer."""
    return _KINDS["bigint"][3](sketch, F.lit(float(q)))
