"""Relations that the reference-parity queries read, each as a DataFrame and as SQL.

A relation is named by its columns: an expression for Spark and one for SQL each. Rows that hold
are picked by the same order on both sides, so that ties are settled alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.tables import NIL_UUID, folded, holding, read, reference

_TRIM = "e' \\t\\r\\n'"
_REF_TRIM = "e' \\t\\r\\n{}'"


def ref_sql(column: str) -> str:
    return f"nullif(nullif(lower(trim({column}, {_REF_TRIM})), ''), '{NIL_UUID}')"


def folded_sql(column: str) -> str:
    return f"lower(trim({column}, {_TRIM}))"


#: Columns that are normalised when they are read.
_REFERENCES = {"analysis_run_id", "issue_id", "assigned_to_user_id", "resolved_by_user_id"}
_FOLDED = {"severity", "status", "language"}


def held(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The rows of a table that hold, with id and the columns named."""
    rows = read(spark, sf_dir, table)
    own = [reference(c).alias(c) if c in _REFERENCES else folded(c).alias(c) if c in _FOLDED else F.col(c) for c in columns if c not in ("updated_at", "loaded_at")]
    return holding(rows.select("id", "updated_at", "loaded_at", *own), ["id"], ["updated_at", "loaded_at"], list(columns))


def held_sql(table: str, *columns: str) -> str:
    """The same as a parenthesised subquery."""
    own = [c for c in columns if c not in ("updated_at", "loaded_at")]
    exprs = ", ".join(f"{ref_sql(c)} as {c}" if c in _REFERENCES else f"{folded_sql(c)} as {c}" if c in _FOLDED else c for c in own)
    order = ", ".join(f"{c} desc nulls last" for c in ["updated_at", "loaded_at", *own])
    return f"(select id, {', '.join(columns)} from (select id, updated_at, loaded_at, {exprs} from {table}) qualify row_number() over (partition by id order by {order}) = 1)"


def view(prefix: str, **subqueries: str) -> str:
    """A WITH clause of the subqueries, before ``prefix``."""
    return "with " + ", ".join(f"{n} as {q}" for n, q in subqueries.items()) + " " + prefix


# Control-flow nodes: there are none in the test tables, so lines of orders stand for nodes and parts for functions.
NODE_TYPES = ["Branch", "Loop", "Closure", "Operator", "Nesting", "Branch", "Operator"]


def functions_and_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    functions = read(spark, sf_dir, "part").select("p_partkey")
    kinds = F.element_at(F.array(*[F.lit(t) for t in NODE_TYPES]), F.col("l_linenumber"))
    nodes = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), kinds.alias("node_type"), (F.floor("l_quantity") % 8).cast("int").alias("depth"))
    return functions, nodes


NODES_SQL = "(select l_partkey p_partkey, [" + ", ".join(f"'{t}'" for t in NODE_TYPES) + "][l_linenumber] node_type, cast(floor(l_quantity) as integer) % 8 depth from lineitem)"
