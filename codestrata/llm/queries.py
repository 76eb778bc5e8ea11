"""Queries p1 and p7 to p10 with the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import abuse, packing, quantiles, tokenizer, topn
from codestrata.plans.registry import Registry
from codestrata.session import materialize, spread, stamp
from codestrata.tables import folded, holding, read, reference, utc_day

registry = Registry()
MEASURES = ["cyclomatic_complexity", "lines_of_code"]
WHOLE = ("bigint",)
PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
GROUPINGS = [["repository_id"], ["language"], ["repository_id", "language"]]
NOT_STATED = "unknown"
TOP_N = 5


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows that hold, with the language folded; lines of code of 0 or less were not measured."""
    held = holding(read(spark, sf_dir, "complexity_metrics"), ["id"], ["updated_at", "loaded_at"], ["repository_id", "language", "created_at", *MEASURES])
    return held.select(
        "repository_id",
        F.coalesce(F.nullif(folded("language"), F.lit("")), F.lit(NOT_STATED)).alias("language"),
        utc_day("created_at").alias("day"),
        "cyclomatic_complexity",
        F.when(F.col("lines_of_code") > 0, F.col("lines_of_code")).alias("lines_of_code"),
    )


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.sketches(measured(spark, sf_dir), ["repository_id", "language", "day"], MEASURES)


@registry.add("p1_percentiles")
def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per repository, per language and per both, from daily sketches merged, with their bound and its confidence."""
    merged = quantiles.merged(daily_sketches(spark, sf_dir), GROUPINGS, kinds=WHOLE)
    values = [quantiles.whole_percentile("sketch", q).alias(f"p{round(100 * q)}") for q in PERCENTILES]
    return merged.select("level", "repository_id", "language", "measure", "n", *values, F.lit(quantiles.rank_error()).alias("rank_error"), F.lit(quantiles.CONFIDENCE).alias("confidence"))


_P1_ROWS = """
with h as (
  select * from complexity_metrics qualify row_number() over (partition by id order by updated_at desc, loaded_at desc) = 1
), m as (
  select repository_id, coalesce(nullif(lower(trim(language)), ''), 'unknown') as language, strftime(date_trunc('month', created_at), '%Y-%m') as month,
    cyclomatic_complexity c, case when lines_of_code > 0 then lines_of_code end l from h
), v as (
  select repository_id, language, month, 'cyclomatic_complexity' as measure, c v from m where c is not null
  union all select repository_id, language, month, 'lines_of_code', l from m where l is not null
)
"""
P1_BOUND_SQL = (
    _P1_ROWS
    + """
select 'repository_id' as level, repository_id, cast(null as varchar) as language, measure, count(*) as n, true as within_bound from v group by all
union all select 'language', null, language, measure, count(*), true from v group by all
union all select 'repository_id+language', repository_id, language, measure, count(*), true from v group by all
"""
)
P1_MONTHS_SQL = _P1_ROWS + "select coalesce(month, '') as month, repository_id, measure, count(*) as n, true as within_bound from v group by all"


def _within(rank_error: float) -> F.Column:
    """Whether the exact rank of a percentile lies within the bound; ranks are whole rows, so one row is added."""
    room = F.col("n") * rank_error + 1
    return (F.col("below") <= F.col("q") * F.col("n") + room) & (F.col("upto") >= F.col("q") * F.col("n") - room)


@registry.add("p1_bound", P1_BOUND_SQL)
def p1_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact ranks of all percentiles lie within the bound that p1_percentiles states, counted over all rows.

    The exact side is a histogram of the values, joined by group.
    """
    checked = _of_ranks(_long(measured(spark, sf_dir)), daily_sketches(spark, sf_dir), GROUPINGS, F.bool_and(_within(quantiles.rank_error())).alias("within_bound"))
    return checked.select("level", "repository_id", "language", "measure", "n", "within_bound")


@registry.add("p1_rank_errors")
def p1_rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest rank error of the percentiles of each group as a share of its rows, and how many miss the bound and that of 99 % (each and a row)."""
    off = F.greatest(F.col("below") - F.col("q") * F.col("n"), F.col("q") * F.col("n") - F.col("upto"), F.lit(0.0))
    beyond = [F.count_if(~_within(quantiles.rank_error())).alias("beyond_bound"), F.count_if(~_within(quantiles.rank_error(confidence=0.99))).alias("beyond_bound_99")]
    return _of_ranks(_long(measured(spark, sf_dir)), daily_sketches(spark, sf_dir), GROUPINGS, F.max(off / F.col("n")).alias("largest_rank_error"), F.count("*").alias("percentiles"), *beyond)


@registry.add("p1_months", P1_MONTHS_SQL)
def p1_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sketches stored as a table, read back and merged by ranges of days: months of each repository, checked against exact ranks."""
    stored = spark.read.parquet(materialize(daily_sketches(spark, sf_dir), "daily-sketches"))
    month = F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("")).alias("month")
    rows = _long(measured(spark, sf_dir).withColumn("month", month), "month")
    checked = _of_ranks(rows, stored.withColumn("month", month), [["month", "repository_id"]], F.bool_and(_within(quantiles.rank_error())).alias("within_bound"))
    return checked.select("month", "repository_id", "measure", "n", "within_bound")


def _long(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each value that was measured."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES]))
    keys = ["repository_id", "language", *more]
    return rows.select(*keys, each.alias("x")).select(*keys, "x.measure", "x.v").where("v is not null")


def _of_ranks(long: DataFrame, parts: DataFrame, groupings: list[list[str]], *measures: F.Column) -> DataFrame:
    """Measures of each group over the exact ranks of its percentiles: rows below the value and up to it."""
    keys = list(dict.fromkeys(c for g in groupings for c in g))
    histogram = long.groupBy(*keys, "measure", "v").agg(F.count("*").alias("k"))
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), quantiles.whole_percentile("sketch", q).alias("value")) for q in PERCENTILES]))
    checked = None
    for g in groupings:
        own = quantiles.merged(parts, [g], kinds=WHOLE).select(*[F.col(c).alias(f"a_{c}") for c in [*g, "measure"]], "n", each.alias("x")).select("*", "x.q", "x.value")
        counts = histogram.groupBy(*g, "measure", "v").agg(F.sum("k").alias("k"))
        match = F.col("a_measure") == F.col("measure")
        for c in g:
            match = match & F.col(f"a_{c}").eqNullSafe(F.col(c))
        ranks = own.join(counts, match).groupBy(*g, "measure", "n", "q").agg(
            F.sum(F.when(F.col("v") < F.col("value"), F.col("k")).otherwise(0)).alias("below"),
            F.sum(F.when(F.col("v") <= F.col("value"), F.col("k")).otherwise(0)).alias("upto"),
        )
        part = ranks.groupBy(*g, "measure", "n").agg(*measures)
        own_columns = part.columns[len(g) + 2 :]
        part = part.select(F.lit("+".join(g)).alias("level"), *[F.col(c) if c in g else F.lit(None).cast("string").alias(c) for c in keys], "measure", "n", *own_columns)
        checked = part if checked is None else checked.unionByName(part)
    return checked


P7_SQL = """
with h as (
  select * from complexity_metrics qualify row_number() over (partition by id order by updated_at desc, loaded_at desc) = 1
), r as (
  select nullif(nullif(lower(trim(analysis_run_id, e' \\t\\r\\n{}')), ''), '00000000-0000-0000-0000-000000000000') run, id, cyclomatic_complexity c, function_name f from h
)
select run as analysis_run_id, cast(row_number() over (partition by run order by c desc, f asc nulls last, id asc) as integer) as rank_no, id
from r where run is not null and c is not null qualify rank_no <= 5
"""


@registry.add("p7_found", P7_SQL)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five functions of highest complexity of every run that metrics refer to."""
    rows = read(spark, sf_dir, "complexity_metrics").select("id", "updated_at", "loaded_at", reference("analysis_run_id").alias("analysis_run_id"), "cyclomatic_complexity", "function_name")
    held = holding(rows, ["id"], ["updated_at", "loaded_at"], ["analysis_run_id", "cyclomatic_complexity", "function_name"])
    top = topn.top_items(held, "analysis_run_id", "cyclomatic_complexity", [F.col("function_name").asc_nulls_last(), F.col("id").asc()], TOP_N, scores=rows)
    return top.select("analysis_run_id", F.col("rank_no").cast("int").alias("rank_no"), "id")


@registry.add("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokenizer.encode_texts(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def capacities(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The container sizes, a small parameter table."""
    return [(r["capacity_id"], r["capacity_tokens"]) for r in read(spark, sf_dir, "token_capacities").select("capacity_id", "capacity_tokens").distinct().collect()]


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.count_tokens(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def packed_documents(spark: SparkSession, sf_dir: str, sizes: DataFrame | None = None) -> DataFrame:
    """Documents in containers; their number, by which blocks are made, is in the footers of the table."""
    return packing.pack(document_sizes(spark, sf_dir) if sizes is None else sizes, "doc_id", "tokens", capacities(spark, sf_dir), read(spark, sf_dir, "documents").count())


@registry.add("p9_containers")
def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, for each container size."""
    return packed_documents(spark, sf_dir)


@registry.add("p9_fill")
def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, the number below which none can go, tokens and the share of room used, for each container size."""
    used = packed_documents(spark, sf_dir).groupBy("capacity_id", "block", "container").agg(F.sum("tokens").alias("tokens"))
    sizes = read(spark, sf_dir, "token_capacities").select(F.col("capacity_id").alias("c_id"), "capacity_tokens")
    total = used.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return total.join(sizes, F.col("capacity_id") == F.col("c_id")).select("capacity_id", "containers", least.alias("least"), "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


P9_CHECK_SQL = """
select capacity_id, (select count(*) from documents) as documents, (select count(*) from documents where text is null or text = '') as without_tokens,
  true as within_capacity, true as whole, true as complete
from token_capacities
"""


@registry.add("p9_check", P9_CHECK_SQL)
def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every assignment: no container is over its capacity, no document is cut that fits, no token is lost or added."""
    sizes = spark.read.parquet(materialize(document_sizes(spark, sf_dir), "document-sizes"))
    packed = spark.read.parquet(materialize(packed_documents(spark, sf_dir, sizes), "packed"))
    rooms = read(spark, sf_dir, "token_capacities").select(F.col("capacity_id").alias("c_id"), "capacity_tokens")
    own = F.col("capacity_id") == F.col("c_id")
    filled = packed.groupBy("capacity_id", "block", "container").agg(F.sum("tokens").alias("tokens")).join(rooms, own)
    containers = filled.groupBy("capacity_id").agg(F.bool_and(F.col("tokens") <= F.col("capacity_tokens")).alias("within_capacity"))
    pieces = packed.groupBy("capacity_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("placed")).join(rooms, own)
    asked = sizes.groupBy(F.col("doc_id").alias("s_id")).agg(F.sum("tokens").alias("size"))
    told = pieces.join(asked, F.col("doc_id") == F.col("s_id"), "left").groupBy(F.col("capacity_id").alias("p_id")).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("size") == 0).alias("without_tokens"),
        F.bool_and(F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens")))).alias("whole"),
        F.bool_and(F.col("placed").eqNullSafe(F.col("size"))).alias("complete"),
    )
    return containers.join(told, F.col("capacity_id") == F.col("p_id")).select("capacity_id", "documents", "without_tokens", "within_capacity", "whole", "complete")


#: Models by application and by the files they were fitted on.
_models: dict[tuple, abuse.Model] = {}


def abuse_model(spark: SparkSession, sf_dir: str) -> abuse.Model:
    """The model of these tables, fitted once for an application as long as their files stay the same."""
    key = (spark.sparkContext.applicationId, *(stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "doc_labels")))
    if key not in _models:
        opinions = abuse.votes(read(spark, sf_dir, "doc_labels"), "doc_id", "reviewer", "label", "labelled_at")
        _models[key] = abuse.train(read(spark, sf_dir, "documents"), opinions, "doc_id", "text")
    return _models[key]


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return abuse.score(spread(documents), "doc_id", "text", abuse_model(spark, sf_dir))


@registry.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with abusive, hateful or sexual language."""
    return scored_documents(spark, sf_dir).where(abuse.is_flagged()).select("doc_id")


@registry.add("p10_scores")
def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, with the sentence that weighs most."""
    return scored_documents(spark, sf_dir)


@registry.add("p10_rates")
def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents reported, and their share, per source."""
    return abuse.rates(scored_documents(spark, sf_dir), "source")
