"""Writing to the store as sets: insert, touch, resolve and reconcile give the next version of a table.

Parquet tables know no updates, so each operator takes the rows of one version and gives those of
the next; ``sources.versions`` swaps versions. ``now`` is passed in, so that a run can be repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT = ("repository_id", "file_path", "issue_type", "line_number", "tool_rule_id")
#: What an upsert of a known issue refreshes.
VOLATILE = ("analysis_run_id", "line_number", "column_number", "code_snippet", "surrounding_context")


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def changed(rows: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with other values where a condition is true."""
    return rows.select(*[F.when(when, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def _active_places(store: DataFrame) -> DataFrame:
    return store.where(F.col("status").isin("open", "ignored")).select(*[F.col(c).alias(f"_{c}") for c in AT]).distinct()


def new_issues(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Issues of a batch that no open or ignored issue of the store shares the location with.

    Twins within the batch are all new. Line and rule compare null-safely, as do the other columns.
    """
    return batch.join(_active_places(store), _same([F.col(c) for c in AT], [F.col(f"_{c}") for c in AT]), "left_anti")


def batch_create(store: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The store after a batch: known issues are touched by their latest twin, others inserted."""
    return touched(store, batch, now).unionByName(new_issues(store, batch).withColumn("updated_at", now))


def touched(store: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Open or ignored issues at the location of a batch's issue get its run and the time; the greatest run of twins."""
    places = batch.groupBy(*[F.col(c).alias(f"_{c}") for c in AT]).agg(F.max("analysis_run_id").alias("_run"), F.lit(True).alias("_hit"))
    joined = store.join(places, _same([F.col(c) for c in AT], [F.col(f"_{c}") for c in AT]), "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("status").isin("open", "ignored")
    return changed(joined, hit, {"analysis_run_id": F.col("_run"), "updated_at": now}).select(*store.columns)


def _resolution(now: Column, reason: str) -> dict[str, Column]:
    return {"status": F.lit("resolved"), "resolved_at": now, "updated_at": now, "resolution_reason": F.lit(reason)}


def missing_condition(current: Column) -> Column:
    """Open issues of another run than the current one; an issue without a run is not matched."""
    return F.coalesce((F.col("status") == "open") & (F.col("analysis_run_id") != current), F.lit(False))


def resolve_missing(store: DataFrame, current: Column, now: Column, reason: str) -> DataFrame:
    return changed(store, missing_condition(current), _resolution(now, reason))


def resolve_stale(store: DataFrame, files: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Open issues in the files (repository_id, file_path) that are not among the found (id) are resolved."""
    scope = files.select(F.col("repository_id").alias("_r"), F.col("file_path").alias("_f"), F.lit(True).alias("_in")).distinct()
    ids = found.select(F.col("id").alias("_id"), F.lit(True).alias("_seen")).distinct()
    joined = store.join(scope, (F.col("repository_id") == F.col("_r")) & (F.col("file_path") == F.col("_f")), "left").join(ids, F.col("id") == F.col("_id"), "left")
    stale = F.coalesce((F.col("status") == "open") & F.col("_in") & F.col("_seen").isNull(), F.lit(False))
    return changed(joined, stale, _resolution(now, "Automatically resolved during incremental scan")).select(*store.columns)


def reconcile(store: DataFrame, batch: DataFrame, tool: str, now: Column, ordinal: str = "ordinal") -> DataFrame:
    """The store after an analyzer's findings per repository: upsert by fingerprint, then sweep.

    ``batch`` has the store's columns and an ordinal. Within a repository and fingerprint the
    last twin gives the volatile columns and the first the rest. An open issue with the fingerprint is refreshed, others are
    inserted as open. Then open issues of the tool that the current run, the run of the batch's
    first finding in the repository, did not refresh, or that have no run, are resolved. A repository
    that the batch leaves out has no current run and loses all open issues of the tool.
    Repositories and fingerprints compare null-safely; a NULL fingerprint is never known.

    One full outer join on repository and fingerprint, whose sides have unique keys among open
    issues; the store's closed issues pass by on a key of their own.
    """
    kept = [c for c in store.columns if c not in VOLATILE]
    first = batch.groupBy("repository_id", "fingerprint_hash").agg(
        F.min(F.struct(ordinal, *[F.col(c) for c in kept if c not in ("repository_id", "fingerprint_hash")])).alias("first"),
        F.max(F.struct(ordinal, *[F.col(c) for c in VOLATILE])).alias("last"),
    )
    runs = batch.groupBy(F.col("repository_id").alias("_run_repo")).agg(F.min(F.struct(ordinal, "analysis_run_id"))["analysis_run_id"].alias("_current"))
    fresh = first.select(F.col("repository_id").alias("b_repo"), F.col("fingerprint_hash").alias("b_hash"), "first", "last")
    is_open = F.col("status") == "open"
    joined = store.join(fresh, is_open & F.col("repository_id").eqNullSafe(F.col("b_repo")) & (F.col("fingerprint_hash") == F.col("b_hash")), "full_outer")
    known, seen = F.col("id").isNotNull(), F.col("last").isNotNull()

    def value(c: str) -> Column:
        if c == "repository_id":
            return F.when(known, F.col(c)).otherwise(F.col("b_repo"))
        if c == "fingerprint_hash":
            return F.when(known, F.col(c)).otherwise(F.col("b_hash"))
        if c in VOLATILE:
            return F.when(seen, F.col("last")[c]).otherwise(F.col(c))
        if c == "updated_at":
            return F.when(seen, now).otherwise(F.col(c))
        if c == "status":
            return F.when(known, F.col(c)).otherwise(F.lit("open"))
        if c == "created_at":
            return F.when(known, F.col(c)).otherwise(now)
        return F.when(known, F.col(c)).otherwise(F.col("first")[c])

    upserted = joined.select(*[value(c).alias(c) for c in store.columns])
    swept = upserted.join(runs, F.col("repository_id").eqNullSafe(F.col("_run_repo")), "left")
    gone = F.coalesce((F.col("tool_name") == tool) & (F.col("status") == "open"), F.lit(False)) & ~F.coalesce(F.col("analysis_run_id") == F.col("_current"), F.lit(False))
    return changed(swept, gone, _resolution(now, "fixed_in_code")).select(*store.columns)


def replace_open(store: DataFrame, batch: DataFrame, tool: str) -> DataFrame:
    """The simpler variant of stores in memory: open issues of the tool are dropped and the batch appended."""
    return store.where(~F.coalesce((F.col("status") == "open") & (F.col("tool_name") == tool), F.lit(False))).unionByName(batch)


_SYNC = {"jira": "jira_sync_status", "trello": "trello_sync_status"}


def pending_syncs(store: DataFrame, platform: str, severities: list[str]) -> DataFrame:
    """Open issues that wait for a platform; no severities, no rows."""
    if platform not in _SYNC:
        raise ValueError(f"unknown platform {platform!r}")
    if not severities:
        return store.limit(0)
    return store.where((F.col("status") == "open") & (F.col(_SYNC[platform]) == "pending") & F.col("severity").isin(*severities))


def linked(store: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """External ids and addresses of issues (id, external_id, external_platform, external_url) written to the store."""
    new = links.groupBy(F.col("id").alias("_id")).agg(F.max(F.struct("external_id", "external_platform", "external_url")).alias("_link"))
    joined = store.join(new, F.col("id") == F.col("_id"), "left")
    values = {c: F.col("_link")[c] for c in ("external_id", "external_platform", "external_url")}
    return changed(joined, F.col("_link").isNotNull(), {**values, "updated_at": now}).select(*store.columns)


def soft_deleted(comments: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Comments with a time of deletion where their id is listed and they weren't deleted before."""
    joined = comments.join(ids.select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct(), F.col("id") == F.col("_id"), "left")
    return changed(joined, F.coalesce("_hit", F.lit(False)) & F.col("deleted_at").isNull(), {"deleted_at": now}).select(*comments.columns)


def completed_runs(runs: DataFrame, now: Column, counters: DataFrame) -> DataFrame:
    """Runs after completion: duration in whole seconds and counters (id and a map of text) where given.

    A counter may be an integer or a fraction, which is cut off; a missing one keeps the old value.
    """
    names = ("total_issues_found", "critical_issues_count", "high_issues_count", "medium_issues_count", "low_issues_count")
    joined = runs.join(counters.select(F.col("id").alias("_id"), F.col("counters").alias("_c")), F.col("id") == F.col("_id"), "left")
    done = F.col("_c").isNotNull()
    values: dict[str, Column] = {n: F.coalesce(F.element_at("_c", F.lit(n)).try_cast("double").cast("int"), F.col(n)) for n in names}
    values |= {"status": F.lit("completed"), "completed_at": now, "duration_seconds": F.floor((F.unix_micros(now) - F.unix_micros("started_at")) / 1_000_000).cast("int")}
    return changed(joined, done, values).select(*runs.columns)
