"""Records kept by key: look-ups with errors, updates, removal, and what sessions, configurations, activity and caches make of them.

As in ``writes``, an operator takes the rows of one version of a table and gives those of the next. A single
record is asked for or changed as a set of one; ``now`` is passed in, so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.writes import changed



def _matches(on: list[str]) -> Column:
    """Equality of the key columns with those asked for; a NULL key matches nothing."""
    out = F.lit(True)
    for c in on:
        out = out & (F.col(c) == F.col(f"_k_{c}"))
    return out


def looked_up(table: DataFrame, keys: DataFrame, on: list[str], name: str, required: bool = True) -> DataFrame:
    """A row for each distinct key asked for: the key, the table's other columns and an error.

    A key that the table doesn't have, or that is NULL, gives a row of NULLs, and an error if it is ``required``. A key of several
    rows gives each of them.
    """
    asked = keys.select(*on).distinct().select(*[F.col(c).alias(f"_k_{c}") for c in on])
    rows = table.withColumn("_found", F.lit(True))
    joined = asked.join(rows, _matches(on), "left")
    error = F.when(F.col("_found").isNull(), F.lit(f"{name} not found")) if required else F.lit(None).cast("string")
    return joined.select(*[F.col(f"_k_{c}").alias(c) for c in on], *[c for c in table.columns if c not in on], error.alias("error"))


def created(table: DataFrame, rows: DataFrame, now: Column, **defaults: Column) -> DataFrame:
    """The table with rows added, created and updated now; columns that ``rows`` lacks have their default or NULL."""
    stamped = {c: now for c in ("created_at", "updated_at") if c in table.columns} | defaults
    new = [stamped[f.name].alias(f.name) if f.name in stamped else F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]
    return table.unionByName(rows.select(*new))


def updated(table: DataFrame, changes: DataFrame, now: Column, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table with the columns of ``changes`` written where the key is, and the keys that it doesn't have.

    Of several changes of one key the greatest holds. Other columns stay; ``updated_at`` is set.
    """
    values = [c for c in changes.columns if c != key]
    new = changes.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*values)).alias("_new"), F.lit(True).alias("_hit"))
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    written = {c: F.col("_new")[c] for c in values} | ({"updated_at": now} if "updated_at" in table.columns else {})
    missing = new.join(table.select(F.col(key).alias("_own")), F.col("_key") == F.col("_own"), "left_anti").select(F.col("_key").alias(key), F.lit("not found").alias("error"))
    return changed(joined, F.coalesce("_hit", F.lit(False)), written).select(*table.columns), missing


def removed(table: DataFrame, keys: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table without the rows of the keys, and the keys that it doesn't have; rows without a key stay."""
    asked = keys.select(F.col(key).alias("_key")).distinct()
    missing = asked.join(table.select(F.col(key).alias("_own")), F.col("_key") == F.col("_own"), "left_anti").select(F.col("_key").alias(key), F.lit("not found").alias("error"))
    return table.join(asked, F.col(key) == F.col("_key"), "left_anti"), missing


# --- sessions: id, user_id, session_token, created_at, expires_at, last_activity_at, is_active --------


def new_sessions(sessions: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    return created(sessions, rows, now, last_activity_at=now, is_active=F.lit(True))


def by_token(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    """The active session of each token; a session that was revoked isn't found, one that ran out is."""
    return looked_up(sessions.where("is_active"), tokens, ["session_token"], "session")


def active_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that are active and have not run out, those of each user from the last activity on."""
    return sessions.where(F.col("is_active") & (F.col("expires_at") > now)).orderBy("user_id", F.col("last_activity_at").desc(), "id")


def seen(sessions: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Sessions after activity: active ones get the time."""
    hit = sessions.join(ids.select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct(), F.col("id") == F.col("_id"), "left")
    return changed(hit, F.coalesce("_hit", F.lit(False)) & F.col("is_active"), {"last_activity_at": now}).select(*sessions.columns)


def revoked(sessions: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Sessions after those of some ids, tokens or users (``key``) are revoked."""
    hit = sessions.join(keys.select(F.col(key).alias("_key"), F.lit(True).alias("_hit")).distinct(), F.col(key) == F.col("_key"), "left")
    return changed(hit, F.coalesce("_hit", F.lit(False)), {"is_active": F.lit(False)}).select(*sessions.columns)


def without_expired(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions but those whose time has passed; one without an end stays."""
    return sessions.where(F.coalesce(F.col("expires_at") >= now, F.lit(True)))


# --- configurations ------------------------------------------------------------------------------------


def by_provider(configurations: DataFrame, keys: DataFrame) -> DataFrame:
    """One configuration of each organization and platform asked for, the first by id; NULLs and no error where there is none."""
    first = configurations.groupBy("organization_id", "platform_type").agg(F.min(F.struct("id", *[c for c in configurations.columns if c not in ("id", "organization_id", "platform_type")])).alias("x"))
    return looked_up(first.select("organization_id", "platform_type", "x.*"), keys, ["organization_id", "platform_type"], "configuration", required=False)


def of_user(configurations: DataFrame, users: DataFrame) -> DataFrame:
    """The configurations of users, by the organization's name."""
    asked = users.select(F.col("user_id").alias("_user")).distinct()
    return configurations.join(asked, F.col("user_id") == F.col("_user"), "left_semi").orderBy("user_id", F.col("organization_name").asc_nulls_last(), "id")


def synchronised(configurations: DataFrame, syncs: DataFrame, now: Column) -> DataFrame:
    """Configurations with the times of the last and next synchronisation (id, last_sync_at, next_sync_at)."""
    return updated(configurations, syncs.select("id", "last_sync_at", "next_sync_at"), now)[0]


def connected(configurations: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Configurations after connection; the first time of it stays."""
    hit = configurations.join(ids.select(F.col("id").alias("_id"), F.lit(True).alias("_hit")).distinct(), F.col("id") == F.col("_id"), "left")
    values = {"is_connected": F.lit(True), "connected_at": F.coalesce("connected_at", now), "updated_at": now}
    return changed(hit, F.coalesce("_hit", F.lit(False)), values).select(*configurations.columns)


# --- activity of issues: id, issue_id, user_id, activity_type, details, metadata, created_at -------------


def activity(events: DataFrame, kind: str, details: Column, metadata: Column, now: Column) -> DataFrame:
    """Log rows of events (id, issue_id, user_id and what the expressions need)."""
    return events.select("id", "issue_id", "user_id", F.lit(kind).alias("activity_type"), details.alias("details"), metadata.alias("metadata"), now.alias("created_at"))


def status_changes(events: DataFrame, now: Column) -> DataFrame:
    """Log rows of changes from old_status to new_status, with the reason if there is one; quotes in it are escaped."""
    told = F.to_json(F.struct("old_status", "new_status", F.nullif("reason", F.lit("")).alias("resolution_reason")))
    return activity(events, "status_changed", F.concat(F.lit("Status changed from "), "old_status", F.lit(" to "), "new_status"), told, now)


def detected(events: DataFrame, now: Column) -> DataFrame:
    return activity(events, "created", F.lit("Issue detected during analysis"), F.lit(None).cast("string"), now)


def assigned(events: DataFrame, now: Column) -> DataFrame:
    """Log rows of assignments to assigned_to_user_id by user_id."""
    return activity(events, "assigned", F.lit("Issue assigned to team member"), F.to_json(F.struct("assigned_to_user_id")), now)


def unassigned(events: DataFrame, now: Column) -> DataFrame:
    return activity(events, "unassigned", F.lit("Issue unassigned"), F.to_json(F.struct("old_user_id")), now)


def told_activity(log: DataFrame, users: DataFrame) -> DataFrame:
    """Log rows with the name and mail of who acted, ``System`` where nobody is known, by issue and time."""
    named = users.select(F.col("id").alias("_user"), "full_name", "email")
    joined = log.join(named, F.col("user_id") == F.col("_user"), "left")
    return joined.select(*log.columns, F.coalesce("full_name", F.lit("System")).alias("user_name"), F.coalesce("email", F.lit("")).alias("user_email")).orderBy("issue_id", "created_at", "id")


# --- cache: cache_key, value, stored_at ------------------------------------------------------------------


def stored(cached: DataFrame, results: DataFrame, now: Column, days: int) -> DataFrame:
    """The cache after results (cache_key, value): an entry that has not run out stays, the others are replaced, and what ran out is gone.

    Of several results for one key the greatest is kept.
    """
    valid = cached.where(F.col("stored_at") + F.make_interval(days=F.lit(days)) > now)
    new = results.groupBy("cache_key").agg(F.max("value").alias("value")).withColumn("stored_at", now)
    return valid.unionByName(new.join(valid.select(F.col("cache_key").alias("_key")).distinct(), F.col("cache_key") == F.col("_key"), "left_anti"))
