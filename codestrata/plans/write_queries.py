"""Queries on writes: insert, touch, resolve, reconcile, links, comments and caches (WRT, SNK, SET)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import entities, sinks, writes
from codestrata.plans.bindings import folded_sql, held, held_sql, ref_sql, view
from codestrata.plans.registry import Registry
from codestrata.tables import folded, read, reference

registry = Registry()

STORE = (
    "user_id", "repository_id", "analysis_run_id", "file_path", "line_number", "column_number", "issue_type", "severity", "tool_name", "tool_rule_id", "status",
    "code_snippet", "surrounding_context", "fingerprint_hash", "resolved_at", "resolution_reason", "external_id", "external_platform", "external_url",
    "jira_sync_status", "trello_sync_status", "created_at", "updated_at",
)
TOOL = "complexity"
NOW_US = 1_743_465_600_000_000  # 2025-04-01
_NOW = "make_timestamp(1743465600000000)::timestamptz"
S_SQL = held_sql("technical_debt_issues", *STORE)


def now() -> Column:
    """The time of the writes, fixed so that both sides agree."""
    return F.timestamp_micros(F.lit(NOW_US))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir, "technical_debt_issues", *STORE)


# A batch of findings: the newest delivery of each repository, in which a finding may occur twice.
_ORDINAL = "lpad(epoch_us(s.loaded_at)::varchar, 20, '0') || sha256(concat_ws('|', file_path, line_number, severity, issue_type, tool_rule_id, status))"
B_SQL = f"""(select {_ORDINAL} as ordinal, sha256(s.repository_id || '|' || {folded_sql('fingerprint_hash')} || '|' || {_ORDINAL}) id, s.repository_id, 'run-' || strftime(d, '%Y-%m-%d') analysis_run_id,
  file_path, line_number, issue_type, {folded_sql('severity')} severity, tool_rule_id, {folded_sql('fingerprint_hash')} fingerprint_hash
  from issue_snapshots s join (select repository_id, max(snapshot_date) d from issue_snapshots group by 1) n on s.repository_id = n.repository_id and s.snapshot_date = n.d)"""


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "issue_snapshots")
    newest = rows.groupBy(F.col("repository_id").alias("r")).agg(F.max("snapshot_date").alias("d"))
    ordinal = F.concat(F.lpad(F.unix_micros("loaded_at").cast("string"), 20, "0"), F.sha2(F.concat_ws("|", "file_path", "line_number", "severity", "issue_type", "tool_rule_id", "status"), 256))
    named = rows.join(newest, (F.col("repository_id") == F.col("r")) & (F.col("snapshot_date") == F.col("d"))).withColumn("ordinal", ordinal).withColumn("fp", folded("fingerprint_hash"))
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("int")
    own = {
        "id": F.sha2(F.concat_ws("|", "repository_id", "fp", "ordinal"), 256), "user_id": none, "repository_id": F.col("repository_id"), "analysis_run_id": F.concat(F.lit("run-"), F.date_format("d", "yyyy-MM-dd")),
        "file_path": F.col("file_path"), "line_number": F.col("line_number"), "column_number": zero, "issue_type": F.col("issue_type"), "severity": folded("severity"), "tool_name": F.lit(TOOL), "tool_rule_id": F.col("tool_rule_id"),
        "status": F.lit("open"), "code_snippet": none, "surrounding_context": none, "fingerprint_hash": F.col("fp"), "resolved_at": F.lit(None).cast("timestamp"), "resolution_reason": none, "external_id": none, "external_platform": none,
        "external_url": none, "jira_sync_status": F.lit("pending"), "trello_sync_status": F.lit("pending"), "created_at": now(), "updated_at": now(),
    }
    return named.select(*[own[c].alias(c) for c in ("id", *STORE)], "ordinal")


def _v(sql: str) -> str:
    return view(sql, s=S_SQL, b=B_SQL)


_PLACE = " and ".join(f"{{0}}.{c} is not distinct from {{1}}.{c}" for c in writes.AT)
_KNOWN = f"exists (select 1 from s where {_PLACE.format('s', 'b')} and s.status in ('open', 'ignored'))"


@registry.add("wrt_01_new_issues", _v(f"select b.id from b where not {_KNOWN}"))
def wrt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.new_issues(store(spark, sf_dir), batch(spark, sf_dir).drop("ordinal")).select("id")


_TOUCHED = f"select s.id, case when t.run is not null then t.run else s.analysis_run_id end as analysis_run_id, epoch_us(case when t.run is not null then {_NOW} else s.updated_at end) as updated_us from s left join (select {', '.join(writes.AT)}, max(analysis_run_id) run from b group by all) t on s.status in ('open', 'ignored') and {_PLACE.format('s', 't')}"


@registry.add("wrt_02_batch_create", _v(f"{_TOUCHED} union all select b.id, b.analysis_run_id, {NOW_US} from b where not {_KNOWN}"))
def wrt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = writes.batch_create(store(spark, sf_dir), batch(spark, sf_dir).drop("ordinal"), now())
    return made.select("id", "analysis_run_id", F.unix_micros("updated_at").alias("updated_us"))


@registry.add("wrt_03_touch", _v(_TOUCHED))
def wrt_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = writes.touched(store(spark, sf_dir), batch(spark, sf_dir), now())
    return made.select("id", "analysis_run_id", F.unix_micros("updated_at").alias("updated_us"))


_LAST_RUN = "(select repository_id, max(analysis_run_id) run from s group by 1)"


@registry.add("wrt_04_resolve_missing", view(f"select s.id, coalesce(s.status = 'open' and s.analysis_run_id <> l.run, false) as resolved from s left join {_LAST_RUN} l on s.repository_id = l.repository_id", s=S_SQL))
def wrt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open issues that are not of their repository's greatest run become resolved."""
    rows = store(spark, sf_dir)
    last = rows.groupBy(F.col("repository_id").alias("r")).agg(F.max("analysis_run_id").alias("run"))
    joined = rows.join(last, F.col("repository_id") == F.col("r"), "left").withColumn("was", F.col("status"))
    made = writes.resolve_missing(joined, F.col("run"), now(), "not detected")
    return made.select("id", F.coalesce((F.col("was") == "open") & (F.col("status") == "resolved"), F.lit(False)).alias("resolved"))


@registry.add(
    "wrt_05_reconcile",
    view(
        f"""select id, status, analysis_run_id, line_number, coalesce(resolution_reason, '') as resolution_reason, epoch_us(updated_at) as updated_us from (
  select u.* replace (case when gone then 'resolved' else status end as status, case when gone then 'fixed_in_code' else resolution_reason end as resolution_reason, case when gone then {_NOW} else updated_at end as updated_at) from (
    select u.*, coalesce(tool_name = '{TOOL}' and status = 'open', false) and not coalesce(analysis_run_id = cur.run, false) gone from u left join cur on u.repository_id = cur.repository_id) u)""",
        s=S_SQL,
        b=B_SQL,
        f="(select repository_id, fingerprint_hash, min_by(id, ordinal) id, max_by(struct_pack(r := analysis_run_id, l := line_number), ordinal) v from b group by all)",
        cur="(select repository_id, min_by(analysis_run_id, ordinal) run from b group by 1)",
        u=f"""(select coalesce(s.id, f.id) id, coalesce(s.repository_id, f.repository_id) repository_id, case when s.id is null then '{TOOL}' else s.tool_name end tool_name, case when s.id is null then 'open' else s.status end status,
  case when f.id is not null then f.v.r else s.analysis_run_id end analysis_run_id, case when f.id is not null then f.v.l else s.line_number end line_number, s.resolution_reason, case when f.id is not null then {_NOW} else s.updated_at end updated_at
  from s full join f on s.status = 'open' and s.repository_id = f.repository_id and s.fingerprint_hash = f.fingerprint_hash)""",
    ),
)
def wrt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = writes.reconcile(store(spark, sf_dir), batch(spark, sf_dir), TOOL, now())
    return made.select("id", "status", "analysis_run_id", "line_number", F.coalesce("resolution_reason", F.lit("")).alias("resolution_reason"), F.unix_micros("updated_at").alias("updated_us"))


@registry.add("wrt_06_resolve_stale", _v("select s.id, coalesce(s.status = 'open' and exists (select 1 from b where b.repository_id = s.repository_id and b.file_path = s.file_path) and not exists (select 1 from issue_comments c where c.issue_id = s.id), false) as resolved from s"))
def wrt_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open issues in files of the batch become resolved, save those that somebody commented on."""
    rows = store(spark, sf_dir).withColumn("was", F.col("status"))
    found = read(spark, sf_dir, "issue_comments").select(F.col("issue_id").alias("id")).where("id is not null")
    made = writes.resolve_stale(rows, batch(spark, sf_dir).select("repository_id", "file_path"), found, now())
    return made.select("id", F.coalesce((F.col("was") == "open") & (F.col("status") == "resolved"), F.lit(False)).alias("resolved"))


@registry.add("wrt_07_replace_open", _v(f"select id, status from s where not coalesce(status = 'open' and tool_name = '{TOOL}', false) union all select id, 'open' from b"))
def wrt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.replace_open(store(spark, sf_dir), batch(spark, sf_dir).drop("ordinal"), TOOL).select("id", "status")


@registry.add("wrt_08_external_link", view("select id, case when severity = 'critical' then 'EXT-' || substr(id, 1, 8) else coalesce(external_id, '') end as external_id from s", s=S_SQL))
def wrt_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All critical issues are linked to a tracker."""
    rows = store(spark, sf_dir)
    links = rows.where("severity = 'critical'").select("id", F.concat(F.lit("EXT-"), F.substring("id", 1, 8)).alias("external_id"), F.lit("jira").alias("external_platform"), F.lit("").alias("external_url"))
    return writes.linked(rows, links, now()).select("id", F.coalesce("external_id", F.lit("")).alias("external_id"))


@registry.add("wrt_09_pending_syncs", view("select id from s where status = 'open' and jira_sync_status = 'pending' and severity in ('critical', 'high')", s=S_SQL))
def wrt_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.pending_syncs(store(spark, sf_dir), "jira", ["critical", "high"]).select("id")


_COMMENT = ("issue_id", "user_id", "created_at", "deleted_at")


@registry.add("wrt_10_soft_delete", view("select id, deleted_at is not null or coalesce(u.is_active = false, false) as deleted from (select c.*, u.is_active from c left join users u on c.user_id = u.id) u", c=held_sql("issue_comments", *_COMMENT)))
def wrt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of inactive users are deleted softly."""
    comments = held(spark, sf_dir, "issue_comments", *_COMMENT)
    inactive = read(spark, sf_dir, "users").where("is_active = false").select(F.col("id").alias("uid"))
    ids = comments.join(inactive, F.col("user_id") == F.col("uid"), "left_semi").select("id")
    return writes.soft_deleted(comments, ids, now()).select("id", F.col("deleted_at").isNotNull().alias("deleted"))


# Sessions and configurations: one session for each user, which runs 31 days from the last login, and a configuration for each repository.
_SESSIONS = "(select 's-' || id as id, id as user_id, sha256(id) as session_token, last_login_at as created_at, last_login_at + interval 31 day as expires_at, updated_at as last_activity_at, is_active from users)"
_CONFIGS = "(select id, user_id, organization_id, full_name as organization_name, platform_type, primary_language as settings, last_commit_date as last_sync_at, cast(null as timestamptz) as next_sync_at, is_private as is_connected, case when is_fork then created_at end as connected_at, created_at, updated_at from user_repositories)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "users").select(
        F.concat(F.lit("s-"), "id").alias("id"), F.col("id").alias("user_id"), F.sha2("id", 256).alias("session_token"), F.col("last_login_at").alias("created_at"),
        (F.col("last_login_at") + F.expr("interval 31 days")).alias("expires_at"), F.col("updated_at").alias("last_activity_at"), "is_active",
    )


def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "user_repositories").select(
        "id", "user_id", "organization_id", F.col("full_name").alias("organization_name"), "platform_type", F.col("primary_language").alias("settings"), F.col("last_commit_date").alias("last_sync_at"),
        F.lit(None).cast("timestamp").alias("next_sync_at"), F.col("is_private").alias("is_connected"), F.when(F.col("is_fork"), F.col("created_at")).alias("connected_at"), "created_at", "updated_at",
    )


@registry.add("wrt_11_last_sync", view(f"select c.id, coalesce(r.at, epoch_us(c.last_sync_at)) as last_sync_us, r.at + 3600000000 as next_sync_us, case when r.id is not null then {NOW_US} else epoch_us(c.updated_at) end as updated_us from c left join (select repository_id id, max(epoch_us(completed_at)) as at from analysis_runs where completed_at is not null group by 1) r on c.id = r.id", c=_CONFIGS))
def wrt_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configuration with the end of its last run as the last synchronisation, the next one an hour later."""
    last = read(spark, sf_dir, "analysis_runs").where("completed_at is not null").groupBy(F.col("repository_id").alias("id")).agg(F.max("completed_at").alias("last_sync_at")).withColumn("next_sync_at", F.col("last_sync_at") + F.expr("interval 1 hour"))
    made = entities.synchronised(configurations(spark, sf_dir), last, now())
    return made.select("id", F.unix_micros("last_sync_at").alias("last_sync_us"), F.unix_micros("next_sync_at").alias("next_sync_us"), F.unix_micros("updated_at").alias("updated_us"))


@registry.add("wrt_11_connected", view(f"select id, is_connected or platform_type = 'github' as is_connected, coalesce(epoch_us(connected_at), case when platform_type = 'github' then {NOW_US} end) as connected_us from c", c=_CONFIGS))
def wrt_11_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations after those of one platform are connected."""
    rows = configurations(spark, sf_dir)
    return entities.connected(rows, rows.where("platform_type = 'github'"), now()).select("id", "is_connected", F.unix_micros("connected_at").alias("connected_us"))


@registry.add("wrt_11_updated", view("select id, coalesce(settings, '') as settings, '' as error from (select id, case when platform_type = 'gitlab' then 'strict' else settings end as settings from c) union all select distinct user_config_id, '', 'not found' from analysis_runs where user_config_id is not null and user_config_id not in (select id from c)", c=_CONFIGS))
def wrt_11_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations of one platform with other settings; those that runs name and nobody keeps are told as errors."""
    rows = configurations(spark, sf_dir)
    wanted = rows.where("platform_type = 'gitlab'").select("id").unionByName(read(spark, sf_dir, "analysis_runs").where("user_config_id is not null").select(F.col("user_config_id").alias("id")))
    made, missing = entities.updated(rows, wanted.withColumn("settings", F.lit("strict")), now())
    return made.select("id", F.coalesce("settings", F.lit("")).alias("settings"), F.lit("").alias("error")).unionByName(missing.select("id", F.lit("").alias("settings"), "error"))


@registry.add("wrt_11_created_and_removed", view("select id from c where not is_private_ union all select 'new-' || id from c where is_private_", c=_CONFIGS.replace("is_private as is_connected", "is_private as is_connected, coalesce(is_private, false) as is_private_")))
def wrt_11_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected configurations are removed and others created in their place."""
    rows = configurations(spark, sf_dir)
    gone = rows.where("is_connected").select("id")
    kept, _ = entities.removed(rows, gone)
    return entities.created(kept, gone.select(F.concat(F.lit("new-"), "id").alias("id")), now(), is_connected=F.lit(False)).select("id")


@registry.add("flt_14_by_provider", view("select k.organization_id, k.platform_type, min(c.id) as id from (select distinct organization_id, p.platform_type from c, (values ('github'), ('gitlab'), ('other')) p(platform_type) where organization_id is not null) k left join c on k.organization_id = c.organization_id and k.platform_type = c.platform_type group by 1, 2", c=_CONFIGS))
def flt_14_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration of each organization for each of three platforms; none is no error."""
    rows = configurations(spark, sf_dir)
    keys = rows.where("organization_id is not null").select("organization_id", F.explode(F.array(*[F.lit(p) for p in ("github", "gitlab", "other")])).alias("platform_type"))
    return entities.by_provider(rows, keys).select("organization_id", "platform_type", "id")


@registry.add("flt_14_by_token", view("select k.session_token, s.user_id, case when s.id is null then 'session not found' end as error from (select session_token from s union select sha256('none-' || user_id) from s) k left join (select * from s where is_active) s on k.session_token = s.session_token", s=_SESSIONS))
def flt_14_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by their tokens; unknown tokens and those of inactive sessions are errors."""
    rows = sessions(spark, sf_dir)
    tokens = rows.select("session_token").unionByName(rows.select(F.sha2(F.concat(F.lit("none-"), "user_id"), 256).alias("session_token")))
    return entities.by_token(rows, tokens).select("session_token", "user_id", "error")


@registry.add("flt_14_required", view(f"select run as id, r.status, case when r.id is null then 'run not found' end as error from (select distinct {ref_sql('analysis_run_id')} run from technical_debt_issues) k left join r on k.run = r.id where run is not null", r=held_sql("analysis_runs", "status")))
def flt_14_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of each issue; one that is missing is an error."""
    keys = read(spark, sf_dir, "technical_debt_issues").select(reference("analysis_run_id").alias("id")).where("id is not null")
    return entities.looked_up(held(spark, sf_dir, "analysis_runs", "status").select("id", "status"), keys, ["id"], "run")


@registry.add("wrt_08_by_link", view("select k.external_platform, k.external_id, s.id from (select distinct external_platform, external_id from s where external_id is not null and external_platform is not null union select distinct 'other', external_id from s where external_id is not null) k left join s on k.external_platform = s.external_platform and k.external_id = s.external_id", s=S_SQL))
def wrt_08_by_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by their links to trackers, and on a tracker that has none."""
    rows = store(spark, sf_dir).select("external_platform", "external_id", "id")
    linked = rows.where("external_id is not null")
    keys = linked.select("external_platform", "external_id").where("external_platform is not null").unionByName(linked.select(F.lit("other").alias("external_platform"), "external_id"))
    return entities.looked_up(rows, keys, ["external_platform", "external_id"], "issue", required=False).drop("error")


@registry.add("wrt_12_sessions", view(f"select id, user_id from s where is_active and epoch_us(expires_at) > {NOW_US}", s=_SESSIONS))
def wrt_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are active and have not run out."""
    return entities.active_sessions(sessions(spark, sf_dir), now()).select("id", "user_id")


@registry.add("wrt_12_revoked", f"select 's-' || u.id as id, u.is_active and not coalesce(u.is_admin, false) and not coalesce(u.mfa_enabled, false) and not (u.type_of_login is not distinct from 'google') as is_active, case when u.is_active and not coalesce(u.is_admin, false) and not coalesce(u.mfa_enabled, false) and not (u.type_of_login is not distinct from 'google') and u.email_verified then {NOW_US} else epoch_us(u.updated_at) end as last_activity_us from users u")
def wrt_12_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions revoked by id, by token and by user; verified users are then active in those that are left."""
    users = read(spark, sf_dir, "users")
    rows = entities.revoked(sessions(spark, sf_dir), users.where("is_admin").select(F.concat(F.lit("s-"), "id").alias("id")))
    rows = entities.revoked(rows, users.where("mfa_enabled").select(F.sha2("id", 256).alias("session_token")), "session_token")
    rows = entities.revoked(rows, users.where("type_of_login = 'google'").select(F.col("id").alias("user_id")), "user_id")
    rows = entities.seen(rows, users.where("email_verified").select(F.concat(F.lit("s-"), "id").alias("id")), now())
    return rows.select("id", "is_active", F.unix_micros("last_activity_at").alias("last_activity_us"))


@registry.add("wrt_12_without_expired", view(f"select id from s where epoch_us(expires_at) >= {NOW_US} or expires_at is null union all select 'new-' || user_id from s where expires_at is null", s=_SESSIONS))
def wrt_12_without_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions but those that ran out, and new ones for users who never logged in."""
    rows = sessions(spark, sf_dir)
    new = rows.where("expires_at is null").select(F.concat(F.lit("new-"), "user_id").alias("id"), "user_id")
    return entities.new_sessions(entities.without_expired(rows, now()), new, now()).select("id")


_LOGGED = "(select id, user_id, status, coalesce(resolution_reason, '') reason, assigned_to_user_id a from s)"


@registry.add(
    "wrt_10_activity_log",
    view(
        """select l.*, coalesce(u.full_name, 'System') as user_name from (
  select id, user_id, 'status_changed' as activity_type, 'Status changed from open to ' || status as details, '{"old_status":"open","new_status":"' || status || '"' || case when reason = '' then '' else ',"resolution_reason":"' || reason || '"' end || '}' as metadata from l where status <> 'open'
  union all select id, user_id, 'created', 'Issue detected during analysis', '' from l
  union all select id, user_id, 'assigned', 'Issue assigned to team member', '{"assigned_to_user_id":"' || a || '"}' from l where a is not null
  union all select id, user_id, 'unassigned', 'Issue unassigned', '{"old_user_id":"' || a || '"}' from l where a is not null) l left join users u on l.user_id = u.id""",
        s=held_sql("technical_debt_issues", "user_id", "status", "resolution_reason", "assigned_to_user_id"),
        l=_LOGGED,
    ),
)
def wrt_10_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is logged on each issue: its detection, its status if it left open, its assignment and the end of it."""
    rows = held(spark, sf_dir, "technical_debt_issues", "user_id", "status", "resolution_reason", "assigned_to_user_id").withColumn("issue_id", F.col("id"))
    moved = rows.where("status <> 'open'").select("id", "issue_id", "user_id", F.lit("open").alias("old_status"), F.col("status").alias("new_status"), F.col("resolution_reason").alias("reason"))
    given = rows.where("assigned_to_user_id is not null").withColumn("old_user_id", F.col("assigned_to_user_id"))
    log = entities.status_changes(moved, now()).unionByName(entities.detected(rows, now())).unionByName(entities.assigned(given, now())).unionByName(entities.unassigned(given, now()))
    return entities.told_activity(log, read(spark, sf_dir, "users")).select("id", "user_id", "activity_type", "details", F.coalesce("metadata", F.lit("")).alias("metadata"), "user_name")


@registry.add("set_01_union_all", "select 'issue' as kind, id from technical_debt_issues union all select 'comment', id from issue_comments")
def set_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (("issue", "technical_debt_issues"), ("comment", "issue_comments"))
    parts = [read(spark, sf_dir, t).select(F.lit(k).alias("kind"), "id") for k, t in kinds]
    return parts[0].unionByName(parts[1])


_TEXT = ("severity", "file_path", "line_number", "tool_rule_id", "message")


@registry.add("snk_02_text_table", view("select id, upper(severity) as severity, coalesce(file_path, '') || case when line_number is null then '' else ':' || line_number end as location, coalesce(nullif(tool_rule_id, ''), 'N/A') as rule, coalesce(message, '') as message from h", h=held_sql("technical_debt_issues", *_TEXT)))
def snk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.text_rows(held(spark, sf_dir, "technical_debt_issues", *_TEXT))


@registry.add("snk_04_cache_misses", "select doc_id, 'analysis:v1:lines:' || sha256(text) as cache_key from documents where text is not null and sha256(text) not in (select sha256(text) from documents where text is not null and source = 'wiki_page' and created_at < timestamptz '2025-02-15 00:00:00+00')")
def snk_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose result no early wiki page has already put into the cache."""
    documents = read(spark, sf_dir, "documents").where("text is not null")
    early = documents.where(F.col("created_at") < F.lit("2025-02-15 00:00:00").cast("timestamp")).where("source = 'wiki_page'")
    cached = sinks.with_cache_key(early, "lines", "text").select("cache_key").withColumn("stored_at", now())
    return sinks.cache_misses(sinks.with_cache_key(documents, "lines", "text"), cached, now()).select("doc_id", "cache_key")


@registry.add(
    "snk_04_cache_stored",
    view(
        "select cache_key, value, stored_us from o union all select cache_key, max(value), 1743465600000000 from n where cache_key not in (select cache_key from o) group by 1",
        o="(select 'analysis:v1:lines:' || sha256(text) as cache_key, max('old') as value, max(epoch_us(created_at)) as stored_us from documents where text is not null and source = 'wiki_page' group by 1 having max(epoch_us(created_at)) > 1743465600000000 - 7 * 86400000000)",
        n="(select 'analysis:v1:lines:' || sha256(text) as cache_key, length(text)::varchar as value from documents where text is not null)",
    ),
)
def snk_04_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of line counts after all documents: entries of the last week stay, others are replaced or gone."""
    documents = sinks.with_cache_key(read(spark, sf_dir, "documents").where("text is not null"), "lines", "text")
    cached = documents.where("source = 'wiki_page'").groupBy("cache_key").agg(F.lit("old").alias("value"), F.max("created_at").alias("stored_at"))
    made = entities.stored(cached, documents.select("cache_key", F.length("text").cast("string").alias("value")), now(), sinks.CACHE_DAYS)
    return made.select("cache_key", "value", F.unix_micros("stored_at").alias("stored_us"))
