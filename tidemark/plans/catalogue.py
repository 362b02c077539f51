"""All queries of the engine's own operators: a plan, and SQL for DuckDB that gives the same rows.

Each entry of ``_QUERIES`` is (function of a table getter, SQL text or None). In the SQL, ``{jobs}`` and
the other bindings are expanded, and stand in parentheses.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import codec, requests
from ..operators import adaptive, changes, chunking, dedup, index, jobs, manifest, mutate, rounds
from ..streaming import stability
from .bindings import duck, spark_table

FLAGSHIP = "plan_summary"
NOW = "TIMESTAMP '1998-01-01 00:00:00'"
_QUERIES: dict[str, tuple] = {}


def now():
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


PUBLIC = "job_id NOT LIKE '%\\_final' ESCAPE '\\'"
ACTIVE = "('pending','syncing','paused')"


@query(f"SELECT count(*) AS total, count_if(status='pending')::BIGINT AS pending, count_if(status='syncing')::BIGINT AS running, count_if(status='paused')::BIGINT AS paused, count_if(status='completed')::BIGINT AS completed, count_if(status='failed')::BIGINT AS failed, count_if(status='cancelled')::BIGINT AS cancelled FROM ({{jobs}}) WHERE {PUBLIC}")
def job_stats(t):
    return jobs.stats(jobs.counts_by_status(t("jobs"), public=True))


@query("SELECT status, count(*) AS n FROM ({jobs}) GROUP BY status")
def counts_by_status(t):
    return jobs.counts_by_status(t("jobs"))


@query(f"SELECT job_id, status, created_at FROM ({{jobs}}) WHERE {PUBLIC} ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 100")
def jobs_page(t):
    return jobs.page(t("jobs"), 2, 50, public=True).select("job_id", "status", "created_at")


@query(f"SELECT job_id, dest_path FROM ({{jobs}}) WHERE status IN {ACTIVE}")
def active_destinations(t):
    return jobs.active_destinations(t("jobs"))


@query("SELECT job_id, status, created_at FROM ({jobs}) WHERE status IN ('completed','failed','cancelled')")
def terminal_jobs(t):
    return jobs.listed(jobs.with_status(t("jobs"), jobs.TERMINAL)).select("job_id", "status", "created_at")


SNAPSHOT = """SELECT coalesce(p.job_id, r.job_id) AS job_id, CASE WHEN r.job_id IS NOT NULL THEN r.status ELSE p.status END AS status,
 CASE WHEN r.job_id IS NOT NULL THEN r.current_size ELSE p.current_size END AS current_size, CASE WHEN r.job_id IS NOT NULL THEN r.error_message ELSE p.error_message END AS error_message,
 CASE WHEN r.job_id IS NOT NULL THEN r.round_id ELSE p.round_id END AS round_id, coalesce(p.job_type, 'once') AS job_type, coalesce(p.priority, 0) AS priority, coalesce(p.created_at, r.created_at) AS created_at
 FROM ({jobs}) p FULL OUTER JOIN ({runtime}) r ON p.job_id = r.job_id"""
SNAPSHOT_COLUMNS = ["job_id", "status", "current_size", "error_message", "round_id", "job_type", "priority", "created_at"]


@query(SNAPSHOT)
def jobs_snapshot(t):
    return jobs.snapshot(t("jobs"), t("runtime")).select(SNAPSHOT_COLUMNS)


@query(f"SELECT * FROM ({SNAPSHOT}) s ORDER BY created_at DESC, job_id LIMIT 40 OFFSET 40")
def jobs_merged_page(t):
    return jobs.page(jobs.snapshot(t("jobs"), t("runtime")), 1, 40).select(SNAPSHOT_COLUMNS)


@query(f"""WITH r AS (SELECT regexp_replace(job_id, '_final$', '') AS id, max_by(status, job_id LIKE '%\\_final' ESCAPE '\\') AS live FROM ({{runtime}}) GROUP BY 1),
 j AS (SELECT job_id AS id, status FROM ({{jobs}}) WHERE {PUBLIC}) SELECT coalesce(live, status) AS status, count(*) AS n FROM j FULL OUTER JOIN r ON j.id = r.id GROUP BY 1""")
def status_counts_overlay(t):
    return jobs.status_counts_overlay(t("jobs"), t("runtime"))


PERCENT = "CASE WHEN {1} > 0 THEN cast(floor(least({0}, {1})::DOUBLE / {1}::DOUBLE * 100.0) AS INT) ELSE 0 END"


@query(f"""WITH v AS (SELECT j.job_id, j.job_type, coalesce(f.status, r.status, j.status) AS status,
 CASE WHEN f.job_id IS NOT NULL THEN f.current_size WHEN r.job_id IS NOT NULL THEN r.current_size ELSE j.current_size END AS cur,
 CASE WHEN f.job_id IS NOT NULL THEN f.total_size WHEN r.job_id IS NOT NULL THEN r.total_size ELSE j.total_size END AS tot,
 coalesce(r.round_id, greatest(f.round_id, 1), j.round_id, 0) AS round_id, CASE WHEN r.job_id IS NOT NULL THEN r.is_last_round WHEN f.job_id IS NOT NULL THEN true ELSE coalesce(j.is_last_round, false) END AS is_last_round
 FROM (SELECT * FROM ({{jobs}}) WHERE {PUBLIC}) j LEFT JOIN ({{runtime}}) r ON j.job_id = r.job_id LEFT JOIN ({{runtime}}) f ON j.job_type = 'sync' AND f.job_id = j.job_id || '_final')
 SELECT job_id, status, {PERCENT.format('cur', 'tot')} AS progress, round_id, is_last_round, CASE WHEN job_type = 'sync' THEN CASE WHEN is_last_round THEN 'Final Round ' ELSE 'Round ' END || round_id END AS badge FROM v""")
def public_status_view(t):
    return jobs.public_view(t("jobs"), t("runtime"))


@query("""WITH j AS ({jobs}), l AS (SELECT DISTINCT job_id FROM ({job_retries}) WHERE retry_count < max_retries),
 x AS (SELECT j.*, f.status AS fs, j.job_id IN (SELECT job_id FROM l) AS own, (j.job_id || '_final') IN (SELECT job_id FROM l) AS fl, j.job_type = 'sync' AND j.job_id NOT LIKE '%\\_final' ESCAPE '\\' AS sy
 FROM j LEFT JOIN (SELECT * FROM j WHERE job_id LIKE '%\\_final' ESCAPE '\\') f ON f.job_id = j.job_id || '_final')
 SELECT job_id, status IN ('pending','syncing','paused') OR (status = 'failed' AND (own OR (sy AND (coalesce(fs IN ('pending','syncing','paused'), false) OR (coalesce(fs = 'failed', false) AND fl))))) AS can_cancel,
 sy AND NOT coalesce(fs IN ('pending','syncing','paused'), false) AND NOT fl AND (status IN ('pending','syncing') OR (status = 'failed' AND (own OR coalesce(fs = 'failed', false)))) AS can_finalize FROM x""")
def job_permissions(t):
    return jobs.permissions(t("jobs"), t("job_retries"))


@query(f"SELECT job_id, retry_count, next_retry_at FROM ({{job_retries}}) WHERE retry_count < max_retries AND next_retry_at <= {NOW} ORDER BY next_retry_at, job_id LIMIT 100")
def due_retries(t):
    return jobs.due_retries(t("job_retries"), now()).select("job_id", "retry_count", "next_retry_at")


@query(f"""SELECT r.job_id, CASE WHEN status IN ('completed','cancelled') THEN 'drop' WHEN status IN {ACTIVE} THEN 'wait' WHEN status IS NULL THEN 'drop' ELSE 'enqueue' END AS action
 FROM ({{job_retries}}) r LEFT JOIN ({{jobs}}) j ON r.job_id = j.job_id WHERE retry_count < max_retries AND next_retry_at <= {NOW}""")
def retry_actions(t):
    return jobs.retry_actions(t("job_retries"), t("jobs"), now())


@query("SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM ({job_retries}) WHERE retry_count < max_retries) THEN 'schedule' ELSE 'purge' END AS action FROM ({jobs}) WHERE status = 'failed'")
def failure_actions(t):
    return jobs.failure_actions(t("jobs"), t("job_retries"))


@query(f"SELECT job_id, status FROM ({{jobs}}) WHERE NOT (status IN ('completed','failed','cancelled') AND updated_at < {NOW})")
def retention(t):
    return mutate.retention(t("jobs"), {}, now())["jobs"].select("job_id", "status")


@query(f"SELECT * FROM ({{job_retries}}) WHERE job_id NOT IN (SELECT job_id FROM ({{jobs}}) WHERE status IN ('completed','failed','cancelled') AND updated_at < {NOW})")
def retention_children(t):
    return mutate.retention(t("jobs"), {"job_retries": t("job_retries")}, now())["job_retries"]


@query(f"SELECT k, updated_at FROM (SELECT 'job-' || l_orderkey AS k, max(l_shipdate) AS updated_at FROM {{lineitem}} GROUP BY 1) x WHERE NOT (updated_at < {NOW}) OR k IN (SELECT job_id FROM ({{jobs}}))")
def orphans_removed(t):
    keys = t("lineitem").groupBy(F.concat(F.lit("job-"), F.col("l_orderkey").cast("string")).alias("job_id")).agg(F.max("l_shipdate").alias("updated_at"))
    return mutate.orphans_removed(keys, t("jobs"), now()).select(F.col("job_id").alias("k"), "updated_at")


def _changes(t):
    return t("jobs").filter("k % 5 = 0").withColumns({"status": F.lit("completed"), "created_at": now(), "current_size": F.col("total_size")})


def _new(t):
    return t("jobs").filter("k % 50 = 1").withColumn("job_id", F.concat(F.lit("new-"), "job_id"))


@query(f"""SELECT job_id, CASE WHEN k % 5 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN k % 5 = 0 THEN total_size ELSE current_size END AS current_size, created_at FROM ({{jobs}})
 UNION ALL SELECT 'new-' || job_id, status, current_size, created_at FROM ({{jobs}}) WHERE k % 50 = 1""")
def upsert_jobs(t):
    return mutate.upsert(t("jobs"), _changes(t).unionByName(_new(t)), ["job_id"], keep=["created_at"]).select("job_id", "status", "current_size", "created_at")


@query("SELECT job_id, CASE WHEN k % 5 = 0 AND status IN ('pending','syncing') THEN total_size ELSE current_size END AS current_size FROM ({jobs})")
def conditional_progress(t):
    return mutate.update(t("jobs"), _changes(t), ["job_id"], ["current_size"], F.col("status").isin("pending", "syncing")).select("job_id", "current_size")


@query("SELECT * FROM ({job_retries}) WHERE retry_count <> 3")
def delete_rows(t):
    return mutate.delete(t("job_retries"), t("job_retries").filter("retry_count = 3"), ["job_id"])


@query(f"""SELECT job_id, CASE WHEN h % 3 = 1 THEN retry_count + 1 ELSE retry_count END AS retry_count, max_retries,
 CASE WHEN h % 3 = 1 AND retry_count + 1 < max_retries THEN {NOW} + to_minutes(CASE WHEN retry_count + 1 <= 0 THEN 1 WHEN retry_count + 1 = 1 THEN 3 WHEN retry_count + 1 = 2 THEN 6 ELSE 10 END) ELSE next_retry_at END AS next_retry_at
 FROM (SELECT *, length(job_id) + cast(epoch(last_retry_at) / 86400 AS BIGINT) AS h FROM ({{job_retries}}) x) y WHERE h % 3 <> 0""")
def retry_attempt(t):
    r = t("job_retries").withColumn("h", F.length("job_id") + F.round(F.unix_timestamp("last_retry_at") / 86400).cast("long"))
    attempts = r.filter("h % 3 < 2").select("job_id", (F.col("h") % 3 == 0).alias("success"))
    return mutate.retry_attempt(t("job_retries"), attempts, now())


@query("""WITH r AS (SELECT event_type AS scope, 'u' || user_id AS key, 'f' || (event_id % 2) AS fingerprint, event_id AS seq, ts AS at FROM {events}),
 o AS (SELECT scope, key, min_by(fingerprint, seq) AS fingerprint, 'j' || min(seq) AS job_id FROM r GROUP BY scope, key)
 SELECT o.scope, o.key, o.fingerprint, o.job_id, max(r.at) AS updated_at FROM o JOIN r ON o.scope = r.scope AND o.key = r.key AND o.fingerprint = r.fingerprint GROUP BY ALL""")
def idempotency_reserve(t):
    r = t("events").selectExpr("event_type AS scope", "concat('u', user_id) AS key", "concat('f', event_id % 2) AS fingerprint", "event_id AS seq", "ts AS at", "concat('j', event_id) AS job_id")
    return mutate.reserve(r)


@query(f"SELECT job_id, file_path, source_size, source_modified FROM ({{transfer_states}}) WHERE (cache_only OR {PERCENT.format('done_chunks', 'total_chunks')} = 100) AND source_size IS NOT NULL AND source_modified IS NOT NULL")
def completed_versions(t):
    return changes.completed_versions(t("transfer_states")).select("job_id", "file_path", "source_size", "source_modified")


TS = "(CASE WHEN {0} = {1} THEN true WHEN abs({0}) < 1000000000000 OR abs({1}) < 1000000000000 THEN (CASE WHEN abs({0}) < 1000000000000 THEN {0} ELSE {0} // 1000000000 END) = (CASE WHEN abs({1}) < 1000000000000 THEN {1} ELSE {1} // 1000000000 END) ELSE false END)"
OPT = "(CASE WHEN {0} IS NULL AND {1} IS NULL THEN true WHEN {0} IS NULL OR {1} IS NULL THEN false ELSE " + TS + " END)"


@query(f"""WITH c AS (SELECT *, source_size + CASE WHEN done_chunks % 5 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN done_chunks % 3 = 0 THEN source_modified // 1000000000 ELSE source_modified END AS modified,
 CASE WHEN done_chunks % 7 = 0 THEN NULL ELSE source_change_time END AS change_time, source_inode AS inode, total_chunks + CASE WHEN done_chunks % 11 = 1 THEN 1 ELSE 0 END AS now_chunks FROM ({{transfer_states}}))
 SELECT job_id, file_path, coalesce(total_chunks = now_chunks AND done_chunks <= now_chunks AND source_size = size AND {TS.format('source_modified', 'modified')}
 AND CASE WHEN change_time IS NOT NULL THEN coalesce({OPT.format('source_change_time', 'change_time')}, false) ELSE source_change_time IS NULL END
 AND CASE WHEN inode IS NOT NULL THEN coalesce(source_inode = inode, false) ELSE source_inode IS NULL END, false) AS resumable FROM c""")
def resume_valid(t):
    s = t("transfer_states")
    c = s.select(
        "job_id", "file_path", (F.col("source_size") + F.when(F.col("done_chunks") % 5 == 0, 1).otherwise(0)).alias("size"),
        F.when(F.col("done_chunks") % 3 == 0, E.whole_seconds("source_modified")).otherwise(F.col("source_modified")).alias("modified"),
        F.when(F.col("done_chunks") % 7 == 0, None).otherwise(F.col("source_change_time")).alias("change_time"), F.col("source_inode").alias("inode"),
        (F.col("total_chunks") + F.when(F.col("done_chunks") % 11 == 1, 1).otherwise(0)).alias("total_chunks"),
    )
    return s.alias("s").join(c.alias("c"), ["job_id", "file_path"]).select("job_id", "file_path", changes.resumable("s", "c").alias("resumable"))


INCLUDE, EXCLUDE = ["en/", "[.](py|txt|toml)$"], ["^src1/de", "doc_[0-9]*7[.]"]


@query("SELECT path FROM ({files}) WHERE NOT regexp_matches(path, '^src1/de') AND NOT regexp_matches(path, 'doc_[0-9]*7[.]') AND (regexp_matches(path, 'en/') OR regexp_matches(path, '[.](py|txt|toml)$'))")
def path_filter(t):
    return t("files").filter(E.file_kept("path", INCLUDE, EXCLUDE)).select("path")


@query(f"""SELECT path, reason FROM (SELECT n.path, CASE WHEN c.path IS NULL THEN 'new'
 WHEN NOT (c.size = n.size AND {TS.format('n.modified', 'c.modified')} AND {OPT.format('n.change_time', 'c.change_time')} AND n.inode IS NOT DISTINCT FROM c.inode) THEN 'changed'
 WHEN d.path IS NULL THEN 'missing' WHEN d.size <> n.size OR NOT {TS.format('d.modified', 'c.modified')} OR NOT {OPT.format('d.change_time', 'c.change_time')} OR d.inode IS DISTINCT FROM c.inode THEN 'drifted'
 WHEN n.mode <> 0 AND (d.mode & 4095) <> (n.mode & 4095) THEN 'permissions' END AS reason
 FROM ({{files_now}}) n LEFT JOIN ({{files}}) c ON n.path = c.path LEFT JOIN ({{files_dest}}) d ON n.path = d.path) x WHERE reason IS NOT NULL""")
def changed_files(t):
    return changes.changed_files(t("files_now"), t("files"), t("files_dest"))


@query(f"SELECT s.path FROM ({{files}}) s LEFT JOIN ({{files_now}}) n ON s.path = n.path WHERE n.path IS NULL OR s.size <> n.size OR NOT {TS.format('s.modified', 'n.modified')}")
def stale_scans(t):
    return changes.stale_scans(t("files"), t("files_now"))


UP = "(SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path FROM ({0}) f, unnest(range(1, len(string_split(path, '/')) + 1)) u(i))"


@query(f"SELECT path FROM {UP.format('{files_now}')} x")
def expected_entries(t):
    return changes.expected_entries(t("files_now"))


@query(f"""WITH gone AS (SELECT path FROM {UP.format('{files}')} d WHERE path NOT IN (SELECT path FROM {UP.format('{files_now}')} e))
 SELECT path FROM gone WHERE array_to_string(string_split(path, '/')[1:-2], '/') NOT IN (SELECT path FROM gone)""")
def deleted_targets(t):
    return changes.deleted_targets(t("files"), t("files_now"))


@query("SELECT path FROM ({files}) WHERE path NOT IN (SELECT path FROM ({files_now}))")
def forgotten_paths(t):
    return changes.forgotten(t("files"), t("files_now"))


@query(f"""WITH a AS (SELECT job_id, dest_path AS path FROM ({{jobs}}) WHERE status IN {ACTIVE})
 SELECT DISTINCT least(x.job_id, y.job_id) AS job_id, greatest(x.job_id, y.job_id) AS other_id FROM a x JOIN a y ON x.job_id <> y.job_id AND (x.path = y.path OR starts_with(y.path, x.path || '/'))
 AND x.job_id <> y.job_id || '_final' AND y.job_id <> x.job_id || '_final'""")
def dest_overlap(t):
    return jobs.overlapping_destinations(t("jobs"))


@query("SELECT doc_id, idx, length, strong, weak FROM ({chunks})")
def line_chunks(t):
    return t("chunks")


@query("SELECT doc_id, idx, cast(coalesce(sum(length) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({chunks})")
def chunk_offsets(t):
    return dedup.with_offsets(t("chunks")).select("doc_id", "idx", "offset")


#: Another version of all chunks: every fifth line of a file was rewritten since.
OTHER = "SELECT doc_id, idx, length, CASE WHEN idx % 5 = 0 THEN {sha:strong} ELSE strong END AS strong, CASE WHEN idx % 5 = 0 THEN substring({sha:strong}, 1, 6) ELSE weak END AS weak FROM ({chunks}) o"


def _other(t):
    c, new = t("chunks"), F.sha2("strong", 256)
    edited = F.col("idx") % 5 == 0
    return c.withColumns({"strong": F.when(edited, new).otherwise(F.col("strong")), "weak": F.when(edited, F.substring(new, 1, 6)).otherwise(F.col("weak"))})


def _located(c):
    return c.withColumns({"path": F.col("doc_id").cast("string"), "pos": F.col("doc_id") * 1000000 + F.col("idx"), "offset": F.col("idx")})


@query(f"SELECT doc_id, idx FROM ({{chunks}}) c WHERE weak IN (SELECT weak FROM ({OTHER}) l)")
def weak_matches(t):
    return dedup.weak_matches(t("chunks"), _other(t)).select("doc_id", "idx")


@query(f"""WITH l AS (SELECT weak, strong, min(doc_id * 1000000 + idx) AS at FROM ({OTHER}) o GROUP BY weak, strong)
 SELECT doc_id, idx, l.at FROM ({{chunks}}) s JOIN l ON s.weak = l.weak AND s.strong = l.strong""")
def weak_strong_dedup(t):
    return dedup.verified_matches(t("chunks").select("doc_id", "idx", "weak", "strong"), _located(_other(t))).select("doc_id", "idx", F.col("at.pos").alias("at"))


@query(f"""WITH s AS (SELECT * FROM ({{chunks}}) c), m AS (SELECT doc_id, idx FROM s WHERE weak NOT IN (SELECT weak FROM ({OTHER}) l)),
 i AS (SELECT weak, strong, doc_id AS p, min(doc_id * 1000000 + idx) AS pos FROM s WHERE doc_id IN (SELECT id FROM ({{files}}) f WHERE path IN (SELECT path FROM ({{files_now}}) n)) GROUP BY ALL),
 b AS (SELECT weak, strong, arg_min(p, pos) AS p1, min(pos) AS a1 FROM i GROUP BY ALL), o AS (SELECT i.weak, i.strong, min(pos) AS a2 FROM i JOIN b ON i.weak = b.weak AND i.strong = b.strong WHERE p <> p1 GROUP BY ALL)
 SELECT s.doc_id, s.idx, CASE WHEN p1 <> s.doc_id THEN a1 ELSE a2 END AS at FROM s JOIN b ON s.weak = b.weak AND s.strong = b.strong LEFT JOIN o ON o.weak = b.weak AND o.strong = b.strong
 WHERE (s.doc_id, s.idx) NOT IN (SELECT (doc_id, idx) FROM m) AND (p1 <> s.doc_id OR a2 IS NOT NULL)""")
def global_dedup(t):
    c = _located(t("chunks"))
    s = c.select("path", "doc_id", "idx", "weak", "strong")
    listing = t("files").join(t("files_now").select("path"), "path", "left_semi").select(F.col("id").cast("string").alias("path"))
    matched = s.join(_other(t).select("weak").distinct(), "weak", "left_anti")
    return dedup.global_matches(s, c.select("weak", "strong", "path", "pos", "offset"), listing, matched).select("doc_id", "idx", F.col("at.pos").alias("at"))


OFFSETS = "SELECT *, cast(coalesce(sum(length) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM ({chunks}) q"
PLAN = f"""WITH c AS ({OFFSETS}), l AS (SELECT strong, doc_id AS p, off - CASE WHEN doc_id % 4 = 0 AND idx > 2 THEN 7 ELSE 0 END AS o, doc_id * 1000000 + idx AS pos FROM c WHERE doc_id % 4 < 2),
 g AS (SELECT strong, doc_id AS p, off AS o, doc_id * 1000000 + idx AS pos FROM c WHERE doc_id % 5 = 0),
 s AS (SELECT c.*, doc_id IN (SELECT p FROM l) AS x FROM c WHERE idx % 9 <> 8),
 m AS (SELECT s.doc_id, s.idx, s.length, EXISTS (SELECT 1 FROM l WHERE l.strong = s.strong AND l.p = s.doc_id AND l.o = s.off) AS here,
  (SELECT arg_min(o, pos) FROM l WHERE l.strong = s.strong AND l.p = s.doc_id) AS moved, (SELECT arg_min(p, pos) FROM l WHERE l.strong = s.strong) AS np, (SELECT arg_min(o, pos) FROM l WHERE l.strong = s.strong) AS no,
  (SELECT arg_min(p, pos) FROM g WHERE g.strong = s.strong) AS gp, (SELECT arg_min(o, pos) FROM g WHERE g.strong = s.strong) AS go FROM s)
 SELECT doc_id, idx, length, CASE WHEN here THEN 'in_place' WHEN moved IS NOT NULL THEN 'relocate' WHEN coalesce(np, gp) IS NOT NULL THEN 'copy' ELSE 'transfer' END AS action,
 CASE WHEN here THEN NULL WHEN moved IS NOT NULL THEN doc_id ELSE coalesce(np, gp) END AS from_doc, CASE WHEN here THEN NULL WHEN moved IS NOT NULL THEN moved ELSE coalesce(no, go) END AS from_offset FROM m"""


def _plan(t):
    c = dedup.with_offsets(t("chunks")).withColumns({"path": F.col("doc_id"), "pos": F.col("doc_id") * 1000000 + F.col("idx")})
    shift = F.when((F.col("doc_id") % 4 == 0) & (F.col("idx") > 2), 7).otherwise(0)
    local = c.filter("doc_id % 4 < 2").withColumn("offset", F.col("offset") - shift).select("strong", "path", "offset", "pos")
    index = c.filter("doc_id % 5 = 0").select("strong", "path", "offset", "pos")
    return dedup.chunk_plan(c.withColumn("done", F.col("idx") % 9 == 8).select("path", "idx", "offset", "length", "strong", "done"), local, index)


@query(PLAN)
def chunk_plan(t):
    return _plan(t).select(F.col("path").alias("doc_id"), "idx", "length", "action", F.col("from_path").alias("from_doc"), "from_offset")


@query(f"SELECT action, count(*) AS chunks, cast(sum(length) AS BIGINT) AS bytes FROM ({PLAN}) p GROUP BY action")
def plan_summary(t):
    return dedup.plan_summary(_plan(t))


@query("""WITH i AS (SELECT weak AS hash, doc_id // 2 AS path, idx // 2 AS "offset", max(doc_id * 1000000 + idx) AS seq FROM ({chunks}) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY seq DESC, path, "offset") AS n FROM i) SELECT hash, path, "offset", seq FROM r WHERE n <= 100""")
def hash_locations_capped(t):
    i = t("chunks").selectExpr("weak AS hash", "doc_id div 2 AS path", "idx div 2 AS offset", "doc_id * 1000000 + idx AS seq")
    return dedup.capped_locations(i)


@query("SELECT doc_id, array_to_string(list_sort(list(DISTINCT weak)), ',') AS weak, count(strong) AS n_strong FROM ({chunks}) GROUP BY doc_id")
def hash_lists(t):
    return dedup.hash_lists(t("chunks")).select("doc_id", F.array_join("weak", ",").alias("weak"), "n_strong")


@query(None)
def fastcdc_chunks(t):
    return chunking.content_chunks(t("documents"), "doc_id", "text", chunking.Profile(256, 1024, 4096))


@query("SELECT doc_id AS path, i AS idx, i * 1000 AS \"offset\", octet_length(encode(text)[i * 1000 + 1 : i * 1000 + 1000]) AS length FROM (SELECT doc_id, text, unnest(range(0, cast(ceil(octet_length(encode(text)) / 1000) AS BIGINT))) AS i FROM {documents}) q")
def fixed_chunks(t):
    return chunking.fixed_chunks(t("documents"), "doc_id", "text", 1000).select("path", "idx", "offset", "length")


def _case(pairs, default):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


EXT = "regexp_extract(lower(regexp_extract(path, '([^/]*)$', 1)), '^.+\\.([^.]*)$', 1)"
CLASS = _case([(f"{EXT} IN ({', '.join(repr(e) for e in some)})", repr(c)) for c, some in E.EXTENSIONS.items()], "'Unknown'")
COMPRESSIBLE = "cls NOT IN ('Image', 'Video', 'Audio', 'Archive')"
RATIO = _case([(f"cls = '{c}'", r) for c, r in E.RATIOS.items()], "1.0")


@query(f"SELECT path, cls, {COMPRESSIBLE} AS ok, {_case([('NOT ' + COMPRESSIBLE, repr('none')), *((f'cls = {c!r}', repr(a)) for c, a in E.ALGORITHMS.items())], repr('zstd'))} AS algorithm FROM (SELECT path, {CLASS} AS cls FROM ({{files}}) f) x")
def file_type(t):
    return t("files").select("path", E.class_by_name("path").alias("cls")).select("path", "cls", E.compressible("cls").alias("ok"), E.algorithm("cls").alias("algorithm"))


@query(f"""SELECT path, CASE WHEN size < 1024 THEN false ELSE {COMPRESSIBLE} END AS should_compress, CASE WHEN size < 1024 THEN 'Unknown' ELSE cls END AS file_type, cast(CASE WHEN size < 1024 THEN 1.0 ELSE {RATIO} END AS DOUBLE) AS estimated_ratio,
 CASE WHEN size < 1024 THEN 'File too small: ' || size || ' bytes < 1024 bytes' WHEN {COMPRESSIBLE} THEN 'File type ' || cls || ' is compressible' ELSE 'File type ' || cls || ' is already compressed' END AS reason FROM (SELECT path, size, {CLASS} AS cls FROM ({{files}}) f) x""")
def compression_decision(t):
    return t("files").select("path", E.compression_decision("path", "size").alias("d")).select("path", "d.*")


def _tie(unit: int, scale: int) -> str:
    """Whole-number division of n * scale by the unit, ties to even, as DuckDB SQL."""
    return f"((n * {scale}) // {unit} + CASE WHEN (n * {scale}) % {unit} * 2 > {unit} OR ((n * {scale}) % {unit} * 2 = {unit} AND ((n * {scale}) // {unit}) % 2 = 1) THEN 1 ELSE 0 END)"


SIZES = "cast((size + id % 5 * 512) * CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 512 WHEN 2 THEN 52428 + 4 * (id % 7) ELSE 5368709 + 3 * (id % 11) END AS {0})"


@query(f"""SELECT id, CASE WHEN n >= 1073741824 THEN ({_tie(1 << 30, 100)} // 100) || '.' || lpad(({_tie(1 << 30, 100)} % 100)::VARCHAR, 2, '0') || ' GB' WHEN n >= 1048576 THEN ({_tie(1 << 20, 10)} // 10) || '.' || ({_tie(1 << 20, 10)} % 10) || ' MB'
 WHEN n >= 1024 THEN {_tie(1 << 10, 1)} || ' KB' ELSE n || ' B' END AS text FROM (SELECT id, {SIZES.format('HUGEINT')} AS n FROM ({{files}}) f UNION ALL SELECT 10000000 + id, 1024 * id + 512 FROM ({{files}}) f UNION ALL SELECT 20000000 + id, 1048576 * id + 262144 FROM ({{files}}) f) x""")
def human_bytes(t):
    f = t("files")
    n = f.selectExpr("id", f"{SIZES.format('BIGINT')} AS n").unionByName(f.selectExpr("10000000 + id AS id", "1024 * id + 512 AS n")).unionByName(f.selectExpr("20000000 + id AS id", "1048576 * id + 262144 AS n"))
    return n.select("id", E.human_bytes("n").alias("text"))


MIMES = "CASE " + " ".join(f"WHEN ends_with(path, '{end}') THEN '{kind}'" for end, kind in E.MIME.items()) + " ELSE 'application/octet-stream' END"
ENDINGS = "CASE id % 5 WHEN 0 THEN path ELSE concat(path, CASE id % 8 WHEN 0 THEN '.html' WHEN 1 THEN '.css' WHEN 2 THEN '.js' WHEN 3 THEN '.wasm' WHEN 4 THEN '.svg' WHEN 5 THEN '.png' WHEN 6 THEN '.HTML' ELSE '.json' END) END"


@query(f"SELECT path, {MIMES} AS mime FROM (SELECT {ENDINGS} AS path FROM ({{files}}) f) x")
def mime_types(t):
    return t("files").selectExpr(f"{ENDINGS} AS path").select("path", E.mime_type("path").alias("mime"))


@query("SELECT job_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS text FROM (SELECT job_id, total_size % 9000 AS s FROM ({jobs}) j) x")
def duration_text(t):
    return t("jobs").select("job_id", E.duration_text(F.col("total_size") % 9000).alias("text"))


@query("SELECT job_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS text FROM ({jobs})")
def date_text(t):
    return t("jobs").select("job_id", E.datetime_text(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("text"))


CATEGORY = """CASE WHEN m LIKE '%[fatal]%' THEN 'Fatal' WHEN m LIKE '%timeout%' OR m LIKE '%timed out%' THEN 'Transient' WHEN m LIKE '%connection refused%' OR m LIKE '%broken pipe%' OR m LIKE '%no route to host%' OR m LIKE '%unhealthy%' THEN 'Retriable'
 WHEN kind = 'Io' THEN 'Retriable' WHEN kind IN ('ProtocolError', 'InvalidConfig') THEN 'Fatal' WHEN kind = 'FileOperation' AND (m LIKE '%not found%' OR m LIKE '%permission denied%') THEN 'Fatal' WHEN kind = 'FileOperation' THEN 'Retriable' ELSE 'Unknown' END"""
CATEGORISED = f"SELECT *, {CATEGORY} AS category FROM (SELECT *, lower(message) AS m FROM ({{errors}}) e) e2"


@query(f"SELECT event_id, category, message LIKE '%cancelled by user%' OR message = 'job cancelled' AS cancelled FROM ({CATEGORISED}) x")
def error_category(t):
    return t("errors").select("event_id", E.error_category("message", "kind").alias("category"), E.is_cancelled("message").alias("cancelled"))


@query(f"""WITH c AS (SELECT *, CASE category WHEN 'Fatal' THEN 4 WHEN 'Transient' THEN 3 WHEN 'Retriable' THEN 2 ELSE 1 END AS r FROM ({CATEGORISED}) x),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, event_id) AS o, count(*) OVER (PARTITION BY user_id) AS n FROM c)
 SELECT user_id, n, category, CASE WHEN category = 'Fatal' THEN '[fatal] ' ELSE '' END || n || ' files failed: ' || message AS message FROM k WHERE o = 1""")
def representative_failure(t):
    return adaptive.representative_failure(t("errors"), "user_id", "event_id")


EWMA = """WITH RECURSIVE q AS (SELECT region, epoch_us(ts) AS us, bytes * 8.0::DOUBLE / (duration_ms / 1000.0::DOUBLE) / 1e6 AS m, row_number() OVER (PARTITION BY region ORDER BY ts, seq) AS n FROM ({samples}) x WHERE duration_ms >= 1 AND bytes IS NOT NULL),
 a AS (SELECT region, n, us AS last, true AS ok FROM q WHERE n = 1 UNION ALL SELECT q.region, q.n, CASE WHEN q.us - a.last >= 100000 THEN q.us ELSE a.last END, q.us - a.last >= 100000 FROM q JOIN a ON q.region = a.region AND q.n = a.n + 1),
 s AS (SELECT q.region, q.m, row_number() OVER (PARTITION BY q.region ORDER BY q.n DESC) AS n FROM q JOIN a ON q.region = a.region AND q.n = a.n WHERE a.ok),
 f AS (SELECT region, list_reduce(list(m ORDER BY n DESC), lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a) AS m FROM s WHERE n <= 20 GROUP BY region)
 SELECT region, round(m, 4) AS mbps, CASE WHEN m >= 800 THEN 'Excellent' WHEN m >= 200 THEN 'Good' WHEN m >= 50 THEN 'Fair' WHEN m > 0 THEN 'Poor' ELSE 'Unknown' END AS quality FROM f"""


@query(EWMA)
def ewma_bandwidth(t):
    return adaptive.ewma_bandwidth(t("samples")).select("region", F.round("mbps", 4).alias("mbps"), "quality")


def _rounds(t):
    s = t("samples").groupBy("region", F.date_trunc("day", "ts").alias("round")).agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    quality = E.chain([(F.dayofmonth("round") % 5 == k, q) for k, q in enumerate(["Excellent", "Good", "Fair", "Poor"])], "Unknown")
    return s.withColumn("quality", quality)


@query("""WITH RECURSIVE r AS (SELECT region, date_trunc('day', ts) AS round, count_if(ok) AS s, count_if(NOT ok) AS f FROM ({samples}) x GROUP BY ALL),
 q AS (SELECT *, CASE day(round) % 5 WHEN 0 THEN 'Excellent' WHEN 1 THEN 'Good' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Poor' ELSE 'Unknown' END AS q, row_number() OVER (PARTITION BY region ORDER BY round) AS n, count(*) OVER (PARTITION BY region) AS last FROM r),
 w AS (SELECT region, n, last, CASE WHEN f::DOUBLE / (s + f) > 0.1 THEN greatest(c // 2, 4) WHEN q = 'Excellent' AND s > 20 THEN least(c + 4, 64) WHEN q = 'Good' AND s > 10 THEN least(c + 2, 64)
  WHEN q IN ('Fair', 'Unknown') AND f::DOUBLE / (s + f) < 0.05 AND s > 5 THEN least(c + 1, 64) WHEN q IN ('Poor', 'Unknown') AND c > CASE q WHEN 'Poor' THEN 4 ELSE 8 END THEN greatest((c + CASE q WHEN 'Poor' THEN 4 ELSE 8 END) // 2, 4) ELSE c END AS c
  FROM (SELECT *, 16 AS c FROM q WHERE n = 1) z
 UNION ALL SELECT region, n, last, CASE WHEN f::DOUBLE / (s + f) > 0.1 THEN greatest(c // 2, 4) WHEN q = 'Excellent' AND s > 20 THEN least(c + 4, 64) WHEN q = 'Good' AND s > 10 THEN least(c + 2, 64)
  WHEN q IN ('Fair', 'Unknown') AND f::DOUBLE / (s + f) < 0.05 AND s > 5 THEN least(c + 1, 64) WHEN q IN ('Poor', 'Unknown') AND c > CASE q WHEN 'Poor' THEN 4 ELSE 8 END THEN greatest((c + CASE q WHEN 'Poor' THEN 4 ELSE 8 END) // 2, 4) ELSE c END
  FROM (SELECT q.*, w.c FROM q JOIN w ON q.region = w.region AND q.n = w.n + 1) z)
 SELECT region, cast(c AS INT) AS streams FROM w WHERE n = last""")
def aimd_concurrency(t):
    return adaptive.concurrency(_rounds(t))


@query("""WITH e AS (SELECT region, max(CASE WHEN ok THEN seq END) AS l FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts, seq) AS o FROM ({samples}) x) y GROUP BY region),
 n AS (SELECT region, ok, row_number() OVER (PARTITION BY region ORDER BY ts DESC, seq DESC) AS k FROM ({samples}) x), a AS (SELECT region, coalesce(min(CASE WHEN ok THEN k END), count(*) + 1) - 1 AS failures FROM n GROUP BY region)
 SELECT region, failures, CASE WHEN failures = 0 THEN 'Healthy' WHEN failures < 3 THEN 'Degraded' ELSE 'Unhealthy' END AS state FROM a""")
def region_health(t):
    return adaptive.health(t("samples"))


@query(f"SELECT job_id, file_path FROM ({{transfer_states}}) WHERE updated_at >= {NOW} - INTERVAL '200' DAY ORDER BY updated_at DESC, job_id, file_path LIMIT 100000")
def cache_cleanup(t):
    return changes.cache_cleanup(t("transfer_states"), now(), 200 * 86400).select("job_id", "file_path")


@query(f"SELECT job_id, priority, row_number() OVER (ORDER BY priority, created_at, job_id) AS place FROM ({{jobs}}) WHERE status IN {ACTIVE}")
def queue_order(t):
    order = Window.partitionBy("priority").orderBy("created_at", "job_id")
    rows = jobs.queue_order(t("jobs")).withColumn("rank", F.row_number().over(order))
    before = rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before), "priority").select("job_id", "priority", (F.col("before") + F.col("rank")).alias("place"))


@query("""WITH q AS (SELECT user_id AS job_id, event_id AS seq, ts AS run_at FROM {events}), l AS (SELECT job_id, max(seq) AS seq, arg_max(run_at, seq) AS run_at FROM q GROUP BY job_id)
 SELECT job_id, seq, run_at FROM l WHERE run_at <= (SELECT min(ts) + (max(ts) - min(ts)) FROM {events})""")
def delayed_ready(t):
    return jobs.delayed_ready(t("events").selectExpr("user_id AS job_id", "event_id AS seq", "ts AS run_at"), F.expr("TIMESTAMP_NTZ '2999-01-01 00:00:00'")).select("job_id", "seq", "run_at")


@query("""WITH s AS (SELECT *, epoch_us(scan_ts) - epoch_us(modified) > 900000000 AS old FROM ({scans}) x),
 c AS (SELECT *, CASE WHEN lag(size) OVER w IS NOT DISTINCT FROM size AND lag(modified) OVER w IS NOT DISTINCT FROM modified AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM s WINDOW w AS (PARTITION BY path, old ORDER BY scan_ts, seq)),
 i AS (SELECT *, sum(c) OVER (PARTITION BY path, old ORDER BY scan_ts, seq) AS i FROM c), f AS (SELECT *, min(scan_ts) OVER (PARTITION BY path, old, i) AS f FROM i)
 SELECT path, seq, old OR epoch_us(scan_ts) - epoch_us(f) >= 900000000 AS stable FROM f""")
def stability_replay(t):
    return stability.replay(t("scans"), 900)


def _entries(t):
    return t("files").select("path", F.lit("F").alias("kind"), "size", F.sha2(F.col("path"), 256).alias("hash"), F.lit(None).cast("string").alias("target"))


LINES = "SELECT path, concat_ws(chr(9), 'F', '\"' || path || '\"', size::VARCHAR, sha256(path)) AS line FROM ({files}) f"


@query(LINES)
def manifest_lines(t):
    return manifest.manifest_lines(_entries(t))


@query(f"SELECT sha256(string_agg(line, chr(10) ORDER BY path)) AS summary, count(*) AS n FROM ({LINES}) l")
def manifest_summary(t):
    return manifest.summary_hash(manifest.manifest_lines(_entries(t)))


@query("SELECT count(*) AS entries, count(*) AS files, cast(sum(size) AS BIGINT) AS bytes FROM ({files})")
def manifest_counts(t):
    return manifest.manifest_counts(_entries(t))


@query("""WITH e AS (SELECT regexp_replace(job_id, '_final$', '') AS job_id, status, k FROM ({jobs}) j) SELECT job_id, arg_max(status, k) AS status FROM e GROUP BY job_id""")
def final_propagation(t):
    return jobs.final_propagation(t("jobs").select("job_id", "status", F.col("k").alias("seq")))


@query("SELECT job_id, coalesce(r.status, j.status) AS status FROM (SELECT job_id, status FROM ({jobs}) x UNION ALL SELECT job_id, NULL FROM ({runtime}) y WHERE job_id LIKE 'rt-%') j LEFT JOIN (SELECT job_id, status FROM ({runtime}) z) r USING (job_id)")
def resolved_statuses(t):
    return jobs.resolved_statuses(t("jobs"), t("runtime"), t("jobs").select("job_id").union(t("runtime").select("job_id")))


@query("SELECT job_id, status FROM ({jobs}) j WHERE EXISTS (SELECT 1 FROM ({jobs}) f WHERE f.job_id = j.job_id || '_final' AND f.status IN ('pending','syncing','paused'))")
def active_final(t):
    return jobs.with_active_final(t("jobs")).select("job_id", "status")


@query("SELECT job_id, CASE WHEN job_type IN ('once','full') OR is_last_round THEN 'completed' ELSE 'again' END AS next, round_id + CASE WHEN job_type IN ('once','full') OR is_last_round THEN 0 ELSE 1 END AS round_id FROM ({jobs})")
def after_round(t):
    return rounds.after_round(t("jobs"))


@query(f"SELECT job_id, CASE WHEN job_id || '_final' IN (SELECT job_id FROM ({{jobs}}) f WHERE status IN {ACTIVE}) THEN 'skip' WHEN status = 'paused' THEN 'keep' ELSE 'submit' END AS action FROM ({{jobs}}) WHERE status IN {ACTIVE}")
def recovery_actions(t):
    return rounds.recovered(t("jobs"))


@query(f"""WITH o AS (SELECT f.path, CASE WHEN f.path LIKE 'src3/%' OR f.path LIKE 'src1/en/%' THEN 'running'
 WHEN c.path IS NOT NULL AND {TS.format('f.modified', 'c.modified')} AND f.size = c.size THEN 'cached' ELSE 'index' END AS outcome FROM ({{files_now}}) f LEFT JOIN ({{files}}) c ON f.path = c.path) SELECT outcome, count(*) AS n FROM o GROUP BY outcome""")
def index_round(t):
    running = t("files").sparkSession.createDataFrame([("src3",), ("src1/en",)], "dest_path string")
    return index.outcome_counts(index.to_index(t("files_now"), running, t("files").select("path").limit(0), t("files"), 1_720_000_000_000_000_000))


@query("SELECT path, size FROM (SELECT path, size, sum(size) OVER (ORDER BY modified DESC, path) AS s FROM ({files}) f) x WHERE s <= 104857600")
def byte_bounded_cache(t):
    return index.byte_bounded(t("files").withColumn("last_access", F.col("modified"))).select("path", "size")


@query("SELECT job_id, sha256(p || '4:once2[3:a.*1:b]0[]') AS fingerprint FROM (SELECT job_id, length(source_path) || ':' || source_path || length(dest_path) || ':' || dest_path AS p FROM ({jobs}) j) x")
def request_fingerprint(t):
    patterns = F.array(F.lit("b"), F.lit("a.*"), F.lit("b"))
    empty = F.array().cast("array<string>")
    return t("jobs").select("job_id", requests.request_fingerprint("source_path", F.concat(F.lit("./"), "dest_path"), F.lit("once"), patterns, empty).alias("fingerprint"))


@query(None)
def compress_ratio(t):
    d = t("documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    packed = codec.smart(d, "path", "content")
    same = codec.unpack("packed", "algorithm") == F.col("content")
    return packed.select("path", "algorithm", F.length("content").alias("size"), F.length("packed").alias("packed_size"), same.alias("restored"))


def queries() -> dict:
    bound = lambda f: lambda spark, sf_dir: f(lambda name: spark_table(spark, sf_dir, name))
    return {name: bound(f) for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duck(sql) for name, (_, sql) in _QUERIES.items() if sql}


from . import calls, more, trees  # noqa: E402, F401  (registers its queries, which use the names above)
