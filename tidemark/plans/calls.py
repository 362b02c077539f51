"""Queries for the service's calls, many at once: every job of the store is asked for. See ``catalogue``."""

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import service
from .catalogue import ACTIVE, PUBLIC, query

ASKED = "(SELECT job_id FROM ({jobs}) j UNION SELECT job_id || 'x' FROM ({jobs}) j WHERE status = 'paused')"
LEFT = "(SELECT DISTINCT job_id FROM ({job_retries}) r WHERE retry_count < max_retries)"
ROWS = f"""(SELECT a.job_id, j.job_type, j.status, j.dest_path, f.job_id AS final_id, f.status AS fs, f.dest_path AS fd, a.job_id IN {LEFT} AS own_left, coalesce(f.job_id IN {LEFT}, false) AS fin_left, j.job_id IS NULL OR a.job_id LIKE '%\\_final' ESCAPE '\\' AS absent
 FROM {ASKED} a LEFT JOIN ({{jobs}}) j ON a.job_id = j.job_id LEFT JOIN ({{jobs}}) f ON f.job_id = a.job_id || '_final')"""
FIN = f"coalesce(fs IN {ACTIVE} OR (fs = 'failed' AND fin_left), false)"
OVER = "({0} = {1} OR starts_with({0}, {1} || '/') OR starts_with({1}, {0} || '/'))"


def asked(t):
    j = t("jobs")
    return j.select("job_id").unionByName(j.filter("status = 'paused'").select(F.concat("job_id", F.lit("x")).alias("job_id")))


@query(f"""SELECT job_id, CASE WHEN absent THEN 404 WHEN action = 'refuse' THEN 409 ELSE 200 END AS code, CASE WHEN absent THEN NULL WHEN job_type = 'sync' AND {FIN} THEN final_id ELSE job_id END AS target_id, action FROM
 (SELECT *, CASE WHEN absent THEN NULL WHEN job_type = 'sync' AND {FIN} THEN 'cancel' WHEN status = 'completed' AND own_left THEN 'drop retry' WHEN status = 'cancelled' THEN 'none' WHEN status = 'completed' OR (status = 'failed' AND NOT own_left) THEN 'refuse' ELSE 'cancel' END AS action FROM {ROWS} x) y""")
def cancel_answers(t):
    return service.cancel_answers(asked(t), t("jobs"), t("job_retries"))


@query(f"""WITH act AS (SELECT job_id AS aid, dest_path AS ad FROM ({{jobs}}) j WHERE status IN {ACTIVE}), dirs AS (SELECT DISTINCT ad FROM act), pairs AS (SELECT d.dest_path, a.ad FROM (SELECT DISTINCT dest_path FROM ({{jobs}}) j) d JOIN dirs a ON {OVER.format('d.dest_path', 'a.ad')}),
 others AS (SELECT x.job_id, count(*) AS n FROM {ROWS} x JOIN pairs p ON x.dest_path = p.dest_path JOIN act ON act.ad = p.ad WHERE act.aid <> x.job_id AND act.aid <> x.job_id || '_final' GROUP BY x.job_id)
 SELECT job_id, CASE WHEN absent THEN 404 WHEN action = 'refuse' THEN 400 WHEN action = 'conflict' THEN 409 ELSE 200 END AS code, action FROM
 (SELECT x.*, CASE WHEN absent THEN NULL WHEN job_type <> 'sync' THEN 'refuse' WHEN {FIN} OR coalesce(fs = 'completed', false) THEN 'none'
 WHEN NOT (status IN ('pending', 'syncing') OR (status = 'failed' AND (own_left OR coalesce(fs = 'failed' AND NOT fin_left, false)))) THEN 'refuse' WHEN o.n > 0 THEN 'conflict' ELSE 'start' END AS action FROM {ROWS} x LEFT JOIN others o ON o.job_id = x.job_id) y""")
def finalize_answers(t):
    return service.finalize_answers(asked(t), t("jobs"), t("job_retries"))


@query(f"""SELECT a.job_id, CASE WHEN j.job_id IS NULL THEN 404 ELSE 200 END AS code, coalesce(j.status IN {ACTIVE} OR (j.status = 'failed' AND (j.job_id IN {LEFT} OR (j.job_type = 'sync' AND {FIN}))), false) AS can_cancel
 FROM {ASKED} a LEFT JOIN (SELECT * FROM ({{jobs}}) q WHERE {PUBLIC}) j ON a.job_id = j.job_id LEFT JOIN (SELECT job_id AS final_id, status AS fs, job_id IN {LEFT} AS fin_left FROM ({{jobs}}) f) f ON f.final_id = j.job_id || '_final'""")
def get_answers(t):
    return service.get_answers(asked(t), t("jobs"), t("runtime"), t("job_retries")).select("job_id", "code", "can_cancel")


CALLS = f"""(SELECT job_id AS call, k AS seq, CASE WHEN k % 31 = 0 THEN ' ' ELSE source_path END AS source_path, CASE WHEN k % 29 = 0 THEN '/elsewhere/x' WHEN k % 23 = 0 THEN 'a/../b' WHEN k % 4 = 1 THEN 'fresh/' || k ELSE dest_path END AS dest,
 CASE WHEN k % 19 = 0 THEN 'nowhere' ELSE region END AS region, CASE WHEN k % 17 = 0 THEN 'twice' ELSE 'ONCE' END AS job_type, k % 13 = 0 AS bad, CASE WHEN k % 4 = 1 AND k % 8 = 1 THEN 'key' || (k % 40) END AS key FROM ({{jobs}}) j WHERE {PUBLIC})"""


@query(f"""WITH c AS (SELECT *, CASE WHEN trim(source_path) = '' THEN 'source_path is required' WHEN contains(dest, '..') THEN 'dest_path must not contain ''..''' WHEN starts_with(dest, '/') THEN 'dest_path is not allowed' WHEN bad THEN 'include_regex is invalid'
 WHEN region = 'nowhere' THEN 'unknown region' WHEN job_type = 'twice' THEN 'unknown job_type' END AS fault FROM {CALLS} q),
 o AS (SELECT key, arg_min(call, seq) AS owner, arg_min(source_path || '|' || dest, seq) AS print FROM c WHERE fault IS NULL AND key IS NOT NULL GROUP BY key),
 act AS (SELECT DISTINCT dest_path AS ad FROM ({{jobs}}) j WHERE status IN {ACTIVE}), taken AS (SELECT DISTINCT d.dest FROM (SELECT DISTINCT dest FROM c) d JOIN act ON {OVER.format('d.dest', 'act.ad')}),
 m AS (SELECT c.call, c.fault, coalesce(o.owner, c.call) AS owner, coalesce(c.fault, CASE WHEN c.fault IS NULL AND c.key IS NOT NULL AND o.print <> c.source_path || '|' || c.dest THEN 'idempotency key is already used'
 WHEN c.dest IN (SELECT dest FROM taken) AND NOT coalesce(o.owner <> c.call, false) THEN 'destination overlaps an active job' END) AS message FROM c LEFT JOIN o ON o.key = c.key AND c.fault IS NULL)
 SELECT call, CASE WHEN fault IS NOT NULL THEN 400 WHEN message IS NOT NULL THEN 409 ELSE 200 END AS code, message, CASE WHEN message IS NULL THEN 'job-of-' || owner END AS job_id FROM m""")
def create_answers(t):
    """Each public job is asked for once more, some with faults, some under a key that others use too."""
    n = lambda m: F.col("k") % m == 0
    fresh = F.col("k") % 4 == 1
    none = F.array().cast("array<string>")
    j = t("jobs").filter(E.is_public("job_id"))
    calls = j.select(
        F.col("job_id").alias("call"), F.col("k").alias("seq"), F.when(n(31), " ").otherwise(F.col("source_path")).alias("source_path"),
        F.when(n(29), "/elsewhere/x").when(n(23), "a/../b").when(fresh, F.concat(F.lit("fresh/"), F.col("k").cast("string"))).otherwise(F.col("dest_path")).alias("dest_path"),
        F.when(n(19), "nowhere").otherwise(F.col("region")).alias("region"), F.when(n(17), "twice").otherwise("ONCE").alias("job_type"), none.alias("exclude_regex"),
        F.when(n(13), F.array(F.lit("(?=a)"))).otherwise(none).alias("include_regex"), F.when(F.col("k") % 8 == 1, F.concat(F.lit("key"), (F.col("k") % 40).cast("string"))).alias("key"),
    )
    return service.create_answers(calls, t("jobs"), t("region").select(F.col("r_name").alias("region")))
