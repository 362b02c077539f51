"""Further queries: lookups, request texts, rules of rows, caches and mutations. See ``catalogue``."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec, requests
from ..functions import exprs as E
from ..operators import adaptive, changes, chunking, dedup, index, jobs, mutate, rounds
from ..streaming import stability
from .catalogue import ACTIVE, CLASS, EWMA, OPT, PUBLIC, TS, query

DEST = """SELECT job_id, file_path, done_chunks, source_size AS dest_size, source_modified AS dest_modified, source_change_time AS dest_change_time, source_inode AS dest_inode,
 source_size + CASE WHEN done_chunks % 5 = 1 THEN 1 ELSE 0 END AS size, CASE WHEN done_chunks % 3 = 0 THEN cast(floor(source_modified / 1000000000) AS BIGINT) ELSE source_modified END AS modified,
 CASE WHEN done_chunks % 7 = 0 THEN NULL ELSE source_change_time END AS change_time, CASE WHEN done_chunks % 4 = 3 THEN NULL ELSE source_inode END AS inode FROM ({transfer_states}) t"""


@query(f"""SELECT job_id, file_path, done_chunks = 0 OR coalesce(dest_size IS NOT NULL AND dest_modified IS NOT NULL AND dest_size IS NOT DISTINCT FROM size AND {OPT.format('dest_modified', 'modified')}
 AND CASE WHEN change_time IS NOT NULL THEN coalesce({OPT.format('dest_change_time', 'change_time')}, false) ELSE dest_change_time IS NULL END
 AND CASE WHEN inode IS NOT NULL THEN coalesce(dest_inode = inode, false) ELSE dest_inode IS NULL END, false) AS resumable FROM ({DEST}) d""")
def resume_destination(t):
    s = t("transfer_states").withColumns({f"dest_{c}": F.col(f"source_{c}") for c in ("size", "modified", "change_time", "inode")})
    d = s.select(
        "job_id", "file_path", (F.col("source_size") + F.when(F.col("done_chunks") % 5 == 1, 1).otherwise(0)).alias("size"),
        F.when(F.col("done_chunks") % 3 == 0, E.whole_seconds("source_modified")).otherwise(F.col("source_modified")).alias("modified"),
        F.when(F.col("done_chunks") % 7 == 0, None).otherwise(F.col("source_change_time")).alias("change_time"), F.when(F.col("done_chunks") % 4 == 3, None).otherwise(F.col("source_inode")).alias("inode"),
    )
    return s.alias("s").join(d.alias("d"), ["job_id", "file_path"]).select("job_id", "file_path", changes.destination_resumable("s", "d").alias("resumable"))


@query(f"SELECT job_id, status FROM (SELECT job_id, CASE WHEN k % 37 = 0 THEN 'odd' ELSE status END AS status, created_at FROM ({{jobs}}) j WHERE {PUBLIC} ORDER BY created_at DESC, job_id LIMIT 200 OFFSET 200) p WHERE status <> 'odd'")
def jobs_page_lenient(t):
    return jobs.lenient_page(t("jobs").withColumn("status", F.when(F.col("k") % 37 == 0, "odd").otherwise(F.col("status"))), 1, 200, public=True).select("job_id", "status")


@query("SELECT job_id, retry_count, last_error FROM ({job_retries}) r WHERE job_id = (SELECT min(job_id) FROM ({job_retries}) q)")
def retry_lookup(t):
    first = t("job_retries").agg(F.min("job_id")).first()[0]
    return jobs.by_key(t("job_retries"), job_id=first).select("job_id", "retry_count", "last_error")


@query("SELECT job_id, file_path, source_size FROM ({transfer_states}) s WHERE job_id = (SELECT min(job_id) FROM ({transfer_states}) q) AND file_path = (SELECT min(file_path) FROM ({transfer_states}) q WHERE job_id = (SELECT min(job_id) FROM ({transfer_states}) q2))")
def state_lookup(t):
    first = t("transfer_states").agg(F.min(F.struct("job_id", "file_path"))).first()[0]
    return jobs.by_key(jobs.checked_states(t("transfer_states")), job_id=first.job_id, file_path=first.file_path).select("job_id", "file_path", "source_size")


@query("SELECT event_type AS scope, 'u' || user_id AS key, count(*) AS n FROM {events} WHERE event_type = 'click' AND user_id = (SELECT min(user_id) FROM {events}) GROUP BY ALL")
def idempotency_lookup(t):
    r = t("events").selectExpr("event_type AS scope", "concat('u', user_id) AS key", "user_id")
    return jobs.by_key(r, scope="click", key=f"u{r.agg(F.min('user_id')).first()[0]}").groupBy("scope", "key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT job_id, file_path AS path, updated_at, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, file_path) AS rank FROM ({transfer_states}) s")
def tmp_paths(t):
    paths = t("transfer_states").select("job_id", F.col("file_path").alias("path"), "updated_at")
    return jobs.newest_first(paths).withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("updated_at"), "path")))


@query("SELECT job_id, CASE WHEN status IN ('paused','cancelled','completed') THEN true WHEN status = 'failed' THEN job_id NOT IN (SELECT job_id FROM ({job_retries}) r WHERE retry_count < max_retries) ELSE false END AS skip FROM ({jobs}) j")
def enqueue_rule(t):
    return jobs.skipped_enqueue(t("jobs"), t("job_retries"))


@query("SELECT job_id, CASE WHEN total > 0 THEN least(cast(floor(current_size::DOUBLE / total::DOUBLE * 100.0) AS INT), 100) ELSE cast(round_id AS INT) END AS progress FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 0 ELSE total_size // 2 END AS total FROM ({jobs}) j) x")
def progress_kept(t):
    j = t("jobs").withColumn("total", F.when(F.col("k") % 4 == 0, 0).otherwise(F.floor(F.col("total_size") / 2)))
    return j.select("job_id", E.kept_progress("current_size", "total", F.col("round_id").cast("int")).alias("progress"))


@query("""WITH s AS (SELECT *, epoch_us(scan_ts) - epoch_us(modified) > 900000000 AS old FROM ({scans}) x),
 c AS (SELECT *, CASE WHEN lag(size) OVER w IS NOT DISTINCT FROM size AND lag(modified) OVER w IS NOT DISTINCT FROM modified AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM s WINDOW w AS (PARTITION BY path, old ORDER BY scan_ts, seq)),
 i AS (SELECT *, sum(c) OVER (PARTITION BY path, old ORDER BY scan_ts, seq) AS i FROM c), f AS (SELECT *, min(scan_ts) OVER (PARTITION BY path, old, i) AS f FROM i)
 SELECT path, greatest(count(*) - count_if(old OR epoch_us(scan_ts) - epoch_us(f) >= 900000000), 0)::BIGINT AS waiting FROM f GROUP BY path""")
def stability_backlog(t):
    s = stability.replay(t("scans"), 900).groupBy("path").agg(F.count(F.lit(1)).alias("scanned"), F.count_if("stable").alias("stable"))
    return s.select("path", E.gap_or_zero("scanned", "stable").alias("waiting"))


@query("SELECT status, n + CASE status WHEN 'paused' THEN -n WHEN 'failed' THEN 3 ELSE 0 END AS n FROM (SELECT status, count(*) AS n FROM ({jobs}) j GROUP BY status) c WHERE status <> 'paused'")
def count_deltas(t):
    c = jobs.counts_by_status(t("jobs"))
    deltas = c.filter("status IN ('paused', 'failed')").select("status", F.when(F.col("status") == "paused", -F.col("n")).otherwise(F.lit(3)).alias("delta"))
    return jobs.adjusted_counts(c, deltas)


@query('SELECT k, CASE WHEN extra = 0 THEN k ELSE greatest(k - extra, 0) END AS "offset", CASE WHEN extra = 0 THEN 50 ELSE 50 + 2 * extra END AS "limit" FROM (SELECT k, priority - 1 AS extra FROM ({jobs}) j) x')
def persisted_window(t):
    return t("jobs").select("k", (F.col("priority") - 1).alias("extra")).select("k", jobs.persisted_window("k", F.lit(50), "extra").alias("w")).select("k", "w.*")


@query("SELECT job_id, CASE WHEN k % 3 = 0 THEN NULL ELSE created_at + INTERVAL '90' MINUTE END AS at FROM ({jobs}) j")
def retry_times(t):
    text = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("k") % 2 == 0, ".250-01:30").otherwise("-01:30"))
    at = E.rfc3339(F.when(F.col("k") % 3 == 0, None).otherwise(text))
    return t("jobs").select("job_id", F.date_trunc("second", at).cast("timestamp_ntz").alias("at"))


@query("""SELECT path, array_to_string(string_split(path, '/')[1:-2], '/') AS parent, substring(path, length(string_split(path, '/')[1]) + 2) AS below, CASE WHEN starts_with(path, 'src1/') THEN substring(path, 6) END AS stripped,
 CASE WHEN starts_with(path, 'src1') THEN ltrim(substring(path, 5), '/') ELSE path END AS relative, 'base/' || path AS dest, '/data/' || path AS inside, true AS valid, path || '_final' AS final FROM ({files}) f""")
def request_paths(t):
    f = t("files").withColumn("root", F.split_part("path", F.lit("/"), F.lit(1)))
    return f.select(
        "path", E.parent_path("path").alias("parent"), requests.relative_strict("path", "root").alias("below"), E.strip_prefix("path", F.lit("src1")).alias("stripped"), E.relative_path("path", F.lit("src1")).alias("relative"),
        requests.destination(F.lit("base/"), "path", F.lit(1)).alias("dest"), requests.confined(F.concat(F.lit("./x/../"), "path"), F.lit("/data")).alias("inside"), E.valid_path("path").alias("valid"), E.final_id("path").alias("final"),
    )


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'key' || event_id WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'k' END AS key, CASE event_id % 4 WHEN 0 THEN 'tok' || event_id WHEN 1 THEN 'tok' ELSE NULL END AS token FROM {events}""")
def request_keys(t):
    n = F.col("event_id").cast("string")
    key = E.chain([(F.col("event_id") % 4 == 0, F.concat(F.lit("  key"), n, F.lit(" "))), (F.col("event_id") % 4 == 1, F.lit("   ")), (F.col("event_id") % 4 == 2, F.repeat(F.lit("é"), 128))], "k")
    head = E.chain([(F.col("event_id") % 4 == 0, F.concat(F.lit("Bearer  tok"), n)), (F.col("event_id") % 4 == 1, F.lit("BEARER tok")), (F.col("event_id") % 4 == 2, F.lit("Bearer a b"))], "Basic tok")
    return t("events").select("event_id", requests.idempotency_key(key).alias("key"), requests.bearer_token(head).alias("token"))


HEADS = ["89504E470D", "FFD8FFE000", "4749463839", "504B030414", "1F8B080000", "425A683931", "89504E", "00000000"]


@query(f"SELECT path, CASE WHEN cls <> 'Unknown' THEN cls WHEN h IN (0, 1, 2) THEN 'Image' WHEN h IN (3, 4, 5) THEN 'Archive' ELSE 'Unknown' END AS cls, CASE WHEN h IN (0, 1, 2) THEN 'Image' WHEN h IN (3, 4, 5) THEN 'Archive' ELSE 'Unknown' END AS magic FROM (SELECT path, id % 8 AS h, {CLASS} AS cls FROM ({{files}}) f) x")
def magic_type(t):
    content = F.unhex(E.chain([(F.col("id") % 8 == k, h) for k, h in enumerate(HEADS[:-1])], HEADS[-1]))
    f = t("files").withColumn("content", content)
    return f.select("path", E.file_class("path", "content").alias("cls"), E.class_by_magic("content").alias("magic"))


@query("SELECT k, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 10 ELSE greatest(1, least(22, k % 40)) END AS zstd, CASE k % 4 WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 11 ELSE greatest(0, least(11, k % 40)) END AS brotli, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 12 ELSE greatest(1, least(16, k % 40)) END AS lz4 FROM ({jobs}) j")
def compression_levels(t):
    name = E.chain([(F.col("k") % 4 == i, n) for i, n in enumerate(["fastest", "balanced", "best"])], "custom")
    j = t("jobs").select("k", name.alias("name"), (F.col("k") % 40).alias("own"))
    return j.select("k", *(E.compression_level(c, "name", "own").alias(c) for c in ("zstd", "brotli", "lz4")))


@query("""SELECT event_id, greatest(CASE WHEN event_id % 2 = 0 THEN r ELSE least(r, 64 // greatest(f, 1)) END, 1) AS budget, least(300.0, greatest(5.0, 10.0 * greatest(rtt / 50.0, 1.0) * 2.0))::DOUBLE AS timeout, CASE WHEN s <= 1048576 THEN 'High' WHEN s <= 10485760 THEN 'Normal' WHEN s <= 104857600 THEN 'Low' ELSE 'Background' END AS priority,
 CASE r % 5 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END AS chunk_mib, CASE WHEN event_id % 3 = 0 THEN 'again' ELSE 'no' END AS loop, cast(least(100 * pow(2, f), 10000) AS BIGINT) AS backoff FROM (SELECT event_id, cast(event_id % 70 AS INT) AS r, cast(event_id % 9 AS INT) AS f, (event_id % 5000)::DOUBLE AS rtt, event_id * 40000 AS s FROM {events}) x""")
def transfer_tuning(t):
    e = t("events").selectExpr("event_id", "cast(event_id % 70 AS INT) AS r", "cast(event_id % 9 AS INT) AS f", "cast(event_id % 5000 AS DOUBLE) AS rtt", "event_id * 40000 AS s")
    quality = E.chain([(F.col("r") % 5 == k, q) for k, q in enumerate(["Excellent", "Good", "Fair", "Poor"])], "Unknown")
    bind = E.chain([(F.col("event_id") % 3 == 0, F.concat(F.lit("127.0.0."), (F.col("event_id") % 200).cast("string"), F.lit(":80")))], "10.0.0.1:80")
    return e.select(
        "event_id", E.stream_budget(F.col("event_id") % 2 == 0, "r", "f").alias("budget"), E.operation_timeout(F.lit(10.0), "rtt", F.lit(2.0)).alias("timeout"), E.size_priority("s").alias("priority"),
        E.tuning(quality)["chunk_mib"].alias("chunk_mib"), F.when(E.is_loopback(bind), "again").otherwise("no").alias("loop"), E.backoff_ms("f").alias("backoff"),
    )


@query("""SELECT job_id, CASE WHEN status = 'pending' THEN 'Queued' WHEN status = 'paused' THEN 'Paused' WHEN k % 5 = 0 THEN '-' WHEN s >= 3600 THEN (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS label,
 CASE WHEN job_type = 'sync' THEN CASE WHEN is_last_round THEN 'Final Round ' ELSE 'Round ' END || round_id END AS badge FROM (SELECT *, k % 8000 AS s FROM ({jobs}) j) x""")
def job_labels(t):
    end = F.when(F.col("k") % 5 == 0, None).otherwise(F.expr("created_at + make_dt_interval(0, 0, 0, k % 8000)"))
    j = t("jobs").withColumns({"a": F.col("created_at").cast("timestamp"), "b": end.cast("timestamp")})
    return j.select("job_id", E.duration_label("a", "b", "status").alias("label"), E.round_badge("job_type", "round_id", "is_last_round").alias("badge"))


@query("WITH c AS (SELECT path, row_number() OVER (ORDER BY modified, path) AS r, count(*) OVER () AS n FROM ({files}) f) SELECT path FROM c WHERE r <= 100 AND n > 150 UNION ALL SELECT path FROM c WHERE n <= 150")
def cache_trim(t):
    return changes.trimmed(t("files"), 150, 100, ["modified", "path"]).select("path")


@query("SELECT job_id AS batch, coalesce(list_sort(list(k) FILTER (k % 3 <> 0)), [])::VARCHAR AS succeeded, coalesce(list_sort(list(k) FILTER (k % 3 = 0)), [])::VARCHAR AS failed FROM (SELECT job_id, cast(round(epoch_us(updated_at) / 86400000000) AS BIGINT) + length(file_path) AS k FROM ({transfer_states}) s) x GROUP BY job_id")
def batch_outcomes(t):
    r = t("transfer_states").select(F.col("job_id").alias("batch"), (F.round(F.unix_micros(F.col("updated_at").cast("timestamp")) / 86400000000).cast("long") + F.length("file_path")).alias("idx"))
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")).alias(c)
    return index.batch_outcome(r.withColumn("ok", F.col("idx") % 3 != 0)).select("batch", text("succeeded"), text("failed"))


@query("""SELECT path, n AS done, CASE WHEN total > 0 THEN cast(floor(least(n, total)::DOUBLE / total::DOUBLE * 100.0) AS INT) ELSE 0 END AS progress FROM
 (SELECT job_id || file_path AS path, total_chunks AS total, len(list_distinct(list_concat(range(0, done_chunks), range(total_chunks // 2, total_chunks)))) AS n FROM ({transfer_states}) s) x""")
def folded_progress(t):
    s = t("transfer_states").withColumn("path", F.concat("job_id", "file_path"))
    upto = lambda lo, hi: F.when(F.col(hi) > F.col(lo), F.sequence(F.col(lo), F.col(hi) - 1)).otherwise(F.array().cast("array<int>"))
    s = s.withColumns({"zero": F.lit(0), "half": F.floor(F.col("total_chunks") / 2).cast("int")})
    states = s.select("path", "total_chunks", upto("zero", "done_chunks").alias("completed"))
    return index.folded(states, s.select("path", upto("half", "total_chunks").alias("succeeded"))).select("path", F.size("completed").cast("long").alias("done"), "progress")


@query("""WITH u AS (SELECT 'u' || user_id AS job_id, epoch_ms(ts) AS at, event_id AS seq FROM {events}),
 s AS (SELECT 'u' || user_id AS job_id, epoch_ms(ts) - 1 AS at, CASE WHEN event_id % 3 = 0 THEN 'paused' ELSE 'syncing' END AS status FROM {events} WHERE event_type = 'click'),
 x AS (SELECT u.job_id, u.seq, s.status FROM u ASOF JOIN s ON u.job_id = s.job_id AND u.at >= s.at) SELECT job_id, seq, least(seq * 3, 5000) AS current FROM x WHERE status = 'syncing'""")
def accepted_progress(t):
    e = t("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"), F.col("event_id").alias("seq"), "event_type")
    u = e.select("job_id", "at_ms", "seq", (F.col("seq") * 3).alias("current"), F.lit(5000).cast("long").alias("total"))
    s = e.filter("event_type = 'click'").select("job_id", (F.col("at_ms") - 1).alias("at_ms"), F.when(F.col("seq") % 3 == 0, "paused").otherwise("syncing").alias("status"))
    return stability.accepted_progress(u, s).select("job_id", "seq", "current")


@query("""WITH RECURSIVE q AS (SELECT user_id, event_id AS seq, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 3 * 1048576 AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}),
 w AS (SELECT user_id, seq, n, true AS emit, size AS sent, ms AS sent_ms FROM q WHERE n = 1
 UNION ALL SELECT user_id, seq, n, go, CASE WHEN go THEN size ELSE sent END, CASE WHEN go THEN ms ELSE sent_ms END FROM
 (SELECT q.user_id, q.seq, q.n, q.size, q.ms, w.sent, w.sent_ms, q.size > w.sent AND (q.size - w.sent >= 10485760 OR q.ms - w.sent_ms >= 3600000) AS go FROM q JOIN w ON q.user_id = w.user_id AND q.n = w.n + 1) z)
 SELECT 'u' || user_id AS job_id, seq, emit FROM w""")
def throttled_progress(t):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    u = t("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"), (n * F.lit(3 * 1048576)).cast("long").alias("bytes"))
    return stability.progress_throttle(u, min_ms=3_600_000)


@query("SELECT job_id, job_id IN (SELECT job_id FROM ({jobs}) q WHERE status IN ('pending','syncing')) AS affected FROM (SELECT job_id FROM ({jobs}) j WHERE k % 5 = 0 UNION ALL SELECT 'none-' || job_id FROM ({jobs}) j WHERE k % 50 = 1) x")
def affected_rows(t):
    j = t("jobs")
    keys = j.filter("k % 5 = 0").select("job_id").unionByName(j.filter("k % 50 = 1").select(F.concat(F.lit("none-"), "job_id").alias("job_id")))
    return mutate.affected(j, keys, ["job_id"], F.col("status").isin("pending", "syncing"))


@query("SELECT job_id, file_path FROM ({transfer_states}) s WHERE job_id NOT IN (SELECT job_id FROM ({jobs}) j WHERE status = 'completed') AND NOT (total_chunks = done_chunks)")
def states_deleted(t):
    s = t("transfer_states")
    by_job = mutate.delete(s, jobs.with_status(t("jobs"), ["completed"]), ["job_id"])
    return mutate.delete(by_job, s.filter("total_chunks = done_chunks"), ["job_id", "file_path"]).select("job_id", "file_path")


@query("SELECT weak, doc_id, idx FROM ({chunks}) c WHERE doc_id NOT IN (SELECT id FROM ({files}) f WHERE path NOT IN (SELECT path FROM ({files_now}) n)) UNION ALL SELECT weak, doc_id, idx FROM ({chunks}) c WHERE false")
def hashes_without_files(t):
    c = t("chunks").join(t("files").select(F.col("id").alias("doc_id"), "path"), "doc_id")
    kept = index.without_files(c, changes.forgotten(t("files"), t("files_now")))
    return kept.unionByName(mutate.cleared(kept)).select("weak", "doc_id", "idx")


@query("SELECT path, size FROM ({files}) f WHERE path IN (SELECT path FROM ({files_now}) n)")
def retained_paths(t):
    return changes.retained(t("files"), t("files_now")).select("path", "size")


@query("SELECT doc_id, idx, strong FROM ({chunks}) c WHERE doc_id NOT IN (SELECT doc_id FROM ({chunks}) q WHERE idx = 3)")
def positional_hashes(t):
    c = t("chunks").withColumnsRenamed({"doc_id": "batch", "idx": "pos"})
    answered = c.filter("pos <> 3").select("batch", "pos", "strong")
    return index.zipped(c.select("batch", "pos"), answered).select(F.col("batch").alias("doc_id"), F.col("pos").alias("idx"), "strong")


@query("SELECT doc_id, idx, CASE WHEN idx % 3 = 2 THEN NULL ELSE strong END AS strong FROM ({chunks}) c")
def strong_written_back(t):
    c = t("chunks").withColumnsRenamed({"doc_id": "path", "idx": "offset"})
    have = c.withColumn("strong", F.when(F.col("offset") % 3 == 0, F.col("strong")))
    return index.strong_filled(have, c.filter("offset % 3 = 1").select("path", "offset", "strong")).select(F.col("path").alias("doc_id"), F.col("offset").alias("idx"), "strong")


@query("SELECT strong, count(DISTINCT doc_id * 1000000 + idx) AS n, min(doc_id) AS first_doc FROM ({chunks}) c GROUP BY strong")
def local_locations(t):
    c = t("chunks").select("strong", F.col("doc_id").alias("path"), F.col("idx").alias("offset"), "length")
    return index.local_matches(c.unionByName(c)).select("strong", F.size("locations").cast("long").alias("n"), F.element_at("locations", 1)["path"].alias("first_doc"))


VALID = f"{TS.format('n.modified', 'c.modified')} AND n.size = c.size"


@query(f"SELECT count_if(coalesce({VALID}, false))::BIGINT AS hits, count_if(NOT coalesce({VALID}, false))::BIGINT AS misses, (SELECT count(*) FROM ({{files}}) q) AS entries FROM ({{files_now}}) n LEFT JOIN ({{files}}) c ON n.path = c.path")
def chunk_cache_stats(t):
    return index.cache_stats(t("files_now"), t("files").withColumn("chunks", F.array(F.lit(1))))


@query("SELECT path, max(size) FILTER (src = 1) AS now_size, coalesce(max(size) FILTER (src = 1), max(size)) AS size FROM (SELECT path, size, 0 AS src FROM ({files}) f UNION ALL SELECT path, size, 1 FROM ({files_now}) n) u GROUP BY path")
def cache_put(t):
    put = mutate.put(t("files").select("path", "size"), t("files_now").select("path", "size"))
    return put.join(t("files_now").select("path", F.col("size").alias("now_size")), "path", "left").select("path", "now_size", "size")


@query("SELECT path, row_number() OVER (ORDER BY len(string_split(path, '/')), path) AS rank FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path FROM ({files_now}) f, unnest(range(1, len(string_split(path, '/')))) u(i)) d")
def directory_order(t):
    dirs = t("files_now").select(F.explode(E.ancestors("path")).alias("path")).distinct()
    ranked = changes.directories_first(dirs).withColumn("rank", F.monotonically_increasing_id())
    n = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("d"))
    return n.select(F.posexplode("d").alias("pos", "d")).select("d.path", (F.col("pos") + 1).cast("long").alias("rank"))


@query(f"""WITH l AS (SELECT path, modified FROM ({{files_now}}) n) SELECT c.doc_id, c.idx FROM ({{chunks}}) c JOIN (SELECT id, path, modified FROM ({{files}}) f) f ON f.id = c.doc_id JOIN l ON l.path = f.path WHERE {TS.format('f.modified', 'l.modified')}""")
def valid_index_locations(t):
    c = t("chunks").join(t("files").select(F.col("id").alias("doc_id"), "path", "modified"), "doc_id")
    return index.valid_locations(c, t("files_now")).select("doc_id", "idx")


@query("""SELECT doc_id, idx, outcome, outcome <> 'Success' AS from_network FROM (SELECT c.doc_id, c.idx, CASE WHEN n.path IS NULL THEN 'SourceNotFound' WHEN n.modified <> f.modified THEN 'SourceModified' WHEN c.idx % 7 = 6 THEN 'HashMismatch' ELSE 'Success' END AS outcome
 FROM ({chunks}) c JOIN ({files}) f ON f.id = c.doc_id LEFT JOIN ({files_now}) n ON n.path = f.path) x""")
def copy_results(t):
    c = t("chunks").join(t("files").select(F.col("id").alias("doc_id"), "path", "modified"), "doc_id").join(t("files_now").select("path", F.col("modified").alias("modified_now")), "path", "left")
    c = c.withColumn("read_strong", F.when(F.col("idx") % 7 == 6, F.sha2("strong", 256)).otherwise(F.col("strong")))
    return c.select("doc_id", "idx", dedup.copy_result().alias("outcome")).withColumn("from_network", F.col("outcome") != "Success")


@query("SELECT doc_id AS path, cast(sum(length) AS BIGINT) AS bytes FROM ({chunks}) c WHERE idx % 4 IN (1, 2) GROUP BY doc_id")
def new_bytes(t):
    c = t("chunks").withColumnRenamed("doc_id", "path")
    return index.newly_completed(c, c.filter("idx % 4 = 0"), c.filter("idx % 4 < 3"))


@query("""WITH RECURSIVE r AS (SELECT region, date_trunc('day', ts) AS w, count(*) AS total, count_if(NOT ok) AS failed, cast(sum(bytes) // 86400 AS BIGINT) AS tp FROM ({samples}) x GROUP BY ALL),
 q AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY w) AS n, count(*) OVER (PARTITION BY region) AS last FROM r),
 s AS (SELECT region, n, last, tp, cast(CASE WHEN failed::DOUBLE / total > 0.05 THEN 8 ELSE 18 END AS INT) AS c FROM q WHERE n = 1
 UNION ALL SELECT q.region, q.n, q.last, q.tp, cast(CASE WHEN q.failed::DOUBLE / q.total > 0.05 THEN greatest(cast(floor(s.c * 0.5) AS INT), 4) WHEN q.tp > s.tp OR s.tp = 0 THEN least(s.c + 2, 64) ELSE s.c END AS INT) FROM q JOIN s ON q.region = s.region AND q.n = s.n + 1)
 SELECT region, c AS streams FROM s WHERE n = last""")
def throughput_concurrency(t):
    w = t("samples").groupBy("region", F.date_trunc("day", "ts").alias("window")).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("failed"), F.floor(F.sum("bytes") / 86400).alias("throughput"))
    return adaptive.throughput_concurrency(w)


@query("SELECT j.job_id, coalesce(r.round_id, 0) AS round_id, coalesce(r.is_last_round, false) AS is_last_round FROM ({jobs}) j LEFT JOIN ({runtime}) r ON j.job_id = r.job_id")
def restored_rounds(t):
    r = t("runtime")
    marks = r.withColumn("seq", F.lit(2)).unionByName(r.withColumns({"seq": F.lit(1), "round_id": F.lit(99).cast("long")}))
    return rounds.restored(t("jobs").select("job_id", "round_id", "is_last_round"), marks)


@query("SELECT event_type AS protocol, count(*) AS total, count_if(event_id % 7 <> 0)::BIGINT AS ok FROM {events} GROUP BY event_type")
def protocol_counts(t):
    return adaptive.protocol_counts(t("events").select(F.col("event_type").alias("protocol"), (F.col("event_id") % 7 != 0).alias("ok")))


@query(f"SELECT job_id, CASE WHEN k % 3 = 0 THEN i WHEN w THEN least(i, CASE WHEN st > 0 THEN st ELSE 100 END) ELSE i END AS delay FROM (SELECT job_id, k, k * 10 AS i, (k % 5) * 1000 AS st, k % 3 = 1 AS w FROM ({{jobs}}) j WHERE status IN {ACTIVE}) x")
def next_round_delay(t):
    j = jobs.with_status(t("jobs"), jobs.ACTIVE).select("job_id", (F.col("k") * 10).alias("i"), ((F.col("k") % 5) * 1000).alias("st"), (F.col("k") % 3 == 1).alias("w"))
    return j.select("job_id", rounds.next_delay_ms("i", "st", "w").alias("delay"))


@query("SELECT 'd/' || doc_id || '.txt' AS path, octet_length(encode(coalesce(text, ''))) AS size, true AS restored, true AS no_larger FROM {documents}")
def compress_round_trip(t):
    d = t("documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    packed = codec.smart(d, "path", "content")
    same = codec.unpack("packed", "algorithm") == F.col("content")
    return packed.select("path", F.length("content").cast("long").alias("size"), same.alias("restored"), (F.length("packed") <= F.length("content")).alias("no_larger"))


@query("SELECT doc_id AS path, cast(octet_length(encode(text)) AS BIGINT) AS bytes, true AS tiled, true AS bounded FROM {documents} WHERE octet_length(encode(text)) > 0")
def fastcdc_tiling(t):
    c = chunking.content_chunks(t("documents"), "doc_id", "text", chunking.Profile(256, 1024, 4096)).withColumn("end", F.col("offset") + F.col("length"))
    whole = c.groupBy("path").agg(F.sum("length").alias("bytes"), F.max("end").alias("last"), F.min("offset").alias("first"), F.max("length").alias("longest"), F.count_if(F.col("length") < 256).alias("short"), F.array_sort(F.collect_list("offset")).alias("starts"), F.array_sort(F.collect_list("end")).alias("ends"))
    n = F.size("starts")
    joined = F.slice("starts", 2, n - 1) == F.slice("ends", 1, n - 1)
    tiled = (F.col("first") == 0) & (F.col("last") == F.col("bytes")) & ((n == 1) | joined)
    return whole.select("path", F.col("bytes").cast("long").alias("bytes"), tiled.alias("tiled"), ((F.col("longest") <= 4096) & (F.col("short") <= 1)).alias("bounded"))


@query(EWMA.replace("epoch_us(ts) AS us", "epoch_us(ts) // 50000 AS us"))
def ewma_dense_samples(t):
    """The samples of all regions at a fifty-thousandth of their distances, most of which are below 100 ms."""
    s = t("samples").withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 50000)))
    return adaptive.ewma_bandwidth(s).select("region", F.round("mbps", 4).alias("mbps"), "quality")
