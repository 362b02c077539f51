"""The job store: reads, overlay by runtime rows, pages, counts, permissions, retries, overlaps.

Every function maps DataFrames to a DataFrame and is lazy; ``now`` is always an argument.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E

STATUSES = ["pending", "syncing", "paused", "completed", "failed", "cancelled"]
ACTIVE = ["pending", "syncing", "paused"]
TERMINAL = ["completed", "failed", "cancelled"]
TYPES = ["once", "full", "sync"]
DEFAULT_LIMIT, MAX_LIMIT = 100, 500


def is_active(status="status") -> Column:
    return E.col(status).isin(ACTIVE)


def is_final_transfer(job_type="job_type", last="is_last_round") -> Column:
    """The round after which the job ends."""
    return E.col(job_type).isin("once", "full") | E.col(last)


def by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def statuses_of(jobs: DataFrame, ids: list[str]) -> DataFrame:
    """(job_id, status) of the ids listed; none for an empty list."""
    return jobs.filter(F.col("job_id").isin(ids) if ids else F.lit(False)).select("job_id", "status")


def listed(jobs: DataFrame) -> DataFrame:
    """Newest first, equal times by id."""
    return jobs.orderBy(F.desc("created_at"), F.asc("job_id"))


def with_status(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """Active (B4) or terminal (B5) jobs."""
    return jobs.filter(F.col("status").isin(statuses))


def active_destinations(jobs: DataFrame) -> DataFrame:
    return with_status(jobs, ACTIVE).select("job_id", "dest_path")


def decoded(jobs: DataFrame, strict: bool = True) -> DataFrame:
    """Rows whose status and type are known; unknown ones fail the query, or are left out."""
    ok = F.lower("status").isin(STATUSES) & F.lower("job_type").isin(TYPES)
    if not strict:
        return jobs.filter(F.coalesce(ok, F.lit(False)))
    shown = F.concat(F.lit("unknown status or type: "), F.coalesce("status", F.lit("null")), F.lit(" "), F.coalesce("job_type", F.lit("null")))
    return jobs.withColumn("status", F.when(ok, F.col("status")).otherwise(F.raise_error(shown)))


def clamp_limit(limit: int | None) -> int:
    """Between 1 and 500, 100 by default."""
    return DEFAULT_LIMIT if limit is None else min(max(limit, 1), MAX_LIMIT)


def clamp_page(total: int, page: int, limit: int) -> int:
    return 0 if total == 0 else min(page, (total - 1) // limit)


def page(jobs: DataFrame, number: int, limit: int, public: bool = False) -> DataFrame:
    """A page; sorting, skipping and limiting is one top-k step, not a sort of all rows."""
    rows = jobs.filter(E.is_public("job_id")) if public else jobs
    return listed(rows).offset(number * limit).limit(limit)


def lenient_page(jobs: DataFrame, number: int, limit: int, public: bool = False) -> DataFrame:
    """A page from which rows that can't be decoded are left out afterwards, so that it may be short."""
    return decoded(page(jobs, number, limit, public), strict=False)


def persisted_window(start, size, runtime_only) -> Column:
    """struct(offset, limit) of stored rows that surely cover a merged page (F8)."""
    start, size, extra = E.col(start), E.col(size), E.col(runtime_only)
    some = F.struct(F.greatest(start - extra, F.lit(0)).cast("long").alias("offset"), (size + 2 * extra).cast("long").alias("limit"))
    return F.when(extra == 0, F.struct(start.cast("long").alias("offset"), size.cast("long").alias("limit"))).otherwise(some)


def by_key(rows: DataFrame, **key) -> DataFrame:
    """The rows of one key of one or more columns."""
    return rows.filter(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in key.items()]))


def checked_states(states: DataFrame) -> DataFrame:
    """Transfer states; a negative size or inode fails the query."""
    bad = F.coalesce((F.col("source_size") < 0) | (F.col("source_inode") < 0), F.lit(False))
    return states.withColumn("source_size", F.when(bad, F.raise_error(F.lit("negative size or inode")).cast("long")).otherwise(F.col("source_size")))


def newest_first(rows: DataFrame) -> DataFrame:
    """By the time of the last change, newest first."""
    return rows.orderBy(F.desc("updated_at"))


def skipped_enqueue(jobs: DataFrame, retries: DataFrame) -> DataFrame:
    """(job_id, skip): paused and ended jobs are not queued, failed ones only with tries left."""
    j = jobs.select("job_id", "status").join(retryable(retries).withColumn("left", F.lit(True)), "job_id", "left")
    skip = F.when(F.col("status").isin("paused", "cancelled", "completed"), True).when(F.col("status") == "failed", F.col("left").isNull()).otherwise(False)
    return j.select("job_id", skip.alias("skip"))


def adjusted_counts(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """(status, n) with the deltas added; a count of zero has no row."""
    return counts.select("status", "n").unionByName(deltas.select("status", F.col("delta").alias("n"))).groupBy("status").agg(F.sum("n").alias("n")).filter("n <> 0")


def counts_by_status(jobs: DataFrame, public: bool = False) -> DataFrame:
    rows = jobs.filter(E.is_public("job_id")) if public else jobs
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stats(counts: DataFrame) -> DataFrame:
    """One row: total and a column per status; ``running`` are those syncing."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias("running" if s == "syncing" else s)
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *(of(s) for s in STATUSES))


OVERLAID = ["status", "current_size", "total_size", "region", "error_message", "round_id", "is_last_round", "updated_at"]


def snapshot(jobs: DataFrame, runtime: DataFrame) -> DataFrame:
    """Stored rows under runtime rows, which win whole: their null error message counts too."""
    r = runtime.select("job_id", "created_at", *OVERLAID)
    both = jobs.alias("p").join(r.alias("r"), "job_id", "full_outer")
    live = F.col("r.created_at").isNotNull() | F.col("r.status").isNotNull()
    out = [F.when(live, F.col(f"r.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in OVERLAID]
    kept = [F.coalesce(F.col("p.job_type"), F.lit("once")).alias("job_type"), F.coalesce("p.priority", F.lit(0)).alias("priority"), F.coalesce("p.created_at", "r.created_at").alias("created_at")]
    return both.select("job_id", *out, *kept)


def status_counts_overlay(jobs: DataFrame, runtime: DataFrame) -> DataFrame:
    """Counts where the runtime status replaces the stored one and a final round counts for its job."""
    base = lambda d: d.select(F.regexp_replace("job_id", "_final$", "").alias("id"), "status", F.endswith("job_id", F.lit("_final")).alias("final"))
    live = base(runtime).groupBy("id").agg(F.max_by("status", "final").alias("live"))
    stored = jobs.filter(E.is_public("job_id")).select(F.col("job_id").alias("id"), "status")
    return stored.join(live, "id", "full_outer").groupBy(F.coalesce("live", "status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def public_view(jobs: DataFrame, runtime: DataFrame) -> DataFrame:
    """Status and round shown to users: a sync job's final round first, then its own, then the stored
    row (C18, C19). Two joins on the id; a final row is reached by the id with its suffix."""
    r = runtime.select("job_id", F.struct("status", "current_size", "total_size").alias("v"), "round_id", "is_last_round")
    own = r.select("job_id", F.col("v").alias("own"), F.col("round_id").alias("own_round"), F.col("is_last_round").alias("own_last"))
    final = r.select(F.col("job_id").alias("final_id"), F.col("v").alias("fin"), F.col("round_id").alias("fin_round"))
    j = jobs.filter(E.is_public("job_id")).join(own, "job_id", "left")
    j = j.withColumn("final_id", F.when(F.col("job_type") == "sync", E.final_id("job_id"))).join(final, "final_id", "left")
    shown = F.coalesce("fin", "own", F.struct("status", "current_size", "total_size"))
    round_id = F.coalesce("own_round", F.greatest("fin_round", F.lit(1)), "round_id", F.lit(0))
    last = F.when(F.col("own").isNotNull(), F.col("own_last")).when(F.col("fin").isNotNull(), F.lit(True)).otherwise(F.coalesce("is_last_round", F.lit(False)))
    progress = E.percent(shown.current_size, shown.total_size)
    return j.select("job_id", shown.status.alias("status"), progress.alias("progress"), round_id.cast("long").alias("round_id"), last.alias("is_last_round"), E.round_badge("job_type", round_id, last).alias("badge"))


def retryable(retries: DataFrame) -> DataFrame:
    """Ids with tries left."""
    return retries.filter("retry_count < max_retries").select("job_id").distinct()


def permissions(jobs: DataFrame, retries: DataFrame) -> DataFrame:
    """(job_id, can_cancel, can_finalize)."""
    left = retryable(retries).withColumn("left", F.lit(True))
    final = jobs.filter(~E.is_public("job_id")).select(F.col("job_id").alias("final_id"), F.col("status").alias("final_status"))
    j = jobs.join(left, "job_id", "left").withColumn("final_id", E.final_id("job_id")).join(final, "final_id", "left")
    j = j.join(left.select(F.col("job_id").alias("final_id"), F.col("left").alias("final_left")), "final_id", "left")
    sync = (F.col("job_type") == "sync") & E.is_public("job_id")
    own, fin_left = F.coalesce("left", F.lit(False)), F.coalesce("final_left", F.lit(False))
    fin_active = F.coalesce(is_active("final_status"), F.lit(False))
    fin_failed = F.coalesce(F.col("final_status") == "failed", F.lit(False))
    cancel = is_active() | ((F.col("status") == "failed") & (own | (sync & (fin_active | (fin_failed & fin_left)))))
    finalize = sync & ~fin_active & ~fin_left & (F.col("status").isin("pending", "syncing") | ((F.col("status") == "failed") & (own | fin_failed)))
    return j.select("job_id", cancel.alias("can_cancel"), finalize.alias("can_finalize"))


def due_retries(retries: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The first ``limit`` retries that are due and have tries left."""
    return retries.filter((F.col("retry_count") < F.col("max_retries")) & (F.col("next_retry_at") <= now)).orderBy("next_retry_at", "job_id").limit(limit)


def retry_actions(retries: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """(job_id, action): what a retry round does with each due row."""
    due = retries.filter((F.col("retry_count") < F.col("max_retries")) & (F.col("next_retry_at") <= now))
    j = due.join(jobs.select("job_id", "status"), "job_id", "left")
    action = F.when(F.col("status").isin("completed", "cancelled"), "drop").when(is_active(), "wait").when(F.col("status").isNull(), "drop").otherwise("enqueue")
    return j.select("job_id", action.alias("action"))


def failure_actions(jobs: DataFrame, retries: DataFrame) -> DataFrame:
    """(job_id, action) of failed jobs: keep and schedule, or purge."""
    j = jobs.filter("status = 'failed'").join(retryable(retries).withColumn("left", F.lit(True)), "job_id", "left")
    return j.select("job_id", F.when(F.col("left"), "schedule").otherwise("purge").alias("action"))


def queue_order(jobs: DataFrame) -> DataFrame:
    """Active jobs in the order they run: smaller priority first, then first come."""
    return jobs.filter(is_active()).select("job_id", "priority", "created_at").orderBy("priority", "created_at", "job_id")


def delayed_ready(queue: DataFrame, now: Column) -> DataFrame:
    """One entry per job, its latest, of those that are ready, in time order."""
    latest = queue.groupBy("job_id").agg(F.max_by(F.struct("run_at", "seq"), "seq").alias("e")).select("job_id", "e.*")
    return latest.filter(F.col("run_at") <= now).orderBy("run_at", "seq")


def overlapping_destinations(jobs: DataFrame) -> DataFrame:
    """(job_id, other_id): pairs of active jobs of which one writes into the other's destination or below
    it (C23-C25). An equal-keys join of each path with all ancestors-or-self of the others, not a product
    of all pairs; a job and its own final round may share a destination."""
    a = active_destinations(jobs).select("job_id", E.normalized_path("dest_path").alias("path"))
    inner = a.select(F.col("job_id").alias("other_id"), F.explode(F.array_append(E.ancestors("path"), F.col("path"))).alias("path"))
    pair = (F.col("job_id") != F.col("other_id")) & (F.col("job_id") != E.final_id("other_id")) & (F.col("other_id") != E.final_id("job_id"))
    p = a.join(inner, "path").filter(pair)
    return p.select(F.least("job_id", "other_id").alias("job_id"), F.greatest("job_id", "other_id").alias("other_id")).distinct()


def final_propagation(events: DataFrame) -> DataFrame:
    """(job_id, status): the last event of each job, a final round's counting for its job."""
    e = events.withColumn("job_id", F.regexp_replace("job_id", "_final$", ""))
    return e.groupBy("job_id").agg(F.max_by("status", F.struct("seq", "status")).alias("status"))


def resolved_statuses(jobs: DataFrame, runtime: DataFrame, ids: DataFrame) -> DataFrame:
    """(job_id, status) of the ids asked for: the runtime's, else the stored one (C17)."""
    live = runtime.select("job_id", F.col("status").alias("live"))
    j = ids.select("job_id").distinct().join(jobs.select("job_id", "status"), "job_id", "left").join(live, "job_id", "left")
    return j.select("job_id", F.coalesce("live", "status").alias("status")).filter("status IS NOT NULL")


def with_active_final(jobs: DataFrame) -> DataFrame:
    """Jobs whose final round exists and is active: a semi-join on the derived id."""
    final = jobs.filter(F.endswith("job_id", F.lit("_final")) & is_active()).select(F.regexp_replace("job_id", "_final$", "").alias("job_id"))
    return jobs.join(final, "job_id", "left_semi")
