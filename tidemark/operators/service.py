"""Answers of the service's calls, for many calls at once: calls and the job store in, (call, code, ...) out.

``code`` is the HTTP status. What a call changes follows from ``action`` through ``mutate``.
"""

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import requests as R
from . import jobs as J

TYPES = ("once", "full", "sync")


def patterns_ok(patterns: str) -> Column:
    """Whether all patterns of a list are in the supported dialect."""

    def one(ps):
        try:
            R.check_patterns([] if ps is None else list(ps))
        except Exception:
            return False
        return True

    def all_of(column: pd.Series) -> pd.Series:
        return column.map(one).astype(bool)

    return F.pandas_udf(all_of, "boolean")(patterns)


def first_fault(faults: list[tuple[Column, str]]) -> Column:
    """The text of the first fault that holds; null without any."""
    return reduce(lambda rest, f: F.when(F.coalesce(f[0], F.lit(True)), f[1]).otherwise(rest), reversed(faults), F.lit(None).cast("string"))


def request_faults(data_dir: str, external: bool = False) -> Column:
    """What is wrong with a request by itself, in the order of the checks; missing values are faults."""
    blank = lambda c: F.trim(c) == ""
    nul = lambda c: F.contains(c, F.lit("\0"))
    full = E.normalized_path(F.when(F.startswith("dest_path", F.lit("/")), F.col("dest_path")).otherwise(E.join_path(F.lit(data_dir), "dest_path")))
    outside = F.lit(False) if external else E.strip_prefix(full, F.lit(data_dir)).isNull()
    fields = [(blank(c), f"{c} is required") for c in ("source_path", "dest_path", "region")]
    fields += [x for c in ("source_path", "dest_path") for x in ((nul(c), f"{c} contains invalid null byte"), (~E.valid_path(c), f"{c} must not contain '..'"))]
    fields += [(outside, "dest_path is not allowed"), (~patterns_ok("exclude_regex"), "exclude_regex is invalid"), (~patterns_ok("include_regex"), "include_regex is invalid")]
    return first_fault([*fields, (F.col("known").isNull(), "unknown region"), (~F.lower("job_type").isin(*TYPES), "unknown job_type")])


def overlap(a: Column, b: Column) -> Column:
    """One path is the other or lies above it."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def active_overlaps(rows: DataFrame, key: str, jobs: DataFrame) -> DataFrame:
    """(key, active): how many active jobs' destinations overlap each row's ``dest``; rows without any are left
    out. Active jobs are counted by directory before the joins, so that no pairs of jobs arise (C23)."""
    dirs = J.active_destinations(jobs).groupBy(E.normalized_path("dest_path").alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    own = rows.select(key, E.normalized_path("dest").alias("own"))
    above = own.select(key, F.explode(F.array_append(E.ancestors("own"), F.col("own"))).alias("dir")).join(dirs, "dir").select(key, "n")
    under = dirs.select(F.explode(E.ancestors("dir")).alias("own"), "n").groupBy("own").agg(F.sum("n").alias("n"))
    return above.unionByName(own.join(under, "own").select(key, "n")).groupBy(key).agg(F.sum("n").alias("active"))


def create_answers(calls: DataFrame, jobs: DataFrame, regions: DataFrame, data_dir: str = "/data", external: bool = False) -> DataFrame:
    """(call, code, message, job_id) of requests to create jobs.

    ``calls``: call, seq, source_path, dest_path, region, job_type, exclude_regex, include_regex, key (or
    null). Of the calls with one key the first that is in order owns it: equal requests get its job, others a
    conflict. A destination that overlaps one of an active job is a conflict too; calls are not held against
    each other, as each is answered from the store as given.
    """
    c = calls.join(F.broadcast(regions.select(F.col("region"), F.lit(True).alias("known")).distinct()), "region", "left").withColumn("fault", request_faults(data_dir, external))
    none = F.array().cast("array<string>")
    print_ = R.request_fingerprint("source_path", "dest_path", F.lower("job_type"), F.coalesce("exclude_regex", none), F.coalesce("include_regex", none))
    c = c.withColumn("print", F.when(F.col("fault").isNull() & F.col("key").isNotNull(), print_))
    owners = c.filter("print IS NOT NULL").groupBy("key").agg(F.min_by(F.struct("print", "call"), "seq").alias("owner"))
    taken = active_overlaps(c.filter("fault IS NULL").select("call", F.col("dest_path").alias("dest")), "call", jobs)
    j = c.join(owners, "key", "left").join(taken, "call", "left")
    other = F.col("print").isNotNull() & (F.col("owner.print") != F.col("print"))
    again = F.col("print").isNotNull() & (F.col("owner.call") != F.col("call"))
    message = F.coalesce("fault", F.when(other, "idempotency key is already used").when((F.coalesce("active", F.lit(0)) > 0) & ~again, "destination overlaps an active job"))
    code = F.when(F.col("fault").isNotNull(), 400).when(message.isNotNull(), 409).otherwise(200)
    return j.select("call", code.alias("code"), message.alias("message"), F.when(code == 200, F.concat(F.lit("job-of-"), F.coalesce("owner.call", "call"))).alias("job_id"))


def with_final(calls: DataFrame, jobs: DataFrame, retries: DataFrame) -> DataFrame:
    """Calls with their job's row, its final round's and whether each has tries left."""
    left = J.retryable(retries).withColumn("left", F.lit(True))
    own = jobs.select("job_id", "job_type", "status", "dest_path")
    final = jobs.select(F.col("job_id").alias("final_id"), F.col("status").alias("final_status"))
    j = calls.select("job_id").distinct().join(own, "job_id", "left").join(left, "job_id", "left").withColumn("final_id", E.final_id("job_id")).join(final, "final_id", "left")
    return j.join(left.select(F.col("job_id").alias("final_id"), F.col("left").alias("final_left")), "final_id", "left").withColumns(
        {"left": F.coalesce("left", F.lit(False)), "final_left": F.coalesce("final_left", F.lit(False)), "absent": ~E.is_public("job_id") | F.col("status").isNull()}
    )


def final_is_active() -> Column:
    return F.coalesce(J.is_active("final_status") | ((F.col("final_status") == "failed") & F.col("final_left")), F.lit(False))


def cancel_answers(calls: DataFrame, jobs: DataFrame, retries: DataFrame) -> DataFrame:
    """(job_id, code, target_id, action) of requests to cancel (A30, B36). An active final round is cancelled in
    its job's place; cancelling twice is no error, cancelling what has ended is a conflict."""
    to_final = (F.col("job_type") == "sync") & final_is_active()
    action = (
        F.when(F.col("absent"), None)
        .when(to_final, "cancel")
        .when((F.col("status") == "completed") & F.col("left"), "drop retry")
        .when(F.col("status") == "cancelled", "none")
        .when((F.col("status") == "completed") | ((F.col("status") == "failed") & ~F.col("left")), "refuse")
        .otherwise("cancel")
    )
    code = F.when(F.col("absent"), 404).when(action == "refuse", 409).otherwise(200)
    target = F.when(F.col("absent"), None).when(to_final, F.col("final_id")).otherwise(F.col("job_id"))
    return with_final(calls, jobs, retries).select("job_id", code.alias("code"), target.alias("target_id"), action.alias("action"))


def finalize_answers(calls: DataFrame, jobs: DataFrame, retries: DataFrame) -> DataFrame:
    """(job_id, code, action) of requests for a last round (A30, B37). It starts for pending and running sync jobs, and
    for failed ones that have tries left or whose last round failed for good; where it runs or is done,
    asking again is no error. Another active job at the destination is a conflict; the job's own is not."""
    done = final_is_active() | F.coalesce(F.col("final_status") == "completed", F.lit(False))
    failed_final = F.coalesce((F.col("final_status") == "failed") & ~F.col("final_left"), F.lit(False))
    starts = F.col("status").isin("pending", "syncing") | ((F.col("status") == "failed") & (F.col("left") | failed_final))
    c = with_final(calls, jobs, retries).join(jobs.select(F.col("job_id").alias("final_id"), F.col("dest_path").alias("final_dest")), "final_id", "left")
    c = c.join(active_overlaps(c.filter("dest_path IS NOT NULL").select("job_id", F.col("dest_path").alias("dest")), "job_id", jobs), "job_id", "left")
    own = J.is_active().cast("int") + F.coalesce((J.is_active("final_status") & overlap(E.normalized_path("dest_path"), E.normalized_path("final_dest"))).cast("int"), F.lit(0))
    taken = F.coalesce(F.col("active"), F.lit(0)) > own
    action = F.when(F.col("absent"), None).when(F.col("job_type") != "sync", "refuse").when(done, "none").when(~starts, "refuse").when(taken, "conflict").otherwise("start")
    code = F.when(F.col("absent"), 404).when(action == "refuse", 400).when(action == "conflict", 409).otherwise(200)
    return c.select("job_id", code.alias("code"), action.alias("action"))


def get_answers(calls: DataFrame, jobs: DataFrame, runtime: DataFrame, retries: DataFrame) -> DataFrame:
    """(job_id, code, the public view, permissions) of requests for jobs (A30); an id of a final round is unknown.
    What is unknown can be neither cancelled nor finalised."""
    seen = J.public_view(jobs, runtime).join(J.permissions(jobs, retries), "job_id", "left").withColumn("there", F.lit(True))
    j = calls.select("job_id").distinct().join(seen, "job_id", "left")
    return j.select("job_id", F.when(F.col("there"), 200).otherwise(404).alias("code"), "status", "progress", "round_id", "is_last_round", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("can_cancel", "can_finalize")))


def health(jobs: DataFrame) -> DataFrame:
    """One row as long as the store can be read."""
    return jobs.agg(F.count(F.lit(1)) >= 0).select(F.lit("ok").alias("status"))
