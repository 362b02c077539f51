"""Stability of files over repeated scans: as a replay over stored scans, and as a stateful stream."""

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

THRESHOLD_SECONDS = 20


def micros(ts):
    """Microseconds of a timestamp with or without zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def replay(scans: DataFrame, threshold: int = THRESHOLD_SECONDS) -> DataFrame:
    """(path, seq, stable) for scans (path, seq, scan_ts, size, modified as timestamps) (K1, K2).

    Old files are stable at once and leave the state alone; among the others, runs of equal size and time
    are islands, and a scan is stable when its island began at least ``threshold`` seconds before.
    """
    us = F.lit(threshold * 1_000_000)
    s = scans.withColumn("old", micros("scan_ts") - micros("modified") > us)
    order = Window.partitionBy("path", "old").orderBy("scan_ts", "seq")
    new = ~(F.lag("size").over(order).eqNullSafe(F.col("size")) & F.lag("modified").over(order).eqNullSafe(F.col("modified"))) | (F.row_number().over(order) == 1)
    s = s.withColumn("island", F.sum(new.cast("int")).over(order))
    first = F.min("scan_ts").over(Window.partitionBy("path", "old", "island"))
    stable = F.col("old") | (micros("scan_ts") - micros(first) >= us)
    return s.select("path", "seq", stable.alias("stable"))


def stable_stream(scans: DataFrame, threshold: int = THRESHOLD_SECONDS) -> DataFrame:
    """The same for a streaming DataFrame, keyed state per path (size, time, first seen). The state goes once
    the file's time is more than ``threshold`` old, by the time of the scan that is read or by the clock
    (K3): such a file is stable at once, whenever it is seen again."""

    def step(key, batches, state: GroupState):
        held = state.get if state.exists else None
        limit = dt.timedelta(seconds=threshold)
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["scan_ts", "seq"])
        out = []
        for r in rows.itertuples():
            if held is not None and r.scan_ts - held[1] > limit:
                held = None
            if r.scan_ts - r.modified > limit:
                out.append((key[0], r.seq, True))
                continue
            stamp = (int(r.size), r.modified.to_pydatetime())
            if held is None or (held[0], held[1]) != stamp:
                held = (*stamp, r.scan_ts.to_pydatetime())
            out.append((key[0], r.seq, r.scan_ts.to_pydatetime() - held[2] >= limit))
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            state.setTimeoutDuration(threshold * 1000 + 1)
        yield pd.DataFrame(out, columns=["path", "seq", "stable"])

    return scans.groupBy("path").applyInPandasWithState(
        step, "path string, seq long, stable boolean", "size long, modified timestamp, since timestamp", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def progress_throttle(updates: DataFrame, min_bytes: int = 10 * 1024 * 1024, min_ms: int = 500) -> DataFrame:
    """(job_id, seq, emit): a report goes out when it grew, and by enough bytes or time since the last one
    that went out (K12). Rows of a job are read in order as a stream of sorted rows, whatever their number."""

    def run(batches):
        job = sent_bytes = sent_at = None
        for b in batches:
            emit = []
            for j, at, size in zip(b["job_id"], b["at_ms"], b["bytes"]):
                if j != job:
                    job, sent_bytes, sent_at = j, 0, None
                grew = size - sent_bytes
                go = grew > 0 and (grew >= min_bytes or sent_at is None or at - sent_at >= min_ms)
                if go:
                    sent_bytes, sent_at = size, at
                emit.append(go)
            yield b[["job_id", "seq"]].assign(emit=emit)

    rows = updates.select("job_id", "seq", "at_ms", "bytes").repartition("job_id").sortWithinPartitions("job_id", "at_ms", "seq")
    return rows.mapInPandas(run, "job_id string, seq long, emit boolean")


def accepted_progress(updates: DataFrame, statuses: DataFrame) -> DataFrame:
    """Progress counts only while its job is syncing, and never beyond the total (K13): the status as of
    each update is the last one before it, found by one window over both kinds of rows."""
    u = updates.select("job_id", "at_ms", F.lit(1).alias("kind"), "seq", "current", "total", F.lit(None).cast("string").alias("status"))
    s = statuses.select("job_id", "at_ms", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("current"), F.lit(None).cast("long").alias("total"), "status")
    as_of = F.last("status", ignorenulls=True).over(Window.partitionBy("job_id").orderBy("at_ms", "kind").rowsBetween(Window.unboundedPreceding, 0))
    both = u.unionByName(s).withColumn("as_of", as_of).filter("kind = 1 AND as_of = 'syncing'")
    return both.select("job_id", "seq", F.least("current", "total").alias("current"), "total")


def newest_generation(rows: DataFrame) -> DataFrame:
    """Rows of each job's newest generation; older ones are late writes."""
    top = rows.groupBy("job_id").agg(F.max("generation").alias("generation"))
    return rows.join(top, ["job_id", "generation"], "left_semi")
