"""Bandwidth and concurrency: folds over bounded, ordered arrays."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E

SAMPLES = 20
ALPHA = 0.3
MIN_STREAMS, MAX_STREAMS = 4, 64


MIN_GAP_MS = 100


def last_samples(samples: DataFrame, most: int = SAMPLES, min_gap_ms: int = MIN_GAP_MS) -> DataFrame:
    """(region, rank, mbps) of the newest samples of each region, rank 1 the newest. A sample counts if it took a
    millisecond and comes ``min_gap_ms`` or more after the last one that counted (E2). Which ones count depends
    on all before them, so that a region's rows are read in order as a stream; ``most`` of them are held."""

    def run(batches):
        region, kept, last, any_row = None, [], None, False

        def close():
            return pd.DataFrame({"region": region, "rank": range(len(kept), 0, -1), "mbps": kept})

        for b in batches:
            out = []
            for r, us, size, ms in zip(b["region"], b["us"], b["bytes"], b["duration_ms"]):
                if any_row and r != region:
                    out.append(close())
                if not any_row or r != region:
                    region, kept, last, any_row = r, [], None, True
                if ms >= 1 and (last is None or us - last >= 1000 * min_gap_ms):
                    kept, last = [*kept[-most + 1 :], size * 8.0 / (ms / 1000.0) / 1e6], us
            if out:
                yield pd.concat(out)
        if any_row:
            yield close()

    kind = samples.schema["region"].dataType.simpleString()
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    rows = samples.filter("bytes IS NOT NULL AND duration_ms IS NOT NULL").select("region", us, "seq", "bytes", "duration_ms")
    return rows.repartition("region").sortWithinPartitions("region", "us", "seq").mapInPandas(run, f"region {kind}, rank int, mbps double")


def ewma_bandwidth(samples: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(region, mbps, quality, streams): exponentially weighted over at most 20 samples."""
    s = last_samples(samples)
    a = s.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("rank"), "mbps"))), lambda x: x.mbps).alias("xs"))
    fold = F.aggregate(F.slice("xs", 2, SAMPLES), F.col("xs")[0], lambda acc, x: F.lit(alpha) * x + F.lit(1 - alpha) * acc)
    a = a.select("region", fold.alias("mbps")).withColumn("quality", E.network_quality("mbps"))
    return a.withColumn("streams", E.initial_concurrency("quality"))


def next_streams(now, ok, failed, quality):
    """Concurrency after a round with so many successes and failures."""
    total = ok + failed
    rate = F.when(total > 0, failed.cast("double") / total).otherwise(F.lit(0.0))
    target = E.initial_concurrency(quality)
    cap = lambda x: F.least(x, F.lit(MAX_STREAMS))
    return (
        F.when(rate > 0.1, F.greatest(F.floor(now * 0.5).cast("int"), F.lit(MIN_STREAMS)))
        .when((quality == "Excellent") & (ok > 20), cap(now + 4))
        .when((quality == "Good") & (ok > 10), cap(now + 2))
        .when(quality.isin("Fair", "Unknown") & (rate < 0.05) & (ok > 5), cap(now + 1))
        .when(quality.isin("Poor", "Unknown") & (now > target), F.greatest(F.floor((now + target) / 2).cast("int"), F.lit(MIN_STREAMS)))
        .otherwise(now)
    )


def concurrency(rounds: DataFrame, start: int = 16) -> DataFrame:
    """(region, streams) after all rounds (region, round, ok, failed, quality), which are few a region."""
    r = rounds.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("round", "ok", "failed", "quality"))).alias("rs"))
    return r.select("region", F.aggregate("rs", F.lit(start), lambda acc, x: next_streams(acc, x.ok, x.failed, x.quality)).alias("streams"))


def protocol_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("protocol").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"))


def health(samples: DataFrame) -> DataFrame:
    """(region, failures in a row at the end, state)."""
    last_ok = F.max(F.when(F.col("ok"), F.struct("ts", "seq")))
    ends = samples.groupBy("region").agg(last_ok.alias("last_ok"))
    after = samples.join(ends, "region").filter(~F.col("ok") & (F.col("last_ok").isNull() | (F.struct("ts", "seq") > F.col("last_ok"))))
    n = ends.join(after.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region", "left").select("region", F.coalesce("n", F.lit(0)).alias("failures"))
    return n.withColumn("state", F.when(F.col("failures") == 0, "Healthy").when(F.col("failures") < 3, "Degraded").otherwise("Unhealthy"))


def representative_failure(errors: DataFrame, group: str, order: str) -> DataFrame:
    """(group, n, category, message): the gravest failure, the earliest of equals."""
    e = errors.withColumn("category", E.error_category("message", "kind"))
    top = F.max_by(F.struct("category", "message"), F.struct(E.category_rank("category"), -F.col(order))).alias("top")
    g = e.groupBy(group).agg(F.count(F.lit(1)).alias("n"), top)
    text = F.concat(F.when(F.col("top.category") == "Fatal", F.lit("[fatal] ")).otherwise(F.lit("")), F.col("n").cast("string"), F.lit(" files failed: "), F.col("top.message"))
    return g.select(group, "n", "top.category", text.alias("message"))


def throughput_concurrency(windows: DataFrame, start: int = 16, increase: int = 2, decrease: float = 0.5, error_rate: float = 0.05, least: int = MIN_STREAMS, most: int = MAX_STREAMS) -> DataFrame:
    """(region, streams) after all sample windows (region, window, total, failed, throughput), which are few a
    region: fewer on errors, more while the throughput grows (D24). A window without requests changes nothing."""
    r = windows.filter("total > 0").groupBy("region").agg(F.array_sort(F.collect_list(F.struct("window", "total", "failed", "throughput"))).alias("ws"))
    first = F.struct(F.lit(start).alias("n"), F.lit(0).cast("long").alias("last"))

    def step(acc, w):
        down = F.greatest(F.floor(acc.n * decrease).cast("int"), F.lit(least))
        up = F.least(acc.n + increase, F.lit(most))
        grew = (w.throughput > acc["last"]) | (acc["last"] == 0)
        return F.struct(F.when(w.failed / w.total > error_rate, down).when(grew, up).otherwise(acc.n).alias("n"), w.throughput.cast("long").alias("last"))

    return r.select("region", F.aggregate("ws", first, step)["n"].alias("streams"))
