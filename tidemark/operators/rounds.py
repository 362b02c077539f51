"""Rounds of synchronisation as plain functions over DataFrames, and as triggers of a stream."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jobs


def next_delay_ms(interval, stability, waiting) -> Column:
    """The interval, or no more than the stability time (or 100 ms) while files wait for it."""
    short = F.least(F.col(interval), F.when(F.col(stability) > 0, F.col(stability)).otherwise(F.lit(100)))
    return F.when(F.col(waiting), short).otherwise(F.col(interval))


def after_round(queue: DataFrame) -> DataFrame:
    """(job_id, next): once and full jobs end after one round, sync jobs after their last."""
    return queue.select("job_id", F.when(jobs.is_final_transfer(), "completed").otherwise("again").alias("next"), (F.col("round_id") + (~jobs.is_final_transfer()).cast("long")).alias("round_id"))


def recovered(stored: DataFrame) -> DataFrame:
    """(job_id, action) at a restart: active jobs run again, paused ones stay so, and a job whose final
    round is active is left to it (K17)."""
    final = stored.filter(F.endswith("job_id", F.lit("_final")) & jobs.is_active()).select(F.regexp_replace("job_id", "_final$", "").alias("job_id")).withColumn("_f", F.lit(True))
    j = stored.filter(jobs.is_active()).join(final, "job_id", "left")
    return j.select("job_id", F.when(F.col("_f"), "skip").when(F.col("status") == "paused", "keep").otherwise("submit").alias("action"))


def trigger(job_type: str, last: bool, interval_ms: int) -> dict:
    """Arguments of ``DataStreamWriter.trigger`` for a job's stream (K4, K9)."""
    return {"availableNow": True} if job_type in ("once", "full") or last else {"processingTime": f"{interval_ms} milliseconds"}


def restored(jobs: DataFrame, marks: DataFrame) -> DataFrame:
    """Jobs with the round they were in when it was last written down (K6)."""
    m = marks.groupBy("job_id").agg(F.max_by(F.struct("round_id", "is_last_round"), "seq").alias("m"))
    j = jobs.drop("round_id", "is_last_round").join(m, "job_id", "left")
    return j.select("job_id", F.coalesce("m.round_id", F.lit(0).cast("long")).alias("round_id"), F.coalesce("m.is_last_round", F.lit(False)).alias("is_last_round"))
