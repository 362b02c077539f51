"""Changes of stored tables as pure functions: old rows and changes in, new rows out."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, changes: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Changes replace rows of equal keys; columns in ``keep`` stay as they were.
    One full outer join, so one shuffle of each side."""
    o, c = old.withColumn("_o", F.lit(True)).alias("o"), changes.withColumn("_c", F.lit(True)).alias("c")
    j = o.join(c, keys, "full_outer")
    new = F.col("c._c").isNotNull()
    value = lambda x: F.coalesce(F.col(f"o.{x}"), F.col(f"c.{x}")) if x in keep else F.when(new, F.col(f"c.{x}")).otherwise(F.col(f"o.{x}"))
    return j.select(*(F.col(x) if x in keys else value(x).alias(x) for x in old.columns))


def update(old: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], when: Column | None = None) -> DataFrame:
    """Set ``columns`` where a change has the key and the old row meets ``when``."""
    c = changes.select(*keys, F.lit(True).alias("_c"), *(F.col(x).alias(f"_new_{x}") for x in columns))
    hit = F.col("_c").isNotNull() if when is None else F.col("_c").isNotNull() & when
    j = old.join(c, keys, "left").withColumn("_hit", hit)
    return j.select(*(F.when(F.col("_hit"), F.col(f"_new_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in old.columns))


def delete(old: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return old.join(keys_gone.select(*keys).distinct(), keys, "left_anti")


def expired_jobs(jobs: DataFrame, before: Column) -> DataFrame:
    """Terminal jobs last touched before the time."""
    return jobs.filter(F.col("status").isin("completed", "failed", "cancelled") & (F.col("updated_at") < before)).select("job_id")


def retention(jobs: DataFrame, children: dict[str, DataFrame], before: Column) -> dict[str, DataFrame]:
    """All tables without the expired jobs."""
    gone = expired_jobs(jobs, before)
    return {name: delete(d, gone, ["job_id"]) for name, d in {"jobs": jobs, **children}.items()}


def orphans_removed(keys: DataFrame, jobs: DataFrame, before: Column) -> DataFrame:
    """Old rows without a job go, the others stay."""
    old = keys.filter(F.col("updated_at") < before).join(jobs.select("job_id"), "job_id", "left_semi")
    return keys.filter(~(F.col("updated_at") < before)).unionByName(old)


def retry_attempt(retries: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Success deletes the row; a failure counts one more and sets the next time while tries are left."""
    j = retries.join(attempts.select("job_id", "success"), "job_id", "left")
    failed = F.coalesce(~F.col("success"), F.lit(False))
    count = F.col("retry_count") + failed.cast("int")
    later = now + F.make_dt_interval(mins=E.retry_minutes(count))
    next_at = F.when(failed & (count < F.col("max_retries")), later).otherwise(F.col("next_retry_at"))
    return j.filter(~F.coalesce("success", F.lit(False))).select("job_id", count.alias("retry_count"), "max_retries", next_at.alias("next_retry_at"))


def reserve(requests: DataFrame) -> DataFrame:
    """The first request of each (scope, key) owns it; later ones of equal fingerprint move updated_at."""
    first = F.min_by(F.struct("fingerprint", "job_id", "at"), "seq").alias("f")
    owners = requests.groupBy("scope", "key").agg(first).select("scope", "key", "f.fingerprint", "f.job_id")
    touched = requests.groupBy("scope", "key", "fingerprint").agg(F.max("at").alias("updated_at"))
    return owners.join(touched, ["scope", "key", "fingerprint"])


def affected(old: DataFrame, changes: DataFrame, keys: list[str], when: Column | None = None) -> DataFrame:
    """(keys, affected) of each change: whether ``update`` finds a row for it."""
    o = (old if when is None else old.filter(when)).select(*keys).distinct().withColumn("_o", F.lit(True))
    return changes.select(*keys).join(o, keys, "left").select(*keys, F.col("_o").isNotNull().alias("affected"))


def cleared(table: DataFrame) -> DataFrame:
    """The table without its rows."""
    return table.filter(F.lit(False))


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The chunk cache with new entries in place of those of equal path."""
    return upsert(cache, entries, ["path"])
