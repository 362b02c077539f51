"""The chunk index and caches: validity, upkeep, and positional joins."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def valid_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with their cached chunks where time and size still match, null where they must be cut anew
    (A26, I6, I9)."""
    c = cache.select("path", F.col("modified").alias("_m"), F.col("size").alias("_s"), "chunks")
    j = files.join(c, "path", "left")
    hit = E.ts_match("modified", "_m") & (F.col("size") == F.col("_s"))
    return j.withColumn("chunks", F.when(hit, F.col("chunks"))).drop("_m", "_s")


def strong_filled(chunks: DataFrame, computed: DataFrame) -> DataFrame:
    """Strong hashes written back by file and offset; known ones stay."""
    return chunks.join(computed.withColumnRenamed("strong", "_n"), ["path", "offset"], "left").withColumn("strong", F.coalesce("strong", "_n")).drop("_n")


def zipped(requested: DataFrame, answered: DataFrame) -> DataFrame:
    """Answers by position; a batch with another number of answers is dropped whole."""
    n = lambda d, c: d.groupBy("batch").agg(F.count(F.lit(1)).alias(c))
    same = n(requested, "a").join(n(answered, "b"), "batch").filter("a = b").select("batch")
    return requested.join(same, "batch", "left_semi").join(answered, ["batch", "pos"])


def local_matches(matches: DataFrame) -> DataFrame:
    """Locations by strong hash, each file and offset once (C4)."""
    return matches.groupBy("strong").agg(F.array_sort(F.collect_set(F.struct("path", "offset", "length"))).alias("locations"))


def without_files(locations: DataFrame, files: DataFrame) -> DataFrame:
    """All locations of the files listed go."""
    return locations.join(files.select("path").distinct(), "path", "left_anti")


def valid_locations(locations: DataFrame, listing: DataFrame) -> DataFrame:
    """Locations whose file is still there with the same time; each is judged by itself."""
    l = listing.select("path", F.col("modified").alias("_now"))
    return locations.join(l, "path").filter(E.ts_match("modified", "_now")).drop("_now")


def to_index(listing: DataFrame, running: DataFrame, tmp: DataFrame, cached: DataFrame, now_ns: int, recent_s: int = 60) -> DataFrame:
    """(path, outcome) of a background indexing round: skip what is being written, recent or cached
    (C32, D26, K21). ``running`` holds destination directories, met through each path's ancestors."""
    up = listing.select("path", F.explode(F.array_append(E.ancestors("path"), F.col("path"))).alias("dir"))
    busy = up.join(running.select(F.col("dest_path").alias("dir")).union(tmp.select(F.col("path").alias("dir"))).distinct(), "dir", "left_semi").select("path").distinct()
    j = listing.join(busy.withColumn("busy", F.lit(True)), "path", "left").join(cached.select("path", F.col("modified").alias("_m"), F.col("size").alias("_s")), "path", "left")
    outcome = (
        F.when(F.col("busy"), "running")
        .when(F.lit(now_ns) - F.col("modified") < recent_s * 1_000_000_000, "recent")
        .when(E.ts_match("modified", "_m") & (F.col("size") == F.col("_s")), "cached")
        .otherwise("index")
    )
    return j.select("path", outcome.alias("outcome"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def byte_bounded(cache: DataFrame, cap: int = 100 * 1024 * 1024, steps: int = 10_000) -> DataFrame:
    """The most recently used entries whose sizes fit together (E5). Accesses (a number) fall into at most
    ``steps`` spans of time; running sums go over the spans' totals, and inside those spans that begin
    below the cap, so that no task sees all entries."""
    ends = F.broadcast(cache.agg(F.min("last_access").alias("_lo"), F.max("last_access").alias("_hi")))
    width = F.greatest(F.ceil((F.col("_hi") - F.col("_lo")) / F.lit(steps)), F.lit(1))
    d = cache.crossJoin(ends).withColumn("_s", F.floor((F.col("_hi") - F.col("last_access")) / width)).drop("_lo", "_hi")
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = d.groupBy("_s").agg(F.sum("size").alias("_t")).withColumn("_b", before).filter(F.col("_b") <= cap).select("_s", "_b")
    total = F.col("_b") + F.sum("size").over(Window.partitionBy("_s").orderBy(F.desc("last_access"), "path"))
    return d.join(F.broadcast(spans), "_s").withColumn("_t", total).filter(F.col("_t") <= cap).select(cache.columns)


def cache_stats(files: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: files whose cached chunks still hold, files to cut anew, entries of the cache."""
    hits = valid_cache(files, cache).agg(F.count_if(F.col("chunks").isNotNull()).alias("hits"), F.count_if(F.col("chunks").isNull()).alias("misses"))
    return hits.crossJoin(F.broadcast(cache.agg(F.count(F.lit(1)).alias("entries"))))


def newly_completed(chunks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, bytes) that became complete between two states."""
    new = after.select("path", "idx").join(before.select("path", "idx"), ["path", "idx"], "left_anti")
    return chunks.join(new, ["path", "idx"]).groupBy("path").agg(F.sum("length").alias("bytes"))


def batch_outcome(results: DataFrame) -> DataFrame:
    """Sorted lists of what succeeded and what failed, by batch."""
    some = lambda ok: F.array_sort(F.collect_list(F.when(F.col("ok") == ok, F.col("idx"))))
    return results.groupBy("batch").agg(some(True).alias("succeeded"), some(False).alias("failed"))


def folded(states: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Completed chunk sets with a batch's successes added, and the percent done."""
    done = F.array_sort(F.array_union(F.coalesce("completed", F.array().cast("array<int>")), F.coalesce("succeeded", F.array().cast("array<int>"))))
    j = states.join(outcomes.select("path", "succeeded"), "path", "left").withColumn("completed", done).drop("succeeded")
    return j.withColumn("progress", E.percent(F.size("completed"), F.col("total_chunks")))
