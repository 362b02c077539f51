"""Change detection: what differs between a listing, what was synchronised before, and the destination."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E

PERMISSIONS = 0o7777


def same_version(a: str, b: str) -> Column:
    """Size, times and inode agree; nulls agree with nulls."""
    c = lambda side, name: F.col(f"{side}.{name}")
    return (
        (c(a, "size") == c(b, "size"))
        & E.ts_match(c(a, "modified"), c(b, "modified"))
        & E.optional_ts_match(c(a, "change_time"), c(b, "change_time"))
        & c(a, "inode").eqNullSafe(c(b, "inode"))
    )


def permissions_differ(mode, expected) -> Column:
    """False where nothing is expected."""
    mask = lambda x: E.col(x).bitwiseAND(F.lit(PERMISSIONS))
    return (E.col(expected) != 0) & (mask(mode) != mask(expected))


def changed_files(now: DataFrame, cache: DataFrame, dest: DataFrame, full: bool = False) -> DataFrame:
    """(path, reason) of files to send: new, changed at the source, missing or drifted at the destination
    (C12, B29). ``full`` sends all. Both joins are on the path: one shuffle of each listing."""
    j = now.alias("n").join(cache.withColumn("has", F.lit(True)).alias("c"), "path", "left").join(dest.withColumn("has", F.lit(True)).alias("d"), "path", "left")
    drift = (
        (F.col("d.size") != F.col("n.size"))
        | ~E.ts_match("d.modified", "c.modified")
        | ~E.optional_ts_match("d.change_time", "c.change_time")
        | ~F.col("d.inode").eqNullSafe(F.col("c.inode"))
    )
    reason = (
        F.when(F.lit(full), "full")
        .when(F.col("c.has").isNull(), "new")
        .when(~same_version("n", "c"), "changed")
        .when(F.col("d.has").isNull(), "missing")
        .when(drift, "drifted")
        .when(permissions_differ("d.mode", "n.mode"), "permissions")
    )
    return j.select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def stale_scans(scans: DataFrame, now: DataFrame) -> DataFrame:
    """Indexed files that are gone or differ in time or size."""
    j = scans.alias("s").join(now.withColumn("has", F.lit(True)).alias("n"), "path", "left")
    stale = F.col("n.has").isNull() | (F.col("s.size") != F.col("n.size")) | ~E.ts_match("s.modified", "n.modified")
    return j.filter(stale).select("path")


def expected_entries(source: DataFrame) -> DataFrame:
    """All paths a destination should hold: the files and every directory above them."""
    return source.select(F.explode(F.array_append(E.ancestors("path"), F.col("path"))).alias("path")).distinct()


def deleted_targets(dest: DataFrame, source: DataFrame, preserved: DataFrame | None = None, filtered: bool = False) -> DataFrame:
    """Topmost destination entries that nothing at the source explains (C27, C28, B34): an unexpected
    directory goes whole. With filters active nothing is deleted; ``preserved`` paths stay."""
    expected = expected_entries(source if preserved is None else source.select("path").unionByName(preserved.select("path")))
    entries = expected_entries(dest)
    gone = entries.join(expected, "path", "left_anti").filter(F.lit(not filtered))
    above = gone.select(F.col("path").alias("parent"))
    return gone.withColumn("parent", E.parent_path("path")).join(above, "parent", "left_anti").select("path")


def forgotten(cache: DataFrame, now: DataFrame) -> DataFrame:
    """Cached paths that are no longer listed."""
    return cache.select("path").join(now.select("path"), "path", "left_anti")


def directories_first(paths: DataFrame) -> DataFrame:
    """By depth, then by path."""
    return paths.orderBy(F.size(F.split("path", "/")), "path")


def cache_cleanup(cache: DataFrame, now: Column, ttl_seconds: int, most: int = 100_000) -> DataFrame:
    """Entries younger than the limit, the newest ``most`` of all jobs (E3): a top-k, not a global sort."""
    young = cache.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp")) <= ttl_seconds * 1_000_000)
    return young.orderBy(F.desc("updated_at"), "job_id", "file_path").limit(most)


def trimmed(cache: DataFrame, above: int = 60_000, down_to: int = 54_000, by: list = ("path",)) -> DataFrame:
    """All rows up to ``above``; beyond it the first ``down_to`` in the order given, as a top-k."""
    n = F.broadcast(cache.agg(F.count(F.lit(1)).alias("_all")))
    r = cache.crossJoin(n)
    return r.filter(F.col("_all") <= above).unionByName(r.filter(F.col("_all") > above).orderBy(*by).limit(down_to)).drop("_all")


def retained(state: DataFrame, listed: DataFrame) -> DataFrame:
    """State of the paths that are still listed."""
    return state.join(listed.select("path").distinct(), "path", "left_semi")


def completed_versions(states: DataFrame) -> DataFrame:
    """States that prove a source version was sent."""
    progress = E.percent("done_chunks", "total_chunks")
    return states.filter((F.col("cache_only") | (progress == 100)) & F.col("source_size").isNotNull() & F.col("source_modified").isNotNull())


def one_sided(saved: Column, current: Column, same: Column) -> Column:
    """A known value must be matched; a saved one must not vanish."""
    return F.when(current.isNotNull(), F.coalesce(same, F.lit(False))).otherwise(saved.isNull())


def resumable(state: str, source: str) -> Column:
    """A saved state fits the source as it is now (B27); ``state`` and ``source`` are join aliases."""
    s = lambda n: F.col(f"{state}.{n}")
    c = lambda n: F.col(f"{source}.{n}")
    return F.coalesce(
        (s("total_chunks") == c("total_chunks"))
        & (s("done_chunks") <= c("total_chunks"))
        & (s("source_size") == c("size"))
        & E.ts_match(s("source_modified"), c("modified"))
        & one_sided(s("source_change_time"), c("change_time"), E.optional_ts_match(s("source_change_time"), c("change_time")))
        & one_sided(s("source_inode"), c("inode"), s("source_inode") == c("inode")),
        F.lit(False),
    )


def destination_resumable(state: str, dest: str) -> Column:
    """Nothing done yet, or the destination is as it was left."""
    s = lambda n: F.col(f"{state}.{n}")
    d = lambda n: F.col(f"{dest}.{n}")
    same = (
        s("dest_size").isNotNull()
        & s("dest_modified").isNotNull()
        & s("dest_size").eqNullSafe(d("size"))
        & E.optional_ts_match(s("dest_modified"), d("modified"))
        & one_sided(s("dest_change_time"), d("change_time"), E.optional_ts_match(s("dest_change_time"), d("change_time")))
        & one_sided(s("dest_inode"), d("inode"), s("dest_inode") == d("inode"))
    )
    return (s("done_chunks") == 0) | F.coalesce(same, F.lit(False))
