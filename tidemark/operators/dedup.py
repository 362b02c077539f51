"""Chunk reuse: an index of chunk locations, matching by weak then strong hash, and the plan of a transfer.

Candidates are reduced to one location a key before any join, so that a hash shared by a third of all
chunks still joins one row with each chunk.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_LOCATIONS = 100


def with_offsets(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Byte offset of each chunk: the lengths before it."""
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))


def first_location(locations: DataFrame, keys: list[str]) -> DataFrame:
    """One location of each key: the first in the order of the list."""
    at = F.struct("pos", "path", "offset")
    return locations.groupBy(*keys).agg(F.min_by(at, at).alias("at"))


def weak_matches(source: DataFrame, local: DataFrame) -> DataFrame:
    """Source chunks whose weak hash occurs among the local ones."""
    return source.join(local.select("weak").distinct(), "weak", "left_semi")


def verified_matches(source: DataFrame, local: DataFrame) -> DataFrame:
    """Of those, the ones with an equal strong hash, with the first local location."""
    return source.join(first_location(local.filter("strong IS NOT NULL"), ["weak", "strong"]), ["weak", "strong"])


def global_matches(source: DataFrame, index: DataFrame, listing: DataFrame, matched: DataFrame, dest_path: str = "path") -> DataFrame:
    """Matches in the global index: not of chunks matched before, not in the destination file itself, only
    in files still listed (C6, C8, B32)."""
    valid = index.join(listing.select("path").distinct(), "path", "left_semi")
    open_ = source.join(matched.select("path", "idx"), ["path", "idx"], "left_anti")
    best = first_location(valid, ["weak", "strong"])
    # the first location may be the destination file itself: then the first one elsewhere counts
    other = first_location(valid.join(best.select("weak", "strong", F.col("at.path").alias("first_path")), ["weak", "strong"]).filter("path <> first_path"), ["weak", "strong"])
    j = open_.join(best, ["weak", "strong"]).join(other.withColumnRenamed("at", "at2"), ["weak", "strong"], "left")
    return j.withColumn("at", F.when(F.col("at.path") != F.col(dest_path), F.col("at")).otherwise(F.col("at2"))).drop("at2").filter("at IS NOT NULL")


def chunk_plan(chunks: DataFrame, local: DataFrame, index: DataFrame) -> DataFrame:
    """(path, idx, length, action, from_path, from_offset): in place, relocate, copy or transfer.

    ``chunks``: path, idx, offset, length, strong, done. ``local``, ``index``: strong, path, offset, pos.
    """
    same = local.select("strong", "path", "offset").distinct().withColumn("here", F.lit(True))
    within = first_location(local, ["strong", "path"]).select("strong", "path", F.col("at.offset").alias("moved"))
    near = first_location(local, ["strong"]).select("strong", F.struct("at.path", "at.offset").alias("near"))
    far = first_location(index, ["strong"]).select("strong", F.struct("at.path", "at.offset").alias("far"))
    j = chunks.filter(~F.col("done")).join(same, ["strong", "path", "offset"], "left").join(within, ["strong", "path"], "left").join(near, "strong", "left").join(far, "strong", "left")
    action = F.when(F.col("here"), "in_place").when(F.col("moved").isNotNull(), "relocate").when(F.coalesce("near", "far").isNotNull(), "copy").otherwise("transfer")
    copy = F.coalesce("near", "far")
    j = j.withColumn("action", action)
    from_path = F.when(F.col("action") == "relocate", F.col("path")).when(F.col("action") == "copy", copy.path)
    from_offset = F.when(F.col("action") == "relocate", F.col("moved")).when(F.col("action") == "copy", copy.offset)
    return j.select("path", "idx", "length", "action", from_path.alias("from_path"), from_offset.alias("from_offset"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """Chunks and bytes by action."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("bytes"))


def capped_locations(inserts: DataFrame, most: int = MAX_LOCATIONS) -> DataFrame:
    """Locations kept of each hash: an insert replaces the one of equal file and offset; the newest
    ``most`` stay (D12, D13). The second ranking is limited before its shuffle."""
    newest = inserts.groupBy("hash", "path", "offset").agg(F.max("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("seq"), "path", "offset"))
    return newest.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def hash_lists(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct sorted weak and strong hashes of each file."""
    return chunks.groupBy(key).agg(F.array_sort(F.collect_set("weak")).alias("weak"), F.array_sort(F.collect_set("strong")).alias("strong"), F.count("strong").alias("n_strong"))


def copy_order(plan: DataFrame) -> DataFrame:
    """Copies by source file and offset (F17, A23); relocations from the end."""
    return plan.filter(F.col("action").isin("copy", "relocate")).repartition("from_path").sortWithinPartitions("from_path", F.when(F.col("action") == "relocate", -F.col("from_offset")).otherwise(F.col("from_offset")))


def copy_result(listed: str = "modified_now", expected: str = "modified", read_hash: str = "read_strong", want: str = "strong"):
    """Outcome of a verified copy."""
    return F.when(F.col(listed).isNull(), "SourceNotFound").when(F.col(listed) != F.col(expected), "SourceModified").when(F.col(read_hash) != F.col(want), "HashMismatch").otherwise("Success")
