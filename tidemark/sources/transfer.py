"""A round of synchronisation of one directory tree with another: the operators of this package in a row.

List both sides, find what changed, cut it into chunks, take each chunk from a file that the destination
has already or else from the source, publish whole files, and remove what the source no longer has (K4, K7).
Steps that a later one depends on are written to the shared folder; each can run again after a loss.
"""

import hashlib
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import changes
from ..operators.chunking import Profile
from . import dirlist, files, sink

SCHEMA = "path string, reason string, outcome string, copied long, transferred long"


def stored(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kind_of(listing: DataFrame) -> DataFrame:
    return listing.withColumn("kind", F.when(F.col("is_dir"), "D").when(F.col("is_symlink"), "L").otherwise("F"))


def filled(tasks: DataFrame, source: str, dest: str) -> DataFrame:
    """(dest, idx, outcome, bytes): new versions of files beside the old ones. A chunk with a place at the
    destination (``source``, ``offset``, ``modified``) is copied from there if it still is what it was (A21,
    A22), any other is read from the source and checked; a source that changed meanwhile leaves its file
    unpublished."""

    def data(row):
        if row["source"] is not None:
            outcome, piece = files.copied(dest, row)
            if outcome == "Success":
                return "copied", piece
        try:
            with files.regular(files.inside(source, row["dest"])) as f:
                f.seek(row["dest_offset"])
                piece = f.read(row["length"])
        except OSError:
            return "failed", b""
        return ("transferred", piece) if hashlib.sha256(piece).hexdigest() == row["strong"] else ("failed", b"")

    return files.into_tmp(tasks, dest, ["source", "offset"], data, lambda full: open(full + ".tmp", "wb").close())


def transfer_round(spark, source: str, dest: str, exclude=(), include=(), profile: Profile = Profile(), window: int = files.WINDOW, full: bool = False) -> DataFrame:
    """Make ``dest`` hold what ``source`` holds; (path, reason, outcome, copied, transferred) of the files that
    had to change, in bytes. With patterns nothing is removed (B34). Both are folders that all machines share;
    one file is written by one task."""
    os.makedirs(dest, exist_ok=True)
    work = sink.new_folder(spark, "round")
    now = stored(kind_of(dirlist.listing(spark, source, recursive=True, strict=True, exclude=list(exclude), include=list(include))), work)
    there = stored(kind_of(dirlist.listing(spark, dest, recursive=True)), work)
    both = now.alias("n").join(there.alias("d"), "path", "left")
    same = (F.col("n.size") == F.col("d.size")) & E.ts_match("n.modified", "d.modified")
    reason = F.when(F.lit(full), "full").when(F.col("d.kind").isNull() | (F.col("d.kind") != "F"), "new").when(~same, "changed")
    todo = stored(both.filter("n.kind = 'F'").select("path", "n.modified", "n.mode", F.col("n.size").alias("size"), reason.alias("reason")).filter("reason IS NOT NULL"), work)
    want = stored(files.file_chunks(todo.filter("size > 0"), source, profile, window), work)
    old = there.filter(F.lit(want.limit(1).count() > 0) & (F.col("kind") == "F"))
    place = F.struct("path", "offset", "modified")
    have = files.file_chunks(old, dest, profile, window).join(old.select("path", "modified"), "path").groupBy("strong", "length").agg(F.min(place).alias("at"))
    tasks = stored(want.join(have, ["strong", "length"], "left").select(F.col("path").alias("dest"), "idx", F.col("offset").alias("dest_offset"), "length", "strong", F.col("at.path").alias("source"), F.col("at.offset").alias("offset"), F.col("at.modified").alias("modified")), work)
    # what is of another kind makes place now; chunks that were to come from there come from the source
    files.remove(both.filter("n.kind <> d.kind").select("path"), dest).count()
    entries = now.filter("kind <> 'F'").unionByName(now.join(todo.filter("size = 0").select("path"), "path", "left_semi"))
    sink.write_blocks(entries.select("path", F.lit(0).cast("long").alias("offset"), F.lit(None).cast("binary").alias("data"), "kind", F.col("symlink_target").alias("target")), dest).count()
    done = stored(filled(tasks, source, dest), work)
    bytes_of = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("bytes"))), F.lit(0)).alias(o)
    by_file = done.groupBy(F.col("dest").alias("path")).agg(F.count_if(F.col("outcome") == "failed").alias("failed"), bytes_of("copied"), bytes_of("transferred"))
    out = stored(todo.join(by_file, "path", "left"), work)
    files.publish(out.filter("coalesce(failed, 0) = 0").select("path", "modified", "mode"), dest).count()
    gone = changes.deleted_targets(there, now, filtered=bool(exclude or include))
    files.remove(gone, dest).count()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("path", "reason", F.when(F.coalesce("failed", F.lit(0)) > 0, "failed").otherwise("done").alias("outcome"), zero("copied"), zero("transferred"))
