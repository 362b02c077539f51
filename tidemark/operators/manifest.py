"""Content manifest: one line an entry, and a summary hash over all lines in path order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(c: str):
    return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def manifest_lines(entries: DataFrame) -> DataFrame:
    """(path, line) of (path, kind D/F/L, size, hash, target)."""
    line = (
        F.when(F.col("kind") == "D", F.concat_ws("\t", F.lit("D"), quoted("path")))
        .when(F.col("kind") == "L", F.concat_ws("\t", F.lit("L"), quoted("path"), quoted("target")))
        .otherwise(F.concat_ws("\t", F.lit("F"), quoted("path"), F.col("size").cast("string"), F.col("hash")))
    )
    return entries.select("path", line.alias("line"))


def manifest_counts(entries: DataFrame) -> DataFrame:
    """Entries, files, bytes."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("kind") == "F").alias("files"), F.coalesce(F.sum(F.when(F.col("kind") == "F", F.col("size"))), F.lit(0)).alias("bytes"))


def summary_hash(lines: DataFrame) -> DataFrame:
    """One row: SHA-256 of the lines in path order joined by line ends (D9); the empty text's when there
    are none. All lines meet in one place by the result's nature: it is for manifests of one tree."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x.line), "\n")
    return lines.agg(F.sha2(joined, 256).alias("summary"), F.count(F.lit(1)).alias("n"))


def write_manifest(lines: DataFrame, path: str) -> None:
    lines.orderBy("path").select("line").write.mode("overwrite").text(path)
