"""Queries over directories: a tree made of the nations and regions is written, listed, read and copied. See
``catalogue``. Each query writes a tree of its own into the shared folder; its size does not grow with the data."""

from pyspark.sql import functions as F

from ..operators import chunking, manifest
from ..sources import dirlist, files, sink, transfer
from .catalogue import query

SIZE = "cast(CASE kind WHEN 'F' THEN length(text) WHEN 'L' THEN length(target) ELSE 0 END AS BIGINT)"
LENGTH = 64


def planted(t):
    """The session and the root of a new tree. Files are written in two blocks, the later one first."""
    e = t("tree").withColumn("data", F.encode("text", "utf-8"))
    spark, at = e.sparkSession, lambda i: F.lit(i).cast("long").alias("offset")
    first = e.select("path", "kind", "target", at(0), F.substring("data", 1, 10).alias("data"))
    rest = e.filter("kind = 'F' AND length(text) > 10").select("path", "kind", "target", at(10), F.expr("substring(data, 11)").alias("data"))
    root = sink.new_folder(spark, "tree")
    sink.write_blocks(rest.unionByName(first), root).count()
    return spark, root


def shown(listing):
    return listing.select("path", F.when(F.col("is_dir"), "D").when(F.col("is_symlink"), "L").otherwise("F").alias("kind"), "size", F.col("symlink_target").alias("target"))


@query(f"SELECT path, kind, {SIZE} AS size, target FROM ({{tree}}) t WHERE NOT contains(path, '/') UNION ALL SELECT '.', 'D', 0, NULL")
def tree_listing(t):
    spark, root = planted(t)
    return shown(dirlist.listing(spark, root, root=True))


@query(f"SELECT path, kind, {SIZE} AS size, target FROM ({{tree}}) t WHERE NOT starts_with(path, '.') AND split_part(path, '/', 1) <> 'ASIA' AND regexp_matches(path, '[.]txt$|^zero')")
def tree_scan(t):
    """An excluded directory hides what is below it; one that is merely not included does not."""
    spark, root = planted(t)
    return shown(dirlist.listing(spark, root, recursive=True, exclude=["^[.]", "^ASIA$"], include=["[.]txt$", "^zero"]))


@query("SELECT true AS root_excluded, 0::BIGINT AS entries UNION ALL SELECT false, count(*) FROM ({tree}) t")
def tree_root_excluded(t):
    spark, root = planted(t)
    n = lambda *p: dirlist.listing(spark, root, recursive=True, exclude=list(p)).agg(F.count(F.lit(1)).alias("entries")).select(F.lit(dirlist.root_excluded(root, p)).alias("root_excluded"), "entries")
    return n("/tree-[0-9a-f]+$").unionByName(n("^none$"))


@query(f"SELECT path, kind, {SIZE} AS size, target FROM ({{tree}}) t WHERE kind <> 'D' AND NOT regexp_matches(path, '^links/.*1')")
def tree_files(t):
    spark, root = planted(t)
    return shown(dirlist.listing(spark, root, recursive=True, dirs=False, exclude=["^links/.*1"]))


@query("SELECT path, kind || chr(9) || '\"' || path || '\"' || CASE kind WHEN 'F' THEN chr(9) || length(text) || chr(9) || sha256(text) WHEN 'L' THEN chr(9) || '\"' || target || '\"' ELSE '' END AS line FROM ({tree}) t")
def tree_manifest(t):
    spark, root = planted(t)
    found = shown(dirlist.listing(spark, root, recursive=True, strict=True))
    return manifest.manifest_lines(found.join(files.file_hashes(found.filter("kind = 'F'"), root).drop("bytes"), "path", "left"))


@query("SELECT 'index' AS scan, path FROM ({tree}) t WHERE kind = 'F' AND NOT (starts_with(path, '.') AND contains(path, '/')) UNION ALL SELECT 'cache', path FROM ({tree}) t WHERE kind = 'F'")
def tree_index_scans(t):
    spark, root = planted(t)
    own = lambda scan, **o: dirlist.listing(spark, root, recursive=True, dirs=False, **o).filter("NOT is_symlink").select(F.lit(scan).alias("scan"), "path")
    return own("index", hidden=False).unionByName(own("cache", errors="skip"))


@query("SELECT path, length(text)::BIGINT AS size, kind = 'F' AS known FROM ({tree}) t UNION ALL SELECT 'none/' || path, NULL, false FROM ({tree}) t")
def tree_versions(t):
    spark, root = planted(t)
    paths = t("tree").select("path")
    v = files.regular_versions(paths.unionByName(paths.select(F.concat(F.lit("none/"), "path").alias("path"))), dirlist.listing(spark, root, recursive=True))
    return v.select("path", "size", (F.col("modified").isNotNull() & F.col("change_time").isNotNull() & F.col("inode").isNotNull()).alias("known"))


RANGES = "(VALUES (0, 3, 20, false), (1, 0, 10000, false), (2, 100000, 1, false), (3, 0, 209715200, false), (4, -1, 4, false), (5, 3, 20, true)) r(idx, start, n, exact)"


@query(f"""SELECT path, idx::BIGINT AS idx, error IS NULL AS success, CASE WHEN error IS NULL THEN substring(text, start + 1, n) END AS text, error FROM (SELECT *, CASE WHEN start < 0 THEN 'invalid range' WHEN n > 104857600 THEN 'range too long'
 WHEN kind <> 'F' THEN 'not a regular file' WHEN start >= length(text) THEN 'offset beyond the end' WHEN exact AND start + n > length(text) THEN 'short read' END AS error FROM ({{tree}}) t, {RANGES}) x
 UNION ALL SELECT '../' || path, 0, false, NULL, 'invalid path' FROM ({{tree}}) t UNION ALL SELECT 'none/' || path, 0, false, NULL, 'file not found' FROM ({{tree}}) t WHERE kind = 'L'""")
def tree_ranges(t):
    spark, root = planted(t)
    e = t("tree")
    wanted = e.select("path", F.explode(F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(a).alias("offset"), F.lit(n).alias("length"), F.lit(x).alias("exact")) for i, a, n, x in ((0, 3, 20, False), (1, 0, 10_000, False), (2, 100_000, 1, False), (3, 0, 209_715_200, False), (4, -1, 4, False), (5, 3, 20, True))))).alias("r")).select("path", "r.*")
    odd = e.select(F.concat(F.lit("../"), "path").alias("path")).unionByName(e.filter("kind = 'L'").select(F.concat(F.lit("none/"), "path").alias("path")))
    loose = wanted.filter("NOT exact").drop("exact").unionByName(odd.selectExpr("path", "0 AS idx", "0 AS offset", "1 AS length"))
    got = files.read_ranges(loose, root).unionByName(files.read_ranges(wanted.filter("exact"), root, exact=True))
    return got.select("path", "idx", "success", F.decode("data", "utf-8").alias("text"), "error")


CHUNKS = f"(SELECT *, i * {LENGTH} AS start, substring(text, (i * {LENGTH} + 1)::BIGINT, {LENGTH}) AS piece FROM ({{tree}}) t, unnest(range(0, (length(text) + {LENGTH - 1}) // {LENGTH})) u(i) WHERE kind = 'F')"


@query(f'SELECT path, i AS idx, start AS "offset", length(piece)::BIGINT AS "length", sha256(piece) AS strong FROM {CHUNKS} c')
def tree_chunks(t):
    """Chunks whose sizes are fixed by equal bounds, cut from windows that end within chunks."""
    spark, root = planted(t)
    found = dirlist.listing(spark, root, recursive=True, dirs=False).filter("NOT is_symlink")
    return files.file_chunks(found, root, chunking.Profile(LENGTH, LENGTH, LENGTH), window=100).drop("weak")


@query(f"""SELECT concat('copy/', path) AS dest, i AS idx, outcome, CASE WHEN outcome = 'Success' THEN length(piece) ELSE 0 END::BIGINT AS bytes FROM
 (SELECT *, CASE k % 6 WHEN 1 THEN 'SourceModified' WHEN 2 THEN 'HashMismatch' WHEN 3 THEN 'SourceNotFound' WHEN 4 THEN 'MissingHash' WHEN 5 THEN 'IOError' ELSE 'Success' END AS outcome FROM {CHUNKS} c) x WHERE length(piece) > 0""")
def tree_copies(t):
    spark, root = planted(t)
    found = dirlist.listing(spark, root, recursive=True, dirs=False).filter("NOT is_symlink")
    c = files.file_chunks(found, root, chunking.Profile(LENGTH, LENGTH, LENGTH), window=100).join(found.select("path", "modified"), "path").join(t("tree").select("path", "k"), "path")
    kind = lambda n: F.col("k") % 6 == n
    tasks = c.select(
        F.concat(F.lit("copy/"), "path").alias("dest"), "idx", F.col("offset").alias("dest_offset"), F.when(kind(3), F.concat(F.lit("none/"), "path")).when(kind(5), "latest").otherwise(F.col("path")).alias("source"), "offset", "length",
        F.when(kind(1), F.col("modified") + 1).otherwise(F.col("modified")).alias("modified"), F.when(kind(4), None).when(kind(2), F.sha2("strong", 256)).otherwise(F.col("strong")).alias("strong"),
    )
    return files.copy_chunks(tasks, root)


@query("SELECT path, length(text)::BIGINT AS bytes, substring(text, 17, 16) || substring(text, 1, 16) || substring(text, 33) AS text FROM ({tree}) t WHERE kind = 'F' AND length(text) > 32")
def tree_moves(t):
    """The first two runs of 16 bytes of each file change places; then the new file takes the old one's name."""
    spark, root = planted(t)
    long = t("tree").filter("kind = 'F' AND length(text) > 32").select("path")
    moves = long.select(F.col("path").alias("dest"), F.explode(F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(a).alias("offset"), F.lit(16).alias("length"), F.lit(b).alias("dest_offset")) for i, a, b in ((0, 0, 16), (1, 16, 0))))).alias("m")).select("dest", "m.*")
    files.move_chunks(moves.withColumn("idx", F.col("idx").cast("long")), root).count()
    done = files.publish(long, root)
    done.count()
    got = files.read_ranges(long.selectExpr("path", "0 AS idx", "0 AS offset", "100000 AS length"), root)
    return got.select("path", F.length("data").cast("long").alias("bytes"), F.decode("data", "utf-8").alias("text"))


@query("SELECT * FROM (VALUES ('latest', true, true), ('links', false, false), ('readme', true, true), ('zero', false, false)) v(name, candidate, confirmed)")
def tree_single_files(t):
    spark, root = planted(t)
    parent = dirlist.listing(spark, root)
    names = ("latest", "links", "readme", "zero")
    rows = [(n, dirlist.single_file_candidate(f"{root}/{n}", dirlist.listing(spark, f"{root}/{n}")), dirlist.confirms_single_file(f"{root}/{n}", parent)) for n in names]
    return spark.createDataFrame(rows, "name string, candidate boolean, confirmed boolean")


@query("SELECT path, kind, CASE kind WHEN 'F' THEN sha256(text) WHEN 'L' THEN target END AS content, CASE WHEN kind = 'F' THEN 'new' END AS first_round, CAST(NULL AS VARCHAR) AS second_round FROM ({tree}) t")
def tree_round(t):
    """The tree is synchronised with an empty folder; a second round finds nothing to do."""
    spark, root = planted(t)
    dest = sink.new_folder(spark, "copy")
    rounds = [transfer.transfer_round(spark, root, dest, profile=chunking.Profile(LENGTH, LENGTH, LENGTH), window=LENGTH).select("path", F.col("reason").alias(name)) for name in ("first_round", "second_round")]
    found = shown(dirlist.listing(spark, dest, recursive=True))
    found = found.join(files.file_hashes(found.filter("kind = 'F'"), dest).drop("bytes"), "path", "left").join(rounds[0], "path", "left").join(rounds[1], "path", "left")
    return found.select("path", "kind", F.coalesce("hash", "target").alias("content"), "first_round", "second_round")
