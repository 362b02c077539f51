"""The directory source, manifests, chunking properties, and the stream against its replay."""

import os
import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunking, manifest
from tidemark.sources import dirlist
from tidemark.streaming import stability


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    (tmp_path / "a/b/x.txt").write_text("alpha")
    (tmp_path / "a/y.log").write_text("beta")
    (tmp_path / ".git/z").write_text("z")
    (tmp_path / "root.txt").write_text("gamma")
    (tmp_path / "link").symlink_to("root.txt")
    (tmp_path / "broken").symlink_to("nowhere")
    return str(tmp_path)


def names(d):
    return sorted(r.path for r in d.collect())


def test_listing_of_the_root(spark, tree):
    assert names(dirlist.listing(spark, tree, root=True)) == [".", ".git", "a", "broken", "link", "root.txt"]
    assert names(dirlist.listing(spark, tree, root=True, include=["root"])) == ["root.txt"]
    assert names(dirlist.listing(spark, tree, root=True, dirs=False)) == ["broken", "link", "root.txt"]
    assert names(dirlist.listing(spark, tree, recursive=True, exclude=[str(tree)])) == []
    assert dirlist.root_excluded(str(tree), [str(tree)]) and not dirlist.root_excluded(str(tree), ["^a$"])
    parent = dirlist.listing(spark, tree)
    assert [dirlist.confirms_single_file(f"{tree}/{n}", parent) for n in ("root.txt", "link", "a", "none")] == [True, True, False, False]


def test_one_deep_tree_is_dealt_over_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dirlist, "SPLIT", 3)
    for k in range(40):
        (tmp_path / "top" / "in" / f"d{k:02}" / "e").mkdir(parents=True)
        (tmp_path / "top" / "in" / f"d{k:02}" / "e" / "f").write_text("x")
    reader = dirlist.Reader({"path": str(tmp_path), "recursive": "true"})
    parts = reader.partitions()
    assert len(parts) == 3 + 40
    rows = [r[0] for p in parts for r in reader.read(p)]
    assert len(rows) == len(set(rows)) == 2 + 3 * 40
    assert names(dirlist.listing(spark, tmp_path, recursive=True)) == sorted(rows)


def test_listing(spark, tree):
    assert names(dirlist.listing(spark, tree)) == [".git", "a", "broken", "link", "root.txt"]
    assert names(dirlist.listing(spark, tree, recursive=True)) == [".git", ".git/z", "a", "a/b", "a/b/x.txt", "a/y.log", "broken", "link", "root.txt"]
    assert names(dirlist.listing(spark, tree, recursive=True, dirs=False, hidden=False)) == ["a/b/x.txt", "a/y.log", "broken", "link", "root.txt"]
    assert names(dirlist.listing(spark, tree, recursive=True, exclude=["^a$"], include=["txt"])) == ["root.txt"]
    assert names(dirlist.listing(spark, f"{tree}/root.txt")) == ["root.txt"]
    assert names(dirlist.listing(spark, f"{tree}/link")) == ["link"]
    row = dirlist.listing(spark, tree).filter("path = 'link'").first()
    assert row.is_symlink and row.symlink_target == "root.txt" and not row.is_dir


def test_missing_directory(spark, tree):
    with pytest.raises(Exception):
        dirlist.listing(spark, f"{tree}/none").collect()


def test_blocks(spark):
    files = spark.createDataFrame([("a", bytearray(b"hello"))], "path string, content binary")
    want = spark.createDataFrame([("a", 0, 1, 3), ("a", 1, 9, 1), ("b", 2, 0, 1), ("a", 3, 3, 9)], "path string, idx int, offset long, length long")
    got = {r.idx: (r.success, r.data and bytes(r.data)) for r in dirlist.blocks(files, want).collect()}
    assert got == {0: (True, b"ell"), 1: (False, None), 2: (False, None), 3: (True, b"lo")}


def test_manifest(spark):
    rows = [("a/b", "F", 5, "h", None), ("a.txt", "F", 1, "g", None), ("a", "D", None, None, None), ("l", "L", None, None, "x\"y")]
    lines = manifest.manifest_lines(spark.createDataFrame(rows, "path string, kind string, size long, hash string, target string"))
    text = [r.line for r in lines.orderBy("path").collect()]
    assert text == ['D\t"a"', 'F\t"a.txt"\t1\tg', 'F\t"a/b"\t5\th', 'L\t"l"\t"x\\"y"']
    import hashlib

    assert manifest.summary_hash(lines).first().summary == hashlib.sha256("\n".join(text).encode()).hexdigest()
    assert manifest.summary_hash(lines.filter("false")).first().summary == hashlib.sha256(b"").hexdigest()


SMALL = chunking.Profile(256, 1024, 4096)


def test_chunks_tile_and_survive_edits():
    data = random.Random(5).randbytes(200_000)
    ends = chunking.cuts(data, SMALL)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= 4096 and min(sizes[:-1]) >= 256
    assert 700 < sum(sizes) / len(sizes) < 2000
    pieces = lambda d: {d[a:b] for a, b in zip([0, *chunking.cuts(d, SMALL)], chunking.cuts(d, SMALL))}
    edited = data[:100_000] + b"edit" + data[100_000:]
    assert len(pieces(data) - pieces(edited)) <= 4
    assert chunking.cuts(b"", SMALL) == [] and chunking.cuts(b"x", SMALL) == [1]
    with pytest.raises(ValueError):
        chunking.Profile(10, 5, 1)


def test_chunk_rows(spark):
    data = bytearray(random.Random(6).randbytes(30_000))
    files = spark.createDataFrame([("a", data), ("b", data), ("c", None)], "path string, content binary")
    rows = chunking.content_chunks(files, "path", "content", SMALL).collect()
    by = {p: [(r.offset, r.length, r.strong) for r in rows if r.path == p] for p in "abc"}
    assert by["a"] == by["b"] and not by["c"]
    ranges = files.filter("path = 'a'").withColumn("ranges", F.expr("array(named_struct('offset', 0L, 'length', 10L))"))
    import hashlib

    assert chunking.strong_hashes(ranges).first().strong == hashlib.sha256(bytes(data[:10])).hexdigest()


def test_stream_equals_replay(spark, tmp_path):
    rng, start, rows = random.Random(7), dt.datetime(2024, 1, 1), []
    for seq in range(120):
        at = start + dt.timedelta(seconds=rng.randrange(3) + seq * 4)
        rows.append((rng.choice("abc"), seq, at, rng.randrange(2), at - dt.timedelta(seconds=rng.choice([1, 5, 30]))))
    rows = [(p, s, a, z, a.replace(second=0) if i % 3 else m) for i, (p, s, a, z, m) in enumerate(rows)]
    schema = "path string, seq long, scan_ts timestamp, size long, modified timestamp"
    src = str(tmp_path / "scans")
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i : i + 40], schema).coalesce(1).write.mode("append").parquet(src)
    stream = stability.stable_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(src))
    q = stream.writeStream.format("memory").queryName("stable").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.path, r.seq): r.stable for r in spark.table("stable").collect()}
    want = {(r.path, r.seq): r.stable for r in stability.replay(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(set(want.values())) == 2


def test_progress_rules(spark):
    rows = [("j", 0, 0, 5), ("j", 1, 100, 6), ("j", 2, 400, 20 << 20), ("j", 3, 950, (20 << 20) + 1), ("j", 4, 2000, (20 << 20) + 1)]
    d = spark.createDataFrame(rows, "job_id string, seq long, at_ms long, bytes long")
    assert [r.emit for r in stability.progress_throttle(d).orderBy("seq").collect()] == [True, False, True, True, False]
    u = spark.createDataFrame([("j", 10, 0, 5, 10), ("j", 20, 1, 50, 10), ("j", 40, 2, 7, 10)], "job_id string, at_ms long, seq long, current long, total long")
    s = spark.createDataFrame([("j", 15, "syncing"), ("j", 30, "paused")], "job_id string, at_ms long, status string")
    assert [(r.seq, r.current) for r in stability.accepted_progress(u, s).collect()] == [(1, 10)]
