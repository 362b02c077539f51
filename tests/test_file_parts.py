"""Files read, chunked, copied and published in parts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunking
from tidemark.sources import dirlist, files, sink

SMALL = chunking.Profile(256, 1024, 4096)


@pytest.mark.parametrize("window", [4096, 5000, 1 << 20])
def test_windows_cut_what_whole_values_cut(spark, tmp_path, window):
    rng = random.Random(window)
    contents = {"a": rng.randbytes(100_000), "b": b"", "c": b"x" * 30_000, "d": rng.randbytes(4096), "e": rng.randbytes(100)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    whole = chunking.content_chunks(spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary"), "path", "content", SMALL)
    got = files.file_chunks(dirlist.listing(spark, str(tmp_path)), str(tmp_path), SMALL, window)
    assert sorted(got.collect()) == sorted(whole.collect())
    with pytest.raises(ValueError):
        files.file_chunks(whole, str(tmp_path), SMALL, 100)
    assert files.file_chunks(dirlist.listing(spark, str(tmp_path)).filter("false"), str(tmp_path), SMALL, window).count() == 0


def test_writes_are_the_same_when_run_again(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "f").write_bytes(b"0123456789")
    moves = spark.createDataFrame([("f", 0, 0, 5, 5), ("f", 1, 5, 5, 0)], "dest string, idx long, offset long, length long, dest_offset long")
    for _ in range(2):
        assert sorted(files.move_chunks(moves, root).collect()) == [("f", 0, "Success", 5), ("f", 1, "Success", 5)]
    assert (tmp_path / "f").read_bytes() == b"0123456789"
    for _ in range(2):
        assert files.publish(moves.selectExpr("dest AS path").distinct(), root).collect() == [("f", 10)]
    assert (tmp_path / "f").read_bytes() == b"5678901234"


def test_copies_check_time_and_hash(spark, tmp_path):
    import hashlib

    root, data = str(tmp_path), b"hello world"
    (tmp_path / "s").write_bytes(data)
    at, good = os.stat(tmp_path / "s").st_mtime_ns, hashlib.sha256(b"world").hexdigest()
    rows = [("d/x", 0, 2, "s", 6, 5, at, good), ("d/x", 1, 0, "s", 6, 5, at // 10**9, good), ("d/x", 2, 0, "s", 0, 5, at, good), ("d/x", 3, 0, "s", 6, 5, None, good), ("d/x", 4, 0, "../s", 6, 5, at, good), ("d/x", 5, 0, None, 6, 5, at, good)]
    tasks = spark.createDataFrame(rows, "dest string, idx long, dest_offset long, source string, offset long, length long, modified long, strong string")
    got = {r.idx: (r.outcome, r.bytes) for r in files.copy_chunks(tasks, root).collect()}
    assert got == {0: ("Success", 5), 1: ("Success", 5), 2: ("HashMismatch", 0), 3: ("SourceModified", 0), 4: ("IOError", 0), 5: ("IOError", 0)}
    files.publish(tasks.selectExpr("dest AS path").distinct(), root).collect()
    assert (tmp_path / "d/x").read_bytes() in (b"wowor" + b"ld", b"world" + b"ld")


def test_directories_and_links(spark, tmp_path):
    rows = [("a/b", "D", None, None, None), ("a/l", "L", None, None, "../f"), ("f", "F", 0, bytearray(b"x"), None), ("z", "F", None, None, None)]
    e = spark.createDataFrame(rows, "path string, kind string, offset long, data binary, target string")
    for _ in range(2):
        assert sorted(sink.write_blocks(e, str(tmp_path)).collect()) == [("a/b", 0), ("a/l", 0), ("f", 1), ("z", 0)]
    assert os.path.isdir(tmp_path / "a/b") and os.readlink(tmp_path / "a/l") == "../f" and (tmp_path / "z").read_bytes() == b""
    for bad in (("../q", "F", 0, bytearray(b"x"), None), ("a/../../q", "L", None, None, "f"), ("a/../../q", "D", None, None, None)):
        with pytest.raises(Exception, match="outside the root"):
            sink.write_blocks(spark.createDataFrame([bad], e.schema), str(tmp_path)).collect()


def test_bad_ranges_fail_alone(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"hello")
    want = spark.createDataFrame([("f", 0, 1, 3), ("f", 1, None, 1), ("f", 2, 3, 9), (None, 3, 0, 1), ("g", 4, 0, 1)], "path string, idx long, offset long, length long")
    got = {r.idx: (r.data and bytes(r.data), r.error) for r in files.read_ranges(want, str(tmp_path)).collect()}
    assert got == {0: (b"ell", None), 1: (None, "invalid range"), 2: (b"lo", None), 3: (None, "invalid path"), 4: (None, "file not found")}
    assert files.read_ranges(want.filter("idx = 2"), str(tmp_path), exact=True).first().error == "short read"
    assert files.file_hashes(spark.createDataFrame([("f",)], "path string"), str(tmp_path)).filter(F.col("hash") == F.sha2(F.encode(F.lit("hello"), "utf-8"), 256)).count() == 1
