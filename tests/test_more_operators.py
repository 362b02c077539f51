"""Requests, codecs, the index, rounds, the sink and stored schemas."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import codec, requests
from tidemark.operators import adaptive, dedup, index, mutate, rounds
from tidemark.sources import sink


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_requests(spark):
    assert [one(spark, requests.idempotency_key(F.lit(k))) for k in (" a ", "  ", "x" * 256)] == ["a", None, None]
    assert [one(spark, requests.bearer_token(F.lit(k))) for k in ("Bearer abc", "bearer a b", "abc", "Basic x")] == ["abc", None, None, None]
    arr = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    same = [requests.request_fingerprint(F.lit(a), F.lit("d"), F.lit("once"), e, arr()) for a, e in (("/a/./b", arr("x", "y", "x")), ("/a/b", arr("y", "x")))]
    assert one(spark, same[0]) == one(spark, same[1])
    assert one(spark, same[0]) != one(spark, requests.request_fingerprint(F.lit("/a/b"), F.lit("d"), F.lit("once"), arr(), arr("x", "y")))
    assert one(spark, requests.destination(F.lit("out"), F.lit("f"), F.lit(1))) == "out"
    assert one(spark, requests.destination(F.lit("out/"), F.lit("f"), F.lit(1))) == "out/f"
    assert one(spark, requests.confined(F.lit("a/../b"), F.lit("/data"))) == "/data/b"
    assert one(spark, requests.relative_strict(F.lit("/data/x"), F.lit("/data"))) == "x"
    for bad in (requests.confined(F.lit("/etc"), F.lit("/data")), requests.confined(F.lit("../x"), F.lit("/data")), requests.relative_strict(F.lit("/data/../x"), F.lit("/data"))):
        with pytest.raises(Exception):
            one(spark, bad)
    for bad in ("(?=a)", r"(a)\1", "["):
        with pytest.raises(Exception):
            requests.check_patterns([bad])


@pytest.mark.parametrize("name", ["zstd", "zlib", "bz2", "lzma"])
def test_codec_round_trip(spark, name):
    rows = [(bytearray(b"ab" * 500), name), (bytearray(b"x"), name), (None, name)]
    d = codec.compressed(spark.createDataFrame(rows, "content binary, want string"), "content", "want")
    got = d.select("algorithm", (F.length("packed") < F.length("content")).alias("smaller"), codec.unpack("packed", "algorithm").eqNullSafe(F.col("content")).alias("same")).collect()
    assert [(r.algorithm, r.smaller, r.same) for r in got] == [(name, True, True), ("none", False, True), ("none", None, True)]


def test_codec_unknown():
    with pytest.raises(ValueError):
        codec.engine("nothing")


def test_index(spark):
    files = spark.createDataFrame([("a", 5, 1_710_000_000), ("b", 6, 2)], "path string, size long, modified long")
    cache = spark.createDataFrame([("a", 5, 1_710_000_000_000_000_007, "x"), ("b", 7, 2, "y")], "path string, size long, modified long, chunks string")
    assert {r.path: r.chunks for r in index.valid_cache(files, cache).collect()} == {"a": "x", "b": None}
    asked = spark.createDataFrame([(1, 0, "p"), (1, 1, "q"), (2, 0, "r")], "batch int, pos int, what string")
    told = spark.createDataFrame([(1, 0, "P"), (1, 1, "Q"), (2, 0, "R"), (2, 1, "S")], "batch int, pos int, answer string")
    assert {(r.what, r.answer) for r in index.zipped(asked, told).collect()} == {("p", "P"), ("q", "Q")}
    locations = spark.createDataFrame([("h", "a", 1_710_000_000_000_000_007), ("h", "b", 3)], "hash string, path string, modified long")
    assert [r.path for r in index.valid_locations(locations, files).collect()] == ["a"]
    assert [r.path for r in index.without_files(locations, files.filter("path = 'a'")).collect()] == ["b"]
    results = spark.createDataFrame([(1, 2, True), (1, 1, True), (1, 0, False)], "batch int, idx int, ok boolean")
    r = index.batch_outcome(results).first()
    assert (r.succeeded, r.failed) == ([1, 2], [0])
    states = spark.createDataFrame([("a", [0], 4), ("b", None, 2)], "path string, completed array<int>, total_chunks int")
    done = spark.createDataFrame([("a", [1, 0])], "path string, succeeded array<int>")
    assert {(r.path, tuple(r.completed), r.progress) for r in index.folded(states, done).collect()} == {("a", (0, 1), 50), ("b", (), 0)}


def test_rounds(spark):
    q = spark.createDataFrame([("o", "once", 0, False), ("s", "sync", 3, False), ("l", "sync", 4, True)], "job_id string, job_type string, round_id long, is_last_round boolean")
    assert {r.job_id: (r.next, r.round_id) for r in rounds.after_round(q).collect()} == {"o": ("completed", 0), "s": ("again", 4), "l": ("completed", 4)}
    delay = lambda *v: spark.createDataFrame([v], "i int, s int, w boolean").select(rounds.next_delay_ms("i", "s", "w")).first()[0]
    assert [delay(10_000, 20_000, True), delay(10_000, 0, True), delay(10_000, 5, False)] == [10_000, 100, 10_000]
    assert rounds.trigger("sync", False, 10_000) == {"processingTime": "10000 milliseconds"} and rounds.trigger("once", False, 1) == {"availableNow": True}


def test_sink(spark, tmp_path):
    rows = [("a/x", 3, bytearray(b"def")), ("a/x", 0, bytearray(b"abc")), ("empty", 0, None)]
    d = spark.createDataFrame(rows, "path string, offset long, data binary")
    assert {(r.path, r.bytes) for r in sink.write_blocks(d, str(tmp_path)).collect()} == {("a/x", 6), ("empty", 0)}
    assert (tmp_path / "a/x").read_bytes() == b"abcdef" and (tmp_path / "empty").read_bytes() == b""
    sink.write_blocks(spark.createDataFrame([("a/x", 1, bytearray(b"Z"))], d.schema), str(tmp_path), "append").collect()
    assert (tmp_path / "a/x").read_bytes() == b"aZcdef" and not [f for f in os.listdir(tmp_path / "a") if f.endswith(".tmp")]
    with pytest.raises(Exception):
        sink.write_blocks(spark.createDataFrame([("../x", 0, bytearray(b"Z"))], d.schema), str(tmp_path)).collect()


def test_migration(spark):
    old = spark.createDataFrame([("j", '["a"]', '{"compression":"zstd","workers":2}')], "job_id string, exclude_regex string, options string")
    r = schemas.migrated(old, "jobs").first()
    assert (r.exclude_regex, r.options.workers, r.round_id, r.is_last_round, r.status) == (["a"], 2, 0, False, None)


def test_first_writer_and_generations(spark):
    r = spark.createDataFrame([("s", "k", "fa", "ja", 1, 1), ("s", "k", "fa", "jb", 2, 5), ("s", "k", "fb", "jc", 3, 9)], "scope string, key string, fingerprint string, job_id string, seq int, at int")
    got = mutate.reserve(r).first()
    assert (got.job_id, got.fingerprint, got.updated_at) == ("ja", "fa", 5)


def test_candidates_and_plan_order(spark):
    two = spark.createDataFrame([(0, "a.bin", 0, "1"), (1, "b.bin", 8, "2")], "pos long, path string, offset long, strong string")
    assert [(r.at.path, r.at.offset) for r in dedup.first_location(two, ["strong"]).filter("strong = '2'").collect()] == [("b.bin", 8)]
    chunk = spark.createDataFrame([("dest", 0, 0, 4, "7", False), ("dest", 1, 4, 4, "7", False), ("dest", 2, 8, 4, "8", True)], "path string, idx long, offset long, length long, strong string, done boolean")
    local = spark.createDataFrame([(0, "other", 100, "7"), (1, "dest", 0, "7")], "pos long, path string, offset long, strong string")
    got = {r.idx: (r.action, r.from_path, r.from_offset) for r in dedup.chunk_plan(chunk, local, local.filter("false")).collect()}
    assert got == {0: ("in_place", None, None), 1: ("relocate", "dest", 0)}


def test_adaptive_edges(spark):
    s = spark.createDataFrame([("r", 1, 1, 0, False), ("r", 2, 2, 0, False), ("q", 1, 1, 0, True)], "region string, ts long, seq long, bytes long, ok boolean")
    assert {r.region: (r.failures, r.state) for r in adaptive.health(s).collect()} == {"r": (2, "Degraded"), "q": (0, "Healthy")}
