"""Truth tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as E
from tidemark.operators import changes, jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def L(v, kind="long"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (1_710_000_000, 1_710_000_000_123_456_789, True),
        (1_710_000_000_123_456_789, 1_710_000_000, True),
        (1_710_000_000_000_000_001, 1_710_000_000_000_000_999, False),
        (5, 5, True),
        (-1, -1_000_000_000_001, False),
        (1_710_000_000, 1_710_000_001_000_000_000, False),
    ],
)
def test_ts_match(spark, a, b, want):
    assert one(spark, E.ts_match(L(a), L(b))) is want


@pytest.mark.parametrize(("a", "b", "want"), [(None, None, True), (None, 1, False), (1, None, False), (7, 7, True)])
def test_optional_ts_match(spark, a, b, want):
    assert one(spark, E.optional_ts_match(L(a), L(b))) is want


def test_whole_seconds_round_down(spark):
    assert one(spark, E.whole_seconds(L(-1_000_000_000_001))) == -1001
    assert one(spark, E.whole_seconds(L(9_223_372_036_854_775_807))) == 9_223_372_036


@pytest.mark.parametrize(("done", "total", "want"), [(0, 0, 0), (1024, 0, 0), (5, 10, 50), (15, 10, 100), (999, 1000, 99)])
def test_percent(spark, done, total, want):
    assert one(spark, E.percent(L(done), L(total))) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [("/a/./b/../c", "/a/c"), ("../x", "x"), ("a//b/", "a/b"), ("/", "/"), ("/..", "/")],
)
def test_normalized_path(spark, path, want):
    assert one(spark, E.normalized_path(F.lit(path))) == want


def test_paths(spark):
    assert one(spark, E.ancestors(F.lit("a/b/c"))) == ["a", "a/b"]
    assert one(spark, E.ancestors(F.lit("a"))) == []
    assert one(spark, E.parent_path(F.lit("a"))) == "."
    assert one(spark, E.parent_path(F.lit("/a"))) == "/"
    assert one(spark, E.strip_prefix(F.lit("ab/c"), F.lit("a"))) is None
    assert one(spark, E.strip_prefix(F.lit("a/c"), F.lit("a"))) == "c"
    assert one(spark, E.relative_path(F.lit("/s/x"), F.lit("/s"))) == "x"
    assert one(spark, E.relative_path(F.lit("/t/x"), F.lit("/s"))) == "/t/x"
    assert one(spark, E.valid_path(F.lit("a/../b"))) is False
    assert one(spark, E.valid_path(F.lit("a/..b"))) is True


def test_filters(spark):
    kept = lambda p, inc, exc: one(spark, E.file_kept(F.lit(p), inc, exc))
    assert kept("a/b.txt", [], []) is True
    assert kept("a/b.txt", ["[.]md$"], []) is False
    assert kept("skip/x/b.txt", [], ["^skip$"]) is False


@pytest.mark.parametrize(
    ("name", "want"),
    [("d/d3plot01", "SimulationResult"), ("a/.log", "Unknown"), ("x.PNG", "Image"), ("x.tar.gz", "Archive"), ("noext", "Unknown"), ("a.b/c", "Unknown")],
)
def test_class_by_name(spark, name, want):
    assert one(spark, E.class_by_name(F.lit(name))) == want


def test_class_by_magic(spark):
    magic = lambda b: one(spark, E.class_by_magic(F.lit(b)))
    assert [magic(bytes.fromhex(x)) for x in ("89504E47", "FFD8FF00", "1F8B0000", "425A6831", "1F8B", "00000000")] == ["Image", "Image", "Archive", "Archive", "Unknown", "Unknown"]


def test_texts(spark):
    assert [one(spark, E.human_bytes(L(n))) for n in (0, 1023, 2048, 1024**2, 3 * 1024**3)] == ["0 B", "1023 B", "2 KB", "1.0 MB", "3.00 GB"]
    assert [one(spark, E.duration_text(L(n))) for n in (5, 184, 3720)] == ["5s", "3m 4s", "1h 2m"]
    assert one(spark, E.datetime_text(F.lit("2024-01-02T03:04:05.678"))) == "2024-01-02 03:04:05"
    assert one(spark, E.datetime_text(F.lit(""))) == "-"
    assert one(spark, E.round_badge(F.lit("sync"), L(3), F.lit(True))) == "Final Round 3"
    assert one(spark, E.round_badge(F.lit("once"), L(3), F.lit(True))) is None


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("Not connected to server", "Other", "Retriable"),
        ("[fatal] timeout", "Io", "Fatal"),
        ("timed out", "ProtocolError", "Transient"),
        ("Permission denied", "FileOperation", "Fatal"),
        ("odd", "FileOperation", "Retriable"),
        ("odd", "Other", "Unknown"),
    ],
)
def test_error_category(spark, text, kind, want):
    assert one(spark, E.error_category(F.lit(text), F.lit(kind))) == want


def test_numbers(spark):
    assert [one(spark, E.network_quality(F.lit(float(x)))) for x in (800, 200, 50, 1, 0)] == ["Excellent", "Good", "Fair", "Poor", "Unknown"]
    assert [one(spark, E.retry_minutes(L(n))) for n in (-1, 0, 1, 2, 3, 9)] == [1, 1, 3, 6, 10, 10]
    assert one(spark, E.stream_budget(F.lit(False), F.lit(40), F.lit(4))) == 16
    assert one(spark, E.stream_budget(F.lit(True), F.lit(40), F.lit(4))) == 40
    assert [one(spark, E.backoff_ms(L(n))) for n in (0, 3, 20)] == [100, 800, 10000]
    assert one(spark, E.compression_level("zstd", F.lit("custom"), F.lit(99))) == 22
    assert (jobs.clamp_limit(0), jobs.clamp_limit(501), jobs.clamp_limit(None)) == (1, 500, 100)
    assert (jobs.clamp_page(0, 5, 10), jobs.clamp_page(21, 9, 10), jobs.clamp_page(21, 1, 10)) == (0, 2, 1)


def test_one_sided_identity(spark):
    ok = lambda a, b: one(spark, changes.one_sided(L(a), L(b), L(a) == L(b)))
    assert [ok(1, 1), ok(1, 2), ok(None, 1), ok(1, None), ok(None, None)] == [True, False, False, False, True]


def test_permissions_ignore_unknown(spark):
    assert one(spark, changes.permissions_differ(F.lit(0o644), F.lit(0))) is False
    assert one(spark, changes.permissions_differ(F.lit(0o100644), F.lit(0o644))) is False


def test_unknown_status_fails_or_is_left_out(spark):
    d = spark.createDataFrame([("a", "pending", "once"), ("b", "odd", "once")], "job_id string, status string, job_type string")
    assert [r.job_id for r in jobs.decoded(d, strict=False).collect()] == ["a"]
    with pytest.raises(Exception, match="unknown status"):
        jobs.decoded(d).collect()


def test_human_bytes_ties_go_to_even(spark):
    given = (2560, 3584, 1_310_720, 1_363_149, 1024**3 * 5 // 4 + (1 << 30) // 8, 1023 * 1024 + 600, 7 * 1024**5)
    assert [one(spark, E.human_bytes(L(n))) for n in given] == ["2 KB", "4 KB", "1.2 MB", "1.3 MB", "1.38 GB", "1024 KB", "7340032.00 GB"]


def test_rules_of_single_values(spark):
    for text, yes in (("127.0.0.1:80", True), ("127.8.0.1:80", True), ("[::1]:80", True), ("localhost:9", True), ("localhost", True), ("0.0.0.0:80", False), ("10.0.0.1:80", False)):
        assert one(spark, E.is_loopback(F.lit(text))) == yes, text
    assert one(spark, E.rfc3339(F.lit(None).cast("string"))) is None and one(spark, E.rfc3339(F.lit("2024-01-02T03:04:05Z"))).minute == 4
    for bad in ("2024-01-02", "x", "2024-13-02T03:04:05Z"):
        with pytest.raises(Exception, match="invalid time"):
            one(spark, E.rfc3339(F.lit(bad)))
    assert one(spark, E.tuning(F.lit("Unknown"))) == one(spark, E.tuning(F.lit("Poor")))
    assert one(spark, E.kept_progress(L(5), L(0), L(42))) == 42 and one(spark, E.kept_progress(L(9), L(3), L(0))) == 100
