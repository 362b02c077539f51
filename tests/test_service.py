"""Answers to calls: order of the checks, conflicts, keys, and calls that may be repeated."""

from pyspark.sql import functions as F

from tidemark.operators import service

CALL = "call string, seq long, source_path string, dest_path string, region string, job_type string, exclude_regex array<string>, include_regex array<string>, key string"
JOB = "job_id string, job_type string, status string, dest_path string"
RETRY = "job_id string, retry_count int, max_retries int"


def test_create(spark):
    jobs = spark.createDataFrame([("a", "once", "syncing", "out/x"), ("b", "once", "completed", "done")], JOB)
    regions = spark.createDataFrame([("eu",), ("eu",)], "region string")
    good = lambda call, seq, dest="new", key=None, region="eu", kind="Sync", exclude=(), source="/s": (call, seq, source, dest, region, kind, list(exclude), None, key)
    rows = [good("ok", 1), good("below", 2, "out/x/y"), good("above", 3, "out"), good("beside", 4, "out/xy"), good("ended", 5, "done/z"), good("blank", 6, " "), good("null", 7, None), good("dots", 8, "a/../b"), good("far", 9, "/etc")]
    rows += [good("region", 10, region="us"), good("kind", 11, kind="odd"), good("pattern", 12, exclude=["(?=x)"]), good("k2", 14, "./new", "k"), good("k1", 13, "new", "k"), good("k3", 15, "other", "k"), good("none", 16, source=None)]
    got = {r.call: (r.code, r.message, r.job_id) for r in service.create_answers(spark.createDataFrame(rows, CALL), jobs, regions).collect()}
    assert len(got) == len(rows)
    assert {c: got[c][0] for c in got} == {
        "ok": 200, "below": 409, "above": 409, "beside": 200, "ended": 200, "blank": 400, "null": 400, "dots": 400, "far": 400,
        "region": 400, "kind": 400, "pattern": 400, "k1": 200, "k2": 200, "k3": 409, "none": 400,
    }
    assert got["k1"][2] == got["k2"][2] == "job-of-k1" and got["k3"][2] is None
    assert got["null"][1] == "dest_path is required" and got["far"][1] == "dest_path is not allowed" and got["pattern"][1] == "exclude_regex is invalid"
    far = service.create_answers(spark.createDataFrame([good("far", 9, "/etc")], CALL), jobs, regions, external=True)
    assert far.first().code == 200 and service.create_answers(far.sparkSession.createDataFrame([], CALL), jobs, regions).count() == 0


def test_cancel_and_finalize(spark):
    rows = [("p", "once", "pending"), ("c", "once", "completed"), ("x", "once", "cancelled"), ("f", "once", "failed"), ("r", "once", "failed"), ("s", "sync", "failed"), ("s_final", "once", "failed"), ("t", "sync", "syncing"), ("t_final", "once", "syncing"), ("u", "sync", "pending"), ("v", "sync", "pending"), ("w", "sync", "completed"), ("old", "once", "completed")]
    jobs = spark.createDataFrame([(i, k, st, f"d/{i.removesuffix('_final')}") for i, k, st in rows] + [("near", "once", "syncing", "d/v/below")], JOB)
    retries = spark.createDataFrame([("r", 1, 3), ("r", 1, 3), ("f", 3, 3), ("old", 0, 3)], RETRY)
    calls = jobs.select("job_id").unionByName(jobs.select("job_id")).unionByName(spark.createDataFrame([("missing",)], "job_id string"))
    cancel = {r.job_id: (r.code, r.target_id, r.action) for r in service.cancel_answers(calls, jobs, retries).collect()}
    assert cancel["p"] == (200, "p", "cancel") and cancel["c"][0] == 409 and cancel["x"] == (200, "x", "none") and cancel["f"][0] == 409 and cancel["r"] == (200, "r", "cancel")
    assert cancel["t"] == (200, "t_final", "cancel") and cancel["t_final"][0] == cancel["missing"][0] == 404 and cancel["old"] == (200, "old", "drop retry")
    final = {r.job_id: (r.code, r.action) for r in service.finalize_answers(calls, jobs, retries).collect()}
    assert final["u"] == final["s"] == (200, "start") and final["t"] == (200, "none") and final["v"] == (409, "conflict")
    assert final["p"] == final["w"] == (400, "refuse") and final["missing"][0] == final["s_final"][0] == 404
    assert len(cancel) == len(final) == jobs.count() + 1


def test_overlaps_count_every_active_job_once(spark):
    jobs = spark.createDataFrame([("a", "once", "pending", "x/y"), ("b", "once", "paused", "x/y"), ("c", "once", "syncing", "x"), ("d", "once", "failed", "x"), ("e", "once", "syncing", "x/y/z")], JOB)
    rows = spark.createDataFrame([(1, "x/y"), (2, "x"), (3, "x/y/z/w"), (4, "q"), (5, "x/yy")], "id int, dest string")
    assert {r.id: r.active for r in service.active_overlaps(rows, "id", jobs).collect()} == {1: 4, 2: 4, 3: 4, 5: 1}
    assert service.health(jobs.filter("false")).select(F.col("status")).collect() == [("ok",)]
