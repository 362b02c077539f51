"""Rounds between two directory trees: what is sent, reused, removed, and left alone."""

import os
import random
import shutil

import pytest

from tidemark.operators import chunking
from tidemark.sources import transfer

SMALL = chunking.Profile(256, 1024, 4096)


def contents(root):
    found = {}
    for at, dirs, names in os.walk(root):
        for n in dirs + names:
            full = os.path.join(at, n)
            found[os.path.relpath(full, root)] = os.readlink(full) if os.path.islink(full) else None if os.path.isdir(full) else open(full, "rb").read()
    return found


@pytest.fixture
def go(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")

    def run(**options):
        return {r.path: r for r in transfer.transfer_round(spark, a, b, profile=SMALL, window=5000, **options).collect()}

    return a, b, run


def test_rounds(go):
    a, b, run = go
    rng = random.Random(4)
    data = {n: rng.randbytes(20_000) for n in ("one", "d/two", "d/e/three")}
    os.makedirs(f"{a}/d/e")
    os.makedirs(f"{a}/empty/in")
    for n, v in {**data, "none": b""}.items():
        open(f"{a}/{n}", "wb").write(v)
    os.symlink("../one", f"{a}/d/link")
    os.chmod(f"{a}/one", 0o640)
    first = run()
    assert set(first) == {*data, "none"} and all(r.reason == "new" and r.outcome == "done" for r in first.values())
    assert contents(a) == contents(b) and sum(r.transferred for r in first.values()) == 60_000
    assert os.stat(f"{b}/one").st_mode & 0o777 == 0o640 and os.stat(f"{b}/one").st_mtime_ns == os.stat(f"{a}/one").st_mtime_ns
    assert run() == {}
    # an edit is sent alone, a renamed file is copied, what changed its kind or vanished goes
    edited = data["one"][:9000] + b"edit" + data["one"][9000:]
    open(f"{a}/one", "wb").write(edited)
    os.rename(f"{a}/d/two", f"{a}/d/moved")
    os.remove(f"{a}/none")
    os.mkdir(f"{a}/none")
    os.remove(f"{a}/d/link")
    open(f"{a}/d/link", "wb").write(b"file now")
    os.rmdir(f"{a}/empty/in")
    shutil.rmtree(f"{a}/d/e")
    open(f"{a}/d/e", "wb").write(data["d/e/three"])
    second = run()
    assert set(second) == {"one", "d/moved", "d/link", "d/e"} and contents(a) == contents(b)
    assert second["one"].reason == "changed" and 0 < second["one"].transferred <= 3 * 4096 and second["one"].copied + second["one"].transferred == len(edited)
    assert second["d/e"].transferred == 20_000
    os.remove(f"{a}/one")
    os.symlink("d", f"{a}/one")
    assert run() == {} and contents(a) == contents(b)
    assert (second["d/moved"].copied, second["d/moved"].transferred) == (20_000, 0)


def test_filters_remove_nothing(go):
    a, b, run = go
    os.makedirs(a)
    os.makedirs(f"{b}/old")
    for n in ("x.txt", "y.log"):
        open(f"{a}/{n}", "wb").write(b"text")
    open(f"{b}/old/kept", "wb").write(b"kept")
    assert set(run(include=["txt$"])) == {"x.txt"}
    assert contents(b) == {"x.txt": b"text", "old": None, "old/kept": b"kept"}
    assert set(run()) == {"y.log"} and contents(b) == contents(a)
    os.remove(f"{a}/x.txt")
    os.remove(f"{a}/y.log")
    assert run() == {} and contents(b) == {}
