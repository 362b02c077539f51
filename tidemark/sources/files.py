"""Reading, chunking and copying parts of files on a file system that all executors share.

Files are opened where a task runs. No more of one is in memory than a piece, a range or a window. What
writes goes into ``<file>.tmp`` and reads only published files, so that a task that runs again writes the
same bytes to the same places; ``publish`` then renames, as a step of its own.
"""

import hashlib
import os
import shutil
import stat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators.chunking import Profile, cuts, weak_hash

PIECE, MOST, WINDOW = 64 * 1024, 100 * 1024 * 1024, 256 * 1024 * 1024


def inside(root: str, path: str) -> str:
    """The full name of a path below the root; others are refused."""
    if path is None or "\0" in path or ".." in path.split("/") or path.startswith("/"):
        raise OSError("invalid path")
    return os.path.join(root, path)


def regular(full: str):
    """The file opened for reading; links, directories and devices are refused."""
    try:
        fd = os.open(full, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except FileNotFoundError:
        raise OSError("file not found") from None
    except OSError as e:
        if os.path.islink(full):
            raise OSError("not a regular file") from None
        raise OSError(e.strerror) from None
    if not stat.S_ISREG(os.fstat(fd).st_mode):
        os.close(fd)
        raise OSError("not a regular file")
    return os.fdopen(fd, "rb")


def rows_of(batches, one, schema):
    """Batches of ``one(row)``'s rows; each is sent on once it holds ``PIECE`` bytes or so of binary data."""
    for b in batches:
        out, held = [], 0
        for row in b.to_pylist():
            for r in one(row):
                out.append(r)
                held += sum(len(v) for v in r.values() if isinstance(v, bytes)) + 64
                if held >= PIECE:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def file_hashes(files: DataFrame, root: str) -> DataFrame:
    """(path, bytes, hash): SHA-256 of whole files, read in pieces (H1). An unreadable one fails the query."""
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("hash", pa.string())])

    def one(row):
        h, n = hashlib.sha256(), 0
        with regular(inside(root, row["path"])) as f:
            while piece := f.read(PIECE):
                h.update(piece)
                n += len(piece)
        yield {"path": row["path"], "bytes": n, "hash": h.hexdigest()}

    return files.select("path").mapInArrow(lambda batches: rows_of(batches, one, schema), "path string, bytes long, hash string")


def read_ranges(requests: DataFrame, root: str, exact: bool = False, most: int = MOST) -> DataFrame:
    """(path, idx, success, data, error) of ranges (path, idx, offset, length), read by position. A range is
    clipped at the end of its file, or fails there if ``exact``; a bad one fails alone (A12-A15)."""
    schema = pa.schema([("path", pa.string()), ("idx", pa.int64()), ("success", pa.bool_()), ("data", pa.binary()), ("error", pa.string())])

    def one(row):
        data = error = None
        try:
            offset, length = row["offset"], row["length"]
            if offset is None or length is None or offset < 0 or length < 0:
                raise OSError("invalid range")
            if length > most:
                raise OSError("range too long")
            with regular(inside(root, row["path"])) as f:
                if offset >= os.fstat(f.fileno()).st_size:
                    raise OSError("offset beyond the end")
                f.seek(offset)
                data = f.read(length)
            if exact and len(data) < length:
                raise OSError("short read")
        except OSError as e:
            data, error = None, str(e)
        yield {"path": row["path"], "idx": row["idx"], "success": error is None, "data": data, "error": error}

    r = requests.select("path", F.col("idx").cast("long"), F.col("offset").cast("long"), F.col("length").cast("long"))
    return r.mapInArrow(lambda batches: rows_of(batches, one, schema), "path string, idx long, success boolean, data binary, error string")


def file_chunks(files: DataFrame, root: str, profile: Profile = Profile(), window: int = WINDOW, strong: bool = True) -> DataFrame:
    """(path, idx, offset, length, weak, strong) of whole files, a window at a time (I3, I6, I8, I10). A chunk
    that the window's end cut short waits for the next window, so that chunks are those of the whole file."""
    if window < profile.most:
        raise ValueError(f"a window must hold a chunk: {window} < {profile.most}")
    schema = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("idx", "offset", "length", "weak")), ("strong", pa.string())])

    def one(row):
        idx = at = 0
        held = b""
        with regular(inside(root, row["path"])) as f:
            while True:
                more = f.read(window)
                held += more
                ends = cuts(held, profile)
                start = 0
                for end in ends if not more else ends[:-1]:
                    piece = held[start:end]
                    yield {"path": row["path"], "idx": idx, "offset": at + start, "length": end - start, "weak": weak_hash(piece), "strong": hashlib.sha256(piece).hexdigest() if strong else None}
                    idx, start = idx + 1, end
                held, at = held[start:], at + start
                if not more:
                    return

    return files.select("path").mapInArrow(lambda batches: rows_of(batches, one, schema), "path string, idx long, offset long, length long, weak long, strong string")


def regular_versions(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths with the version of the regular file there, null for anything else."""
    v = listing.filter(~F.col("is_dir") & ~F.col("is_symlink")).select("path", "size", "modified", "change_time", "inode")
    return paths.join(v, "path", "left")


def same_time(a: int, b: int) -> bool:
    """``E.ts_match`` for the time that a task finds: of whole seconds where one side has no finer ones."""
    legacy = lambda x: abs(x) < E.LEGACY_LIMIT
    seconds = lambda x: x if legacy(x) else x // 1_000_000_000
    return a == b or ((legacy(a) or legacy(b)) and seconds(a) == seconds(b))


def copied(root: str, t: dict) -> tuple[str, bytes]:
    """Outcome of one verified copy and the bytes read."""
    if t["strong"] is None:
        return "MissingHash", b""
    try:
        with regular(inside(root, t["source"])) as f:
            if t["modified"] is None or not same_time(os.fstat(f.fileno()).st_mtime_ns, t["modified"]):
                return "SourceModified", b""
            f.seek(t["offset"])
            data = f.read(t["length"])
    except OSError as e:
        return ("SourceNotFound" if str(e) == "file not found" else "IOError"), b""
    return ("Success", data) if hashlib.sha256(data).hexdigest() == t["strong"] else ("HashMismatch", b"")


def into_tmp(rows: DataFrame, root: str, order: list, data, start) -> DataFrame:
    """(dest, idx, outcome, bytes): each destination's rows go to one task, which opens its ``.tmp`` with
    ``start(full)`` and writes what ``data(row)`` gives at ``dest_offset``."""
    schema = pa.schema([("dest", pa.string()), ("idx", pa.int64()), ("outcome", pa.string()), ("bytes", pa.int64())])

    def run(batches):
        name = f = None

        def one(row):
            nonlocal name, f
            if row["dest"] != name:
                if f is not None:
                    f.close()
                name, full = row["dest"], inside(root, row["dest"])
                os.makedirs(os.path.dirname(full), exist_ok=True)
                start(full)
                f = open(full + ".tmp", "r+b")
            outcome, piece = data(row)
            if piece:
                f.seek(row["dest_offset"])
                f.write(piece)
            yield {"dest": name, "idx": row["idx"], "outcome": outcome, "bytes": len(piece)}

        yield from rows_of(batches, one, schema)
        if f is not None:
            f.close()

    return rows.repartition("dest").sortWithinPartitions("dest", *order).mapInArrow(run, "dest string, idx long, outcome string, bytes long")


def copy_chunks(tasks: DataFrame, root: str) -> DataFrame:
    """Copy chunks (dest, idx, dest_offset, source, offset, length, modified, strong) out of other files, each
    checked for its time and hash; by source and offset. What fails is left to the network (A21-A23)."""

    def start(full):
        if not os.path.exists(full + ".tmp"):
            open(full + ".tmp", "wb").close()

    return into_tmp(tasks, root, ["source", "offset"], lambda t: copied(root, t), start)


def move_chunks(moves: DataFrame, root: str) -> DataFrame:
    """Move chunks (dest, idx, offset, length, dest_offset) within a file, from its end (A20). All are read from
    the published file, whatever is already written, and land in a copy of it."""

    def data(row):
        with regular(inside(root, row["dest"])) as f:
            f.seek(row["offset"])
            return "Success", f.read(row["length"])

    return into_tmp(moves, root, [F.desc("dest_offset")], data, lambda full: shutil.copyfile(full, full + ".tmp"))


def publish(files: DataFrame, root: str) -> DataFrame:
    """(path, bytes): each file's ``.tmp`` takes its name (A18); one that has it already stays. Where there are
    columns modified and mode, the file gets them."""
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64())])

    def one(row):
        full = inside(root, row["path"])
        if os.path.exists(full + ".tmp"):
            os.replace(full + ".tmp", full)
        if row.get("mode") is not None:
            os.chmod(full, row["mode"])
        if row.get("modified") is not None:
            os.utime(full, ns=(row["modified"], row["modified"]))
        yield {"path": row["path"], "bytes": os.path.getsize(full)}

    return files.select("path", *(c for c in ("modified", "mode") if c in files.columns)).mapInArrow(lambda batches: rows_of(batches, one, schema), "path string, bytes long")


def remove(paths: DataFrame, root: str) -> DataFrame:
    """(path): entries below the root go, directories with all that they hold; what is gone already is no error."""
    schema = pa.schema([("path", pa.string())])

    def one(row):
        full = inside(root, row["path"])
        if not row["path"].strip("/."):
            raise OSError("invalid path")
        if os.path.isdir(full) and not os.path.islink(full):
            shutil.rmtree(full, ignore_errors=True)
        elif os.path.lexists(full):
            os.remove(full)
        yield {"path": row["path"]}

    return paths.select("path").mapInArrow(lambda batches: rows_of(batches, one, schema), "path string")
