"""Writing blocks to files at their offsets, and publishing each file at once.

Blocks of a file are dealt to one task and written in order into ``<file>.tmp``, which is renamed when all
are in (mode ``tmp``), or into the file itself (mode ``append``). A task that runs again writes the same
bytes to the same places. The target is a file system that all executors share, as for any such sink.
"""

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("tmp", "append")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the one that all machines share, spark.checkpoint.dir, which has to be
    mounted as a file system. Only a local session may leave it unset."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = (own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")
    base = "/" + base.removeprefix("file:").lstrip("/") if base.startswith("file:") else base
    if not base.startswith("/"):
        raise ValueError(f"files need a mounted folder: {base}")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_blocks(blocks: DataFrame, root: str, mode: str = "tmp") -> DataFrame:
    """(path, bytes) written; ``blocks``: path below the root, offset, data (A16-A18). Empty files are made
    by a row with offset 0 and no data. Where there are columns kind and target, rows of kind D make a
    directory and rows of kind L a link, before any work on chunks (A19)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}: {mode}")

    def run(batches):
        name = f = None
        written = 0

        def done():
            f.close()
            if mode == "tmp":
                os.replace(f.name, f.name.removesuffix(".tmp"))
            return {"path": name, "bytes": written}

        for b in batches:
            out = []
            for path, offset, data, kind, link in zip(b["path"], b["offset"].tolist(), b["data"], b["kind"], b["target"]):
                full = os.path.join(root, path)
                if path != name or kind != "F":
                    if f is not None:
                        out.append(done())
                        name = f = None
                    at = os.path.join(os.path.realpath(os.path.dirname(full)), os.path.basename(full)) if kind == "L" else os.path.realpath(full)
                    if ".." in path.split("/") or not at.startswith(os.path.realpath(root) + os.sep):
                        raise ValueError(f"outside the root: {path}")
                    os.makedirs(full if kind == "D" else os.path.dirname(full), exist_ok=True)
                    if kind == "L" and not (os.path.islink(full) and os.readlink(full) == link):
                        if os.path.lexists(full + ".tmp"):
                            os.remove(full + ".tmp")
                        os.symlink(link, full + ".tmp")
                        os.replace(full + ".tmp", full)
                    if kind != "F":
                        out.append({"path": path, "bytes": 0})
                        continue
                    name, written = path, 0
                    target = full + ".tmp" if mode == "tmp" else full
                    f = open(target, "r+b" if mode == "append" and os.path.exists(target) else "wb")
                data = b"" if data is None else bytes(data)
                f.seek(offset)
                f.write(data)
                written += len(data)
            yield pd.DataFrame(out, columns=["path", "bytes"])
        if f is not None:
            yield pd.DataFrame([done()])

    has = lambda c, other: F.col(c) if c in blocks.columns else F.lit(other)
    rows = blocks.select("path", F.coalesce("offset", F.lit(0)).alias("offset"), "data", has("kind", "F").alias("kind"), has("target", None).cast("string").alias("target"))
    rows = rows.repartition("path").sortWithinPartitions("path", "offset")
    return rows.mapInPandas(run, "path string, bytes long")
