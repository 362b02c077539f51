"""Content-defined chunking: one binary or text value becomes many chunk rows.

A rolling gear hash over the last 64 bytes marks cut points; a stricter mask holds before the average size
and a looser one after it, so that sizes stay near the average. The gear table follows from a rule, and
cut points from this engine's own constants.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64


@dataclass(frozen=True)
class Profile:
    """Sizes in bytes."""

    least: int = 256 * 1024
    average: int = 2 * 1024 * 1024
    most: int = 8 * 1024 * 1024

    def __post_init__(self):
        if not 64 <= self.least <= self.average <= self.most:
            raise ValueError(f"chunk sizes must satisfy 64 <= least <= average <= most: {self}")


def gear() -> np.ndarray:
    """256 random 64-bit numbers: the first bytes of SHA-256 of each byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], U64)


GEAR = gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The hash at each byte: the sum over the last 64 bytes, each shifted by its age, by doubling."""
    h, span = GEAR[data], 1
    while span < 64:
        older = np.zeros_like(h)
        older[span:] = h[:-span] << U64(span)
        h = h + older
        span *= 2
    return h


def cuts(content: bytes, profile: Profile = Profile()) -> list[int]:
    """End offsets of the chunks; they tile the content."""
    n = len(content)
    bits = max(1, int(np.log2(profile.average)))
    h = gear_hashes(np.frombuffer(content, np.uint8)) if n else np.empty(0, U64)
    top = lambda k: np.flatnonzero(h >> U64(64 - k) == 0) + 1
    strict, loose = top(min(63, bits + 1)), top(max(1, bits - 1))
    out, start = [], 0
    while start < n:
        low, mid, high = start + profile.least, start + profile.average, min(start + profile.most, n)
        end = high
        for marks, a, b in ((strict, low, min(mid, high)), (loose, mid, high)):
            i = np.searchsorted(marks, a)
            if a < b and i < len(marks) and marks[i] < b:
                end = int(marks[i])
                break
        out.append(end)
        start = end
    return out


def weak_hash(piece: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)


def content_chunks(files: DataFrame, path_col: str, content_col: str, profile: Profile = Profile(), strong: bool = True) -> DataFrame:
    """(path, idx, offset, length, weak, strong): all chunks of each value (I1, I2, I4, I9). For files too
    large for a value, ``files.file_chunks`` gives the same chunks a window at a time."""
    kind = files.schema[path_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                content = b"" if content is None else bytes(content)
                start = 0
                for i, end in enumerate(cuts(content, profile)):
                    piece = content[start:end]
                    rows.append((path, i, start, end - start, weak_hash(piece), hashlib.sha256(piece).hexdigest() if strong else None))
                    start = end
            yield pd.DataFrame(rows, columns=["path", "idx", "offset", "length", "weak", "strong"])

    schema = f"path {kind}, idx long, offset long, length long, weak long, strong string"
    return files.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content")).mapInPandas(run, schema)


def strong_hashes(files: DataFrame) -> DataFrame:
    """Hashes of given ranges (path, content, ranges: array of offset, length), checked."""
    bad = lambda r: (r.offset < 0) | (r.length < 0) | (r.offset + r.length > F.length("content"))
    one = lambda r: F.when(bad(r), F.raise_error(F.lit("chunk range outside the file"))).otherwise(F.sha2(F.substring(F.col("content"), (r.offset + 1).cast("int"), r.length.cast("int")), 256))
    return files.select("path", F.posexplode(F.transform("ranges", one)).alias("idx", "strong"))


def fixed_chunks(files: DataFrame, path_col: str, content_col: str, size: int) -> DataFrame:
    """Chunks of equal size, in the JVM."""
    n = F.ceil(F.length("content") / F.lit(size)).cast("int")
    f = files.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content")).filter(F.length("content") > 0)
    f = f.select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    piece = F.substring(F.col("content"), F.col("idx") * size + 1, F.lit(size))
    return f.select("path", F.col("idx").cast("long").alias("idx"), (F.col("idx").cast("long") * size).alias("offset"), F.length(piece).cast("long").alias("length"), F.sha2(piece, 256).alias("strong"))
