"""Block compression by named algorithm, as Arrow-batched functions.

``zstd``, ``zlib``, ``bz2`` and ``lzma`` are at hand; ``brotli`` and ``lz4`` are used where installed. A
name without an engine fails the query.
"""

import bz2
import importlib
import lzma
import zlib

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exprs as E


def engines() -> dict:
    found = {
        "zstd": (lambda b, level: zstandard.ZstdCompressor(level=level).compress(b), lambda b: zstandard.ZstdDecompressor().decompress(b)),
        "zlib": (lambda b, level: zlib.compress(b, min(level, 9)), zlib.decompress),
        "bz2": (lambda b, level: bz2.compress(b, max(1, min(level, 9))), bz2.decompress),
        "lzma": (lambda b, level: lzma.compress(b, preset=min(level, 9)), lzma.decompress),
        "none": (lambda b, level: b, lambda b: b),
    }
    for name, module, call in (("brotli", "brotli", "quality"), ("lz4", "lz4.frame", "compression_level")):
        try:
            m = importlib.import_module(module)
        except ImportError:
            continue
        found[name] = (lambda b, level, m=m, call=call: m.compress(b, **{call: level}), m.decompress)
    return found


def engine(name: str):
    try:
        return engines()[name]
    except KeyError:
        raise ValueError(f"unknown compression algorithm: {name}") from None


def compressed(blocks: DataFrame, content: str, algorithm: str, level: int = 3, out: str = "packed", used: str = "algorithm") -> DataFrame:
    """Adds the block compressed by the algorithm its row names, and what was used: the result counts only
    where it is strictly smaller, else the block stays as it is with ``none`` (H23, H25, H26)."""

    @F.pandas_udf("struct<data binary, algorithm string>")
    def pack(data: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = []
        for b, a in zip(data, name):
            if b is None:
                rows.append((None, "none"))
                continue
            b = bytes(b)
            p = engine(a)[0](b, level)
            rows.append((p, a) if len(p) < len(b) else (b, "none"))
        return pd.DataFrame(rows, columns=["data", "algorithm"])

    return blocks.withColumn("_p", pack(F.col(content).cast("binary"), F.col(algorithm))).withColumns({out: F.col("_p.data"), used: F.col("_p.algorithm")}).drop("_p")


def unpack(data, name):
    """The inverse (H24): a column."""

    @F.pandas_udf("binary")
    def restore(blocks: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else engine(a)[1](bytes(b)) for b, a in zip(blocks, names)])

    return restore(E.col(data), E.col(name))


def smart(blocks: DataFrame, path: str, content: str, level: int = 3) -> DataFrame:
    """Class by name, then the algorithm recommended for it if an engine is at hand, else zstd."""
    known = list(engines())
    want = E.algorithm(E.file_class(path, F.col(content).cast("binary")))
    return compressed(blocks.withColumn("_a", F.when(want.isin(known), want).otherwise(F.lit("zstd"))), content, "_a", level).drop("_a")
