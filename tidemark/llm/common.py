"""Shared pieces: shared-folder tables, word splitting on bytes, vectorised hashes.

Text is handled as UTF-8 bytes: every delimiter of the contracts is ASCII, so splitting bytes equals
splitting code points, and ``bytes.lower`` changes A-Z only.
"""

import ctypes
import itertools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Only a local session may leave it unset; its
    tables then go beside the warehouse."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def saved(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends at files that
    survive the loss of any executor. Tables stay until ``forget`` or the folder's own clean-up. ``few``: small rows, in no more files than cores."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if few:
        df = df.coalesce(4 * max(1, spark.sparkContext.defaultParallelism // 4))
    # the shuffles behind a table that is written are not read again
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote and that no later plan reads."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, and what one stage needed would be
    held while the next one runs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts_of(column) -> list[str]:
    """Texts of an Arrow column; null is empty."""
    return [t or "" for t in column.to_pylist()]


def map_texts(docs: DataFrame, make, columns: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, columns) of every row. ``make()`` is called once a task and gives a function from a list of
    texts to a list of Arrow arrays, one a column. Ids pass through as Arrow, whatever their type; nulls
    beside large numbers stay exact."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches):
        of = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *of(texts_of(b.column(1)))], names=names)
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {columns}")


def filter_texts(docs: DataFrame, make, text_col="text") -> DataFrame:
    """The rows of ``docs``, whole and unchanged, whose text the function that ``make()`` gives admits."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        of = make()
        for b in batches:
            yield b.filter(pa.array(np.asarray(of(texts_of(b.column(at))), bool)))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def stable_order(id_col: str) -> Column:
    return F.xxhash64(F.lit("order"), F.col(id_col).cast("string"))


#: ASCII characters that are neither digits nor letters become spaces; A-Z become a-z.
LETTERS = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256)
)


def utf8(text) -> bytes:
    return text.encode() if isinstance(text, str) else b""


def letter_words(text) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return utf8(text).translate(LETTERS).split()


def plain_words(text, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` splits at exactly these six characters."""
    b = utf8(text)
    return (b.lower() if lower else b).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same in every process and on every machine."""
    if not words:
        return np.empty(0, U64)
    a = np.empty(len(words), object)
    a[:] = words
    return mix(pd.util.hash_array(a, categorize=False))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, k, U64)
    for j in range(k):
        out = out * U64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)


def hash_texts(texts, split) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and the offsets at which each text begins (one more)."""
    words = [split(t) for t in texts]
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    return hash_words(list(itertools.chain.from_iterable(words))), at
