"""Benchmark decontamination by winnowing.

Both sides hash their words and take k-gram hashes; of each window of w consecutive k-grams the smallest
hash is its fingerprint. Any span of k + w - 1 = 13 words that two texts share holds the same k-grams and
so has the same fingerprint at the same place, so that joining fingerprints misses no such span. A
fingerprint carries the windows it stands for, each as a second hash of its 13 words and of the
fingerprint's place in it; a joined pair is extended over those windows that both sides hold, and the
union of a text's windows are its hit spans. An item of n < 13 words is one window: k = n and w = 1.

The items' fingerprints are a table. So are those of the documents, which one scan of the texts writes
beside the word counts; a fingerprint that no item can have is left out there by a Bloom filter, whose size
is bounded (``FILTER_BITS``): a benchmark too large for it lets more through, and the join removes that. The
plan has the same steps however large the benchmark is, and nothing of it but the filter is sent to the
driver or broadcast, unless Spark finds a side of a join below its own threshold. Texts are known by a
128-bit hash: equal texts are joined once, so that a text that a third of all rows hold is one row there.

Cases: null and empty texts have no words: never contaminated, never an item with windows. Very long
texts are read whole. Repeated items with the same id count as one item; the words that an item without an
id hits are hit, but it is no item to count or name. Repeated rows of documents get equal results, and each
row is judged by its own text, whatever its id. An empty benchmark hits nothing. Extra columns are ignored
or, in ``kept_rows``, kept.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, forget, give_back, hash_texts, letter_words, mix, prepare, rolling, saved, table, texts_of

SPAN = 13
K = 5
W = SPAN - K + 1
#: Bits of the filter: 64 for each fingerprint of the items, between these bounds (32 MB at most).
FILTER_BITS = (1 << 16, 1 << 28)
PROBES = 3
STEP, TURN = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def kinds(n: int) -> tuple[int, int]:
    """(k, w) of windows of ``n`` words."""
    return (K, W) if n >= SPAN else (n, 1)


def windows_min(g: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` consecutive values, by doubling."""
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, U64)
    m, have = g, 1
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[w - have : w - have + n])


def fingerprints(h: np.ndarray, at: np.ndarray, n: int, admits=None) -> list[list[dict]]:
    """Of texts laid end to end (word hashes, offsets) the fingerprints of their windows of ``n`` words,
    those whose hash ``admits`` lets pass, with the starts of the windows they stand for and their checks."""
    out: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    k, w = kinds(n)
    g = rolling(h, k)
    m = windows_min(g, w)
    if not len(m):
        return out
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    i = np.flatnonzero(owner[: len(m)] == owner[n - 1 : n - 1 + len(m)])
    if admits is not None:
        i = i[admits(m[i])]
    if not len(i):
        return out
    place = np.lib.stride_tricks.sliding_window_view(g, w)[i].argmin(1)
    check = np.full(len(i), n, U64)
    for j in range(n):
        check = check * TURN + h[i + j]
    check = mix(check + place.astype(U64) * STEP).astype(np.int64)
    start, cut = i - at[owner[i]], np.flatnonzero(np.r_[True, np.diff(i + place) != 0, True])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        print_ = int(m[i[a]].astype(np.int64))
        out[owner[i[a]]].append({"n": n, "print": print_, "starts": start[a:b].tolist(), "checks": check[a:b].tolist()})
    return out


def probes(prints: np.ndarray, j: int, bits: int) -> np.ndarray:
    return mix(prints + U64(j) * STEP) & U64(bits - 1)


class Filter:
    """A Bloom filter of fingerprints."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        at = np.arange(len(prints))
        for j in range(PROBES):
            p = probes(prints[at], j, self.bits)
            at = at[(self.words[(p >> U64(6)).astype(np.int64)] >> (p & U64(63))) & U64(1) == 1]
        return at


PRINT = "n int, print long, starts array<int>, checks array<long>"
PRINTS = pa.list_(pa.struct([("n", pa.int32()), ("print", pa.int64()), ("starts", pa.list_(pa.int32())), ("checks", pa.list_(pa.int64()))]))


def item_prints(benchmark: DataFrame, item_col="item_id", text_col="text") -> DataFrame:
    """(item, n, print, checks): a table of the items' fingerprints, each with all windows it stands for."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()

    def run(batches):
        for b in batches:
            h, at = hash_texts(texts_of(b.column(1)), letter_words)
            found = [[] for _ in range(b.num_rows)]
            for r, size in enumerate(np.diff(at).tolist()):
                if size:
                    found[r] = fingerprints(h[at[r] : at[r + 1]], np.array([0, size]), min(SPAN, size))[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, PRINTS)], names=["item", "prints"])

    own = items.mapInArrow(run, f"item string, prints array<struct<{PRINT}>>").select("item", F.inline("prints"))
    return saved(own.groupBy("item", "n", "print").agg(F.array_distinct(F.flatten(F.collect_set("checks"))).alias("checks")), "item-prints", few=True)


def print_filter(items: DataFrame) -> Filter:
    """The filter of all fingerprints; its words are summed by place in Spark."""
    count = items.agg(F.count(F.lit(1))).first()[0]
    bits = min(max(FILTER_BITS[0], 1 << (64 * count).bit_length()), FILTER_BITS[1])

    def run(batches):
        for b in batches:
            p = b.column(0).to_numpy().astype(U64)
            at = np.concatenate([probes(p, j, bits) for j in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).astype(np.int64))], names=["word", "bits"])

    some = items.select("print").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, U64)
    words[some["word"].to_numpy()] = some["bits"].to_numpy().astype(U64)
    return Filter(words, bits)


def text_prints(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t1, t2, n_words, prints): a table with a row per row of ``docs``; t1 and t2 name its text."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast((print_filter(items), sorted(r.n for r in items.select("n").distinct().collect())))

    def run(batches):
        admits, sizes = sent.value
        for b in batches:
            h, at = hash_texts(texts_of(b.column(3)), letter_words)
            prints = [[] for _ in range(b.num_rows)]
            for n in sizes:
                for own, found in zip(prints, fingerprints(h, at, n, admits)):
                    own += found
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), pa.array(np.diff(at)), pa.array(prints, PRINTS)], names=["doc_id", "t1", "t2", "n_words", "prints"])
        give_back()

    d = docs.select(F.col(id_col).alias("doc_id"), *text_name(text_col, "t1", "t2"), F.col(text_col).alias("text"))
    return saved(d.mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, n_words long, prints array<struct<{PRINT}>>"), "text-prints")


def text_name(text_col: str, *names: str) -> list:
    return [F.xxhash64(text_col).alias(names[0]), F.xxhash64(F.lit(1), text_col).alias(names[1])]


def merged(windows) -> list[list[int]]:
    """Spans [from, to) that the windows (start, length) cover."""
    out: list[list[int]] = []
    for a, n in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return out


def hit_texts(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(t1, t2, n_hit, n_items, items_sha256, spans, items) of the texts that hold any window of an item."""
    found = prints.filter(F.size("prints") > 0).select("t1", "t2", "prints").dropDuplicates(["t1", "t2"]).select("t1", "t2", F.inline("prints"))
    joined = found.join(items.withColumnRenamed("checks", "known"), ["n", "print"])
    # extend each joined fingerprint over the windows that both sides hold
    both = F.filter(F.arrays_zip("starts", "checks"), lambda x: F.array_contains("known", x["checks"]))
    hits = joined.select("t1", "t2", "n", "item", both.alias("both")).filter(F.size("both") > 0).select("t1", "t2", "n", "item", F.inline("both"))
    of = hits.groupBy("t1", "t2").agg(F.collect_set(F.struct("starts", "n")).alias("windows"), F.collect_set("item").alias("items"))

    def run(batches):
        for b in batches:
            spans = [merged((x["starts"], x["n"]) for x in w) for w in b.column(2).to_pylist()]
            items = [sorted(x) for x in b.column(3).to_pylist()]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            hit = [sum(y - x for x, y in s) for s in spans]
            own = [pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own], names=["t1", "t2", "n_hit", "n_items", "items_sha256", "spans", "items"])

    return of.mapInArrow(run, "t1 long, t2 long, n_hit long, n_items long, items_sha256 string, spans array<array<long>>, items array<string>")


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: word counts, the hit spans (word positions) and items, the verdict."""
    items = item_prints(benchmark)
    prints = text_prints(docs, items, id_col, text_col)
    d = prints.select("doc_id", "t1", "t2", "n_words").join(hit_texts(prints, items), ["t1", "t2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    d = d.withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "n_items": F.coalesce("n_items", F.lit(0).cast("long")), "items_sha256": F.coalesce("items_sha256", F.lit(none)),
            "spans": F.coalesce("spans", F.array().cast("array<array<long>>")), "items": F.coalesce("items", F.array().cast("array<string>")),
        }
    )
    return d.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", is_contaminated().alias("contaminated"), "spans", "items")


def kept_rows(docs: DataFrame, benchmark: DataFrame, text_col="text") -> DataFrame:
    """The rows of ``docs``, whole, that are not contaminated, each judged by its own text.

    The names of the contaminated texts are a table, the smaller side of an anti-join: while Spark finds it
    below its broadcast threshold no text is shuffled, beyond it the join deals both sides by the name.
    """
    items = item_prints(benchmark)
    prints = text_prints(docs.select(F.lit(0).alias("id"), text_col), items, "id", text_col)
    words = prints.groupBy("t1", "t2").agg(F.max("n_words").alias("n_words"))
    bad = saved(hit_texts(prints, items).join(words, ["t1", "t2"]).filter(is_contaminated()).select("t1", "t2"), "contaminated", few=True)
    forget(prints)
    forget(items)
    own = ["t1", "t2"]
    while set(own) & set(docs.columns):
        own = [x + "_" for x in own]
    return docs.withColumns(dict(zip(own, text_name(text_col, *own)))).join(bad.toDF(*own), own, "left_anti").select(docs.columns)


def op2_decontamination(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
