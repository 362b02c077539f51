"""Packing documents into sequences by cutting-stock column generation.

Each document (its ids and the closing one) is cut into full sequences from its start; what remains, at
most one piece a document, is packed whole. Pieces are graded by length, rounded up to ``GRAIN`` tokens.
The histogram of grades is all the driver sees: at most 2048 / GRAIN rows. A linear program over patterns
(how many pieces of each grade share a sequence) minimises the sequences; a knapsack over the dual
prices, solved by dynamic programming, finds the next pattern until none pays. The solution is rounded
down, the few pieces left over are packed best fit decreasing, and each pattern takes the next ranks of
its grades. A piece's rank in its grade is its rank in its task plus what earlier tasks hold.

Cases: null and empty texts are one piece, the closing id. Very long texts are cut, never shortened.
Repeated rows are packed as often as they occur. An empty table gives no rows. Equal lengths are told
apart by rank. Extra columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, prepare, saved, table, texts_of
from .tokens import END, Encoder, groups

SEQUENCE = 2048
GRAIN = 8
#: The linear program ends when it is proven to be this near its optimum.
GAP = 1e-3


def pieces(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None, size: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """One row per piece, with its grade, and its rank in that grade within the task ``part``."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    closing = np.array([END], "<u4").tobytes()

    def run(batches):
        encode, ranks, part = Encoder(path), {}, TaskContext.get().partitionId()
        for b in batches:
            texts, rows = texts_of(b.column(1)), []
            for lo, hi in groups(texts):
                for doc, stream in enumerate(encode(texts[lo:hi]), lo):
                    stream += closing
                    n = len(stream) // 4
                    for start in range(0, n, size):
                        piece = stream[4 * start : 4 * (start + size)]
                        grade = -(-len(piece) // (4 * grain))
                        rank = ranks.get(grade, 0)
                        ranks[grade] = rank + 1
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, grade, part, rank))
            of = np.array(rows, np.int64).reshape(-1, 8)
            numbers = [pa.array(of[:, k]).cast(pa.int32() if k in (5, 6) else pa.int64()) for k in range(1, 8)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of[:, 0])), *numbers], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grade", "part", "rank"])
        give_back()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, grade int, part int, rank long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def knapsack(grades: np.ndarray, prices: np.ndarray, cap: int) -> tuple[float, dict[int, int]]:
    """The best-paid pattern: index of grade -> copies, by dynamic programming over the capacity."""
    best, take = np.zeros(cap + 1), np.full(cap + 1, -1)
    reach = np.searchsorted(grades, np.arange(cap + 1), "right")
    for c in range(1, cap + 1):
        best[c] = best[c - 1]
        if k := reach[c]:
            v = best[c - grades[:k]] + prices[:k]
            j = int(v.argmax())
            if v[j] > best[c] + 1e-12:
                best[c], take[c] = v[j], j
    pattern: dict[int, int] = {}
    c = cap
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[int(take[c])] = pattern.get(int(take[c]), 0) + 1
            c -= int(grades[take[c]])
    return float(best[cap]), pattern


def linear_program(grades: np.ndarray, need: np.ndarray, cap: int, gap: float = GAP, limit: int = 20_000):
    """Patterns and how often each is used (fractions), by the revised simplex method with generated columns."""
    m = len(grades)
    fit, by_length = cap // grades, grades / cap
    columns = [{i: int(fit[i])} for i in range(m)]
    inverse, x = np.diag(1.0 / fit), need / fit
    bound, share = by_length @ need, 0.2
    for _ in range(limit):
        if bound >= (1 - gap) * x.sum():
            break
        prices = inverse.sum(0)
        # Prices blended with those by length, which are near the optimum, keep the duals from swinging.
        value, pattern = knapsack(grades, share * prices + (1 - share) * by_length, cap)
        if sum(prices[i] * k for i, k in pattern.items()) <= 1 + 1e-6:
            if share == 1:
                break
            share = min(1.0, 2 * share)
            continue
        if share == 1:
            bound = max(bound, prices @ need / value)
        a = np.zeros(m)
        for i, k in pattern.items():
            a[i] = k
        d = inverse @ a
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        pivot = inverse[r] / d[r]
        inverse -= np.outer(d, pivot)
        inverse[r] = pivot
        columns[r] = pattern
    return columns, x


def cutting_stock(histogram: dict[int, int], cap: int) -> list[tuple[dict[int, int], int]]:
    """(pattern: grade -> copies, how many sequences use it), which together hold each grade's count."""
    grades = np.array(sorted(g for g, n in histogram.items() if n > 0), np.int64)
    if not len(grades):
        return []
    left = np.array([histogram[int(g)] for g in grades], np.int64)
    out = []
    for pattern, times in zip(*linear_program(grades, left.astype(float), cap)):
        whole = int(min(np.floor(times + 1e-6), *(left[i] // k for i, k in pattern.items())))
        if whole > 0:
            out.append(({int(grades[i]): k for i, k in pattern.items()}, whole))
            for i, k in pattern.items():
                left[i] -= k * whole
    open_bins: list[list] = []
    for i in range(len(grades) - 1, -1, -1):
        for _ in range(int(left[i])):
            fits = [b for b in open_bins if b[0] >= grades[i]]
            b = min(fits, key=lambda b: b[0]) if fits else None
            if b is None:
                open_bins.append(b := [cap, {}])
            b[0] -= int(grades[i])
            b[1][int(grades[i])] = b[1].get(int(grades[i]), 0) + 1
            if not b[0]:
                open_bins.remove(b)
                out.append((b[1], 1))
    return out + [(b[1], 1) for b in open_bins]


def slots(patterns) -> dict[int, np.ndarray]:
    """By grade, rows (first rank, first sequence, copies a sequence, place of the first copy)."""
    rows: dict[int, list] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        place = 0
        for g, k in sorted(pattern.items(), reverse=True):
            r = next_rank.get(g, 0)
            rows.setdefault(g, []).append((r, sequence, k, place))
            next_rank[g] = r + k * times
            place += k
        sequence += times
    return {g: np.array(v, np.int64) for g, v in rows.items()}


def pack(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None, size: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """Pieces with sequence_id and offset. The table of slots has at most a few thousand rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    p = saved(pieces(docs, id_col, text_col, path, size, grain), "pieces")
    counts = p.groupBy("grade", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["grade"]: r["n"] for r in counts.groupBy("grade").agg(F.sum("n").alias("n")).collect()}
    where = slots(cutting_stock(histogram, size // grain))
    earlier = Window.partitionBy("grade").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("grade", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            out = np.zeros((b.num_rows, 2), np.int64)
            grade, rank = b["grade"].to_numpy(), b["rank"].to_numpy() + b["base"].to_numpy()
            for g in np.unique(grade):
                i, rows = np.flatnonzero(grade == g), where[int(g)]
                first, seq, copies, place = rows[np.searchsorted(rows[:, 0], rank[i], "right") - 1].T
                out[i, 0], out[i, 1] = seq + (rank[i] - first) // copies, place + (rank[i] - first) % copies
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(out[:, 0]), pa.array(out[:, 1])], names=[*names, "sequence_id", "place"])

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"
    placed = p.join(base, ["grade", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "grade", "part", "rank", "base").mapInArrow(run, schema)
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("place")


def op3_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
