"""Toxicity by a factorization machine over hashed terms.

    z = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,   score = 1 / (1 + exp(-z))

A term is a word of the text or the first four letters of a word (marked apart), hashed into 2^20
buckets; x_i is 1 for each bucket the text touches. The pairwise part learns that an insult beside a
group's name weighs more than both alone, which additive weights cannot. Buckets that fewer than
``MIN_TEXTS`` training texts touch, or whose share among toxic and other texts differs by no more than
chance (G-test below ``MIN_G``), are left out: the hundreds of neutral words of a text would drown the few
that matter.

Cases: null and empty texts touch no bucket and score sigmoid(w0). Very long texts are read whole; a term
counts once however often it occurs. Repeated rows get equal scores. Without labels of both classes the
score is the share of toxic ones (0 without any). Extra columns of the inputs are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, filter_texts, fold, forget, hash_words, letter_words, map_texts, mix, saved, table, texts_of
from .quality import bounded, labelled

BUCKETS = 1 << 20
RANK = 4
#: Bound of the fit: that many labelled texts of each class, first by a hash of the id.
MAX_TEXTS = 8000
MIN_TEXTS = 3
MIN_G, MIN_PAIR_G = 8.0, 20.0
#: Bounds of the model and of what the driver collects for the fit: the terms of the largest G of either
#: kind, and as many of the sampled texts, by a hash of the id, as fit the bytes (all of them, usually).
MAX_TERMS = 4096
MAX_BYTES = 32_000_000
THRESHOLD = 0.3


def terms(text) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    words = list(set(letter_words(text)))
    if not words:
        return np.empty(0, np.int64)
    heads = list({w.decode()[:4].encode() for w in words if len(w) > 4})
    h = np.concatenate([hash_words(words), mix(hash_words(heads) + U64(1))])
    return np.unique(h & U64(BUCKETS - 1)).astype(np.int64)


def bucket_counts(rows: DataFrame, beside: np.ndarray | None = None) -> DataFrame:
    """(bucket, a, b): how many toxic and how many other texts touch each bucket; with ``beside``, among the
    texts that touch one of these buckets. A task adds up its own texts first."""

    def run(batches):
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = terms(t)
                if beside is None or np.isin(x, beside, assume_unique=True).any():
                    n[y, x] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1, at]), pa.array(n[0, at])], names=["bucket", "a", "b"])

    part = rows.select("y", "text").mapInArrow(run, "bucket long, a long, b long")
    return part.groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def g_test(n1: int, n0: int):
    """G of the 2x2 table of touching a bucket (columns a, b) and being toxic."""
    n, held, out = float(n1 + n0), F.col("a") + F.col("b"), F.lit(0.0)
    for seen, col, row in ((F.col("a"), held, n1), (F.col("b"), held, n0), (n1 - F.col("a"), n - held, n1), (n0 - F.col("b"), n - held, n0)):
        out += F.when(seen > 0, 2 * seen * F.log(seen * F.lit(n) / (col * F.lit(float(row))))).otherwise(F.lit(0.0))
    return out


def telling(rows: DataFrame) -> np.ndarray:
    """The kept buckets, sorted: at most MAX_TERMS of each kind, those of the largest G."""

    def best(counts: DataFrame, n1: int, n0: int, least: float) -> np.ndarray:
        if not n1 or not n0:
            return np.empty(0, np.int64)
        top = counts.filter(F.col("a") + F.col("b") >= MIN_TEXTS).withColumn("g", g_test(n1, n0)).filter(F.col("g") >= least)
        return np.array(sorted(r.bucket for r in top.orderBy(F.desc("g"), "bucket").limit(MAX_TERMS).select("bucket").collect()), np.int64)

    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    alone = best(bucket_counts(rows), n.get(1, 0), n.get(0, 0), MIN_G)
    if not len(alone):
        return alone
    held = {r.y: r.n for r in kept_terms(rows, alone).filter(F.octet_length("terms") > 0).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return np.union1d(alone, best(bucket_counts(rows, alone), held.get(1, 0), held.get(0, 0), MIN_PAIR_G))


def kept_terms(rows: DataFrame, kept: np.ndarray) -> DataFrame:
    """(id, y, terms): of each text the kept buckets it touches, as places in ``kept``, 32 bits each."""

    def run(batches):
        for b in batches:
            places = [np.searchsorted(kept, x[np.isin(x, kept, assume_unique=True)]).astype("<i4").tobytes() for x in map(terms, texts_of(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.binary())], names=["id", "y", "terms"])

    return rows.select("id", "y", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, y int, terms binary")


def fit(xs: list[np.ndarray], y: np.ndarray, kept: np.ndarray, epochs: int = 6, rate: float = 0.08, seed: int = 7) -> dict:
    """AdaGrad over the samples (places in ``kept``), one at a time, in a fixed shuffled order."""
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    rng = np.random.default_rng(seed)
    w0, w, v = np.log(y.mean() / (1 - y.mean())), np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), RANK))
    gw, gv, g0 = np.full(len(kept), 1e-2), np.full((len(kept), RANK), 1e-2), 1e-2
    decay_w, decay_v = 1e-5, 1e-4
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x = xs[i]
            vx = v[x]
            s = vx.sum(0)
            z = w0 + w[x].sum() + 0.5 * (s @ s - (vx * vx).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            if abs(g) < 1e-3:
                continue
            g0 += g * g
            w0 -= rate * g / np.sqrt(g0)
            dw = g + decay_w * w[x]
            gw[x] += dw * dw
            w[x] -= rate * dw / np.sqrt(gw[x])
            dv = g * (s - vx) + decay_v * vx
            gv[x] += dv * dv
            v[x] -= 0.25 * rate * dv / np.sqrt(gv[x])
    at = np.full(BUCKETS, -1, np.int32)
    at[kept] = np.arange(len(kept))
    return {"at": at, "w0": w0, "w": w, "v": v}


def train(docs: DataFrame, labels: DataFrame, admits, label="toxic", id_col="doc_id", text_col="text") -> dict:
    """Fit on a bounded sample; the intercept is shifted to the classes' shares among all labelled rows."""
    rows, n = labelled(docs, labels, label, admits, MAX_TEXTS, id_col, text_col)
    kept = telling(rows)
    own = saved(kept_terms(rows, kept), "kept-terms", few=True)
    parts = bounded(own, F.octet_length("terms") + 16, MAX_BYTES).orderBy("y", "o", "terms").select("y", "terms").collect()
    forget(own)
    forget(rows)
    got = np.array([r.y for r in parts], float)
    model = fit([np.frombuffer(r.terms, "<i4") for r in parts], got, kept)
    if "constant" not in model:
        model["w0"] += np.log(n[1] / n[0]) - np.log(got.sum() / (len(got) - got.sum()))
    return model


def raw_score(model: dict, text) -> float:
    if "constant" in model:
        return model["constant"]
    x = model["at"][terms(text)]
    x = x[x >= 0]
    vx = model["v"][x]
    s = vx.sum(0)
    z = model["w0"] + model["w"][x].sum() + 0.5 * (s @ s - (vx * vx).sum())
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity_scores(docs: DataFrame, model: dict, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score) for every row of ``docs``. The model has BUCKETS + 2 * MAX_TERMS * (RANK + 1) numbers at most."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        return lambda texts: [pa.array([raw_score(m, t) for t in texts], pa.float64())]

    return map_texts(docs, make, "score double", id_col, text_col)


def kept_rows(docs: DataFrame, model: dict, text_col="text") -> DataFrame:
    """The rows of ``docs``, whole, that the model scores below THRESHOLD."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        return lambda texts: [raw_score(m, t) < THRESHOLD for t in texts]

    return filter_texts(docs, make, text_col)


def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, lambda c: fold(c, 4) != 2)
    s = toxicity_scores(docs, model)
    return s.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
