"""Quality from compression: zstandard dictionaries of good and of bad text.

A text like the good sample compresses better with the good dictionary, and the other way round. The
difference of the two compressed sizes, normalised by the size without a dictionary, and the normalised
difference between raw and compressed size (text that repeats itself shrinks without any dictionary)
enter a logistic calibration. The calibration is fitted on texts whose dictionaries never saw them: the
sample is cut in two halves, each scored with dictionaries of the other half.

Cases: null and empty texts have no bytes; their features are 0 and they get the calibrated score of
that point. Very long texts are compressed whole. Repeated rows get equal scores. Unlabelled classes:
with fewer than four good or bad labelled texts the score is the share of good ones (0.5 without any). Labels other
than 0 and 1, null labels and repeated label rows: only 0/1 count, a doc_id takes its largest label.
Extra columns of the inputs are ignored.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, fold, forget, map_texts, saved, stable_order, table, utf8

#: Bound of the fit: that many labelled texts of each class, first by a hash of the id, and of these as
#: many whole texts as fit the bytes (a longer one is passed over). Scoring covers all rows.
MAX_TEXTS = 3000
MAX_BYTES = 24_000_000
DICT_BYTES = 112_640
LEVEL = 3
#: A document is kept at this score; a wrongly lost clean text costs more than a kept bad one.
THRESHOLD = 0.3


def labelled(docs: DataFrame, labels: DataFrame, label: str, admits, bound: int, id_col="doc_id", text_col="text"):
    """A table (id, text, y) of at most ``bound`` documents of each class, and the classes' sizes.

    The labels alone choose the ids: of those that ``admits`` (a condition on the id column), each class's
    first by a hash of the id. At most 2 * bound ids are sent to the scan of the documents, so that no
    text is shuffled; repeated documents of one id count once.
    """
    y = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y")).filter(admits("id"))
    sizes = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    firsts = [y.filter(F.col("y") == v).orderBy(stable_order("id"), "id").limit(bound) for v in (0, 1)]
    chosen = F.broadcast(firsts[0].unionByName(firsts[1]))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return saved(d.join(chosen, "id").groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y")), "labelled"), sizes


def bounded(rows: DataFrame, size, max_bytes: int) -> DataFrame:
    """Whole rows in the order of a hash of their id (column ``o``), as many as fit ``max_bytes``; a row
    that does not fit is passed over, and smaller ones after it still count. ``size`` is a row's bytes."""
    r = rows.withColumn("o", stable_order("id"))
    total, last, over = 0, None, []
    for k in r.select("o", size.alias("b")).orderBy("o", "b").collect():
        if total + k.b > max_bytes:
            over.append(k.o)
        else:
            total, last = total + k.b, k.o
    if last is None:
        return r.filter(F.lit(False))
    return r.filter((F.col("o") <= last) & ~F.col("o").isin([o for o in over if o <= last]))


def sample(rows: DataFrame, y: int) -> list[str]:
    """The bounded sample of one class's texts."""
    some = bounded(rows.filter(F.col("y") == y), F.octet_length("text"), MAX_BYTES)
    return [x.text for x in some.orderBy("o", "text").select("text").collect()]


def train_dict(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves as raw content when they are too few to train on."""
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts, k=400, d=8, f=20, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICT_BYTES:]


class Sizes:
    """Compressed sizes of a text: with the good dictionary, with the bad one, with none."""

    def __init__(self, good: bytes, bad: bytes):
        def one(raw):
            if not raw:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

        self.all = [one(good), one(bad), one(b"")]

    def features(self, text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        g, b, c = (len(z.compress(text)) for z in self.all)
        return (b - g) / c, np.log(c / (len(text) + 16))


def design(f: np.ndarray) -> np.ndarray:
    d, r = np.clip(f[:, 0], -1, 1), np.clip(f[:, 1], -5, 1)
    return np.column_stack([np.ones(len(f)), d, r, d * r, d * d, np.maximum(0, -0.9 - r)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Newton's method, each step halved until the penalised loss falls. The loss is convex, so this ends
    at its one minimum in whatever order the rows come; an end elsewhere is an error."""
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + keep @ (w * w) / 2
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + keep * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(keep), slope)
        if slope @ step < 1e-10 * len(y):
            return w
        size = 1.0
        while (then := loss(w - size * step)) > now - 1e-4 * size * (slope @ step):
            size /= 2
            if size < 1e-9:
                raise ArithmeticError("the calibration found no step that lowers its loss")
        w, now = w - size * step, then
    raise ArithmeticError("the calibration did not converge")


def fit(good: list[str], bad: list[str]) -> dict:
    """Dictionaries and calibration; a plain dict of bytes and numbers, of bounded size."""
    g, b = [utf8(t) for t in good], [utf8(t) for t in bad]
    if min(len(g), len(b)) < 4:
        return {"constant": len(g) / (len(g) + len(b)) if g or b else 0.5}
    f, y = [], []
    for half in (0, 1):
        s = Sizes(train_dict(g[1 - half :: 2]), train_dict(b[1 - half :: 2]))
        for texts, label in ((g[half::2], 1), (b[half::2], 0)):
            f += [s.features(t) for t in texts]
            y += [label] * len(texts)
    return {"good": train_dict(g), "bad": train_dict(b), "w": (np.array(f), np.array(y, float))}


def calibrate(model: dict, share_good: float) -> dict:
    """Fit the logistic weights, weighting the two classes to their shares among all labelled rows."""
    if "constant" in model:
        return model
    f, y = model.pop("w")
    w = logistic(design(f), y)
    n1, n0 = y.sum(), len(y) - y.sum()
    w[0] += np.log(share_good / (1 - share_good)) - np.log(n1 / n0)
    return model | {"w": w}


def train(docs: DataFrame, labels: DataFrame, admits, label="quality", id_col="doc_id", text_col="text") -> dict:
    rows, n = labelled(docs, labels, label, admits, MAX_TEXTS, id_col, text_col)
    model = fit(sample(rows, 1), sample(rows, 0))
    forget(rows)
    return calibrate(model, n[1] / (n[0] + n[1])) if n.get(0) and n.get(1) else model


def scorer(model: dict):
    """Function of texts: their scores, 0 to 1."""
    state = {}

    def score(texts) -> np.ndarray:
        if "constant" in model:
            return np.full(len(texts), float(model["constant"]))
        if not state:
            state["s"] = Sizes(model["good"], model["bad"])
        f = np.array([state["s"].features(utf8(t)) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(design(f) @ model["w"], -30, 30)))

    return score


def quality_scores(docs: DataFrame, model: dict, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""

    def make():
        score = scorer(model)
        return lambda texts: [pa.array(score(texts))]

    return map_texts(docs, make, "score double", id_col, text_col)


def kept_rows(docs: DataFrame, model: dict, text_col="text") -> DataFrame:
    """The rows of ``docs``, whole, that the model scores THRESHOLD or more."""

    def make():
        score = scorer(model)
        return lambda texts: score(texts) >= THRESHOLD

    return filter_texts(docs, make, text_col)


def op1_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, lambda c: fold(c, 5) != 0)
    s = quality_scores(docs, model)
    return s.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
