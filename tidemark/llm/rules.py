"""Quality rules: base statistics of whole texts and a learned decision list.

Sequential covering: rules that find bad texts are learned one at a time. A rule grows, condition by
condition (statistic <= or > threshold), by the gain of FOIL on two thirds of the still uncovered rows,
and is pruned from its end on the other third; it joins the list when it is precise enough there, and the
rows it covers go. The list is an ordered CASE expression of Spark columns, so that applying it runs in
the JVM and people can read and edit it.

Cases: a null text has no words, lines or symbols; ratios of an empty text are 0 and base_failed is true
(fewer than 20 words). Texts are read whole, whatever their length. Repeated rows get equal results.
Without labels of both classes the list is empty and only the base rule decides. Extra columns of the
inputs are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, hash_words, map_texts, plain_words, rolling, table, utf8
from .quality import labelled

#: Bound of the fit: that many labelled rows of each class, first by a hash of the id.
MAX_ROWS = 10_000
WINDOW = 8
MIN_WORDS = 20
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct_words"]
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUATION = bytes(range(0x80, 0xC0))
SPACE = b" \t\n\r\x0b\x0c"


def stats(text) -> tuple[int, ...]:
    """The STATS of one text."""
    b = utf8(text)
    words = plain_words(text)
    n = len(words)
    lines = [x for x in b.split(b"\n") if x.strip(SPACE)]
    repeat = 0
    if n > WINDOW:
        g = rolling(hash_words(words), WINDOW)
        _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
        often = count[inverse] > 1
        if often.any():
            mark = np.zeros(n + 1, np.int64)
            mark[: len(g)] += often
            mark[WINDOW : WINDOW + len(g)] -= often
            repeat = int((np.cumsum(mark[:n]) > 0).sum())
    chars = len(b.translate(None, SPACE + CONTINUATION))
    return n, chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(b) - len(b.translate(None, UPPER)), len(set(words))


def text_stats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, the STATS as long) for every row."""

    def of(texts):
        rows = np.array([stats(t) for t in texts], np.int64).reshape(-1, len(STATS))
        return [pa.array(rows[:, k]) for k in range(len(STATS))]

    return map_texts(docs, lambda: of, ", ".join(f"{c} long" for c in STATS), id_col, text_col)


#: Features the rules test: a name, and the STATS whose ratio it is (None: the first as it is).
FEATURES = {
    "symbol_ratio": ("n_symbols", "n_words"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "dup_lines_ratio": ("n_dup_lines", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "distinct_ratio": ("n_distinct_words", "n_words"),
    "mean_word": ("word_chars", "n_words"),
    "words": ("n_words", None),
}


def feature(num: str, den: str | None) -> Column:
    value = F.col(num).cast("double")
    return value if den is None else F.when(F.col(den) > 0, value / F.col(den)).otherwise(F.lit(0.0))


def with_features(s: DataFrame) -> DataFrame:
    return s.withColumns({name: feature(*parts) for name, parts in FEATURES.items()})


def grow(x: np.ndarray, bad: np.ndarray, weight: np.ndarray, limit: int = 4) -> list[tuple[int, bool, float]]:
    """Conditions (feature, greater, threshold), each chosen by the gain of FOIL over what the others cover."""
    rule, live = [], np.ones(len(x), bool)
    for _ in range(limit):
        p, n = weight[live & bad].sum(), weight[live & ~bad].sum()
        if not n or not p:
            break
        base, best = np.log2(p / (p + n)), (1e-6, None)
        for f in range(x.shape[1]):
            v = x[live, f]
            order = np.argsort(v, kind="stable")
            v, b, w = v[order], bad[live][order], weight[live][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            cp, cn = np.cumsum(w * b)[cut], np.cumsum(w * ~b)[cut]
            for greater, pp, nn in ((False, cp, cn), (True, p - cp, n - cn)):
                gain = pp * (np.log2(np.maximum(pp, 1e-12) / np.maximum(pp + nn, 1e-12)) - base)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, greater, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= covered(x, rule[-1:])
    return rule


def covered(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, t in rule:
        out &= x[:, f] > t if greater else x[:, f] <= t
    return out


def learn(x: np.ndarray, bad: np.ndarray, min_precision: float = 0.9, max_rules: int = 12, seed: int = 3) -> list[dict]:
    """The decision list: rules {conditions, covered, precision} on the rows given, in order."""
    order = np.random.default_rng(seed).permutation(len(x))
    x, bad = x[order], bad[order]
    left, rules = np.ones(len(x), bool), []
    held = np.arange(len(x)) % 3 == 2
    floor = max(5, 0.005 * bad.sum())
    while len(rules) < max_rules and (left & bad & ~held).sum() >= floor and (left & bad & held).sum():
        g, h = left & ~held, left & held
        rule = grow(x[g], bad[g], np.ones(g.sum()))

        def worth(r):
            c = covered(x[h], r)
            return (bad[h][c].sum() - (~bad[h][c]).sum()) / max(1, c.sum()) if c.sum() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = covered(x, rule) & left if rule else np.zeros(len(x), bool)
        precision = bad[c].mean() if c.any() else 0
        if precision < min_precision or c.sum() < floor:
            break
        rules.append({"conditions": rule, "covered": int(c.sum()), "precision": float(precision)})
        left &= ~c
    return rules


def train(docs: DataFrame, labels: DataFrame, admits=lambda c: F.lit(True), label="quality", id_col="doc_id", text_col="text") -> list[dict]:
    some, _ = labelled(docs, labels, label, admits, MAX_ROWS, id_col, text_col)
    s = with_features(text_stats(some, "id")).withColumnRenamed("doc_id", "id").join(some.select("id", "y"), "id")
    rows = s.select("id", "y", *FEATURES).orderBy("id").toPandas()
    return learn(rows[list(FEATURES)].to_numpy(float), (rows["y"] == 0).to_numpy())


def expression(rules: list[dict]) -> Column:
    """Index of the first rule that holds, null if none does: an ordered chain of CASE WHEN."""
    names, out = list(FEATURES), None
    for k, r in enumerate(rules):
        test = F.lit(True)
        for f, greater, t in r["conditions"]:
            test &= F.col(names[f]) > F.lit(t) if greater else F.col(names[f]) <= F.lit(t)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: list[dict], id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, STATS, rule, base_failed, kept): ``rule`` is the rule that fired, null where none did."""
    s = with_features(text_stats(docs, id_col, text_col)).withColumn("rule", expression(rules)).withColumn("base_failed", base_failed())
    return s.select("doc_id", *STATS, "rule", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def op7_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = train(docs, labels, lambda c: fold(c, 5) != 0)
    return apply_rules(docs, rules).select("doc_id", *STATS[:5], "base_failed", "kept", "rule")
