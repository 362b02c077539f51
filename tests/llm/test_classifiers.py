"""Quality, toxicity and rules: held-out accuracy on planted texts, edge cases, defined results."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, rules, toxicity
from tidemark.llm.common import fold


def words(rng, n):
    return [rng.choice(["the", "river", "stone", "of", "and", "light", "over", "small", "house", "walk"]) + rng.choice(["", "", "er", "ing"]) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = random.Random(3), [], []
    for i in range(700):
        w = words(rng, rng.randrange(40, 200))
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            w = [x + rng.choice(["###", "$$$", "%%%"]) for x in w] if i % 8 else [w[0]] * len(w)
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["blarg", "snorfle", "quibbo"]))
        docs.append((i, " ".join(w), "x", "y"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, None, None), (1001, "", None, None), (1002, "word " * 200_000, None, None), (None, "the river", None, None), (5, docs[5][1], "x", "y")]
    labels += [(None, 1, 0), (2000, 0, 1), (7, None, None), (8, 9, 9)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, y string, score string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def held(scores, labels, label, mod, rest):
    s = scores.filter(fold("doc_id", mod) == rest).join(labels.filter(F.col(label).isin(0, 1)), "doc_id").select("score", label).collect()
    return [(r.score, r[label]) for r in s]


def test_quality(corpus):
    docs, labels = corpus
    model = quality.train(docs, labels, lambda c: fold(c, 5) != 0)
    s = quality.quality_scores(docs, model)
    rows = s.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    got = held(s, labels, "quality", 5, 0)
    assert sum((p >= quality.THRESHOLD) == (y == 1) for p, y in got) >= 0.95 * len(got)
    kept = quality.kept_rows(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert len({r.score for r in rows if r.doc_id == 5}) == 1


def test_quality_without_labels(spark, corpus):
    docs, labels = corpus
    assert quality.train(docs, labels.filter("false"), lambda c: F.lit(True)) == {"constant": 0.5}
    model = quality.train(docs.filter("false"), labels, lambda c: F.lit(True))
    assert quality.quality_scores(docs.filter("false"), model).count() == 0


def test_toxicity(corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels, lambda c: fold(c, 4) != 2)
    s = toxicity.toxicity_scores(docs, model)
    got = held(s, labels, "toxic", 4, 2)
    assert sum((p >= toxicity.THRESHOLD) == (y == 1) for p, y in got) >= 0.95 * len(got)
    assert len(s.collect()) == docs.count() and toxicity.kept_rows(docs, model).columns == docs.columns
    assert toxicity.train(docs, labels.filter("false"), lambda c: F.lit(True)) == {"constant": 0.0}


def fitted(spark, rows):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, lambda c: F.lit(True))
    return model, lambda t: toxicity.raw_score(model, t)


def test_factorization_learns_pairs(spark):
    """Neither term is toxic alone; together they are."""
    rng, rows = random.Random(1), []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join(["aaa"] * a + ["bbb"] * b + [f"n{rng.randrange(40)}" for _ in range(5)]), int(a and b)))
    _, one = fitted(spark, rows)
    assert one("aaa bbb") > 0.5 > max(one("aaa"), one("bbb"), one("n1"))


def test_factorization_learns_a_term_that_tells_nothing_alone(spark):
    """A group's name is as common in clean texts as in toxic ones; only beside the insult it tells."""
    rng, rows = random.Random(2), []
    for _ in range(4000):
        insult = rng.random() < 0.4
        toxic = insult and rng.random() < 0.5
        names = [rng.choice(["zorg", "yarl"])] if toxic else ["zorg"] * (not insult and rng.random() < 2 / 3)
        rows.append((" ".join(["wretch"] * insult + names + [f"n{rng.randrange(60)}" for _ in range(6)]), int(toxic)))
    share = lambda label: sum("zorg" in t for t, y in rows if y == label) / sum(y == label for _, y in rows)
    assert abs(share(1) - share(0)) < 0.04
    _, one = fitted(spark, rows)
    assert one("wretch zorg n1 n2") > 0.6 and one("zorg n1 n2") < 0.3 and one("wretch n1 n2") < 0.3


def brute_stats(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, repeat = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeat |= {j for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def test_stats_match_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n\t", "é ü \x1c a", "a b c d e f g h " * 3, "x\nx\n\n \n \nx"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) + rng.choice(["", "\n#a|\n#a|", "\r\n"]) for _ in range(60)]
    for t in texts:
        assert rules.stats(t)[:5] == brute_stats(t), repr(t)


def test_rules(corpus):
    docs, labels = corpus
    found = rules.train(docs, labels, lambda c: fold(c, 5) != 0)
    assert found and all(r["precision"] >= 0.9 for r in found)
    out = rules.apply_rules(docs, found)
    got = out.filter(fold("doc_id", 5) == 0).join(labels.filter("quality IN (0, 1)"), "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got)
    empty = {r.doc_id: r for r in out.filter("doc_id IN (1000, 1001)").collect()}
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in empty.values())
    assert rules.train(docs, labels.filter("false")) == []
    assert rules.apply_rules(docs.filter("false"), []).count() == 0


def test_calibration_does_not_depend_on_order():
    """The same samples in 60 orders and splits, separable ones among them, give one held-out ranking."""
    import numpy as np

    rng = np.random.default_rng(5)
    y = (rng.random(900) < 0.7).astype(float)
    for noise in (0.02, 0.3):
        f = np.column_stack([0.4 * (y - 0.5) + rng.normal(0, noise, 900), rng.normal(-0.8, 0.3, 900) - 0.9 * (1 - y)])
        first = None
        for seed in range(30):
            o = np.random.default_rng(seed).permutation(900)
            w = quality.logistic(quality.design(f[o]), y[o])
            first = w if first is None else first
            assert np.abs(w).max() < 1e3 and np.allclose(w, first, rtol=1e-3, atol=1e-3)
            z = quality.design(f) @ w
            assert (z[y == 1][:, None] > z[y == 0]).mean() > 0.9


def test_quality_of_many_orders():
    """Whole fits on 30 orders of one labelled sample: each finds the held-out texts as well as the others."""
    import numpy as np

    rng = random.Random(8)
    make = lambda bad: " ".join(w + ("#$%"[rng.randrange(3)] * 2 if bad and rng.random() < 0.3 else "") for w in words(rng, rng.randrange(20, 120)))
    good, bad, held_good, held_bad = ([make(k) for _ in range(n)] for k, n in ((False, 120), (True, 60), (False, 60), (True, 60)))
    found = []
    for seed in range(30):
        r = random.Random(seed)
        r.shuffle(good)
        r.shuffle(bad)
        score = quality.scorer(quality.calibrate(quality.fit(good, bad), 2 / 3))
        a, b = score(held_good), score(held_bad)
        found.append(float(np.mean(a[:, None] > b)))
    assert max(found) - min(found) <= 0.02 and min(found) > 0.95


def test_sample_passes_over_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_BYTES", 100)
    rows = spark.createDataFrame([(k, "x" * (1000 if k < 5 else 10), 1) for k in range(12)], "id long, text string, y int")
    assert [len(t) for t in quality.sample(rows, 1)] == [10] * 7
    assert quality.sample(rows.filter("id < 5"), 1) == [] == quality.sample(rows, 0)
