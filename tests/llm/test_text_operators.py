"""Decontamination, packing, token counts, near duplicates, licenses, scoring: against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, licenses, lm, near, packing, tokens
from tidemark.llm.common import fold

SCHEMA = "doc_id long, text string, n_words string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


LOW = {i: i + 32 for i in range(65, 91)}


def lower(t):
    return (t or "").translate(LOW)


# --- decontamination


@pytest.fixture(scope="module")
def contamination():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 5, 12, 13, 14, 20, 40]))) for k in range(25)] + [(30, None), (31, ""), (None, "w1 w2"), (3, "Also, item THREE!")]
    docs = [(k, text(rng.randrange(120))) for k in range(60)]
    for k in range(60, 110):
        w = rng.choice(items[:25])[1].split()
        a = rng.randrange(len(w))
        docs.append((k, text(rng.randrange(30)) + " " + rng.choice([", ", "-", "\n"]).join(x.upper() for x in w[a:] + w[:a]) + " " + text(rng.randrange(30))))
    return docs + [(200, None), (201, ""), (202, "ALSO item-three"), (None, "w1 w2"), (60, docs[60][1])], items


@pytest.mark.parametrize("bits", [decontaminate.FILTER_BITS, (64, 64)])
def test_decontamination(spark, contamination, monkeypatch, bits):
    """Also with a filter so small that it admits almost all fingerprints."""
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    docs, items = contamination
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for name, t in items:
        w = word.findall(lower(t))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).update([] if name is None else [str(name)])
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    bad = next(t for k, t in items if k is not None and len((t or "").split()) == 40)
    docs = docs + [(None, bad), (None, "clean"), (700, bad), (700, "clean too"), (701, bad)]
    got = decontaminate.decontaminate(frame(spark, docs), bench).collect()
    seen = Counter()
    want, clean = Counter(), Counter()
    for i, t in docs:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        verdict = bool(hit) and 20 * len(hit) >= len(w)
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), verdict] += 1
        clean[i, t] += not verdict
    for r in got:
        seen[r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated] += 1
        assert sum(b - a for a, b in r.spans) == r.n_hit and len(r["items"]) == r.n_items
    assert seen == want
    d = frame(spark, docs).withColumns({"spans": F.array(F.lit("x")), "t1": F.lit(7)})
    kept = decontaminate.kept_rows(d, bench)
    assert kept.columns == d.columns and {(tuple(r.spans), r.t1) for r in kept.collect()} == {(("x",), 7)}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == +clean


def test_decontamination_plan_does_not_grow_with_the_benchmark(spark):
    """The same steps for one item as for a benchmark of many."""
    docs = frame(spark, [(k, f"a{k} b c d") for k in range(20)])
    plans = []
    for n in (1, 3000):
        bench = spark.createDataFrame([(k, " ".join(f"i{k}x{j}" for j in range(40))) for k in range(n)], "item_id long, text string")
        plan = decontaminate.decontaminate(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
        plans.append((plan.count("MapInArrow"), plan.count("Join")))
    assert plans[0] == plans[1] == (1, 2)


def test_decontamination_empty(spark):
    docs = frame(spark, [(1, "a b")])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.decontaminate(docs, bench).collect()] == [0]
    assert decontaminate.decontaminate(docs.filter("false"), bench).count() == 0
    assert decontaminate.kept_rows(docs, bench).collect() == docs.collect() and decontaminate.kept_rows(docs.filter("false"), bench).count() == 0


# --- tokens and packing

TEXTS = [
    (1, "Hello world, it's  we'll\n\n see 12 34"), (2, None), (3, ""), (4, "a" * 50), (5, "word " * 6000), (6, "naïve ☃ 日本 \x1c x　y"),
    (7, "<|endoftext|> is text"), (8, " lead"), (9, "trail  "), (10, "x\t\ty \n z"), (1, "Hello world, it's  we'll\n\n see 12 34"), (None, "no id"),
]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_tokenizers(ids):
    rng = random.Random(9)
    pool = "aB1 \n\t.,'#<|>éß☃̀\u0085  "
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(400)]
    got = tokens.Encoder()(texts)
    assert all(np.frombuffer(g, "<u4").tolist() == ids(t)[:-1] for g, t in zip(got, texts))


@pytest.mark.parametrize("blank", [" ", "\n", "\u00a0", " \n"])
def test_encoder_takes_long_blank_runs(ids, blank):
    texts = ["a" + blank * (n // len(blank)) + end for n in (tokens.LONG_RUN - 2, tokens.LONG_RUN, 1_100_000) for end in ("", "b")]
    encode = tokens.Encoder()
    assert encode.fast is not None
    assert all(np.frombuffer(encode.one(t), "<u4").tolist() == ids(t)[:-1] for t in texts)


def test_packing_round_trip(spark, ids):
    rng = random.Random(8)
    rows = TEXTS + [(100 + i, " ".join(rng.choice(["alpha", "be", "gamma", "delta!"]) for _ in range(rng.randrange(1, 900)))) for i in range(150)]
    out = packing.pack(frame(spark, rows)).toPandas()
    want = Counter()
    for i, t in rows:
        x = ids(t)
        for a in range(0, len(x), 2048):
            p = np.array(x[a : a + 2048], "<u4")
            want[i, a, len(p), zlib.crc32(p.tobytes()), len(x)] += 1
    got = Counter((None if i != i else int(i), a, n, c, d) for i, a, n, c, d in out[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False))
    assert got == want
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.offset == out.groupby("sequence_id").length.cumsum() - out.length).all()
    total = out.groupby("sequence_id").length.sum()
    assert total.max() <= 2048 and len(total) <= total.sum() / 2048 * 1.02 + 2
    assert packing.pack(frame(spark, rows).filter("false")).count() == 0


def test_cutting_stock_holds_all_pieces():
    rng = random.Random(5)
    need = {g: rng.randrange(1, 60) for g in rng.sample(range(1, 257), 90)}
    found = packing.cutting_stock(need, 256)
    held = Counter()
    for pattern, times in found:
        assert sum(g * k for g, k in pattern.items()) <= 256
        for g, k in pattern.items():
            held[g] += k * times
    assert held == need
    g = np.array(sorted(need))
    least = packing.linear_program(g, np.array([need[x] for x in g.tolist()], float), 256)[1].sum()
    assert sum(t for _, t in found) <= least * 1.01 + 3
    assert packing.cutting_stock({}, 256) == []


def test_length_histogram(spark, ids):
    lengths = [len(ids(t)) for _, t in TEXTS]
    h = tokens.length_histogram(tokens.token_lengths(frame(spark, TEXTS)))
    rows = h.collect()
    assert sum(r.n_docs for r in rows) == len(TEXTS)
    for r in rows:
        assert r.docs_at_least == sum(x >= r.length for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= r.length)
        assert r.docs_at_most == sum(x <= r.length for x in lengths) and r.truncated_tokens == sum(min(x, r.length) for x in lengths)
    assert tokens.truncated_total(h, 7).first()[0] == sum(min(x, 7) for x in lengths)
    assert tokens.quantile(h, 0.5).first()[0] == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert tokens.length_histogram(tokens.token_lengths(frame(spark, []).filter("false"))).count() == 0


# --- near duplicates


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, root = [(i, shingles(t)) for i, t in rows], {}
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                at[find(a)] = find(b)
    for k, (i, _) in enumerate(sets):
        r = find(k)
        if i is not None:
            root[r] = min(root.get(r, i), i)
    return Counter((i, len(s), root.get(find(k), i)) for k, (i, s) in enumerate(sets))


def near_rows(seed, groups):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20, 40, 120]))]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w))
                if len(w) > 1:
                    w[i : i + 1] = rng.choice([[], [f"x{rng.randrange(50)}"], [w[i], f"y{rng.randrange(50)}"]])
            out.append((len(out), rng.choice([" ", "\n", " \t"]).join(w).upper()))
    return out


def test_near_duplicates(spark):
    rows = near_rows(1, 45) + [(5000, None), (5001, ""), (5002, " \n"), (None, "a b c d e f"), (5003, "a b c d e f"), (3, "again the same id")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_components(rows)
    assert near.near_duplicates(frame(spark, rows).filter("false")).count() == 0


def test_near_duplicates_with_few_names_and_two_hops(spark, monkeypatch):
    """Class names of 6 bits, so that most collide; blocks dealt by way of groups; lists over several places."""
    monkeypatch.setattr(near, "LONG", 3)
    rows = near_rows(2, 40) + [(5000, None), (None, "a b c d e f"), (5003, "a b c d e f")]
    got = near.near_duplicates(frame(spark, rows).repartition(5), bits=6, fanout=3, part_shingles=400)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_blocks_fan_out_within_bounds():
    """A block makes no more than ``fanout`` rows of 10,000 parts, and both hops keep every shingle."""
    rng = np.random.default_rng(3)
    names, sizes = np.arange(50, dtype=np.int64), np.full(50, 400, np.int32)
    owner, s = np.repeat(np.arange(50), 400), rng.integers(0, 1 << 48, 20_000).astype(np.uint64)
    d = near.Dealing(10_000, 128)
    first = d.first(names, sizes, owner, s)
    assert len(first) <= 128 and d.parts == 10_112 and first.part.max() < d.parts
    n, z, o, t, _ = near.unpacked(first)
    assert sorted(zip(n[o].tolist(), t.tolist())) == sorted(zip(owner.tolist(), s.tolist())) and set(z.tolist()) == {400}
    group = near.Dealing.part(d, n, o, t) // 128
    assert (np.repeat(first.part.to_numpy() // 128, [sum(np.frombuffer(x, np.int32)) for x in first.counts]) == group).all()


def test_frequent_shingles_are_found(spark):
    """A passage in 1 % of the documents, spread evenly, is heavy: its shingles are dealt by set."""
    passage = " ".join(f"p{i}" for i in range(9))
    own = "array_join(transform(sequence(1, 12), i -> concat('q', pmod(xxhash64(id, i), 10000000))), ' ')"
    docs = spark.range(0, 40_000, 1, 4).selectExpr("id AS doc_id", f"concat({own}, if(id % 100 = 0, ' {passage}', '')) AS text")
    heavy = near.heavy_shingles(near.classes(docs))
    planted = near.shingle_sets([passage])[0]
    assert set((planted & near.MASK).tolist()) == set(heavy.tolist())
    # dealt by set, the 400 sets that hold one such shingle go to many parts
    names = np.arange(400, dtype=np.int64)
    d = near.Dealing(50, near.FANOUT, spark.sparkContext.broadcast(heavy))
    assert np.bincount(d.part(names, np.arange(400), np.full(400, planted[0]))).max() < 30


def test_near_duplicates_in_one_large_group(spark):
    """Copies at all distances of one text: many pairs miss the threshold, chains of links join them."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(500 + k, " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) + " " + passage) for k in range(60)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_boundary_follows_cost():
    assert near.boundary({3: 1000, 400: 5}) > 0
    assert near.boundary({}) == 0
    for n in range(1, 11):
        for b, c in near.subset_keys(n):
            assert n <= b and c == math.ceil(0.8 * b - 1e-9) <= n


# --- licenses


def brute_licenses(rows):
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    out = {}
    for i, t in rows:
        g = grams(split(t))
        names = sorted({n for n, text in licenses.TEMPLATES if 5 * len(grams(split(text)) & g) >= 4 * len(grams(split(text)))})
        if names:
            out[i] = ",".join(names)
    return out


def test_licenses(spark):
    rng, rows = random.Random(11), [(900, None), (901, ""), (902, "MIT"), (903, "License " * 50)]
    filler = lambda n: " ".join(f"z{rng.randrange(999)}" for _ in range(n))
    for k in range(150):
        name, text = rng.choice(licenses.TEMPLATES)
        w = text.split()
        if k % 5 == 0:
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, f"{filler(rng.randrange(90))} {' '.join(w)} {filler(rng.randrange(90))}"))
    rows += [(300 + k, filler(200)) for k in range(30)]
    got = {r.doc_id: r.licenses for r in licenses.license_lists(frame(spark, rows)).collect()}
    want = brute_licenses(rows)
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.98 * len(want)
    assert licenses.license_lists(frame(spark, rows).filter("false")).count() == 0


def test_licenses_by_row(spark):
    mit, bsd = "Released under the MIT License.", licenses.TEMPLATES[2][1]
    rows = [(None, mit), (None, bsd), (5, mit), (5, bsd), (5, "neither"), (None, None), (6, mit + " " + bsd), (6, mit + " " + bsd)]
    got = Counter((r.doc_id, r.licenses) for r in licenses.license_lists(frame(spark, rows)).collect())
    assert got == {(None, "mit"): 1, (None, "bsd"): 1, (5, "mit"): 1, (5, "bsd"): 1, (6, "bsd,mit"): 2}
    found = licenses.license_matches(frame(spark, rows))
    assert found.columns == ["doc_id", "license", "template", "contained"] and found.count() == 8


# --- language model


def lm_rows():
    rng = random.Random(12)
    base = [f"v{i}" for i in range(300)]
    chain = lambda n: " ".join(base[(s + i) % 300] for s in [rng.randrange(300)] for i in range(n))
    rows = [(k, chain(rng.randrange(5, 80)) if k % 2 else " ".join(rng.choice(base) for _ in range(50)).upper()) for k in range(300)]
    return rows + [(500, None), (501, ""), (502, "never seen words"), (None, "v1 v2"), (None, "v1 v2"), (4, rows[4][1]), (503, "v1"), (1, rows[4][1])]


def brute_lm(rows):
    """Per row (id, tokens, known, N, base, score), by the interpolated probabilities in closed form."""
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]
    train = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1
    c, context = Counter(), Counter()
    for i, t in rows:
        if train(i):
            w = ["<start>", *toks(t)]
            for j in range(1, len(w)):
                for size in (1, 2, 3):
                    if j - size + 1 >= 0:
                        c[tuple(w[j - size + 1 : j + 1])] += 1
                        context[tuple(w[j - size + 1 : j])] += 1
    n, v = context[()], sum(len(k) == 1 for k in c)

    def p(h, w):
        if not h:
            return (c[w,] + 0.5) / (n + 0.5 * (v + 1))
        mu = lm.MU[len(h) + 1]
        return (c[(*h, w)] + mu * p(h[1:], w)) / (context[h] + mu)

    out = Counter()
    for i, t in rows:
        w = ["<start>", *toks(t)]
        score = sum(math.log10(p(tuple(w[max(0, j - 2) : j]), w[j])) for j in range(1, len(w)))
        known = sum(c[x,] > 0 for x in w[1:])
        out[i, len(w) - 1, known, n, round(sum(math.log10(p((), x)) for x in w[1:]), 6), round(score, 6)] += 1
    return out, p, [k[0] for k in c if len(k) == 1], context


@pytest.mark.parametrize("docs, grams", [(lm.BLOCK_DOCS, lm.PART_GRAMS), (40, 500)])
def test_lm_scores(spark, monkeypatch, docs, grams):
    """Against brute force, in one block and in many blocks and parts."""
    monkeypatch.setattr(lm, "BLOCK_DOCS", docs)
    monkeypatch.setattr(lm, "PART_GRAMS", grams)
    rows = lm_rows()
    got = lm.lm_scores(frame(spark, rows), fold("doc_id", 5) != 1).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == brute_lm(rows)[0]
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in held if r.doc_id % 2) > 0.8 * sum(r.base_score for r in held if r.doc_id % 2)
    assert sum(r.score for r in held if not r.doc_id % 2) > 1.02 * sum(r.base_score for r in held if not r.doc_id % 2)


def test_lm_edges(spark):
    rows = lm_rows()
    assert lm.lm_scores(frame(spark, rows).filter("false"), F.lit(True)).count() == 0
    assert all(r.n_known == 0 and abs(r.score - r.base_score) < 1e-9 for r in lm.lm_scores(frame(spark, rows), F.lit(False)).collect())


def test_lm_probabilities_sum_to_one():
    """Over all next tokens, from states of two, one and no words, by the automaton's weights."""
    _, p, words, context = brute_lm(lm_rows())
    for h in [h for h in context if len(h) == 2][:20] + [(w,) for w in words[:5]] + [(), ("unmet", "pair")]:
        assert abs(sum(p(h, w) for w in words) + p(h, "unmet") - 1) < 1e-9
    # the same weights, read by the automaton: a text of three tokens whose last one varies
    c1, c2, c3 = {"a": 3, "b": 2, "$": 2}, {("b", "a"): 1, ("b", "$"): 1}, {("a", "b", "$"): 1, ("a", "b", "a"): 1}
    n, v, total = 7, 3, 0.0
    head = lambda m: m.read(0, 2)
    for w in ["a", "b", "$", "?"]:
        c = {1: np.array([3.0, 2, c1.get(w, 0)]), 2: np.array([1.0, 2, c2.get(("b", w), 0)]), 3: np.array([0.0, 1, c3.get(("a", "b", w), 0)])}
        m = lm.Automaton(c, np.array([0]), 2, (c[1] + 0.5) / (n + 0.5 * (v + 1)))
        total += 10 ** (m.read(0, 3) - head(m))
    assert abs(total - 1) < 1e-9


def test_lm_keys_and_counts_pack():
    rng = np.random.default_rng(1)
    for n in (1, 2, 500):
        k = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (lm.unpack_keys(lm.pack_keys(k)) == k).all()
    for top in (1, 255, 256, 1 << 33):
        assert lm.unpack_counts(lm.pack_counts(np.array([0, top]))).tolist() == [0, top]
    assert lm.edges(1).tolist() == [0] and lm.edges(4).tolist() == [0, 1 << 62, 2 << 62, 3 << 62]
