"""Chat formatting: round trips and templates that rewrite history; the pipeline end to end."""

import os
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, quality, registry, tokens, toxicity
from tidemark.llm.common import fold

turns = st.lists(st.tuples(st.text(max_size=12), st.text(alphabet="ab\\<|>turnclosebody/ \n", max_size=40)), max_size=6)


@given(turns)
@settings(max_examples=300, deadline=None)
def test_round_trip(ts):
    assert chat.read_back(chat.marked(ts)) == ts
    r = chat.render(ts)
    assert r["text"] == chat.marked(ts) and not r["rewrites"] and [chat.read_back(r["text"][a:b]) for a, b in r["spans"]] == [[t] for t in ts]
    assert [chat.unescape(r["text"][a:b]) for a, b in r["loss"]] == [t for role, t in ts if role == "assistant"]


def test_texts_full_of_controls():
    ts = [("user", chat.TURN + chat.BODY), ("assistant", chat.CLOSE + "\n" + chat.TURN + "user" + chat.BODY + "\\" + chat.CLOSE), ("assistant", "")]
    assert chat.read_back(chat.marked(ts)) == ts
    assert [chat.unescape(chat.marked(ts)[a:b]) for a, b in chat.render(ts)["loss"]] == [ts[1][1], ""]


def test_rewriting_template_is_detected():
    last_only = lambda ts: f"{len(ts)} turns: " + "|".join(t for _, t in ts)
    assert chat.render([("user", "a"), ("assistant", "b")], last_only)["rewrites"]
    plain = lambda ts: "".join(f"[{r}]{t}\n" for r, t in ts)
    r = chat.render([("user", "a"), ("assistant", "bcb")], plain)
    assert not r["rewrites"] and [r["text"][a:b] for a, b in r["loss"]] == ["bcb"]


def test_format_chats(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, None, None, 0), (None, 0, "user", "x", 0), (1, 1, "assistant", "b", 0)]
    rows += [(9, k, "user" if k % 2 else "assistant", f"t{k}", 0) for k in range(300)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")
    got = {r.conv_id: chat.read_back(r.text) for r in chat.format_chats(d).collect()}
    assert got.pop(9) == [("user" if k % 2 else "assistant", f"t{k}") for k in range(300)]
    assert got == {1: [("user", "a"), ("assistant", "b"), ("assistant", "b")], 2: [("", "")], None: [("user", "x")]}
    assert chat.format_chats(d.filter("false")).count() == 0


DATA = "/root/testdata/sf0.001"


def small_corpus(spark):
    """Documents with labels, near copies, benchmark passages, toxic and bad texts, and awkward rows."""
    rng, docs, labels = random.Random(7), [], []
    word = lambda: rng.choice(["river", "stone", "light", "house", "walk", "over", "small", "green"]) + rng.choice(["", "er", "ing", "ed"]) + str(rng.randrange(30))
    bench = [(k, " ".join(word() for _ in range(30))) for k in range(5)]
    for k in range(260):
        w = [word() for _ in range(rng.randrange(30, 90))]
        bad, toxic = k % 4 == 0, k % 5 == 0
        if bad:
            w = [x + rng.choice(["###", "$$$"]) for x in w]
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["blarg", "snorfle"]))
        if k % 7 == 3:
            w += rng.choice(bench)[1].split()
        docs.append((k, " ".join(w), "en"))
        labels.append((k, int(not bad), int(toxic)))
        if k % 6 == 1:
            docs.append((1000 + k, " ".join(w + ["tail"]), "en"))
    long = lambda x: " ".join(f"{x}{i}" for i in range(30))
    docs += [(3, long("k"), "a"), (7, long("k"), "a"), (7, long("m"), "a"), (9, long("x"), "a"), (9, long("y"), "a"), (None, long("k"), None), (None, long("z"), "a"), (None, long("z"), "b")]
    docs += [(50_000, long("w"), "a")] * 3 + [(50_001, None, None), (50_001, None, None), (50_002, "", "a"), (50_003, long("w").upper(), "c"), (None, None, None)]
    frame = spark.createDataFrame([(*r, {"n": i % 2}) for i, r in enumerate(docs)], "doc_id long, text string, a string, extra map<string,int>")
    return frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark.createDataFrame(bench, "item_id long, text string")


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("corpus"))
    for name, d in zip(("documents", "labels", "benchmark"), small_corpus(spark)):
        d.coalesce(2).write.parquet(f"{base}/{name}.parquet")
    return base


def rows_of(d):
    return Counter((r.doc_id, r.text, r.a, r.extra["n"]) for r in d.collect())


def words_of(t, pattern):
    return re.findall(pattern, (t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_near(rows):
    """Of each group of linked rows the first by id (null last); rows of one id and one text: how many stay."""
    rows, at = list(rows), {}
    sets = [set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set()) for w in (words_of(r[1], r"[^\x20\x09-\x0D]+") for r in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    for k, r in enumerate(rows):
        at.setdefault(find(k), []).append(r)
    return [sorted({(r[0] is None, r[0]) for r in group}, key=lambda x: (x[0], x[1] or 0))[0][1] for group in at.values()], at


def test_near_duplicate_stage_is_exact_by_row(spark, corpus_dir):
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, corpus_dir)
    assert kept.columns == docs.columns
    kept, given = rows_of(kept), rows_of(docs)
    assert kept <= given
    ids, groups = brute_near(given.elements())
    assert sum(kept.values()) == len(groups) and Counter(r[0] for r in kept.elements()) == Counter(ids)
    for group in groups.values():
        assert sum(kept[r] for r in set(group)) == 1 or not (group[0][1] or "").strip()
    texts = Counter(r[1] for r in kept.elements())
    assert texts[None] == 3 and texts[""] == 1 and all(texts[" ".join(f"{x}{i}" for i in range(30))] == 1 for x in "kmxyz")
    assert corpus_pipeline.near_duplicate_stage(spark, docs.filter("false"), corpus_dir).count() == 0


def test_every_stage_and_the_run(spark, corpus_dir):
    """Each stage on its predecessor's rows: filters by the row's own text, the last one packs every token."""
    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{corpus_dir}/{n}.parquet") for n in ("labels", "benchmark"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, corpus_dir).cache()
        given, kept = rows_of(now), rows_of(out)
        assert out.columns == docs.columns and kept <= given and 0 < sum(kept.values()) < sum(given.values()), name
        if name == "quality classifier":
            model = quality.train(now, labels, lambda c: fold(c, 5) != 0)
            score = quality.scorer(model)
            assert kept == Counter({r: n for r, n in given.items() if score([r[1] or ""])[0] >= quality.THRESHOLD})
        if name == "toxicity":
            model = toxicity.train(now, labels, lambda c: fold(c, 4) != 2)
            assert kept == Counter({r: n for r, n in given.items() if toxicity.raw_score(model, r[1]) < toxicity.THRESHOLD})
        if name == "benchmark decontamination":
            windows = {tuple(w[i : i + 13]) for r in bench.collect() for w in [words_of(r.text, "[0-9a-z]+")] for i in range(len(w) - 12)}

            def clean(t):
                w = words_of(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
                hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
                return not hit or 20 * len(hit) < len(w)

            assert kept == Counter({r: n for r, n in given.items() if clean(r[1])})
        now = out
    packed = corpus_pipeline.run(spark, corpus_dir)
    whole = packed.filter("start = 0").select("doc_id", "doc_tokens").collect()
    encode = tokens.Encoder()
    assert Counter((r.doc_id, r.doc_tokens) for r in whole) == Counter((r.doc_id, len(encode.one(r.text or "")) // 4 + 1) for r in now.collect())
    assert packed.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in whole)


CONTRACT = {
    "op1_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_token_counts": "length bigint, n_docs bigint, docs_at_least bigint, tokens_at_least bigint",
    "op9_license_scan": "doc_id bigint, licenses string",
    "op10_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_registered(spark, name):
    """Each query returns its contract's columns, and a row per document where the contract says so."""
    out = registry.queries()[name](spark, DATA)
    kinds = dict(out.dtypes)
    assert all(kinds.get(c.split()[0]) == c.split()[1] for c in CONTRACT[name].split(", ")), kinds
    out = out.cache()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    if name in ("op1_quality_classifier", "op2_decontamination", "op4_jaccard_join", "op5_toxicity", "op7_quality_rules", "op10_lm_score"):
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    fold_of = {"op1_quality_classifier": (5, 0), "op5_toxicity": (4, 2), "op10_lm_score": (5, 1)}.get(name)
    if fold_of:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold_of[0] == fold_of[1]) for r in out.select("doc_id", "held_out").collect())
    if "predicted" in kinds:
        assert out.filter("predicted <> CAST(score >= 0.3 AS INT) OR score < 0 OR score > 1").count() == 0
    if name == "op7_quality_rules":
        assert out.filter("base_failed <> (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) OR (base_failed AND kept)").count() == 0
    assert out.count() > 0
