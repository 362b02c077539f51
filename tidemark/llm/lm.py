"""Language-model scoring with a weighted backoff automaton of n-grams up to order 3.

Tokens are words and one end a text. The automaton has a state for each context met in training: pairs of
words, single words (the start of a text is one), and the empty context. A state's arcs are the n-grams
that continue it; where it has no arc for a token, its failure arc leads, at a weight, to the state of its
shorter context, down to the empty one, whose arcs are the additively smoothed unigrams of the base score
(unknown words share one arc there). An arc leads to the longest context that its token ends. One
left-to-right traversal carries the state and adds up log10 of the weights it passes. The weights are

    arc of w at h:  (c(h w) + mu * p(w | shorter h)) / (c(h) + mu)       failure arc of h:  mu / (c(h) + mu)

which is interpolation with a Dirichlet prior (the shorter context's distribution, worth ``MU`` tokens):
fixed for each state, and the probabilities of all next tokens sum to one from every state.

Counts cover all training rows. Documents are dealt into blocks. A block sends the distinct n-grams of its
texts, as sorted 64-bit hashes, with their counts in its own training rows, to parts by range of the hash; a
part adds up what all blocks sent and returns to each block, in the order it sent them, the totals. Words
and pairs go first; then, of the triples, those whose two pairs were both met in other blocks too, as no
other triple can have been. So each block gets the part of the automaton its texts can visit, and no table of
all n-grams exists in one place. A frequent word is one entry a block, however often it occurs.

Cases: null and empty texts have one token, the end. Very long texts are read whole. Repeated rows train
and score as often as they occur; rows without an id are dealt by their place in the input, others by id and
text. Without training rows N and V are 0, every count is 0 and the score is the base score. An empty
table gives no rows. Extra columns are ignored. A null doc_id counts as empty text for the fold.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, fold, give_back, hash_words, mix, plain_words, prepare, saved, table, texts_of

#: Sizes of a block of documents: what one task holds in memory.
BLOCK_DOCS = 4096
BLOCK_BYTES = 12_000_000
#: n-grams that one part adds up.
PART_GRAMS = 3_000_000
#: Tokens that the shorter context is worth, by order. Chosen on held-out rows of tables of 1,000 to 40,000
#: documents: the best of 1000, 3000 and 10000 for pairs, and near the best of 30, 100 and 300 for triples.
MU = {2: 10_000.0, 3: 50.0}
END = U64(0x2545F4914F6CDD1D)
START = U64(0x9E6C63D0876A9A47)


def sequences(texts) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Of all texts end to end: by order the hashes of the n-grams that end in each token, and offsets. The
    start of a text counts as a word, once: first tokens end a pair with it, and no triple (0)."""
    words = [plain_words(t, lower=True) for t in texts]
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    one = np.full(at[-1], END, U64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    one[inner] = hash_words([w for ws in words for w in ws])
    two = mix(shifted(one, at, START) * U64(0x9E3779B97F4A7C15) + one)
    three = mix(shifted(two, at, START) * U64(0xD6E8FEB86659FD93) + one)
    three[at[:-1]] = 0
    return {1: one, 2: two, 3: three}, at


def shifted(x: np.ndarray, at: np.ndarray, first) -> np.ndarray:
    """The value before each token of its text; ``first`` for first tokens."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at[:-1]] = first
    return out


def counts(keys: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their counts among training tokens, and where each token's key is."""
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, weights=trains, minlength=len(unique)).astype(np.int64), where


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, and the steps to the next ones in as many bytes as the largest needs."""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return keys[:1].astype("<u8").tobytes() + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    width = raw[8]
    out = np.zeros((1 + (len(raw) - 9) // width, 8), np.uint8)
    out[0] = np.frombuffer(raw[:8], np.uint8)
    out[1:, :width] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(out.view("<u8").ravel(), dtype=U64)


def pack_counts(n: np.ndarray) -> bytes:
    kind = "<u1" if n.max() < 1 << 8 else "<u4" if n.max() < 1 << 32 else "<u8"
    return bytes([int(kind[2])]) + n.astype(kind).tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def edges(parts: int) -> np.ndarray:
    """The least key of each part; ``parts`` is a power of two."""
    return np.arange(parts, dtype=U64) << U64(64 - (parts.bit_length() - 1)) if parts > 1 else np.zeros(1, U64)


def with_blocks(docs: DataFrame, trains, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), trains.alias("t"))
    n, size = d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_DOCS), -(-int(size) // BLOCK_BYTES))
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    key = F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64), place)
    return d.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int")), blocks, int(size) // 5 + n


def messages(block: int, size: int, unique: np.ndarray, n: np.ndarray, low: np.ndarray) -> list[tuple]:
    """Rows MESSAGE of a block's distinct n-grams of one order, by part."""
    cut = [*np.searchsorted(unique, low).tolist(), len(unique)]
    return [(p, block, size, pack_keys(unique[a:b]), pack_counts(n[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]


MESSAGE = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
MESSAGE_SQL = "part int, block int, size int, keys binary, n binary"


def read_block(texts: pa.Table):
    """(n-gram hashes by order, offsets, whether each token is a training one)."""
    grams, at = sequences(texts_of(texts["text"]))
    return grams, at, np.repeat(np.array(texts["t"].to_pylist(), bool), np.diff(at))


def as_messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, MESSAGE)], schema=MESSAGE)


def sent_pairs(d: DataFrame, blocks: int, parts: int) -> DataFrame:
    """(part, block, size, keys, n): the words and pairs of each block and their counts in training."""
    low = edges(parts)

    def run(texts: pa.Table) -> pa.Table:
        grams, _, t = read_block(texts)
        block, rows = texts["block"][0].as_py(), []
        for size in (1, 2):
            unique, n, _ = counts(grams.pop(size), t)
            rows += messages(block, size, unique, n, low)
        out = as_messages(rows)
        grams = rows = unique = n = None
        give_back()
        return out

    return d.select("block", "text", "t").repartitionById(blocks, "block").groupBy("block").applyInArrow(run, MESSAGE_SQL)


def sent_triples(d: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """As ``sent_pairs``, the triples that other blocks may hold too; ``pairs`` are the replies so far."""
    low = edges(parts)

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return as_messages([])
        grams, at, t = read_block(texts)
        _, elsewhere = known(grams.pop(2), t, by_part(replies)[2], low)
        _, unique, n, _ = open_triples(grams.pop(3), at, t, elsewhere)
        out = as_messages(messages(texts["block"][0].as_py(), 3, unique, n, low))
        grams = unique = n = elsewhere = None
        give_back()
        return out

    return d.select("block", "text", "t").groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(run, MESSAGE_SQL)


def open_triples(three: np.ndarray, at: np.ndarray, t: np.ndarray, elsewhere: np.ndarray):
    """Which tokens end a triple whose pairs both are met elsewhere, and these triples, as ``counts``."""
    may = elsewhere & shifted(elsewhere, at, False)
    return may, *counts(three[may], t[may])


def returned_grams(sent: DataFrame, parts: int) -> DataFrame:
    """(block, part, size, n): of what a block sent, in its order, twice the total, and one more where other
    blocks hold it too; block -1: N and V."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, part = [], int(pdf["part"].iloc[0])
        for size, some in pdf.groupby("size"):
            keys = [unpack_keys(x) for x in some["keys"]]
            unique, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([unpack_counts(x) for x in some["n"]]), minlength=len(unique)).astype(np.int64)
            if size == 1:
                rows.append((-1, part, 1, pack_counts(np.array([total.sum(), (total > 0).sum()]))))
            reply, start = 2 * total + (np.bincount(where, minlength=len(unique)) > 1), 0
            for block, k in zip(some["block"], keys):
                rows.append((block, part, size, pack_counts(reply[where[start : start + len(k)]])))
                start += len(k)
        give_back()
        return pd.DataFrame(rows, columns=["block", "part", "size", "n"])

    return sent.repartitionById(parts, "part").groupBy("part").applyInPandas(run, "block int, part int, size int, n binary")


def by_part(replies: pa.Table) -> dict[int, dict[int, bytes]]:
    """The replies of a block, by order and part."""
    got: dict = {1: {}, 2: {}, 3: {}}
    for part, size, n in zip(*(replies[x].to_pylist() for x in ("part", "size", "n"))):
        got[size][part] = n
    return got


def totals(unique: np.ndarray, replies: dict[int, bytes], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The training counts of a block's distinct n-grams, and whether other blocks hold them too, from its
    replies by part."""
    cut = [*np.searchsorted(unique, low).tolist(), len(unique)]
    got = [unpack_counts(replies[p]) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    out = np.concatenate(got) if got else np.empty(0, np.int64)
    if len(out) != len(unique):
        raise ValueError("the documents of a block differ from those that were counted")
    return out >> 1, out & 1 == 1


def known(keys: np.ndarray, t: np.ndarray, replies: dict[int, bytes], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By token, the training count of its n-gram, and whether other blocks hold it too."""
    unique, _, where = counts(keys, t)
    total, elsewhere = totals(unique, replies, low)
    return total[where], elsewhere[where]


class Automaton:
    """The part of the automaton that a block's texts visit, laid out by token: the log10 weights of the arcs
    that lead on from the states of two, one and no words before it (NO_ARC where there is none), of these
    states' failure arcs, and the size of the longest context that the token ends."""

    NO_ARC = 1.0

    def __init__(self, c: dict[int, np.ndarray], starts: np.ndarray, texts: int, base: np.ndarray):
        """``c``: by order the training counts of the n-grams that end in each token; ``starts``: the first
        tokens; ``texts``: how many texts were counted; ``base``: the unigram probabilities."""
        first = np.zeros(len(base), bool)
        first[starts] = True
        before = {2: np.r_[0, c[1][:-1]], 3: np.r_[0, c[2][:-1]]}
        before[2][first], before[3][first] = texts, 0
        self.arc, self.back, p = {1: np.log10(base)}, {}, base
        for size in (2, 3):
            mu = MU[size]
            p = (c[size] + mu * p) / (before[size] + mu)
            self.arc[size] = np.where(c[size] > 0, np.log10(p), self.NO_ARC)
            self.back[size] = np.log10(mu / (before[size] + mu))
        self.ends = np.where(c[2] > 0, 2, np.where(c[1] > 0, 1, 0))
        self.start = 1 if texts else 0

    def read(self, lo: int, hi: int) -> float:
        """log10 probability of the tokens from ``lo`` to ``hi``, a whole text, carrying the state."""
        total, state, none = 0.0, self.start, self.NO_ARC
        of = (self.arc[3], self.back[3], self.arc[2], self.back[2], self.arc[1], self.ends)
        for arc3, back3, arc2, back2, arc1, ends in zip(*(x[lo:hi].tolist() for x in of)):
            if state == 2:
                if arc3 != none:
                    total += arc3
                    state = ends
                    continue
                total += back3
                state = 1
            if state == 1:
                if arc2 != none:
                    total += arc2
                    state = ends
                    continue
                total += back2
            total += arc1
            state = ends
        return total


def lm_scores(docs: DataFrame, trains, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: n_tokens, n_known, train_tokens, base_score and the automaton's score."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    d, blocks, tokens = with_blocks(docs, trains, id_col, text_col)
    parts = 1 << (max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * tokens // PART_GRAMS)) - 1).bit_length()
    pairs = saved(returned_grams(sent_pairs(d, blocks, parts), parts), "pairs")
    triples = saved(returned_grams(sent_triples(d, pairs.filter("block >= 0 AND size = 2"), parts), parts), "triples")
    shares = [unpack_counts(r.n) for r in pairs.filter("block = -1").select("n").collect()]
    big_n, big_v = (int(x) for x in np.sum(shares or [[0, 0]], axis=0))
    unit, low = big_n + 0.5 * (big_v + 1), edges(parts)
    n_texts = d.filter("t").count()

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        ids = texts["doc_id"].combine_chunks()
        if not texts.num_rows:
            return pa.Table.from_arrays([ids, *(pa.array([], x) for x in [pa.int64()] * 3 + [pa.float64()] * 2)], names=names)
        grams, at, t = read_block(texts)
        got, c = by_part(replies), {}
        c[1], _ = known(grams.pop(1), t, got[1], low)
        c[2], elsewhere = known(grams.pop(2), t, got[2], low)
        three = grams.pop(3)
        _, own, where = counts(three, t)
        c[3] = own[where]
        may, unique, _, where = open_triples(three, at, t, elsewhere)
        c[3][may] = totals(unique, got[3], low)[0][where]
        c[3][at[:-1]] = 0
        three = own = where = may = unique = elsewhere = got = None
        base = (c[1] + 0.5) / unit
        automaton = Automaton(c, at[:-1], n_texts, base)
        sums = np.add.reduceat(automaton.arc[1], at[:-1])
        n_known = np.add.reduceat((c[1] > 0).astype(np.int64), at[:-1])
        c = base = None
        give_back()
        score = np.array([automaton.read(a, b) for a, b in zip(at[:-1], at[1:])])
        return pa.Table.from_arrays([ids, *map(pa.array, (np.diff(at), n_known, np.full(len(n_known), big_n, np.int64), sums, score))], names=names)

    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    mine = pairs.filter("block >= 0").unionByName(triples).groupBy("block")
    return d.select("block", "doc_id", "text", "t").groupBy("block").cogroup(mine).applyInArrow(run, schema)


def op10_lm_score(spark, sf_dir):
    out = lm_scores(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
