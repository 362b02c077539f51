"""Token ids by a public tokenizer, and the exact length histogram with its suffix sums.

The ids are those of the ``tokenizers`` library for a byte-level BPE file. The same vocabulary, read from
that file, also drives ``tiktoken``, which is several times faster; it encodes the texts made of
characters below U+0250 (where both split alike) without the special token's string and without very long
runs of whitespace (it gives up on runs of a million), and ``tokenizers`` encodes all others. An encoder compares both on probes when it is made, and uses ``tokenizers`` alone if
they differ or the file is of another kind.

Cases: a null text is empty: no ids but the closing one. Very long texts are encoded whole. Repeated rows
count as often as they occur. An empty table gives an empty histogram. Extra columns are ignored.
"""

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, saved, table

END = 1
#: How byte-level BPE vocabularies of this kind split text before merging: a fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNUSUAL = re.compile("[^\x00-\u024f]")
#: Runs of whitespace from this length on are not given to ``tiktoken``, whose stack they overflow.
LONG_RUN = 100_000
BLANKS = re.compile(r"\s+")
PROBES = ["", " ", "Hello world, it's we'll  12 34,5\n\n x\t", "na\u00efve caf\u00e9 \u00e7a  \u00fc\u00df. ###!! <a|b>"]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 characters
    stand for themselves, the other bytes for the characters from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def long_run(text: str) -> bool:
    """Whether the text holds LONG_RUN characters of whitespace in a row."""
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in BLANKS.finditer(text))


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, without the closing id."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self.same_vocabulary()

    def same_vocabulary(self):
        import tiktoken

        names = byte_names()
        ranks = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        try:
            ranks = {bytes(names[c] for c in t): i for t, i in ranks.items()}
            fast = tiktoken.Encoding("same", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            same = [fast.encode_ordinary(t) for t in PROBES] == [e.ids for e in self.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
        except (KeyError, ValueError):
            return None
        return fast.encode_ordinary if same else None

    def one(self, text: str) -> bytes:
        if self.fast is None or UNUSUAL.search(text) or long_run(text) or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        return np.array(ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


def groups(texts: list[str], limit: int = 4_000_000):
    """Runs of texts of bounded size, so that few ids are held at once."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def token_lengths(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the ids of each whole text plus the closing one."""

    def make():
        encode = Encoder(path)
        return lambda texts: [pa.array([len(x) // 4 + 1 for lo, hi in groups(texts) for x in encode(texts[lo:hi])], pa.int64())]

    return map_texts(docs, make, "n_tokens long", id_col, text_col)


BLOCK = 1024


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """(length, n_docs) and its suffix and prefix sums, one row per distinct length:

    docs_at_least, tokens_at_least: over lengths >= this one; docs_at_most, tokens_at_most: <= this one;
    truncated_tokens: tokens left of all documents when each is cut to this length.
    The sums run inside blocks of lengths, and over the blocks' totals: no task gets all lengths.
    """
    h = lengths.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    h = saved(h, "length-histogram").withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = "OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    totals = totals.selectExpr("block", f"coalesce(sum(d) {before}, 0) AS d0", f"coalesce(sum(t) {before}, 0) AS t0", "sum(d) OVER () AS d_all", "sum(t) OVER () AS t_all")
    inside = "OVER (PARTITION BY block ORDER BY length)"
    out = h.join(totals, "block").selectExpr("length", "n_docs", "tokens", f"d0 + sum(n_docs) {inside} AS docs_at_most", f"t0 + sum(tokens) {inside} AS tokens_at_most", "d_all", "t_all")
    return out.selectExpr(
        "length", "n_docs", "docs_at_most", "tokens_at_most", "d_all - docs_at_most + n_docs AS docs_at_least", "t_all - tokens_at_most + tokens AS tokens_at_least",
        "tokens_at_most + length * (d_all - docs_at_most) AS truncated_tokens",
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: total of min(length, limit) over all documents, for any limit, from the histogram."""
    return histogram.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the share ``q`` of the documents does not exceed."""
    need = histogram.agg(F.max("docs_at_most").alias("all"))
    return histogram.crossJoin(F.broadcast(need)).filter(F.col("docs_at_most") >= F.ceil(F.col("all") * F.lit(q))).agg(F.min("length").alias("length"))


def op8_token_counts(spark, sf_dir):
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
