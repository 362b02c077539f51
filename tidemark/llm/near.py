"""N-gram Jaccard join: size-aware, heavy-light, exact.

Sets are the distinct 5-word shingles of a text; two sets link when 100 * |A & B| >= 80 * |A | B|.

* Equal sets are one class from the start; all work below is on classes, named by a 64-bit hash.
* Small sets (up to a boundary) enumerate subsets of a fixed size. Linked sets of sizes a <= b share at
  least c = ceil(0.8 b) shingles, so they share a subset of size c: for each b that a set can meet, its
  subsets of that size are its keys.
* Larger sets use inverted lists. Shingles are ranked, rarest first; linked sets share a shingle among
  the first n - ceil(0.8 n) + 1 of each. Shingles met in one class only need no list, and as they are the
  rarest, most sets of original text have no key at all.
* Heavy shingles, which a good share of all sets hold, are found in the first pass. They rank last whatever
  their count, so they are dealt by set and not by shingle: no task gets all the sets of a frequent passage.
* The boundary is the size at which, by the histogram of set sizes, keys and shuffled shingles cost least.
  Sets near it go both ways, so that no pair falls between.

Lists that many classes share are never expanded into all their pairs. Every member is first held against
one leader, the member of its lists in whose order the shingle comes first (it differs least from the
others); links join classes into components; only lists whose members still lie in several components are
looked at again, against the leaders ranked 0-7, 8-127, ... until all pairs in different components have
been tested. Pairs that cannot link by their sizes and the shingle's places are not. No link is lost, and
what links early costs no more tests.

Cases: null, empty and blank texts have empty sets: component_id is their own doc_id. Fewer than five
words: the whole sequence is the one shingle. Very long texts are read whole. Repeated rows and equal
texts are one class. An empty table gives no rows. A null doc_id keeps its row; it never names a
component unless it is alone. Extra columns are ignored.
"""

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, forget, give_back, hash_texts, map_texts, mix, plain_words, prepare, rolling, saved, table

SHINGLE = 5
#: The threshold as a fraction of whole numbers.
NUM, DEN = 4, 5
#: No boundary above this: subsets of larger sets are too many.
MAX_SMALL = 10
#: A heavy shingle: so many sets of a window of a task's sets hold it, and so many of all documents: the
#: lesser of a share of them and a count, but not below HEAVY_SETS.
WINDOW_SHINGLES, WINDOW_SETS = 2_000_000, 8
HEAVY_SHARE, HEAVY_COUNT, HEAVY_SETS = 0.005, 20_000, 64
#: So many heavy shingles at most, the most frequent ones: 8 bytes each are sent to the tasks.
MAX_HEAVY = 1 << 20
LAST = 0xFFFFFFFF
#: Shingles are kept as 48-bit hashes once their set is known; the set's own name hashes all 64 bits.
BYTES = 6
MASK = U64((1 << 8 * BYTES) - 1)
#: Shingles of one shuffled block of sets at most (memory of a task that makes blocks), and a part.
BLOCK_SHINGLES = 1_000_000
PART_SHINGLES = 2_000_000
#: A block is dealt to so many parts at most; where there are more, it goes by way of groups of parts.
FANOUT = 4096
#: Members of a list that meet in one place; longer lists are dealt over several.
LONG = 512


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    h, at = hash_texts(texts, lambda t: plain_words(t, lower=True))
    g = rolling(h, SHINGLE)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(g[a : b - SHINGLE + 1]))
        else:
            out.append(mix(rolling(h[a:b], b - a)) if b > a else np.empty(0, U64))
    return out


def name_of(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The class: a hash of the sorted set of ``bits`` bits, and a check, another hash of 64."""
    i = np.arange(1, len(s) + 1, dtype=U64)
    name, check = (np.bitwise_xor.reduce(mix(s + i * U64(c))) + U64(len(s)) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
    name, check = mix(np.array([name, check]))
    return int((name >> U64(64 - bits)).astype(np.int64)), int(check.astype(np.int64))


def narrow(s: np.ndarray) -> bytes:
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def widen(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


SETS = "cls long, n long, tokens binary, keys array<long>, places array<int>"


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def subset_keys(n: int) -> list[tuple[int, int]]:
    """(larger size b, subset size c) for each b that a set of size n can be the smaller one of."""
    top = DEN * n // NUM
    return [(b, c) for b in range(n, top + 1) if (c := -(-NUM * b // DEN)) <= n]


def enumerated(n: int) -> int:
    """Keys of a small set of size n: as the smaller set of any b, and as the larger one of b = n."""
    return sum(math.comb(n, c) for _, c in subset_keys(n))


def boundary(sizes: dict[int, int]) -> int:
    """The largest size that enumerates subsets: least keys and shuffled shingles over the histogram."""

    def cost(x: int) -> float:
        listed = -(-NUM * (x + 1) // DEN)
        return sum(k * (enumerated(n) * (n <= x) + (n + prefix_size(n)) * (n >= listed)) for n, k in sizes.items())

    return min(range(MAX_SMALL + 1), key=lambda x: (cost(x), x))


def classes(docs: DataFrame, id_col="doc_id", text_col="text", bits: int = 64) -> DataFrame:
    """(doc_id, n, cls, check, tokens, frequent): set size, class name and check (null for an empty set), the
    shingles of small sets, and now and then, for the sets a task has read since, the shingles that many of
    them hold, with their counts."""

    def make():
        held, names_held, size, batches, due = [], set(), 0, 0, 1

        def frequent() -> bytes | None:
            if len(held) < WINDOW_SETS:
                return None
            found, count = np.unique(np.concatenate(held) & MASK, return_counts=True)
            many = count >= WINDOW_SETS
            return found[many].astype("<u8").tobytes() + count[many].astype("<u4").tobytes() if many.any() else None

        def of(texts):
            nonlocal size, batches, due
            sets = shingle_sets(texts)
            names = [name_of(s, bits) if len(s) else (None, None) for s in sets]
            small = [narrow(s) if 0 < len(s) <= MAX_SMALL else None for s in sets]
            first = [None] * len(sets)
            for k, (s, name) in enumerate(zip(sets, names)):
                if len(s) and name not in names_held:
                    names_held.add(name)
                    held.append(s)
                    size += len(s)
                    if size >= WINDOW_SHINGLES:
                        first[k], size = frequent(), 0
                        held.clear()
                        names_held.clear()
            batches += 1
            if batches == due and sets:
                due *= 2
                if first[-1] is None:
                    first[-1], size = frequent(), 0
                    held.clear()
                    names_held.clear()
            cls, check = zip(*names) if names else ((), ())
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), pa.array(small, pa.binary()), pa.array(first, pa.binary())]

        return of

    return map_texts(docs, make, "n long, cls long, check long, tokens binary, frequent binary", id_col, text_col)


def class_sizes(own: DataFrame) -> DataFrame:
    """A table (cls, n, tokens, c0, c1): a row per class, with the least and the largest check."""
    some = own.filter("cls IS NOT NULL").groupBy("cls")
    return saved(some.agg(F.max("n").alias("n"), F.max("tokens").alias("tokens"), F.min("check").alias("c0"), F.max("check").alias("c1")), "class-sizes")


def heavy_shingles(own: DataFrame) -> np.ndarray:
    """The heavy shingles, sorted. Which shingles are heavy changes only the order they rank in."""

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                n = len(raw) // 12
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw[: 8 * n], "<i8")), pa.array(np.frombuffer(raw[8 * n :], "<u4").astype(np.int64))], names=["s", "k"])

    docs = own.agg(F.count(F.lit(1))).first()[0]
    found = own.filter("frequent IS NOT NULL").select("frequent").mapInArrow(run, "s long, k long").groupBy("s").agg(F.sum("k").alias("k"))
    least = max(HEAVY_SETS, min(HEAVY_SHARE * docs, HEAVY_COUNT))
    top = found.filter(F.col("k") >= least).orderBy(F.desc("k"), "s").limit(MAX_HEAVY).select("s").toArrow()
    return np.sort(top["s"].to_numpy().astype(U64))


def is_heavy(shingles: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    s = shingles & MASK
    return heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s if len(heavy) else np.zeros(len(s), bool)


BLOCK = "part int, names binary, sizes binary, counts binary, shingles binary, freqs binary"


def blocks(to, names, sizes, owner, s, freq=None) -> pd.DataFrame:
    """Rows BLOCK: the shingles ``s`` of the sets ``owner``, by the part ``to`` that each goes to."""
    order = np.lexsort((owner, to))
    to, owner, s = to[order], owner[order], s[order]
    freq = None if freq is None else freq[order].astype("<u4")
    rows, cut = [], np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        who, count = np.unique(owner[a:b], return_counts=True)
        rows.append((int(to[a]), names[who].tobytes(), sizes[who].tobytes(), count.astype(np.int32).tobytes(), narrow(s[a:b]), b"" if freq is None else freq[a:b].tobytes()))
    return pd.DataFrame(rows, columns=["part", "names", "sizes", "counts", "shingles", "freqs"])


def unpacked(pdf: pd.DataFrame):
    """(names, sizes, owner, shingles, freqs) of BLOCK rows laid end to end."""
    join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in pdf[c]])
    names = join("names", np.int64)
    return names, join("sizes", np.int32), np.repeat(np.arange(len(names)), join("counts", np.int32)), np.concatenate([widen(x) for x in pdf["shingles"]]), join("freqs", "<u4")


class Dealing:
    """How shingles go to ``parts`` parts: by shingle (a heavy one by set), or by class. Where the parts are
    more than ``fanout``, a block's rows go first to groups of ``fanout`` parts, each group in as many
    places, and are gathered into new blocks there: a block makes ``fanout`` rows at most in either step,
    so that rows grow with the shingles and not with blocks times parts."""

    def __init__(self, parts: int, fanout: int, heavy=None):
        self.fanout, self.heavy = fanout, heavy
        self.parts = parts if parts <= fanout else -(-parts // fanout) * fanout

    def part(self, names, owner, s) -> np.ndarray:
        by_class = mix(names.astype(U64))[owner]
        key = by_class if self.heavy is None else np.where(is_heavy(s, self.heavy.value), by_class, s & MASK)
        return (mix(key) % U64(self.parts)).astype(np.int64)

    def first(self, names, sizes, owner, s, freq=None) -> pd.DataFrame:
        to = self.part(names, owner, s)
        if self.parts > self.fanout and len(names):
            to = to // self.fanout * self.fanout + int(mix(names[:1].astype(U64) + U64(len(s)))[0]) % self.fanout
        return blocks(to, names, sizes, owner, s, freq)

    def deal(self, d: DataFrame) -> DataFrame:
        """The rows of ``first``, each at its part."""
        d = d.repartitionById(self.parts, "part")
        if self.parts <= self.fanout:
            return d

        def again(rows):
            names, sizes, owner, s, freq = unpacked(pd.concat(rows))
            return blocks(self.part(names, owner, s), names, sizes, owner, s, freq if len(freq) else None)

        def run(batches):
            held, size = [], 0
            for b in batches:
                for k in range(len(b)):
                    held.append(b.iloc[k : k + 1])
                    size += len(b["shingles"].iloc[k]) // BYTES
                    if size >= BLOCK_SHINGLES:
                        yield again(held)
                        held, size = [], 0
            if held:
                yield again(held)

        return d.mapInPandas(run, BLOCK).repartitionById(self.parts, "part")


def listed_blocks(docs: DataFrame, least: int, dealing: Dealing, text_col="text", bits: int = 64, renamed=frozenset()) -> DataFrame:
    """Sets of at least ``least`` shingles, packed for ``dealing``. A task sends each class once, however many
    copies it reads. Names in ``renamed`` are those of several classes."""

    def flush(sets):
        names, sizes = np.array([s[0] for s in sets], np.int64), np.array([len(s[1]) for s in sets], np.int32)
        return dealing.first(names, sizes, np.repeat(np.arange(len(sets)), sizes), np.concatenate([s[1] for s in sets]))

    def run(batches):
        seen, sets, held = set(), [], 0
        for b in batches:
            for s in shingle_sets(b["text"]):
                if len(s) < least:
                    continue
                name, check = name_of(s, bits)
                name ^= check if name in renamed else 0
                if name not in seen:
                    seen.add(name)
                    sets.append((name, s))
                    held += len(s)
                    if held >= BLOCK_SHINGLES:
                        yield flush(sets)
                        sets, held = [], 0
        if sets:
            yield flush(sets)
        sets = seen = None
        give_back()

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, BLOCK)


def shared_shingles(listed: DataFrame, dealing: Dealing, by_class: Dealing) -> DataFrame:
    """Of each class the shingles that other classes hold too, with their frequencies, packed for ``by_class``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, sizes, who, s, _ = unpacked(pdf)
        order = np.lexsort((names[who], s))
        s, who = s[order], who[order]
        # a class that several tasks sent has equal shingles more than once
        new = np.r_[True, (s[1:] != s[:-1]) | (names[who[1:]] != names[who[:-1]])]
        s, who = s[new], who[new]
        group = np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1
        freq = np.where(is_heavy(s, dealing.heavy.value), LAST, np.bincount(group)[group])
        keep = freq > 1
        s, who, freq = s[keep], who[keep], freq[keep]
        # one owner a class
        unique, first, of = np.unique(names, return_index=True, return_inverse=True)
        out = by_class.first(unique, sizes[first], of[who], s, freq)
        s = who = freq = order = group = new = keep = None
        give_back()
        return out

    return dealing.deal(listed).groupBy("part").applyInPandas(run, BLOCK)


def list_keys(shared: DataFrame, by_class: Dealing) -> DataFrame:
    """(cls, n, tokens, keys, places): all shared shingles of a class, and of those in its prefix the list
    keys with their places in its order. What only one class holds ranks first and takes up the prefix
    without needing a list; classes whose prefix holds nothing else have no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, sizes, owner, s, freq = unpacked(pdf)
        cls, size = names[owner], sizes[owner]
        order = np.lexsort((s, freq, cls))
        s, cls, size = s[order], cls[order], size[order]
        first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        rows = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cls)]):
            n = int(size[a])
            alone = n - (b - a)
            r = prefix_size(n) - alone
            if r > 0:
                keys = s[a : min(b, a + r)]
                rows.append((int(cls[a]), n, narrow(np.sort(s[a:b])), mix(keys).astype(np.int64).tolist(), list(range(alone, alone + len(keys)))))
        return pd.DataFrame(rows, columns=["cls", "n", "tokens", "keys", "places"])

    return by_class.deal(shared).groupBy("part").applyInPandas(run, SETS)


def subset_rows(small: DataFrame) -> DataFrame:
    """As ``list_keys`` for small sets: a key for each subset of each fixed size; places are 0."""

    def keys(raw: bytes) -> list[int]:
        s = mix(widen(raw))
        out = [
            np.array([int(np.sum(s[list(i)], dtype=U64)) + (b << 8 | c) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for i in itertools.combinations(range(len(s)), c)], U64)
            for b, c in subset_keys(len(s))
        ]
        return mix(np.concatenate(out)).astype(np.int64).tolist()

    def run(batches):
        for b in batches:
            found = [keys(x) for x in b["tokens"]]
            yield b.assign(keys=found, places=[[0] * len(x) for x in found])

    return small.select("cls", "n", "tokens").mapInPandas(run, SETS)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sets meet the threshold, by exact intersection."""
    a = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def run(batches):
        for p in batches:
            ok = []
            for na, nb, ta, tb in zip(p["na"], p["nb"], p["ta"], p["tb"]):
                both = len(np.intersect1d(widen(ta), widen(tb), assume_unique=True))
                ok.append(DEN * both >= NUM * (na + nb - both))
            yield p.loc[ok, ["a", "b"]]

    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ta", "tb").mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cls, root) of every end of an edge (a, b): the smallest name of its component.

    Alternates large-star and small-star steps until nothing changes; each is an aggregation with
    map-side minimum and a join. A hub's edges are dealt by the hub there; Spark splits such a partition
    once it is large (its skew join).
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    made, before = None, None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = saved(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large-star", few=True)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = saved(small.filter("a <> b").distinct(), "small-star", few=True)
        forget(large)
        if made is not None:
            forget(made)
        made = e
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("cls"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("cls"), F.col("b").alias("root"))).distinct()
        before = now


def may_link(na, pa, nb, pb):
    """Two classes on a list, of sizes and with the list's shingle at places: where it is the first that
    both hold, they share no more than what follows it in either. True of some list for every link."""
    both = F.col(na) + F.col(nb)
    least = F.ceil((NUM * both) / F.lit(NUM + DEN) - F.lit(1e-9))
    return F.least(F.col(na) - F.col(pa), F.col(nb) - F.col(pb)) >= least


def salts(size: str):
    """Over how many places the list of a key is dealt."""
    return F.greatest(F.lit(1), F.ceil(F.col(size) / LONG).cast("int"))


def at_all(d: DataFrame, size: str) -> DataFrame:
    """Each row once for each place of its list, numbered ``salt``."""
    return d.withColumn("salt", F.explode(F.sequence(F.lit(0), salts(size) - 1)))


def resolve(sets: DataFrame) -> DataFrame:
    """(cls, root) of all classes that have links, a table; ``sets`` has the columns SETS.

    The members of a list are dealt by (key, salt), at most about LONG to a place, and what a list has in
    common (its leaders, its size) goes to all its places. Leaders of a later round are those whose place in
    an order by hash, a fraction of the list's size, lies in the round's range: no list is ever sorted.
    """
    lists = sets.select("cls", "n", F.inline(F.arrays_zip("keys", "places"))).withColumnsRenamed({"keys": "key", "places": "place"}).distinct()
    first = F.min_by(F.struct(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb")), F.struct("place", "cls"))
    shared = saved(lists.groupBy("key").agg(first.alias("leader"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "shared-keys")
    long = shared.filter(F.col("members") > LONG).select("key", F.col("members").alias("size"))
    lists = lists.join(long, "key", "left").withColumn("salt", F.pmod(F.xxhash64("cls"), F.coalesce(salts("size"), F.lit(1))).cast("int"))
    lists = saved(lists.join(at_all(shared, "members"), ["key", "salt"]).select("key", "salt", "cls", "n", "place", "leader.*"), "lists")
    forget(shared)
    sets = saved(sets.select("cls", "n", "tokens").join(lists.select("cls").distinct(), "cls", "left_semi"), "sets")
    fits = may_link("n", "place", "nb", "pb")
    pairs = lists.filter((F.col("cls") != F.col("b")) & fits).groupBy("cls").agg(F.min_by("b", F.struct("pb", "b")).alias("b")).select(F.col("cls").alias("a"), "b")
    lo, hi = 0, 8
    links = roots = open_lists = None
    while True:
        fresh = linked(pairs, sets)
        before = [links, roots, open_lists]
        links = saved(fresh if links is None else links.unionByName(fresh), "links", few=True)
        roots = saved(components(links), "roots", few=True)
        for old in filter(None, before):
            forget(old)
        at = lists.select("key", "salt", "cls", "n", "place").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        mixed = at.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("members")).filter("r0 <> r1")
        open_lists = saved(at.join(at_all(mixed.select("key", "members"), "members"), ["key", "salt"]), "open-lists")
        most = open_lists.agg(F.max("members")).first()[0]
        if most is None or lo >= most:
            for old in (links, lists, sets, open_lists):
                forget(old)
            return roots
        turn = F.pmod(F.xxhash64("key", "cls"), F.lit(1 << 52)).cast("double") / float(1 << 52) * F.col("members")
        ranked = open_lists.withColumn("rank", turn)
        leaders = ranked.filter((F.col("rank") >= lo) & (F.col("rank") < hi)).drop("salt")
        leaders = at_all(leaders, "members").select("key", "salt", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("root").alias("rb"), F.col("rank").alias("kb"))
        later = (F.col("rank") > F.col("kb")) | ((F.col("rank") == F.col("kb")) & (F.col("cls") > F.col("b")))
        ok = fits & (F.col("root") != F.col("rb")) & later
        pairs = ranked.join(leaders, ["key", "salt"]).filter(ok).select(F.greatest("cls", "b").alias("a"), F.least("cls", "b").alias("b")).distinct()
        lo, hi = hi, 16 * hi


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", bits: int = 64, fanout: int = FANOUT, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``. The other parameters are those of the
    class names and of the dealing; the result does not depend on them."""
    spark = prepare(docs.sparkSession)
    own = saved(classes(docs, id_col, text_col, bits), "classes")
    sizes = class_sizes(own)
    # names that several classes have by chance (about n^2 / 2^65 of them) become the XOR of name and check
    renamed = frozenset(r.cls for r in sizes.filter("c0 <> c1").select("cls").collect())
    if renamed:
        forget(sizes)
        own = own.withColumn("cls", F.when(F.col("cls").isin(*renamed), F.col("cls").bitwiseXOR(F.col("check"))).otherwise(F.col("cls")))
        sizes = class_sizes(own)
    histogram = {r["n"]: r["k"] for r in sizes.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()}
    x = boundary(histogram)
    least = max(1, -(-NUM * (x + 1) // DEN))
    total = sizes.filter(F.col("n") >= least).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // part_shingles))
    dealing, by_class = Dealing(parts, fanout, spark.sparkContext.broadcast(heavy_shingles(own))), Dealing(parts, fanout)
    listed = listed_blocks(docs, least, dealing, text_col, bits, renamed)
    by_list = saved(list_keys(shared_shingles(listed, dealing, by_class), by_class), "listed-sets")
    # small sets keep all their shingles; where one goes both ways its two lists of keys are joined
    by_subset = subset_rows(sizes.filter(F.col("n") <= x))
    both = by_list.filter(F.col("n") <= x).withColumn("whole", F.lit(False)).unionByName(by_subset.withColumn("whole", F.lit(True)))
    joined = lambda c: F.flatten(F.collect_list(c)).alias(c)
    small = saved(both.groupBy("cls").agg(F.max("n").alias("n"), F.max_by("tokens", "whole").alias("tokens"), joined("keys"), joined("places")), "small-sets", few=True)
    sets = by_list.filter(F.col("n") > x).unionByName(small)
    roots = resolve(sets)
    for old in (sizes, by_list, small):
        forget(old)
    rows = own.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"))
    rows = saved(rows.join(roots, "cls", "left").withColumn("component", F.coalesce("root", "cls")).drop("root"), "class-rows")
    groups = rows.groupBy("component").agg(F.min("least_id").alias("least_id"), F.sum("rows").alias("all_rows"), F.count(F.lit(1)).alias("members"))
    groups = saved(groups.filter("all_rows > 1").drop("all_rows"), "groups")
    by_class = saved(looked_up(rows.drop("least_id"), "component", groups, "members").filter("least_id IS NOT NULL").select("cls", "least_id", F.col("rows").alias("members")), "class-groups")
    for old in (roots, rows, groups):
        forget(old)
    return looked_up(own.select("doc_id", F.col("n").alias("n_shingles"), "cls"), "cls", by_class, "members", "doc_id").select("doc_id", "n_shingles", F.coalesce("least_id", "doc_id").alias("component_id"))


def looked_up(d: DataFrame, key: str, values: DataFrame, size: str, spread: str = "cls") -> DataFrame:
    """``d`` with the least_id of its key. Keys that many rows have are few, and looked up in a table of their
    own, which Spark broadcasts while it is below its threshold; in the join of all others such rows, and
    those without a key, are dealt by a hash of ``spread``."""
    many = values.filter(F.col(size) > LONG).select(F.col(key).alias("_k"), F.col("least_id").alias("_many"))
    others = values.filter(F.col(size) <= LONG).select(F.col(key).alias("_o"), F.col("least_id").alias("_other"))
    d = d.join(many, F.col(key) == F.col("_k"), "left")
    at = F.when(F.col(key).isNull() | F.col("_k").isNotNull(), F.xxhash64(spread)).otherwise(F.col(key))
    d = d.withColumn("_at", at).join(others, F.col("_at") == F.col("_o"), "left")
    own = F.when(F.col(key).isNull(), None).otherwise(F.coalesce("_many", F.when(F.col("_k").isNull(), F.col("_other"))))
    return d.withColumn("least_id", own).drop("_k", "_o", "_many", "_other", "_at")


def op4_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
