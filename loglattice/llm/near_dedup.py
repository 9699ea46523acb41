"""Near-duplicates: banded MinHash, sequential Bayesian pruning, exact verification.

1. Each document's set of word shingles gives a key of the whole set, band keys and a signature of one byte per
   hash. Documents of equal sets form a class; one representative goes on.
2. Representatives that share a band key form a bucket. Buckets of at most ``SMALL`` are compared in tiles of signatures,
   batch by batch: a pair goes as soon as the posterior probability that it reaches the threshold is below ``MISS``. First
   each tile gives only the likeliest pairs that would connect its documents; these are verified on their full sets. Then
   the pairs that are left between different components are all verified, inside their tiles (``pair_tiles``).
3. A larger bucket is compared with a leader only, the smallest id in any large bucket of its members. Members linked to the
   leader are linked to each other by way of it. A member that is not may still be linked to others of the bucket: then the
   two share differences from the leader, so members are dealt again into buckets by their rarest differences (see
   ``differences``), and the same step runs on those. A bucket of one component goes; one with at most ``FEW`` members
   outside its main component is compared in tiles, as is what is left after ``ROUNDS`` such steps.
4. Links between representatives give components; copies inherit them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm import pair_tiles
from loglattice.llm.common import arrow_map, discard, store, whole_text
from loglattice.llm.components import components

WORDS = 5
PERCENT = 85
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
BATCH = 25
MISS = 1e-9
SMALL = 8192
FEW = 1024
#: Members of a star that get the leader's text from one copy.
STAR = 256
ROUNDS = 6

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_random = np.random.default_rng(20)
FACTORS = (_random.integers(0, 1 << 32, HASHES, dtype=np.uint64) | U64(1)).astype(np.uint32)
SHIFTS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
PLACES = 8 * np.arange(ROWS)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two multiply and shift rounds)."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            self.up = np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(size - 1, BASE))])
            self.down = np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(size - 1, INVERSE))])
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a whole text.

    A-Z are lower-cased; words are runs of anything but space and the five control characters after
    it. A text of fewer words is one shingle; one without words has none.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _POWERS.get(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)])])
        word = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
        n = min(words, len(word))
        out = np.full(len(word) - n + 1, U64(n))
        for k in range(n):
            out = mixed(out * BASE + word[k : len(word) - n + 1 + k])
    return np.unique(out)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of multiply-add hashes of the set; taken in slices, so a long text needs little memory."""
    low = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 2048):
            out = np.minimum(out, (low[at : at + 2048, None] * FACTORS + SHIFTS).min(axis=0))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the key of the set (two numbers), band keys (band number and its bytes of the signature) and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py())
                if not len(s):
                    yield doc_id, 0, None, None, None, None
                    continue
                with np.errstate(over="ignore"):
                    key = [int(mixed(s + U64(k)).sum().astype(np.int64)) for k in (1, 2)]
                    hashes = minhashes(s)
                    signature = ((hashes * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                    bands = (signature.reshape(BANDS, ROWS).astype(np.int64) << PLACES).sum(axis=1) + (np.arange(BANDS) << 40)
                yield doc_id, len(s), *key, bands.tolist(), signature.tobytes()

    return arrow_map(docs, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, signature binary", run)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n make the similarity Beta(m+1, n-m+1) distributed, which exceeds
    t with the probability that n+1 trials of chance t succeed at most m times. Bytes of the signature agree by chance as
    well, which only keeps more pairs.
    """
    out, t = {}, percent / 100
    for n in range(BATCH, HASHES + 1, BATCH):
        total = 0.0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                out[n] = m
                break
    return out


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of both sides; a leader's goes out once for every ``STAR`` members or so."""
    side = lambda n: texts.select(F.col("id").alias(n), F.col("text").alias(f"t{n}"))
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR)).cast("int").alias("shares"))
    leaders = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).join(side("a"), "a")
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share"))
    return dealt.join(side("b"), "b").join(leaders, ["a", "share"]).select("a", "b", "ta", "tb")


class _Sets:
    """The sets of the texts met last; a leader's text comes again and again."""

    def __init__(self) -> None:
        self.known: dict[int, np.ndarray] = {}

    def get(self, key: int, text: pa.StringScalar) -> np.ndarray:
        if key not in self.known:
            if len(self.known) >= 64:
                self.known.clear()
            self.known[key] = shingle_set(text.as_py())
        return self.known[key]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def differences(stars: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For (a = leader, b = member): whether they are linked, and the shingles in one of the two sets only.

    Sizes l of the leader, a and b of two members, D the differences, c = (1 - t) / (1 + t). Two sets are
    linked when their own differences number at most c times the sum of their sizes; those of the members are the elements in
    one of D_a, D_b only. If a is not linked to the leader, |D_a| > c (a + l), and a link of a and b asks for
    more than (|D_b| - c max(0, b - l)) / 2 common elements of D_a and D_b. So b can be found by its
    |D_b| - floor((|D_b| - c max(0, b - l)) / 2) rarest elements (``prefix``): against all elements of a, if b
    is linked to the leader, and against those of a's own prefix if neither is.
    """
    c = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sets = _Sets()
        for batch in batches:
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for (a, b), ta, tb in zip(ids, batch.column(2), batch.column(3), strict=True):
                leader, member = sets.get(a, ta), shingle_set(tb.as_py())
                own = np.setxor1d(leader, member, assume_unique=True)
                prefix = len(own) - math.floor((len(own) - c * max(0, len(member) - len(leader))) / 2)
                yield a, b, linked(leader, member, percent), prefix, own.astype(np.int64).tolist()

    return arrow_map(_with_texts(stars, texts), "a long, b long, linked boolean, prefix int, own array<long>", run, chunk=200)


def _dealt_again(compared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id): buckets of members that share rare differences from their leader, at least one not linked to it; and the table they read."""
    open_ = compared.where("NOT linked").select("a").distinct()
    tokens = compared.join(open_, "a", "left_semi").select("a", "b", "linked", "prefix", F.explode("own").alias("e"))
    counts = tokens.groupBy("a", "e").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(counts, ["a", "e"])
    order = F.row_number().over(Window.partitionBy("a", "b").orderBy("n", "e"))
    ranked = ranked.withColumn("rare", order <= F.col("prefix")).where("n > 1 AND (rare OR NOT linked)")
    ranked = store(ranked.select("a", "e", "b", "linked", "rare"), "differences")
    rare_linked, apart = F.max(F.col("rare") & F.col("linked")).alias("wide"), F.max(~F.col("linked")).alias("apart")
    kinds = ranked.groupBy("a", "e").agg(rare_linked, apart, F.max("rare").alias("any_rare")).where("apart AND any_rare")
    members = ranked.join(kinds, ["a", "e"]).where("rare OR wide")
    return members.select(F.xxhash64("a", "e").alias("key"), F.col("b").alias("id")), ranked


def _stars(big: DataFrame, shared: bool) -> DataFrame:
    """(a = leader, b = member) of large buckets (key, leader, id), the leader being the smallest member.

    With ``shared`` (for bands) it is a common one:

    Buckets of several bands hold much the same members, so a bucket takes the smallest leader that any of its
    members has in any bucket. It need not be a member itself: what is shown in ``differences`` holds for any set.
    """
    if not shared:
        return big.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    least = big.groupBy("id").agg(F.min("leader").alias("least"))
    common = big.select("key", "id").join(least, "id").groupBy("key").agg(F.min("least").alias("a"))
    return big.select("key", F.col("id").alias("b")).join(common, "key").where("a <> b").select("a", "b").distinct()


def links(members: DataFrame, signatures: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect all that the buckets of the band keys ``members`` (key, id) hold and that reach the threshold.

    ``signatures``: id, n_shingles, signature.
    """
    least = least_matches(percent)
    members = store(members.join(signatures.select("id", "n_shingles"), "id").select("key", "id", "n_shingles"), "members")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).where(F.col("n") <= SMALL)
    number = pair_tiles.blocks(F.col("n"), F.col("weight"))
    whole = members.join(sizes, "key").select("key", "id", F.col("id").alias("root"), F.lit(None).cast("long").alias("main"), number.alias("blocks"), number.alias("outside_blocks"))
    likely = store(pair_tiles.repacked(pair_tiles.possible_pairs(pair_tiles.dealt(whole, signatures), least, forest=True, bands=None)), "likely")
    found = [store(pair_tiles.verified(likely, texts, shingle_set, percent), "linked")]
    discard(likely)
    last_links, read = [], []
    for turn in range(ROUNDS):
        if turn:
            members = store(members.distinct().join(signatures.select("id", "n_shingles"), "id").select("key", "id", "n_shingles"), "members")
        if read:
            discard(*read)
        roots = components(reduce(DataFrame.union, found))
        rooted = members.join(roots, "id", "left").select("key", "id", "n_shingles", F.coalesce("root", "id").alias("root"))
        counts = rooted.groupBy("key", "root").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
        sizes = counts.groupBy("key").agg(
            F.min("leader").alias("leader"), F.sum("n").alias("n"), F.sum("weight").alias("weight"),
            F.max_by(F.struct("root", "n", "weight"), F.struct("n", "root")).alias("most"),
        ).where("n > most.n")
        rest = pair_tiles.blocks(F.col("n") - F.col("most.n"), F.col("weight") - F.col("most.weight"))
        sizes = sizes.select("key", "leader", "n", (F.col("n") - F.col("most.n")).alias("apart"), F.col("most.root").alias("main"), pair_tiles.blocks(F.col("n"), F.col("weight")).alias("blocks"), rest.alias("outside_blocks"))
        sized = store(rooted.join(sizes, "key"), "sized")
        few = (F.col("n") <= SMALL) | (F.col("apart") <= FEW)
        big = sized.where(~few)
        last = turn == ROUNDS - 1 or big.isEmpty()
        pairs = pair_tiles.possible_pairs(pair_tiles.dealt(sized if last else sized.where(few), signatures), least, forest=False, bands=None if turn else (BANDS, ROWS))
        pairs = store(pair_tiles.repacked(pairs) if turn else pairs, "possible")
        last_links.append(store(pair_tiles.verified(pairs, texts, shingle_set, percent), "linked"))
        discard(pairs)
        if last:
            discard(members, sized)
            break
        compared = store(differences(_stars(big, turn == 0), texts, percent), "compared")
        discard(members, sized)
        found.append(store(compared.where("linked").select("a", "b"), "linked"))
        members, ranked = _dealt_again(compared)
        read = [compared, ranked]
    return reduce(DataFrame.union, [*found, *last_links])


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. component_id is the
    smallest id reachable. Texts without words are linked with nothing, nor are rows with a null id (their component_id
    is null and they are kept). Repeated rows share a component. Rows of one id with different texts each get the
    component of their own text, linked by any text of the id. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    sketched = store(sketches(rows), "sketches")
    key = ["key1", "key2", "n_shingles"]
    filled = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = store(filled.groupBy(*key).agg(F.min("doc_id").alias("id")), "classes")
    # Copies have one set, so any row with the representative's id and key will do.
    chosen = filled.join(classes.withColumnRenamed("id", "doc_id"), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key])
    chosen = store(chosen.select(F.col("doc_id").alias("id"), "n_shingles", "signature", "bands"), "representatives")
    banded = chosen.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = store(banded.join(shared, "key", "left_semi").select("key", "id"), "banded")
    wanted = members.select("id").distinct()
    texts = rows.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
    texts = store(texts, "texts")
    found = components(links(members, chosen.select("id", "n_shingles", "signature"), texts, percent))
    labelled = classes.join(found, "id", "left").select(*key, F.coalesce("root", "id").alias("component"))
    out = sketched.join(labelled, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
