"""Spelling variants: dense tiles of word pairs, compared by common prefix and suffix.

1. Words and their counts: each task counts the runs of its documents, a shuffle adds the counts up.
2. Two words of which the longer has M code points are one edit apart exactly if their common prefix and suffix together reach
   M - 1. So one of them reaches half of that, and words meet below a key of that half: (M, prefix) or (M, suffix).
3. Words of a key are rows of padded matrices of code points, one aligned left, one right. Blocks of ``BLOCK`` rows
   are compared as dense tiles, column by column. A pair whose prefix reaches the half is taken below the prefix only, so it is found
   once, and each task returns counts and best words per word, never pairs.
4. A key of more than ``KEY_WORDS`` words is dealt to blocks by a hash, and pairs of blocks to tasks.
5. Every word takes its form; roots follow by pointer jumping.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, discard, store, whole_text
from loglattice.operators.lookup import lookup

# Runs, the rule of deleted code points, the words that count, and how much more frequent a form is.
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
DELETED_IN = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_TIMES = 5

BLOCK = 128
KEY_WORDS = 4096
#: Words a task counts before it hands the counts on.
HELD_WORDS = 300_000
BROADCAST_BYTES = 8 << 20


def damaged(run: str, doc_id: str) -> str:
    """The run as it counts: without one code point where the checksum of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DELETED_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def lowered(text: str) -> str:
    """A-Z in lower case, nothing else."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of words of LEAST_LENGTH or more, for rows (doc_id as text, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in Counter(RUN.findall(lowered(text.as_py()))).items():
                    if len(word) >= LEAST_LENGTH and len(word := damaged(word, doc_id)) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield from held.items()
                    held = Counter()
        yield from held.items()

    counted = arrow_map(docs.select("doc_id", "text"), "word string, n long", run, chunk=20_000)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Rows:
    """Words as columns of code points, aligned left and right; padded by -1, and as the other side of a tile by -2."""

    def __init__(self, words: list[str], n: np.ndarray) -> None:
        self.words, self.n = words, n
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<i4")
        row = np.repeat(np.arange(len(words)), self.lengths)
        ends = np.cumsum(self.lengths)
        at = np.arange(len(flat)) - (ends - self.lengths)[row]
        width = int(self.lengths.max(initial=0))
        self.left = np.full((width, len(words)), -1, np.int32)
        self.right = np.full((width, len(words)), -1, np.int32)
        self.left[at, row] = flat
        self.right[self.lengths[row] - 1 - at, row] = flat
        self.other_left, self.other_right = (np.where(m < 0, -2, m) for m in (self.left, self.right))

    def part(self, where: slice) -> Rows:
        out = object.__new__(Rows)
        out.words, out.n, out.lengths = self.words[where], self.n[where], self.lengths[where]
        out.left, out.right, out.other_left, out.other_right = (m[:, where] for m in (self.left, self.right, self.other_left, self.other_right))
        return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common starts of all columns of two padded matrices."""
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    total = np.zeros(alive.shape, np.int16)
    for k in range(min(len(a), len(b))):
        alive &= a[k][:, None] == b[k][None, :]
        if not alive.any():
            break
        total += alive
    return total


def tile(a: Rows, b: Rows, longest: np.ndarray, by_prefix: np.ndarray) -> np.ndarray:
    """Which pairs of a's and b's words are one edit apart and belong to the key: ``longest`` and ``by_prefix`` are a's keys."""
    prefix, suffix = common(a.left, b.other_left), common(a.right, b.other_right)
    m = np.maximum(a.lengths[:, None], b.lengths[None, :])
    least = m // 2
    near = np.minimum(prefix + suffix, np.minimum(a.lengths[:, None], b.lengths[None, :])) >= m - 1
    # A tile may hold several keys: the pair must be of the length of a's key, and its prefix or suffix of the key's kind.
    near &= (m == longest[:, None]) & np.where(by_prefix[:, None], prefix >= least, (suffix >= least) & (prefix < least))
    # Equal words are no pair.
    return near & ~((a.lengths[:, None] == b.lengths[None, :]) & (prefix == m))


def _best(near: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each row of ``near`` the first true column along ``order``, -1 if there is none."""
    ranked = near[:, order]
    return np.where(ranked.any(axis=1), order[ranked.argmax(axis=1)], -1)


NEAR = "word string, n_near long, best struct<n:long,word:string>"


class _Group:
    """Partial results of the words of one group."""

    def __init__(self, rows: Rows, longest: np.ndarray, by_prefix: np.ndarray, key: np.ndarray) -> None:
        self.rows, self.longest, self.by_prefix, self.key = rows, longest, by_prefix, key
        self.count = np.zeros(len(rows.words), np.int64)
        self.best = np.full(len(rows.words), -1)
        rank = sorted(range(len(rows.words)), key=lambda i: (-int(rows.n[i]), rows.words[i]))
        self.rank = np.empty(len(rank), np.int64)
        self.rank[rank] = np.arange(len(rank))

    def _take(self, at: np.ndarray, near: np.ndarray, others: np.ndarray) -> None:
        self.count[at] += near.sum(axis=1)
        best = _best(near, np.argsort(self.rank[others]))
        found = best >= 0
        mine, new = at[found], others[best[found]]
        old = self.best[mine]
        self.best[mine] = np.where((old < 0) | (self.rank[new] < self.rank[old]), new, old)

    def compare(self, a: slice, b: slice) -> None:
        near = tile(self.rows.part(a), self.rows.part(b), self.longest[a], self.by_prefix[a])
        near &= self.key[a][:, None] == self.key[b][None, :]
        if near.any():
            i, j = np.arange(a.start, a.stop), np.arange(b.start, b.stop)
            self._take(i, near, j)
            if a != b:
                self._take(j, near.T, i)

    def results(self) -> Iterator[tuple]:
        words, n = self.rows.words, self.rows.n
        for i in np.flatnonzero(self.count).tolist():
            b = int(self.best[i])
            yield words[i], int(self.count[i]), {"n": int(n[b]), "word": words[b]}


def _blocks(first: int, last: int) -> list[slice]:
    return [slice(at, min(last, at + BLOCK)) for at in range(first, last, BLOCK)]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Partial results for rows (longest, side, part, ti, tj, blk, word, n), groups one after the other.

    Small groups share a tile; a larger one is compared block by block, of two dealt blocks (ti, tj) the one with the other.
    """
    held: list[tuple] = []

    def done(rows: list[tuple]) -> Iterator[tuple]:
        keys = [r[:5] for r in rows]
        edges = [0, *[i for i in range(1, len(rows)) if keys[i] != keys[i - 1]], len(rows)]
        number = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        group = _Group(
            Rows([r[6] for r in rows], np.array([r[7] for r in rows], np.int64)),
            np.array([r[0] for r in rows], np.int64), np.array([r[1] == "p" for r in rows], bool), number,
        )
        small = 0
        for k, (first, last) in enumerate(zip(edges, edges[1:])):
            longest, _, _, ti, tj = keys[first]
            if last - first > BLOCK or ti != tj:
                if small < first:
                    group.compare(slice(small, first), slice(small, first))
                small = last
                if ti != tj:
                    cut = next((i for i in range(first, last) if rows[i][5] != ti), last)
                    for a in _blocks(first, cut):
                        for b in _blocks(cut, last):
                            group.compare(a, b)
                else:
                    blocks = _blocks(first, last)
                    for i, a in enumerate(blocks):
                        for b in blocks[i:]:
                            group.compare(a, b)
            elif last - small > BLOCK and small < first:
                group.compare(slice(small, first), slice(small, first))
                small = first
        if small < len(rows):
            group.compare(slice(small, len(rows)), slice(small, len(rows)))
        yield from group.results()

    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
            if len(held) >= 4 * BLOCK and row[:5] != held[-1][:5]:
                yield from done(held)
                held = []
            held.append(row)
    if held:
        yield from done(held)


def near_words(words: DataFrame, key_words: int = KEY_WORDS) -> DataFrame:
    """word, n_near, best (n, word) for the words (word, n) that have words one edit apart."""
    sides = F.array(*[
        F.struct((F.length("word") + more).alias("longest"), F.lit(side).alias("side"), cut(F.floor((F.length("word") + more) / 2).cast("int")).alias("part"))
        for more in (0, 1)
        for side, cut in (("p", lambda h: F.substring("word", F.lit(1), h)), ("s", lambda h: F.expr("word").substr(F.length("word") - h + 1, h)))
    ])
    keyed = words.select("word", "n", F.explode(sides).alias("k")).select("k.longest", "k.side", "k.part", "word", "n")
    key = ["longest", "side", "part"]
    sizes = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    heavy = store(sizes.where(F.col("size") > key_words), "heavy")
    zero = F.lit(0)
    blocks = F.ceil(F.col("size") / key_words).cast("int")
    marked = lookup(keyed, heavy, key, broadcast_bytes=BROADCAST_BYTES).withColumn("blk", F.when(F.col("size").isNull(), zero).otherwise(F.pmod(F.xxhash64("word"), blocks).cast("int")))
    others = F.when(F.col("size").isNull(), F.array(zero)).otherwise(F.sequence(zero, blocks - 1))
    dealt = marked.withColumn("other", F.explode(others)).select(*key, F.least("blk", "other").alias("ti"), F.greatest("blk", "other").alias("tj"), "blk", "word", "n")
    group = [*key, "ti", "tj"]
    grouped = dealt.repartition(*group).sortWithinPartitions(*group, "blk")
    partial = arrow_map(grouped, NEAR, _tiles, chunk=20_000)
    rank = F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word"))
    found = partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(rank).alias("r"))
    return found.select("word", "n_near", (-F.col("r.n")).alias("best_n"), F.col("r.word").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root for words (word, form) with a form: forms are followed to the last, doubling the distance each round.

    A form is FORM_TIMES as frequent as its word, so chains are as long as the logarithm of the largest count at most.
    """
    found = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = found.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        moved = store(lookup(found, above, ["root"], broadcast_bytes=BROADCAST_BYTES).select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        more = not moved.where("moved").isEmpty()
        discard(found)
        found = moved
        if not more:
            return found.select("word", "root")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_words: int = KEY_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters of all texts with A-Z lowered, of LEAST_LENGTH code points and LEAST_COUNT places or more, after the rule of
    ``damaged``. form is the near word of largest n (of equal ones the first in code-point order) if its n is
    FORM_TIMES the word's or more, else null; root is the last form of the chain, the word itself without a form.
    Null and empty texts have no runs; a null id counts as the empty string in the rule; repeated rows count as often
    as they occur; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), whole_text(text_col).alias("text"))
    words = store(word_counts(rows).where(F.col("n") >= LEAST_COUNT), "words")
    near = near_words(words, key_words)
    formed = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("best_n") >= FORM_TIMES * F.col("n"), F.lit(False)))
    out = store(
        formed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(F.col("has"), F.col(c)).alias(a) for c, a in (("best", "form"), ("best_n", "form_n"))]), "variants"
    )
    roots = rooted(out.where("form IS NOT NULL"))
    out = lookup(out, roots, ["word"], broadcast_bytes=BROADCAST_BYTES)
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
