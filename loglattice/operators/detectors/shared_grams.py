"""Similarities of bags of grams summed over all bags, from the sets of grams that bags share instead of from pairs of bags.

Let two bags hold s grams together and c in common, a gram as often as the smaller count says. Their similarity
c / (s - c) is the sum of 1 / C(s - 1, k) over all sets of k >= 1 common grams. So the similarities of a bag to all
others are a sum over the sets of its own grams, of the bags of each size that hold the set: work grows with the
number of bags times 2 to the power of their grams, not with the square of their number. Every term is
positive, so nothing cancels.

Grams are ordered by how many bags hold them, rarest first. Each bag goes to the groups of all its grams, with the
grams behind; a group builds all sets that begin with its gram, and a set that a single bag holds is not extended.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators.lookup import lookup
from loglattice.session import materialize

# Bags with a set that are compared in pairs instead of extending the set, at most.
FEW = 8
# Bags by set that are extended at once; a set held by more bags is extended alone.
ENTRIES = 1 << 19
# Words of 64 grams for comparing pairs, at most.
PAIR_WORDS = 8


class _Group:
    """Bags that share a gram: sizes, times and, in order, the grams behind it as offsets into ``flat``."""

    def __init__(self, size: np.ndarray, times: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> None:
        grams, self.flat = np.unique(flat, return_inverse=True)
        self.grams, self.offsets, self.ends = len(grams), offsets[:-1], offsets[1:]
        self.times = times.astype(float)
        self.sizes, self.kind = np.unique(size, return_inverse=True)
        self.most = int((self.ends - self.offsets).max(initial=0))
        self.sums = np.zeros(len(size))
        words = -(-self.grams // 64)
        self.paired = 0 < words <= PAIR_WORDS
        if self.paired:
            bits = np.left_shift(np.uint64(1), (np.arange(64 * words) % 64).astype(np.uint64))
            # held[w, bag]: its grams; above[w, gram]: the grams behind.
            self.held = np.zeros((words, len(size)), dtype=np.uint64)
            rows = np.repeat(np.arange(len(size)), self.ends - self.offsets)
            np.bitwise_or.at(self.held, (self.flat // 64, rows), bits[self.flat])
            gram = np.arange(self.grams)
            of = np.arange(64 * words)
            behind = np.where(of[None, :] > gram[:, None], bits[None, :], np.uint64(0))
            self.above = np.bitwise_or.reduce(behind.reshape(self.grams, words, 64), axis=2).T.copy()
        self.shares: dict[int, np.ndarray] = {}
        self.weights: dict[int, np.ndarray] = {}

    def weight(self, k: int) -> np.ndarray:
        """1 / C(s - 1, k) by the sizes of two bags that hold a set of k grams."""
        if k not in self.weights:
            self.weights[k] = np.array([[1 / (comb(int(a + b) - 1, k) or np.inf) for b in self.sizes] for a in self.sizes])
        return self.weights[k]

    def share(self, k: int) -> np.ndarray:
        """The same summed over all sets that extend one of k grams by some of r more, by sizes and r."""
        if k not in self.shares:
            table = np.zeros((len(self.sizes), len(self.sizes), self.most + 1))
            for r in range(self.most + 1):
                table[:, :, r] = sum(comb(r, j) * self.weight(k + j) for j in range(r + 1))
            self.shares[k] = table.reshape(-1, self.most + 1)
        return self.shares[k]

    def _add(self, rows: np.ndarray, values: np.ndarray) -> None:
        if len(rows) * 8 < len(self.sums):
            np.add.at(self.sums, rows, values)
        else:
            self.sums += np.bincount(rows, values, minlength=len(self.sums))

    def _counted(self, k: int, node: np.ndarray, rows: np.ndarray) -> None:
        """Adds to each bag of a set the other bags that hold it."""
        kinds, weight = len(self.sizes), self.weight(k)
        times, kind = self.times[rows], self.kind[rows]
        held = np.bincount(node * kinds + kind, times, minlength=(int(node[-1]) + 1) * kinds).reshape(-1, kinds)
        self._add(rows, (held @ weight)[node, kind] - times * weight[kind, kind])

    def _compared(self, k: int, rows: np.ndarray, last: np.ndarray) -> None:
        """Adds to the bags of sets, a column of ``rows`` each, all that they share beyond the set ``last`` ends."""
        table, kinds = self.share(k), len(self.sizes)
        own = [h[rows] & a[last] for h, a in zip(self.held, self.above)]
        times, kind = self.times[rows], self.kind[rows]
        out = np.zeros(rows.shape)
        for i in range(1, len(rows)):
            for j in range(i):
                common = sum(np.bitwise_count(w[i] & w[j]) for w in own)
                found = table[kind[i] * kinds + kind[j], common]
                out[i] += found * times[j]
                out[j] += found * times[i]
        self._add(rows.ravel(), out.ravel())

    def run(self) -> np.ndarray:
        """For each bag, the similarities to the other bags so far as they come from sets that begin with the group's gram."""
        if len(self.sums) > 1:
            rows = np.arange(len(self.sums))
            todo = self._settled(1, np.zeros(len(rows), dtype=np.int64), rows, self.offsets)
            while todo:
                k, *entries = todo.pop()
                todo += self._settled(k + 1, *self._extended(*entries))
        return self.sums

    def _settled(self, k: int, node: np.ndarray, rows: np.ndarray, at: np.ndarray) -> list[tuple]:
        """Adds what sets of k grams give (set number, bag, place behind the last gram); returns what is left to extend, in parts."""
        if not len(node):
            return []
        heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        counts = np.diff(np.r_[heads, len(node)])
        if self.paired and k > 1:
            for n in range(2, FEW + 1):
                chosen = heads[counts == n]
                if len(chosen):
                    self._compared(k, rows[chosen + np.arange(n)[:, None]], self.flat[at[chosen] - 1])
            many = counts > FEW
            keep = np.repeat(many, counts)
            node, rows, at = np.repeat(np.arange(int(many.sum())), counts[many]), rows[keep], at[keep]
            if not len(node):
                return []
        self._counted(k, node, rows)
        more = np.cumsum(self.ends[rows] - at)
        heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        before = np.r_[0, more][heads]
        parts, start = [], 0
        while start < len(heads):
            stop = max(start + 1, int(np.searchsorted(before, before[start] + ENTRIES, side="right")) - 1)
            if stop >= len(heads) - 1 and more[-1] - before[start] <= ENTRIES:
                stop = len(heads)
            part = slice(heads[start], heads[stop] if stop < len(heads) else len(node))
            parts.append((k, node[part], rows[part], at[part]))
            start = stop
        return parts

    def _extended(self, node: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sets one gram longer that at least two bags hold."""
        more = self.ends[rows] - at
        total = int(more.sum())
        source = np.repeat(np.arange(len(rows), dtype=np.int32), more)
        place = np.arange(total) + np.repeat(at - (np.cumsum(more) - more), more)
        sets = (node - node[:1])[source] * self.grams + self.flat[place]
        bits = total.bit_length()
        if total and int(node[-1] - node[0] + 1) * self.grams < 1 << (62 - bits):
            # Sets and places in one number each: sorting values is faster than sorting places.
            sets = (sets << bits) | np.arange(total)
            sets.sort()
            order = sets & ((1 << bits) - 1)
            sets >>= bits
        else:
            order = np.argsort(sets, kind="stable")
            sets = sets[order]
        heads = np.flatnonzero(np.r_[True, sets[1:] != sets[:-1]]) if total else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.r_[heads, total])
        shared = counts > 1
        order = order[np.repeat(shared, counts)]
        return np.repeat(np.arange(int(shared.sum())), counts[shared]), rows[source[order]], place[order] + 1


def group_sums(table: pa.Table) -> pa.Table:
    """Group function of one gram: similarities of its bags as far as they come from sets that begin with it."""
    table = table.combine_chunks()
    rest = table.column("rest").chunk(0)
    offsets = rest.offsets.to_numpy().astype(np.int64)
    flat = rest.values.to_numpy()[offsets[0] : offsets[-1]]
    size, times = (table.column(c).to_numpy() for c in ("size", "times"))
    return pa.table({"did": table.column("did"), "s": _Group(size, times, flat, offsets - offsets[0]).run()})


def shared_sums(distinct: DataFrame) -> DataFrame:
    """``(did, s)``: similarity to all bags, for a stored ``distinct (did, times, bag, grams)``."""
    cells = distinct.select("did", "times", "grams", F.explode("bag").alias("g")).select(
        "did", "times", "grams", "g.gram", F.explode(F.sequence(F.lit(1).cast("long"), F.col("g.c"))).alias("nth")
    )
    counts = cells.groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "gram", "nth")
    codes = materialize(counts.select("gram", "nth", F.monotonically_increasing_id().alias("code")))
    coded = lookup(cells, codes, ["gram", "nth"], "inner").groupBy("did", "times", "grams")
    bags = coded.agg(F.array_sort(F.collect_list("code")).alias("codes"))
    each = bags.select("did", "times", F.col("grams").alias("size"), "codes", F.posexplode("codes").alias("i", "gram"))
    each = each.select("did", "times", "size", "gram", F.slice("codes", F.col("i") + 2, F.size("codes")).alias("rest"))
    parallel = distinct.sparkSession.sparkContext.defaultParallelism
    partial = each.repartition(16 * parallel, "gram").groupBy("gram").applyInArrow(group_sums, "did long, s double")
    # A bag is as similar to its equals as to itself.
    equal = distinct.select("did", F.col("times").cast("double").alias("s"))
    return equal.unionByName(partial).groupBy("did").agg(F.sum("s").alias("s"))
