"""SimHash near-duplicates: a self-join of binary tries of the fingerprints.

1. A fingerprint has the bits that more than half of the document's shingle hashes have. Equal fingerprints are a class.
2. Two fingerprints within BUDGET bits agree in one of BUDGET + 1 blocks of bits. So each fingerprint enters BUDGET + 1 tries, turned
   so that another block comes first, and only pairs below one node at the depth of that block can link.
3. A task takes whole nodes of that depth and traverses pairs of nodes together, from each node paired with itself: the
   halves of both are paired, bits that differ add up, and a pair beyond the budget goes. Small pairs are compared
   fingerprint by fingerprint. Links found leave the task as a spanning forest, so a dense group gives no square of rows.
4. A node of more than ``NODE_ROWS`` fingerprints is not given to a task: the same traversal runs on the table of its nodes, ``STEP`` bits
   at a time, until pairs are small enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, store, whole_text
from loglattice.llm.components import components
from loglattice.operators.lookup import lookup

# Words of a shingle, the hash's seed, bits that may differ.
WORDS = 3
SEED = 42
BUDGET = 3

BITS = 64
BLOCK = BITS // (BUDGET + 1)
STEP = 8
NODE_ROWS = 100_000
#: A task traverses this many fingerprints at once (or one node), and this many node pairs.
TASK_ROWS = 50_000
FRONT = 100_000
#: Pairs of nodes with at most so many pairs of fingerprints are compared directly.
DIRECT = 64
#: Direct comparisons, and links held before they are joined.
SLICE = 1 << 20
U64 = np.uint64


def fingerprint(text: str) -> int:
    """The SimHash of a whole text as a signed number; 0 without words. Only A-Z are lower-cased, repeats count."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WORDS + 1)
    begin, end = starts[:n].tolist(), ends[len(ends) - n :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = [xxhash.xxh64_intdigest(joined[b:e], SEED) for b, e in zip(begin[at : at + (1 << 16)], end[at : at + (1 << 16)], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > n, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield doc_id, fingerprint(text.as_py())

    return arrow_map(docs.select("doc_id", "text"), "doc_id long, fp long", run)


class Forest:
    """Groups of 0 .. n - 1 that grow as links arrive; the smallest number stands for a group."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                above = self.label[self.label]
                if (above == self.label).all():
                    break
                self.label = above


def _compared(values: np.ndarray, pairs: np.ndarray, budget: int, forest: Forest) -> None:
    """Compare all fingerprints of pairs of nodes (a0, a1, b0, b1), of a node with itself those after one another."""
    sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    ends = np.cumsum(sizes)
    at = 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        part, size = pairs[at:to], sizes[at:to]
        row = np.repeat(np.arange(len(part)), size)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        width = (part[:, 3] - part[:, 2])[row]
        i, j = part[row, 0] + inside // width, part[row, 2] + inside % width
        near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        forest.unite(i[near], j[near])
        at = to


def trie_forest(values: np.ndarray, nodes: np.ndarray, depth: int, budget: int = BUDGET) -> Forest:
    """Links of ascending ``values`` between the intervals of ``nodes`` (a0, a1, b0, b1, differing bits so far).

    An interval holds the values below one trie node of ``depth`` (bits from the top).
    """
    forest = Forest(len(values))
    waiting = [(nodes, depth)]
    ones: dict[int, np.ndarray] = {}
    while waiting:
        front, bit = waiting.pop()
        if len(front) > FRONT:
            waiting += [(front[:FRONT], bit), (front[FRONT:], bit)]
            continue
        small = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2]) <= (DIRECT if bit < BITS else np.iinfo(np.int64).max)
        _compared(values, front[small, :4], budget, forest)
        front = front[~small]
        if not len(front):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((values >> U64(BITS - 1 - bit)) & U64(1))]).astype(np.int64)
        count = ones[bit]
        a0, a1, b0, b1, differ = front.T
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        other = a0 != b0
        pairs = [
            np.stack([a0, am, b0, bm, differ], 1), np.stack([am, a1, bm, b1, differ], 1),
            np.stack([a0, am, bm, b1, differ + 1], 1), np.stack([am, a1, b0, bm, differ + 1], 1)[other],
        ]
        after = np.concatenate(pairs)
        itself = (after[:, 0] == after[:, 2]) & (after[:, 1] - after[:, 0] < 2)
        after = after[(after[:, 1] > after[:, 0]) & (after[:, 3] > after[:, 2]) & (after[:, 4] <= budget) & ~itself]
        if len(after):
            waiting.append((after, bit + 1))
    return forest


def turned(fp: Column, turn: int) -> Column:
    """``fp`` with its bits moved up by ``turn`` blocks, the top ones coming in below."""
    by = turn * BLOCK
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by)) if by else fp


def _back(values: np.ndarray, turn: np.ndarray) -> np.ndarray:
    by = turn.astype(U64) * U64(BLOCK)
    return np.where(by == 0, values, (values >> by) | (values << ((U64(BITS) - by) % U64(BITS)))).view(np.int64)


def _linked(values: np.ndarray, turns: np.ndarray, forest: Forest) -> pa.RecordBatch:
    own = _back(values, turns)
    moved = forest.label != np.arange(len(values))
    return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[forest.label[moved]])], names=["a", "b"])


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links below the nodes of depth BLOCK, for rows (turn, value), all of a node together; ``bits`` is the value turned."""
    turns, bits = np.zeros(0, np.int64), np.zeros(0, U64)

    def done(turns: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        node = (turns.astype(U64) << U64(BLOCK)) | (bits >> U64(BITS - BLOCK))
        order = np.lexsort((bits, node))
        turns, bits, node = turns[order], bits[order], node[order]
        edges = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        a0, a1 = edges[:-1], edges[1:]
        wide = a1 - a0 > 1
        pairs = np.stack([a0, a1, a0, a1, np.zeros_like(a0)], 1)[wide]
        return _linked(bits, turns, trie_forest(bits, pairs, BLOCK))

    for batch in batches:
        turns = np.concatenate([turns, batch.column(0).to_numpy().astype(np.int64)])
        bits = np.concatenate([bits, batch.column(1).to_numpy().view(U64)])
        if len(bits) >= TASK_ROWS:
            node = (turns.astype(U64) << U64(BLOCK)) | (bits >> U64(BITS - BLOCK))
            end = int(np.flatnonzero(node != node[-1])[-1]) + 1 if (node != node[-1]).any() else 0
            if end:
                yield done(turns[:end], bits[:end])
                turns, bits = turns[end:], bits[end:]
    if len(bits):
        yield done(turns, bits)


def _pair_links(depth: int):
    """Function from the members (turn, u, v, differ, bits) of pairs of nodes of ``depth`` to their links."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (turn, u, v), own in group.groupby(["turn", "u", "v"]):  # two pairs may share a task's hash
            bits = np.sort(own["bits"].to_numpy(np.int64).view(U64))
            upper = max(int(x) & (1 << BITS) - 1 for x in (u, v))
            mid = int(np.searchsorted(bits >> U64(BITS - depth), U64(upper))) if u != v else 0
            first = [0, mid or len(bits), mid, len(bits), int(own["differ"].iloc[0])]
            batch = _linked(bits, np.full(len(bits), turn), trie_forest(bits, np.array([first]), depth))
            out.append(batch.to_pandas())
        return pd.concat(out)

    return run


def _heavy_links(rows: DataFrame, heavy: DataFrame, node_rows: int) -> DataFrame:
    """Links below the nodes ``heavy`` (turn, node) of depth BLOCK: the traversal on tables of nodes, STEP bits at a time."""
    node = lambda depth: F.shiftrightunsigned("bits", BITS - depth)
    pairs = heavy.select("turn", F.col("node").alias("u"), F.col("node").alias("v"))
    found = []
    for depth in range(BLOCK + STEP, BITS + 1, STEP):
        asked = pairs.select("turn", F.col("u").alias("parent")).union(pairs.select("turn", "v")).distinct()
        tagged = rows.select("turn", "bits", node(depth - STEP).alias("parent"), node(depth).alias("child"))
        counts = tagged.groupBy("turn", "parent", "child").agg(F.count(F.lit(1)).alias("n"))
        children = store(lookup(counts, store(asked, "asked"), ["turn", "parent"], "left_semi"), "children")
        side = lambda s: children.select("turn", F.col("parent").alias(s), F.col("child").alias(f"c{s}"), F.col("n").alias(f"n{s}"))  # noqa: B023, E731
        split = pairs.join(side("u"), ["turn", "u"]).join(side("v"), ["turn", "v"])
        differ = F.bit_count(F.col("cu").bitwiseXOR(F.col("cv")))
        split = split.where((differ <= BUDGET) & ((F.col("u") != F.col("v")) | (F.col("cu") <= F.col("cv"))) & ((F.col("cu") != F.col("cv")) | (F.col("nu") > 1)))
        split = store(split.select("turn", F.col("cu").alias("u"), F.col("cv").alias("v"), "nu", "nv", differ.alias("differ")), "node-pairs")
        ready = (F.col("nu") + F.col("nv") <= node_rows) | F.lit(depth == BITS)
        now = split.where(ready).withColumn("task", F.xxhash64("turn", "u", "v"))
        ends = F.explode(F.when(F.col("u") == F.col("v"), F.array("u")).otherwise(F.array("u", "v"))).alias("child")
        members = tagged.join(now.select("turn", "task", "u", "v", "differ", ends), ["turn", "child"])

        found.append(store(members.select("task", "turn", "u", "v", "differ", "bits").groupBy("task").applyInPandas(_pair_links(depth), "a long, b long"), "heavy-links"))
        pairs = split.where(~ready).select("turn", "u", "v")
        if pairs.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def links(classes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within BUDGET bits."""
    tries = F.array(*[F.struct(F.lit(t).alias("turn"), turned(F.col("fp"), t).alias("bits")) for t in range(BUDGET + 1)])
    rows = classes.select(F.explode(tries).alias("x")).select("x.turn", "x.bits", F.shiftrightunsigned("x.bits", BITS - BLOCK).alias("node"))
    heavy = store(rows.groupBy("turn", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_rows).select("turn", "node"), "heavy")
    none = heavy.isEmpty()
    light = rows if none else lookup(rows, heavy, ["turn", "node"], "left_anti")
    dealt = light.repartition("turn", "node").sortWithinPartitions("turn", "node").select("turn", "bits")
    found = dealt.mapInArrow(_light, "a long, b long")
    return found if none else found.unionByName(_heavy_links(lookup(rows, heavy, ["turn", "node"], "left_semi"), heavy, node_rows))


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, kept.

    Fingerprints of at most BUDGET differing bits are linked; component_id is the smallest id reachable. Null, empty and blank
    texts have fingerprint zero, which is linked like any other. A null id is no component_id: such a row gets the
    smallest other id reachable, and null if there is none. Repeated rows and ids give repeated rows, each with the component of
    its own text. Texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    prints = store(fingerprints(rows), "fingerprints")
    classes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    found = components(links(classes, node_rows))
    rooted = store(classes.join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "id"), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    # Many documents may share a fingerprint: the skew join splits them, or the table of classes is broadcast if small.
    named = store(rooted.join(least, "root").select("fp", "component_id"), "named")
    out = lookup(prints, named, ["fp"], "inner", broadcast_bytes=8 << 20)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select("doc_id", hexed, "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
