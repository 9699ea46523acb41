"""Buckets compared in tiles: signatures of two blocks at a time, then full sets of the pairs left.

A bucket of documents is dealt to blocks of about ``BLOCK`` documents (fewer long ones); a tile compares the members outside
the bucket's main component (all members at first) in one block with all members of another. Pairs stay inside the
task: a tile returns one row per document that is in a pair still possible, with the list of its partners.
Verification keeps those tiles, so a text goes to a task once however many pairs it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, partitions
from loglattice.llm.simhash import Forest

BLOCK = 1024
#: Shingles in a block.
WEIGHT = 1 << 20
#: Pairs or shingles handled at once inside a tile.
SLICE = 1 << 20

_TILE = "tile long, id long, partners array<long>"


def blocks(n, weight):
    """Columns: the number of blocks for n documents of so many shingles in all."""
    return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(weight / F.lit(WEIGHT)), F.lit(1)).cast("int")


def dealt(sized: DataFrame, signatures: DataFrame) -> DataFrame:
    """Rows of tiles from bucket members (key, id, root, main, blocks, outside_blocks); main is null if all are compared with all."""
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n)).cast("int")
    outside = F.coalesce(F.col("root") != F.col("main"), F.lit(True))
    place = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("int").alias("role"))
    first = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: place(own("outside_blocks"), j, F.lit(1)))
    second = F.transform(F.sequence(F.lit(0), F.col("outside_blocks") - 1), lambda i: place(i, own("blocks"), F.lit(2)))
    single = F.array(place(F.lit(0), F.lit(0), F.when(outside, 3).otherwise(2)))
    places = F.when((F.col("blocks") == 1) & (F.col("outside_blocks") == 1), single).when(outside, F.concat(first, second)).otherwise(second)
    rows = sized.select("key", "id", "root", outside.alias("outside"), F.explode(places).alias("p"))
    rows = rows.select(F.xxhash64("key", "p.i", "p.j").alias("tile"), "key", "id", "root", "outside", F.col("p.role").alias("role"))
    return rows.join(signatures.select("id", "signature"), "id").select("tile", "key", "id", "root", "outside", "role", "signature")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one tile at a time; rows come sorted by the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        if held and held[0].column(0)[0].as_py() != int(tile[0]):
            yield pa.concat_batches(held)
            held = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(low, high - low))
            if high < len(tile):
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def _possible(left: np.ndarray, right: np.ndarray, apart: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) among those ``apart`` that no batch of the signatures rules out, and their matches."""
    step = min(least)
    if left.shape[0] * right.shape[0] <= 4096:
        matches = (left[:, None, :step] == right[None, :, :step]).sum(axis=2, dtype=np.uint8)
    else:
        matches = np.zeros((len(left), len(right)), np.uint8)
        columns = np.ascontiguousarray(right[:, :step].T)
        for k in range(step):
            matches += left[:, k, None] == columns[k]
    i, j = np.nonzero(apart & (matches >= least[step]))
    found = matches[i, j].astype(np.int64)
    for n in sorted(least)[1:]:
        for at in range(0, len(i), SLICE // step):
            part = slice(at, at + SLICE // step)
            found[part] += (left[i[part], n - step : n] == right[j[part], n - step : n]).sum(axis=1)
        alive = found >= least[n]
        i, j, found = i[alive], j[alive], found[alive]
    return i, j, found


def likeliest(i: np.ndarray, j: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the pairs of a spanning forest over 0 .. n - 1 that prefers high scores."""
    forest, kept = Forest(n), [np.zeros(0, np.int64)]
    for s in np.unique(score)[::-1]:
        at = np.flatnonzero(score == s)
        while True:
            a, b = forest.label[i[at]], forest.label[j[at]]
            apart = a != b
            if not apart.any():
                break
            at = at[apart]
            # Each larger label takes one pair to a smaller one, so no circle closes.
            _, first = np.unique(np.maximum(a, b)[apart], return_index=True)
            kept.append(at[first])
            forest.unite(i[at[first]], j[at[first]])
    return np.concatenate(kept)


def possible_pairs(rows: DataFrame, least: dict[int, int], *, forest: bool, bands: tuple[int, int] | None) -> DataFrame:
    """(tile, id, partners) of ``dealt`` rows: pairs of different components that the signatures do not rule out.

    With ``forest`` a tile keeps only the likeliest pairs that connect its documents. ``bands`` (number, rows) says that the keys are
    those of bands: a pair that agrees in an earlier band is left to the tile of that one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            tile, key = group.column(0)[0].as_py(), group.column(1).to_numpy()
            ids, root = group.column(2).to_numpy(), group.column(3).to_numpy()
            outside, role = group.column(4).to_numpy(zero_copy_only=False), group.column(5).to_numpy()
            signature = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint8).reshape(group.num_rows, -1)
            x, y = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
            found = []
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                apart = (root[part, None] != root[None, y]) & (~outside[y] | (ids[part, None] < ids[None, y]))
                i, j, matches = _possible(signature[part], signature[y], apart, least)
                found.append((part[i], y[j], matches))
            if not found:
                continue
            i, j, matches = (np.concatenate(f) for f in zip(*found, strict=True))
            if bands is not None and len(i):
                first = np.empty(len(i), np.int64)
                for at in range(0, len(i), SLICE // 16):
                    part = slice(at, at + SLICE // 16)
                    same = signature[i[part]] == signature[j[part]]
                    first[part] = same.reshape(-1, *bands).all(axis=2).argmax(axis=1)
                own = first == key[i] >> 40
                i, j, matches = i[own], j[own], matches[own]
            if forest and len(i):
                _, number = np.unique(ids, return_inverse=True)
                keep = likeliest(number[i], number[j], matches, group.num_rows)
                i, j = i[keep], j[keep]
            if len(i):
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                for who, partners in zip(ids[i[starts]].tolist(), np.split(ids[j], starts[1:]), strict=True):
                    yield tile, who, partners
                for who in np.setdiff1d(ids[j], ids[i]).tolist():
                    yield tile, who, []

    spread = rows.repartition(partitions(rows.sparkSession), "tile").sortWithinPartitions("tile")
    return arrow_map(spread, _TILE, run)


def repacked(pairs: DataFrame) -> DataFrame:
    """``possible_pairs`` with every pair in one tile only, its smallest."""
    each = pairs.select("tile", F.col("id").alias("a"), F.explode("partners").alias("b"))
    each = each.select("tile", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.min("tile").alias("tile"))
    sides = each.select("tile", F.col("a").alias("id"), "b").union(each.select("tile", F.col("b").alias("id"), F.lit(None).cast("long")))
    return sides.groupBy("tile", "id").agg(F.collect_list("b").alias("partners"))


def _shared(own: np.ndarray, tokens: np.ndarray, ends: np.ndarray, partners: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Elements that the set ``own`` has in common with each of the partners' sets."""
    marks[own] = True
    out, sizes, at = [], np.diff(ends, prepend=0)[partners], 0
    total = np.cumsum(sizes)
    while at < len(partners):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, side="right")))
        size = sizes[at:to]
        starts = np.cumsum(size) - size
        where = np.repeat((ends[partners[at:to]] - size) - starts, size) + np.arange(int(size.sum()))
        out.append(np.add.reduceat(marks[tokens[where]], starts, dtype=np.int64))
        at = to
    marks[own] = False
    return np.concatenate(out)


def verified(pairs: DataFrame, texts: DataFrame, shingles, percent: int) -> DataFrame:
    """Links (a, b) that connect what the pairs of similarity ``percent`` connect; ``shingles`` makes the set of a text."""

    def links(ids: list[int], sets: list[np.ndarray], partners: list[np.ndarray]) -> Iterator[tuple]:
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        elements, tokens = np.unique(np.concatenate(sets), return_inverse=True)
        marks, number, forest = np.zeros(len(elements), bool), {k: n for n, k in enumerate(ids)}, Forest(len(ids))
        for n, others in enumerate(partners):
            if len(others):
                other = np.array([number[int(k)] for k in others])
                other = other[forest.label[other] != forest.label[n]]
                if len(other):
                    shared = _shared(tokens[ends[n] - sizes[n] : ends[n]], tokens, ends, other, marks)
                    near = other[100 * shared >= percent * (sizes[n] + sizes[other] - shared)]
                    forest.unite(np.full(len(near), n), near)
        for n in np.flatnonzero(forest.label != np.arange(len(ids))).tolist():
            yield ids[n], ids[int(forest.label[n])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, ids, sets, partners = None, [], [], []
        for batch in batches:
            lists = batch.column(2)
            for n, (tile, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if ids and tile != held:
                    yield from links(ids, sets, partners)
                    ids, sets, partners = [], [], []
                held = tile
                ids.append(key)
                sets.append(shingles(batch.column(3)[n].as_py()))
                partners.append(lists[n].values.to_numpy())
        if ids:
            yield from links(ids, sets, partners)

    rows = pairs.join(texts, "id").select("tile", "id", "partners", "text")
    spread = rows.repartition(partitions(rows.sparkSession), "tile").sortWithinPartitions("tile")
    return arrow_map(spread, "a long, b long", run)
