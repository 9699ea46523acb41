"""Best-fit packing with certified groups.

Pieces are dealt into groups of about ``GROUP_ROWS``. Each group is packed by best-fit decreasing and
compared with lower bounds from dual feasible functions. A group that meets its bound is certified: no packing of it has
fewer sequences. A group with a gap gives back its emptiest sequences, a certified one only its single
emptiest; what is given back is dealt into fewer, mixed groups and packed again, until one group is left or
nothing is given back. Only given-back pieces move after the first round.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, store, whole_text
from loglattice.llm.word_tokens import word_encoder

CAPACITY = 2048
GROUP_ROWS = 8192
ROUNDS = 12
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each document with its end id, cut into pieces of ``capacity``; the last may be shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    yield doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return arrow_map(rows, PIECE, cut)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every length and the fill of every bin.

    Bins wait in one stack per free space; a bit set of the spaces in use gives the tightest that fits.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = spaces >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            chosen = waiting[free].pop()
            if not waiting[free]:
                spaces &= ~(1 << free)
        else:
            free, chosen = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = chosen, fill[chosen]
        fill[chosen] += need
        if free > need:
            waiting[free - need].append(chosen)
            spaces |= 1 << (free - need)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the bounds: total length; large/middle items (threshold functions); rounding functions.

    A dual feasible function u has sum(u) <= 1 over any items that fit one bin, so no packing has fewer bins than
    the sum of u over all items. All arithmetic is in whole numbers.
    """
    if not len(lengths):
        return 0
    x = np.sort(lengths.astype(np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    best = -(-int(total[-1]) // capacity)
    # Items above capacity - e count as whole bins, items below e as nothing.
    for e in np.unique(x[x <= capacity // 2]):
        low, high = np.searchsorted(x, e, "left"), np.searchsorted(x, capacity - e, "right")
        best = max(best, (len(x) - int(high)) + -(-int(total[high] - total[low]) // capacity))
    # u(x) = floor((k+1) x) / k, and x itself where (k+1) x is whole; as multiples of 1 / (k * capacity).
    for k in range(1, 33):
        scaled = (k + 1) * x
        u = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int(u.sum()) // (k * capacity)))
    return max(best, int((x > capacity // 2).sum()))


def given_back(fill: np.ndarray, gap: int, capacity: int) -> np.ndarray:
    """The emptiest bins: one, and with a gap as many more as leave room to save that many bins."""
    order = np.argsort(fill, kind="stable")
    room = np.cumsum(capacity - fill[order])
    count = 1 if gap == 0 else int(np.searchsorted(room, (gap + 1) * capacity)) + 2 * gap + 1
    back = np.zeros(len(fill), bool)
    back[order[:count]] = True
    return back & (fill < capacity)


def _solver(turn: int, last: bool, names: list[str], capacity: int):
    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        bins, offsets, fill = best_fit_decreasing(group["length"].to_numpy(), capacity)
        bound = lower_bound(group["length"].to_numpy(), capacity)
        back = np.zeros(len(fill), bool) if last else given_back(fill, len(fill) - bound, capacity)
        out = group.assign(sequence_id=(turn << 56) + (int(key[0]) << 24) + bins, offset=offsets, bound=bound, back=back[bins])
        return out[[*names, "row", "sequence_id", "offset", "bound", "back"]]

    return solve


def pack(cut: DataFrame, *, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``cut`` (columns of ``pieces``) with sequence_id and offset; every piece once, no overlap, no hole."""
    waiting = store(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    done, names = [], cut.columns
    schema = f"{PIECE}, row long, sequence_id long, offset long, bound long, back boolean"
    for turn in range(rounds):
        rows = waiting.count()
        groups = max(1, math.ceil(rows / group_rows))
        last = groups == 1 or turn == rounds - 1
        grouped = waiting.withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        packed = store(grouped.groupBy("group").applyInPandas(_solver(turn, last, names, capacity), schema), f"packed-{turn}")
        done.append(packed.where("NOT back"))
        waiting = packed.where("back").select(*names, "row")
        if last or waiting.isEmpty():
            break
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out.select(*names, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, tokenizer: str, *, end_id: int = 0, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null or empty text is its end id alone. Repeated rows and ids are packed as rows of their own; equal lengths are
    placed in stored order; other columns are ignored; an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, end_id=end_id), **options)
