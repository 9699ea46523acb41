"""Outlier scores from the similarity of a sequence to all the others.

Equal sequences (for n-grams: equal bags of grams) are collapsed first, with their
multiplicity. What shares nothing has similarity 0, so an inverted index decides what meets: each distinct one
has a set of tokens (states, or grams); ordered by their rarest token they are cut into blocks of bounded size, postings
name the blocks of each token, and only pairs of blocks with a common token become tiles. In a tile, bags are
compared along the postings of the grams they share or several in one number, sequences 64 at once by one dynamic programme per prefix. Only one partial sum per
sequence leaves a tile: no pair of sequences becomes a row, and no task holds more than two blocks. Many small bags
are not compared at all (see ``shared_grams``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.similarity import ngrams
from loglattice.operators import ordered as o
from loglattice.operators.detectors.shared_grams import shared_sums
from loglattice.operators.lookup import lookup
from loglattice.operators.sequences import as_arrays
from loglattice.operators.thresholds import flag
from loglattice.session import materialize

BLOCK = 16384
# The same for LCS: a sequence is copied once per block, so blocks are large.
LCS_BLOCK = 1 << 17
# Nodes or rows that are compared at once: sequences, and bags.
PIECE = 512
TILE = 2048
# Words of 64 sequences that are compared at once with one node, at most, and bytes of their masks. Bits of nodes: bytes that
# caches hold, bytes of one position that are worth a call, and bytes at most.
WORDS = 128
MASK_BYTES = 1 << 25
PLANE_BYTES = 1 << 21
POSITION_BYTES = 1 << 17
HELD_BYTES = 1 << 26
# Bags below this size are compared several at a time in one number.
PACKED_GRAMS = 256
# States, or distinct grams, of a block.
BLOCK_TOKENS = 1 << 22
# A token in more blocks than this is heavy: all blocks with a heavy token meet, without a list for each token.
HEAVY_BLOCKS = 64
# Shared postings cost about as much as so many cells of a dense product.
POSTING_CELLS = 24
# A set of grams of a bag costs about as much as so many pairs of bags.
SET_PAIRS = 6
# Fixed value: the score of a sequence that resembles no other.
DISSIMILAR = 100000.0


class Ragged:
    """Sequences of one block: flat states with offsets."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        self.flat, self.offsets = flat, offsets
        self.lengths = np.diff(offsets)

    def take(self, rows: np.ndarray) -> Ragged:
        lengths = self.lengths[rows]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        shift = np.repeat(self.offsets[:-1][rows] - offsets[:-1], lengths)
        return Ragged(self.flat[np.arange(offsets[-1]) + shift], offsets)

    def only(self, states: np.ndarray) -> Ragged:
        """The sequences without other states than ``states``."""
        keep = np.isin(self.flat, states)
        return Ragged(self.flat[keep], np.concatenate([[0], np.cumsum(keep)])[self.offsets])

    def padded(self, fill: int) -> np.ndarray:
        out = np.full((len(self.lengths), int(self.lengths.max(initial=0))), fill, dtype=np.int64)
        row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        out[row, np.arange(len(self.flat)) - self.offsets[:-1][row]] = self.flat
        return out


class LaneSums:
    """Sums of bit planes lane by lane, weighted by whole numbers: planes of equal value are added up as bits, three to two."""

    def __init__(self, most: int = 1024) -> None:
        self.held: list[list[np.ndarray]] = []
        self.most = most

    def add(self, planes: np.ndarray, weights: np.ndarray) -> None:
        for k in range(int(weights.max(initial=0)).bit_length()):
            here = (weights >> k) & 1 == 1
            self._put(planes if here.all() else planes[here], k)

    def _put(self, planes: np.ndarray, k: int) -> None:
        while len(self.held) <= k:
            self.held.append([])
        self.held[k].append(planes)
        if sum(map(len, self.held[k])) >= self.most:
            self._fold(k)

    def _fold(self, k: int) -> None:
        planes = np.concatenate(self.held[k])
        while len(planes) > 2:
            third = len(planes) // 3
            x, y, z = planes[:third], planes[third : 2 * third], planes[2 * third : 3 * third]
            one = x ^ y
            carry = x & y
            carry |= one & z
            one ^= z
            self._put(carry, k + 1)
            planes = np.concatenate([one, planes[3 * third :]])
        self.held[k] = [planes]

    def total(self, lanes: int) -> np.ndarray:
        out = np.zeros(lanes)
        k = 0
        while k < len(self.held):
            if self.held[k]:
                self._fold(k)
                for plane in self.held[k][0]:
                    out += np.ldexp(np.unpackbits(plane.view(np.uint8), bitorder="little")[:lanes].astype(float), k)
            k += 1
        return out


def lcs_gains(a: Ragged, b: Ragged) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """LCS lengths of all pairs as bits: which states of a sequence of ``b`` lengthen its LCS with which sequences of ``a``.

    Sequences of ``a`` are lanes, 64 in a word. A cell of the dynamic programme has one bit of difference to the cell on its left
    and one to the cell above, so a state of ``b`` is four operations on bits per position of ``a``. Sequences of ``b`` in order
    form a prefix trie, whose nodes are worked out once. States that only one side has match nothing and are left out. A
    piece is a range of ``a``, the rows of ``b`` in order, for some nodes of one depth the range of these rows below each, and a
    plane of bits per node; the LCS length is the number of bits along the path.
    """
    states = np.intersect1d(a.flat, b.flat)
    a, b = a.only(states), b.only(states)
    coded_a, coded_b = (Ragged(np.searchsorted(states, x.flat), x.offsets) for x in (a, b))
    longest = int(a.lengths.max(initial=0))
    steps = coded_b.padded(len(states))
    rows = np.lexsort(steps.T[::-1]) if steps.shape[1] else np.arange(len(steps))
    steps = steps[rows]
    _, firsts, parents = trie(steps)
    ends, letters, before = [], [], np.zeros(1, dtype=np.int64)
    for p, first in enumerate(firsts):
        # Sequences that have ended have no nodes.
        letter = steps[first, p]
        going = letter < len(states)
        ends.append(np.append(first[1:], len(rows))[going])
        firsts[p], parents[p] = first[going], before[parents[p][going]]
        letters.append(letter[going])
        before = np.cumsum(going) - 1
    wide = max(1, min(WORDS, MASK_BYTES // (8 * max(1, longest) * max(1, len(states)))))
    for low in range(0, len(a.lengths), 64 * wide):
        near = slice(low, min(low + 64 * wide, len(a.lengths)))
        one = coded_a.take(np.arange(near.start, near.stop))
        lane = np.repeat(np.arange(len(one.lengths)), one.lengths)
        at = np.arange(len(one.flat)) - one.offsets[:-1][lane]
        # mask[i, s]: the lanes with state s at position i.
        mask = np.zeros((longest, len(states), -(-len(one.lengths) // 64)), dtype=np.uint64)
        np.bitwise_or.at(mask, (at, one.flat, lane // 64), np.left_shift(np.uint64(1), (lane % 64).astype(np.uint64)))
        for p, nodes, planes in _walk(mask, parents, letters):
            yield near, rows, firsts[p][nodes], ends[p][nodes], planes


def _walk(mask: np.ndarray, parents: list[np.ndarray], letters: list[np.ndarray]) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Depth, range of nodes and their planes; at most ``PIECE`` nodes at once, parents before children."""
    longest, _, words = mask.shape
    held = max(PLANE_BYTES, min(POSITION_BYTES * longest, HELD_BYTES))
    most = max(1, min(PIECE, held // (8 * max(1, longest) * words)))
    # Nodes low to high of the depth above p, and their difference to the left at each position.
    todo = [(0, 0, 1, np.zeros((longest, 1, words), dtype=np.uint64))]
    while todo:
        p, low, high, left = todo.pop()
        while p < len(parents):
            start, stop = np.searchsorted(parents[p], [low, high])
            if start == stop:
                break
            if stop - start > most and high - low > 1:
                cuts = [low]
                while cuts[-1] < high:
                    after = np.searchsorted(parents[p], cuts[-1]) + max(1, most // 2)
                    cuts.append(max(cuts[-1] + 1, int(parents[p][after])) if after < stop else high)
                todo += [(p, x, y, left[:, x - low : y - low]) for x, y in reversed(list(zip(cuts[:-1], cuts[1:])))]
                break
            above, letter = parents[p][start:stop] - low, letters[p][start:stop]
            # No difference to the row above, one bit per lane: at first all ones.
            same = np.full((stop - start, words), np.iinfo(np.uint64).max)
            met, either = np.empty_like(same), np.empty_like(same)
            deepest = p + 1 == len(parents)
            lefts = np.empty((1 if deepest else longest, stop - start, words), dtype=np.uint64)
            for i in range(longest):
                here = lefts[0 if deepest else i]
                left[i].take(above, axis=0, out=here, mode="clip")
                mask[i].take(letter, axis=0, out=met, mode="clip")
                if deepest:
                    # met ? here : here | same
                    np.bitwise_and(same, np.invert(met, out=met), out=same)
                    np.bitwise_or(same, here, out=same)
                else:
                    np.bitwise_xor(here, same, out=either)
                    np.bitwise_or(here, met, out=here)
                    np.bitwise_and(here, same, out=here)
                    np.bitwise_xor(here, either, out=same)
            yield p, slice(start, stop), np.invert(same, out=same)
            p, low, high, left = p + 1, int(start), int(stop), lefts


def lcs_matrix(a: Ragged, b: Ragged) -> np.ndarray:
    """LCS lengths of all pairs."""
    steps = np.zeros((len(b.lengths) + 1, len(a.lengths)), dtype=np.int64)
    rows = np.arange(len(b.lengths))
    for near, rows, starts, ends, planes in lcs_gains(a, b):
        bits = np.unpackbits(planes.view(np.uint8), axis=1, bitorder="little")[:, : near.stop - near.start].astype(np.int64)
        steps[starts, near] += bits
        steps[ends, near] -= bits
    out = np.zeros((len(a.lengths), len(b.lengths)), dtype=np.int64)
    out[:, rows] = np.cumsum(steps, axis=0)[:-1].T
    return out


def trie(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Prefix trie of sorted rows of equal width.

    Per depth the first row of each node and the node above it; and the deepest node of each row.
    """
    above, firsts, parents = np.zeros(len(rows), dtype=np.int64), [], []
    changed = np.zeros(len(rows), dtype=bool)
    changed[:1] = True
    for p in range(rows.shape[1]):
        changed[1:] |= rows[1:, p] != rows[:-1, p]
        first = np.flatnonzero(changed)
        firsts.append(first)
        parents.append(above[first])
        above = np.cumsum(changed) - 1
    return above, firsts, parents


def _ragged(states: pa.ListArray) -> Ragged:
    offsets = states.offsets.to_numpy().astype(np.int64)
    flat = states.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return Ragged(flat, offsets - offsets[0])


def _lane_groups(lengths: np.ndarray, times: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lanes by length and by bit of their times: (length, bit, words, mask)."""
    out = []
    for length in np.unique(lengths):
        own = np.where(lengths == length, times, 0)
        for k in range(int(own.max()).bit_length()):
            bits = np.packbits((own >> k) & 1 == 1, bitorder="little")
            words = np.pad(bits, (0, -len(bits) % 8)).view(np.uint64)
            at = np.flatnonzero(words)
            if len(at):
                out.append((int(length), k, at, words[at]))
    return out


def lcs_sums(left: pa.Table, right: pa.Table, both: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Similarities LCS / sqrt(length * length) summed over the other block, for ``left`` and, with ``both``, for ``right``.

    LCS lengths are added up per length of the other sequence, as whole numbers, and only those sums are divided.
    """
    a, b = (_ragged(t.column("states").chunk(0)) for t in (left, right))
    times_a, times_b = (t.column("times").to_numpy().astype(np.int64) for t in (left, right))
    # Lanes in order of their length and times, so that few words have several of them.
    order = np.lexsort((times_a, a.lengths))
    a, times_a = a.take(order), times_a[order]
    lengths_a = np.unique(a.lengths)
    lengths_b, kind_b = np.unique(b.lengths, return_inverse=True)
    of_a = np.zeros((len(lengths_b), len(order)))
    # Differences from row to row of ``b``, in the order of the trie.
    steps_b = np.zeros((len(lengths_a), len(times_b) + 1), dtype=np.int64)
    rows, seen, lanes, sums = np.arange(len(times_b)), None, [], {}
    upto: np.ndarray | None = None

    def finish() -> None:
        for g, found in sums.items():
            of_a[g, seen] = found.total(seen.stop - seen.start)

    for near, rows, starts, ends, planes in lcs_gains(a, b):
        if upto is None:
            # upto[g, i]: the times of rows of length g before i.
            kinds = kind_b[rows]
            upto = np.zeros((len(lengths_b), len(rows) + 1), dtype=np.int64)
            upto[kinds, np.arange(1, len(rows) + 1)] = times_b[rows]
            np.cumsum(upto, axis=1, out=upto)
        if seen != near:
            finish()
            seen, sums = near, {}
            lanes = _lane_groups(a.lengths[near], times_a[near]) if both else []
        below = upto[:, ends[-1]] - upto[:, starts[0]]
        for g in np.flatnonzero(below):
            times = upto[g, ends] - upto[g, starts]
            here = times > 0
            sums.setdefault(g, LaneSums()).add(*((planes, times) if here.all() else (planes[here], times[here])))
        for length, k, words, mask in lanes:
            own = planes if len(words) == planes.shape[1] else planes[:, words]
            found = np.bitwise_count(own & mask).sum(axis=1, dtype=np.int64) << k
            h = np.searchsorted(lengths_a, length)
            steps_b[h, starts] += found
            steps_b[h, ends] -= found
    finish()
    sums_a = np.zeros(len(order))
    sums_a[order] = (of_a / np.sqrt(lengths_b[:, None].astype(float) * a.lengths[None, :])).sum(axis=0)
    if not both:
        return sums_a, None
    lcs_b = np.cumsum(steps_b, axis=1)[:, :-1]
    sums_b = np.zeros(len(times_b))
    sums_b[rows] = (lcs_b / np.sqrt(lengths_a[:, None].astype(float) * b.lengths[rows][None, :])).sum(axis=0)
    return sums_a, sums_b


def _entries(left: pa.Table, right: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, gram number, count) of each side, over the grams both sides have."""
    sides = []
    for table in (left, right):
        bags = table.column("bag").chunk(0)
        inside = bags.flatten()
        rows = np.repeat(np.arange(len(bags)), np.diff(bags.offsets.to_numpy()))
        sides.append((rows, inside.field("gram"), inside.field("c").to_numpy()))
    coded = pa.chunked_array([sides[0][1], sides[1][1]]).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    ca, cb = codes[: len(sides[0][0])], codes[len(sides[0][0]) :]
    shared = np.intersect1d(ca, cb)
    out = []
    for (rows, _, counts), c in zip(sides, (ca, cb)):
        keep = np.isin(c, shared)
        out.append((rows[keep], np.searchsorted(shared, c[keep]), counts[keep]))
    return out


def _common(ca: np.ndarray, cb: np.ndarray, levels: int = 32) -> np.ndarray:
    """Sum over grams of the smaller count: indicator products per level, then the rest."""
    out = np.zeros((len(ca), len(cb)))
    low_a, low_b = np.minimum(ca, levels), np.minimum(cb, levels)
    for t in range(1, levels + 1):
        live = (low_a >= t).any(axis=0) & (low_b >= t).any(axis=0)
        if not live.any():
            break
        out += (low_a[:, live] >= t).astype(np.float32) @ (low_b[:, live] >= t).astype(np.float32).T
    over = np.flatnonzero((ca > levels).any(axis=0) & (cb > levels).any(axis=0))
    for g in over:
        out += np.minimum.outer(np.maximum(ca[:, g] - levels, 0), np.maximum(cb[:, g] - levels, 0))
    return out


def _along_postings(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shape: tuple[int, int], match: str) -> np.ndarray:
    """Common grams of all pairs, added up along the two postings of each shared gram."""
    out = np.zeros(shape)
    lists = []
    for rows, gram, counts in sides:
        order = np.argsort(gram, kind="stable")
        ends = np.cumsum(np.bincount(gram))
        lists.append((rows[order], counts[order].astype(float), ends))
    (rows_a, counts_a, ends_a), (rows_b, counts_b, ends_b) = lists
    for g in range(len(ends_a)):
        a, b = (slice(ends[g - 1] if g else 0, ends[g]) for ends in (ends_a, ends_b))
        both = (np.minimum if match == "bag" else np.multiply).outer(counts_a[a], counts_b[b])
        out[np.ix_(rows_a[a], rows_b[b])] += both
    return out


def ngram_tile(n: int, match: str, width: int = 2048) -> Callable[[pa.Table, pa.Table], np.ndarray]:
    """Similarities of two blocks of gram bags: along the postings if those are few, else ``width`` grams at a time."""

    def tile(left: pa.Table, right: pa.Table) -> np.ndarray:
        sides = _entries(left, right)
        grams = 1 + max((int(g.max(initial=-1)) for _, g, _ in sides), default=-1)
        shape = (left.num_rows, right.num_rows)
        postings = [np.bincount(g, minlength=grams).astype(float) for _, g, _ in sides]
        if not grams:
            c = np.zeros(shape)
        elif float(postings[0] @ postings[1]) * POSTING_CELLS < shape[0] * shape[1] * grams:
            c = _along_postings(sides, shape, match)
        else:
            c = np.zeros(shape)
            for start in range(0, grams, width):
                dense = []
                for (rows, gram, counts), table in zip(sides, (left, right)):
                    now = (gram >= start) & (gram < start + width)
                    m = np.zeros((table.num_rows, min(width, grams - start)), dtype=np.int64)
                    m[rows[now], gram[now] - start] = counts[now]
                    dense.append(m)
                ca, cb = dense
                c += _common(ca, cb) if match == "bag" else ca.astype(float) @ cb.astype(float).T
        # A bag holds length + n - 1 grams.
        size = left.column("grams").to_numpy()[:, None] + right.column("grams").to_numpy()[None, :]
        with np.errstate(divide="ignore"):
            return c / (size - c)

    return tile


def _packed(a: tuple, b: tuple, size_a: np.ndarray, size_b: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Similarities of bags summed over ``b``, for every row of ``a``; sides are those of ``_entries``.

    The common grams of a pair are an inner product over (gram, 1 to its count). As they are few bits, several rows of ``b``
    share a number of the product, and a table gives the similarities of several of them at once.
    """
    bits = int(min(size_a.max(initial=0), size_b.max(initial=0))).bit_length()
    per = max(1, 12 // bits)
    pack = per * max(1, 24 // (per * bits))
    units = []
    for rows, gram, counts in (a, b):
        at = np.repeat(np.arange(len(rows)), counts)
        level = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        units.append((rows[at], gram[at] * (1 << bits) + level))
    live = np.intersect1d(units[0][1], units[1][1])
    cells = []
    for rows, unit in units:
        keep = np.isin(unit, live)
        cells.append((rows[keep], np.searchsorted(live, unit[keep])))
    # Rows of ``b`` with equal size and times follow each other and fill up numbers of their own.
    order = np.lexsort((times, size_b))
    runs = np.flatnonzero(np.r_[True, (np.diff(size_b[order]) != 0) | (np.diff(times[order]) != 0)])
    lengths = np.diff(np.r_[runs, len(order)])
    numbers = -(-lengths // pack)
    first = np.cumsum(numbers) - numbers
    inside = np.arange(len(order)) - np.repeat(runs, lengths)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.repeat(first, lengths) + inside // pack
    field = np.empty(len(order), dtype=np.int64)
    field[order] = inside % pack
    total = int(numbers.sum())
    weight, size_of = np.repeat(times[order][runs], numbers), np.repeat(size_b[order][runs], numbers)
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(size_of) != 0]), total]
    by_size = np.argsort(size_a, kind="stable")
    rank = np.empty(len(by_size), dtype=np.int64)
    rank[by_size] = np.arange(len(by_size))
    sizes = size_a[by_size]
    (rows_a, unit_a), (rows_b, unit_b) = cells
    rows_a = rank[rows_a]
    sort = np.argsort(rows_a, kind="stable")
    rows_a, unit_a = rows_a[sort], unit_a[sort]
    codes = np.arange(1 << (per * bits))
    fields = [(codes >> (bits * j)) & ((1 << bits) - 1) for j in range(per)]
    tables: dict[int, np.ndarray] = {}

    def table(size: int) -> np.ndarray:
        if size not in tables:
            with np.errstate(divide="ignore"):
                # A code with more common grams than both bags allow does not occur.
                tables[size] = sum(np.where(c < size, c / np.maximum(size - c, 1), 0.0) for c in fields)
        return tables[size]

    sums = np.zeros(len(sizes))
    for wide in range(0, total, PIECE * 4):
        here = slice(wide, min(wide + PIECE * 4, total))
        mine = (place[rows_b] >= here.start) & (place[rows_b] < here.stop)
        packed = np.zeros((len(live), here.stop - here.start), dtype=np.float32)
        np.add.at(packed, (unit_b[mine], place[rows_b[mine]] - here.start), np.left_shift(1, bits * field[rows_b[mine]]).astype(np.float32))
        for low in range(0, len(sizes), PIECE):
            high = min(low + PIECE, len(sizes))
            own = slice(*np.searchsorted(rows_a, [low, high]))
            ones = np.zeros((high - low, len(live)), dtype=np.float32)
            ones[rows_a[own] - low, unit_a[own]] = 1
            common = (ones @ packed).astype(np.int32)
            steps = np.r_[low, low + 1 + np.flatnonzero(np.diff(sizes[low:high])), high]
            for top, end in zip(steps[:-1], steps[1:]):
                for x, y in zip(np.maximum(cuts[:-1], here.start), np.minimum(cuts[1:], here.stop)):
                    if x < y:
                        part, known = common[top - low : end - low, x - here.start : y - here.start], table(int(sizes[top] + size_of[x]))
                        found = known[part & (len(codes) - 1)]
                        for shift in range(per * bits, pack * bits, per * bits):
                            found += known[(part >> shift) & (len(codes) - 1)]
                        sums[top:end] += found @ weight[x:y]
    out = np.empty(len(sizes))
    out[by_size] = sums
    return out


def ngram_sums(n: int, match: str, width: int = 2048) -> Callable[[pa.Table, pa.Table, bool], tuple[np.ndarray, np.ndarray | None]]:
    """Similarities of gram bags summed over the other block, for ``left`` and, with ``both``, for ``right``."""
    tile = ngram_tile(n, match, width)

    def sums(left: pa.Table, right: pa.Table, both: bool) -> tuple[np.ndarray, np.ndarray | None]:
        times = [t.column("times").to_numpy().astype(float) for t in (left, right)]
        sizes = [t.column("grams").to_numpy() for t in (left, right)]
        sides = _entries(left, right)
        grams = 1 + max((int(g.max(initial=-1)) for _, g, _ in sides), default=-1)
        if match == "bag" and 0 < grams <= width and min(s.max() for s in sizes) < PACKED_GRAMS:
            postings = [np.bincount(g, minlength=grams).astype(float) for _, g, _ in sides]
            most = np.zeros((2, grams), dtype=np.int64)
            for m, (_, g, counts) in zip(most, sides):
                np.maximum.at(m, g, counts)
            units = int(most.min(axis=0).sum())
            if units <= 4 * width and float(postings[0] @ postings[1]) * POSTING_CELLS >= left.num_rows * right.num_rows * grams / 8:
                of_left = _packed(*sides, *sizes, times[1])
                return of_left, _packed(*sides[::-1], *sizes[::-1], times[0]) if both else None
        of_left, of_right = np.zeros(left.num_rows), np.zeros(right.num_rows)
        for i in range(0, left.num_rows, TILE):
            for j in range(0, right.num_rows, TILE):
                sim = tile(left.slice(i, TILE).combine_chunks(), right.slice(j, TILE).combine_chunks())
                of_left[i : i + TILE] += sim @ times[1][j : j + TILE]
                of_right[j : j + TILE] += times[0][i : i + TILE] @ sim
        return of_left, of_right if both else None

    return sums


def _partial(sums: Callable[[pa.Table, pa.Table, bool], tuple[np.ndarray, np.ndarray | None]]) -> Callable[[pa.Table], pa.Table]:
    """Group function of one tile: similarities summed over the other block, per sequence."""

    def partial_sums(table: pa.Table) -> pa.Table:
        block = table.column("blk").to_numpy()
        ti, tj = table.column("ti")[0].as_py(), table.column("tj")[0].as_py()
        left, right = (table.filter(pa.array(block == t)).combine_chunks() for t in (ti, tj))
        if not left.num_rows or not right.num_rows:
            return pa.table({"did": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        dids = [t.column("did").to_numpy() for t in (left, right)]
        of_left, of_right = sums(left, right, ti != tj)
        if ti == tj:
            return pa.table({"did": dids[0], "s": of_left})
        return pa.table({"did": np.concatenate(dids), "s": np.concatenate([of_left, of_right])})

    return partial_sums


def blocks_and_tiles(distinct: DataFrame, tokens: Column, blocks: int, order: str = "did") -> tuple[DataFrame, DataFrame]:
    """``distinct`` with a block ``blk``, and the stored pairs ``(ti, tj)`` of blocks with a common token.

    Rows are cut into ranges by their rarest token, so blocks share as few tokens as can be, and below it by ``order``. A block
    meets itself.
    """
    postings = materialize(distinct.select("did", F.explode(F.array_distinct(tokens)).alias("token")))
    counts = materialize(postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    # A frequent token has many postings; the skew join splits them.
    rarest = lookup(postings, counts, ["token"], "inner").groupBy("did").agg(F.min(F.struct("n", "token")).alias("r"))
    rarest = rarest if order == "did" else rarest.join(distinct.select("did", order), "did")
    ranged = rarest.repartitionByRange(blocks, "r.token", order, "did").select("did", F.spark_partition_id().alias("blk"))
    placed = materialize(ranged)
    held = postings.join(placed, "did").groupBy("token").agg(F.array_sort(F.collect_set("blk")).alias("blks"))
    held = materialize(held.select("blks").distinct())
    light = held.where(F.size("blks") <= HEAVY_BLOCKS)
    heavy = held.where(F.size("blks") > HEAVY_BLOCKS).select(F.explode("blks").alias("blk")).agg(F.array_sort(F.collect_set("blk")).alias("blks"))
    first = light.unionByName(heavy).select(F.posexplode("blks").alias("i", "ti"), "blks")
    tiles = first.select("ti", F.explode(F.slice("blks", F.col("i") + 1, F.size("blks"))).alias("tj")).distinct()
    return distinct.join(placed, "did"), materialize(tiles)


def _similarity_sums(distinct: DataFrame, sums: Callable, block: int, tokens: Column, order: str = "did") -> DataFrame:
    """``(did, s)``: similarity to all sequences, for a stored ``distinct (did, times, ...)``."""
    size = distinct.agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).alias("tokens")).first()
    d = size["d"]
    parallel = distinct.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(d / block), math.ceil(size["tokens"] / BLOCK_TOKENS), min(math.ceil(math.sqrt(8 * parallel)), d // 256))
    rows, pairs = blocks_and_tiles(distinct, tokens, blocks, order)
    tiles = pairs.count()
    ends = pairs.select("ti", "tj", F.explode(F.array_distinct(F.array("ti", "tj"))).alias("blk"))
    rows = rows.join(ends, "blk")
    partial = (
        # Several tiles meet in a partition by chance; in many partitions few do, and no core waits long for the last one.
        rows.repartition(max(1, min(2 * tiles, 4 * max(4 * parallel, tiles // 64))), "ti", "tj")
        .groupBy("ti", "tj")
        .applyInArrow(_partial(sums), "did long, s double")
    )
    return partial.groupBy("did").agg(F.sum("s").alias("s"))


def _score(total: Column, equal: Column, sequences: int) -> Column:
    """One over the mean; the sequence and its equals count as similarity minus one."""
    mean = (total - equal) / F.nullif(F.lit(sequences - 1), F.lit(0))
    return F.when(mean == 0, F.lit(DISSIMILAR)).otherwise(F.lit(1.0) / mean)


def _numbered(groups: DataFrame) -> DataFrame:
    """Stored groups with a number each; the number is fixed because the table is stored."""
    return materialize(groups.withColumn("did", F.monotonically_increasing_id()))


def lcs_scores(sequences: DataFrame, *, block: int = LCS_BLOCK) -> DataFrame:
    """``(seq_id, score)``: one over the mean LCS similarity to the other sequences.

    A sequence that shares no state with any other scores ``DISSIMILAR``; a single sequence
    scores null. Sequences are compared whole, so build them with a bounded length.
    """
    arrays = materialize(as_arrays(sequences))
    distinct = _numbered(arrays.groupBy("states").agg(F.count(F.lit(1)).alias("times")))
    sums = _similarity_sums(distinct, lcs_sums, block, F.col("states"), "states")
    score = _score(F.col("s"), F.col("times"), arrays.count())
    per_distinct = materialize(distinct.join(sums, "did").select("states", score.alias("score")))
    return lookup(arrays, per_distinct, ["states"], "inner").select("seq_id", "score")


def gram_bags(
    sequences: DataFrame, n: int, *, rows_per_block: int = o.ROWS_PER_BLOCK, max_length: int | None = None
) -> DataFrame:
    """``(seq_id, bag ARRAY<(gram, c)>, grams, f1, f2)`` with n - 1 pads on both sides.

    Grams are read off a window over bounded blocks and counted before they meet, so a bag
    holds the distinct grams only, however long its sequence. ``f1, f2`` identify the
    sequence: hashes of all (position, state), combined by exclusive or.
    """
    rows = sequences.select("seq_id", "pos", "state")
    blocks, by = o.halo_blocks(rows, "pos", max(n - 1, 1), rows_per_block, max_length)
    along = Window.partitionBy(*by).orderBy("pos")
    ahead = [F.col("state"), *[F.lead("state", j).over(along) for j in range(1, n)]]
    blocks = blocks.withColumns({f"s{j}": F.coalesce(a.cast("string"), F.lit("|")) for j, a in enumerate(ahead)})

    def gram(pads: int) -> Column:
        return F.concat_ws(",", *[F.lit("|")] * pads, *[F.col(f"s{j}") for j in range(n - pads)])

    here = F.struct(
        gram(0).alias("gram"),
        F.xxhash64("pos", "state").alias("f1"),
        F.xxhash64("state", "pos", F.lit(n)).alias("f2"),
    )
    zero = F.lit(0).cast("long")
    before = [F.struct(gram(p).alias("gram"), zero.alias("f1"), zero.alias("f2")) for p in range(1, n)]
    found = F.when(F.col("pos") == 0, F.array(here, *before)).otherwise(F.array(here))
    counts = (
        blocks.where("__own")
        .select("seq_id", F.explode(found).alias("g"))
        .groupBy("seq_id", F.col("g.gram").alias("gram"))
        .agg(F.count(F.lit(1)).alias("c"), F.bit_xor("g.f1").alias("f1"), F.bit_xor("g.f2").alias("f2"))
    )
    return counts.groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.struct("gram", "c"))).alias("bag"),
        F.sum("c").alias("grams"),
        F.bit_xor("f1").alias("f1"),
        F.bit_xor("f2").alias("f2"),
    )


def _bag_sums(distinct: DataFrame, n: int, match: str, block: int) -> DataFrame:
    """``(did, s)``: similarity to all bags, by the cheaper of two ways: all pairs, or all sets of a bag's grams."""
    size = distinct.agg(F.count(F.lit(1)).alias("d"), F.sum(F.pow(F.lit(2.0), F.col("grams"))).alias("sets")).first()
    if match == "bag" and size["d"] and size["sets"] * SET_PAIRS < size["d"] ** 2 / 2:
        return shared_sums(distinct)
    return _similarity_sums(distinct, ngram_sums(n, match), block, F.col("bag.gram"))


def ngram_scores(
    sequences: DataFrame, n: int = 2, *, match: str = "bag", block: int = BLOCK, **options
) -> DataFrame:
    """``(seq_id, score)``: one over the mean n-gram similarity to the other sequences.

    Similarity is c / (len a + len b + 2(n - 1) - c) over grams padded on both sides; c sums
    the smaller count of each gram, or with ``match='product'`` the product of the counts.
    """
    if match not in ("bag", "product"):
        raise ValueError(match)
    bags = materialize(gram_bags(sequences, n, **options))
    distinct = _numbered(bags.groupBy("bag", "grams").agg(F.count(F.lit(1)).alias("times")))
    sums = _bag_sums(distinct, n, match, block)
    per_bag = materialize(distinct.join(sums, "did").select("bag", "s"))
    same = ["f1", "f2", "grams"]
    equal = materialize(bags.groupBy(*same).agg(F.count(F.lit(1)).alias("equal")))
    joined = lookup(lookup(bags, per_bag, ["bag"], "inner"), equal, same, "inner")
    return joined.select("seq_id", _score(F.col("s"), F.col("equal"), bags.count()).alias("score"))


def detect_lcs(sequences: DataFrame, eps: Sequence[float], **options) -> DataFrame:
    """LCS scores flagged at every threshold in ``eps``."""
    return flag(lcs_scores(sequences, **options), eps)


def detect_ngram(sequences: DataFrame, eps: Sequence[float], n: int = 2, **options) -> DataFrame:
    """n-gram scores flagged at every threshold in ``eps``."""
    return flag(ngram_scores(sequences, n, **options), eps)


def ngram_similarity(pairs: DataFrame, n: int = 2, *, a: str = "a", b: str = "b", match: str = "bag") -> DataFrame:
    """``pairs (pair_id, a ARRAY, b ARRAY)`` to ``(pair_id, similarity)``.

    Grams are counted per (pair, gram, side) and summed per pair; no gram is joined.
    """
    sides = F.array(
        *[F.struct(ngrams(F.col(c), n).alias("grams"), F.lit(s).alias("side")) for s, c in enumerate((a, b))]
    )
    grams = (
        pairs.select("pair_id", (F.size(a) + F.size(b)).alias("size"), F.explode(sides).alias("x"))
        .select("pair_id", "size", "x.side", F.explode("x.grams").alias("gram"))
        .groupBy("pair_id", "size", "gram")
        .agg(F.count_if(F.col("side") == 0).alias("ca"), F.count_if(F.col("side") == 1).alias("cb"))
    )
    shared = F.least("ca", "cb") if match == "bag" else F.col("ca") * F.col("cb")
    c = F.sum(shared).cast("double")
    return grams.groupBy("pair_id", "size").agg(c.alias("c")).select(
        "pair_id", F.try_divide(F.col("c"), F.col("size") + 2 * (n - 1) - F.col("c")).alias("similarity")
    )
