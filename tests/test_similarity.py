import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import SEQS, as_dict, sequence_table
from loglattice.operators.detectors import shared_grams as sg
from loglattice.operators.detectors import similarity as sm

FIVE = SEQS | {4: [1] * 10}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def bag(s, n):
    p = ["|"] * (n - 1) + list(s) + ["|"] * (n - 1)
    return Counter(tuple(p[i : i + n]) for i in range(len(s) + n - 1))


def gram_sim(a, b, n, match="bag"):
    x, y = bag(a, n), bag(b, n)
    c = sum(min(x[g], y[g]) if match == "bag" else x[g] * y[g] for g in x)
    return c / (len(a) + len(b) + 2 * (n - 1) - c)


def scores(seqs, sim):
    out = []
    for s in seqs:
        total = sum(sim(s, t) - (s == t) for t in seqs) / (len(seqs) - 1)
        out.append(1 / total if total else 100000)
    return out


def ragged(seqs):
    return sm.Ragged(
        np.array([x for s in seqs for x in s], dtype=np.int64),
        np.concatenate([[0], np.cumsum([len(s) for s in seqs])]),
    )


def test_lcs_kernel_over_words():
    rng = random.Random(1)
    seqs = [[rng.randrange(4) for _ in range(rng.choice([1, 3, 63, 64, 65, 128, 150]))] for _ in range(40)]
    got = sm.lcs_matrix(ragged(seqs), ragged(seqs[:17]))
    assert got.tolist() == [[lcs(a, b) for b in seqs[:17]] for a in seqs]


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("match", ["bag", "product"])
def test_ngram_kernel(n, match):
    rng = random.Random(n)
    seqs = [[rng.randrange(6) for _ in range(rng.randrange(1, 12))] for _ in range(30)] + [[3] * 90, [3] * 70]
    if match == "product":
        seqs = [list(range(i, i + k)) for i in range(5) for k in (1, 3, 4)]
    def block(part):
        bags = [[{"gram": ",".join(map(str, g)), "c": c} for g, c in bag(s, n).items()] for s in part]
        kind = pa.list_(pa.struct([("gram", pa.string()), ("c", pa.int64())]))
        grams = pa.array([len(s) + n - 1 for s in part])
        return pa.table({"bag": pa.array(bags, kind), "grams": grams})

    for width in (5, 2048):
        got = sm.ngram_tile(n, match, width)(block(seqs), block(seqs))
        want = np.array([[gram_sim(a, b, n, match) if (len(a) + len(b) + 2 * (n - 1)) else 0 for b in seqs] for a in seqs])
        assert np.allclose(got, want)


def test_prefixes_share_their_work():
    rows = np.array([[0, 1, 2], [0, 1, 3], [0, 1, 3], [0, 2, 2], [1, 0, 0]])
    nodes, firsts, parents = sm.trie(rows)
    assert [f.tolist() for f in firsts] == [[0, 4], [0, 3, 4], [0, 1, 3, 4]]
    assert [p.tolist() for p in parents] == [[0, 0], [0, 0, 1], [0, 0, 1, 2]]
    assert nodes.tolist() == [0, 1, 1, 2, 3]


@pytest.mark.parametrize("match", ["bag", "product"])
@pytest.mark.parametrize("cells", [0, 10**9])
def test_postings_and_dense_products_agree(monkeypatch, match, cells):
    rng = random.Random(4)
    seqs = [[rng.randrange(i, i + 9) for _ in range(rng.randrange(2, 9))] for i in range(0, 200, 5)]
    kind = pa.list_(pa.struct([("gram", pa.string()), ("c", pa.int64())]))

    def block(part):
        bags = [[{"gram": ",".join(map(str, g)), "c": c} for g, c in bag(s, 1).items()] for s in part]
        return pa.table({"bag": pa.array(bags, kind), "grams": pa.array([3 * len(s) ** 2 for s in part])})

    monkeypatch.setattr(sm, "POSTING_CELLS", cells)
    got = sm.ngram_tile(1, match, 16)(block(seqs[:25]), block(seqs[20:]))
    for i, a in enumerate(seqs[:25]):
        for j, b in enumerate(seqs[20:]):
            x, y = bag(a, 1), bag(b, 1)
            c = sum(min(x[g], y[g]) if match == "bag" else x[g] * y[g] for g in x)
            assert got[i, j] == pytest.approx(c / (3 * len(a) ** 2 + 3 * len(b) ** 2 - c))


@pytest.mark.parametrize("heavy", [64, 2])
def test_blocks_without_a_common_token_do_not_meet(spark, monkeypatch, heavy):
    monkeypatch.setattr(sm, "HEAVY_BLOCKS", heavy)
    rng = random.Random(6)
    # Twenty families of states of their own, and one state in three families.
    seqs = [[rng.randrange(10 * f, 10 * f + 5) for _ in range(rng.randrange(1, 6))] + ([999] if f < 3 else []) for f in range(20) for _ in range(12)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "did long, states array<int>")
    placed, tiles = sm.blocks_and_tiles(rows, F.col("states"), 20)
    blk = {r.did: r.blk for r in placed.collect()}
    pairs = {(r.ti, r.tj) for r in tiles.collect()}
    for i, a in enumerate(seqs):
        for j, b in enumerate(seqs):
            if set(a) & set(b):
                assert tuple(sorted((blk[i], blk[j]))) in pairs
    blocks = len(set(blk.values()))
    assert len(pairs) < 0.4 * blocks * (blocks + 1) / 2
    table = sequence_table(spark, seqs)
    got = as_dict(sm.lcs_scores(table, block=13))
    assert [got[str(i)] for i in range(len(seqs))] == pytest.approx(scores(seqs, lambda a, b: lcs(a, b) / (len(a) * len(b)) ** 0.5))
    got = as_dict(sm.ngram_scores(table, 2, block=13))
    assert [got[str(i)] for i in range(len(seqs))] == pytest.approx(scores(seqs, lambda a, b: gram_sim(a, b, 2)))


def test_lcs_golden(spark):
    got = as_dict(sm.lcs_scores(sequence_table(spark, FIVE)))
    want = [2.2094012918, 2.1939492145, 2.3771634263, 2.8694350803, 6.2478200176]
    assert [got[str(i)] for i in range(5)] == pytest.approx(want, abs=1e-9)
    flags = sm.detect_lcs(sequence_table(spark, FIVE), [0, 0])
    assert flags.where("is_anomaly").count() == 10
    lonely = as_dict(sm.lcs_scores(sequence_table(spark, [[0, 1], [0], [9], [9, 8]][:3])))
    assert lonely["2"] == 100000
    assert as_dict(sm.lcs_scores(sequence_table(spark, [[0, 1]])))["0"] is None


def test_ngram_golden_pairs(spark):
    pairs = [(f"{i}{j}", FIVE[i], FIVE[j]) for i in range(5) for j in range(i + 1, 5)]
    df = spark.createDataFrame(pairs, "pair_id string, a array<int>, b array<int>")
    got = as_dict(sm.ngram_similarity(df), "pair_id", "similarity")
    want = {"01": 3 / 7, "02": 2 / 9, "03": 1 / 10, "12": 1 / 8, "14": 1 / 14, "23": 1 / 9, "24": 1 / 15,
            "34": 1 / 15, "04": 0, "13": 0}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("kind", ["lcs", "ngram"])
def test_tiles_against_brute_force(spark, kind):
    rng = random.Random(2)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, 8))] for _ in range(60)] + [[2, 2, 1]] * 30
    table = sequence_table(spark, seqs)
    if kind == "lcs":
        got = sm.lcs_scores(table, block=13)
        want = scores(seqs, lambda a, b: lcs(a, b) / (len(a) * len(b)) ** 0.5)
    else:
        got = sm.ngram_scores(table, 3, block=13, rows_per_block=3)
        want = scores(seqs, lambda a, b: gram_sim(a, b, 3))
    got = as_dict(got)
    assert [got[str(i)] for i in range(len(seqs))] == pytest.approx(want)


def test_lcs_sums_without_a_matrix(monkeypatch):
    monkeypatch.setattr(sm, "lcs_matrix", None)  # No matrix of all pairs of a tile is made.
    monkeypatch.setattr(sm, "PIECE", 7)
    rng = random.Random(8)
    for longest in (9, 30, 70):
        seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, longest))] for _ in range(40)] + [[7], [8, 9]]
        parts = seqs[:23], seqs[23:]
        times = [[rng.randrange(1, 4) for _ in p] for p in parts]
        left, right = (pa.table({"states": pa.array(p, pa.list_(pa.int32())), "times": t}) for p, t in zip(parts, times))
        sim = np.array([[lcs(a, b) / (len(a) * len(b)) ** 0.5 for b in parts[1]] for a in parts[0]])
        of_left, of_right = sm.lcs_sums(left, right, True)
        assert np.allclose(of_left, sim @ times[1]) and np.allclose(of_right, times[0] @ sim)
        alone, none = sm.lcs_sums(right, right, False)
        assert none is None and alone[-2:].tolist() == times[1][-2:]


@pytest.mark.parametrize("piece", [1, 3, 512])
@pytest.mark.parametrize("words", [1, 128])
def test_lcs_takes_a_bit_per_pair_and_prefix(monkeypatch, piece, words):
    """64 sequences share a word, and sequences with a common prefix its steps."""
    monkeypatch.setattr(sm, "PIECE", piece)
    monkeypatch.setattr(sm, "WORDS", words)
    rng = random.Random(9)
    a = [[rng.randrange(5) for _ in range(rng.randrange(1, 11))] for _ in range(150)]
    b = [s[:6] + [rng.randrange(6) for _ in range(4)] for s in ([rng.randrange(3) for _ in range(6)] for _ in range(50))]
    prefixes = len({tuple(s[:k]) for s in b for k in range(1, 11)})
    pieces = list(sm.lcs_gains(ragged(a), ragged(b)))
    assert sum(planes.nbytes for *_, planes in pieces) <= prefixes * 8 * 3
    got = np.zeros((150, 51), dtype=int)
    for near, rows, starts, ends, planes in pieces:
        bits = np.unpackbits(planes.view(np.uint8), axis=1, bitorder="little")[:, : near.stop - near.start]
        for plane, start, end in zip(bits, starts, ends):
            for r in rows[start:end]:
                got[near, r] += plane
    assert got[:, :50].tolist() == [[lcs(x, y) for y in b] for x in a]
    times = [[rng.choice([1, 1, 1, 2, 7, 1000]) for _ in s] for s in (a, b)]
    left, right = (pa.table({"states": pa.array(s, pa.list_(pa.int32())), "times": t}) for s, t in zip((a, b), times))
    sim = np.array([[lcs(x, y) / (len(x) * len(y)) ** 0.5 for y in b] for x in a])
    of_left, of_right = sm.lcs_sums(left, right, True)
    assert np.allclose(of_left, sim @ times[1]) and np.allclose(of_right, times[0] @ sim)


def test_tiles_are_spread_over_more_partitions_than_tiles(spark):
    """hashes put several tiles in one of few partitions, and all cores wait for it."""
    rng = random.Random(10)
    rows = [(i, 1, [rng.randrange(4) for _ in range(6)]) for i in range(60)]
    distinct = spark.createDataFrame(rows, "did long, times long, states array<int>")
    sums = sm._similarity_sums(distinct, sm.lcs_sums, 13, F.col("states"), "states")
    plan = sums._jdf.queryExecution().analyzed().toString()
    # Five blocks that all meet.
    assert [int(n) for n in re.findall(r"RepartitionByExpression \[ti#\d+, tj#\d+\], (\d+)", plan)] == [30]
    assert sums.count() == 60


@pytest.mark.parametrize("longest", [9, 60])
def test_packed_bags_are_summed_without_a_matrix(monkeypatch, longest):
    monkeypatch.setattr(sm, "PIECE", 5)
    monkeypatch.setattr(sm, "POSTING_CELLS", 10**9)
    monkeypatch.setattr(sm, "ngram_tile", lambda *_: None)  # No matrix of all pairs of a tile is made.
    rng = random.Random(longest)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, longest))] for _ in range(70)] + [[8, 9]]
    kind = pa.list_(pa.struct([("gram", pa.string()), ("c", pa.int64())]))
    parts = seqs[:30], seqs[30:]
    times = [[rng.choice([1, 1, 2, 1000]) for _ in p] for p in parts]

    def block(part, times):
        bags = [[{"gram": ",".join(map(str, g)), "c": c} for g, c in bag(s, 2).items()] for s in part]
        return pa.table({"bag": pa.array(bags, kind), "grams": [len(s) + 1 for s in part], "times": times})

    left, right = (block(*x) for x in zip(parts, times))
    sim = np.array([[gram_sim(a, b, 2) for b in parts[1]] for a in parts[0]])
    of_left, of_right = sm.ngram_sums(2, "bag")(left, right, True)
    assert np.allclose(of_left, sim @ times[1]) and np.allclose(of_right, times[0] @ sim)
    alone, none = sm.ngram_sums(2, "bag")(right, right, False)
    assert none is None and alone[-1] == times[1][-1]


@pytest.mark.parametrize("few, entries, words", [(1, 1, 8), (3, 40, 8), (8, 1 << 19, 8), (8, 40, 0)])
@pytest.mark.parametrize("n", [1, 3])
def test_sums_over_shared_sets_of_grams(monkeypatch, few, entries, words, n):
    for name, value in {"FEW": few, "ENTRIES": entries, "PAIR_WORDS": words}.items():
        monkeypatch.setattr(sg, name, value)
    rng = random.Random(n)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(80)] + [[2] * 9, [2] * 8, [8, 9]]
    bags = list({tuple(sorted(bag(s, n).items(), key=str)) for s in seqs})
    times = [rng.choice([1, 1, 2, 1000]) for _ in bags]
    units = [[(g, i) for g, c in b for i in range(c)] for b in bags]
    held = Counter(u for x in units for u in x)
    rank = {u: i for i, u in enumerate(sorted(held, key=lambda u: (held[u], str(u))))}
    got = [float(t) for t in times]
    for key in rank.values():
        rows = [(did, sorted(rank[u] for u in x)) for did, x in enumerate(units) if key in {rank[u] for u in x}]
        group = {"did": [], "times": [], "size": [], "rest": []}
        for did, x in rows:
            for name, value in zip(group, (did, times[did], len(x), x[x.index(key) + 1 :])):
                group[name].append(value)
        rest = pa.array(group.pop("rest"), pa.list_(pa.int64()))
        for row in sg.group_sums(pa.table(group).append_column("rest", rest)).to_pylist():
            got[row["did"]] += row["s"]
    for i, a in enumerate(bags):
        want = 0
        for t, b in zip(times, bags):
            c = sum(min(c, dict(b).get(g, 0)) for g, c in a)
            want += t * c / (len(units[i]) + sum(dict(b).values()) - c)
        assert got[i] == pytest.approx(want)
    alone = [i for i, b in enumerate(bags) if sum(len(set(dict(b)) & set(dict(c))) > 0 for c in bags) == 1]
    assert alone and all(got[i] == times[i] for i in alone)


@pytest.mark.parametrize("n", [2, 3])
def test_many_bags_meet_in_the_sets_they_share(spark, monkeypatch, n):
    """no pairs of bags are compared where their sets of grams are fewer."""
    monkeypatch.setattr(sm, "SET_PAIRS", 1e-6)
    monkeypatch.setattr(sm, "ngram_sums", None)  # No tile is made.
    rng = random.Random(n)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(80)] + [[2, 2, 1]] * 20 + [[8, 9], [7], [7]]
    got = as_dict(sm.ngram_scores(sequence_table(spark, seqs), n))
    want = scores(seqs, lambda a, b: gram_sim(a, b, n))
    assert [got[str(i)] for i in range(len(seqs))] == pytest.approx(want)
    alone = as_dict(sm.ngram_scores(sequence_table(spark, [[0, 1, 1], [1, 0, 1], [1, 1, 0], [2]]), 3))
    assert alone["3"] == sm.DISSIMILAR and alone["0"] < 100
