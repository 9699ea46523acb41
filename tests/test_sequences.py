import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loglattice.operators import ordered as o
from loglattice.operators import sequences as sq

START = dt.datetime(2024, 1, 1)


def rows_of(spark, rows):
    """rows: (client, server, seconds)."""
    data = [
        (i, c, s, START + dt.timedelta(seconds=t), i % 4) for i, (c, s, t) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "row_id long, client_ip string, server_ip string, ts timestamp, label int"
    )


def lengths(df):
    return {r.seq_id: r.n for r in df.groupBy("seq_id").agg(F.count("*").alias("n")).collect()}


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.seq_id, {})[r.pos] = r.state
    for k, v in out.items():
        assert sorted(v) == list(range(len(v))), k
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def test_chunks(spark):
    df = rows_of(spark, [("a", "s", i) for i in range(23)] + [("b", "s", i) for i in range(21)])
    assert lengths(sq.by_chunk(df)) == {"a_0": 10, "a_1": 10, "a_2": 3, "b_0": 10, "b_1": 10}
    assert len(lengths(sq.by_chunk(df, many=1))) == 44


def test_gap(spark):
    df = rows_of(spark, [("a", "s", t) for t in (0, 10, 3610, 7209)])
    assert lengths(sq.by_time_gap(df)) == {"a_0": 2, "a_1": 2}
    assert lengths(sq.by_time_gap(df, gap=None)) == {"a": 4}


def test_runs(spark):
    df = rows_of(spark, [("a", s, i) for i, s in enumerate("AABAA")])
    assert lengths(sq.by_server_run(df)) == {"a_A_000": 2, "a_B_000": 1, "a_A_001": 2}
    assert lengths(sq.by_server_run(df, drop_last_run=True)) == {"a_A_000": 2, "a_B_000": 1}


def test_pairs(spark):
    df = rows_of(spark, [("a", s, i) for i, s in enumerate("ABAAB")])
    assert collected(sq.by_pair(df)) == {"a_A": [0, 2, 3], "a_B": [1, 0]}


def brute(rows, mode, many=4, gap=30):
    by = {}
    for i, (c, s, t) in sorted(enumerate(rows), key=lambda x: (x[1][2], x[0])):
        by.setdefault(c, []).append((i % 4, s, t))
    out = {}
    for c, items in by.items():
        if mode == "client":
            out[c] = [x[0] for x in items]
        elif mode == "chunk":
            for k in range(0, len(items), many):
                part = [x[0] for x in items[k : k + many]]
                if len(part) == many or len(part) > 1:
                    out[f"{c}_{k // many}"] = part
        elif mode == "pair":
            for x in items:
                out.setdefault(f"{c}_{x[1]}", []).append(x[0])
        elif mode == "gap":
            k, last = 0, None
            for x in items:
                if last is not None and x[2] - last >= gap:
                    k += 1
                last = x[2]
                out.setdefault(f"{c}_{k}", []).append(x[0])
        elif mode == "run":
            seen, last = {}, None
            for x in items:
                if x[1] != last:
                    seen[x[1]] = seen.get(x[1], -1) + 1
                    last = x[1]
                out.setdefault(f"{c}_{x[1]}_{seen[x[1]]:03d}", []).append(x[0])
    return out


@pytest.mark.parametrize("mode", ["client", "chunk", "pair", "gap", "run"])
@pytest.mark.parametrize("block,parts", [(7, 5), (10_000, 1)])
def test_modes_against_brute_force(spark, mode, block, parts):
    """A client with most rows, bursts on one timestamp, and blocks of 7 rows."""
    rng = random.Random(3)
    rows = [("hot", rng.choice("AAB"), rng.choice([5, rng.randrange(900)])) for _ in range(150)]
    rows += [(f"c{rng.randrange(9)}", rng.choice("AB"), rng.randrange(900)) for _ in range(60)]
    df = rows_of(spark, rows).repartition(parts)
    options = {"chunk": {"many": 4}, "gap": {"gap": 30}}.get(mode, {})
    got = collected(sq.build_sequences(df, mode, rows_per_block=block, **options))
    assert got == brute(rows, mode)


def test_every_scan_across_blocks(spark):
    rng = random.Random(5)
    rows = [("h", None if rng.random() < 0.3 else rng.randrange(50), rng.randrange(400)) for _ in range(120)]
    df = spark.createDataFrame(
        [(k, v, t, i) for i, (k, v, t) in enumerate(rows)] + [(None, 1, i, 1000 + i) for i in range(30)],
        "k string, v long, t long, id long",
    )
    scans = dict(
        rn=o.position(),
        n=o.group_rows(),
        total=o.group_sum(F.col("v")),
        s=o.running_sum(F.col("v")),
        m=o.running_max(F.col("v")),
        c=o.carried(F.col("v")),
        p=o.previous(F.col("v")),
        f=o.following(F.col("v")),
    )
    groups = o.OrderedGroups(df, ["k"], ["t", "id"], rows_per_block=11)
    assert groups.blocked
    plain = o.OrderedGroups(df, ["k"], ["t", "id"]).scan(**scans).df.orderBy("id").collect()
    cut = groups.scan(**scans).df.select(*df.columns, *scans).orderBy("id").collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in cut]


def test_blocks_stay_below_the_limit_in_a_burst(spark):
    """Most rows share one second and one file name; ids, nulls and names still cut them."""
    rows = [("h", 1000, "a" if i % 3 else "b", i) for i in range(120)]
    rows += [("h", None, "a", 200 + i) for i in range(30)] + [("h", 10**9, "z", 400), ("c", 5, "a", 500)]
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, f string, id long").repartition(3)
    groups = o.OrderedGroups(df, ["k"], ["t", "f", "id"], rows_per_block=8)
    sizes = [r["count"] for r in groups._df.groupBy("k", "__block").count().collect()]
    assert max(sizes) <= 8 and sum(sizes) == len(rows)
    got = {r.id: r.rn for r in groups.scan(rn=o.position()).df.collect() if r.k == "h"}
    order = sorted((r for r in rows if r[0] == "h"), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    assert got == {r[3]: i + 1 for i, r in enumerate(order)}


def test_attach_labels(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, c string")
    right = spark.createDataFrame([(2, 7)], "row_id long, label int")
    assert [tuple(r) for r in sq.attach_labels(left, right).collect()] == [(2, "b", 7)]


def test_a_missing_server_and_a_dash_are_one_name(spark):
    rows = [(1, "c", None), (2, "c", "-"), (3, None, "s"), (4, "-", "s"), (5, None, "s")]
    df = spark.createDataFrame([(i, c, s, i, 0) for i, c, s in rows], "row_id long, client_ip string, server_ip string, ts long, label int")
    for mode in ("pair", "run", "client", "chunk"):
        found = sq.build_sequences(df, mode, order=("ts", "row_id")).collect()
        assert len({(r.seq_id, r.pos) for r in found}) == len(found), mode


@pytest.mark.parametrize("kind", ["words", "urls", "spread", "ends"])
def test_hot_group_along_a_string_is_cut_in_few_rounds(spark, monkeypatch, kind):
    make = {
        "words": lambda i: f"{i * 7919 % 1000:03d}",
        "urls": lambda i: f"https://host.example/a/very/long/path/that/all/share/{i * 7919 % 1000}/é{i % 7}",
        "spread": lambda i: chr(97 + i % 26) + "x" * (i % 5) + str(i),
        "ends": lambda i: "same" + "\0" * (i % 9),
    }[kind]
    rows = [("hot", make(i), i) for i in range(1000 if kind != "ends" else 40)] + [("hot", None, -1), ("cold", "z", -2)]
    df = spark.createDataFrame(rows, "k string, f string, id long").repartition(3)
    rounds, oversized = [], o._oversized
    monkeypatch.setattr(o, "_oversized", lambda *a: rounds.append(1) or oversized(*a))
    groups = o.OrderedGroups(df, ["k"], ["f", "id"], rows_per_block=4)
    got = {r.id: r.nth for r in groups.scan(nth=o.position()).df.collect()}
    order = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[2]))
    assert [got[r[2]] for r in order] == list(range(1, len(order) + 1)) and got[-2] == 1
    assert len(rounds) <= (10 if kind != "ends" else 14)
    largest = groups._df.where("k = 'hot'").groupBy(o._BLOCK).count().agg({"count": "max"}).first()[0]
    assert largest <= 4
