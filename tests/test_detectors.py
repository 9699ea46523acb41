import math

import pytest
from pyspark.sql import functions as F

from helpers import SEQS, as_dict, sequence_table
from loglattice.functions.chi2 import chi2_quantile
from loglattice.operators import evaluate, thresholds, transitions
from loglattice.operators.detectors import directional, frequency, markov, session


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_transition_matrix(spark, block):
    table = transitions.transition_table(sequence_table(spark, SEQS), rows_per_block=block)
    rows = transitions.transition_matrix(table, [0, 1, 2, 3]).orderBy("from_state").collect()
    got = [[r.to_0, r.to_1, r.to_2, r.to_3, r.total] for r in rows]
    assert got == [[1, 2, 0, 1, 4], [0, 0, 2, 0, 2], [3, 1, 1, 0, 5], [0, 0, 1, 0, 1]]


def test_probabilities_sum_to_one(spark):
    table = transitions.transition_table(sequence_table(spark, SEQS))
    sums = table.groupBy("from_state").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-12 for r in sums)
    assert {r.grand_total for r in table.collect()} == {12}


@pytest.mark.parametrize("block", [2, 1000])
def test_markov_golden(spark, block):
    seqs = sequence_table(spark, SEQS | {4: [3]})
    table = transitions.train(sequence_table(spark, SEQS))
    got = as_dict(markov.markov_scores(seqs, table, rows_per_block=block))
    want = [0.9342413985, 0.3684827971, 1.3529645630, 1.4406426983, 0.0]
    assert [got[str(i)] for i in range(5)] == pytest.approx(want, abs=1e-9)
    flags = thresholds.flag(markov.markov_scores(sequence_table(spark, SEQS)), [1.0, 0.0])
    hits = {(r.eps, r.seq_id) for r in flags.where("is_anomaly").collect()}
    assert hits == {(1.0, "2"), (1.0, "3")} | {(0.0, str(i)) for i in range(4)}


def test_markov_unseen(spark):
    table = transitions.train(sequence_table(spark, SEQS))
    new = sequence_table(spark, {9: [3, 3]})
    assert as_dict(markov.markov_scores(new, table))["9"] == math.inf
    smooth = as_dict(markov.markov_scores(new, table, alpha=1.0, states=4))["9"]
    assert smooth == pytest.approx(-math.log2(1 / 5))


def test_session_table_and_scores(spark):
    seqs = sequence_table(spark, SEQS)
    table = transitions.train(seqs)
    pq = {(r.from_state, r.to_state): r.pq for r in table.collect()}
    assert pq[0, 1] == pytest.approx(1 / 12) and pq[2, 0] == pytest.approx(0.15)
    want = {
        "0": [0.104167, 0.270833, 0.4, 0.316667, 0.15],
        "1": [0.316667, 0.316667, 0.15],
        "2": [0.166667, 0.25, 0.233333, 0.083333],
        "3": [0.104167, 0.120833, 0.1, 0.016667],
    }
    for block in (3, 4, 1000):
        rows = session.position_scores(seqs, table, l=2, rows_per_block=block).collect()
        got = {(r.seq_id, r.pos): r.score for r in rows}
        assert len(rows) == 16
        for s, values in want.items():
            for i, v in enumerate(values):
                assert got[s, i] == pytest.approx(v, abs=1e-6)


@pytest.mark.parametrize("l", [1, 3, 5, 7])
def test_session_blocks_equal_one_block(spark, l):
    import random

    rng = random.Random(l)
    seqs = sequence_table(spark, [[rng.randrange(3) for _ in range(n)] for n in (1, 2, 4, 5, 6, 7, 40, 41)])
    table = transitions.train(seqs)
    one = session.position_scores(seqs, table, l=l).collect()
    cut = session.position_scores(seqs, table, l=l, rows_per_block=9).collect()
    key = lambda rows: {(r.seq_id, r.pos): round(r.score, 9) for r in rows}
    assert key(one) == key(cut)
    lengths = [n for n in (1, 2, 4, 5, 6, 7, 40, 41) if n >= l]
    assert len(one) == sum(lengths)


def test_session_demo_is_all_sentinel(spark):
    seqs = sequence_table(spark, [[0, 0, 1], [1, 2, 0]])
    where = [(0, 0), (1, 0), (0, 1), (0, 2), (1, 1), (1, 2)]
    sessions = spark.createDataFrame(
        [(i, str(s), p, int(i > 3)) for i, (s, p) in enumerate(where)],
        "session_id long, seq_id string, pos long, label int",
    )
    flags = session.detect(seqs, sessions, [0.0])
    assert {r.score for r in flags.collect()} == {1000000.0}
    r = evaluate.detection_rates(flags, by=["eps"]).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.dr, r.fpr) == (0, 0, 2, 4, 0.0, 0.0)


def test_balanced_f(spark):
    flags = markov.detect(sequence_table(spark, SEQS), [1.0, 99.0])
    truth = spark.createDataFrame([("0", 0), ("1", 0), ("2", 1), ("3", 1)], "seq_id string, label int")
    rows = {r.eps: r for r in evaluate.balanced_f(flags.join(truth, "seq_id"), by=["eps"]).collect()}
    r = rows[1.0]
    assert (r.tn, r.fn, r.fp, r.tp, r.f) == (2, 0, 0, 2, 1.0)
    assert rows[99.0].f == 0.0


def test_frequency_vectors(spark):
    seqs = [[1, 2, 3, 4, 0], [1, 1, 2, 4], [0, 4, 4, 2, 1], [2, 2, 3, 1, 4], [1, 1], [1] * 10, [3]]
    table = sequence_table(spark, seqs)
    got = {}
    for r in frequency.frequency_vectors(table, 5).collect():
        got.setdefault(r.seq_id, {})[r.slot] = r.x
    assert got["0"] == {7: 0.25, 13: 0.25, 19: 0.25, 20: 0.25}
    assert got["1"] == {6: pytest.approx(1 / 3), 7: pytest.approx(1 / 3), 14: pytest.approx(1 / 3)}
    assert got["4"] == {6: 1.0} == got["5"]
    assert "6" not in got
    rows = frequency.detect(table, 5, 2, min_share=0.4).collect()
    labels = {r.seq_id: r.label for r in rows}
    assert len(rows) == 6 and labels["4"] == labels["5"]
    assert sum({r.label: r.cluster_size for r in rows}.values()) == 6
    assert all(r.is_anomaly == (r.cluster_size / 6 < 0.4) for r in rows)


def test_directional_golden(spark):
    seqs = sequence_table(spark, [[0] * 4, [0] * 7, [0] * 2, [0] * 5, [1, 2, 3, 4, 4, 4, 4, 4, 4], [2]])
    rows = {r.seq_id: r for r in directional.detect(seqs, 5, 100).collect()}
    assert set(rows) == {"0", "1", "2", "3", "4"}
    assert rows["0"].score == pytest.approx(0.0298574999, abs=1e-9)
    assert rows["4"].score == pytest.approx(0.7574643750, abs=1e-9)
    assert [k for k, r in rows.items() if r.is_anomaly] == ["4"]
    assert rows["0"].threshold == pytest.approx(0.2148991, abs=1e-7)
    assert chi2_quantile(0.99, 24) == pytest.approx(42.9798201, abs=1e-6)
    scores = directional.direction_scores(directional.direction_vectors(seqs, 5))
    mean = sum(r.score for r in scores.collect()) / 5
    assert directional.estimate_kappa(scores, 5) == pytest.approx(24 / (2 * mean))
