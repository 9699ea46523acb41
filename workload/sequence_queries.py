"""Sequence building, transition statistics and the sequence detectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loglattice.operators import evaluate, transitions
from loglattice.operators.features import one_client
from loglattice.operators.thresholds import flag
from loglattice.operators import sequences as sq
from loglattice.operators.detectors import directional, frequency, markov, session, similarity
from loglattice.functions.similarity import lcs_length, lcs_similarity
from loglattice.plans import detection
from loglattice.sources import tables
from loglattice.session import shared_folder
from workload.registry import (
    C, CHUNK_SEQS, CLIENT_SEQS, COUNTS, MOVES, STATES, VISITS, query, rounded, table, visits, with_,
)

EMIT = "SELECT seq_id, pos, state FROM seqs"
GAP = 12 * 3600


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 7")
def client_filter(spark, folder):
    return one_client(table(spark, folder, "events"), 7, "user_id").select("event_id", "event_type", "value")


@query(with_(VISITS) + "SELECT DISTINCT client_ip FROM visits")
def distinct_clients(spark, folder):
    return visits(spark, folder).select("client_ip").distinct()


@query(with_(VISITS) + "SELECT DISTINCT server_ip FROM visits")
def distinct_servers(spark, folder):
    return visits(spark, folder).select("server_ip").distinct()


@query(with_(VISITS, CLIENT_SEQS) + EMIT)
def seq_by_client(spark, folder):
    return sq.by_client(visits(spark, folder))


@query(with_(VISITS, CLIENT_SEQS) + EMIT)
def seq_without_gap(spark, folder):
    return sq.by_time_gap(visits(spark, folder), gap=None)


@query(
    with_(
        VISITS,
        f"""gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL {GAP} SECOND THEN 1 ELSE 0 END AS cut
  FROM visits WINDOW w AS (PARTITION BY client_ip ORDER BY ts, row_id)),
named AS (SELECT *, client_ip || '_' || CAST(sum(cut) OVER (PARTITION BY client_ip ORDER BY ts, row_id) AS VARCHAR)
  AS seq_id FROM gaps),
seqs AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY ts, row_id) - 1 AS pos, label AS state
  FROM named)""",
    )
    + EMIT
)
def seq_time_gap(spark, folder):
    return sq.by_time_gap(visits(spark, folder), gap=GAP)


@query(with_(VISITS, CHUNK_SEQS) + EMIT)
def seq_chunks(spark, folder):
    return sq.by_chunk(visits(spark, folder))


@query(
    with_(VISITS)
    + """SELECT client_ip || '_' || server_ip AS seq_id,
  row_number() OVER (PARTITION BY client_ip, server_ip ORDER BY ts, row_id) - 1 AS pos, label AS state FROM visits"""
)
def seq_pair(spark, folder):
    return sq.by_pair(visits(spark, folder))


@query(
    with_(
        VISITS,
        """marked AS (SELECT *, CASE WHEN lag(server_ip) OVER (PARTITION BY client_ip ORDER BY ts, row_id)
  IS DISTINCT FROM server_ip THEN 1 ELSE 0 END AS opens FROM visits),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY client_ip ORDER BY ts, row_id) AS run,
  sum(opens) OVER (PARTITION BY client_ip, server_ip ORDER BY ts, row_id) - 1 AS nth FROM marked)""",
    )
    + """SELECT client_ip || '_' || server_ip || '_' || CASE WHEN nth < 1000 THEN lpad(CAST(nth AS VARCHAR), 3, '0')
    ELSE CAST(nth AS VARCHAR) END AS seq_id,
  row_number() OVER (PARTITION BY client_ip, run ORDER BY ts, row_id) - 1 AS pos, label AS state FROM runs
  QUALIFY run < max(run) OVER (PARTITION BY client_ip)"""
)
def seq_runs_but_the_last(spark, folder):
    return sq.by_server_run(visits(spark, folder), drop_last_run=True)


@query(
    with_(
        VISITS,
        """marked AS (SELECT *, CASE WHEN lag(server_ip) OVER (PARTITION BY client_ip ORDER BY ts, row_id)
  IS DISTINCT FROM server_ip THEN 1 ELSE 0 END AS opens FROM visits),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY client_ip ORDER BY ts, row_id) AS run,
  sum(opens) OVER (PARTITION BY client_ip, server_ip ORDER BY ts, row_id) - 1 AS nth FROM marked)""",
    )
    + """SELECT client_ip || '_' || server_ip || '_' || CASE WHEN nth < 1000 THEN lpad(CAST(nth AS VARCHAR), 3, '0')
    ELSE CAST(nth AS VARCHAR) END AS seq_id,
  row_number() OVER (PARTITION BY client_ip, run ORDER BY ts, row_id) - 1 AS pos, label AS state FROM runs"""
)
def seq_runs(spark, folder):
    return sq.by_server_run(visits(spark, folder))


@query(
    "SELECT l.row_id, l.server_ip, r.label FROM (SELECT event_id AS row_id, event_type AS server_ip FROM events) l "
    + "JOIN ("
    + with_(VISITS)
    + "SELECT row_id, label FROM visits) r ON l.row_id = r.row_id"
)
def labels_attached(spark, folder):
    rows = visits(spark, folder)
    return sq.attach_labels(rows.select("row_id", "server_ip"), rows.select("row_id", "label"))


@query(
    with_(VISITS)
    + """SELECT row_id, CASE WHEN label = 3 THEN (SELECT max(CASE WHEN label = 3 THEN -1 ELSE label END) + 1 FROM visits)
  ELSE label END AS label FROM visits"""
)
def noise_as_state(spark, folder):
    """State 3 taken as noise (-1) becomes a state after the others."""
    rows = visits(spark, folder).select("row_id", F.when(F.col("label") == 3, -1).otherwise(F.col("label")).alias("label"))
    return detection.noise_as_state(rows)


@query(with_(VISITS, CLIENT_SEQS, MOVES) + "SELECT * FROM moves")
def adjacent_states(spark, folder):
    return sq.adjacent(sq.by_client(visits(spark, folder)))


@query(
    with_(VISITS, CLIENT_SEQS, MOVES, COUNTS)
    + """SELECT from_state, to_state, n, from_total, grand_total, round(n / from_total, 6) AS p,
  round(1.0::DOUBLE * n * n / (1.0::DOUBLE * from_total * grand_total), 6) AS pq FROM trans"""
)
def transition_table(spark, folder):
    return rounded(transitions.transition_table(sq.by_client(visits(spark, folder))), "p", "pq")


@query(
    with_(VISITS, CLIENT_SEQS, MOVES)
    + "SELECT from_state, "
    + ", ".join(f"count(*) FILTER (to_state = {s}) AS to_{s}" for s in STATES.values())
    + ", count(to_state) AS total FROM moves GROUP BY from_state"
)
def transition_matrix(spark, folder):
    trained = transitions.train(sq.by_client(visits(spark, folder)))
    return transitions.transition_matrix(trained, list(STATES.values()))


MARKOV = """scores AS (SELECT m.seq_id, coalesce(-avg(log2(n / from_total)), 0) AS score
  FROM moves m LEFT JOIN trans t ON m.from_state = t.from_state AND m.to_state = t.to_state GROUP BY m.seq_id)"""


@query(with_(VISITS, CHUNK_SEQS, MOVES, COUNTS, MARKOV) + "SELECT seq_id, round(score, 6) AS score FROM scores")
def markov_scores(spark, folder):
    return rounded(markov.markov_scores(sq.by_chunk(visits(spark, folder)), max_length=10), "score")


@query(
    with_(VISITS, CLIENT_SEQS, MOVES, COUNTS, MARKOV)
    + """SELECT seq_id, round(score, 6) AS score, eps, score > eps AS is_anomaly
  FROM scores, (VALUES (2.3::DOUBLE), (2.32::DOUBLE)) e(eps)"""
)
def markov_flags(spark, folder):
    return rounded(markov.detect(sq.by_client(visits(spark, folder)), [2.3, 2.32]), "score")


@query(
    with_(
        VISITS,
        CLIENT_SEQS.replace("seqs AS", "whole AS"),
        "parts AS (SELECT seq_id || '_' || CAST(pos // 10 AS VARCHAR) AS seq_id, pos, state FROM whole)",
        "seqs AS (SELECT * FROM whole)",
        MOVES,
        COUNTS,
        "rows_ AS (SELECT DISTINCT from_state, from_total FROM trans)",
    )
    + """SELECT m.seq_id, round(coalesce(-avg(log2((coalesce(t.n, 0) + 0.5) / (r.from_total + 2.5))), 0), 6) AS score
  FROM (SELECT seq_id, state AS from_state, lead(state) OVER (PARTITION BY seq_id ORDER BY pos) AS to_state FROM parts) m
  LEFT JOIN trans t ON m.from_state = t.from_state AND m.to_state = t.to_state
  LEFT JOIN rows_ r ON m.from_state = r.from_state AND m.to_state IS NOT NULL GROUP BY m.seq_id"""
)
def markov_smoothed(spark, folder):
    """Chunks scored under the transitions of whole clients, with add-alpha smoothing."""
    rows = visits(spark, folder)
    whole = sq.by_client(rows)
    trained = transitions.train(whole)
    parts = whole.select(
        F.concat_ws("_", "seq_id", F.floor(F.col("pos") / 10).cast("string")).alias("seq_id"), "pos", "state"
    )
    return rounded(markov.markov_scores(parts, trained, alpha=0.5, states=C), "score")


SLIDING = """pqs AS (SELECT m.seq_id, m.pos, coalesce(1.0::DOUBLE * n * n / (1.0::DOUBLE * from_total * grand_total), 0) AS pq
  FROM moves m LEFT JOIN trans t ON m.from_state = t.from_state AND m.to_state = t.to_state),
positions AS (SELECT seq_id, pos, sum(pq) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)
  AS score, count(*) OVER (PARTITION BY seq_id) AS len FROM pqs)"""


@query(
    with_(VISITS, CHUNK_SEQS, MOVES, COUNTS, SLIDING)
    + "SELECT seq_id, pos, round(score, 6) AS score FROM positions WHERE len >= 5"
)
def position_scores(spark, folder):
    return rounded(session.position_scores(sq.by_chunk(visits(spark, folder)), max_length=10), "score")


SESSIONS = """sessions AS (SELECT row_id AS session_id,
  client_ip || '_' || CAST(rn // 10 AS VARCHAR) AS seq_id, rn % 10 AS pos FROM numbered),
scored AS (SELECT s.session_id, s.seq_id, s.pos, coalesce(p.score, 1000000) AS score FROM sessions s
  LEFT JOIN positions p ON s.seq_id = p.seq_id AND s.pos = p.pos AND p.len >= 5)"""


def _sessions(spark, folder):
    """Every log row as a session, at its place among the chunks of its client."""
    rows = sq.by_client(visits(spark, folder), keep=["row_id"])
    return rows.select(
        F.col("row_id").alias("session_id"),
        F.concat_ws("_", "seq_id", F.floor(F.col("pos") / 10).cast("string")).alias("seq_id"),
        F.pmod("pos", F.lit(10)).alias("pos"),
    )


@query(
    with_(VISITS, CHUNK_SEQS, MOVES, COUNTS, SLIDING, SESSIONS)
    + "SELECT session_id, seq_id, pos, round(score, 6) AS score FROM scored"
)
def session_scores(spark, folder):
    chunks = sq.by_chunk(visits(spark, folder))
    scored = session.session_scores(_sessions(spark, folder), session.position_scores(chunks, max_length=10))
    return rounded(scored, "score").select("session_id", "seq_id", "pos", "score")


@query(
    with_(VISITS, CHUNK_SEQS, MOVES, COUNTS, SLIDING, SESSIONS)
    + """SELECT eps, count(*) FILTER (score < eps) AS anomalies, count(*) AS sessions
  FROM scored, (VALUES (0.05::DOUBLE), (0.25::DOUBLE)) e(eps) GROUP BY eps"""
)
def session_flags(spark, folder):
    chunks = sq.by_chunk(visits(spark, folder))
    flags = session.detect(chunks, _sessions(spark, folder), [0.05, 0.25], max_length=10)
    return flags.groupBy("eps").agg(
        F.count_if("is_anomaly").alias("anomalies"), F.count(F.lit(1)).alias("sessions")
    )


SLOTS = f"""slots AS (SELECT seq_id, CAST({C} * from_state + to_state AS INTEGER) AS slot, count(*) AS n FROM moves
  WHERE to_state IS NOT NULL GROUP BY ALL)"""
UNIT = """unit AS (SELECT seq_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY seq_id)) AS x FROM slots)"""
MEAN = """sums AS (SELECT slot, sum(x) AS s FROM unit GROUP BY slot),
mean AS (SELECT slot, s / sqrt((SELECT sum(s * s) FROM sums)) AS m FROM sums)"""


@query(
    with_(VISITS, CHUNK_SEQS, MOVES, SLOTS)
    + "SELECT seq_id, slot, round(n / sum(n) OVER (PARTITION BY seq_id), 6) AS x FROM slots"
)
def frequency_vectors(spark, folder):
    return rounded(frequency.frequency_vectors(sq.by_chunk(visits(spark, folder)), C, max_length=10), "x")


@query(with_(VISITS, CHUNK_SEQS) + "SELECT DISTINCT seq_id, true AS labelled, true AS size_holds, true AS flag_holds FROM seqs")
def frequency_clusters(spark, folder):
    """Every chunk with a transition is in a cluster; sizes and flags are those of the labels."""
    found = frequency.detect(sq.by_chunk(visits(spark, folder)), C, 4, min_share=0.2, max_length=10)
    whole, all_ = Window.partitionBy("label"), found.select(F.count(F.lit(1))).scalar()
    size = F.count(F.lit(1)).over(whole)
    checked = found.withColumns({"size_holds": size == F.col("cluster_size"), "flag_holds": (size / all_ < 0.2) == F.col("is_anomaly")})
    return checked.select("seq_id", F.col("label").between(0, 3).alias("labelled"), "size_holds", "flag_holds")


@query(
    """SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS cluster_size,
  count(*) OVER (PARTITION BY label) / count(*) OVER () < 0.1 AS is_anomaly FROM embeddings"""
)
def small_cluster_flags(spark, folder):
    return frequency.flag_small_clusters(table(spark, folder, "embeddings").select("vec_id", "label"))


@query(with_(VISITS, CHUNK_SEQS, MOVES, SLOTS, UNIT) + "SELECT seq_id, slot, round(x, 6) AS x FROM unit")
def direction_vectors(spark, folder):
    return rounded(directional.direction_vectors(sq.by_chunk(visits(spark, folder)), C, max_length=10), "x")


@query(with_(VISITS, CHUNK_SEQS, MOVES, SLOTS, UNIT, MEAN) + "SELECT slot, round(m, 6) AS m FROM mean")
def mean_direction(spark, folder):
    vectors = directional.direction_vectors(sq.by_chunk(visits(spark, folder)), C, max_length=10)
    return rounded(directional.mean_direction(vectors), "m")


KAPPA = 30.0


@query(
    with_(
        VISITS,
        CHUNK_SEQS,
        MOVES,
        SLOTS,
        UNIT,
        MEAN,
        "scores AS (SELECT seq_id, 1 - sum(x * m) AS score FROM unit JOIN mean USING (slot) GROUP BY seq_id)",
    )
    # 42.979820139351645 is the 0.99 quantile of the chi-square law with 24 degrees of freedom.
    + f"""SELECT seq_id, round(score, 6) AS score, round(42.979820139351645::DOUBLE / {2 * KAPPA}::DOUBLE, 6) AS threshold,
  score > 42.979820139351645::DOUBLE / {2 * KAPPA}::DOUBLE AS is_anomaly FROM scores"""
)
def direction_flags(spark, folder):
    found = directional.detect(sq.by_chunk(visits(spark, folder)), C, KAPPA, max_length=10)
    return rounded(found, "score", "threshold")


def _lcs_sql() -> str:
    """Bit-parallel LCS of all pairs of chunks (ten states at most), one column per step."""
    masks = ", ".join(
        f"CAST(sum(CASE WHEN state = {s} THEN 1 << CAST(pos AS INTEGER) ELSE 0 END) AS BIGINT) AS m{s}"
        for s in STATES.values()
    )
    steps = ", ".join(f"max(state) FILTER (pos = {p}) AS b{p}" for p in range(10))
    v = "CAST(2047 AS BIGINT)"
    chain = f"SELECT a.seq_id, a.len AS la, b.len AS lb, a.seq_id = b.seq_id AS self, a.*, b.*, {v} AS v FROM packed a, packed b"
    sql = f"packed AS (SELECT seq_id, count(*) AS len, {masks}, {steps} FROM seqs GROUP BY seq_id),\n"
    pick = "CASE {b} " + " ".join(f"WHEN {s} THEN m{s}" for s in STATES.values()) + " ELSE 0 END"
    cols_a = ", ".join(f"a.m{s}" for s in STATES.values())
    cols_b = ", ".join(f"b.b{p}" for p in range(10))
    chain = f"SELECT a.seq_id AS seq_id, a.len AS la, b.len AS lb, {cols_a}, {cols_b}, {v} AS v FROM packed a, packed b"
    for p in range(10):
        x = f"(v & ({pick.format(b=f'b{p}')}))"
        chain = f"SELECT * REPLACE (((v + {x}) | (v - {x})) & 2047 AS v) FROM ({chain})"
    return sql + f"pairs AS (SELECT seq_id, la, lb, bit_count(xor(v, 2047) & ((1 << la) - 1)) AS lcs FROM ({chain}))"


LCS_SCORES = (
    _lcs_sql()
    + """,
keyed AS (SELECT seq_id, string_agg(CAST(state AS VARCHAR), ',' ORDER BY pos) AS k FROM seqs GROUP BY seq_id),
times AS (SELECT seq_id, count(*) OVER (PARTITION BY k) AS t, count(*) OVER () AS n FROM keyed),
sums AS (SELECT seq_id, sum(lcs / sqrt(la * lb)) AS s FROM pairs GROUP BY seq_id),
scores AS (SELECT seq_id, CASE WHEN s = t THEN 100000 ELSE (n - 1) / (s - t) END AS score FROM sums JOIN times USING (seq_id))"""
)


@query(with_(VISITS, CHUNK_SEQS, LCS_SCORES) + "SELECT seq_id, round(score, 6) AS score FROM scores")
def lcs_scores(spark, folder):
    return rounded(similarity.lcs_scores(sq.by_chunk(visits(spark, folder))), "score")


@query(
    with_(VISITS, CHUNK_SEQS, LCS_SCORES)
    + """SELECT eps, count(*) FILTER (score > eps) AS anomalies FROM scores,
  (VALUES (1.9::DOUBLE), (2.1::DOUBLE)) e(eps) GROUP BY eps"""
)
def lcs_flags(spark, folder):
    flags = similarity.detect_lcs(sq.by_chunk(visits(spark, folder)), [1.9, 2.1])
    return flags.groupBy("eps").agg(F.count_if("is_anomaly").alias("anomalies"))


def _gram_sql(n: int) -> str:
    pad = "repeat('|', {0})".format(n - 1)
    return f"""texts AS (SELECT seq_id, {pad} || string_agg(CAST(state AS VARCHAR), '' ORDER BY pos) || {pad} AS txt,
  string_agg(CAST(state AS VARCHAR), '' ORDER BY pos) AS k, count(*) AS len FROM seqs GROUP BY seq_id),
grams AS (SELECT seq_id, substr(txt, CAST(i AS BIGINT), {n}) AS g, count(*) AS c FROM texts,
  LATERAL (SELECT unnest(range(1, len + {n})) AS i) GROUP BY ALL)"""


def _gram_scores_sql(n: int) -> str:
    return (
        _gram_sql(n)
        + f""",
shared AS (SELECT a.seq_id AS sa, b.seq_id AS sb, sum(least(a.c, b.c)) AS c FROM grams a JOIN grams b ON a.g = b.g
  GROUP BY ALL),
sums AS (SELECT sa AS seq_id, sum(c / (a.len + b.len + {2 * (n - 1)} - c)) AS s
  FROM shared JOIN texts a ON sa = a.seq_id JOIN texts b ON sb = b.seq_id GROUP BY sa),
times AS (SELECT seq_id, count(*) OVER (PARTITION BY k) AS t, count(*) OVER () AS n FROM texts),
scores AS (SELECT seq_id, CASE WHEN abs(s - t) < 1e-12 THEN 100000 ELSE (n - 1) / (s - t) END AS score
  FROM sums JOIN times USING (seq_id))"""
    )


@query(with_(VISITS, CHUNK_SEQS, _gram_scores_sql(2)) + "SELECT seq_id, round(score, 6) AS score FROM scores")
def ngram_scores(spark, folder):
    return rounded(similarity.ngram_scores(sq.by_chunk(visits(spark, folder)), 2, max_length=10), "score")


@query(
    with_(VISITS, CHUNK_SEQS, _gram_scores_sql(3))
    + """SELECT seq_id, round(score, 6) AS score, eps, score > eps AS is_anomaly
  FROM scores, (VALUES (20.0::DOUBLE), (40.0::DOUBLE)) e(eps)"""
)
def ngram_flags(spark, folder):
    return rounded(similarity.detect_ngram(sq.by_chunk(visits(spark, folder)), [20.0, 40.0], 3, max_length=10), "score")


def _consecutive_chunks(spark, folder):
    """Each full or partial chunk of a client with the chunk before it."""
    arrays = sq.as_arrays(sq.by_chunk(visits(spark, folder)))
    part = arrays.select(
        F.split_part("seq_id", F.lit("_"), F.lit(1)).alias("client"),
        F.split_part("seq_id", F.lit("_"), F.lit(2)).cast("int").alias("k"),
        "states",
    )
    before = part.select("client", (F.col("k") + 1).alias("k"), F.col("states").alias("a"))
    joined = part.withColumnRenamed("states", "b").join(before, ["client", "k"])
    return joined.select(F.concat_ws("_", "client", F.col("k").cast("string")).alias("pair_id"), "a", "b")


NEIGHBOURS = """named AS (SELECT DISTINCT seq_id, split_part(seq_id, '_', 1) AS client,
  CAST(split_part(seq_id, '_', 2) AS INTEGER) AS k FROM seqs),
near AS (SELECT b.seq_id AS pair_id, a.seq_id AS sa, b.seq_id AS sb FROM named a JOIN named b
  ON a.client = b.client AND b.k = a.k + 1)"""


@query(
    with_(VISITS, CHUNK_SEQS, NEIGHBOURS, _lcs_sql().replace("FROM packed a, packed b",
        ", b.seq_id AS other FROM near JOIN packed a ON a.seq_id = sa JOIN packed b ON b.seq_id = sb")
        .replace("pairs AS (SELECT seq_id,", "pairs AS (SELECT other AS pair_id,"))
    + "SELECT pair_id, CAST(lcs AS BIGINT) AS lcs, round(lcs / sqrt(la * lb), 6) AS similarity FROM pairs"
)
def lcs_of_consecutive_chunks(spark, folder):
    pairs = _consecutive_chunks(spark, folder)
    a, b = F.col("a"), F.col("b")
    out = pairs.select("pair_id", lcs_length(a, b).cast("long").alias("lcs"), lcs_similarity(a, b).alias("similarity"))
    return rounded(out, "similarity")


@query(
    with_(
        VISITS,
        CHUNK_SEQS,
        NEIGHBOURS,
        _gram_sql(2),
        """shared AS (SELECT pair_id, sum(least(a.c, b.c)) AS c FROM near JOIN grams a ON a.seq_id = sa
  JOIN grams b ON b.seq_id = sb AND a.g = b.g GROUP BY pair_id)""",
    )
    + """SELECT pair_id, round(coalesce(c, 0) / (a.len + b.len + 2 - coalesce(c, 0)), 6) AS similarity FROM near
  LEFT JOIN shared USING (pair_id) JOIN texts a ON a.seq_id = sa JOIN texts b ON b.seq_id = sb"""
)
def ngram_of_consecutive_chunks(spark, folder):
    return rounded(similarity.ngram_similarity(_consecutive_chunks(spark, folder), 2), "similarity")


TRUTH = """judged AS (SELECT doc_id, toxic, quality, eps, 1 - quality > eps AS is_anomaly
  FROM labels, (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) e(eps))"""


@query(
    with_(TRUTH,
        """cells AS (SELECT eps, count(*) FILTER (NOT is_anomaly AND toxic = 0) AS tn,
  count(*) FILTER (NOT is_anomaly AND toxic = 1) AS fn, count(*) FILTER (is_anomaly AND toxic = 0) AS fp,
  count(*) FILTER (is_anomaly AND toxic = 1) AS tp FROM judged GROUP BY eps),
rates AS (SELECT *, tn / (tn + fp) AS r1, tp / (tp + fn) AS r2 FROM cells)""")
    + """SELECT eps, tn, fn, fp, tp, round(r1, 6) AS r1, round(r2, 6) AS r2,
  round(CASE WHEN r1 + r2 = 0 THEN 0 ELSE 2 * r1 * r2 / (r1 + r2) END, 6) AS f FROM rates"""
)
def evaluation_balanced_f(spark, folder):
    scored = table(spark, folder, "labels").withColumn("score", 1.0 - F.col("quality"))
    flags = flag(scored, [0.5, 2.0])
    return rounded(evaluate.balanced_f(flags, truth="toxic", by=["eps"]), "r1", "r2", "f")


@query(
    with_("""judged AS (SELECT toxic, eps, quality < eps AS hit FROM labels, (VALUES (0.5::DOUBLE), (0.0::DOUBLE)) e(eps)),
cells AS (SELECT eps, count(*) FILTER (hit AND toxic = 1) AS tp, count(*) FILTER (hit AND toxic = 0) AS fp,
  count(*) FILTER (NOT hit AND toxic = 1) AS fn, count(*) FILTER (NOT hit AND toxic = 0) AS tn FROM judged GROUP BY eps)""")
    + "SELECT *, round(tp / (tp + fn), 6) AS dr, round(fp / (fp + tn), 6) AS fpr FROM cells"
)
def evaluation_detection_rates(spark, folder):
    scored = table(spark, folder, "labels").withColumn("score", F.col("quality").cast("double"))
    flags = flag(scored, [0.5, 0.0], low_is_anomalous=True)
    return rounded(evaluate.detection_rates(flags, truth="toxic", by=["eps"]), "dr", "fpr")


@query(with_(VISITS) + "SELECT server_ip, count(*) AS n FROM visits GROUP BY server_ip")
def table_stored_and_loaded(spark, folder):
    """The visits written as a partitioned table to the shared folder and read back."""
    stored = tables.store(visits(spark, folder), shared_folder(spark), tables.new_name("visits"), partition_by=["server_ip"])
    return stored.groupBy("server_ip").agg(F.count(F.lit(1)).alias("n"))
