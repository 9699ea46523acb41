"""Queries over the given tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The states of the event table, in alphabetical order of the event type.
STATES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
C = len(STATES)
STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STATES.items()) + " END"


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Events as labelled log rows: the user is the client, the event type server and state."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("string").alias("client_ip"),
        F.col("event_type").alias("server_ip"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr(STATE_SQL).cast("int").alias("label"),
    )


# CTE of the same rows.
VISITS = f"""visits AS (SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS client_ip,
  event_type AS server_ip, ts, CAST({STATE_SQL} AS INTEGER) AS label FROM events)"""

CLIENT_SEQS = """seqs AS (SELECT client_ip AS seq_id,
  row_number() OVER (PARTITION BY client_ip ORDER BY ts, row_id) - 1 AS pos, label AS state FROM visits)"""

CHUNK_SEQS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY client_ip ORDER BY ts, row_id) - 1 AS rn,
  count(*) OVER (PARTITION BY client_ip) AS n FROM visits),
seqs AS (SELECT client_ip || '_' || CAST(rn // 10 AS VARCHAR) AS seq_id, rn % 10 AS pos, label AS state
  FROM numbered WHERE n - (rn // 10) * 10 >= 2)"""

MOVES = """moves AS (SELECT seq_id, pos, state AS from_state,
  lead(state) OVER (PARTITION BY seq_id ORDER BY pos) AS to_state FROM seqs)"""

COUNTS = """counts AS (SELECT from_state, to_state, count(*) AS n FROM moves
  WHERE to_state IS NOT NULL GROUP BY ALL),
trans AS (SELECT *, CAST(sum(n) OVER (PARTITION BY from_state) AS BIGINT) AS from_total,
  CAST(sum(n) OVER () AS BIGINT) AS grand_total FROM counts)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
