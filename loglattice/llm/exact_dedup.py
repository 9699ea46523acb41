"""Exact dedup with a heavy-hitter split.

Digests of whole texts are summarised per partition by Misra-Gries counters; the merged summaries
name every digest that could hold more than 2/(k+1) of the rows, at most k+1 of them. Those are counted
exactly, their winners broadcast (the size bound is k+1 rows), and their rows never enter the shuffle.
All other digests are grouped by an ordinary shuffle, where no group can be large.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, store, whole_text

COUNTERS = 1024


def shrink(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """The mergeable form of the Misra-Gries step: lower all by the (k+1)-th largest count.

    Every kept count is too low by at most (rows taken so far) / (counters + 1).
    """
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def frequent_digests(digests: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Digests that may hold more than 2/(counters+1) of the rows; none of those is missing.

    At most counters + 1 rows, since the lowered counts add up to no more than the number of rows.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for item in pc.value_counts(batch.column(0)).to_pylist():
                held[item["values"]] = held.get(item["values"], 0) + item["counts"]
            held = shrink(held, counters)
        yield from held.items()

    rows = digests.count()
    summed = arrow_map(digests.select(column), f"{column} string, lowered long", summaries).groupBy(column).agg(F.sum("lowered").alias("lowered"))
    return summed.where(F.col("lowered") * (counters + 1) >= rows).select(column)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as the empty text. Of equal texts the row
    with the largest id stays. A null id loses to any other and keep_id is null only if all ids
    of the group are; rows that repeat id and text are all marked kept, as one cannot tell them apart. Other
    columns are ignored; an empty table gives no rows.
    """
    digests = store(docs.select(F.col(id_col).alias("doc_id"), F.sha2(whole_text(text_col), 256).alias("text_sha256")), "digests")
    frequent = frequent_digests(digests, "text_sha256", counters)
    totals = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = store(digests.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(*totals), "winners")
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    light = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    light = light.select("*", F.max("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return light.unionByName(heavy).select("doc_id", "keep_id", "group_size", kept, "text_sha256")
