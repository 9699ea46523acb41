"""Context-triggered piecewise hashing of whole texts.

A rolling hash of seven bytes ends a chunk wherever it falls below a threshold set by the block size; one
character of each chunk's checksum makes the signature. A fingerprint is block size, signature, and the
signature at twice the block size: "block:signature:signature2". Signatures of equal block size are
compared by edit distance, so an insertion or replacement costs only the chunks that it touches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, bucket_of, partitions, range_bounds, whole_text

WINDOW = 7
MULTIPLIER = np.uint32(0x01000193)
MIX = np.uint32(0x9E3779B1)
SMALLEST, CHUNKS = 3, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ROWS_PER_BUCKET = 500


def rolling(data: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the last WINDOW bytes, at every byte."""
    values = data.astype(np.uint32)
    out, factor = values.copy(), np.uint32(1)
    with np.errstate(over="ignore"):
        for back in range(1, WINDOW):
            factor = factor * MULTIPLIER
            out[back:] += values[:-back] * factor
        out *= MIX
        out ^= out >> np.uint32(15)
        out *= MIX
    return out


def signature(data: bytes, ends: np.ndarray) -> str:
    """One character per chunk; a rest behind the last border is a chunk as well."""
    out, start = [], 0
    for end in ends.tolist():
        out.append(ALPHABET[zlib.crc32(data[start : end + 1]) & 63])
        start = end + 1
    if start < len(data):
        out.append(ALPHABET[zlib.crc32(data[start:]) & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text; the empty text has block size SMALLEST and empty signatures.

    The block size is the smallest, of SMALLEST times a power of two, that gives about CHUNKS chunks by the
    length; it is doubled while there are more and halved while there are fewer than half of that.
    """
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return f"{SMALLEST}::"
    hashes = rolling(np.frombuffer(data, np.uint8))
    size = SMALLEST
    while size * CHUNKS < len(data):
        size *= 2
    ends = lambda block: np.flatnonzero(hashes < np.uint32(0xFFFFFFFF // block))
    found = ends(size)
    if len(found) > CHUNKS:
        while len(found) > CHUNKS:
            size *= 2
            found = ends(size)
    else:
        while size > SMALLEST and len(found) < CHUNKS // 2:
            finer = ends(size // 2)
            if len(finer) > CHUNKS:
                break
            size, found = size // 2, finer
    wider = found[hashes[found] < np.uint32(0xFFFFFFFF // (2 * size))]
    return f"{size}:{signature(data, found)}:{signature(data, wider)}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the best 1 - distance / longer length over signatures of equal block size; 1 for equal prints.

    No common block size: 0.
    """
    part = lambda c, i: F.get(F.split(c, ":"), i)
    size = lambda c, i: part(c, 0).cast("double") * (i)

    def near(i: int, j: int) -> Column:
        x, y = part(a, i), part(b, j)
        return F.when(size(a, i) == size(b, j), 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))

    best = F.coalesce(F.greatest(*[F.coalesce(near(i, j), F.lit(0.0)) for i in (1, 2) for j in (1, 2)]), F.lit(0.0))
    return F.when(a == b, 1.0).otherwise(best)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; null is the empty text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield doc_id, fingerprint(text.as_py())

    return arrow_map(rows, "doc_id long, fingerprint string", run)


def fingerprints_with_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness, one row per input row.

    The edited form has its last floor(n/2) code points replaced by the first of the next document
    in descending id order (the last row's next is the first row). Rows of one id follow each other by text, null ids come
    last, a single row is its own neighbour, an empty table gives no rows; null is the empty text.

    Ranges of ids become sorted buckets; each bucket also gets the first row of the one below it, so a
    neighbour is always at hand and nothing but one row per bucket is copied.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    bucket = bucket_of(range_bounds(rows, "doc_id", ROWS_PER_BUCKET))
    heads = rows.select("doc_id", bucket("doc_id").alias("b")).groupBy("b").agg(F.max("doc_id").alias("head")).collect()
    above = sorted(r["b"] for r in heads)
    # The first row of a bucket (largest id) follows the last row of the bucket above it.
    target = [(r["head"], above[(above.index(r["b"]) + 1) % len(above)]) for r in heads]
    heads = F.broadcast(docs.sparkSession.createDataFrame(target, "head long, extra int"))
    placed = rows.join(heads, F.col("doc_id").eqNullSafe(F.col("head")), "left").withColumn("own", bucket("doc_id"))
    no, yes = F.lit(False), F.lit(True)
    places = F.array_compact(F.array(F.struct(F.col("own").alias("b"), no.alias("x")), F.when(F.col("extra").isNotNull(), F.struct(F.col("extra").alias("b"), yes.alias("x")))))
    placed = placed.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.b", "place.x")
    placed = placed.repartition(partitions(docs.sparkSession), "b").sortWithinPartitions("b", "x", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None  # the row that waits for its neighbour: id, text, print, bucket
        for batch in batches:
            ids, texts, buckets, extra = (batch.column(i) for i in range(4))
            for doc_id, text, b, x in zip(ids.to_pylist(), texts, buckets.to_pylist(), extra.to_pylist(), strict=True):
                if x and (held is None or held[3] != b):
                    continue  # a further copy of the neighbour's id
                text = text.as_py()
                own = fingerprint(text)
                if held is not None:
                    before, n = held[1], len(held[1])
                    edited = before[: n - n // 2] + text[: n // 2]
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    yield held[0], n, digest, held[2], fingerprint(edited), own
                held = None if x else (doc_id, text, own, b)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    out = arrow_map(placed, schema, run)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
