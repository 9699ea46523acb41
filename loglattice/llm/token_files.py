"""Token files: documents in id order, each shard's ids as one compressed wavelet matrix.

Ranges of ids become buckets, sorted inside; only text crosses the shuffle and ids are made where they
are written. A bucket is cut into shards of about ``SHARD_TOKENS`` ids, whole documents each. A shard is one
row of a Parquet table in the shared folder, written by Spark's own committed writer, so a lost executor or
a second attempt leaves no half file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, bucket_of, partitions, range_bounds, whole_text
from loglattice.llm.wavelet import WaveletMatrix
from loglattice.llm.word_tokens import word_encoder

SHARD_TOKENS = 1 << 20
WIDTH = 16
ROWS_PER_BUCKET = 500
SHARD = "bucket int, shard int, n_docs long, n_tokens long, doc_ids array<long>, lengths array<long>, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each with ``end_id`` appended, under ``path``.

    Ascending by id, rows of the same id by text, null ids first. A null or empty text is the end id
    alone. One document is never cut, so a shard holds more than SHARD_TOKENS only for the sake of its last one.
    """
    bounds = range_bounds(docs, id_col, ROWS_PER_BUCKET)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("bucket", bucket_of(bounds)("doc_id"))
    rows = rows.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder, pack = word_encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        bucket, shard, ids, held, size = None, 0, [], [], 0

        def flush() -> tuple:
            values = np.frombuffer(b"".join(held), "<u4")
            lengths = [len(h) // 4 for h in held]
            data = pack.compress(WaveletMatrix.build(values, WIDTH).to_bytes())
            return bucket, shard, len(ids), len(values), list(ids), lengths, data

        for batch in batches:
            for doc_id, text, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if ids and (b != bucket or size >= SHARD_TOKENS):
                    yield flush()
                    shard, ids, held, size = (shard + 1 if b == bucket else 0), [], [], 0
                bucket = b
                ids.append(doc_id)
                held.append(encoder.encode(text.as_py()) + end)
                size += len(held[-1]) // 4
        if ids:
            yield flush()

    arrow_map(rows, SHARD, shards, chunk=1).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from the ids read back.

    ``start`` counts the ids of all documents before it. The driver holds one total per bucket;
    buckets are bounded by the session's partitions.
    """
    files = spark.read.schema(SHARD).parquet(path)
    totals = {(r["bucket"], r["shard"]): r["n"] for r in files.select("bucket", "shard", F.col("n_tokens").alias("n")).collect()}
    starts, at = {}, 0
    for key in sorted(totals):
        starts[key], at = at, at + totals[key]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(unpack.decompress(row["data"])).values().astype("<u4")
                here = 0
                for doc_id, n in zip(row["doc_ids"], row["lengths"], strict=True):
                    own = ids[here : here + n]
                    yield doc_id, starts[row["bucket"], row["shard"]] + here, n, zlib.crc32(own.tobytes())
                    here += n

    return arrow_map(files, "doc_id long, start long, n_tokens long, ids_crc32 long", read)
