"""Byte-level BPE by dynamic programming over prefixes.

Exactly one token can end the encoding of a byte prefix: the one that fits the last token of the
prefix before it. Two tokens fit when merging their bytes gives the same two tokens back. With the last token
of every prefix stored, appending bytes never touches what is stored, and after an edit the rest is taken over
as soon as it agrees for the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, whole_text

REMEMBERED = 800_000
LONGEST = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._fits: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging: the adjacent pair of lowest rank first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            lowest = min((r for r in ranked if r[0] is not None), default=None)
            if lowest is None:
                break
            i = lowest[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) >= REMEMBERED:
                self._fits.clear()
            known = self._fits[pair] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known


class PrefixEncoding:
    """The encoding of one piece of bytes, with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _token_at(self, end: int) -> int:
        ranks, fits, last, data = self.vocabulary.ranks, self.vocabulary.fits, self.last, self.data
        for start in range(max(0, end - self.vocabulary.longest), end):
            token = ranks.get(data[start:end])
            if token is not None and (start == 0 or fits(last[start - 1], token)):
                return token
        raise ValueError("a byte of the text is not in the vocabulary")

    def append(self, data: bytes) -> None:
        self.data += data
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._token_at(end))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of data[start:end]; returns how many prefixes were computed anew."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[:start]
        agreed = 0
        for at in range(start + 1, len(self.data) + 1):
            token = self._token_at(at)
            self.last.append(token)
            before = at - shift
            agreed = agreed + 1 if at > start + len(data) and old[before - 1] == token else 0
            if agreed >= self.vocabulary.longest:
                self.last += old[before:]
                return at - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class PieceEncoder(dict):
    """Maps a piece of text to its ids as little-endian 32-bit numbers; remembers short pieces."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.vocabulary = Vocabulary(load_ranks(path))
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = PrefixEncoding(self.vocabulary, data).ids() if whole is None else [whole]
        out = np.array(ids, dtype="<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def piece_encoder(path: str, pattern: str) -> PieceEncoder:
    """The encoder of this worker process; what it remembers lasts as long as the process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = PieceEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers) of every document; null is the empty text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = piece_encoder(ranks, pattern)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield doc_id, encoder.encode(text.as_py())

    return arrow_map(rows, "doc_id long, ids binary", run, chunk=500)


def encoded_and_decoded(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids of each document and what they decode to.

    Whole texts, one pass. A null or empty text has no ids and the digests of nothing. Repeated rows and
    ids give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = piece_encoder(ranks, pattern)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py())
                yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()

    return arrow_map(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
