"""Ids of the word tokenizer, looked up chunk by chunk.

The tokenizer never forms a token across white space, so a text may be cut at spaces and line ends and
the ids of a chunk remembered. A chunk met for the first time goes to the tokenizers library; one that is a run
of letters followed by plain punctuation is first cut at that border, where the tokenizer cuts too, and one of
Latin letters only goes straight to the tokenizer's merges, as its other steps leave it alone.
"""

from __future__ import annotations

import os
import re

import numpy as np

LONGEST = 64
REMEMBERED = 800_000
# Latin letters that stay single letters when lower-cased and normalised (not the dotted capital I).
WORD_AND_MARKS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?*#$%&|]+)")
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if visible Latin-1, else the next one above 255."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    above = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(above)) for b in range(256)]


class WordEncoder(dict):
    """Maps a chunk without spaces to its ids as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()

    def _ids(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST:
            return self._ids(chunk)
        if LATIN.fullmatch(chunk):
            if chunk != (low := chunk.lower()):
                ids = self[low]
            else:
                merged = self.tokenizer.model.tokenize("".join([self.letters[b] for b in chunk.encode()]))
                ids = np.array([t.id for t in merged], dtype="<u4").tobytes()
        elif parts := WORD_AND_MARKS.fullmatch(chunk):
            ids = self[parts[1]] + self[parts[2]]
        else:
            ids = self._ids(chunk) if chunk else b""
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process; its memory lasts as long as the process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
