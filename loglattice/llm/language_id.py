"""Language identification by a linear-chain conditional random field over words.

A word's score for a language is a sum of learned weights of its affixes, character n-grams and, if it is in
the lexicon, of itself; neighbouring labels are tied by learned transitions. Forward-backward gives every word a
probability for each language, so a text that switches languages gets its words labelled one by one. A
document's language has the largest mean probability over its words with letters.

The model is fitted on a bounded sample of labelled documents; prediction is one pass over whole texts. Emissions
are kept per distinct word, and the chains of a batch run side by side, longest first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, whole_text

#: Bounds of the training sample: documents for each language, and their characters.
SAMPLE_DOCS = 200
SAMPLE_CHARS = 20_000
LEXICON = 400
BUCKETS = 1 << 17
STEPS = 40
RATE, DECAY = 0.25, 1e-4
REMEMBERED = 600_000
CHAIN_CELLS = 400_000
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def stem(chunk: str) -> str:
    """The lower-cased word without what is not a letter at its ends; empty if it has no letter."""
    word = EDGES.sub("", chunk)
    if word and not (word[0].isalpha() and word[-1].isalpha()):  # number characters such as a raised 2 are no letters
        letters = [i for i, c in enumerate(word) if c.isalpha()]
        word = word[letters[0] : letters[-1] + 1] if letters else ""
    return word.lower()


def features(word: str, lexicon: frozenset[str] | set[str]) -> list[int]:
    """Buckets of the affixes up to three letters, the 2- and 3-grams with borders, and the word if it is known."""
    names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    framed = f"^{word}$"
    names += [f"g{framed[i : i + k]}" for k in (2, 3) for i in range(len(framed) - k + 1)]
    if word in lexicon:
        names.append(f"w{word}")
    return [xxhash.xxh32_intdigest(n) & (BUCKETS - 1) for n in names]


@dataclass
class Field:
    """The fitted model; no larger than BUCKETS weights per language and the lexicon."""

    labels: list[str]
    lexicon: frozenset[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _scores: list[np.ndarray] = field(default_factory=list, repr=False)

    def word_scores(self, word: str) -> np.ndarray:
        if not word:
            return np.zeros(len(self.labels), np.float32)
        return self.weights[features(word, self.lexicon)].sum(axis=0)


def chains(lengths: np.ndarray, cells: int = CHAIN_CELLS) -> Iterator[np.ndarray]:
    """Positions of the chains, longest first, in groups of at most ``cells`` padded places (one chain at least)."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order) and lengths[order[at]]:
        size = max(1, cells // int(lengths[order[at]]))
        yield order[at : at + size]
        at += size


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (place, chain, label) and the summed expected transitions.

    ``scores`` is (place, chain, label), padded; lengths fall along the chains, so the ones still running
    at a place are the first ones. Messages are normalised at every place; places behind a chain's end have probability 0.
    """
    places, count, _ = scores.shape
    psi = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max()).astype(np.float32)
    running = np.searchsorted(-lengths, -np.arange(places), side="left")
    alpha, beta = np.zeros_like(psi), np.ones_like(psi)
    alpha[0] = psi[0] * np.exp(start - start.max()).astype(np.float32)
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for t in range(1, places):
        n = running[t]
        a = (alpha[t - 1, :n] @ move) * psi[t, :n]
        alpha[t, :n] = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
    expected = np.zeros_like(transitions)
    for t in range(places - 2, -1, -1):
        n = running[t + 1]
        ahead = psi[t + 1, :n] * beta[t + 1, :n]
        b = ahead @ move.T
        pair = np.maximum((alpha[t, :n] * b).sum(axis=1, keepdims=True), 1e-30)
        expected += move * (alpha[t, :n].T @ (ahead / pair))
        beta[t, :n] = b / np.maximum(b.sum(axis=1, keepdims=True), 1e-30)
    post = alpha * beta
    return post / np.maximum(post.sum(axis=2, keepdims=True), 1e-30), expected


def spliced(texts: Sequence[str], labels: Sequence[int], seed: int = 7) -> list[list[tuple[str, int]]]:
    """Chains of (word, label) that switch between documents every 10 to 80 words, so that switches are learned."""
    random = np.random.default_rng(seed)
    parts = []
    for text, label in zip(texts, labels, strict=True):
        words, at = [w for c in text.split() if (w := stem(c))], 0
        while at < len(words):
            size = int(random.integers(10, 80))
            parts.append([(w, label) for w in words[at : at + size]])
            at += size
    order = random.permutation(len(parts))
    return [[w for p in order[i : i + 8] for w in parts[p]] for i in range(0, len(parts), 8)]


def fit(texts: Sequence[str], langs: Sequence[str]) -> Field:
    """Maximise the conditional likelihood of the labels by scaled gradient steps over all chains."""
    names = sorted(set(langs))
    k = len(names)
    if not names:
        return Field([], frozenset(), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    sequences = [c for c in spliced(texts, [names.index(x) for x in langs]) if c]
    counts = [Counter() for _ in names]
    for chain in sequences:
        for word, label in chain:
            counts[label][word] += 1
    lexicon = frozenset(w for c in counts for w, _ in c.most_common(LEXICON))
    rows: dict[str, int] = {}
    chain_rows = [np.array([rows.setdefault(w, len(rows)) for w, _ in c]) for c in sequences]
    chain_gold = [np.array([g for _, g in c]) for c in sequences]
    lists = [features(w, lexicon) for w in rows]
    flat, sizes = np.concatenate([np.array(x) for x in lists]) if lists else np.zeros(0, int), np.array([len(x) for x in lists])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    lengths = np.array([len(c) for c in chain_rows])
    groups = list(chains(lengths))
    gold_moves, gold_start = np.zeros((k, k)), np.zeros(k)
    gold_words = np.zeros((len(rows), k))
    for r, g in zip(chain_rows, chain_gold, strict=True):
        np.add.at(gold_words, (r, g), 1)
        np.add.at(gold_moves, (g[:-1], g[1:]), 1)
        gold_start[g[0]] += 1
    weights, transitions, start = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k)
    squares = [np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)]
    total = max(1, int(lengths.sum()))
    for _ in range(STEPS if rows else 0):
        table = np.add.reduceat(weights[flat], begins, axis=0)
        words, moves, first = gold_words.copy(), gold_moves.copy(), gold_start.copy()
        for group in groups:
            size, longest = lengths[group], int(lengths[group[0]])
            padded = np.zeros((longest, len(group)), np.int64)
            for j, c in enumerate(group):
                padded[: len(chain_rows[c]), j] = chain_rows[c]
            post, expected = forward_backward(table[padded], size, transitions, start)
            real = np.arange(longest)[:, None] < size[None, :]
            for j in range(k):
                words[:, j] -= np.bincount(padded[real], weights=post[..., j][real], minlength=len(rows))
            moves -= expected
            first -= post[0].sum(axis=0)
        spread = np.repeat(words, sizes, axis=0)
        slope = np.stack([np.bincount(flat, weights=spread[:, j], minlength=BUCKETS) for j in range(k)], axis=1)
        for value, grad, square in ((weights, slope, squares[0]), (transitions, moves, squares[1]), (start, first, squares[2])):
            grad = grad / total - DECAY * value
            square += grad**2
            value += RATE * grad / (np.sqrt(square) + 1e-8)
    return Field(names, lexicon, weights, transitions, start)


def learning_rows(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: the checksum of the id as text leaves another remainder than 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fit on about ``sample_docs`` documents per language (twice that at most), chosen by a hash of the id.

    Only rows of ``learning_rows`` with a text and a language count; texts over SAMPLE_CHARS are not sampled.
    """
    rows = docs.where(learning_rows(id_col)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    usable = rows.where(f"t IS NOT NULL AND l IS NOT NULL AND length(t) BETWEEN 1 AND {SAMPLE_CHARS}")
    counts = {r["l"]: r["count"] for r in usable.groupBy("l").count().collect()}
    if not counts:
        return fit([], [])
    space = 1 << 30
    limits = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(space * min(1.0, sample_docs / n))))])
    # Distinct from the remainders that hold documents out.
    chosen = usable.where(F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(space)) < limits[F.col("l")])
    sample = sorted((r["i"] if r["i"] is not None else -1, r["t"], r["l"]) for r in chosen.limit(2 * sample_docs * len(counts)).collect())
    return fit([t for _, t, _ in sample], [x for _, _, x in sample])


class Labeller:
    """Applies a fitted field; remembers the row of each chunk and the scores of each stem."""

    def __init__(self, model: Field):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.labels)), np.float32)
        self.lettered = np.zeros(1024, bool)

    def _row(self, chunk: str) -> int:
        word = stem(chunk)
        row = self.stems.get(word)
        if row is None:
            row = self.stems[word] = len(self.stems)
            if row >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.lettered = np.concatenate([self.lettered, np.zeros_like(self.lettered)])
            self.scores[row] = self.model.word_scores(word)
            self.lettered[row] = bool(word)
        self.rows[chunk] = row
        return row

    def word_rows(self, text: str) -> np.ndarray:
        get, row = self.rows.get, self._row
        return np.array([r if (r := get(c)) is not None else row(c) for c in text.split()], dtype=np.int64)

    def label(self, texts: Sequence[str], keep: bool = False) -> list:
        """(mean probabilities or None, word probabilities if ``keep``) for each text."""
        if len(self.rows) > REMEMBERED:
            self.forget()
        rows = [self.word_rows(t) for t in texts]
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        out: list = [(None, None)] * len(texts)
        if not self.model.labels:
            return out
        for group in chains(lengths):
            size, longest = lengths[group], int(lengths[group[0]])
            padded = np.zeros((longest, len(group)), np.int64)
            for j, c in enumerate(group):
                padded[: len(rows[c]), j] = rows[c]
            post, _ = forward_backward(self.scores[padded], size, self.model.transitions, self.model.start)
            counted = self.lettered[padded] & (np.arange(longest)[:, None] < size[None, :])
            n = counted.sum(axis=0)
            mean = (post * counted[..., None]).sum(axis=0) / np.maximum(n, 1)[:, None]
            for j, c in enumerate(group.tolist()):
                out[c] = (mean[j] if n[j] else None, post[: len(rows[c]), j] if keep else None)
        return out


def predict(docs: DataFrame, model: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Null texts and texts without a letter are ``und`` with score 0; so is every text when the model has learned no
    language. Ties go to the first label in alphabetical order. Repeated rows and ids give repeated rows; a null id is
    not held out; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(~learning_rows(id_col), F.lit(False)).alias("held_out"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        labeller = Labeller(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = labeller.label(part.column(2).to_pylist())
                for doc_id, held, (mean, _) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), found, strict=True):
                    if mean is None:
                        yield doc_id, held, "und", 0.0
                    else:
                        best = int(mean.argmax())
                        yield doc_id, held, model.labels[best], min(1.0, float(mean[best]))

    return arrow_map(rows, "doc_id long, held_out boolean, lang_pred string, score double", run)


def label_words(docs: DataFrame, model: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one (word, lang, probability) per white-space separated word, in order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        labeller = Labeller(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(1).to_pylist()
                for doc_id, text, (_, post) in zip(part.column(0).to_pylist(), texts, labeller.label(texts, keep=True), strict=True):
                    best = [] if post is None else post.argmax(axis=1)
                    yield doc_id, [
                        {"word": w, "lang": model.labels[b], "probability": float(p[b])} for w, b, p in zip(text.split(), best, post if post is not None else [], strict=False)
                    ]

    return arrow_map(rows, "doc_id long, words array<struct<word:string,lang:string,probability:double>>", run, chunk=200)
