"""Texts that once broke an operator: very long candidates and numbers, number characters, chains of unequal length."""

import base64
import random
from collections import Counter

import numpy as np

from loglattice.llm import language_id, pii, secret_scan


def test_chains_of_unequal_length_do_not_read_unset_memory(monkeypatch):
    def poisoned(a, *_, **__):
        return np.full(a.shape, np.nan, a.dtype)

    monkeypatch.setattr(np, "empty_like", poisoned)
    r = np.random.default_rng(2)
    lengths = np.array([9, 4, 1])
    post, expected = language_id.forward_backward(r.normal(size=(9, 3, 4)), lengths, r.normal(size=(4, 4)), r.normal(size=4))
    assert np.isfinite(post).all() and np.isfinite(expected).all()
    for c, n in enumerate(lengths):
        assert np.allclose(post[:n, c].sum(axis=1), 1) and not post[n:, c].any()
    texts = ["der hund und die katze " * 9, "the dog and the cat " * 30, "le chien et le chat " * 2] * 6
    model = language_id.fit(texts, ["de", "en", "fr"] * 6)
    labels = language_id.Labeller(model).label(["der hund und", "the dog and the cat and the dog " * 40, "le chat"])
    assert [model.labels[int(mean.argmax())] for mean, _ in labels] == ["de", "en", "fr"]
    assert all(np.isfinite(mean).all() for mean, _ in labels)


def test_number_characters_are_no_letters(spark):
    assert [language_id.stem(x) for x in ("²", "Ⅷ", "½①", "m²", "²x½", "(Haus)", "é")] == ["", "", "", "m", "x", "haus", "é"]
    model = language_id.fit(["the dog and the cat", "der hund und die katze"], ["en", "de"])
    docs = spark.createDataFrame([(1, "² Ⅷ ½"), (2, "the dog")], "doc_id long, text string")
    assert [(x["lang_pred"], x["score"] > 0) for x in language_id.predict(docs, model).orderBy("doc_id").collect()] == [("und", False), ("en", True)]


def test_addresses_of_thousands_of_zeros():
    automaton = pii.build_automaton()
    zeros = "0" * 5000
    for text, end in ((f"{zeros}.1.{zeros}255.{zeros}", 15_006 + 2), (f"1.2.3.{'9' * 5000}", None)):
        spans = [s for s in pii.scan(text, automaton) if s[2] == "ip"]
        assert spans == ([(0, 1, "ip", len(text))] if end else [])


def _hot(part, bits):
    def entropy(w):
        return -sum(n / len(w) * np.log2(n / len(w)) for n in Counter(w).values())

    return [i for i in range(len(part) - 19) if entropy(part[i : i + 20]) >= bits - 1e-12]


def test_entropy_of_long_candidates(spark):
    r = random.Random(4)
    key = base64.b64encode(r.randbytes(90_000)).decode()[:100_000]
    low = "xb1" * 700 + key[:300] + "zz9" * 700
    slug = "-".join(["ab"] * 30_000) + "-12"
    texts = [f"blob {key}", low, slug]
    got = [x["spans"] for x in secret_scan.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    bits = [b for _, p, b in secret_scan.CLASSES]
    first, inner = _hot(key, bits[2]), _hot(low, bits[2] if set("+/") & set(low) else bits[1])
    assert got == [f"entropy:{5 + first[0]}:{5 + first[-1] + 20}", f"entropy:{inner[0]}:{inner[-1] + 20}", ""]


def test_allow_list_is_narrow(spark):
    secret = ["QwErTyUiOpAsDfGhJkLzXcVb", "2024-01-02aB3dE5fG7hJ9kL1mN3pQ"]
    plain = ["theQuickBrownFoxJumpsOverTheLazyDog", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "2024-01-02T10_20_30Z", "2024-01-02-release-notes-final"]
    docs = spark.createDataFrame(list(enumerate(secret + plain)), "doc_id long, text string")
    got = [x["n_entropy"] for x in secret_scan.secret_scan(docs).orderBy("doc_id").collect()]
    assert got == [1, 1, 0, 0, 0, 0]


def test_texts_meet_their_labels_in_fewer_bytes_than_ids_of_words(spark):
    """Pipeline, quality: compressed texts are shuffled, not 64 bits for each word."""
    from loglattice.llm import quality

    words = [f"w{i * 7919 % 4000}" for i in range(4000)]
    rows = [(1, "en", " ".join(words)), (2, "de", ""), (3, None, "ä \u2028 ö")]
    found = quality.encoded(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert sum(len(v) for r in found.collect() for v in r if isinstance(v, bytearray | bytes)) < 4 * len(words)
    block = quality.blocked(found.selectExpr("*", "0 AS part"), 3).collect()
    assert sorted((d, n) for b in block for d, n in zip(b["doc_ids"], b["lengths"])) == [(1, 4000), (2, 0), (3, 2)]
