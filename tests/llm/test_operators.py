"""Each operator against a plain version, and on awkward tables."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loglattice.llm import (
    byte_bpe, common, components, exact_dedup, fingerprint, language_id, near_dedup, packing, pair_tiles, pii, quality, secret_scan, token_files, wavelet,
)
from loglattice.llm.common import new_folder
from loglattice.llm.word_tokens import WordEncoder
from tests.llm import brute

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of" for i in range(20_000)) + " mail me.now@host.example.org 10.1.2.3 token = abcdef123"
AWKWARD = [
    (5, None, "en", "s", 0),
    (1, "", None, "s", 0),
    (2, "same text here", "en", None, 14),
    (3, "same text here", "fr", "s", 14),
    (3, "same text here", "fr", "s", 14),
    (None, "no id at all", "en", "s", 12),
    (7, LONG, "en", "s", len(LONG)),
    (8, " \n\t ", "de", "s", 4),
    (9, "x" * 30_000, "de", "s", 30_000),
    (10, "é😀 ünï password: hunter22 +1 (555) 123-4567 ", "es", "s", 40),
]
CLASHING = ("kept", "component_id", "bucket", "b", "x", "key", "n", "ids", "part", "text_sha256", "id", "block", "row", "span", "block_id")


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(AWKWARD, COLUMNS)
    return docs.withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark, awkward):
    return spark.createDataFrame([], awkward.schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vocabulary_text(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{int(r.expovariate(1 / 60)) % words}" for _ in range(n))


# Exact dedup


def test_exact_dedup(spark, awkward, none):
    got = rows(exact_dedup.exact_dedup(awkward))
    groups = {}
    for i, t, *_ in AWKWARD:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, *_ in AWKWARD:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert rows(exact_dedup.exact_dedup(none)) == []


def test_exact_dedup_with_few_counters(spark):
    r = random.Random(4)
    texts = ["hot"] * 300 + ["warm"] * 90 + [f"t{r.randint(0, 200)}" for _ in range(400)]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for counters in (2, 7):
        got = {x["doc_id"]: x for x in exact_dedup.exact_dedup(docs, counters=counters).collect()}
        counts, last = Counter(texts), {t: i for i, t in enumerate(texts)}
        assert all(got[i]["group_size"] == counts[t] and got[i]["keep_id"] == last[t] for i, t in enumerate(texts))


def test_misra_gries_error():
    r = random.Random(1)
    items = [min(int(r.paretovariate(0.6)), 5000) for _ in range(20_000)]
    held = {}
    for at in range(0, len(items), 700):
        for k, n in Counter(items[at : at + 700]).items():
            held[k] = held.get(k, 0) + n
        held = exact_dedup.shrink(held, 20)
    assert len(held) <= 20
    for k, n in Counter(items).items():
        assert n - len(items) / 21 <= held.get(k, 0) <= n


# Personal data and secrets


def test_pii_parsers_match_the_patterns():
    r, automaton = random.Random(2), pii.build_automaton()
    parts = ["1", "2", "25", "300", "4111", "111111111111", ".", "..", "@", "a", "b-c", "+", "+1", " ", "-", "(", ")", "x.y", "%", "é", "\n", ":"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 22)))
        assert [s for s in sorted(pii.scan(text, automaton)) if s[1] < 4] == brute.pii(text)


def test_pii_added_kinds():
    text = "IBAN: DE89 3704 0044 0532 0130 00 and account no 12345678, SSN 123-45-6789 see https://a.example/x?y=1."
    kinds = {k: text[s:e] for s, _, k, e in pii.scan(text, pii.build_automaton())}
    assert kinds["iban"] == "DE89 3704 0044 0532 0130 00"
    assert kinds["account"] == "12345678" and kinds["ssn"] == "123-45-6789" and kinds["url"] == "https://a.example/x?y=1"


def test_pii_cues_in_any_case():
    automaton = pii.build_automaton()
    kinds = lambda text: [(s[2], text[s[0] : s[3]]) for s in pii.scan(text, automaton)]
    for text in ("Account Number: 123456789", "aCCount No. 123456789", "Konto NR 123456789", "account number is 123456789", "Ä Account ID: 123456789"):
        assert kinds(text) == [("account", "123456789")]
    assert kinds("Social Security Number: 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("passport: C4J8K21PZ issued") == kinds("Passport No. C4J8K21PZ") == [("passport", "C4J8K21PZ")]
    assert kinds("Passport L898902C36") == [("passport", "L898902C36")] and kinds("Passport L898902C37") == []
    assert kinds("passport REQUIRED") == [] and kinds("HTTP://a.example") == []


def _base_columns(spans, kinds):
    return (*[sum(s[1] == k for s in spans) for k in range(kinds)], hashlib.sha256(brute.joined(spans).encode()).hexdigest())


def test_pii_rows(awkward, none):
    got = rows(pii.find_pii(awkward).drop("spans"))
    assert got == sorted(((i, *_base_columns(brute.pii(t or ""), 4)) for i, t, *_ in AWKWARD), key=repr)
    assert rows(pii.find_pii(none)) == []


def test_secret_rows(spark, awkward, none):
    r = random.Random(3)
    parts = ["token", "Secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "abcdef12", "AKIA", "ABCDEFGHIJ0123456", "0123456789abcdef", "dead", "/", "-", "é", "\n", "password"]
    more = [(100 + i, "".join(r.choice(parts) for _ in range(r.randint(1, 14))), "en", "s", 0) for i in range(400)]
    docs = awkward.select(*COLUMNS.replace(",", "").split()[::2]).union(spark.createDataFrame(more, COLUMNS))
    got = rows(secret_scan.secret_scan(docs).drop("spans", "n_entropy"))
    assert got == sorted(((i, *_base_columns(brute.secrets(t or ""), 3)) for i, t, *_ in AWKWARD + more), key=repr)
    assert rows(secret_scan.secret_scan(none)) == []
    flagged = {x[0] for x in docs.where(secret_scan.has_secret()).select("doc_id").collect()}
    assert {i for i, t, *_ in AWKWARD + more if brute.secrets(t or "")} <= flagged


def test_entropy_windows(spark):
    def best(part):
        def bits(w):
            return -sum(n / len(w) * np.log2(n / len(w)) for n in Counter(w).values())

        return [i for i in range(len(part) - 19) if bits(part[i : i + 20]) >= 3.9 - 1e-12]

    key = "gggggggggggggggggggggggg+Zx9Kq2Lm8Rt5Vw1Yb4N/gggggggggggggggggggggggg"
    texts = [f"see {key} there", "a-plain-slug-of-words-12", "550e8400-e29b-41d4-a716-446655440000", "abcdefghijklmnopqrstuvwxyz"]
    got = [x["spans"] for x in secret_scan.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    hot = best(key)
    assert got == [f"entropy:{4 + hot[0]}:{4 + hot[-1] + 20}", "", "", ""]


def test_many_matches_keep_their_places(spark):
    text = " ".join("0123456789abcdef01234567" for _ in range(700))
    row = secret_scan.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_hex"] == 700 and row["base_sha256"] == hashlib.sha256(brute.joined(brute.secrets(text)).encode()).hexdigest()


# Near-duplicates


def test_near_dedup_matches_all_pairs(spark, monkeypatch):
    r, base = random.Random(5), vocabulary_text(1, 150).split()
    texts = {}
    for i in range(160):  # a group around one text, some members linked only to each other
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
        texts[1000 - i] = " ".join(w)
    for i in range(0, 40):
        texts[2000 + i] = texts[1000 - 3 * i].replace("w1 ", "W1\t", 1)
        texts[3000 + i] = " ".join(texts[1000 - 3 * i].split()[: 150 - i % 5])
    texts |= {1: "a b c", 2: "A  b\nc", 3: "a b c d", 4: None, 5: "", 6: " \t", 7: vocabulary_text(9, 5000), 8: vocabulary_text(9, 5000) + " tail"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("component_id", F.lit(1))
    want = brute.near_components(texts)
    for small, few, block in ((2, 4, 1024), (32, 4, 16), (8192, 1024, 40)):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "FEW", few)
        monkeypatch.setattr(pair_tiles, "BLOCK", block)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_dedup(docs).collect()}
        assert got == want


def test_near_dedup_awkward(awkward, none):
    got = near_dedup.near_dedup(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {(x["doc_id"], x["component_id"], x["kept"]) for x in got} >= {(3, 2, False), (2, 2, True), (None, None, True), (5, 5, True), (9, 9, True)}
    assert near_dedup.near_dedup(none).collect() == []


def test_pruning_bounds_rise_and_allow_the_threshold():
    least = near_dedup.least_matches()
    assert all(m < 0.85 * n for n, m in least.items()) and list(least.values()) == sorted(least.values())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


# Tokens


def test_word_encoder_is_the_tokenizer():
    r, own = random.Random(6), WordEncoder(TOKENIZER)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "É", "ü", "日本", "😀", "\x1c", "ñ", "'s", "'", ".", "...", "0", "12", "THE", "=", "-", "́", "<|endoftext|>", "ß", "İ", "Σ", " ", "​"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, awkward, none):
    path = new_folder(spark, "token-files")
    token_files.write_token_files(awkward, path, TOKENIZER, end_id=1)
    got = [tuple(x) for x in token_files.read_token_files(spark, path).orderBy("start").collect()]
    own, want, start = WordEncoder(TOKENIZER).tokenizer, [], 0
    for i, t, *_ in sorted(AWKWARD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    path = new_folder(spark, "token-files")
    token_files.write_token_files(none, path, TOKENIZER, end_id=1)
    assert token_files.read_token_files(spark, path).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 512, 513, 5000])
def test_wavelet_matrix(n):
    values = np.minimum(np.random.default_rng(n).zipf(1.3, n), 60_000).astype(np.uint16)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(values, 16).to_bytes())
    assert (w.values() == values).all() and [w.access(i) for i in range(0, n, 37)] == values[::37].tolist()
    for v in [*np.unique(values)[:20].tolist(), 65_000]:
        places = np.flatnonzero(values == v)
        assert w.count(v) == len(places) and w.count(v, n // 2) == (places < n // 2).sum()
        assert [w.select(v, k) for k in range(min(5, len(places)))] == places[:5].tolist() and w.select(v, len(places)) is None


def test_wavelet_rejects_damage():
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(np.arange(9), 16).to_bytes()[:-1])


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.load_ranks(RANKS))


def test_prefix_encoding_appends_and_edits(vocabulary):
    r = random.Random(8)
    for _ in range(60):
        data = "".join(r.choice("abcdeéinthg =-") for _ in range(r.randint(0, 500))).encode()
        e = byte_bpe.PrefixEncoding(vocabulary, data[:100])
        e.append(data[100:])
        assert e.ids() == vocabulary.merge(data)
        start = r.randint(0, len(data))
        end, new = min(len(data), start + r.randint(0, 5)), r.choice([b"", b"the", b"xx"])
        anew = e.replace(start, end, new)
        assert e.ids() == vocabulary.merge(data[:start] + new + data[end:]) and anew <= len(e.data)
    long = byte_bpe.PrefixEncoding(vocabulary, b"the other thing " * 400)
    assert long.replace(10, 11, b"x") < 400


def test_byte_bpe_rows(spark, awkward, none):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    want = []
    for i, t, *_ in AWKWARD:
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(byte_bpe.encoded_and_decoded(awkward, RANKS, public_tokenizers.PATTERN)) == sorted(want, key=repr)
    assert byte_bpe.encoded_and_decoded(none, RANKS, public_tokenizers.PATTERN).collect() == []


# Packing


def check_packing(got, capacity):
    at = {}
    for x in got:
        at.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_packing_rows(awkward, none):
    got = packing.best_fit_packing(awkward, TOKENIZER).collect()
    check_packing(got, 2048)
    own, want = WordEncoder(TOKENIZER).tokenizer, []
    for i, t, *_ in AWKWARD:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(x)[:5] for x in got), key=repr) == sorted(want, key=repr)
    assert packing.best_fit_packing(none, TOKENIZER).collect() == []


def test_groups_exchange_until_the_bound(spark):
    r = random.Random(10)
    cut = [(i, 0, 0, r.choice([2048, 1500, 700, 701, 650, 300, 40, 9]), i) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(cut, packing.PIECE), group_rows=100).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(3000))
    lengths = np.array([c[3] for c in cut])
    whole = len(packing.best_fit_decreasing(lengths)[2])
    assert packing.lower_bound(lengths) <= check_packing(got, 2048) <= whole * 1.01 + 1


def test_bounds_hold_against_the_best_packing():
    def best(items, capacity):
        def fits(k, items, free):
            if not items:
                return True
            seen = set()
            for b in range(k):
                if free[b] >= items[0] and free[b] not in seen:
                    seen.add(free[b])
                    free[b] -= items[0]
                    if fits(k, items[1:], free):
                        return True
                    free[b] += items[0]
            return False

        return next(k for k in range(len(items) + 1) if fits(k, items, [capacity] * k))

    r = random.Random(11)
    for _ in range(150):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(0, 8))), reverse=True)
        lengths = np.array(items, dtype=np.int64)
        optimum = best(items, 20)
        assert packing.lower_bound(lengths, 20) <= optimum <= len(packing.best_fit_decreasing(lengths, 20)[2])


# Fingerprints


def test_fingerprint_rows(awkward, none):
    got = fingerprint.fingerprints_with_neighbours(awkward).collect()
    order = sorted(AWKWARD, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    texts = [x[1] or "" for x in order]
    want = []
    for x, t, n in zip(order, texts, texts[1:] + texts[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((x[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.fingerprint(t), fingerprint.fingerprint(edited)))
    assert sorted((tuple(x)[:5] for x in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in got)
    assert fingerprint.fingerprints_with_neighbours(none).collect() == []


def test_fingerprint_likeness(spark):
    text = vocabulary_text(20, 2000)
    others = [text, text.replace("w7 ", "w8 ", 1), text[:9000], vocabulary_text(21, 2000), ""]
    prints = spark.createDataFrame([(fingerprint.fingerprint(text), fingerprint.fingerprint(o), i) for i, o in enumerate(others)], "a string, b string, i int")
    same, edited, part, other, empty = [x[0] for x in prints.orderBy("i").select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()]
    assert same == 1 and edited > 0.9 and part > 0.5 and other < 0.4 and empty == 0


# Language


def test_forward_backward_sums_over_all_paths():
    from itertools import product

    r = np.random.default_rng(1)
    lengths, k = np.array([4, 2, 1]), 3
    scores, move, start = r.normal(size=(4, 3, k)), r.normal(size=(k, k)), r.normal(size=k)
    post, expected = language_id.forward_backward(scores, lengths, move, start)
    want_moves = np.zeros((k, k))
    for c, n in enumerate(lengths):
        weight, total = np.zeros((n, k)), 0.0
        moves = np.zeros((k, k))
        for path in product(range(k), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(scores[t, c, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += w
            for t, y in enumerate(path):
                weight[t, y] += w
            for a, b in zip(path, path[1:]):
                moves[a, b] += w
        assert np.allclose(post[:n, c], weight / total, atol=1e-5)
        want_moves += moves / total
    assert np.allclose(expected, want_moves, atol=1e-4)


LANGS = {"aa": "the of and that thing with", "bb": "der und die nicht schön mit", "cc": "el los que muy año por"}


@pytest.fixture(scope="module")
def field():
    r = random.Random(12)
    data = [(" ".join(r.choice(v.split()) + r.choice(["", "s", "en"]) for _ in range(40)), k) for k, v in LANGS.items() for _ in range(15)]
    return language_id.fit([t for t, _ in data], [x for _, x in data])


def test_language_rows(spark, awkward, none, field):
    texts = [(i, v, k) for i, (k, v) in enumerate(LANGS.items())]
    got = language_id.predict(spark.createDataFrame(texts, "doc_id long, text string, lang string"), field).collect()
    assert all(x["lang_pred"] == texts[x["doc_id"]][2] and 0.5 < x["score"] <= 1 for x in got)
    rows_ = {x["doc_id"]: x for x in language_id.predict(awkward, field).collect()}
    assert rows_[5]["lang_pred"] == rows_[1]["lang_pred"] == rows_[8]["lang_pred"] == "und" and rows_[5]["score"] == 0
    assert {i: x["held_out"] for i, x in rows_.items() if i is not None} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in AWKWARD if i is not None}
    assert language_id.predict(none, field).collect() == []
    empty = language_id.train(none)
    assert {x["lang_pred"] for x in language_id.predict(awkward, empty).collect()} == {"und"}


def test_switching_words_are_labelled(spark, field):
    text = " ".join([LANGS["aa"]] * 4 + [LANGS["bb"]] * 4)
    words = language_id.label_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).first()["words"]
    assert [w["word"] for w in words] == text.split()
    assert np.mean([w["lang"] == ("aa" if i < 24 else "bb") for i, w in enumerate(words)]) > 0.9


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.predict(docs, language_id.train(docs, sample_docs=60)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert got and np.mean([x["lang"] == x["lang_pred"] for x in got]) >= 0.95


# Quality


@pytest.mark.parametrize("bits", [2, 7])
def test_likelihoods_match_the_definition(spark, bits, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_DOCS", 13)
    monkeypatch.setattr(quality, "PACK_ROWS", 500)
    r = random.Random(14)
    texts = [vocabulary_text(100 + i, r.randint(0, 120), 60 + 60 * (i % 2)) + (" !!NOISE!!" if i % 7 == 0 else "") for i in range(60)]
    texts += [f"Once{i} {texts[i]} only-{i}" for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", i % 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, part int")
    plain = quality.blocked(quality.encoded(docs).join(docs.select("doc_id", "part"), "doc_id"), 66)
    known = quality.trusted_words(plain)
    blocks = quality.with_classes(plain, known)
    n = Counter(w for i, t in enumerate(texts) if i % 3 == 1 for w in t.split())
    assert {x["word"]: x["n"] for x in known.collect()} == {quality.word_id(w): k for w, k in n.items()}
    size = quality.FIRST_WORD + len(n)
    model, lowest = quality.model_tables(quality.counted_trigrams(blocks), size, bits)
    got = {x["doc_id"]: x["nll"] for x in quality.scored(blocks, model, lowest, bits).collect()}

    def padded(text, classed):
        return [quality.START] * 2 + [quality.shape(w) if classed(w) else quality.word_id(w) for w in text.split()] + [quality.END]

    counted = [t for i, t in enumerate(texts) if i % 3 == 1]
    once = [(padded(t, lambda w: False), padded(t, lambda w: n[w] == 1)) for t in counted]
    grams = [g for s, _ in once for g in zip(s, s[1:], s[2:])]
    again = [h for s, c in once for g, h in zip(zip(s, s[1:], s[2:]), zip(c, c[1:], c[2:])) if g != h]
    assert again
    p = brute.kneser_ney_of(Counter(grams + again), size)
    for i, t in enumerate(texts):
        s = padded(t, lambda w: w not in n)
        nll = [-np.log(p(*k)) + (np.log(quality.OPEN_WORDS) if k[2] < quality.SHAPES else 0) for k in zip(s, s[1:], s[2:])]
        assert got[i] == pytest.approx(np.mean(nll), rel=1e-5)


def test_packed_keys_come_back():
    keys = quality.short_keys(np.random.default_rng(3).integers(-(2**62), 2**62, 5000))
    assert (quality.unpack_keys(quality.pack_keys(keys)) == keys).all() and len(quality.pack_keys(keys)) < 8 * len(keys)
    parts = list(quality.by_shard(keys, 5))
    assert [s for s, _ in parts] == list(range(32)) and np.array_equal(np.concatenate([keys[at] for _, at in parts]), keys)
    assert len(quality.unpack_keys(quality.pack_keys(keys[:0]))) == 0 and list(quality.by_shard(keys[:0], 5)) == []


def test_packed_values_come_back():
    values = np.array([0, 0.5, 0, 0.25, 0.5, 1, 0], np.float32)
    for blank in (0, 1):
        assert (quality.unpack_values(quality.pack_values(values, blank), blank) == values).all()
        assert len(quality.unpack_values(quality.pack_values(values[:0], blank), blank)) == 0


def test_tables_of_quality_stay_small(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    words = [word() for _ in range(4000)]
    texts = [" ".join(words[int(r.expovariate(1 / 500)) % 4000] if r.random() < 0.8 else word() for _ in range(300)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    sizes = Counter()

    def stored(df, name):
        table = common.store(df, name)
        folder = common._FOLDERS[-1].removeprefix("file:")
        sizes[name] += sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet"))
        return table

    monkeypatch.setattr(quality, "store", stored)
    assert quality.classify(docs, labels).count() == 200
    text = sum(map(len, texts))
    assert sizes["classes"] < 0.4 * text and sizes["trigrams"] < 0.6 * text and sum(sizes.values()) < 4 * text, (text, sizes)


def test_noise_goes_and_trusted_text_stays(spark):
    good = [(i, vocabulary_text(i, 120), ["en", None][i % 2], "s", 0) for i in range(300)]
    bad = [(1000 + i, " ".join(f"@@{i}{j}##" for j in range(150)), "en", "s", 0) for i in range(20)] + [(2000, "w1 " * 0 + "##", "en", "s", 0)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1, 1, 0), (1, 0, 0)] + [(1001, 0, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(spark.createDataFrame(good + bad, COLUMNS), labels).collect()}
    assert len(got) == 321 and all(got[i]["kept"] for i in range(300)) and got[2000]["kept"]
    assert not any(got[1000 + i]["kept"] for i in range(20))


def test_words_of_a_rare_language_are_known(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rare = [word() for _ in range(200)]
    text = lambda: " ".join(r.choice(rare) for _ in range(60))
    docs = [(i, vocabulary_text(i, 120), "en", "s", 0) for i in range(400)] + [(1000 + i, text(), "xx", "s", 0) for i in range(30)]
    docs += [(2000, text(), "xx", "s", 0), (2001, " ".join(word() for _ in range(60)), "xx", "s", 0)]
    labels = spark.createDataFrame([(d[0], 1, 0) for d in docs if d[0] < 2000], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(spark.createDataFrame(docs, COLUMNS), labels).collect()}
    assert got[2001]["perplexity"] > 100 * got[2000]["perplexity"]


def test_short_noise_goes(spark):
    docs = [(i, vocabulary_text(i, [25, 120, 600][i % 3]), "en", "s", 0) for i in range(600)]
    docs += [(1000 + i, " ".join(f"@@{i}{j}##" for j in range(25)), "en", "s", 0) for i in range(10)]
    docs += [(2000 + i, " ".join(f"w{(i * 7 + j) % 90 + 200}" for j in range(25)), "en", "s", 0) for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["kept"] for x in quality.classify(spark.createDataFrame(docs, COLUMNS), labels).collect()}
    assert not any(got[i] for i in got if i >= 1000) and sum(got[i] for i in range(600)) >= 597


def test_quality_awkward(spark, awkward, none):
    labels = spark.createDataFrame([(2, 1, 0), (7, 1, 0), (None, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(awkward, labels).collect()
    assert sorted((x["doc_id"] or 0 for x in got)) == sorted(x[0] or 0 for x in AWKWARD)
    assert all(x["kept"] for x in got if x["n_words"] == 0)
    assert all(x["kept"] for x in quality.classify(awkward, labels.where("quality = 5")).collect())
    assert quality.classify(none, labels).collect() == []


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    good = [(i, vocabulary_text(i, 120), "en", "s", 0) for i in range(200)]
    planted = [
        (500, good[3][1], "en", "s", 0),  # copy: the larger id stays
        (501, good[4][1] + " tail", "en", "s", 0),  # near copy: the smaller id stays
        (502, vocabulary_text(777, 400) + " token=abcdef123456", "en", "s", 0),
        (503, " ".join(f"@@{j}##" for j in range(150)), "en", "s", 0),
        (504, None, "en", "s", 0),
        (504, None, "en", "s", 0),
        (None, "a text without an id", None, None, None),
    ]
    spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(good + planted, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        seen[name] = Counter(x["doc_id"] for x in docs.collect()) - Counter(x["doc_id"] for x in after.collect())
        docs = after
    assert seen == {"quality classifier": {503: 1}, "exact dedup": {3: 1, 504: 1}, "MinHash near-dedup": {501: 1}, "secret scans": {502: 1}}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(whole, 2048)
    assert {x["doc_id"] for x in whole} == {x["doc_id"] for x in docs.collect()}


def test_pipeline_links_pairs_of_eighty_percent(spark):
    words = [f"n{i}" for i in range(100)]
    changed = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, " ".join(changed), "en", "s", 0)], COLUMNS)
    a, b = (brute_shingles(w) for w in (words, changed))
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    assert [x["doc_id"] for x in corpus_pipeline.near(spark, docs, "").collect()] == [1]


def brute_shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_stored_tables_are_cleared(spark):
    import os

    from loglattice.llm import common

    path = new_folder(spark, "ids")
    spark.range(3).write.parquet(path)
    assert path in common._FOLDERS
    common._FOLDERS[:] = [path]
    common.clear_stored(spark)
    assert not os.path.exists(path.removeprefix("file:"))
