"""Manifest, SimHash and spelling variants against plain versions, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loglattice.llm import merkle, simhash, spelling
from tests.llm.test_operators import AWKWARD, CLASHING, COLUMNS, vocabulary_text


@pytest.fixture(scope="module")
def awkward(spark):
    extra = (*CLASHING, "tree", "level", "pos", "segment", "group", "height", "fp", "turn", "node", "word", "root", "form", "side", "n_near")
    return spark.createDataFrame(AWKWARD, COLUMNS).withColumns({c: F.lit("extra") for c in extra})


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) to the contract's columns."""

    def leaf(i, text, lang, source, n):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    def grow(nodes):  # (digest, members) lists; adds siblings to every member's proof
        while len(nodes) > 1:
            above = []
            for at in range(0, len(nodes), 2):
                run = nodes[at : at + 2]
                for k, (_, members) in enumerate(run):
                    for m in members:
                        m["proof"].append((k, [d for j, (d, _) in enumerate(run) if j != k]))
                above.append((sha(*[d for d, _ in run]), [m for _, ms in run for m in ms]))
            nodes = above
        return nodes[0]

    members = [{"row": r, "leaf": leaf(*r), "proof": []} for r in rows]
    trees = []
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((m for m in members if m["row"][2] == lang), key=lambda m: (m["row"][0] is not None, m["row"][0] or 0, m["leaf"]))
        digest, below = grow([(m["leaf"], [m]) for m in own])
        for m in below:
            m["subroot"] = digest
        trees.append((digest, below))
    root, _ = grow(trees)
    out = []
    for m in members:
        i, text, lang, source, n = m["row"]
        now = m["leaf"]
        if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0:
            now = leaf(i, text, lang, source, n + 1)
        for k, others in m["proof"]:
            now = sha(*others[:k], now, *others[k:])
        out.append((i, m["leaf"], m["subroot"], root, sha(*[d for _, o in m["proof"] for d in o]), now, now == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_manifest_of_awkward_rows(spark, awkward):
    assert rows_of(merkle.manifest(awkward).drop("proof")) == plain_manifest(AWKWARD)
    assert merkle.manifest(spark.createDataFrame([], awkward.schema)).collect() == []
    one = [(4, "only", None, None, None)]
    assert rows_of(merkle.manifest(spark.createDataFrame(one, COLUMNS)).drop("proof")) == plain_manifest(one)


@pytest.mark.parametrize("levels, broadcast", [(1, 0), (3, 8 << 20), (10, 0)])
def test_manifest_in_blocks_and_by_shuffles(spark, monkeypatch, levels, broadcast):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", broadcast)
    r = random.Random(levels)
    rows = [(i, f"text {i % 50}", "en" if i < 90 else r.choice(["de", "fr", "Ä", "", None]), r.choice(["a", None]), r.choice([None, i])) for i in range(131)]
    rows += [(500, "t", f"l{k}", "s", 3) for k in range(5)] + rows[:3]
    r.shuffle(rows)
    assert rows_of(merkle.manifest(spark.createDataFrame(rows, COLUMNS).repartition(3)).drop("proof")) == plain_manifest(rows)


def test_proofs_verify_alone(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(19)]
    for x in merkle.manifest(spark.createDataFrame(rows, COLUMNS)).collect():
        assert merkle.folded(x["leaf"], x["proof"]) == x["root"] and merkle.folded(sha("other"), x["proof"]) != x["root"]


def plain_fingerprint(text):
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints):
    """{position: smallest id reachable} for a list of (id, fingerprint)."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [(i, f"{p:016x}", least.get(find(p))) for i, p in prints]


def test_simhash_of_awkward_rows(spark, awkward):
    got = rows_of(simhash.simhash_dedup(awkward).drop("kept"))
    assert got == sorted(plain_components([(i, plain_fingerprint(t)) for i, t, *_ in AWKWARD]), key=repr)
    assert simhash.simhash_dedup(spark.createDataFrame([], awkward.schema)).collect() == []


def test_simhash_components_of_near_texts(spark):
    r, base, texts = random.Random(3), vocabulary_text(1, 300).split(), []
    for i in range(300):
        w = list(base) if i % 3 else vocabulary_text(i, 40).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
        texts.append((900 - i, " ".join(w)))
    texts += [(None, texts[0][1]), (2000, "Same Words"), (2001, "same\twords"), (2002, None), (2003, " ")]
    got = simhash.simhash_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
    assert rows_of(got.drop("kept")) == sorted(plain_components([(i, plain_fingerprint(t)) for i, t in texts]), key=repr)


@pytest.mark.parametrize("node_rows, direct", [(100_000, 64), (100_000, 1), (8, 1), (2, 1)])
def test_trie_join_finds_every_link(spark, monkeypatch, node_rows, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    monkeypatch.setattr(simhash, "FRONT", 50)
    monkeypatch.setattr(simhash, "TASK_ROWS", 40)
    r = random.Random(7)
    seeds = [r.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    values = set(seeds)
    for s in seeds:
        at = s
        for _ in range(12):  # chains of small steps, and steps just beyond the budget
            for k in r.sample(range(64), r.choice([1, 2, 3, 4, 4])):
                at ^= 1 << k
            values.add(at)
    values |= {(7 << 48) | r.getrandbits(20) for _ in range(120)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in sorted(values)], "fp long")
    found = [(int(a) % (1 << 64), int(b) % (1 << 64)) for a, b in simhash.links(fps, node_rows).collect()]
    assert all((a ^ b).bit_count() and a in values and b in values for a, b in found)
    root = {v: v for v in values}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        root[find(a)] = find(b)
    want = {i: c for i, _, c in plain_components([(i, v) for i, v in enumerate(sorted(values))])}
    groups = {}
    for i, v in enumerate(sorted(values)):
        groups.setdefault(find(v), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def plain_variants(rows):
    counts = Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [o for o in n if o != w and one_edit(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def spelled(seed, rows=60):
    r = random.Random(seed)
    stems = ["banana", "bananas", "panama", "español", "Españoles", "straße", "Straßen", "strassen", "aaaaaa", "aaaaaaa", "aaaaaaaa", "Überall", "überall", "counter", "encounter"]
    out = []
    for i in range(rows):
        words = []
        for _ in range(r.randint(0, 120)):
            w = stems[min(int(r.expovariate(0.25)), len(stems) - 1)]
            if r.random() < 0.25:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("xé÷") + w[k:], w[:k] + r.choice("xyß") + w[k + 1 :]])
            words.append(w)
        out.append((i, " ".join(words), "en", "s", 0))
    return out


@pytest.mark.parametrize("key_words, block", [(4096, 128), (3, 2), (5, 7)])
def test_spelling_variants(spark, monkeypatch, key_words, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "DELETED_IN", 199)
    rows = spelled(key_words)
    rows += [(None, "banana " * 6, None, None, None), (3, None, None, None, None), (4, "", None, None, None), *rows[:4]]
    assert rows_of(spelling.spelling_variants(spark.createDataFrame(rows, COLUMNS).repartition(3), key_words=key_words)) == plain_variants(rows)


def test_spelling_of_awkward_rows(spark, awkward):
    assert rows_of(spelling.spelling_variants(awkward)) == plain_variants(AWKWARD)
    assert spelling.spelling_variants(spark.createDataFrame([], awkward.schema)).collect() == []


def test_tiles_agree_with_the_definition():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(6, 8))) for _ in range(300)})
    rows = spelling.Rows(words, np.ones(len(words), np.int64))
    near = np.zeros((len(words), len(words)), int)
    for m in (6, 7, 8, 9):
        for prefix in (True, False):
            near += spelling.tile(rows, rows, np.full(len(words), m), np.full(len(words), prefix))
    want = {(w, o) for w, _, _, _, _, _ in [] for o in []}
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            short, long_ = sorted((a, b), key=len)
            one = sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(long_) - len(short) == 1 and any(long_[:k] + long_[k + 1 :] == short for k in range(len(long_)))
            want = want | {(i, j)} if one else want
    assert near.max() == 1 and set(zip(*np.nonzero(near))) == want
