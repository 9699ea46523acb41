"""Plain versions of the contracts, straight from their patterns."""

import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def luhn(d):
    s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
    return s % 10 == 0


def pii(text):
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def shingles(text):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near_components(texts):
    """{id: (set size, smallest reachable id)} by comparing all pairs."""
    sets = {i: shingles(t or "") for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def kneser_ney_of(tri, size):
    """p(w3 | w1, w2) as a function, from the definition, over a Counter of trigrams."""
    from collections import Counter, defaultdict

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5 * k for k in (1, 2, 3)]
        return [min(max(d, 0.05), k) for d, k in zip(raw, (1, 2, 3))]

    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)
    total = sum(uni.values())

    def low(w):
        return max(uni[w] - 0.5, 0) / max(total, 1) + 0.5 * len(uni) / max(total, 1) / size if uni else 1 / size

    def level(counts, lower):
        d = discounts(counts)
        contexts = defaultdict(list)
        for k, n in counts.items():
            contexts[k[:-1]].append(n)
        cut = lambda n: d[min(n, 3) - 1]

        def p(*key):
            c = contexts.get(key[:-1])
            if not c:
                return lower(*key[1:])
            n = counts.get(key, 0)
            return ((n - cut(n)) if n else 0) / sum(c) + sum(map(cut, c)) / sum(c) * lower(*key[1:])

        return p

    return level(tri, level(bi, low))
