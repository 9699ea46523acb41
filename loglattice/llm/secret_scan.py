"""Secret scan in column expressions only: fixed patterns and sliding-window entropy.

Matches get their places without Python: the lengths of the gaps (``split``) and of the matches
(``regexp_extract_all``) add up to the starts. Candidate strings of the entropy detector are scanned with a window of
``WINDOW`` characters; sum(c * log2 c) over the character counts of the window is kept up to date as one
character enters and one leaves, so a step costs the same for any window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import whole_text

# The base patterns; kinds in the order of ties.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"

WINDOW = 20
BLOCK = 256
#: Bits of a character's count in a window, and counts in one 64-bit number.
COUNT_BITS = 5
PACKED = 12
#: Strings worth a look: long enough, of letters, digits and the usual code characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Character class, its pattern and the least entropy in bits of a window of that class.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("code", r"^[A-Za-z0-9+/_=-]+$", 3.9))
#: Allow list: strings without a digit if of one case or of words, strings without letters, UUIDs, dates (with a time or
#: a short slug of words) and host-like slugs. Groups repeat possessively, so a long string needs no deep stack.
ALLOWED = (
    r"^(?:[^0-9A-Z]*+|[^0-9a-z]*+)$",
    r"^[+/_=-]*+(?:[A-Z]?+[a-z]{2,}+[+/_=-]*+)++$",
    r"^[^A-Za-z]*+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-][0-9]{2}[0-9_-]{0,10}Z?)?(?:[_-][A-Za-z]{1,20}){0,8}[_-]?[0-9]{0,4}$",
    r"^[a-z]++(?:[-_/][a-z]++)++[-_/]?[0-9]{1,4}$",
)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, part) in code points; no match: empty.

    ``part`` is the match. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.transform(found, lambda hit, i: F.struct(F.get(gaps, i).alias("gap"), hit.alias("hit")))
    # Running sums append to an array; in blocks of BLOCK that stays cheap for any number of matches.
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(found) / BLOCK).cast("int") - 1), lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK))
    width = lambda pair: F.length(pair["gap"]) + F.length(pair["hit"])
    ints = F.expr("cast(array() as array<int>)")
    offsets = F.aggregate(
        F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, pair: n + width(pair))),
        F.struct(F.lit(0).alias("at"), ints.alias("out")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("part"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    none = F.expr("cast(array() as array<struct<start:int,end:int,part:string>>)")
    placed = F.zip_with(blocks, offsets, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"]))
    return F.when(text.rlike(pattern), F.flatten(placed)).otherwise(none)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hot_range(part: Column, least: Column) -> Column:
    """(first, last) start of the windows of ``part`` with at least ``least`` bits; null when there is none.

    The counts of the window's characters (ASCII, at most WINDOW each) are packed twelve to a number.
    Entering raises a count c and the sum by f(c+1) - f(c), leaving lowers them, with f(c) = c * log2(c). Each character
    comes with the one that leaves as it enters, and every value is bound once, so a step costs the same for any string.
    """
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])

    def moved(state: Column, code: Column, by: int) -> Column:
        """The state (counts, sum) after the character ``code`` has entered (by 1) or left (by -1)."""

        def change(at: Column) -> Column:
            count = F.call_function("shiftright", F.get(state["counts"], at["slot"]), at["shift"]).bitwiseAND(F.lit(2**COUNT_BITS - 1)).cast("int")
            step = F.call_function("shiftleft", F.lit(by).cast("long"), at["shift"])
            counts = F.transform(state["counts"], lambda packed, slot: F.when(slot == at["slot"], packed + step).otherwise(packed))
            return bound(count, lambda c: F.struct(counts.alias("counts"), (state["sum"] + F.get(f, c + by) - F.get(f, c)).alias("sum")))

        place = F.struct(F.floor(code / PACKED).cast("int").alias("slot"), (code % PACKED * COUNT_BITS).cast("int").alias("shift"))
        return bound(place, change)

    def step(state: Column, move: Column) -> Column:
        def done(now: Column) -> Column:
            start = state["i"] - (WINDOW - 1)
            hot = (start >= 0) & (F.lit(math.log2(WINDOW)) - now["sum"] / WINDOW >= least)
            return bound(hot, lambda h: F.struct(
                (state["i"] + 1).alias("i"), now["counts"].alias("counts"), now["sum"].alias("sum"),
                F.when(h & state["first"].isNull(), start).otherwise(state["first"]).alias("first"),
                F.when(h, start).otherwise(state["last"]).alias("last"),
            ))

        leave = lambda now: F.when(move["out"] >= 0, moved(now, move["out"], -1)).otherwise(now)
        return bound(moved(state, move["code"], 1), lambda entered: bound(leave(entered), done))

    zero = F.struct(
        F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("long"), -(-128 // PACKED)).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    chars = lambda s: F.transform(F.split(s, ""), lambda ch: F.ascii(ch))
    before = F.concat(F.array_repeat(F.lit(-1), WINDOW), chars(part))
    moves = F.zip_with(chars(part), before, lambda code, out: F.struct(code.alias("code"), out.alias("out")))
    moves = F.slice(moves, F.lit(1), F.length(part))
    return F.aggregate(moves, zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def least_bits(part: Column) -> Column:
    """The threshold of the narrowest character class that holds the whole string."""
    out = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        out = F.when(part.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def entropy_spans(text: Column) -> Column:
    """Spans from the first to the end of the last window with enough entropy, per candidate string."""
    found = matches(text, CANDIDATE)
    allowed = lambda part: F.array(*[part.rlike(p) for p in ALLOWED])
    strings = F.filter(found, lambda m: ~F.array_contains(allowed(m["part"]), F.lit(True)))
    classed = F.transform(strings, lambda m: F.struct(m["start"].alias("start"), m["part"].alias("part"), least_bits(m["part"]).alias("least")))
    ranged = F.transform(classed, lambda m: F.struct(m["start"].alias("start"), hot_range(m["part"], m["least"]).alias("range")))
    return F.filter(ranged, lambda m: m["range"]["first"].isNotNull())


def assignments(text: Column) -> Column:
    """Matches of ASSIGN whose value has six or more characters."""
    return F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["part"], ASSIGN, 1)) >= 6)


def has_secret(text_col: str = "text") -> Column:
    """Whether a text holds a match of any kind or a span of high entropy; null: no."""
    text = whole_text(text_col)
    plain = text.rlike(ACCESS) | text.rlike(HEX) | (F.size(assignments(text)) > 0)
    return plain | (F.size(entropy_spans(text)) > 0)


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    A null or empty text has no spans and the digest of the empty list. Places are code points, end
    exclusive. A long text is scanned whole; repeated rows and ids give repeated rows; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    found = rows.select(
        "doc_id",
        assignments(F.col("text")).alias("assign"),
        matches(F.col("text"), ACCESS).alias("access"),
        matches(F.col("text"), HEX).alias("hex"),
        entropy_spans(F.col("text")).alias("entropy"),
    )

    def spans(column: str, rank: int, start=lambda m: m["start"], end=lambda m: m["end"]) -> Column:
        return F.transform(column, lambda m: F.struct(start(m).alias("start"), F.lit(rank).alias("rank"), F.lit(column).alias("kind"), end(m).alias("end")))

    base = F.concat(spans("assign", 0), spans("access", 1), spans("hex", 2))
    added = spans("entropy", 3, lambda m: m["start"] + m["range"]["first"], lambda m: m["start"] + m["range"]["last"] + WINDOW)
    text = lambda all_: F.array_join(F.transform(F.array_sort(all_), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.concat(base, added)).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
