"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, schemes, identifier cues, digits, plus signs and
dotted digits. From each anchor a small deterministic parser walks left and right over the characters that
its kind allows, then validates what it found (labels, number ranges, check digits). Text without
anchors costs one pass of the automaton.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import arrow_map, joined_spans, whole_text

# Kinds in the order of ties, and the character classes of the base patterns.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "account", "passport")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = re.compile(r"[A-Za-z0-9-]+")
DIGITS = re.compile(r"[0-9]+")
DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE_BODY = re.compile(r"[\x20().0-9-]*")
CUES = ("account", "acct", "iban", "routing", "ssn", "social security", "passport", "konto", "compte", "cuenta")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://")
URL_BODY = re.compile(r"[A-Za-z0-9._~:/?#@!$&'*+,;=%-]+")
IDENTIFIER = re.compile(r"[\s:#=.]*(?:(?i:number|no|nr|num|id|is)\b[\s:#=.]*){0,3}([A-Z0-9][A-Z0-9\x20-]{4,40}[A-Z0-9])")
PASSPORT = re.compile(r"[A-Z0-9]{6,10}(?![A-Za-z0-9])")
ASCII_LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")


def build_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in (
        [("@", "at"), ("+", "plus")]
        + [(str(d), "digit") for d in range(10)]
        + [(f".{d}", "dotted") for d in range(10)]
        + [(s, "scheme") for s in SCHEMES]
        + [(c, "cue") for c in CUES]
    ):
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(compact: str) -> bool:
    """Country, check digits and length as an account number; the remainder by 97 is 1."""
    if not (15 <= len(compact) <= 34 and compact[:2].isalpha() and compact[2:4].isdigit() and compact.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def passport(compact: str) -> bool:
    """Six to nine letters and digits, a letter and two digits among them; a tenth place must be their check digit."""
    if not (6 <= len(compact) <= 10 and any(c.isalpha() for c in compact) and sum(c.isdigit() for c in compact) >= 2):
        return False
    return len(compact) < 10 or str(sum(int(c, 36) * (7, 3, 1)[i % 3] for i, c in enumerate(compact[:9])) % 10) == compact[9]


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, not reaching left of ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    label = LABEL.match(text, at + 1)
    if start == at or label is None:
        return None
    end, labels = label.end(), 0
    while end < len(text) and text[end] == "." and (label := LABEL.match(text, end + 1)):
        end, labels = label.end(), labels + 1
    return (start, end) if labels else None


def address_at(text: str, start: int) -> tuple[int, bool] | None:
    """(end, valid) of four dotted numbers from ``start``; None when there are fewer."""
    end, parts = start, []
    for i in range(4):
        if i:
            if text[end : end + 1] != ".":
                return None
            end += 1
        number = DIGITS.match(text, end)
        if number is None:
            return None
        parts.append(number[0])
        end = number.end()
    return end, all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in parts)


def phone_at(text: str, plus: int) -> int | None:
    """The end of a plus sign, a digit, characters of numbers and a last digit."""
    if not ("0" <= text[plus + 1 : plus + 2] <= "9"):
        return None
    end = PHONE_BODY.match(text, plus + 2).end()
    while end > plus + 2 and not ("0" <= text[end - 1] <= "9"):
        end -= 1
    return end if end >= plus + 4 else None


def scan(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str, int]]:
    """Spans (start, rank, kind, end) of one text, base kinds first in rank."""
    spans: list[tuple[int, int, str, int]] = []
    ends = dict.fromkeys(KINDS, 0)
    chain_end = 0

    def add(kind: str, start: int, end: int, valid: bool = True) -> None:
        ends[kind] = end
        if valid:
            spans.append((start, KINDS.index(kind), kind, end))

    # Cues count in any case; only A-Z are lowered, so places stay.
    for last, (anchor, size) in automaton.iter(text.lower() if text.isascii() else text.translate(ASCII_LOWER)):
        at = last - size + 1
        if anchor == "digit":
            if at < chain_end:
                continue
            chain_end = DIGIT_CHAIN.match(text, at).end()
            digits = text[at:chain_end].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                add("card", at, chain_end)
        elif anchor == "dotted":
            start = at
            while start > ends["ip"] and "0" <= text[start - 1] <= "9":
                start -= 1
            if at >= ends["ip"] and start < at and (found := address_at(text, start)):
                add("ip", start, *found)
        elif anchor == "at":
            if at >= ends["email"] and (found := email_at(text, at, ends["email"])):
                add("email", *found)
        elif anchor == "plus":
            if at >= ends["phone"] and (end := phone_at(text, at)):
                add("phone", at, end, 10 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15)
        elif anchor == "scheme":
            if at >= ends["url"] and text[at : last + 1].islower() and (body := URL_BODY.match(text, last + 1)):
                end = body.end()
                while text[end - 1] in ".,;:!?'":
                    end -= 1
                if end > last + 1:
                    add("url", at, end)
        elif found := IDENTIFIER.match(text, last + 1):
            start, end = found.span(1)
            if start < max(ends["iban"], ends["ssn"], ends["account"], ends["passport"]):
                continue
            value = found[1]
            # The longest valid prefix at a group border: text may follow the number.
            cuts = [len(value)] + [i for i in range(len(value) - 1, 0, -1) if value[i] in " -"]
            good = next((c for c in cuts if iban(value[:c].replace(" ", "").replace("-", ""))), None)
            if good:
                add("iban", start, start + good)
            elif number := SSN.match(value):
                if number[0][:3] not in ("000", "666") and number[0][0] != "9" and number[0][4:6] != "00" and number[0][7:] != "0000":
                    add("ssn", start, start + number.end())
            elif text[at : last + 1].lower() == "passport" and (number := PASSPORT.match(text, start)) and passport(number[0]):
                add("passport", start, number.end())
            elif number := re.match(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])", value):
                add("account", start, start + number.end())
    return spans


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Places are code points, end exclusive. Null and empty texts have no spans and the digest of the empty list.
    Texts are scanned whole in one pass. Repeated rows and ids give repeated rows; a null id is kept;
    other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        automaton = build_automaton()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans = scan(text.as_py(), automaton)
                base = [s for s in spans if s[1] < 4]
                counts = [sum(s[1] == k for s in base) for k in range(4)]
                yield doc_id, *counts, hashlib.sha256(joined_spans(base).encode()).hexdigest(), joined_spans(spans)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return arrow_map(rows, schema, run)
