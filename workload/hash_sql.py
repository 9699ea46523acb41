"""SQL for the row hash (XXH64 of one 64-bit integer after constant salts)."""

from __future__ import annotations

M = 1 << 64
# The five primes of XXH64.
P1, P2, P3, P4, P5 = (
    0x9E3779B185EBCA87,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) % M


def _hash(x: int, seed: int) -> int:
    h = (seed + P5 + 8) % M
    h ^= _rotl(x * P2 % M, 31) * P1 % M
    h = (_rotl(h, 27) * P1 + P4) % M
    h = (h ^ (h >> 33)) * P2 % M
    h = (h ^ (h >> 29)) * P3 % M
    return h ^ (h >> 32)


def _u(v: int) -> str:
    return f"{v}::UHUGEINT"


def _rotl_sql(x: str, r: int) -> str:
    return f"(({x} * {_u(1 << r)}) % {_u(M)} + {x} // {_u(1 << (64 - r))})"


def hashed(rows: str, *salts: int) -> str:
    """``rows`` (with a non-negative ``x``) plus ``h``, the hash of the salts and ``x``."""
    seed = 42
    for s in salts:
        seed = _hash(s, seed)
    start = (seed + P5 + 8) % M
    steps = [
        f"(x::UHUGEINT * {_u(P2)}) % {_u(M)}",
        f"xor({_u(start)}, ({_rotl_sql('h', 31)} * {_u(P1)}) % {_u(M)})",
        f"({_rotl_sql('h', 27)} * {_u(P1)} + {_u(P4)}) % {_u(M)}",
        f"(xor(h, h // {_u(1 << 33)}) * {_u(P2)}) % {_u(M)}",
        f"(xor(h, h // {_u(1 << 29)}) * {_u(P3)}) % {_u(M)}",
        f"xor(h, h // {_u(1 << 32)})",
    ]
    sql = f"SELECT *, {steps[0]} AS h FROM ({rows})"
    for step in steps[1:]:
        sql = f"SELECT * REPLACE ({step} AS h) FROM ({sql})"
    return sql
