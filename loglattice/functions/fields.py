"""Columns for status codes, addresses and reproducible noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUS_CLASSES = (1, 2, 3, 4, 5)
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_QUAD = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def status_flags(code: Column, *, zero_is_five: bool = False) -> dict[str, Column]:
    """One 0/1 column per hundreds digit 1-5 and ``status_other``.

    A code outside 100-599 sets only ``status_other``; with ``zero_is_five`` the code ``000``
    counts as class 5.
    """
    return status_class_flags(F.floor(code.try_cast("int") / 100), zero_is_five=zero_is_five)


def status_class_flags(digit: Column, *, zero_is_five: bool = False) -> dict[str, Column]:
    if zero_is_five:
        digit = F.when(digit == 0, F.lit(5)).otherwise(digit)
    digit = F.coalesce(digit, F.lit(-1))
    out = {f"status_to_client_{k}": (digit == k).cast("double") for k in STATUS_CLASSES}
    out["status_other"] = (~digit.isin(*STATUS_CLASSES)).cast("double")
    return out


def ip_number(ip: Column) -> Column:
    """The address as one number, null for anything but a dotted quad of octets up to 255."""
    octets = F.split(ip, r"\.")
    number = sum((octets[i].try_cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), octets[0].try_cast("long") * (1 << 24))
    return F.when(ip.rlike(_QUAD), number)


def ip_bits(ip: Column, number: Column | None = None) -> dict[str, Column]:
    """32 columns ``IP_binary_<octet>_<bit>``, most significant bit first, and ``ip_valid``.

    Anything but a dotted quad with octets up to 255 gives zeros (as does ``-``) and
    ``ip_valid`` 0. ``number`` may hand in a stored ``ip_number(ip)``.
    """
    number = ip_number(ip) if number is None else number
    out = {
        f"IP_binary_{i}_{j}": F.coalesce(F.shiftright(number, 31 - 8 * i - j).bitwiseAND(F.lit(1)), F.lit(0)).cast(
            "double"
        )
        for i in range(4)
        for j in range(8)
    }
    return out | {"ip_valid": number.isNotNull().cast("double")}


def uniform(row_id: Column, *salt: int) -> Column:
    """A number in [0, 1) fixed by the row id and the salts, whatever the partitioning."""
    bits = F.xxhash64(*[F.lit(s).cast("long") for s in salt], row_id.cast("long"))
    return F.shiftrightunsigned(bits, 11) * F.lit(2.0**-53)


def split_bucket(row_id: Column, seed: int, buckets: int) -> Column:
    """A bucket 0..buckets-1 fixed by the row id."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), row_id.cast("long")), F.lit(buckets)).cast("int")
