"""URL columns. One generic-URI split serves every feature; nothing raises on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the generic URI pattern of RFC 3986, appendix B.
GENERIC_URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
_HOST, _PATH, _QUERY = 4, 5, 7
# `host:443`, the target of a CONNECT request, has no path.
_AUTHORITY_FORM = r"^[^/?#:]+:[0-9]+$"

# The file extensions told apart; any other is "other".
FILE_TYPES = (
    "txt", "png", "jpg", "html", "htm", "ini", "gif", "crl", "php", "cab",
    "js", "mp4", "ico", "mp3", "zip", "css", "dat", "dll", "exe", "sys",
)
# Fixed value: an IPv4-like group of digits anywhere in the URL.
IPV4_PATTERN = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def _part(url: Column, group: int) -> Column:
    found = F.regexp_extract(url, GENERIC_URI, group)
    return F.when(url.rlike(_AUTHORITY_FORM), F.lit("")).otherwise(found)


def host(url: Column) -> Column:
    """Authority part: host and port as written."""
    return _part(url, _HOST)


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(_part(url, _PATH), r";[^/]*$", "")


def query(url: Column) -> Column:
    return _part(url, _QUERY)


def params(url: Column) -> Column:
    """The ``;parameters`` of the last path segment."""
    return F.regexp_extract(_part(url, _PATH), r"^(?:.*/)?[^/;]*;([^/]*)$", 1)


def component(url: Column, which: str) -> Column:
    if which == "query":
        return query(url)
    if which == "params":
        return params(url)
    raise ValueError(f"component is 'query' or 'params', not {which!r}")


def file_type(url: Column) -> Column:
    """Known extension of the last path segment, case-sensitive, or ``other``."""
    return file_type_of_path(path(url))


def file_type_of_path(path: Column) -> Column:
    # Leading dots belong to the name, so ".profile" has no extension.
    name = F.ltrim(F.substring_index(path, "/", -1), F.lit("."))
    ext = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))
    return F.when(ext.isin(*FILE_TYPES), ext).otherwise(F.lit("other"))


def url_length(url: Column) -> Column:
    return F.length(url).cast("double")


def path_length(url: Column) -> Column:
    return F.length(path(url)).cast("double")


def query_length(url: Column, which: str = "query") -> Column:
    return F.length(component(url, which)).cast("double")


def query_keys(url: Column, which: str = "query") -> Column:
    """Number of equal signs."""
    return equal_signs(component(url, which))


def equal_signs(part: Column) -> Column:
    return (F.length(part) - F.length(F.replace(part, F.lit("="), F.lit("")))).cast("double")


def has_ipv4(url: Column) -> Column:
    return url.rlike(IPV4_PATTERN).cast("double")
