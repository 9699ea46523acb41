"""Proxy access logs and blacklists as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a log line, in the order they appear.
LOG_COLUMNS = (
    "day", "month", "year", "hour", "minute", "second", "zero_time", "response_time",
    "client_ip", "port", "request_status", "status_to_client", "size_of_reply",
    "request_method", "url_from_client", "server_ip", "user_name", "hierarchy_status",
    "server_peer_name", "MIME_content_type", "Referer", "User_Agent",
)

# One group per column above: date and time, then blank-separated fields, two of them pairs
# joined by a slash, and two quoted strings; text after those is ignored. Every quantifier is
# possessive, so a malformed line fails in linear time instead of backtracking.
LOG_PATTERN = (
    r"(?U)^([^/]*+)/++([^/]*+)/++([^:]*+):([^:]*+):([^:]*+):(\S*+)\s++(\S++)\s++(\S++)\s++(\S++)\s++"
    r"(\S++)\s++([^/\s]*+)/(\S*+)\s++(\S++)\s++(\S++)\s++(\S++)\s++(\S++)\s++(\S++)\s++"
    r'([^/\s]*+)/(\S*+)\s++([^\s"]++)\s*+"([^"]*+)"\s*+"([^"]*+)"(?s:.*+)$'
)
_TYPED = {"response_time": "long", "port": "int", "size_of_reply": "long"}
_SEPARATOR = "\u0001"


def _parts(value: str) -> Column:
    """An empty string and the 22 fields of a line as an array; of any other line its text alone.

    One regex pass rewrites the line with a separator before each field; a line without a match is left as
    is. The separator cannot come from the line: there it is read as U+FFFD.
    """
    clean = F.translate(F.col(value), _SEPARATOR, "\ufffd")
    groups = "".join(f"{_SEPARATOR}${i}" for i in range(1, len(LOG_COLUMNS) + 1))
    return F.split(F.regexp_replace(clean, LOG_PATTERN, groups), _SEPARATOR)


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The plane table: 22 columns and ``ts``; other columns of ``lines`` pass through."""
    # Exploding the matching parts filters and projects at once: the regex runs once a line,
    # where a filter on its result would be pushed below and run it again.
    matching = F.filter(F.array(_parts(value)), lambda p: F.size(p) == len(LOG_COLUMNS) + 1)
    others = [c for c in lines.columns if c != value]
    good = lines.select(*others, F.explode(matching).alias("_parts"))
    p = [F.col("_parts")[i] for i in range(1, len(LOG_COLUMNS) + 1)]
    fields: dict[str, Column] = dict(zip(LOG_COLUMNS, p))
    for name, kind in _TYPED.items():
        fields[name] = fields[name].try_cast(kind)
    # The day keeps an opening bracket before it; the time stamp does without.
    stamp = F.concat(
        F.ltrim(p[0], F.lit("[ ")), F.lit("/"), p[1], F.lit("/"), p[2], F.lit(":"), p[3], F.lit(":"), p[4],
        F.lit(":"), F.left(p[5], F.lit(2)), F.lit(" "), F.left(p[6], F.lit(5)),
    )
    fields["ts"] = F.try_to_timestamp(stamp, F.lit("d/MMM/yyyy:H:m:s Z"))
    return good.withColumns(fields).drop("_parts")


def quarantine(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines that do not have the shape of a log line, unchanged."""
    unmatched = F.size(_parts(value)) != len(LOG_COLUMNS) + 1
    return lines.where(F.coalesce(unmatched, F.lit(True)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their source: ``value, src_file, src_block, row_id``.

    ``row_id`` grows with the position inside one split of a file; (``src_file``,
    ``src_block``, ``row_id``) is the order of the lines in the files.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("row_id"),
    )


FILE_ORDER = ("ts", "src_file", "src_block", "row_id")


def read_proxy_log(spark: SparkSession, path: str) -> DataFrame:
    """The plane table of the log files under ``path``; bad lines: ``quarantine(read_lines())``."""
    return parse_lines(read_lines(spark, path))


def parse_blacklist(lines: DataFrame, value: str = "value", order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``(key, label)`` of ``key,label`` lines.

    The last comma splits, the label is its run of non-blanks, and of several lines with one
    key the last (by ``order``) counts.
    """
    pattern = r"^(.*),\s*(\S*)"
    pairs = lines.where(F.col(value).rlike(pattern)).select(
        F.regexp_extract(value, pattern, 1).alias("key"),
        F.regexp_extract(value, pattern, 2).alias("label"),
        F.struct(*order).alias("at"),
    )
    return pairs.groupBy("key").agg(F.max_by("label", "at").alias("label"))


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    return parse_blacklist(read_lines(spark, path), order=("src_file", "src_block", "row_id"))
