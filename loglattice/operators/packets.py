"""HTTP transactions from a table of TCP packets.

Input ``packets(idx LONG, ts DOUBLE, src STRING, dst STRING, sport INT, dport INT, seq LONG,
ack LONG, payload BINARY)``. A request acknowledges byte A of its flow and the reply starts at
byte A, so requests (at ``ack``) and reply segments (at ``seq``) of a flow share one ordering
by offset, and stitching is a scan along it. Numbers as captured, which start again after 2^32, are
turned into offsets by ``unwrapped`` first (``raw=True`` of the functions below).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators import ordered as o

_FLOW = ("client_ip", "port", "server_ip", "server_port")
_ORDER = ("offset", "is_reply", "seq", "idx")
_REQUEST_LINE = r"^([A-Z][A-Z_-]*) (\S+) HTTP/[0-9.]+\r?\n"
_FIELDS = ("request_method", "url_from_client", "server_peer_name", "Referer", "User_Agent")


def _header(head: Column, name: str, default: str | None) -> Column:
    pattern = rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$"
    return F.when(head.rlike(pattern), F.regexp_extract(head, pattern, 1)).otherwise(F.lit(default))


def http_requests(packets: DataFrame) -> DataFrame:
    """Packets whose payload is an HTTP request, with its method, URL and headers."""
    return (
        _described(packets)
        .where("request_method is not null")
        .select(
            "idx", "ts", F.col("src").alias("client_ip"), F.col("sport").alias("port"),
            F.col("dst").alias("server_ip"), *_FIELDS,
        )
    )


def _described(packets: DataFrame) -> DataFrame:
    """Packets with payload, the payload replaced by what the scan needs of it."""
    # ISO-8859-1 maps every byte to one character, so no payload fails to decode.
    text = F.decode("payload", "ISO-8859-1")
    head = F.substring_index(F.col("__text"), "\r\n\r\n", 1)
    asks = F.col("__text").rlike(_REQUEST_LINE)
    host = _header(head, "host", "")
    answers = F.col("__text").startswith("HTTP/")
    columns = {
        "request_method": F.regexp_extract("__text", _REQUEST_LINE, 1),
        "url_from_client": F.concat(F.lit("http://"), host, F.regexp_extract("__text", _REQUEST_LINE, 2)),
        "server_peer_name": host,
        "Referer": _header(head, "referer", "-"),
        "User_Agent": _header(head, "user-agent", None),
    }
    out = packets.where(F.octet_length("payload") > 0).withColumn("__text", text)
    return out.withColumns(
        {n: F.when(asks, c) for n, c in columns.items()}
        | {
            "length": F.octet_length("payload").cast("long"),
            "answers": answers,
            "status": F.when(answers, F.try_element_at(F.split("__text", " "), F.lit(2))),
            "Chunked": answers & F.contains("__text", F.lit("Transfer-Encoding: chunked")),
        }
    ).drop("__text")


def unwrapped(packets: DataFrame, *, rows_per_block: int = o.ROWS_PER_BLOCK) -> DataFrame:
    """``packets`` whose 32-bit ``seq`` and ``ack`` are offsets that go on growing past 2^32.

    The ``seq`` of a direction and the ``ack`` of the other one count the same bytes, so both are scanned together in
    order of time: each number lies less than 2^31 before or after the one before it, and the signed steps add up
    from the first number. So disorder and retransmissions do no harm. A zero ``ack`` without payload acknowledges
    nothing and stays. ``idx`` names a packet; null numbers stay null.
    """
    own = F.struct(F.col("src").alias("a"), F.col("sport").alias("a_port"), F.col("dst").alias("b"), F.col("dport").alias("b_port"), F.col("seq").alias("raw"), F.lit(0).alias("is_ack"))
    other = F.struct(F.col("dst").alias("a"), F.col("dport").alias("a_port"), F.col("src").alias("b"), F.col("sport").alias("b_port"), F.col("ack").alias("raw"), F.lit(1).alias("is_ack"))
    nothing = (F.col("ack") == 0) & (F.coalesce(F.octet_length("payload"), F.lit(0)) == 0)
    numbers = packets.select("idx", "ts", F.explode(F.array(own, F.when(~F.coalesce(nothing, F.lit(False)), other))).alias("v"))
    numbers = numbers.where("v.raw IS NOT NULL").select("idx", "ts", "v.*")
    turn, half = 1 << 32, 1 << 31
    step = F.pmod(F.col("raw") - F.col("__before") + half, F.lit(turn)) - half
    placed = (
        o.OrderedGroups(numbers, ("a", "a_port", "b", "b_port"), ("ts", "idx", "is_ack"), rows_per_block=rows_per_block)
        .scan(__before=o.previous(F.col("raw")))
        .derive(__step=F.when(F.col("__before").isNull(), F.col("raw")).otherwise(step))
        .scan(__at=o.running_sum(F.col("__step")))
        .df
    )
    found = placed.groupBy("idx").agg(F.max(F.when(F.col("is_ack") == 0, F.col("__at"))).alias("__seq"), F.max(F.when(F.col("is_ack") == 1, F.col("__at"))).alias("__ack"))
    joined = packets.join(found, "idx", "left")
    return joined.withColumns({"seq": F.coalesce("__seq", "seq"), "ack": F.coalesce("__ack", "ack")}).select(packets.columns)


def stitched(packets: DataFrame, *, rows_per_block: int = o.ROWS_PER_BLOCK, raw: bool = False) -> DataFrame:
    """Requests and the reply segments that belong to them, one row each.

    ``request`` is the packet number of the request; reply rows add ``fresh`` bytes (bytes a
    retransmission repeats count once). A segment past a hole in the reply is left out.
    """
    packets = unwrapped(packets, rows_per_block=rows_per_block) if raw else packets
    asks = F.col("request_method").isNotNull()
    rows = _described(packets).select(
        F.when(asks, F.col("src")).otherwise(F.col("dst")).alias("client_ip"),
        F.when(asks, F.col("sport")).otherwise(F.col("dport")).alias("port"),
        F.when(asks, F.col("dst")).otherwise(F.col("src")).alias("server_ip"),
        F.when(asks, F.col("dport")).otherwise(F.col("sport")).alias("server_port"),
        F.when(asks, F.col("ack")).otherwise(F.col("seq")).alias("offset"),
        (~asks).cast("int").alias("is_reply"),
        "idx", "ts", "seq", "length", "answers", "status", "Chunked", *_FIELDS,
    )
    # Flows are sized as if every packet were a reply: that reads no payload.
    sizes = packets.select(
        F.col("dst").alias("client_ip"), F.col("dport").alias("port"), F.col("src").alias("server_ip"),
        F.col("sport").alias("server_port"), F.col("seq").alias("offset"),
    )
    is_reply = F.col("is_reply") == 1
    end = F.col("offset") + F.col("length")
    again = F.struct("offset", "is_reply", "seq")
    before = F.coalesce(F.col("__before"), F.col("offset"))
    scanned = (
        o.OrderedGroups(rows, _FLOW, _ORDER, rows_per_block=rows_per_block, sized_by=sizes)
        .scan(__top=o.running_max(F.when(is_reply, end)), __next=o.following(again))
        .scan(__before=o.previous(F.col("__top")))
        .derive(fresh=F.when(is_reply, F.greatest(end - F.greatest(before, "offset"), F.lit(0))).otherwise(0))
        .scan(__sum=o.running_sum(F.col("fresh")))
        .derive(
            __own=F.when(
                ~is_reply, F.struct(F.col("idx").alias("id"), F.col("offset").alias("at"), F.col("__sum").alias("base"))
            )
        )
        .scan(__req=o.carried(F.col("__own")))
        .df
    )
    # A request sent twice is one request: its last copy counts.
    resent = ~is_reply & F.col("__next").eqNullSafe(again)
    req = F.col("__req")
    whole = F.col("__top") - req["at"] == F.col("__sum") - req["base"]
    return scanned.where(req.isNotNull() & ~resent & (~is_reply | ((F.col("fresh") > 0) & whole))).select(
        req["id"].alias("request"), (F.col("offset") - req["at"]).alias("start"),
        "is_reply", "idx", "ts", "fresh", "answers", "status", "Chunked",
        "client_ip", "port", "server_ip", *_FIELDS,
    )


def reply_packets(packets: DataFrame, **options) -> DataFrame:
    """``(request, idx, start, fresh)``: the packets of each reply, one row each."""
    rows = stitched(packets, **options).where("is_reply = 1")
    return rows.select("request", "idx", "start", "fresh")


def transactions(packets: DataFrame, *, with_index: bool = False, **options) -> DataFrame:
    """One row per request, shaped like the plane table.

    ``size_of_reply`` counts header and body bytes, ``response_time`` is in milliseconds;
    a request without a reply has nulls. ``with_index`` adds the packet numbers as an array,
    for captures whose replies have a bounded number of packets (else: ``reply_packets``).
    """
    rows = stitched(packets, **options)
    reply, first = F.col("is_reply") == 1, (F.col("is_reply") == 1) & (F.col("start") == 0)
    mine = F.max(F.when(~reply, F.struct("client_ip", "port", "server_ip", *_FIELDS))).alias("r")
    grouped = rows.groupBy("request").agg(
        mine,
        F.coalesce(F.bool_or(F.when(first, F.col("answers"))), F.lit(False)).alias("found_response"),
        F.max(F.when(first, F.col("status"))).alias("status"),
        F.coalesce(F.bool_or(F.when(first, F.col("Chunked"))), F.lit(False)).alias("chunked"),
        F.sum("fresh").alias("size"),
        F.min(F.when(~reply, F.col("ts"))).alias("asked"),
        F.max("ts").alias("done"),
        *([F.array_sort(F.collect_list("idx")).alias("index")] if with_index else []),
    )
    found = F.col("found_response")
    nothing = F.lit(None).cast("string")
    index = [F.when(found, F.col("index")).otherwise(F.array("request")).alias("index")] if with_index else []
    return grouped.select(
        "request",
        "found_response",
        F.when(found, F.array("asked", "done")).otherwise(F.array("asked")).alias("timestamp"),
        F.when(found, ((F.col("done") - F.col("asked")) * 1000).cast("long")).alias("response_time"),
        "r.client_ip",
        "r.port",
        nothing.alias("request_status"),
        F.when(found, F.col("status")).alias("status_to_client"),
        F.when(found, F.col("size")).alias("size_of_reply"),
        "r.request_method",
        "r.url_from_client",
        "r.server_ip",
        nothing.alias("user_name"),
        nothing.alias("hierarchy_status"),
        "r.server_peer_name",
        "r.Referer",
        "r.User_Agent",
        *index,
        (found & F.col("chunked")).alias("Chunked"),
    )


def reply_data(packets: DataFrame, **options) -> DataFrame:
    """``(request, start, payload)``: the bytes of each reply in pieces, to be read by ``start``."""
    pieces = reply_packets(packets, **options)
    body = packets.select("idx", "payload")
    # A retransmission may repeat bytes at the front of a piece: keep its fresh tail.
    joined = pieces.join(body, "idx")
    overlap = F.octet_length("payload").cast("long") - F.col("fresh")
    return joined.select(
        "request",
        (F.col("start") + overlap).alias("start"),
        F.expr("substring(payload, int(octet_length(payload) - fresh + 1), int(fresh))").alias("payload"),
    )
