"""Log and packet parsing, features, scaling and blacklist joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglattice.functions import fields, url
from loglattice.operators import clustering, features, packets, scaling
from loglattice.operators.sequences import by_client
from loglattice.plans.detection import DetectionPlan
from loglattice.plans.detection import run as run_detection
from loglattice.session import shared_folder
from loglattice.sources import logs, tables
from workload.hash_sql import hashed
from workload.registry import query, rounded, table, with_

# The event table rendered as log lines; both texts describe the same line.
_CODES = "CASE event_type WHEN 'click' THEN '200' WHEN 'error' THEN '503' WHEN 'purchase' THEN '302' WHEN 'signup' THEN '000' ELSE '404' END"
_EXT = "CASE event_type WHEN 'click' THEN '.html' WHEN 'error' THEN '' WHEN 'purchase' THEN '.PHP' WHEN 'signup' THEN '.tar.gif' ELSE '/' END"
_PARTS = f"""
  CASE WHEN event_type = 'click' THEN '-' ELSE concat('93.184.', CAST(event_id % 300 AS VARCHAR(9)), '.', CAST(user_id % 7 AS VARCHAR(9))) END AS server_ip,
  concat('10.', CAST(user_id % 256 AS VARCHAR(9)), '.0.1') AS client_ip,
  {_CODES} AS code,
  concat(event_type, CAST(user_id % 5 AS VARCHAR(9)), '.example.com') AS peer,
  concat('/', event_type, '/', CAST(event_id AS VARCHAR(20)), {_EXT}) AS upath,
  CASE WHEN event_id % 3 = 0 THEN concat('id=', CAST(event_id AS VARCHAR(20)), '&u=', CAST(user_id AS VARCHAR(20))) ELSE '' END AS uquery
"""  # noqa: S608
EVENTS_PLUS = f"plus AS (SELECT *, {_PARTS} FROM events)"
URL_SQL = "concat('http://', peer, upath, CASE WHEN uquery <> '' THEN concat('?', uquery) ELSE '' END)"


def _plus(spark, folder):
    return table(spark, folder, "events").selectExpr("*", *[p for p in _PARTS.strip().split(",\n")])


def log_lines(spark, folder):
    """``(row_id, value)``: one access-log line per event; error events leave broken lines."""
    line = F.concat(
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0900 "), (F.col("event_id") % 1000).cast("string"),
        F.lit(" "), "client_ip", F.lit(" "), (1024 + F.col("user_id")).cast("string"), F.lit(" TCP_MISS/"), "code",
        F.lit(" "), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit(" GET "), F.expr(URL_SQL),
        F.lit(" "), "server_ip", F.lit(" - DEFAULT_PARENT/"), "peer", F.lit(' text/html "'), "event_type",
        F.lit('" "agent/1.0 (x; y)"'),
    )
    broken = F.substring_index(line, '"', 1)
    return _plus(spark, folder).select(
        F.col("event_id").alias("row_id"), F.when(F.col("event_type") == "error", broken).otherwise(line).alias("value")
    )


PLANE = f"""plane AS (SELECT event_id AS row_id, strftime(ts, '%d') AS day, strftime(ts, '%b') AS month,
  strftime(ts, '%Y') AS year, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, strftime(ts, '%S') AS second,
  '+0900' AS zero_time, event_id % 1000 AS response_time, client_ip, CAST(1024 + user_id AS INTEGER) AS port,
  'TCP_MISS' AS request_status, code AS status_to_client, CAST(round(value * 100) AS BIGINT) AS size_of_reply,
  'GET' AS request_method, {URL_SQL} AS url_from_client, server_ip, '-' AS user_name,
  'DEFAULT_PARENT' AS hierarchy_status, peer AS server_peer_name, 'text/html' AS MIME_content_type,
  event_type AS Referer, 'agent/1.0 (x; y)' AS User_Agent,
  epoch_us(date_trunc('second', ts)) - 32400000000 AS ts_us, upath, uquery
  FROM plus WHERE event_type <> 'error')"""


def plane(spark, folder):
    return logs.parse_lines(log_lines(spark, folder))


@query(with_(EVENTS_PLUS, PLANE) + "SELECT * EXCLUDE (upath, uquery) FROM plane")
def proxy_log_parse(spark, folder):
    return plane(spark, folder).withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query("SELECT event_id AS row_id FROM events WHERE event_type = 'error'")
def proxy_log_quarantine(spark, folder):
    return logs.quarantine(log_lines(spark, folder)).select("row_id")


PAGE_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(
    f"""SELECT key, arg_max(label, page_id) AS label FROM (SELECT page_id, concat({PAGE_HOST}, ',',
  split_part(url, '/', 4)) AS key, concat('list', CAST(page_id % 4 AS VARCHAR)) AS label FROM pages) GROUP BY key"""
)
def blacklist_parse(spark, folder):
    """Lines ``host,section,label``: the key keeps its comma and later pages win."""
    lines = table(spark, folder, "pages").select(
        F.col("page_id").alias("row_id"),
        F.concat(
            F.expr(PAGE_HOST), F.lit(","), F.split_part("url", F.lit("/"), F.lit(4)), F.lit(", list"),
            (F.col("page_id") % 4).cast("string"), F.lit("  "),
        ).alias("value"),
    )
    return logs.parse_blacklist(lines)


_TYPES = ", ".join(f"'{t}'" for t in url.FILE_TYPES)
_PATH = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(.*)$', 1)"
_QUERY = "regexp_extract(regexp_replace(url, '#.*$', ''), '[?](.*)$', 1)"


@query(
    f"""WITH u AS (SELECT page_id, url, {_PATH} AS p, {_QUERY} AS q FROM pages),
e AS (SELECT *, CASE WHEN split_part(p, '/', -1) LIKE '%.%' THEN split_part(p, '.', -1) ELSE '' END AS ext FROM u)
SELECT page_id, CAST(length(url) AS DOUBLE) AS url_length, CAST(length(p) AS DOUBLE) AS path_length,
  CAST(length(q) AS DOUBLE) AS query_length, CAST(length(q) - length(replace(q, '=', '')) AS DOUBLE) AS query_keys,
  CASE WHEN ext IN ({_TYPES}) THEN ext ELSE 'other' END AS file_type,
  CAST(regexp_matches(url, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}') AS DOUBLE) AS has_ip FROM e"""
)
def url_features(spark, folder):
    u = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", url.url_length(u).alias("url_length"), url.path_length(u).alias("path_length"),
        url.query_length(u).alias("query_length"), url.query_keys(u).alias("query_keys"),
        url.file_type(u).alias("file_type"), url.has_ipv4(u).alias("has_ip"),
    )


@query(
    with_(EVENTS_PLUS)
    + "SELECT event_id, "
    + ", ".join(f"CAST(code LIKE '{k}%' AS DOUBLE) AS status_to_client_{k}" for k in range(1, 6))
    + ", CAST(code LIKE '0%' AS DOUBLE) AS status_other FROM plus"
)
def status_classes(spark, folder):
    flags = fields.status_flags(F.col("code"))
    return _plus(spark, folder).select("event_id", *[c.alias(n) for n, c in flags.items()])


_OCTETS = "list_transform(string_split(ip, '.'), lambda s: CAST(s AS INTEGER))"
_BITS = ", ".join(
    f"CAST(CASE WHEN ok THEN (o[{i + 1}] >> {7 - j}) & 1 ELSE 0 END AS DOUBLE) AS IP_binary_{i}_{j}"
    for i in range(4)
    for j in range(8)
)


@query(
    with_(
        EVENTS_PLUS,
        "ips AS (SELECT event_id, server_ip, CASE WHEN server_ip = '-' THEN '0.0.0.0' ELSE server_ip END AS ip FROM plus)",
        f"octets AS (SELECT event_id, {_OCTETS} AS o, server_ip <> '-' AND list_max({_OCTETS}) <= 255 AS ok FROM ips)",
    )
    + f"SELECT event_id, {_BITS}, CAST(ok AS DOUBLE) AS ip_valid FROM octets"
)
def ip_bits(spark, folder):
    bits = fields.ip_bits(F.col("server_ip"))
    return _plus(spark, folder).select("event_id", *[c.alias(n) for n, c in bits.items()])


_TYPES5 = ("click", "error", "purchase", "signup", "view")


@query(
    "SELECT event_id, " + ", ".join(f"CAST(event_type = '{t}' AS DOUBLE) AS event_type_{t}" for t in _TYPES5)
    + " FROM events"
)
def dummies(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type")
    return features.dummies(rows, ["event_type"], {"event_type": _TYPES5})


_ORDER_TEXT = "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS p FROM orders"


@query(
    f"""WITH o AS ({_ORDER_TEXT}), v AS (SELECT DISTINCT 'k' AS feature, k AS value FROM o UNION SELECT DISTINCT 'p', p FROM o)
SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS slot FROM v"""
)
def dummy_values(spark, folder):
    """Every order key as text (as many values as rows) and the priorities, numbered."""
    rows = table(spark, folder, "orders").selectExpr("o_orderkey", "CAST(o_orderkey AS STRING) AS k", "o_orderpriority AS p")
    return features.dummy_values(rows, ["k", "p"])


@query(
    f"""WITH o AS ({_ORDER_TEXT})
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY k) - 1 AS INTEGER) AS k, CAST(dense_rank() OVER (ORDER BY p) - 1 AS INTEGER) AS p,
  CAST((SELECT count(DISTINCT k) FROM o) AS INTEGER) AS k_size FROM o"""
)
def dummy_vectors(spark, folder):
    """The place of the one in the sparse vectors of the same columns."""
    rows = table(spark, folder, "orders").selectExpr("o_orderkey", "CAST(o_orderkey AS STRING) AS k", "o_orderpriority AS p")
    one, size = F.udf(lambda v: int(v.indices[0]), "int"), F.udf(lambda v: v.size, "int")
    return features.sparse_dummies(rows, ["k", "p"]).select("o_orderkey", one("k").alias("k"), one("p").alias("p"), size("k").alias("k_size"))


@query(
    """SELECT event_id AS row_id, unnest(['event_type_' || event_type, 'user_id_' || CAST(user_id AS VARCHAR)]) AS feature,
  1.0::DOUBLE AS x FROM events"""
)
def dummies_long(spark, folder):
    rows = table(spark, folder, "events").withColumnRenamed("event_id", "row_id")
    return features.dummies_long(rows, ["event_type", "user_id"])


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "SELECT l_orderkey, "
    + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in _NUMERIC)
    + ", 0.0::DOUBLE AS flat FROM lineitem"
)
def minmax_scaled(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", *_NUMERIC, F.lit(3.0).alias("flat"))
    return rounded(scaling.min_max(rows, [*_NUMERIC, "flat"]), *_NUMERIC)


@query(
    "SELECT l_orderkey, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in _NUMERIC)
    + ", 0.0::DOUBLE AS flat FROM lineitem"
)
def zscored(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", *_NUMERIC, F.lit(3.0).alias("flat"))
    return rounded(scaling.z_score(rows, [*_NUMERIC, "flat"]), *_NUMERIC)


@query(
    f"""WITH a AS ({hashed("SELECT event_id AS x, event_type FROM events", 7, 0)}),
b AS ({hashed("SELECT event_id AS x, event_type FROM events", 7, 1)})
SELECT a.x AS row_id, (a.event_type = 'click')::DOUBLE + (a.h // 2048)::DOUBLE * pow(2::DOUBLE, -53) - 0.5::DOUBLE AS is_click,
  (a.event_type = 'view')::DOUBLE + (b.h // 2048)::DOUBLE * pow(2::DOUBLE, -53) - 0.5::DOUBLE AS is_view FROM a JOIN b USING (x)"""
)
def jittered(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"),
        (F.col("event_type") == "click").cast("double").alias("is_click"),
        (F.col("event_type") == "view").cast("double").alias("is_view"),
    )
    return scaling.jitter(rows, ["is_click", "is_view"], seed=7)


@query(
    f"""SELECT x AS row_id, (CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h + 4 ELSE h END) % 10 = 0 AS is_test
FROM ({hashed("SELECT event_id AS x FROM events", 4)})"""
)
def train_test_split(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_id").alias("row_id"))
    return clustering.with_split(rows, seed=4)


IP_LIST = "ip_list AS (SELECT DISTINCT server_ip AS key FROM plus WHERE event_type = 'signup' AND value > 60)"
HOST_RULE = "regexp_matches({0}, 'adult|bets|spam|casino|pills|ads-')"
HOST_LIST = f"host_list AS (SELECT DISTINCT {PAGE_HOST} AS key FROM pages WHERE {HOST_RULE.format('url')})"


def _ip_list(spark, folder):
    rows = _plus(spark, folder).where("event_type = 'signup' AND value > 60")
    return rows.select(F.col("server_ip").alias("key"), F.col("event_type").alias("label"))


def _host_list(spark, folder):
    rows = table(spark, folder, "pages").where(F.col("url").rlike("adult|bets|spam|casino|pills|ads-"))
    return rows.select(F.expr(PAGE_HOST).alias("key"), F.lit("bad").alias("label"))


def _page_hosts(spark, folder):
    return table(spark, folder, "pages").select("page_id", url.host(F.col("url")).alias("server_peer_name"))


@query(
    with_(EVENTS_PLUS, IP_LIST)
    + "SELECT event_id, server_ip, CAST(server_ip IN (SELECT key FROM ip_list) AS DOUBLE) AS server_ip_listed FROM plus"
)
def blacklist_ip_flags(spark, folder):
    rows = _plus(spark, folder).select("event_id", "server_ip")
    return features.blacklist_flag(rows, _ip_list(spark, folder), "server_ip")


@query(
    with_(HOST_LIST)
    + f"""SELECT page_id, {PAGE_HOST} AS server_peer_name,
  CAST({PAGE_HOST} IN (SELECT key FROM host_list) AS DOUBLE) AS server_peer_name_listed FROM pages"""
)
def blacklist_host_flags(spark, folder):
    return features.blacklist_flag(_page_hosts(spark, folder), _host_list(spark, folder), "server_peer_name")


@query(
    with_(HOST_LIST)
    + f"SELECT page_id, {PAGE_HOST} AS server_peer_name FROM pages WHERE {PAGE_HOST} IN (SELECT key FROM host_list)"
)
def blacklisted_pages(spark, folder):
    return features.listed(_page_hosts(spark, folder), _host_list(spark, folder), "server_peer_name")


@query(
    with_(HOST_LIST)
    + f"SELECT page_id, {PAGE_HOST} AS server_peer_name FROM pages WHERE {PAGE_HOST} NOT IN (SELECT key FROM host_list)"
)
def unlisted_pages(spark, folder):
    return features.unlisted(_page_hosts(spark, folder), _host_list(spark, folder), "server_peer_name")


FEATURES = (
    "server_ip", "server_peer_name", "status_to_client", "size_of_reply", "response_time", "file_type", "URL_length",
    "URL_path_length", "URL_query_length", "URL_query_key_number", "URL_have_IP", "server_IP_binary", "Referer",
)
SCALED = ("size_of_reply", "response_time", "URL_length", "URL_path_length", "URL_query_length", "URL_query_key_number")


def _scaled_sql(expr: str, name: str) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    return f"round(coalesce(({x} - min({x}) OVER ()) / nullif(max({x}) OVER () - min({x}) OVER (), 0), 0), 6) AS {name}"


_FLAGS = [f"CAST(status_to_client LIKE '{k}%' AS DOUBLE) AS status_to_client_{k}" for k in range(1, 6)]
_FLAGS += ["CAST(status_to_client LIKE '0%' AS DOUBLE) AS status_other"]
_KIND = [f"CAST(ext = '{t}' AS DOUBLE) AS file_type_{t}" for t in url.FILE_TYPES]
_KIND += [f"CAST(ext NOT IN ({_TYPES}) AS DOUBLE) AS file_type_other", "0.0::DOUBLE AS file_type_"]


_MISSING = ", ".join(f"0.0::DOUBLE AS {c}_missing" for c in SCALED)
_SIZES = """sizes AS (SELECT row_id, CASE WHEN status_to_client LIKE '4%' THEN NULL ELSE CAST(size_of_reply AS DOUBLE) END AS x FROM plane)"""


@query(
    with_(EVENTS_PLUS, PLANE, _SIZES)
    + """SELECT row_id, round(coalesce((x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0), 0), 6) AS size_of_reply,
  CAST(x IS NULL AS DOUBLE) AS size_of_reply_missing FROM sizes"""
)
def input_table_with_missing_sizes(spark, folder):
    """Rows whose reply size is not known, as after a dash in the log line, get 0 and a flag."""
    known = F.when(~F.col("status_to_client").startswith("4"), F.col("size_of_reply"))
    rows = plane(spark, folder).withColumn("size_of_reply", known)
    return rounded(features.input_table(rows, ["size_of_reply"], ["size_of_reply"]), "size_of_reply")


@query(
    with_(
        EVENTS_PLUS,
        PLANE,
        IP_LIST,
        HOST_LIST,
        f"""wide AS (SELECT *, CASE WHEN split_part(upath, '/', -1) LIKE '%.%' THEN split_part(upath, '.', -1) ELSE '' END AS ext,
  CASE WHEN server_ip = '-' THEN '0.0.0.0' ELSE server_ip END AS ip FROM plane)""",
        f"full_ AS (SELECT *, {_OCTETS} AS o, server_ip <> '-' AND list_max({_OCTETS}) <= 255 AS ok FROM wide)",
    )
    + f"""SELECT row_id, CAST(server_ip IN (SELECT key FROM ip_list) AS DOUBLE) AS server_ip,
  CAST(server_peer_name IN (SELECT key FROM host_list) AS DOUBLE) AS server_peer_name, {", ".join(_FLAGS + _KIND)},
  {_scaled_sql("size_of_reply", "size_of_reply")}, {_scaled_sql("response_time", "response_time")},
  {_scaled_sql("length(url_from_client)", "URL_length")}, {_scaled_sql("length(upath)", "URL_path_length")},
  {_scaled_sql("length(uquery)", "URL_query_length")},
  {_scaled_sql("length(uquery) - length(replace(uquery, '=', ''))", "URL_query_key_number")},
  CAST(regexp_matches(url_from_client, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}') AS DOUBLE) AS URL_have_IP,
  {_BITS}, CAST(ok AS DOUBLE) AS ip_valid, {_MISSING},
  {", ".join(f"CAST(Referer = '{t}' AS DOUBLE) AS Referer_{t}" for t in _TYPES5 if t != "error")} FROM full_"""
)
def input_table(spark, folder):
    """Lines parsed and turned into the numeric table of thirteen features."""
    stored = tables.store(plane(spark, folder), shared_folder(spark), tables.new_name("plane"))
    out = features.input_table(
        stored, FEATURES, SCALED, values={"Referer": [t for t in _TYPES5 if t != "error"]},
        ip_blacklist=_ip_list(spark, folder), host_blacklist=_host_list(spark, folder),
    )
    return rounded(out, *SCALED)


# One request per event, acknowledged byte 100000 * event_id of the user's connection. Errors
# get no answer; purchases get two packets, their second one sent twice and out of order.
_HEAD = "concat('HTTP/1.1 ', code, ' X\\r\\nServer: s\\r\\n', CASE WHEN event_type = 'view' THEN 'Transfer-Encoding: chunked\\r\\n' ELSE '' END, '\\r\\n')"
_BODY = "repeat('z', CAST(event_id % 50 AS INT) + 1)"
_ASK = f"concat('GET ', upath, ' HTTP/1.1\\r\\nHost: ', peer, '\\r\\n', CASE WHEN event_id % 2 = 0 THEN concat('User-Agent: ua/', event_type, '\\r\\n') ELSE '' END, '\\r\\n')"


def _lf(sql: str) -> str:
    return sql.replace("\\r\\n", "\r\n")


def packet_table(spark, folder):
    rows = _plus(spark, folder).withColumns(
        {
            "head": F.expr(_lf(_HEAD)),
            "body": F.expr(_BODY),
            "ask": F.expr(_lf(_ASK)),
            "t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6,
        }
    )
    at, flow = F.col("event_id") * 100000, F.col("user_id").cast("int")

    def packet(nth, up, seq, ack, payload, after):
        return F.struct(
            (F.col("event_id") * 10 + nth).alias("idx"), (F.col("t") + after).alias("ts"),
            F.col("client_ip" if up else "peer").alias("src"), F.col("peer" if up else "client_ip").alias("dst"),
            (flow + 1024 if up else F.lit(80)).alias("sport"), (F.lit(80) if up else flow + 1024).alias("dport"),
            seq.alias("seq"), ack.alias("ack"), payload.cast("binary").alias("payload"),
        )

    head, body = F.col("head"), F.col("body")
    asked = packet(0, True, F.col("event_id") * 1000, at, F.col("ask"), 0.0)
    bare = packet(1, False, at, F.lit(1).cast("long"), F.lit(""), 0.125)
    first = packet(4, False, at, F.lit(1).cast("long"), head, 0.25)
    rest = packet(2, False, at + F.length(head), F.lit(1).cast("long"), body, 0.1875)
    again = packet(5, False, at + F.length(head), F.lit(1).cast("long"), body, 0.5)
    sent = (
        F.when(F.col("event_type") == "error", F.array(asked, bare))
        .when(F.col("event_type") == "purchase", F.array(asked, bare, first, rest, again))
        .otherwise(F.array(asked, bare, first))
    )
    return rows.select(F.explode(sent).alias("p")).select("p.*")


_TALK = _lf(
    f"""talk AS (SELECT *, {_HEAD} AS head, {_BODY} AS body, epoch_us(ts) / 1e6 AS t, event_type <> 'error' AS found FROM plus)"""
)
_AGENT = "CASE WHEN event_id % 2 = 0 THEN concat('ua/', event_type) END"


@query(
    with_(EVENTS_PLUS)
    + f"""SELECT event_id * 10 AS idx, client_ip, CAST(user_id + 1024 AS INTEGER) AS port, peer AS server_ip,
  'GET' AS request_method, concat('http://', peer, upath) AS url_from_client, peer AS server_peer_name,
  '-' AS Referer, {_AGENT} AS User_Agent FROM plus"""
)
def http_requests(spark, folder):
    return packets.http_requests(packet_table(spark, folder)).drop("ts")


_TRANSACTIONS = (
    with_(EVENTS_PLUS, _TALK)
    + f"""SELECT event_id * 10 AS request, found AS found_response,
  CASE WHEN found THEN CAST(trunc(((t + 0.25) - t) * 1000) AS BIGINT) END AS response_time,
  client_ip, CAST(user_id + 1024 AS INTEGER) AS port, CASE WHEN found THEN code END AS status_to_client,
  CASE WHEN found THEN CAST(length(head) + CASE WHEN event_type = 'purchase' THEN length(body) ELSE 0 END AS BIGINT) END AS size_of_reply,
  'GET' AS request_method, concat('http://', peer, upath) AS url_from_client, peer AS server_ip, peer AS server_peer_name,
  '-' AS Referer, {_AGENT} AS User_Agent, found AND event_type = 'view' AS Chunked FROM talk"""
)


@query(_TRANSACTIONS)
def http_transactions(spark, folder):
    found = packets.transactions(packet_table(spark, folder))
    return found.drop("timestamp", "request_status", "user_name", "hierarchy_status")


@query(_TRANSACTIONS)
def http_transactions_past_the_turn(spark, folder):
    """The same transactions from numbers of 32 bits that start again inside the flows."""
    captured = packet_table(spark, folder).withColumns({c: F.pmod(F.col(c) - 5_000_000, F.lit(1 << 32)) for c in ("seq", "ack")})
    found = packets.transactions(captured, raw=True)
    return found.drop("timestamp", "request_status", "user_name", "hierarchy_status")


@query(
    with_(EVENTS_PLUS, _TALK)
    + """SELECT event_id * 10 AS request, round(t, 3) AS asked, CASE WHEN found THEN round(t + 0.25, 3) END AS answered,
  CASE WHEN NOT found THEN CAST(event_id * 10 AS VARCHAR) WHEN event_type = 'purchase' THEN concat(event_id * 10, ',', event_id * 10 + 2, ',', event_id * 10 + 4)
    ELSE concat(event_id * 10, ',', event_id * 10 + 4) END AS packets FROM talk"""
)
def http_transaction_packets(spark, folder):
    """When each request was sent and answered, and the packets of both."""
    found = packets.transactions(packet_table(spark, folder), with_index=True)
    return found.select(
        "request", F.round(F.col("timestamp")[0], 3).alias("asked"), F.round(F.get("timestamp", F.lit(1)), 3).alias("answered"),
        F.array_join(F.col("index").cast("array<string>"), ",").alias("packets"),
    )


@query(
    with_(EVENTS_PLUS, _TALK)
    + """SELECT event_id * 10 AS request, head || CASE WHEN event_type = 'purchase' THEN body ELSE '' END AS data FROM talk WHERE found"""
)
def http_reply_data(spark, folder):
    """The bytes of every reply, its pieces put together in order."""
    pieces = packets.reply_data(packet_table(spark, folder))
    ordered = F.array_sort(F.collect_list(F.struct("start", F.col("payload").cast("string").alias("text"))))
    whole = pieces.groupBy("request").agg(ordered.alias("parts"))
    return whole.select("request", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("data"))


@query(
    with_(EVENTS_PLUS, _TALK)
    + """SELECT event_id * 10 AS request, event_id * 10 + 4 AS idx, CAST(0 AS BIGINT) AS start, length(head) AS fresh
  FROM talk WHERE found
UNION ALL SELECT event_id * 10, event_id * 10 + 2, length(head), length(body) FROM talk WHERE event_type = 'purchase'"""
)
def http_reply_packets(spark, folder):
    return packets.reply_packets(packet_table(spark, folder))


_CHUNKED = """chunked AS (SELECT client_ip, row_number() OVER (PARTITION BY client_ip ORDER BY ts_us, row_id) - 1 AS rn,
  count(*) OVER (PARTITION BY client_ip) AS n FROM plane),
chunks AS (SELECT DISTINCT client_ip || '_' || CAST(rn // 10 AS VARCHAR) AS seq_id FROM chunked WHERE n - (rn // 10) * 10 >= 2)"""


@query(
    with_(EVENTS_PLUS, PLANE, _CHUNKED)
    + "SELECT seq_id, eps, true AS scored, true AS flag_fits FROM chunks, (VALUES (1.5::DOUBLE), (2.5::DOUBLE)) e(eps)"
)
def log_to_anomalies(spark, folder):
    """Every stage from log lines to flagged chunks of client sequences: which chunks are judged, at which thresholds."""
    stored = tables.store(plane(spark, folder), shared_folder(spark), tables.new_name("detection_plane"))
    plan = DetectionPlan(
        features=("size_of_reply", "response_time", "URL_length", "file_type", "status_to_client"),
        numeric=("size_of_reply", "response_time", "URL_length"),
        mode="chunk", eps=(1.5, 2.5), detector_options={"max_length": 10},
    )
    flags = run_detection(stored, plan)
    fits = (F.col("score") > F.col("eps")) == F.col("is_anomaly")
    return flags.select("seq_id", "eps", (F.col("score") >= 0).alias("scored"), fits.alias("flag_fits"))


@query(
    with_(EVENTS_PLUS, PLANE)
    + """SELECT row_id, client_ip, row_number() OVER (PARTITION BY client_ip ORDER BY ts_us, row_id) - 1 AS pos FROM plane"""
)
def log_files_in_order(spark, folder):
    """Lines written as text files, read back as a log; the place of each line among those of its client."""
    path = f"{shared_folder(spark).rstrip('/')}/{tables.new_name('lines')}"
    lines = log_lines(spark, folder)
    tagged = F.concat_ws(" ", "value", F.concat(F.lit("row="), F.col("row_id")))
    lines.repartitionByRange(4, "row_id").sortWithinPartitions("row_id").select(tagged.alias("value")).write.text(path)
    read = logs.read_lines(spark, path).withColumn("line", F.regexp_extract("value", r"row=(\d+)$", 1).cast("long"))
    placed = by_client(logs.parse_lines(read), order=logs.FILE_ORDER, state="line", keep=["client_ip"])
    return placed.select(F.col("state").alias("row_id"), "client_ip", "pos")
