import pytest

from loglattice.operators import packets as pk

GET = b"GET /a?b=1 HTTP/1.1\r\nHost: h.example\r\nUser-Agent: ua/1\r\n\r\n"
SCHEMA = "idx long, ts double, src string, dst string, sport int, dport int, seq long, ack long, payload binary"


def up(idx, ts, seq, ack, payload, port=5000):
    return (idx, ts, "c", "s", port, 80, seq, ack, bytearray(payload))


def down(idx, ts, seq, ack, payload, port=5000):
    return (idx, ts, "s", "c", 80, port, seq, ack, bytearray(payload))


OK = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.request: r for r in pk.transactions(df, with_index=True, **options).collect()}


@pytest.mark.parametrize("block", [2, 1000])
def test_golden(spark, block):
    first = b"HTTP/1.1 200 OK\r\n".ljust(40, b"x")
    rows = [
        up(1, 0.0, 50, 100, GET),
        down(2, 0.01, 100, 130, b""),
        down(3, 0.05, 100, 130, first),
        down(4, 0.12, 140, 130, b"y" * 60),
        up(5, 1.0, 130, 200, GET.replace(b"Host: h.example\r\n", b"Referer: http://r/\r\n")),
    ]
    got = run(spark, rows, rows_per_block=block)
    r, q = got[1], got[5]
    assert (r.found_response, r.status_to_client, r.size_of_reply, r.response_time) == (True, "200", 100, 120)
    assert (r["index"], r.timestamp, r.Chunked) == ([1, 3, 4], [0.0, 0.12], False)
    assert (r.client_ip, r.port, r.server_ip, r.request_method) == ("c", 5000, "s", "GET")
    assert (r.url_from_client, r.server_peer_name, r.Referer, r.User_Agent) == (
        "http://h.example/a?b=1", "h.example", "-", "ua/1")
    assert (q.found_response, q.size_of_reply, q.status_to_client, q["index"]) == (False, None, None, [5])
    assert (q.url_from_client, q.server_peer_name, q.Referer) == ("http:///a?b=1", "", "http://r/")


@pytest.mark.parametrize("block", [2, 1000])
def test_disorder_retransmission_holes_and_flows(spark, block):
    n = len(OK)
    rows = [
        up(1, 0.0, 10, 100, GET),
        down(2, 0.3, 100 + n, 1, b"b" * 10),          # before the head of the reply
        down(3, 0.2, 100, 1, OK),
        down(4, 0.4, 100, 1, OK),                     # sent again
        down(5, 0.5, 100 + n + 5, 1, b"c" * 10),      # five bytes again, five new
        down(6, 0.6, 100 + n + 40, 1, b"d" * 10),     # after a hole
        up(7, 0.1, 10, 100, GET, 6000),               # same numbers, other flow
        down(8, 0.7, 100, 1, b"HTTP/1.0 404 NF\r\n\r\n", 6000),
        up(9, 1.0, 90, 500, GET),
        up(10, 1.1, 90, 500, GET),                    # request sent again
        down(11, 1.2, 500, 1, b"no http here"),
        up(12, 2.0, 99, 700, GET.replace(b"GET", b"POST")),
        up(13, 2.0, 120, 700, GET),                   # two requests at one offset
        down(14, 2.5, 700, 1, b"HTTP/1.1 302 Found\r\n\r\n"),
        up(15, 3.0, 300, 701, b"body bytes of a post"),
    ]
    got = run(spark, rows, rows_per_block=block)
    assert set(got) == {1, 7, 10, 12, 13}
    r = got[1]
    assert (r.size_of_reply, r["index"], r.Chunked, r.response_time) == (n + 15, [1, 2, 3, 5], True, 500)
    assert (got[7].status_to_client, got[7].size_of_reply, got[7].port) == ("404", 19, 6000)
    assert not got[10].found_response and not got[12].found_response
    assert got[12].request_method == "POST" and got[13].status_to_client == "302"
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = sorted((x.request, x.start, bytes(x.payload)) for x in pk.reply_data(df).collect())
    assert b"".join(p for q, _, p in pieces if q == 1) == OK + b"b" * 10 + b"c" * 5
    assert pk.http_requests(df).count() == 6


@pytest.mark.parametrize("block", [3, 1000])
def test_numbers_that_start_again(spark, block):
    turn = 1 << 32
    n = len(OK)
    base, asked = turn - n - 7, turn - 20
    rows = [
        (0, -0.1, "c", "s", 5000, 80, asked - 1, 0, bytearray()),
        up(1, 0.0, asked, base, GET),
        down(2, 0.1, base, asked + len(GET), OK),
        down(4, 0.3, base + n + 30, asked + len(GET), b"z" * 5),
        down(3, 0.2, base + n, asked + len(GET), b"y" * 30),
        down(5, 0.4, base, asked + len(GET), OK),
        up(6, 1.0, asked + len(GET), base + n + 35, GET),
        down(7, 1.1, base + n + 35, asked + 2 * len(GET), OK),
    ]
    want = run(spark, rows, rows_per_block=block)
    wrapped = [(*r[:6], r[6] % turn, r[7] % turn, r[8]) for r in rows]
    got = run(spark, wrapped, rows_per_block=block, raw=True)
    assert got == want and (want[1].size_of_reply, want[6].size_of_reply) == (n + 35, n)
    assert run(spark, wrapped, rows_per_block=block) != want
    offsets = {r.idx: (r.seq - asked, r.ack) for r in pk.unwrapped(spark.createDataFrame(wrapped, SCHEMA)).collect()}
    assert offsets[0] == (-1, 0) and offsets[6][0] == len(GET) and offsets[6][1] - offsets[1][1] == n + 35
