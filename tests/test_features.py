import pytest
from pyspark.sql import functions as F

from loglattice.functions import fields, similarity, url
from loglattice.operators import features, scaling
from loglattice.sources import logs, tables

LINE = (
    '01/Oct/2017:00:00:05 +0900 120 192.168.0.1 51000 TCP_MISS/200 5120 GET '
    'http://example.com/a.html 93.184.216.34 - DEFAULT_PARENT/example.com text/html "-" "Mozilla/5.0"'
)


def lines_of(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id long, value string")


def test_parse_and_quarantine(spark):
    bracket = "[" + LINE.replace("TCP_MISS/200", "TCP_DENIED/000")
    bad = ["nonsense", "a" * 3000 + " b/c:d:e " * 200, LINE.rsplit('"', 3)[0]]
    lines = lines_of(spark, [LINE, *bad, bracket])
    rows = logs.parse_lines(lines).orderBy("row_id").collect()
    assert len(rows) == 2
    r = rows[0]
    assert str(r.ts) == "2017-09-30 15:00:05" and rows[1].ts == r.ts
    assert (r.day, r.month, r.year, r.hour, r.minute, r.second) == ("01", "Oct", "2017", "00", "00", "05")
    assert rows[1].day == "[01" and rows[1].status_to_client == "000"
    assert (r.zero_time, r.response_time, r.client_ip, r.port) == ("+0900", 120, "192.168.0.1", 51000)
    assert (r.request_status, r.status_to_client, r.size_of_reply) == ("TCP_MISS", "200", 5120)
    assert (r.request_method, r.url_from_client) == ("GET", "http://example.com/a.html")
    assert (r.server_ip, r.user_name, r.hierarchy_status) == ("93.184.216.34", "-", "DEFAULT_PARENT")
    assert (r.server_peer_name, r.MIME_content_type) == ("example.com", "text/html")
    assert (r.Referer, r.User_Agent) == ("-", "Mozilla/5.0")
    assert sorted(r.value for r in logs.quarantine(lines).collect()) == sorted(bad)


def test_read_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join([LINE] * 3 + ["broken"]) + "\n")
    (tmp_path / "bl.txt").write_text("a,b,c \nx,1\nx,2\n10.0.0.1,bad\n")
    plane = logs.read_proxy_log(spark, str(tmp_path / "a.log"))
    assert plane.count() == 3 and plane.where("src_file like '%a.log'").count() == 3
    got = {r.key: r.label for r in logs.read_blacklist(spark, str(tmp_path / "bl.txt")).collect()}
    assert got == {"a,b": "c", "x": "2", "10.0.0.1": "bad"}


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, d string")
    stored = tables.store(df, str(tmp_path), "t", partition_by=["d"])
    assert stored.where("d = 'a'").count() == 1
    assert tables.load(spark, str(tmp_path), "t").count() == 2


def test_url_features(spark):
    cases = {
        "http://10.0.0.1/a/b.tar.gz;v=1?p=1&q=2": (38, 11, 7, 2, 3, 1, "other", 1),
        "/x/A.JPG": (8, 8, 0, 0, 0, 0, "other", 0),
        "/x/a.jpg": (8, 8, 0, 0, 0, 0, "jpg", 0),
        "/x/.htaccess": (12, 12, 0, 0, 0, 0, "other", 0),
        "/x/": (3, 3, 0, 0, 0, 0, "other", 0),
        "host.example:443": (16, 0, 0, 0, 0, 0, "other", 0),
        "http://h/a;b/c.php?x=/y.exe#f": (29, 10, 8, 1, 0, 0, "php", 0),
        "http://h": (8, 0, 0, 0, 0, 0, "other", 0),
        "http://h/sp ace.css": (19, 11, 0, 0, 0, 0, "css", 0),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    u = F.col("u")
    rows = df.select(
        u, url.url_length(u), url.path_length(u), url.query_length(u), url.query_keys(u),
        url.query_length(u, "params"), url.query_keys(u, "params"), url.file_type(u), url.has_ipv4(u),
    ).collect()
    for r in rows:
        assert tuple(r)[1:] == cases[r.u], r.u


def test_status_and_bits(spark):
    df = spark.createDataFrame([("200",), ("404",), ("000",), ("700",), ("x",), (None,)], "s string")
    on = lambda z: [
        [k for k, v in r.asDict().items() if v] for r in df.select(
            *[c.alias(n) for n, c in fields.status_flags(F.col("s"), zero_is_five=z).items()]
        ).collect()
    ]
    other = ["status_other"]
    assert on(False) == [["status_to_client_2"], ["status_to_client_4"], other, other, other, other]
    assert on(True)[2] == ["status_to_client_5"]
    ips = spark.createDataFrame([("192.168.0.1",), ("-",), ("300.1.1.1",), ("::1",)], "ip string")
    bits = ips.select(*[c.alias(n) for n, c in fields.ip_bits(F.col("ip")).items()]).collect()
    text = ["".join(str(int(v)) for v in tuple(r)[:32]) for r in bits]
    assert text == ["11000000101010000000000000000001"] + ["0" * 32] * 3
    assert [r.ip_valid for r in bits] == [1, 0, 0, 0]


def test_scaling(spark):
    df = spark.createDataFrame([(2.0, 7.0, 1.0), (4.0, 7.0, 3.0), (6.0, 7.0, None)], "a double, b double, c double")
    got = scaling.min_max(df, ["a", "b"]).orderBy("a").collect()
    assert [(r.a, r.b) for r in got] == [(0, 0), (0.5, 0), (1, 0)]
    z = scaling.z_score(df, ["b", "c"]).orderBy("a").collect()
    assert [(r.b, r.c) for r in z] == [(0, -1), (0, 1), (0, None)]


def test_jitter_ignores_partitioning(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    one = scaling.jitter(df.repartition(1), ["a", "b"]).orderBy("row_id").collect()
    many = scaling.jitter(df.repartition(7), ["a", "b"]).orderBy("row_id").collect()
    assert one == many
    assert all(0.5 <= r.a < 1.5 and -0.5 <= r.b < 0.5 for r in one)
    assert len({r.a for r in one}) == 500 and one[0].a - 1 != one[0].b
    assert abs(sum(r.b for r in one) / 500) < 0.05


def test_dummies(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "row_id long, c string")
    rows = features.dummies(df, ["c"], {"c": ["x", "y"]}).orderBy("row_id")
    assert rows.columns == ["row_id", "c_x", "c_y"]
    assert [tuple(r) for r in rows.collect()] == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    long = {(r.row_id, r.feature) for r in features.dummies_long(df, ["c"]).collect()}
    assert long == {(1, "c_x"), (2, "c_y")}
    sparse = features.sparse_dummies(df, ["c"]).orderBy("row_id").collect()
    assert [r.c.toArray().tolist() for r in sparse] == [[1, 0], [0, 1], [0, 0]]


def test_dummies_of_many_values(spark):
    df = spark.range(12_000).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id")).alias("c"), F.lit(None).cast("string").alias("d"))
    values = features.dummy_values(df, ["c", "d"])
    slots = {r.value: r.slot for r in values.collect()}
    assert [v for v, _ in sorted(slots.items(), key=lambda x: x[1])] == sorted(f"v{i}" for i in range(12_000))
    assert set(slots.values()) == set(range(12_000))
    rows = features.sparse_dummies(df, ["c", "d"], values).collect()
    assert all(r.c.size == 12_000 and r.c.indices.tolist() == [slots[f"v{r.row_id}"]] and r.d.numNonzeros() == 0 for r in rows)


def test_schema_of_sparse_dummies_does_not_grow_with_the_values(spark):
    def schema(n):
        df = spark.range(n).select(F.concat(F.lit("v"), F.col("id")).alias("c"))
        return features.sparse_dummies(df, ["c"])

    assert len(schema(3_000).schema.json()) - len(schema(30).schema.json()) < 10
    # Also without rows the size is known, and vectors can be assembled.
    empty = schema(30).where("false")
    assert features.assemble(empty, ["c"]).count() == 0


def test_input_table_without_nulls(spark):
    plane = spark.createDataFrame([(1, "200", "10", "r1"), (2, "200", "-", "r2"), (3, "404", "30", None)], "row_id long, status_to_client string, size_of_reply string, Referer string")
    table = features.input_table(plane, ["status_to_client", "size_of_reply", "Referer"], ["size_of_reply"])
    rows = {r.row_id: r for r in features.assemble(table).collect()}
    assert [rows[i].size_of_reply for i in (1, 2, 3)] == [0, 0, 1] and [rows[i].size_of_reply_missing for i in (1, 2, 3)] == [0, 1, 0]
    assert rows[1].features.size == rows[3].features.size and rows[3].Referer.numNonzeros() == 0


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_blacklist_joins(spark, limit):
    df = spark.createDataFrame([(i, f"h{i % 3}") for i in range(9)] + [(9, None)], "row_id long, h string")
    bl = spark.createDataFrame([("h1", "bad"), ("h1", "worse"), ("zz", "q")], "key string, label string")
    flags = features.blacklist_flag(df, bl, "h", broadcast_bytes=limit).orderBy("row_id").collect()
    assert [r.h_listed for r in flags] == [0, 1, 0] * 3 + [0]
    assert features.listed(df, bl, "h", broadcast_bytes=limit).count() == 3
    assert features.unlisted(df, bl, "h", broadcast_bytes=limit).count() == 7


def test_input_table(spark):
    plane = logs.parse_lines(lines_of(spark, [LINE, LINE.replace("/200 5120 GET", "/404 10 POST")]))
    ips = spark.createDataFrame([("93.184.216.34", "bad")], "key string, label string")
    hosts = spark.createDataFrame([("other", "bad")], "key string, label string")
    wanted = ["server_ip", "server_peer_name", "status_to_client", "size_of_reply", "request_method",
              "file_type", "URL_length", "server_IP_binary"]
    table = features.input_table(
        plane, wanted, ["size_of_reply", "URL_length"], ip_blacklist=ips, host_blacklist=hosts,
        values={"request_method": ["GET", "POST"]},
    )
    a, b = table.orderBy("row_id").collect()
    assert (a.server_ip, a.server_peer_name, a.size_of_reply, b.size_of_reply) == (1, 0, 1, 0)
    assert (a.URL_length, a.status_to_client_2, b.status_to_client_4, a.file_type_html) == (0, 1, 1, 1)
    assert (a.request_method_GET, b.request_method_GET, b.request_method_POST) == (1, 0, 1)
    assert table.columns[-2:] == ["request_method_GET", "request_method_POST"]
    vectors = features.assemble(table).select("features").collect()
    assert len(vectors[0].features) == len(table.columns) - 1
    noisy = features.input_table(
        plane, wanted, ["size_of_reply", "URL_length"], ip_blacklist=ips, host_blacklist=hosts, jittered=True
    ).orderBy("row_id").first()
    assert noisy.size_of_reply == 1 and abs(noisy.server_ip - 1) < 0.5 and noisy.server_ip != 1


def test_native_lcs_and_ngrams(spark):
    df = spark.createDataFrame(
        [([0, 0, 1, 2, 0], [0, 3, 2, 1], 2), ([1, 2, 0], [0, 0, 1, 2, 0], 3), ([], [1], 0), ([4], [1], 0)],
        "a array<int>, b array<int>, n int",
    )
    got = df.select(similarity.lcs_length(F.col("a"), F.col("b")).alias("g"), "n",
                    similarity.lcs_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.g for r in got] == [r.n for r in got]
    assert got[0].s == pytest.approx(2 / 20**0.5) and got[2].s is None
    grams = df.select(similarity.ngrams(F.col("b"), 2)).first()[0]
    assert grams == [[-1, 0], [0, 3], [3, 2], [2, 1], [1, -1]]


def test_a_separator_in_a_line_is_not_a_field(spark):
    junk = "\u0001".join(str(i) for i in range(22))
    marked = LINE.replace("text/html", "text/\u0001html")
    plane = logs.parse_lines(lines_of(spark, [junk, marked, LINE])).orderBy("row_id").collect()
    assert len(plane) == 2 and plane[0].MIME_content_type == "text/�html"
    assert logs.quarantine(lines_of(spark, [junk, marked, LINE])).count() == 1


def test_stored_name_is_not_taken_over(spark, tmp_path):
    first = tables.store(spark.range(3), str(tmp_path), "ids")
    with pytest.raises(Exception, match="exist"):
        tables.store(spark.range(5), str(tmp_path), "ids")
    assert first.count() == 3 and tables.store(spark.range(5), str(tmp_path), "ids", overwrite=True).count() == 5
