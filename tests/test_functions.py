"""Scalar functions and reshaping on the reference's small fixtures."""

import datetime as dt

from lakeloom.functions import datetimes as dtf
from lakeloom.functions import nested as nf
from lakeloom.functions import numeric as nu
from lakeloom.functions import strings as st
from lakeloom.operators import shape
from lakeloom.operators import text as tx


def one(df, col):
    return [r[col] for r in df.collect()]


def test_text_helpers(spark):
    df = spark.createDataFrame([(1, "Hello World!", "<p>Hi <b>there</b></p>")], "id int, title string, html string")
    assert one(st.text_replace(df, "title", "World", "Galaxy"), "title") == ["Hello Galaxy!"]
    assert one(st.slug(df, "title"), "title_slug") == ["hello-world"]
    assert one(st.strip_html(df, "html"), "html") == ["Hi there"]
    d2 = spark.createDataFrame([(1, "abc", "xyz"), (2, "foo", "foo")], "id int, a string, b string")
    assert one(st.text_reverse(d2, "a"), "a_reversed") == ["cba", "oof"]
    assert one(st.text_repeat(d2, "a", 3), "a_repeated")[0] == "abcabcabc"


def test_base64_roundtrip_utf8(spark):
    df = spark.createDataFrame([("café" * 40,)], "word string")
    enc = st.base64_codec(df, "word", "encode")
    assert "\r" not in one(enc, "word_encode")[0]
    assert one(st.base64_codec(enc, "word_encode", "decode"), "word_encode_decode") == ["café" * 40]


def test_similarity_scores(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("foo", "foo"), ("abc", "xyz")], "a string, b string")
    assert one(st.text_similarity(df, "a", "b", "levenshtein", "s"), "s") == [3, 0, 3]
    two = spark.createDataFrame([("martha", "marhta", "ca", "abc"), (None, "x", "x", None)], "a string, b string, c string, d string")
    jw = one(st.text_similarity(two, "a", "b", "jaro_winkler", "s"), "s")
    assert abs(jw[0] - 0.9611111) < 1e-6 and jw[1] is None
    assert one(st.text_similarity(two, "c", "d", "damerau_levenshtein", "s"), "s") == [2, None]  # unrestricted form (OSA gives 3)


def test_url_and_ip(spark):
    df = spark.createDataFrame([("https://example.com:8443/api/v1?key=x#top",), ("http://a.io/p",)], "url string")
    assert one(st.url_parse(df, "url", "host"), "url_host") == ["example.com", "a.io"]
    assert one(st.url_parse(df, "url", "port"), "url_port") == ["8443", ""]
    ips = spark.createDataFrame([("10.0.0.1/24",), ("192.168.1.5",), ("::1",)], "addr string")
    assert one(st.ip_parse(ips, "addr", "host"), "addr_host") == ["10.0.0.1", "192.168.1.5", "::1"]
    assert one(st.ip_parse(ips, "addr", "family"), "addr_family") == [4, 4, 6]
    assert one(st.ip_parse(ips, "addr", "network"), "addr_network")[0] == "10.0.0.0/24"
    assert one(st.ip_parse(ips, "addr", "broadcast"), "addr_broadcast")[0] == "10.0.0.255/24"
    assert one(st.ip_parse(ips, "addr", "netmask"), "addr_netmask")[0] == "255.255.255.0"


def test_pii_redact_labels(spark):
    df = spark.createDataFrame([(1, "mail alice@example.com or call (415) 555-0100"), (2, "SSN 123-45-6789"),
                                (3, "card 4242 4242 4242 4242"), (4, None)], "id int, note string")
    out = one(st.pii_redact(df, "note", "clean"), "clean")
    assert out[0] == "mail [REDACTED-EMAIL] or call [REDACTED-PHONE]"
    assert out[1] == "SSN [REDACTED-SSN]" and out[2] == "card [REDACTED-CREDIT-CARD]" and out[3] == ""


def test_prompt_render(spark):
    df = spark.createDataFrame([("ann", None)], "name string, city string")
    assert one(st.prompt_render(df, "Hi {name} from {city} {missing} {open"), "prompt") == ["Hi ann from   {open"]


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 11))], "start date, end date")
    assert one(dtf.dt_diff(df, "start", "end", "day"), "date_diff") == [10]
    late = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert one(dtf.dt_diff(late, "a", "b", "day"), "date_diff") == [1]
    d = spark.createDataFrame([(dt.date(2026, 1, 1),)], "d date")
    assert one(dtf.dt_extract(d, "d", "dow"), "d") == [4]
    ts = spark.createDataFrame([(dt.datetime(2026, 1, 1, 12, 0, 0),)], "ts timestamp_ntz")
    ep = dtf.dt_epoch(ts, "ts", "to")
    assert one(ep, "ts_epoch") == [1767268800.0]
    assert one(dtf.dt_epoch(ep, "ts_epoch", "from"), "ts_epoch_timestamp") == [dt.datetime(2026, 1, 1, 12)]
    tb = spark.createDataFrame([(dt.datetime(2026, 1, 1, 12, 3, 42),), (dt.datetime(2026, 1, 1, 12, 7, 11),)], "ts timestamp_ntz")
    assert [x.minute for x in one(dtf.time_bin(tb, "ts", "minute", 5), "ts_bin")] == [0, 5]
    m = spark.createDataFrame([(dt.datetime(2024, 1, 31),)], "ts timestamp_ntz")
    assert one(dtf.dt_add(m, "ts", 1, "month"), "ts") == [dt.datetime(2024, 2, 29)]


def test_numeric(spark):
    df = spark.createDataFrame([(1, -7), (2, 0), (3, 42)], "id int, v int")
    assert one(nu.num_sign(df, "v"), "v_sign") == [-1, 0, 1]
    c = spark.createDataFrame([(1, -50), (2, 25), (3, 150), (4, None)], "id int, v int")
    assert one(nu.num_clamp(c, "v", 0, 100), "v") == [0.0, 25.0, 100.0, 0.0]
    b = spark.createDataFrame([(5,), (15,), (55,), (95,), (150,)], "score int")
    assert one(nu.bucketize(b, "score", 0, 100, 10), "score_bucket") == [1, 2, 6, 10, 11]
    a = spark.createDataFrame([(5,), (25,), (70,)], "age int")
    assert one(nu.bucketize(a, "age", bounds=[18, 65], labels=["minor", "adult", "senior"]), "age_bucket") == ["minor", "adult", "senior"]
    assert one(nu.num_mod(df, "v", 0), "v") == [None, None, None]


def test_pad_cuts(spark):
    df = spark.createDataFrame([(7,), (42,), (1000000,)], "id int")
    assert one(st.pad(df, "id", 5, "0"), "id") == ["00007", "00042", "10000"]


def test_arrays_and_json(spark):
    df = spark.createDataFrame([(1, ["red", "blue"]), (2, ["green"]), (3, None)], "id int, tags array<string>")
    assert one(nf.arr_contains(df, "tags", "red"), "tags_contains") == [True, False, False]
    assert one(nf.arr_element(df, "tags", -1), "tags") == ["blue", "green", None]
    assert one(nf.arr_element(df, "tags", 0), "tags") == [None, None, None]
    assert nf.explode(df, "tags").count() == 4
    j = spark.createDataFrame([('{"a": 1, "b": {"c": 2}}', '{"b": {"c": null, "d": 3}, "e": "x"}')], "x string, y string")
    assert one(nf.json_merge(j, "x", "y"), "merged") == ['{"a":1,"b":{"d":3},"e":"x"}']
    assert one(nf.json_path(j, "x", "$.b.c"), "x") == ["2"]


def test_shape(spark):
    df = spark.createDataFrame([(1, 10, None), (2, None, 20)], "id int, q1 int, q2 int")
    assert shape.unpivot(df, "q1, q2").count() == 4
    n = spark.createDataFrame([(1, "a,b"), (2, "c")], "id int, tags string")
    assert shape.normalize(n, "tags").count() == 3
    t = spark.createDataFrame([(1, 10, 100), (2, 20, 200)], "a int, b int, c int")
    tr = {r.column_name: r.r1 for r in shape.transpose(t, "a").collect()}
    assert len(tr) == 3 and tr["b"] == "10"
    p = spark.createDataFrame([("x", "k1", 1), ("x", "k2", 2), ("y", None, 3)], "g string, k string, v int")
    out = {r.g: (r.k1, r.k2) for r in shape.pivot(p, "k", "v", "sum", "g").collect()}
    assert out == {"x": (1, 2), "y": (None, None)}


def test_chunk_text(spark):
    df = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz0123"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123"), (3, "")], "id int, text string")
    out = tx.chunk_text(df, "text", 10, 0).collect()
    assert len(out) == 7 and [r.chunk for r in out if r.id == 1][0] == "abcdefghij"
    ov = tx.chunk_text(df.where("id = 1"), "text", 10, 4).orderBy("chunk_index").collect()
    assert [r.chunk for r in ov] == ["abcdefghij", "ghijklmnop", "mnopqrstuv", "stuvwxyz01", "yz0123"]
    assert {r.chunk_count for r in ov} == {5}


def test_chunks_are_cut_in_the_jvm(spark):
    """No Arrow batch of whole texts goes to Python; same chunks as ``chunk_list``."""
    texts = [None, "", "a", "x\ny\r\n" * 9, "é😀\u2028z" * 31, "word " * 101, "0123456789"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size, overlap in ((10, 0), (10, 3), (10, 9), (10, 12), (1, 0), (7, -4), (0, 0), (500, 20)):
        out = tx.chunk_text(df, "text", size, overlap)
        assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.id, r.chunk_index, r.chunk, r.chunk_count) for r in out.collect())
        want = [(i, k, c, len(cs)) for i, t in enumerate(texts) for cs in [tx.chunk_list(t, size, overlap)] for k, c in enumerate(cs)]
        assert got == want, (size, overlap)


def test_dt_diff_matches_sql_boundaries(spark):
    import random

    import duckdb
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    base = dt.datetime(2023, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=rnd.randint(0, 10**8)), base + dt.timedelta(seconds=rnd.randint(0, 10**8)))
            for i in range(150)]
    df = spark.createDataFrame(rows, "i int, a timestamp_ntz, b timestamp_ntz")
    units = ["year", "quarter", "month", "week", "day", "hour", "minute", "second"]
    got = {r.i: tuple(r[1:]) for r in df.select("i", *[dtf.boundary_diff(F.col("a"), F.col("b"), u).alias(u) for u in units]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, a TIMESTAMP, b TIMESTAMP)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    exp = {r[0]: tuple(r[1:]) for r in con.execute("SELECT i, " + ", ".join(f"date_diff('{u}', a, b)" for u in units) + " FROM t").fetchall()}
    assert got == exp


def test_dt_extract_and_trunc_match_sql(spark):
    import random

    import duckdb

    rnd = random.Random(5)
    base = dt.datetime(2020, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=rnd.randint(0, 2 * 10**8), microseconds=rnd.randint(0, 999999))) for i in range(120)]
    out = spark.createDataFrame(rows, "i int, ts timestamp_ntz")
    units = ["year", "quarter", "month", "week", "day", "hour", "minute", "second", "dow", "isodow", "doy", "epoch",
             "millisecond", "microsecond", "decade"]
    tunits = ["year", "quarter", "month", "week", "day", "hour", "minute", "second"]
    for u in units:
        out = dtf.dt_extract(out, "ts", u, output=u)
    for u in tunits:
        out = dtf.dt_trunc(out, "ts", u, output="t_" + u)
    names = units + ["t_" + u for u in tunits]
    got = {r.i: tuple(r[n] for n in names) for r in out.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, ts TIMESTAMP)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    sql = ("SELECT i, " + ", ".join(f"date_part('{u}', ts)" for u in units) + ", "
           + ", ".join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP)" for u in tunits) + " FROM t")
    assert got == {r[0]: tuple(r[1:]) for r in con.execute(sql).fetchall()}
