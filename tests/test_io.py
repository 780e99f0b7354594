"""Readers, writers, table modes, change feeds, streaming and code nodes."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import code
from lakeloom.sources import readers, tables, writers
from lakeloom.streaming import streams as st


def test_fixedwidth(spark, tmp_dir):
    p = os.path.join(tmp_dir, "fw.txt")
    with open(p, "w") as f:
        f.write("00001alice               000123.45\n00002bob                 000050.00\n00003carol             000007.10\n")
    df = readers.read_fixedwidth(spark, p, [{"name": "id", "start": 1, "width": 5}, {"name": "name", "start": 6, "width": 20},
                                            {"name": "amt", "start": 26, "width": 9}])
    rows = df.orderBy("id").collect()
    assert len(rows) == 3 and rows[0].name == "alice" and rows[1].amt == "000050.00"


def test_csv_declared_schema_and_split(spark, tmp_dir):
    p = os.path.join(tmp_dir, "o.csv")
    with open(p, "w") as f:
        f.write("id,amount,day\n1,10,01/02/2024\n2,x,03/02/2024\n3,,05/02/2024\n")
    df = readers.read_csv(spark, p, columns=[{"name": "amount", "type": "int64"}, {"name": "day", "type": "date", "format": "%d/%m/%Y"},
                                             {"name": "missing", "type": "string"}])
    got = {r.id: (r.amount, r.day) for r in df.collect()}
    assert got[1] == (10, dt.date(2024, 2, 1)) and got[2][0] is None
    s = readers.read_csv_split(spark, p, [{"name": "amount", "type": "int64"}])
    assert s.passed.count() == 2 and [r.amount for r in s.rejected.collect()] == ["x"]


def test_partitioned_parquet_and_guard(spark, tmp_dir):
    df = spark.createDataFrame([("us", 1, 10), ("us", 2, 20), ("eu", 3, 5), ("apac", 4, 7)], "region string, id int, amount int")
    out = os.path.join(tmp_dir, "p")
    writers.write_parquet(df, out, partition_by="region")
    assert sorted(d for d in os.listdir(out) if d.startswith("region=")) == ["region=apac", "region=eu", "region=us"]
    with pytest.raises(ValueError, match="partitions"):
        writers.write_parquet(df, os.path.join(tmp_dir, "q"), partition_by="id", max_partitions=2)


def test_upsert_fixture(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    tables.write_table(spark.createDataFrame([(1, "alice"), (2, "bob"), (3, "carol")], "id int, name string"), path)
    src = spark.createDataFrame([(2, "BOB", "update"), (3, "carol", "delete"), (4, "dave", "insert")], "id int, name string, op string")
    for _ in range(2):  # applying the same batch again gives the same table
        tables.upsert_table(src, path, "id", delete_column="op")
        assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "alice"), (2, "BOB"), (4, "dave")]


def test_first_load_drops_flagged_rows_and_the_flag(spark, tmp_dir):
    src = spark.createDataFrame([(1, "a", None), (2, "b", "delete")], "id int, name string, op string")
    for i, write in enumerate((tables.upsert_table, tables.merge_table)):
        path = os.path.join(tmp_dir, f"first{i}")
        write(src, path, "id", delete_column="op")
        got = spark.read.parquet(path)
        assert got.columns == ["id", "name"] and [tuple(r) for r in got.collect()] == [(1, "a")]


def test_merge_updates_only_source_columns(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m")
    tables.write_table(spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, amt int"), path)
    src = spark.createDataFrame([(1, "A", None), (3, "c", None), (2, "x", "delete"), (9, "z", "delete")], "id int, name string, op string")
    tables.merge_table(src, path, "id", delete_column="op")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "A", 10), (3, "c", None)]


def test_duplicate_keys_refused(spark, tmp_dir):
    path = os.path.join(tmp_dir, "d")
    tables.write_table(spark.createDataFrame([(1, "a")], "id int, v string"), path)
    with pytest.raises(ValueError, match="duplicate"):
        tables.upsert_table(spark.createDataFrame([(2, "x"), (2, "y")], "id int, v string"), path, "id", on_duplicate="error")


def test_truncate_keeps_types(spark, tmp_dir):
    path = os.path.join(tmp_dir, "tr")
    tables.write_table(spark.createDataFrame([(1, "a")], "id int, v string"), path, "truncate")
    tables.write_table(spark.createDataFrame([("b", 2)], "v string, id long"), path, "truncate")
    got = spark.read.parquet(path)
    assert got.dtypes == [("id", "int"), ("v", "string")] and [tuple(r) for r in got.collect()] == [(2, "b")]
    with pytest.raises(ValueError, match="mode"):
        tables.write_table(got, path, "upsert")


def test_change_feed(spark, tmp_dir):
    path, jan, feb = os.path.join(tmp_dir, "cf"), dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    tables.write_snapshot(spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "id int, v string"), path, jan)
    tables.write_snapshot(spark.createDataFrame([(1, "a"), (2, "b2"), (3, "c")], "id int, v string"), path, feb)
    want = [(2, "b", "update_preimage"), (2, "b2", "update_postimage"), (3, "c", "insert"), (4, "d", "delete")]
    assert sorted((r.id, r.v, r.change_type) for r in tables.read_changes(spark, path, "id", jan, feb).collect()) == want
    assert sorted(r.v for r in tables.read_as_of(spark, path, dt.datetime(2024, 1, 15)).collect()) == ["a", "b", "d"]
    feed, now = tables.read_changes_incremental(spark, path, "id", jan)
    assert sorted((r.id, r.v, r.change_type) for r in feed.collect()) == want and now == feb
    assert tables.read_changes_incremental(spark, path, "id", now)[0].count() == 0
    first, _ = tables.read_changes_incremental(spark, path, "id", None, inserts_only=True)
    assert first.count() == 3


def _follow(spark, tmp_dir, log, name, batches, ckpt=None, **kw):
    """Write each batch as one file, drain the stream after it."""
    src, schema = os.path.join(tmp_dir, f"src-{name}"), "id int, v string, op string, at timestamp"
    for rows in batches:
        rows = [(i, v, op, None if at is None else dt.datetime(2024, 1, at)) for i, v, op, at in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        st.stream_upsert(spark.readStream.schema(schema).parquet(src), log, os.path.join(tmp_dir, ckpt or f"ckpt-{name}"), "id", "at", **kw)


def test_stream_upsert_keeps_the_newest_change_of_every_key(spark, tmp_dir):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "id int, v string")
    log = os.path.join(tmp_dir, "log")

    def now():
        return sorted(tuple(r) for r in st.upserted(target, log, "id", spark, delete_column="op").select("id", "v").collect())

    _follow(spark, tmp_dir, log, "one", [
        [(2, "old", None, 3), (2, "B", None, 5), (3, "c", None, 1), (7, "no order", None, None)],
        [(2, "late", None, 4), (3, "x", "delete", 2), (5, "e", None, 1)],  # an older change of key 2 comes late
        [(3, "again", None, 9), (5, "late delete", "delete", 1)],
    ])
    assert now()[:3] == [(1, "a"), (2, "B"), (3, "again")] and (9, "z") in now()
    stored = spark.read.parquet(log)
    assert stored.where("v = 'late'").count() == 0 and stored.where("v = 'no order'").count() == 0
    _follow(spark, tmp_dir, log, "two", [[(4, "d", None, 1), (1, "x", "delete", 1)]])  # a second stream, another checkpoint
    before = now()
    assert (4, "d") in before and all(i != 1 for i, _ in before) and (3, "again") in before
    _follow(spark, tmp_dir, log, "two", [[]], ckpt="ckpt-replayed")  # the same changes under a new checkpoint
    assert now() == before
    st.compact_changes(spark, log, "id")
    assert now() == before
    folded = spark.read.parquet(log)
    assert folded.count() == folded.select("id").distinct().count()
    _follow(spark, tmp_dir, log, "one", [[(2, "newest", None, 20)]])
    assert (2, "newest") in now()
    with pytest.raises(ValueError, match="running"):
        _follow(spark, tmp_dir, log, "one", [[]], expire_hours=1)


def test_stream_upsert_calls_no_python_per_key(spark, tmp_dir, monkeypatch):
    """Keys without expiry are an aggregate's state; a batch stores only what it brought."""
    monkeypatch.setattr(st, "_newest", None)
    log = os.path.join(tmp_dir, "log")
    first = [(k, f"v{k}", None, 5) for k in range(40)]
    _follow(spark, tmp_dir, log, "one", [first, [(1, "late", None, 4), (2, "v2", None, 5), (3, "new", None, 6)]])
    stored = spark.read.parquet(log)
    assert {r.v for r in stored.where("batch = 1").collect()} == {"new"} and stored.where("batch = 0").count() == 40


def test_repeated_snapshot_replaces_itself(spark, tmp_dir):
    path, jan, feb = os.path.join(tmp_dir, "snap"), dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        tables.write_snapshot(rows, path, jan)
    tables.write_snapshot(rows.where("id = 1"), path, feb)
    assert tables.read_as_of(spark, path, jan).count() == 2 and tables.read_as_of(spark, path, feb).count() == 1


def test_change_feed_resumes_once_per_snapshot(spark, tmp_dir):
    path, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("s", "sink", "ckpt"))

    def add(day, *rows):
        tables.write_snapshot(spark.createDataFrame(list(rows), "id int, v string"), path, dt.datetime(2024, 1, day))

    def feed():
        st.stream_changes(spark, path, "id", sink, ckpt)
        return sorted((r.changed_at.day, r.id, r.v, r.change_type) for r in spark.read.parquet(sink).collect())

    add(1, (1, "a"), (2, "b"))
    first = [(1, 1, "a", "insert"), (1, 2, "b", "insert")]
    assert feed() == first and feed() == first
    add(2, (1, "a"), (2, "c"))
    add(3, (2, "c"), (3, "d"))  # two new snapshots between restarts
    want = first + [(2, 2, "b", "update_preimage"), (2, 2, "c", "update_postimage"), (3, 1, "a", "delete"), (3, 3, "d", "insert")]
    assert feed() == want and feed() == want


def test_pii_guard(spark):
    df = writers.tag_pii(spark.createDataFrame([("a@x", 1)], "email string, n int"), "email")
    with pytest.raises(ValueError, match="PII"):
        writers.pii_guard(df)
    masked = df.withColumn("email", F.md5("email"))
    assert writers.pii_guard(masked) is masked


def test_fan_out_and_dead_letter(spark, tmp_dir):
    df = spark.createDataFrame([("1",), ("x",), ("3",)], "v string")
    out = writers.fan_out(df, [lambda d: d.count(), lambda d: d.where("v = 'x'").count()])
    assert out == [3, 1]
    got = []
    clean = writers.write_with_dead_letter(df, {"v": "int64"}, lambda c: got.append(c.count()), os.path.join(tmp_dir, "dl"))
    assert got == [2] and spark.read.parquet(os.path.join(tmp_dir, "dl")).count() == 1 and clean.schema["v"].dataType.simpleString() == "bigint"


def test_streams(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i), "u1" if i % 2 else "u2", float(i)) for i in range(40)]
    ev = spark.createDataFrame(rows, "id int, ts timestamp_ntz, user_id string, value double")
    ev.write.parquet(src)
    stream = st.stream_files(spark, src, ev.schema)
    bins = st.run_to_files(st.stream_time_bin(stream, "ts", None, "1 hour", watermark="0 seconds"), os.path.join(tmp_dir, "b"), os.path.join(tmp_dir, "bc"))
    assert bins.agg(F.sum("events")).collect()[0][0] <= 40 and bins.count() > 0
    s = st.run_to_files(st.stream_sessionize(st.stream_files(spark, src, ev.schema), "ts", "user_id", "10 minutes", "0 seconds"),
                        os.path.join(tmp_dir, "s"), os.path.join(tmp_dir, "sc"))
    assert s.count() > 0
    ok, bad = os.path.join(tmp_dir, "ok"), os.path.join(tmp_dir, "bad")
    st.stream_quality_split(st.stream_files(spark, src, ev.schema), "value >= 10", ok, bad, os.path.join(tmp_dir, "ck"))
    assert spark.read.parquet(ok).count() == 30 and spark.read.parquet(bad).count() == 10


def test_code_nodes(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 5)], "id int, amount int")
    out = code.sql_node(spark, "SELECT id, amount * 2 AS doubled FROM input WHERE amount >= 10", input=df).collect()
    assert len(out) == 2 and {r.doubled for r in out} == {20, 40}
    with pytest.raises(ValueError):
        code.sql_template(spark, "DROP TABLE x")
    kept = code.python_rows(df, lambda r: None if r["amount"] < 10 else {"id": r["id"]}, "id int").collect()
    assert sorted(r.id for r in kept) == [1, 2]
    mb = code.map_batches(df, lambda vals: [v * 10 for v in vals], "amount", "x", "bigint", batch_size=2).collect()
    assert sorted(r.x for r in mb) == [50, 100, 200]


def test_write_json_array_document(spark, tmp_dir):
    import glob
    import json

    df = spark.createDataFrame([(i, f"n{i}") for i in range(30)], "id int, name string")
    writers.write_json(df, os.path.join(tmp_dir, "arr"), "array")
    text = "".join(open(f).read() for f in sorted(glob.glob(os.path.join(tmp_dir, "arr", "part-*"))))
    assert sorted(r["id"] for r in json.loads(text)) == list(range(30))


def test_csv_padding_only_pads(spark, tmp_dir):
    def csv(name, text):
        path = os.path.join(tmp_dir, name)
        with open(path, "w", newline="") as f:
            f.write(text)
        return path

    schema = "a int, b int, s string"
    short = csv("short.csv", "a,b,s\n1\n2,3\n4,5,\"x, y\"\n")
    got = sorted(tuple(r) for r in readers.read_csv(spark, short, schema=schema, null_padding=True).collect())
    assert got == [(1, None, None), (2, 3, None), (4, 5, "x, y")]
    for bad in ("a,b,s\n1,x\n", "a,b,s\n3,4,t,5\n"):
        path = csv("bad.csv", bad)
        with pytest.raises(Exception):
            readers.read_csv(spark, path, schema=schema, null_padding=True).collect()
        assert readers.read_csv(spark, path, schema=schema, null_padding=True, ignore_errors=True).collect() == []


def test_csv_skips_lines_and_keeps_quoted_line_ends_in_many_tasks(spark, tmp_dir):
    rows = [(i, "text " + "\n" * (i % 4 == 0) + f'of "{i}", more' + "\nlast" * (i % 7 == 0)) for i in range(400)]
    for name, part in (("a.csv", rows[:300]), ("b.csv", rows[300:])):
        with open(os.path.join(tmp_dir, name), "w", newline="") as f:
            f.write("made by a tool\non a day, at a time\nid,t\n")
            for i, t in part:
                quoted = t.replace('"', '""')
                f.write(f'{i},"{quoted}"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        df = readers.read_csv(spark, tmp_dir, skip_lines=2, multi_line=True, schema="id int, t string", read_options={"escape": '"'})
        assert sorted(tuple(r) for r in df.collect()) == rows
        assert df.rdd.getNumPartitions() > 4
        flat = readers.read_csv(spark, os.path.join(tmp_dir, "b.csv"), skip_lines=2, multi_line=True, read_options={"escape": '"'})
        assert flat.dtypes == [("id", "int"), ("t", "string")] and flat.count() == 100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
