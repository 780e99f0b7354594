"""Both window forms agree in value and type; small answers that were wrong."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import strings
from lakeloom.operators import code, columns, geo, rows, quality, shape
from lakeloom.operators import windows as win
from lakeloom.sources import readers

BASE = dt.datetime(2024, 1, 1)


def ties(spark):
    """Two keys, one with most rows; repeated times, null values, large integers."""
    data = [(i, "hot" if i % 5 else None, BASE + dt.timedelta(minutes=3 * (i // 4)), None if i % 11 == 0 else Decimal(i) / 8,
             (1 << 60) + i, dt.date(2024, 1, 1) + dt.timedelta(days=(7 * i) % 40), chr(97 + (5 * i) % 26) + "é", float(i % 13))
            for i in range(240)]
    return spark.createDataFrame(data, "id int, k string, ts timestamp_ntz, dec decimal(12,3), big bigint, day date, txt string, x double")


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_running_forms_agree_in_value_and_type(spark, partitions):
    df = ties(spark)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for column, function in (("dec", "sum"), ("dec", "avg"), ("big", "max"), ("big", "min"), ("day", "min"), ("day", "max"),
                                 ("txt", "max"), ("txt", "min"), ("dec", "count"), ("x", "sum"), ("x", "avg")):
            a, b = (win.cumulative(df, column, "id", function, "k", "out", skew_safe=s) for s in (True, False))
            assert a.dtypes == b.dtypes
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), (column, function)
        for forward in (win.fill_forward, win.fill_backward):
            a, b = (forward(df, "dec", "id", "k", skew_safe=s) for s in (True, False))
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_sessions_do_not_depend_on_the_order_of_ties(spark, partitions):
    df = ties(spark).select("id", "k", "ts").where("id % 7 <> 3")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for gap in (2, 3, 6):
            a, b = (win.sessionize(df, "k", "ts", gap, "minutes", skew_safe=s) for s in (True, False))
            key = ["id", "k", "ts", "session_id"]
            assert a.dtypes == b.dtypes and sorted(map(str, a.select(key).collect())) == sorted(map(str, b.select(key).collect()))
            for out in (a, b):  # places 1..n in each session, in the order of time
                seen = {}
                for r in out.collect():
                    seen.setdefault((r.k, r.session_id), []).append((r.session_seq, r.ts))
                for x in seen.values():
                    x.sort()
                    assert [s for s, _ in x] == list(range(1, len(x) + 1)) and [t for _, t in x] == sorted(t for _, t in x)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_nulls_reach_user_code_as_none(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, None), (None, "x")], "n bigint, s string")
    got = code.python_rows(df, lambda r: {"n": r["n"], "kind": type(r["n"]).__name__}, "n bigint, kind string").collect()
    assert sorted((r.n is None, r.n, r.kind) for r in got) == [(False, big, "int"), (True, None, "NoneType")]
    got = code.map_batches(df, lambda v: [x is None for x in v], "n", "missing", "boolean").collect()
    assert sorted((r.s or "", r.n, r.missing) for r in got) == [("", big, False), ("x", None, True)]


def test_full_match_ends_at_the_end(spark):
    df = spark.createDataFrame([("123-45-6789\n",), ("123-45-6789",)], "v string")
    assert [r.v for r in quality.check_regex(df, "v", r"\d{3}-\d{2}-\d{4}").passed.collect()] == ["123-45-6789"]


def test_formats(spark):
    df = spark.createDataFrame([(7,)], "n int")
    for pattern, want in (("50% off %d", "50% off 7"), ("%i/%u", None), ("%05d%%", "00007%"), ("100%", "100%")):
        if pattern.count("%") == 2 and want is None:
            assert strings._escape_stray_percents(pattern) == "%d/%d"
        else:
            assert strings.format_string(df, "n", pattern, "s").first()["s"] == want


def test_excel_day_serials(spark):
    df = spark.createDataFrame([("45292.75",), ("bad",), (None,)], "v string")
    got = columns.cast_columns(df, [{"column": "v", "targetType": "timestamp", "format": "excel"}]).collect()
    assert [str(r.v) for r in got] == ["2024-01-01 18:00:00", "None", "None"]
    day = columns.cast_columns(df.limit(1), [{"column": "v", "targetType": "date", "format": "excel"}]).first()
    assert day.v == dt.date(2024, 1, 1)


def test_kafka_offsets(spark):
    assert readers.kafka_options("b", "t", 5, 2)["startingOffsets"] == '{"t": {"2": 5}}'
    assert readers.kafka_options("b", "t", 5, 2)["assign"] == '{"t": [2]}'
    assert readers.kafka_options("b", "t", 5)["startingOffsets"] == "earliest"
    raw = spark.createDataFrame([(p, o, BASE, b"k", b"v") for p in (0, 1) for o in range(4)],
                                "partition int, offset bigint, timestamp timestamp, key binary, value binary")
    assert sorted(r.offset for r in readers.shape_kafka(raw, None, None, 2).collect()) == [2, 2, 3, 3]
    assert readers.shape_kafka(raw, None, None, -1).count() == 0 and readers.shape_kafka(raw, 1).count() == 4


HOLED = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
PARTS = "MULTIPOLYGON(((20 20, 22 20, 22 22, 20 22)), ((30 30, 31 30, 31 31, 30 31, 30 30)))"


def test_holes_and_multipolygons(spark):
    pts = spark.createDataFrame([(1, "POINT(5 5)"), (2, "POINT(1 1)"), (3, "POINT(21 21)"), (4, "POINT(30.5 30.5)"), (5, "POINT(25 25)"), (6, None)],
                                "id int, g string")
    inside = {r.id: r["in"] for r in geo.geo_intersects(pts, "g", HOLED, "in").collect()}
    assert (inside[1], inside[2], inside[3]) == (False, True, False)
    areas = spark.createDataFrame([("holed", HOLED), ("parts", PARTS), ("none", "POINT(2 2)")], "name string, shape string")
    got = geo.join_spatial(pts, areas, "g", "shape", join_type="left")
    assert sorted((r.id, r.name or "") for r in got.collect()) == [(1, ""), (2, "holed"), (3, "parts"), (4, "parts"), (5, ""), (6, "")]
    assert geo.join_spatial(pts, areas, "g", "shape").count() == 3


def test_diff_compares_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    b = spark.createDataFrame([(None, 2), (1, 1)], "k int, v int")
    assert quality.dataset_diff({"t": a}, {"t": b}, {"t": ["k"]}).first().changed_rows == 1


def test_no_limits_on_branches_columns_and_values(spark):
    df = spark.createDataFrame([(i, f"v{i % 1500}") for i in range(1600)], "n int, v string")
    out = quality.switch(df, [f"n % 5 = {i}" for i in range(4)])
    assert len(out) == 5 and out["default"].count() == 320
    assert quality.profile_column(df, "v", top_n=1200).where("metric = 'top_value'").count() == 1200
    assert len(shape.transpose(df.limit(1100).select("n"), "n").columns) == 1101


def test_rank_filter_takes_a_direction_per_column(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 0, 3), ("b", 5, 4)], "k string, score int, id int")
    got = rows.rank_filter(df, "k", "score desc, id asc", 1)
    assert sorted((r.k, r.id) for r in got.collect()) == [("a", 1), ("b", 4)]
    assert [r.id for r in rows.top_n(df, 2, [("score", "desc")]).collect()] == [4, 1]


def test_hash_is_not_a_limit(spark):
    df = spark.range(50).withColumn("m", F.lit(1))
    assert rows.sample_rows(df, 7).count() == 7 and rows.sample_percent(df, 20).count() == 10


def test_equal_names_in_two_tables(spark):
    from lakeloom.operators import similarity

    many = spark.range(60_000).select(F.lit("Acme Limited").alias("name"))
    got = similarity.record_link(many, many, "name", "name", expand=False).collect()
    assert [(r.left_key, r.n_pairs) for r in got] == [("Acme Limited", 60_000 ** 2)]
    few = many.limit(3)
    assert similarity.record_link(few, few, "name", "name").count() == 9
    with pytest.raises(ValueError, match="every pair"):
        similarity.fuzzy_dedupe(few, "name", "jaro-winkler", 0.5)


def test_short_rows_are_padded(spark, tmp_dir):
    path = f"{tmp_dir}/short.csv"
    with open(path, "w") as f:
        f.write("a,b,c\n1,2,3\n4,5\n")
    got = readers.read_csv(spark, path, schema="a int, b int, c int", null_padding=True)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 3), (4, 5, None)]


def test_json_format_is_found(spark, tmp_dir):
    for name, text, want in (("lines", '\n{"a": 1}\n{"a": 2}\n', [1, 2]), ("array", '[\n{"a": 1}]', [1]), ("object", '{\n  "a": 3\n}', [3])):
        with open(f"{tmp_dir}/{name}.json", "w") as f:
            f.write(text)
        assert sorted(r.a for r in readers.read_json(spark, f"{tmp_dir}/{name}.json").collect()) == want


def test_rename_from_a_file(spark, tmp_dir):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    for name, text in (("m.json", '{"a": "x", "c": "z"}'), ("m.csv", "a,x\nc,z\n"), ("m.yaml", "# names\na: x\nc: 'z'\n")):
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write(text)
        assert columns.rename(df, mapping_file=f"{tmp_dir}/{name}").columns == ["b", "x", "z"]


def test_near_vectors_without_all_pairs(spark):
    import numpy as np

    from lakeloom.operators import search

    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(30, 12)), 20, axis=0) + rng.normal(0, 0.25, (600, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, e array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.triu(u @ u.T, 1)
    for t in (0.4, 0.95):
        got = {(r.i, r.j) for r in search.cosine_pairs(df, "id", "e", t).collect()}
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= t))}


def test_vectors_that_are_not_finite_hide_no_pairs(spark):
    import numpy as np

    from lakeloom.operators import search

    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 8)), 2, axis=0)  # ids 2k and 2k + 1 are copies
    x[78:80] *= 1e200  # a finite pair whose squares overflow
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(100, [float("nan")] + [1.0] * 7), (101, [float("inf")] + [1.0] * 7), (102, [float("-inf")] * 8), (103, [float("nan")] * 8),
             (104, [0.0] * 8), (105, None), (106, [None] + [1.0] * 7), (107, [])]
    df = spark.createDataFrame(rows, "id int, e array<double>").repartition(3)
    got = {(r.i, r.j) for r in search.cosine_pairs(df, "id", "e", 0.999).collect()}
    assert got == {(i, i + 1) for i in range(0, 80, 2)}
    kept = sorted(r.id for r in search.semantic_dedupe(df, "id", "e", 0.999).collect())
    assert kept == list(range(0, 80, 2)) + list(range(100, 108))
