"""Quality checks, gates, CDC / SCD on the reference's fixtures."""

import datetime as dt

import pytest

from lakeloom.operators import cdc
from lakeloom.operators import quality as qa


def test_check_schema_and_range(spark):
    df = spark.createDataFrame([(1, "alice", "a@x"), (2, None, "b@x"), (3, "carol", None)], "id int, name string, email string")
    s = qa.check_schema(df, "id, name, email")
    assert s.passed.count() == 1 and s.rejected.count() == 2
    r = spark.createDataFrame([(1, 5), (2, 50), (3, 500)], "id int, amount int")
    s2 = qa.check_range(r, "amount", 1, 10)
    assert s2.passed.count() == 1 and s2.rejected.count() == 2


def test_histogram_and_profile(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "g string")
    h = qa.histogram(df, "g").collect()
    assert [(r.value, r.frequency) for r in h] == [("a", 2), ("b", 1)]
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, grp string")
    assert qa.profile(p).count() == 2


def test_profile_column(spark):
    vals = ["alice@x.com"] * 3 + ["bob@y.com"] * 2 + ["carol@z.org", None, "not-an-email", "dave@w.io"]
    df = spark.createDataFrame([(v,) for v in vals], "email string")
    m = {(r.metric, r.value): r for r in qa.profile_column(df, "email", 3, exact_distinct=True).collect()}
    top = [k[1] for k in m if k[0] == "top_value"]
    assert "alice@x.com" in top
    email = [r for k, r in m.items() if k[0] == "pattern_email"][0]
    assert email.pct == 87.5
    assert [r for k, r in m.items() if k[0] == "null_count"][0]["count"] == 1


def test_standardize_and_mask(spark):
    df = spark.createDataFrame([("  hello   world ",)], "name string")
    assert qa.standardize(df, "name", "upper").collect()[0].name == "HELLO WORLD"
    m = spark.createDataFrame([("123456789", "a@x.com")], "ssn string, email string")
    out = qa.mask(m, [{"column": "ssn", "mode": "partial", "show_last": 4}, {"column": "email", "mode": "hash", "salt": "s"}]).collect()[0]
    assert out.ssn == "*****6789" and len(out.email) == 32


def test_classify(spark):
    df = spark.createDataFrame([("a@x.com", "123-45-6789", "hello"), ("b@y.org", "987-65-4321", "world"),
                                ("c@z.net", "111-22-3333", "again")], "email string, ssn string, note string")
    out = {r.column: (r.detected_type, r.is_pii) for r in qa.classify_columns(df).collect()}
    assert out == {"email": ("email", True), "ssn": ("ssn", True), "note": ("text", False)}


def test_expect_scorecard(spark):
    df = spark.createDataFrame([(1, "a@x.com", 5, "paid"), (2, None, -3, "pending"), (3, "bad", 10, "weird"), (1, "c@x.com", 0, "paid")],
                               "id int, email string, amt int, status string")
    rules = [{"column": "email", "check": "not_null"}, {"column": "amt", "check": "in_range", "args": {"min": 0, "max": 10}},
             {"column": "status", "check": "in_set", "args": ["paid", "pending"]}, {"column": "id", "check": "unique"},
             {"column": "email", "check": "regex", "args": ".+@.+"}]
    out = {r.expectation: (r.failed, r.pass_rate) for r in qa.expect(df, rules).collect()}
    assert out["not_null(email)"][0] == 1 and out["in_range(amt, 0, 10)"][0] == 1
    assert out["in_set(status, 2 values)"][0] == 1 and out["unique(id)"] == (2, 0.5)
    assert out["regex(email)"][0] == 1  # NULL is not a failure


def test_contract_and_gates(spark):
    clean = spark.createDataFrame([(1, "a", 5), (2, "b", 7), (3, "c", 9)], "id int, email string, amt int")
    rules = [{"column": "amt", "check": "in_range", "args": {"min": 0, "max": 10}}, {"column": "id", "check": "unique"}]
    assert qa.contract(clean, rules).count() == 3
    dirty = spark.createDataFrame([(1, "a", 5), (2, "b", 99), (2, "c", 7)], clean.schema)
    with pytest.raises(Exception, match="in_range.*unique|unique.*in_range"):
        qa.contract(dirty, rules).collect()
    with pytest.raises(Exception, match="negative"):
        qa.assert_rows(spark.createDataFrame([(1,), (-1,)], "v int"), "v >= 0", "negative value").count()
    assert qa.assert_rows(spark.createDataFrame([(1,), (None,)], "v int"), "v >= 0").count() == 2
    with pytest.raises(Exception, match="stop"):
        qa.row_count_gate(clean, "stop", "has-rows").collect()


def test_freshness(spark):
    now = dt.datetime(2024, 6, 1, 12)
    fresh = spark.createDataFrame([(1, now - dt.timedelta(hours=2)), (2, now - dt.timedelta(hours=3))], "id int, ts timestamp_ntz")
    assert qa.freshness(fresh, "ts", 24, "hours", "gate", now=now).count() == 2
    stale = spark.createDataFrame([(1, now - dt.timedelta(days=10))], "id int, ts timestamp_ntz")
    with pytest.raises(Exception, match="stale"):
        qa.freshness(stale, "ts", 24, "hours", "gate", now=now).collect()
    rep = qa.freshness(stale, "ts", 2, "days", "report", now=now).collect()[0]
    assert rep.is_fresh is False and rep.age_days == 10


def test_switch(spark):
    df = spark.createDataFrame([(1, 50), (2, 150), (3, 200), (4, 30), (5, None)], "id int, amount int")
    out = qa.switch(df, ["amount > 100", "amount <= 100"])
    assert out["case_1"].count() == 2 and out["case_2"].count() == 2 and out["default"].count() == 1


def test_schema_drift(spark):
    df = spark.createDataFrame([("1", "x"), ("b", "y")], "a string, extra string")
    out = {r.column: (r.status, r.cast_failures) for r in qa.schema_drift(df, {"a": "int64", "gone": "string"}).collect()}
    assert out == {"a": ("type_changed", 1), "gone": ("missing", None), "extra": ("added", None)}


def _cur_prev(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b2"), (3, "c")], "id int, v string")
    prev = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "id int, v string")
    return cur, prev


def test_cdc_and_scd(spark):
    cur, prev = _cur_prev(spark)
    d = {r.id: r.change_type for r in cdc.cdc_diff(cur, prev, "id", "v").collect()}
    assert d == {2: "updated", 3: "inserted", 4: "deleted"}
    s1 = {r.id: r.v for r in cdc.scd1(cur, prev, "id").collect()}
    assert s1 == {1: "a", 2: "b2", 3: "c", 4: "d"}
    assert cdc.upsert_delta(cur, prev, "id", "v").count() == 2
    s3 = {r.id: r.previous_v for r in cdc.scd3(cur, prev, "id", "v").collect()}
    assert s3 == {1: "a", 2: "b", 3: None}


def test_scd2(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b2"), (3, "c")], "id int, v string")
    t0 = dt.datetime(2024, 1, 1)
    hist = spark.createDataFrame([(1, "a", t0, None, True), (2, "b", t0, None, True)],
                                 "id int, v string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean")
    as_of = dt.datetime(2024, 6, 1)
    out = cdc.scd2(cur, hist, "id", "v", as_of=as_of).collect()
    assert len(out) == 4
    two = sorted([r for r in out if r.id == 2], key=lambda r: r.valid_from)
    assert two[0].v == "b" and two[0].is_current is False and two[0].valid_to == as_of
    assert two[1].v == "b2" and two[1].is_current is True


def test_incremental_state(spark, tmp_dir):
    state = f"{tmp_dir}/state"
    load = cdc.IncrementalLoad(spark, state, "id")
    first = load.pending(spark.createDataFrame([(1,), (2,), (3,)], "id int"))
    assert first.count() == 3
    load.commit(first)
    second = load.pending(spark.createDataFrame([(i,) for i in range(1, 6)], "id int"))
    assert second.count() == 2
    assert load.mark() == 3  # not committed yet: a failed run leaves the mark
    load.commit(second)
    assert load.mark() == 5
