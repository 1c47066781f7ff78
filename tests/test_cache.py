from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import cache

SCHEMA = "req_id int, method string, key string, outcome string, body string"


def clock():
    return F.floor(F.col("req_id") / 3).cast("bigint")


def run(spark, rows):
    got, other = cache.route(spark.createDataFrame(rows, SCHEMA))
    replies = cache.replay(got, ["req_id"], clock())
    return {r.req_id: r.served for r in replies.collect()}, other.count()


@pytest.mark.parametrize(
    ("before", "request_", "served", "after"),
    [
        ([], ("POST", "ok", "n"), "routed", None),
        (["c"], ("GET", "ok", "n"), "c", "n"),
        (["c"], ("GET", "not_ok", "n"), "c", "c"),
        (["c"], ("GET", "rejected", None), "c", "c"),
        ([], ("GET", "ok", "n"), "n", "n"),
        ([], ("GET", "not_ok", "n"), "n", None),
        ([], ("GET", "rejected", None), None, None),
    ],
)
def test_truth_table(spark, before, request_, served, after):
    """What is served, and what the next (rejected) request then finds stored."""
    rows = [(i, "GET", "k", "ok", b) for i, b in enumerate(before)]
    method, outcome, body = request_
    rows += [(5, method, "k", outcome, body), (9, "GET", "k", "rejected", None)]
    replies, other = run(spark, rows)
    assert (replies.get(5) if method == "GET" else "routed") == served
    assert other == (method != "GET")
    assert replies[9] == after


def simulated(rows):
    store, out = {}, {}
    for i, method, key, outcome, body in sorted(rows, key=lambda r: r[0]):
        if method != "GET":
            continue
        cached = store.get(key)
        network = cached if outcome == "rejected" else body
        out[i] = cached if cached is not None else network
        if outcome == "ok":
            store[key] = body
    return out


def test_replay_equals_sequential_run(spark):
    draw = random.Random(7)
    rows = []
    for i in range(400):
        outcome = draw.choice(["ok", "not_ok", "rejected"])
        rows.append((i, draw.choice(["GET", "GET", "GET", "POST", None]), draw.choice(["a", "a", "a", "b", "c", None]), outcome, None if outcome == "rejected" else f"b{i}"))
    assert run(spark, rows)[0] == simulated(rows)


def test_replay_hot_key_is_cut_into_periods(spark):
    rows = [(i, "GET", "hot", "ok" if i % 50 == 0 else "not_ok", f"b{i}") for i in range(300)]
    assert run(spark, rows)[0] == simulated(rows)


def test_replay_of_nothing(spark):
    assert run(spark, []) == ({}, 0)


def test_replay_keeps_extra_columns(spark):
    df = spark.createDataFrame([(1, "GET", "k", "ok", "b", "x", 3)], SCHEMA + ", cached_by string, _own int")
    got = cache.replay(df.drop("_own"), ["req_id"], clock()).collect()[0]
    assert (got.cached_by, got.served, got.hit) == ("x", "b", False)


def test_lookup_takes_the_oldest_store(spark):
    stores = spark.createDataFrame([("k", "new", 2), ("k", "old", 1), ("n", None, 1), (None, "x", 1)], "key string, body string, created_ord int")
    asked = spark.createDataFrame([(1, "k"), (2, "m"), (3, None), (4, "n")], "req_id int, key string")
    got = {r.req_id: (r.hit, r.cached) for r in cache.lookup(asked, stores).collect()}
    assert got == {1: (True, "old"), 2: (False, None), 3: (False, None), 4: (True, None)}
    assert {r.req_id for r in cache.misses(asked, stores).collect()} == {2, 3}


def test_latest(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("j", None, 1)], "key string, body string, at int")
    assert {r.key: r.body for r in cache.latest(rows, ["at"]).collect()} == {"k": "b", "j": None}


def test_latest_may_end_in_null(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", None, 2)], "key string, body string, at int")
    assert cache.latest(rows, ["at"]).collect()[0].body is None


def test_preference(spark):
    df = spark.createDataFrame([("", "n", "ok"), (None, "n", "ok"), (None, "n", "rejected"), ("c", "n", "rejected"), ("c", "n", None)], "cached string, network string, outcome string")
    got = df.select(cache.served(F.col("cached"), cache.recovered(F.col("outcome"), F.col("network"), F.col("cached"))).alias("s"), cache.admitted(F.col("outcome") == "ok").alias("a")).collect()
    assert [r.s for r in got] == ["", "n", None, "c", "c"]
    assert [r.a for r in got] == [True, True, False, False, False]


def test_tee(spark):
    got = cache.tee(spark.createDataFrame([(1, "b")], "req_id int, body string")).collect()
    assert {(r.req_id, r.body, r.target) for r in got} == {(1, "b", "client"), (1, "b", "cache")}


def test_outcomes_of_statuses(spark):
    rows = [(200, None), (299, None), (206, None), (304, None), (404, None), (None, None), (200, "reset"), (None, "reset")]
    got = spark.createDataFrame(rows, "status int, error string").select(cache.outcome_of(F.col("status"), F.col("error")).alias("o"), "status")
    got = got.select("o", cache.admitted(F.col("o") == "ok", F.col("status")).alias("a")).collect()
    assert [r.o for r in got] == ["ok", "ok", "ok", "not_ok", "not_ok", "rejected", "rejected", "rejected"]
    assert [r.a for r in got] == [True, True, False, False, False, False, False, False]


def test_variants_of_a_key(spark):
    """A stored response answers requests whose headers, of those that it names, are the same as its own request's."""
    stores = spark.createDataFrame(
        [
            (3, "a", None, None, "any"),
            (1, "a", "Accept-Language", {"ACCEPT-language": "en"}, "en"),
            (2, "a", " accept-language ,Accept-Language,", {"accept-language": "de"}, "de"),
            (2, "a", "accept-language, x", {"accept-language": "de", "X": "1"}, "de1"),
            (0, "a", "*", {"accept-language": "en"}, "never"),
            (0, "b", "x, *", None, "never"),
            (1, "c", "x", None, None),
            (1, "d", "x", {"x": ""}, "empty"),
            (0, None, None, None, "no key"),
        ],
        "created_ord int, key string, vary string, headers map<string,string>, body string",
    )
    en, de = {"Accept-Language": "en", "other": "z"}, {"accept-language": "de"}
    asked = [(1, "a", en), (2, "./a#f", de), (3, "a", None), (4, "a", de | {"x": "1"}), (5, "b", en), (6, "c", {"X": None}), (7, "c", None), (8, "d", {"x": ""}), (9, "d", None), (10, None, en), (11, "e", en)]
    found = cache.lookup_variants(spark.createDataFrame(asked, "req_id long, key string, headers map<string,string>"), stores)
    got = {r.req_id: (r.hit, r.cached) for r in found.collect()}
    assert got == {1: (True, "en"), 2: (True, "de"), 3: (True, "any"), 4: (True, "de"), 5: (False, None), 6: (False, None), 7: (True, None), 8: (True, "empty"), 9: (False, None), 10: (False, None), 11: (False, None)}


def test_names_of_vary(spark):
    rows = spark.createDataFrame([(None,), ("",), ("B, a,,A ",), ("*",), ("a,*",)], "vary string")
    assert [tuple(r) for r in rows.select(cache.vary_names(F.col("vary")), cache.storable(F.col("vary"))).collect()] == [([], True), ([], True), (["a", "b"], True), (["*"], False), (["*", "a"], False)]
