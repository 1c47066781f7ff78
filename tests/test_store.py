from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from larder.operators import cache
from larder.plans.store import VersionedStore, purged


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, f"file://{tmp_path}")


def source(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, ok boolean, body string")


def keys(spark, *names):
    return spark.createDataFrame([(k,) for k in names], "key string")


def entries(df):
    return {r.key: r.body for r in df.collect()}


def test_load_is_all_or_nothing(spark, store):
    store.install("v1", keys(spark, "a", "b"), source(spark, ("a", True, "1"), ("b", True, "2")), view="now")
    with pytest.raises(ValueError, match="failed"):
        store.install("v2", keys(spark, "a", "b", "c"), source(spark, ("a", True, "3"), ("b", False, "4")), view="now")
    assert store.current() == "v1"
    assert store.names() == ["v1"]
    assert entries(spark.table("now")) == {"a": "1", "b": "2"}


def test_publish_and_purge(spark, store):
    good = source(spark, ("a", True, "1"), ("b", True, "2"))
    store.install("v1", keys(spark, "a"), good, view="now")
    store.install("v2", keys(spark, "b", "b"), good, view="now")
    assert (store.current(), store.names()) == ("v2", ["v1", "v2"])
    assert [(r.store_name, r.created_ord, r.key) for r in store.all_entries().orderBy("created_ord").collect()] == [("v1", 0, "a"), ("v2", 1, "b")]
    assert store.activate("v2", view="now") == ["v1"]
    assert (store.names(), entries(spark.table("now"))) == (["v2"], {"b": "2"})


def test_namespace(spark, store):
    for name in ("app-1", "app-2", "other"):
        store.open(name)
        store.open(name)
    assert store.purge("app-2", namespace="app-") == ["app-1"]
    assert sorted(store.names()) == ["app-2", "other"]


def test_puts_overlay_the_load(spark, store):
    store.install("v1", keys(spark, "a", "b"), source(spark, ("a", True, "1"), ("b", True, "2")))
    store.put("v1", spark.createDataFrame([("a", "9"), ("c", "3")], "key string, body string"), "0001")
    assert entries(store.read("v1")) == {"a": "9", "b": "2", "c": "3"}


def test_many_puts_are_one_scan(spark, store):
    store.install("v1", keys(spark, "a"), source(spark, ("a", True, "1")))
    for i in range(12):
        store.put("v1", spark.createDataFrame([("a" if i < 7 else "b", str(i)), (f"k{i}", "x")], "key string, body string"), f"{i:04d}")
    read = store.read("v1")
    assert entries(read) == {"a": "6", "b": "11"} | {f"k{i}": "x" for i in range(12)}
    assert read._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    with pytest.raises(ValueError, match="not a store name"):
        store.put("v1", read, "x/../y")


def test_empty(store):
    assert (store.current(), store.names(), store.all_entries().count(), store.read("none").count()) == (None, [], 0, 0)
    with pytest.raises(ValueError):
        store.publish("none")
    with pytest.raises(ValueError):
        store.open("../x")


def test_purged_names(spark):
    names = spark.createDataFrame([("v1",), ("v2",), ("v3",), (None,)], "store_name string")
    assert {r[0] for r in purged(names, "v3").collect()} == {"v1", "v2", None}


def test_a_put_does_not_make_a_store_younger(spark, store):
    """Order is that of creation: the older store answers first, whenever it was written to last."""
    store.install("v1", keys(spark, "a"), source(spark, ("a", True, "1")))
    store.install("v2", keys(spark, "a", "b"), source(spark, ("a", True, "2"), ("b", True, "2")))
    store.put("v1", spark.createDataFrame([("a", "9"), ("c", "9")], "key string, body string"), "0001")
    assert store.names() == ["v1", "v2"]
    asked = spark.createDataFrame([("a",), ("b",), ("./c#x",), ("d",), (None,)], "key string")
    got = {r.key: (r.hit, r.cached) for r in cache.lookup(asked, store.all_entries()).collect()}
    assert got == {"a": (True, "9"), "b": (True, "2"), "./c#x": (True, "9"), "d": (False, None), None: (False, None)}
    store.purge("v2")
    store.install("v1", keys(spark, "a"), source(spark, ("a", True, "3")))
    assert store.names() == ["v2", "v1"]


def test_spellings_of_a_key_are_one(spark, store):
    store.install("v1", keys(spark, "./a", "a", "a#x"), source(spark, ("a#y", True, "1")))
    store.put("v1", spark.createDataFrame([("./b", "2"), ("./././a", "3")], "key string, body string"), "0001")
    assert entries(store.read("v1")) == {"a": "3", "b": "2"}
    asked = spark.createDataFrame([("./a#f",), ("b",), ("c",)], "key string")
    assert {r.key for r in cache.misses(asked, store.all_entries()).collect()} == {"c"}


def test_a_source_that_changes_is_checked_as_written(spark, store):
    """Each run of the plan gives another answer; what is published was checked."""
    tries = spark.sparkContext.accumulator(0)
    flaky = F.udf(lambda _: tries.add(1) or time.time_ns() % 2 == 0, "boolean").asNondeterministic()
    many = spark.range(4).select(F.col("id").cast("string").alias("key"))
    for i in range(3):
        try:
            store.load_all(f"v{i}", many, many.select("key", flaky("key").alias("ok"), F.lit("x").alias("body")))
            assert store.read(f"v{i}").count() == 4
        except ValueError:
            assert f"v{i}" not in store.names()
    with pytest.raises(ValueError, match="loaded before"):
        store.load_all("w", keys(spark, "a"), source(spark, ("a", True, "1")))
        store.load_all("w", keys(spark, "a"), source(spark, ("a", True, "1")))


def test_the_last_put_wins_whatever_its_name(spark, store):
    for part in ("9", "10", "1", None):
        store.put("v", spark.createDataFrame([("a", f"put{part}")], "key string, body string"), part)
    assert entries(store.read("v")) == {"a": "putNone"}
    assert store.put("v", spark.createDataFrame([("a", "again")], "key string, body string"), "10") == 2
    assert entries(store.read("v")) == {"a": "putNone"}
    assert store.put("v", spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None)], "key string, body string")) == 5
    assert entries(store.read("v")) == {"a": "y"}


def test_compaction_changes_nothing_but_files(spark, store):
    store.install("v", keys(spark, "a", "b"), source(spark, ("a", True, "1"), ("b", True, "2")))
    for i in range(5):
        store.put("v", spark.createDataFrame([("a", str(i)), (f"k{i}", None)], "key string, body string"), f"p{i}")
    store.put("v", spark.createDataFrame([], "key string, body string"))
    before = entries(store.read("v"))
    assert before == {"a": "4", "b": "2"} | {f"k{i}": None for i in range(5)}
    store.compact("v")
    assert entries(store.read("v")) == before and len(store.files.list("data")) == 1
    assert store.put("v", spark.createDataFrame([("a", "late")], "key string, body string"), "p3") == 4
    assert store.put("v", spark.createDataFrame([("a", "new")], "key string, body string"), "p9") == 7
    assert entries(store.read("v")) == before | {"a": "new"}
    store.compact("v")
    store.compact("v")
    store.compact("none")
    assert entries(store.read("v")) == before | {"a": "new"} and store.names() == ["v"]


def test_few_keys_are_read_from_their_buckets(spark, store):
    many = spark.range(2000).select(F.col("id").cast("string").alias("key"), F.lit(True).alias("ok"), F.concat(F.lit("v"), "id").alias("body"))
    store.load_all("v", many.select("key"), many)
    store.put("v", spark.createDataFrame([("7", "new")], "key string, body string"))
    found = store.read("v", keys=["./7", "8#x", "absent"])
    assert entries(found) == {"7": "new", "8": "v8"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    files = {f.rsplit("/bucket=", 1)[1].split("/")[0] for f in store.read("v").inputFiles()}
    assert len(files) == 16


def test_a_purge_leaves_what_is_being_read(spark, store):
    """A version that is read, by a snapshot or through a view, stays readable across ``activate``; then its files go."""
    good = source(spark, ("a", True, "1"), ("b", True, "2"))
    store.install("v1", keys(spark, "a"), good, view="held")
    through_view = spark.table("held")
    with store.snapshot("v1") as old:
        store.install("v2", keys(spark, "b"), good)
        assert store.activate("v2", view="held") == ["v1"]
        assert (store.names(), entries(old), entries(through_view), entries(spark.table("held"))) == (["v2"], {"a": "1"}, {"a": "1"}, {"b": "2"})
        assert len(store.files.list("data")) == 2 and store.vacuum() == []
    assert len(store.vacuum()) == 1 and len(store.files.list("data")) == 1
    assert entries(spark.table("held")) == {"b": "2"}


def test_leases_end(spark, tmp_path):
    """What a dead writer or reader held goes once its lease is over."""
    root = f"file://{tmp_path}"
    dead = VersionedStore(spark, root, lease_seconds=-1)
    dead.put("v", spark.createDataFrame([("a", "1")], "key string, body string"))
    with dead.snapshot("v") as old:
        VersionedStore(spark, root).purge("none")
        assert dead.files.list("data") == [] and old is not None
    assert dead.files.list("leases") == []


def test_a_store_made_anew_has_nothing_of_the_old(spark, store):
    store.put("v", spark.createDataFrame([("a", "1")], "key string, body string"), "p")
    assert store.purge("none") == ["v"] and store.read("v").count() == 0
    assert store.put("v", spark.createDataFrame([("b", "2")], "key string, body string"), "p") == 1
    assert entries(store.read("v")) == {"b": "2"}


def test_a_missing_key_opens_no_entries(spark, tmp_path):
    """Bases are skipped by their filters, puts by their ranges of keys; keys that are there are found in all stores."""
    store = VersionedStore(spark, f"file://{tmp_path}", filter_rows=1)
    many = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(True).alias("ok"), F.concat(F.lit("v"), "id").alias("body"))
    store.load_all("v1", many.select("key").where("key < 'k5'"), many)
    store.load_all("v2", many.select("key"), many)
    store.put("v2", spark.createDataFrame([("k1", "new"), ("k2", None)], "key string, body string"))
    store.put("v2", spark.createDataFrame([], "key string, body string"))
    absent = [f"k9{i:05d}" for i in range(40)]
    passed = sum(store.find([k]).inputFiles() != [] for k in absent)
    assert passed <= 8 and store.find(["a", None, "zz"]).inputFiles() == []
    miss = next(k for k in absent if store.find([k]).inputFiles() == [])
    plan = store.find([miss])._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and store.find([miss]).count() == 0
    found = {(r.store_name, r.created_ord, r.key, r.body) for r in store.find(["./k1", "k2#x", "k700", "k700", miss]).collect()}
    assert found == {("v1", 0, "k1", "v1"), ("v2", 1, "k1", "new"), ("v1", 0, "k2", "v2"), ("v2", 1, "k2", None), ("v2", 1, "k700", "v700")}
    assert {x.split("folder=")[1][:33] for x in store.find(["k700"]).inputFiles()} == {store._state("v2")["base"]}
    store.compact("v2")
    assert {r.body for r in store.find(["k1"]).collect()} == {"v1", "new"} and len(store.files.list("filters")) == 2
    assert store.find([miss]).inputFiles() == []
    everything = [r.key for r in many.select("key").collect()]
    assert store.find(everything).where("store_name = 'v2'").count() == 1000


def test_find_without_stores(store):
    assert store.find(["a"]).count() == 0 and store.find([]).columns == ["store_name", "created_ord", "key", "body"]
