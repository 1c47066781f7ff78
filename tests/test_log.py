"""Races between writers: logs, registries of stores, loads, puts and leases."""

from __future__ import annotations

import threading

import pytest

from larder.plans.log import Files, Log
from larder.plans.store import VersionedStore


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/a b"


def at_once(*calls):
    """Run all at the same time; results or errors in their order."""
    gate, out = threading.Barrier(len(calls)), [None] * len(calls)

    def run(i, call):
        gate.wait()
        try:
            out[i] = call()
        except Exception as e:
            out[i] = e

    threads = [threading.Thread(target=run, args=x) for x in enumerate(calls)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_files(spark, root):
    files = Files(spark, root)
    assert (files.list("x"), files.read("x/y"), files.exists("x")) == ([], None, False)
    assert files.create_new("x/é", "1é") and not files.create_new("x/é", "2")
    files.replace("x/b", "3")
    files.replace("x/b", "4")
    assert (files.list("x"), files.read("x/é"), files.read("x/b")) == (["b", "é"], "1é", "4")
    files.delete("x/b")
    assert files.list("x") == ["é"]


def test_exclusive_creation_has_one_winner(spark, root):
    files = Files(spark, root)
    for i in range(5):
        got = at_once(*[lambda n=n, i=i: files.create_new(f"x/{i}", str(n)) for n in range(8)])
        assert sum(got) == 1 and files.read(f"x/{i}") == str(got.index(True))


def test_no_change_is_lost(spark, root):
    """Eight writers, more changes than files are kept."""
    files = Files(spark, root)

    def add():
        log = Log(files, "log", keep=3)
        return [log.update(lambda s: {"n": (s or {"n": 0})["n"] + 1})["n"] for _ in range(6)]

    got = at_once(*[add] * 8)
    assert sorted(n for x in got for n in x) == list(range(1, 49))
    assert Log(files, "log").state() == {"n": 48} and len(files.list("log")) <= 3 + 8


def test_a_stale_writer_does_not_win(spark, root):
    """A writer that read long ago, and whose number was cleared meanwhile, makes its change anew."""
    files, calls = Files(spark, root), []
    log = Log(files, "log", keep=2)
    log.update(lambda s: {"n": 1})

    def late(state):
        calls.append(state["n"])
        if len(calls) == 1:
            for _ in range(5):
                Log(files, "log", keep=2).update(lambda s: {"n": s["n"] + 1})
        return {"n": state["n"] + 100}

    assert log.update(late) == {"n": 106} and calls == [1, 6]
    assert log.state() == {"n": 106}


def test_ten_threads_open_ten_stores(spark, root):
    names = [f"s{i}" for i in range(10)]
    ids = at_once(*[lambda n=n: VersionedStore(spark, root).open(n) for n in names])
    first = VersionedStore(spark, root).names()
    assert sorted(first) == sorted(names) and len(set(ids)) == 10
    again = at_once(*[lambda n=n: VersionedStore(spark, root).open(n) for n in names])
    assert again == ids and VersionedStore(spark, root).names() == first


def test_one_name_opened_by_many_is_one_store(spark, root):
    ids = at_once(*[lambda: VersionedStore(spark, root).open("same")] * 8)
    assert len(set(ids)) == 1 and VersionedStore(spark, root).names() == ["same"]


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, body string")


def body(df):
    return {r.key: r.body for r in df.collect()}


def test_second_loader_of_a_name_is_refused(spark, root):
    def load(value):
        source = spark.createDataFrame([("a", True, value)], "key string, ok boolean, body string")
        VersionedStore(spark, root).load_all("v", source.select("key"), source)
        return value

    got = at_once(*[lambda v=v: load(v) for v in "1234"])
    won = [x for x in got if isinstance(x, str)]
    assert len(won) == 1 and sum("loaded before" in str(x) for x in got) == 3
    store = VersionedStore(spark, root)
    assert body(store.read("v")) == {"a": won[0]}
    store.vacuum()
    assert len(store.files.list("data")) == 1


def test_puts_at_once_are_all_there(spark, root):
    got = at_once(*[lambda i=i: VersionedStore(spark, root).put("v", rows(spark, ("all", str(i)), (f"k{i}", "x"))) for i in range(6)])
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert body(VersionedStore(spark, root).read("v")) == {"all": str(got.index(6))} | {f"k{i}": "x" for i in range(6)}


def test_a_put_while_a_store_is_compacted_stays_on_top(spark, root, monkeypatch):
    store = VersionedStore(spark, root)
    store.put("v", rows(spark, ("a", "1"), ("b", "1")))
    store.put("v", rows(spark, ("a", "2")))
    plain = store._read

    def read(state, *a):
        monkeypatch.setattr(store, "_read", plain)
        VersionedStore(spark, root).put("v", rows(spark, ("b", "3")))
        return plain(state, *a)

    monkeypatch.setattr(store, "_read", read)
    store.compact("v")
    assert body(store.read("v")) == {"a": "2", "b": "3"}
    assert len(store._state("v")["deltas"]) == 1 and len(store.files.list("data")) == 2
