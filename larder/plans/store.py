"""Versioned stores of keyed entries on Parquet, published by a pointer that is written last.

``<root>/registry`` is a log of the stores' names in the order of their creation, ``<root>/versions/<id>`` a log of what each
store consists of, ``<root>/data/folder=<id>`` a folder of entries, ``<root>/current`` the name of the published store. Logs settle
races between writers (see ``log``): two that open stores at once both get one, two loaders of a name get one load and one
error, two puts get numbers that follow each other.

A store is read as its base overlaid by its deltas: a load writes the base, each put a delta, and the store numbers them, so
the last put wins whatever it is called. ``compact`` merges them into a new base. Entries lie in ``buckets`` folders by a
hash of their key, so a lookup of few keys reads few files. Of each folder the log has the range of its keys, and a large base
has a Bloom filter (``<root>/filters``, a table of words of bits), so ``find`` opens no folder that cannot have a key. Nothing is overwritten where it is read: a folder is written
whole, then named in a log, and deleted only when no store names it and no lease holds it. Keys are kept in their canonical
form, so two spellings of a key are one entry.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row, StructType

from larder.functions.keys import canonical_key
from larder.plans.log import Files, Log


#: Hashes of a key, and bits a key, in a Bloom filter: about one key in 40 that is not there passes.
HASHES, BITS = 4, 8
#: Words in a folder of a filter's table.
CHUNK = 1 << 16


def checked(name: str) -> str:
    """The name of a store or of a batch of entries, if it is one."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ValueError(f"not a store name: {name!r}")
    return name


class VersionedStore:
    """Keys and bodies (columns key, body) under named versions."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, lease_seconds: int = 86_400, filter_rows: int = 100_000) -> None:
        """A lease ends by itself after ``lease_seconds``, so a reader or writer that died holds nothing for ever.

        Bases of ``filter_rows`` or more get a Bloom filter; smaller ones are read about as fast as a filter would be.
        """
        self.spark, self.files, self.buckets, self.lease_seconds, self.filter_rows = spark, Files(spark, root), buckets, lease_seconds, filter_rows
        self.registry = Log(self.files, "registry")
        self._views: dict[str, str] = {}

    # Names

    def open(self, name: str) -> str:
        """Create the store if it is not there; opening twice is the same as once. Returns its id, new for each creation."""
        checked(name)
        new = uuid.uuid4().hex

        def add(state: dict | None) -> dict | None:
            stores = state["stores"] if state else []
            return None if any(n == name for n, _ in stores) else {"stores": [*stores, [name, new]]}

        return dict(self.registry.update(add)["stores"])[name]

    def _stores(self) -> dict[str, str]:
        state = self.registry.state()
        return dict(state["stores"]) if state else {}

    def names(self) -> list[str]:
        """The names of all stores in the order of their creation (one entry a version: a short list by design)."""
        return list(self._stores())

    def _log(self, name: str) -> Log | None:
        there = self._stores().get(checked(name))
        return Log(self.files, f"versions/{there}") if there else None

    def _state(self, name: str) -> dict:
        log = self._log(name)
        return (log.state() if log else None) or {"base": None, "buckets": self.buckets, "deltas": [], "next": 1, "labels": {}, "schema": None, "about": {}}

    # Leases

    def _lease(self, folders: Sequence[str]) -> str:
        mark = f"leases/{uuid.uuid4().hex}"
        self.files.write(mark, json.dumps({"until": time.time() + self.lease_seconds, "folders": list(folders)}))
        return mark

    def _leased(self) -> set[str]:
        held: set[str] = set()
        for x in self.files.list("leases"):
            text = self.files.read(f"leases/{x}")
            if text:
                lease = json.loads(text)
                if lease["until"] < time.time():
                    self.files.delete(f"leases/{x}")
                else:
                    held.update(lease["folders"])
        return held

    def _held(self, name: str) -> tuple[dict, str]:
        """A store's state, and a lease of its folders taken while the store still named them."""
        while True:
            state = self._state(name)
            mark = self._lease(folders_of(state))
            if self._state(name) == state:
                return state, mark
            self.files.delete(mark)

    @contextmanager
    def snapshot(self, name: str) -> Iterator[DataFrame]:
        """The store as it is now; whatever is purged or compacted meanwhile, its files stay until the block ends."""
        state, mark = self._held(name)
        try:
            yield self._read(state)
        finally:
            self.files.delete(mark)

    def vacuum(self) -> list[str]:
        """Delete the folders that no store names and no lease holds; returns them."""
        there = [x.removeprefix("folder=") for x in self.files.list("data")]
        held = self._leased()
        named = {f for n in self.names() for f in folders_of(self._state(n))}
        gone = [f for f in there if f not in held and f not in named]
        for f in gone:
            self.files.delete(data_of(f))
            self.files.delete(f"filters/{f}")
        return gone

    # Entries

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    @contextmanager
    def _written(self, rows: DataFrame, buckets: int) -> Iterator[tuple[str, dict]]:
        """A new folder with ``rows``, leased until the block ends, and what the log has of it."""
        folder, seen = f"f{uuid.uuid4().hex}", Observation()
        mark = self._lease([folder])
        try:
            watched = rows.observe(seen, F.min("key").alias("least"), F.max("key").alias("most"), F.count("key").alias("rows"))
            watched.withColumn("bucket", self._bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(self.files.uri(data_of(folder)))
            yield folder, seen.get | {"words": 0}
        except BaseException:
            self.files.delete(data_of(folder))
            self.files.delete(f"filters/{folder}")
            raise
        finally:
            self.files.delete(mark)

    def _filter(self, folder: str, about: dict) -> dict:
        """Write a folder's Bloom filter, if it is due: a row for each word of 64 bits that has one. Returns what the log has of it."""
        if about["rows"] < self.filter_rows:
            return about
        words = max(1, -(-about["rows"] * BITS // 64))
        keys = self.spark.read.schema("key string").parquet(self.files.uri(data_of(folder)))
        at = keys.where("key IS NOT NULL").select(F.explode(hashes("key")).alias("h")).select(F.pmod("h", F.lit(64 * words)).alias("at"))
        bit = F.expr("shiftleft(1L, CAST(at % 64 AS INT))")
        found = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
        # A folder for each so many words, so a lookup reads those of its keys.
        found.withColumn("chunk", F.floor(F.col("word") / CHUNK)).repartition("chunk").write.partitionBy("chunk").parquet(self.files.uri(f"filters/{folder}"))
        return about | {"words": words}

    def _may_have(self, state: dict, asked: Sequence[Row]) -> list[str]:
        """The folders of a store that may have one of the keys asked (rows of key and h, its hashes)."""
        out = []
        for folder in folders_of(state):
            about = state["about"][folder]
            near = [r for r in asked if about["rows"] and about["least"] <= r.key <= about["most"]]
            if near and about["words"]:
                places = {r.key: [h % (64 * about["words"]) for h in r.h] for r in near}
                words = sorted({p // 64 for at in places.values() for p in at})
                table = self.spark.read.schema("word bigint, bits bigint, chunk bigint").parquet(self.files.uri(f"filters/{folder}"))
                hit = table.where(F.col("chunk").isin(sorted({w // CHUNK for w in words})) & F.col("word").isin(words))
                bits = dict(map(tuple, hit.select("word", "bits").collect()))
                near = [r for r in near if all(bits.get(p // 64, 0) >> (p % 64) & 1 for p in places[r.key])]
            if near:
                out.append(folder)
        return out

    def _asked(self, keys: Sequence[str]) -> list[Row]:
        """The canonical forms of a few keys, each once, with their hashes; null keys are none."""
        rows = self.spark.createDataFrame([(k,) for k in keys], "key string").select(canonical_key(F.col("key")).alias("key"))
        return list({r.key: r for r in rows.select("key", hashes("key").alias("h"), F.xxhash64("key").alias("at")).collect() if r.key is not None}.values())

    def load_all(self, name: str, keys: DataFrame, source: DataFrame) -> None:
        """Load every key of ``keys`` (column key) from ``source`` (key, ok, body), or nothing.

        A key that the source lacks or has not ok fails the load. What is checked is what was written, so a source that
        changes meanwhile cannot pass unchecked. Repeated keys are one; of several sources of a key the one with the
        greatest body is taken. A store is loaded once: of two loaders the second fails, however close they are.
        """
        loaded = ValueError(f"store {name} was loaded before")
        if self._state(name)["base"]:
            raise loaded
        asked = keys.select(canonical_key(F.col("key")).alias("key")).distinct()
        source = source.withColumn("key", canonical_key(F.col("key")))
        found = source.groupBy("key").agg(F.max_by(F.struct("ok", "body"), F.struct(F.coalesce("ok", F.lit(False)), "body")).alias("r"))
        rows = asked.join(found, "key", "left").select("key", F.coalesce("r.ok", F.lit(False)).alias("ok"), "r.body")
        with self._written(rows, self.buckets) as (folder, about):
            bad = self.spark.read.schema(rows.schema).parquet(self.files.uri(data_of(folder))).where(~F.col("ok")).limit(10).collect()
            if bad:
                raise ValueError(f"load of {name} failed, for example on: {[r.key for r in bad]}")

            about = self._filter(folder, about)

            def base(state: dict | None) -> dict:
                state = state or self._state_of(rows)
                if state["base"]:
                    raise loaded
                return state | {"base": folder, "about": state["about"] | {folder: about}}

            self._change(name, base)

    def _state_of(self, rows: DataFrame) -> dict:
        return {"base": None, "buckets": self.buckets, "deltas": [], "next": 1, "labels": {}, "schema": rows.select("key", "body").schema.json(), "about": {}}

    def _change(self, name: str, change) -> dict:
        return Log(self.files, f"versions/{self.open(name)}").update(change)

    def put(self, name: str, entries: DataFrame, part: str | None = None) -> int:
        """Add a batch of written-through entries (key, body) to a store; returns the number that the store gives it.

        Later puts win over earlier ones and over the load; of equal keys in a batch the greatest body is taken. A batch
        with a name, ``part``, is put once: putting it again, as a stream does after a failure, changes nothing.
        """
        part = checked(part) if part is not None else None
        before = self._state(name)
        if part is not None and part in before["labels"]:
            return before["labels"][part]
        rows = entries.groupBy(canonical_key(F.col("key")).alias("key")).agg(F.max(F.struct("body")).alias("b")).select("key", "b.body")
        with self._written(rows, before["buckets"]) as (folder, about):

            def add(state: dict | None) -> dict | None:
                state = state or self._state_of(rows)
                if part is not None and part in state["labels"]:
                    return None
                labels = state["labels"] | ({part: state["next"]} if part is not None else {})
                return state | {"deltas": [*state["deltas"], [state["next"], folder]], "next": state["next"] + 1, "labels": labels, "about": state["about"] | {folder: about}}

            state = self._change(name, add)
        number = next((n for n, f in state["deltas"] if f == folder), None)
        if number is None:
            self.files.delete(data_of(folder))
            return state["labels"][part]
        return number

    def _read(self, state: dict, asked: Sequence[Row] | None = None) -> DataFrame:
        folders = folders_of(state) if asked is None else self._may_have(state, asked)
        if not folders:
            return self.spark.createDataFrame([], "key string, body string")
        schema = StructType.fromJson(json.loads(state["schema"]))
        schema = schema.add("folder", "string").add("bucket", "integer")
        rows = self.spark.read.schema(schema).option("basePath", self.files.uri("data")).parquet(*(self.files.uri(data_of(f)) for f in folders))
        if asked is not None:
            rows = rows.where(F.col("bucket").isin(sorted({r["at"] % state["buckets"] for r in asked})) & F.col("key").isin([r.key for r in asked]))
        # One scan of all parts, however many batches were put; the folder of a row tells its number.
        numbers = {f: n for n, f in state["deltas"]} | ({state["base"]: 0} if state["base"] else {})
        at = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[F.col("folder")]
        both = rows.select("key", "body", at.alias("_at"))
        if len(numbers) == 1:
            return both.select("key", "body")
        return both.groupBy("key").agg(F.max_by(F.struct("body"), "_at").alias("b")).select("key", "b.body")

    def read(self, name: str, keys: Sequence[str] | None = None) -> DataFrame:
        """key, body of a store: the load, overlaid by the puts in their order. ``keys``: of these few keys, from their buckets alone."""
        return self._read(self._state(name), None if keys is None else self._asked(keys))

    def find(self, keys: Sequence[str]) -> DataFrame:
        """``all_entries`` of a few keys. Stores, and folders of a store, that cannot have one of them are not opened."""
        asked = self._asked(keys)
        return self._entries(self._read(self._state(n), asked) if self._may_have(self._state(n), asked) else None for n in self.names())

    def compact(self, name: str) -> None:
        """Merge a store's base and the deltas there are into a new base; deltas put meanwhile stay on top of it."""
        state, mark = self._held(name)
        try:
            log = self._log(name)
            if not state["deltas"] or not log:
                return
            last = state["deltas"][-1][0]
            with self._written(self._read(state), state["buckets"]) as (folder, about):
                about = self._filter(folder, about)

                def merged(now: dict | None) -> dict | None:
                    if not now or now["base"] != state["base"]:
                        return None  # another compaction was faster
                    deltas = [d for d in now["deltas"] if d[0] > last]
                    return now | {"base": folder, "deltas": deltas, "about": {f: now["about"][f] for _, f in deltas} | {folder: about}}

                log.update(merged)
        finally:
            self.files.delete(mark)
        self.vacuum()

    # Versions

    def _bind(self, name: str, view: str) -> None:
        """Bind a view to a store. The lease of what it was bound to ends, but files go with the next purge or vacuum only."""
        state, mark = self._held(name)
        self._read(state).createOrReplaceTempView(view)
        old, self._views[view] = self._views.get(view), mark
        if old:
            self.files.delete(old)

    def publish(self, name: str, view: str | None = None) -> None:
        """Move the pointer to a complete store; a view of that name is bound to it anew."""
        if name not in self.names():
            raise ValueError(f"no store {name}")
        self.files.replace("current", name)
        if view:
            self._bind(name, view)

    def current(self) -> str | None:
        return self.files.read("current")

    def purge(self, keep: str, namespace: str = "") -> list[str]:
        """Drop every store but ``keep`` (and those outside ``namespace``, a name prefix); returns the dropped names.

        Their names go at once, their files when no lease holds them: now, or with a later purge or ``vacuum``.
        """
        gone: dict[str, str] = {}

        def drop(state: dict | None) -> dict | None:
            gone.clear()
            gone.update({n: i for n, i in (state or {"stores": []})["stores"] if n != keep and n.startswith(namespace)})
            return {"stores": [x for x in state["stores"] if x[0] not in gone]} if gone else None

        self.registry.update(drop)
        self.vacuum()
        for there in gone.values():
            self.files.delete(f"versions/{there}")
        return list(gone)

    def install(self, name: str, keys: DataFrame, source: DataFrame, view: str | None = None) -> None:
        """Load, then cut over at once."""
        self.load_all(name, keys, source)
        self.publish(name, view)

    def activate(self, name: str, view: str | None = None) -> list[str]:
        """Purge all others, then rebind the readers. What was read through the view before is still there until the next purge."""
        gone = self.purge(name)
        if view:
            self._bind(name, view)
        return gone

    def all_entries(self) -> DataFrame:
        """store_name, created_ord, key, body over all stores, oldest first."""
        return self._entries(self.read(n) for n in self.names())

    def _entries(self, stores: Iterable[DataFrame | None]) -> DataFrame:
        """The entries of the stores in their order, those that are None left out."""
        out = None
        for i, (n, rows) in enumerate(zip(self.names(), stores, strict=True)):
            if rows is not None:
                rows = rows.select(F.lit(n).alias("store_name"), F.lit(i).alias("created_ord"), "key", "body")
                out = out.unionByName(rows) if out is not None else rows
        return out if out is not None else self.spark.createDataFrame([], "store_name string, created_ord int, key string, body string")


def hashes(key: str) -> Column:
    """The hashes of a key for a Bloom filter."""
    return F.array(*[F.xxhash64(F.lit(i), key) for i in range(HASHES)])


def data_of(folder: str) -> str:
    return f"data/folder={folder}"


def folders_of(state: dict) -> list[str]:
    """The data folders that a store consists of."""
    return [*[state["base"]] * bool(state["base"]), *(f for _, f in state["deltas"])]


def purged(names: DataFrame, keep: str, column: str = "store_name") -> DataFrame:
    """The names a purge deletes: all but ``keep``; a null name is not ``keep`` and goes."""
    return names.where(~F.col(column).eqNullSafe(F.lit(keep)))
