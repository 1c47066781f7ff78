"""Requests against a keyed store that is served first and refreshed behind.

Requests have a method and a key, an order of arrival and the outcome of the read behind the store: ``ok``, ``not_ok`` or
``rejected``. Only GET takes part; only ok outcomes are stored; a stored value is served, else the read's answer, and a
rejected read without a stored value is an absent reply. A store write counts from the next request of its key on: the
replay assumes that it is finished by then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.keys import canonical_key


def is_get(method: Column) -> Column:
    """True for GET; a null method is not GET."""
    return F.coalesce(method == "GET", F.lit(False))


def route(requests: DataFrame, method: str = "method") -> tuple[DataFrame, DataFrame]:
    """The requests that the store answers and the others, which keep their default handling."""
    return requests.where(is_get(F.col(method))), requests.where(~is_get(F.col(method)))


def outcome_of(status: Column, error: Column) -> Column:
    """The outcome of a read: ``rejected`` after an error or without a status, ``ok`` for 200 to 299, else ``not_ok``."""
    return F.when(error.isNotNull() | status.isNull(), "rejected").when(status.between(200, 299), "ok").otherwise("not_ok")


def kept_outcome(status: Column, error: Column) -> Column:
    """The outcome of a read as ``replay`` takes it: a partial response (206) is answered but not stored, as one that is not ok."""
    outcome = outcome_of(status, error)
    return F.when((outcome == "ok") & ~admitted(F.lit(True), status), "not_ok").otherwise(outcome)


def admitted(ok: Column, status: Column | None = None) -> Column:
    """Whether a response may be stored: present, ok and, where the status is given, not partial (206)."""
    may = F.coalesce(ok, F.lit(False))
    return may if status is None else may & ~F.coalesce(status == 206, F.lit(False))


def joinable(rows: DataFrame, key: str, spread: bool) -> DataFrame:
    """Adds _k, the canonical form of a text key (others are as they are), and _s, by which rows without a key are spread."""
    k = canonical_key(F.col(key)) if rows.schema[key].dataType.typeName() == "string" else F.col(key)
    salt = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1000))).otherwise(0) if spread else F.lit(0)
    return rows.withColumns({"_k": k, "_s": salt.cast("bigint")})


def lookup(requests: DataFrame, stores: DataFrame, key: str = "key") -> DataFrame:
    """Left join of the first match: the oldest store (least created_ord) that has the key. Adds hit and cached.

    ``stores`` has created_ord, the key and body. Text keys match in their canonical form: without fragment and leading
    ``./``. A null key matches nothing. The aggregate has one row a key, so a key that many requests share is a hot key of
    the requests alone, which adaptive execution may split.
    """
    first = joinable(stores.where(F.col(key).isNotNull()), key, False).groupBy("_k", "_s").agg(F.min_by(F.struct("body"), "created_ord").alias("_m"))
    found = joinable(requests, key, True).join(first, ["_k", "_s"], "left")
    return found.select(*requests.columns, F.col("_m").isNotNull().alias("hit"), F.col("_m.body").alias("cached"))


def vary_names(vary: Column) -> Column:
    """The request headers that a response says it depends on: lower-cased, sorted, each once; none for null."""
    names = F.transform(F.split(F.lower(F.coalesce(vary, F.lit(""))), ","), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def storable(vary: Column) -> Column:
    """Whether a response can be found again: one that depends on ``*`` matches no request."""
    return ~F.array_contains(vary_names(vary), "*")


def variant(headers: Column, names: Column) -> Column:
    """What a request's headers (a map, names in any case) hold of ``names``, as one text; a header may be absent or empty."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))

    def one(name: Column) -> Column:
        own = F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == name), lambda e: F.coalesce(e["value"], F.lit("")))
        text = F.array_join(F.array_sort(own), ", ")
        return F.when(F.size(own) == 0, "-").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    return F.array_join(F.transform(names, one), "")


def lookup_variants(requests: DataFrame, stores: DataFrame, key: str = "key", row: str = "req_id") -> DataFrame:
    """``lookup`` among responses that depend on request headers: adds hit and cached.

    ``requests`` has a unique ``row``, the key and headers (a map); ``stores`` created_ord, the key, vary (the response's
    header of that name), headers (those of the request that was answered) and body. A stored response matches if all
    headers that it names are the same in both requests; of several the oldest store's, then the first by vary, answers.
    Requests meet the different sets of names of their key, then one response for each; both tables have a key once.
    """
    usable = stores.where(F.col(key).isNotNull() & storable(F.col("vary"))).withColumn("_names", vary_names(F.col("vary")))
    usable = joinable(usable, key, False).withColumn("_variant", variant(F.col("headers"), F.col("_names")))
    sets = usable.groupBy("_k", "_s").agg(F.collect_set("_names").alias("_sets"))
    first = usable.groupBy("_k", "_s", "_names", "_variant").agg(F.min_by(F.struct("body"), "created_ord").alias("_m"), F.min("created_ord").alias("_ord"))
    asked = joinable(requests, key, True).select(row, "_k", "_s", "headers").join(sets, ["_k", "_s"]).withColumn("_names", F.explode("_sets"))
    asked = asked.select(row, "_k", "_s", "_names", variant(F.col("headers"), F.col("_names")).alias("_variant"))
    found = asked.join(first, ["_k", "_s", "_names", "_variant"]).groupBy(row).agg(F.min_by("_m", F.struct("_ord", "_names")).alias("_m"))
    return requests.join(found, row, "left").select(*requests.columns, F.col("_m").isNotNull().alias("hit"), F.col("_m.body").alias("cached"))


def misses(requests: DataFrame, stores: DataFrame, key: str = "key") -> DataFrame:
    """The requests whose key, in its canonical form, no store has."""
    have = joinable(stores, key, False).select("_k", "_s").distinct()
    return joinable(requests, key, True).join(have, ["_k", "_s"], "left_anti").select(*requests.columns)


def latest(responses: DataFrame, order: Sequence[str], key: str = "key", body: str = "body") -> DataFrame:
    """The last body of each key: an upsert, as a partial and a final aggregate."""
    return responses.groupBy(key).agg(F.max_by(F.struct(body), F.struct(*order)).alias("_l")).select(key, F.col(f"_l.{body}").alias(body))


def tee(responses: DataFrame) -> DataFrame:
    """Each response twice: for the client and for the store (column ``target``)."""
    return responses.withColumn("target", F.explode(F.array(F.lit("client"), F.lit("cache"))))


def recovered(outcome: Column, network: Column, cached: Column) -> Column:
    """What the read behind yields: its body whatever its status, after a rejection the stored value."""
    return F.when(outcome == "rejected", cached).otherwise(network)


def served(cached: Column, network: Column) -> Column:
    """The stored value if there is one (an empty one counts), else the other."""
    return F.coalesce(cached, network)


def replay(requests: DataFrame, order: Sequence[str], clock: Column, key: str = "key", outcome: str = "outcome", body: str = "body", before: DataFrame | None = None) -> DataFrame:
    """The reply to each GET request: adds cached, hit and served. A null body stores nothing.

    ``before`` (the key, once each, and body) is what was stored before all requests; it counts as one more period of its
    key, so it meets summaries of periods, never the requests themselves.

    ``order`` must be unique within a key, or replies among equals are arbitrary; nulls come first. ``clock``, a bigint
    that does not decrease along ``order``, cuts a key's requests into periods. What a key's earlier periods stored comes
    from one summary row a period, so a key with a third of all requests is spread over its periods, not held by a task.
    """
    rows = requests.withColumns({"_stored": F.when(F.col(outcome) == "ok", F.col(body)), "_period": F.coalesce(clock, F.lit(-(1 << 62)))})
    # A null key is a key like any other.
    rows = rows.withColumn("_key", F.struct(F.col(key)))
    at = [F.col(c).asc_nulls_first() for c in order]
    within = Window.partitionBy("_key", "_period").orderBy(*at)
    rows = rows.withColumn("_own", F.last("_stored", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)))

    ends = requests.select(F.struct(F.col(key)).alias("_key"), F.coalesce(clock, F.lit(-(1 << 62))).alias("_period"), F.when((F.col(outcome) == "ok") & F.col(body).isNotNull(), F.struct(F.struct(*order).alias("o"), F.col(body).alias("b"))).alias("e"))
    ends = ends.groupBy("_key", "_period").agg(F.max("e").alias("e"))
    if before is not None:
        state = F.struct(F.lit(None).cast(ends.schema["e"].dataType["o"].dataType).alias("o"), F.col(body).alias("b"))
        ends = ends.unionByName(before.select(F.struct(F.col(key)).alias("_key"), F.lit(-(1 << 63)).alias("_period"), state.alias("e")))
    earlier = Window.partitionBy("_key").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_earlier", F.last("e.b", ignorenulls=True).over(earlier)).where("_earlier IS NOT NULL").select("_key", "_period", "_earlier")

    cached = F.coalesce("_own", "_earlier")
    out = rows.join(ends, ["_key", "_period"], "left").withColumn("cached", cached)
    answer = served(F.col("cached"), recovered(F.col(outcome), F.col(body), F.col("cached")))
    return out.select(*requests.columns, "cached", F.col("cached").isNotNull().alias("hit"), answer.alias("served"))
