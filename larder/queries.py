"""The queries of the store, replay and descriptor operators, with the same in DuckDB SQL.

No table holds requests, stores or descriptors. Stand-ins: an event is a request (purchase: not GET; click, view: ok;
signup: not ok; error: rejected; key props.k, body value), a page is a stored asset (host as store name, url as key), and
every host of the pages has a descriptor like the one below, written to files and read back.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import keys
from larder.operators import cache
from larder.plans.log import Files
from larder.plans.store import VersionedStore, purged
from larder.sources import descriptor, documents, remote
from larder.streaming.launch import launch_batches, watched
from larder.streaming.replay import replay_batches
from larder.streaming.tee import tee_batches

#: A descriptor; the field names are fixed values of the web-app descriptor format.
DESCRIPTOR = {
    "name": "Reader", "short_name": "Rd", "description": "Opens documents", "start_url": "./start.html", "scope": "../en/", "display": "standalone", "background_color": "#102030", "theme_color": "#405060", "lang": "en",
    "icons": [{"src": "i/small.png", "sizes": "192x192", "type": "image/png"}, {"src": "i/any.svg", "sizes": "any", "type": "image/svg+xml"}, {"src": "i/mask.png", "sizes": "512x256", "type": "image/png", "purpose": "maskable"}],
    "file_handlers": [{"action": "./open.html", "accept": {"text/html": [".html"], "application/xhtml+xml": [".html", ".xhtml"], "text/plain": []}, "icons": [{"src": "i/doc.png", "sizes": "64x64", "type": "image/png"}], "launch_type": "single-client"}],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see; a session in one process may name none, then a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larder-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def outcome(kind: Column) -> Column:
    return F.when(kind.isin("click", "view"), "ok").when(kind == "signup", "not_ok").when(kind == "error", "rejected")


def as_requests(events: DataFrame) -> DataFrame:
    method = F.when(F.col("event_type") == "purchase", "POST").otherwise("GET")
    return events.select(F.col("event_id").alias("req_id"), F.col("ts").cast("timestamp").alias("arrival"), method.alias("method"), F.get_json_object("props", "$.k").cast("long").alias("key"), outcome(F.col("event_type")).alias("outcome"), F.col("value").alias("body"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(table(spark, sf_dir, "events"))


def day(arrival: str = "arrival") -> Column:
    return F.unix_date(F.to_date(arrival)).cast("long")


def replay_swr(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, _ = cache.route(requests(spark, sf_dir))
    return cache.replay(asked, ["arrival", "req_id"], day()).select("req_id", "key", "cached", "hit", "served")


REQUESTS = """r AS (SELECT event_id AS req_id, ts AS arrival, CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS key, value AS body,
  CASE WHEN event_type IN ('click', 'view') THEN 'ok' WHEN event_type = 'signup' THEN 'not_ok' WHEN event_type = 'error' THEN 'rejected' END AS outcome
  FROM events)"""
REPLAY = f"""WITH {REQUESTS}, c AS (SELECT *, last_value(CASE WHEN outcome = 'ok' THEN body END IGNORE NULLS) OVER
  (PARTITION BY key ORDER BY arrival, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cached FROM r WHERE method = 'GET')
"""


READS = """b AS (SELECT req_id, key, arrival, CAST(t.n AS INTEGER) AS attempts, CAST(t.status AS INTEGER) AS status, t.error, t.outcome, t.admitted, CAST(t.status AS VARCHAR) AS header,
  CASE t.status WHEN 200 THEN v WHEN 206 THEN 'part:' || v WHEN 404 THEN 'absent' END AS body
  FROM (SELECT r.req_id, r.key, r.arrival, CAST(CAST(body AS DECIMAL(20,4)) AS VARCHAR) AS v, CASE WHEN event_type = 'view' THEN event_type || key % 2 ELSE event_type END AS kind FROM r JOIN events ON event_id = req_id)
  JOIN (VALUES ('click', 1, 200, NULL, 'ok', true), ('view0', 2, 206, NULL, 'ok', false), ('view1', 3, 503, NULL, 'not_ok', false), ('signup', 1, 404, NULL, 'not_ok', false), ('error', 3, NULL, 'timeout', 'rejected', false)) t(kind, n, status, error, outcome, admitted) USING (kind))"""


def replay_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay as a stream over the events' files, run until they are read; a key is spread over days."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    asked, _ = cache.route(as_requests(events))
    out, marks = shared_dir(spark, "replies"), shared_dir(spark, "progress")
    replay_batches(asked, out, marks, ["arrival", "req_id"], day()).awaitTermination()
    return spark.read.parquet(f"{out}/replies").select("req_id", "key", "cached", "served")


def in_files(rows: DataFrame, order: list[str], files: int, folder: str) -> int:
    """Write rows as about ``files`` files that a stream takes in ``order``; returns how many there are."""
    rows.repartitionByRange(files, *order).write.parquet(folder)
    there = Files(rows.sparkSession, folder)
    names = there.list("")
    for i, name in enumerate(names):  # a stream goes by the time of modification, which only follows the names by chance
        there.set_time(name, (int(time.time()) - len(names) + i) * 1000)
    return len(names)


def event_files(spark: SparkSession, sf_dir: str, batches: int = 6) -> DataFrame:
    """The events as a stream of about ``batches`` micro-batches, in order of time."""
    events, folder = table(spark, sf_dir, "events"), shared_dir(spark, "events")
    n = in_files(events, ["ts", "event_id"], batches, folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-n // batches)).parquet(folder)


def replay_microbatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay as a stream of several micro-batches, each on top of the state that the one before left."""
    asked, _ = cache.route(as_requests(event_files(spark, sf_dir)))
    out, marks = shared_dir(spark, "replies"), shared_dir(spark, "progress")
    replay_batches(asked, out, marks, ["arrival", "req_id"], day(), buckets=16).awaitTermination()
    return spark.read.parquet(f"{out}/replies").select("req_id", "key", "cached", "served")


def text_of(value: str) -> Column:
    return F.col(value).cast("decimal(20,4)").cast("string")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads behind GET requests, recorded attempt by attempt and read as a source.

    A click's is answered at once, a view's fails twice or more and comes in part or not at all, a signup's is not found, an
    error's gets no answer.
    """
    asked, _ = cache.route(requests(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("req_id"), "event_type"), "req_id"))
    answer = lambda status, body: F.struct(F.lit(status).cast("int").alias("status"), F.lit(None).cast("string").alias("error"), F.create_map(F.lit("x-status"), F.lit(str(status))).alias("headers"), body.cast("string").alias("body"))
    none = F.struct(F.lit(None).cast("int").alias("status"), F.lit("timeout").alias("error"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("body"))
    body, kind, busy = text_of("body"), F.col("event_type"), answer(503, F.lit(None))
    tries = F.when(kind == "click", F.array(answer(200, body))).when((kind == "view") & (F.col("key") % 2 == 0), F.array(busy, answer(206, F.concat(F.lit("part:"), body))))
    tries = tries.when(kind == "view", F.array(busy, busy, busy, answer(200, body))).when(kind == "signup", F.array(answer(404, F.lit("absent")))).otherwise(F.array(none, none, none, none))
    path = shared_dir(spark, "reads")
    remote.record(asked.select(F.col("req_id").alias("id"), F.posexplode(tries).alias("attempt", "t")).select("id", "attempt", "t.*"), path)
    return remote.read_exchanges(spark, path, retries=2)


def remote_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reads came to: attempts, the last status, the outcome that follows from it, and whether it may be stored."""
    outcome = cache.outcome_of(F.col("status"), F.col("error"))
    found = reads(spark, sf_dir).withColumn("outcome", outcome)
    return found.select(F.col("id").alias("req_id"), "attempts", "status", "error", "outcome", cache.admitted(F.col("outcome") == "ok", F.col("status")).alias("admitted"), F.col("headers")["x-status"].alias("header"), "body")


def replay_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay with outcomes that come from the statuses of the reads behind."""
    asked, _ = cache.route(requests(spark, sf_dir).drop("outcome", "body"))
    found = reads(spark, sf_dir).select(F.col("id").alias("req_id"), cache.kept_outcome(F.col("status"), F.col("error")).alias("outcome"), "body")
    return cache.replay(asked.join(found, "req_id"), ["arrival", "req_id"], day()).select("req_id", "key", "cached", "served")


def lookup_vary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by language over stored responses that depend on the language, on nothing, or on everything."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url", F.explode(F.array(F.lit("en"), F.lit("de"))).alias("lang"))
    vary = F.when(F.col("url").contains("?"), "*").when(F.col("url").contains("/en/"), "Accept-Language, accept,").otherwise(F.lit(None))
    stores = pages.select(F.when(F.col("lang") == "en", 1).otherwise(2).alias("created_ord"), "key", vary.alias("vary"), F.create_map(F.lit("ACCEPT-LANGUAGE"), "lang").alias("headers"), F.concat("lang", F.lit(":"), "url").alias("body"))
    events = table(spark, sf_dir, "events")
    language = F.when(F.col("event_type") == "click", F.create_map(F.lit("Accept-Language"), F.lit("en"), F.lit("x"), F.lit("y"))).when(F.col("event_type") == "view", F.create_map(F.lit("accept-language"), F.lit("de")))
    asked = events.select(F.col("event_id").alias("req_id"), F.get_json_object("props", "$.k").cast("long").alias("key"), language.alias("headers"))
    return cache.lookup_variants(asked, stores).select("req_id", "key", "hit", "cached")


def put_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load and twelve puts, the last of which wins whatever its name; the same after the store is compacted."""
    assets = table(spark, sf_dir, "pages").select(keys.canonical_key(F.col("url")).alias("key"), F.lit(True).alias("ok"), F.concat(F.lit("load:"), "url").alias("body"))
    store, numbers = VersionedStore(spark, shared_dir(spark, "store")), F.sequence(F.length("key") % 3 + 1, F.lit(12), F.lit(3))
    store.load_all("assets", assets.select("key"), assets)
    puts = assets.select("key", F.explode(numbers).alias("n")).select("n", "key", F.concat(F.lit("put"), F.col("n").cast("string")).alias("body"))
    for n in range(1, 13):
        store.put("assets", puts.where(F.col("n") == n), str(n))
    before = shared_dir(spark, "before")
    store.read("assets").write.parquet(before)
    store.compact("assets")
    return store.read("assets").join(spark.read.parquet(before).select("key", F.col("body").alias("before")), "key")


def tee_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of GET requests as a stream to the client and, those that are ok, to the store."""
    asked, _ = cache.route(as_requests(event_files(spark, sf_dir)))
    asked = asked.withColumns({"key": F.col("key").cast("string"), "body": text_of("body")})
    store, out = VersionedStore(spark, shared_dir(spark, "store")), shared_dir(spark, "replies")
    tee_batches(asked, out, shared_dir(spark, "progress"), store, "assets", "events", ["arrival", "req_id"], F.col("outcome") == "ok").awaitTermination()
    client = spark.read.parquet(out).select(F.lit("client").alias("target"), "req_id", "key", "body")
    return client.unionByName(store.read("assets").select(F.lit("cache").alias("target"), F.lit(None).cast("long").alias("req_id"), "key", "body"))


def gate_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches of the router."""
    get, other = cache.route(requests(spark, sf_dir))
    both = get.select("req_id", "method", F.lit("store").alias("branch")).unionByName(other.select("req_id", "method", F.lit("default").alias("branch")))
    return both


def gate_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("req_id", cache.admitted(F.col("outcome") == "ok").alias("admitted"))


def page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URL has no fragment as a store, and those whose URL has a query also in an older one: key page_id, body url."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("body"))
    new = pages.where("body NOT LIKE '%#%'").withColumn("created_ord", F.lit(2))
    old = pages.where("body LIKE '%?%'").select("key", F.concat(F.lit("old:"), "body").alias("body"), F.lit(1).alias("created_ord"))
    return new.unionByName(old)


STORES = "s AS (SELECT page_id AS key, url AS body, 2 AS ord FROM pages WHERE url NOT LIKE '%#%' UNION ALL SELECT page_id, 'old:' || url, 1 FROM pages WHERE url LIKE '%?%')"


def lookup_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.lookup(requests(spark, sf_dir).select("req_id", "key"), page_store(spark, sf_dir)).select("req_id", "key", "hit", "cached")


def lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.misses(requests(spark, sf_dir).select("req_id", "key"), page_store(spark, sf_dir))


def lookup_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages looked up by URL over two stores, the older of which is written to last: it still answers first."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("key"))
    assets = pages.select(keys.canonical_key(F.col("key")).alias("key")).distinct().select("key", F.lit(True).alias("ok"), F.concat(F.lit("v1:"), "key").alias("body"))
    store = VersionedStore(spark, shared_dir(spark, "store"))
    store.install("assets-v1", assets.where("key LIKE '%/en/%'").select("key"), assets)
    store.install("assets-v2", assets.select("key"), assets.withColumn("body", F.concat(F.lit("v2:"), "key")))
    store.put("assets-v1", assets.where("key LIKE '%?%'").withColumn("body", F.concat(F.lit("put:"), "key")), "0001")
    return cache.lookup(pages, store.all_entries()).select("page_id", "hit", "cached")


def lookup_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative keys that requests spell ``./a#f`` and the store ``a``, and the other way round."""
    path = F.substr(keys.canonical_key(F.try_parse_url("url", F.lit("PATH"))), F.lit(2))
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), (F.col("url").contains("?")).alias("dotted"))
    stored = pages.select(F.when(F.col("dotted"), F.col("path")).otherwise(F.concat(F.lit("./"), "path")).alias("key"), F.lit(1).alias("created_ord"), F.col("path").alias("body"))
    asked = pages.select("page_id", F.when(F.col("dotted"), F.concat(F.lit("./"), "path", F.lit("#f"))).otherwise(F.col("path")).alias("key"))
    return cache.lookup(asked, stored).select("page_id", "hit", "cached")


def put_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).where(cache.is_get(F.col("method")) & (F.col("outcome") == "ok"))
    return cache.latest(rows, ["arrival", "req_id"])


def tee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.tee(requests(spark, sf_dir).select("req_id", "body"))


def recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the read behind yields, with the page of the same key as the stored value."""
    rows = cache.lookup(requests(spark, sf_dir).select("req_id", "key", "outcome", F.col("body").cast("decimal(20,4)").cast("string").alias("body")), page_store(spark, sf_dir))
    network = cache.recovered(F.col("outcome"), F.col("body"), F.col("cached"))
    return rows.select("req_id", F.length(network).alias("network_len"), F.length(cache.served(F.col("cached"), network)).alias("served_len"))


def list_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(keys.host(F.col("url")).alias("store_name")).distinct()


def current_name(spark: SparkSession, sf_dir: str) -> str:
    return list_stores(spark, sf_dir).agg(F.min("store_name")).first()[0] or ""


def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list_stores(spark, sf_dir)
    return purged(names, current_name(spark, sf_dir))


def canon_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", keys.canonical_key(F.col("url")).alias("key"))


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page lies in the scope of its host's descriptor, which is relative to the descriptor's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", keys.host(F.col("url")).alias("name"))
    scopes = broadcast_if_small(apps(spark, sf_dir).select("name", "scope"))
    rows = pages.join(scopes, "name", "left").withColumn("_base", F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.lit(PLACE)))
    return rows.select("page_id", keys.in_scope(F.col("url"), keys.resolved(F.col("scope"), F.col("_base"))).alias("in_scope"))


def install_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load two versions all-or-nothing, publish the second, purge the first, and read what is left."""
    pages = table(spark, sf_dir, "pages").select(keys.canonical_key(F.col("url")).alias("key"), F.lit(True).alias("ok"), F.sha2("html", 256).alias("body"))
    store = VersionedStore(spark, shared_dir(spark, "store"))
    store.install("assets-v1", pages.where("key LIKE '%/en/%'").select("key"), pages)
    store.install("assets-v2", pages.select("key"), pages)
    store.activate("assets-v2")
    return store.all_entries().select("store_name", "key", "body")


def refused_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load with one key that its source lacks fails as a whole: the published store stays, and no other is there."""
    pages = table(spark, sf_dir, "pages").select(keys.canonical_key(F.col("url")).alias("key"), F.lit(True).alias("ok"), F.sha2("html", 256).alias("body"))
    store = VersionedStore(spark, shared_dir(spark, "store"))
    store.install("assets-v1", pages.select("key"), pages)
    try:
        store.install("assets-v2", pages.select("key").unionByName(spark.range(1).select(F.lit("absent").alias("key"))), pages)
    except ValueError:
        return store.all_entries().select(F.lit(store.current()).alias("published"), "store_name", "key", "body")
    raise AssertionError("a load without one of its keys went through")


def rebound_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a view of the first version reads once the second is published and the first purged."""
    pages = table(spark, sf_dir, "pages").select(keys.canonical_key(F.col("url")).alias("key"), F.lit(True).alias("ok"), F.sha2("html", 256).alias("body"))
    store, view = VersionedStore(spark, shared_dir(spark, "store")), f"assets_{uuid.uuid4().hex}"
    store.install("assets-v1", pages.where("key LIKE '%/en/%'").select("key"), pages, view=view)
    store.install("assets-v2", pages.select("key"), pages)
    store.activate("assets-v2", view=view)
    read = spark.table(view)
    spark.catalog.dropTempView(view)
    return read.select("key", "body")


def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as XML elements and read back: attributes and values stay text, leading zeros too."""
    path = shared_dir(spark, "documents")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("_id"), F.format_string("%012d", "page_id").alias("number"), "url")
    rows.write.format("xml").option("rootTag", "pages").option("rowTag", "page").save(path)
    return documents.read_xml(spark, path, "page", "_id string, number string, url string").withColumnRenamed("_id", "id")


#: Where a host's descriptor lies.
PLACE = "/app/site.json"


def broadcast_if_small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows of a few short columns with a broadcast hint if they are at most ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptors of all hosts, one a line, written to files and read back; those of www hosts are in German."""
    path, given = shared_dir(spark, "descriptors"), json.dumps(DESCRIPTOR)
    hosts = list_stores(spark, sf_dir).where("store_name IS NOT NULL")
    text = hosts.select(F.replace(F.replace(F.lit(given), F.lit('"Reader"'), F.concat(F.lit('"'), "store_name", F.lit('"'))), F.lit('"lang": "en"'), F.when(F.col("store_name").startswith("www."), '"lang": "de"').otherwise('"lang": "en"')))
    text.write.text(path)
    return descriptor.read_descriptor(spark, path, lines=True)


#: How some descriptors go wrong: an unknown member, mistyped ones, an extension in place of a list of them, broken JSON.
WRONG = DESCRIPTOR | {"theme": {"dark": True}, "lang": 5, "icons": "none", "file_handlers": [{"action": "./open.html", "accept": {"text/html": ".HTML", "application/xml": ["xml", 7], "text/plain": [], "text/css": {"a": 1}}}, "none", {"action": "./b.html"}]}


def odd_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, v: descriptors of all hosts written to files and read as variants; www hosts' are wrong, m hosts' malformed."""
    path, given = shared_dir(spark, "descriptors"), lambda d: F.replace(F.lit(json.dumps(d)), F.lit('"Reader"'), F.concat(F.lit('"'), "store_name", F.lit('"')))
    hosts = list_stores(spark, sf_dir).where("store_name IS NOT NULL")
    www, mobile = F.col("store_name").startswith("www."), F.col("store_name").startswith("m.")
    hosts.select(F.when(www, given(WRONG)).when(mobile, F.concat(F.lit('{"name": "'), "store_name", F.lit('", '))).otherwise(given(DESCRIPTOR))).write.text(path)
    return descriptor.read_variants(spark, path, lines=True).select(F.regexp_extract("text", '"name": "([^"]*)"', 1).alias("name"), "v")


def app_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptor.members(odd_apps(spark, sf_dir))


def app_accepts_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptor.accepted_anyhow(odd_apps(spark, sf_dir))


def app_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apps(spark, sf_dir)
    return descriptor.metadata(descriptor.located(found, F.concat(F.lit("https://"), "name", F.lit(PLACE))))


def app_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apps(spark, sf_dir)
    return descriptor.icons(found).withColumn("action", F.lit(None).cast("string")).unionByName(descriptor.handler_icons(found))


def app_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptor.accepted(apps(spark, sf_dir))


def route_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose extension a file handler opens."""
    return descriptor.route_files(table(spark, sf_dir, "pages").select("page_id", "url"), descriptor.routes(apps(spark, sf_dir)), "url").select("page_id", "ext", "action")


def launch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one host opened together, as rows: a host may have any number of pages."""
    files = table(spark, sf_dir, "pages").select("url", keys.host(F.col("url")).alias("launch_id"))
    return descriptor.opened(files, descriptor.routes(apps(spark, sf_dir)), "url")


def launch_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in a watched folder in two goes, a folder a host: the second finds some windows open."""
    accept = {"application/json": [".json"], "application/xml": [".xml"], "text/xml": [".xml"]}
    given = json.dumps(DESCRIPTOR | {"file_handlers": [{"action": "./open.html", "accept": accept, "launch_type": "single-client"}]})
    pages = table(spark, sf_dir, "pages").select("page_id", "url", keys.host(F.col("url")).alias("host")).repartition("host")
    routes = descriptor.routes(list_stores(spark, sf_dir).select(descriptor.parse_descriptor(F.lit(given)).alias("d")).select("d.*"))
    folder, out, marks = (shared_dir(spark, x) for x in ("watched", "launches", "progress"))
    for i, (rows, kind) in enumerate(((pages.where("url LIKE '%/en/%'"), "json"), (pages, "xml"))):
        writer = rows.write.partitionBy("host").format(kind)
        (writer.option("rowTag", "page") if kind == "xml" else writer).save(f"{folder}/go{i}")
        files = watched(spark, folder).select(F.regexp_extract("path", "/host=([^/]*)/", 1).alias("launch_id"), "path")
        launch_batches(files, routes, out, marks).awaitTermination()
    return spark.read.parquet(f"{out}/launches").select("launch_id", "action", "window", keys.extension(F.col("file")).alias("ext"), "fresh").distinct()


ICONS = "('i/small.png', '192x192', 192, 192, 'image/png', 'any', NULL), ('i/any.svg', 'any', NULL, NULL, 'image/svg+xml', 'any', NULL), ('i/mask.png', '512x256', 512, 256, 'image/png', 'maskable', NULL), ('i/doc.png', '64x64', 64, 64, 'image/png', 'any', './open.html')"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"

QUERIES = {
    f.__name__: f
    for f in (replay_swr, replay_streamed, replay_microbatches, replay_remote, remote_read, lookup_vary, put_order, tee_streamed, gate_method, gate_ok, lookup_hit, lookup_miss, lookup_order, lookup_spelling, put_latest, tee, recover, list_stores, purge, canon_key, scoped, install_store, refused_load, rebound_view, xml_documents, app_metadata, app_icons, app_accepts, app_members, app_accepts_odd, route_ext, launch, launch_watched)
}

SQL = {
    "replay_swr": REPLAY + "SELECT req_id, key, cached, cached IS NOT NULL AS hit, coalesce(cached, CASE WHEN outcome <> 'rejected' THEN body END) AS served FROM c",
    "replay_streamed": REPLAY + "SELECT req_id, key, cached, coalesce(cached, CASE WHEN outcome <> 'rejected' THEN body END) AS served FROM c",
    "replay_microbatches": REPLAY + "SELECT req_id, key, cached, coalesce(cached, CASE WHEN outcome <> 'rejected' THEN body END) AS served FROM c",
    "remote_read": f"WITH {REQUESTS}, {READS} SELECT req_id, attempts, status, error, outcome, admitted, header, body FROM b",
    "replay_remote": f"""WITH {REQUESTS}, {READS}, c AS (SELECT req_id, key, outcome, body, last_value(CASE WHEN admitted THEN body END IGNORE NULLS) OVER
  (PARTITION BY key ORDER BY arrival, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cached FROM b)
SELECT req_id, key, cached, coalesce(cached, CASE WHEN outcome <> 'rejected' THEN body END) AS served FROM c""",
    "lookup_vary": f"""WITH {REQUESTS}, l AS (SELECT event_id AS req_id, CASE event_type WHEN 'click' THEN 'en:' WHEN 'view' THEN 'de:' END AS lang FROM events),
  f AS (SELECT r.req_id, key, CASE WHEN url LIKE '%?%' THEN NULL WHEN url LIKE '%/en/%' THEN lang || url ELSE 'en:' || url END AS cached FROM r JOIN l USING (req_id) LEFT JOIN pages ON page_id = key)
SELECT req_id, key, cached IS NOT NULL AS hit, cached FROM f""",
    "put_order": "SELECT key, body, body AS before FROM (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS key, 'put' || (CASE length(key) % 3 WHEN 0 THEN 10 WHEN 1 THEN 11 ELSE 12 END) AS body FROM pages)",
    "tee_streamed": f"""WITH {REQUESTS}, t AS (SELECT req_id, arrival, outcome, CAST(key AS VARCHAR) AS key, CAST(CAST(body AS DECIMAL(20,4)) AS VARCHAR) AS body FROM r WHERE method = 'GET')
SELECT 'client' AS target, req_id, key, body FROM t UNION ALL SELECT 'cache', NULL, key, arg_max(body, (arrival, req_id)) FROM t WHERE outcome = 'ok' GROUP BY key""",
    "gate_method": f"WITH {REQUESTS} SELECT req_id, method, CASE WHEN method = 'GET' THEN 'store' ELSE 'default' END AS branch FROM r",
    "gate_ok": f"WITH {REQUESTS} SELECT req_id, coalesce(outcome = 'ok', false) AS admitted FROM r",
    "lookup_hit": f"WITH {REQUESTS}, {STORES}, f AS (SELECT key, arg_min(body, ord) AS body FROM s GROUP BY key) SELECT req_id, r.key, f.key IS NOT NULL AS hit, f.body AS cached FROM r LEFT JOIN f ON r.key = f.key",
    "lookup_miss": f"WITH {REQUESTS}, {STORES} SELECT key, req_id FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.key = r.key)",
    "lookup_order": "WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS key FROM pages) SELECT page_id, true AS hit, CASE WHEN key LIKE '%?%' THEN 'put:' WHEN key LIKE '%/en/%' THEN 'v1:' ELSE 'v2:' END || key AS cached FROM p",
    "lookup_spelling": f"SELECT page_id, true AS hit, substr({PATH}, 2) AS cached FROM pages",
    "put_latest": f"WITH {REQUESTS} SELECT key, arg_max(body, (arrival, req_id)) AS body FROM r WHERE outcome = 'ok' GROUP BY key",
    "tee": f"WITH {REQUESTS} SELECT req_id, body, target FROM r, (VALUES ('client'), ('cache')) t(target)",
    "recover": f"WITH {REQUESTS}, {STORES}, f AS (SELECT key, arg_min(body, ord) AS body FROM s GROUP BY key), j AS (SELECT req_id, f.body AS cached, CASE WHEN outcome = 'rejected' THEN f.body ELSE CAST(CAST(r.body AS DECIMAL(20,4)) AS VARCHAR) END AS network FROM r LEFT JOIN f ON r.key = f.key) SELECT req_id, CAST(length(network) AS INTEGER) AS network_len, CAST(length(coalesce(cached, network)) AS INTEGER) AS served_len FROM j",
    "list_stores": f"SELECT DISTINCT {HOST} AS store_name FROM pages",
    "purge": f"WITH n AS (SELECT DISTINCT {HOST} AS store_name FROM pages) SELECT store_name FROM n WHERE store_name IS DISTINCT FROM (SELECT min(store_name) FROM n)",
    "canon_key": "SELECT page_id, regexp_replace(url, '#.*$', '') AS key FROM pages",
    "scoped": f"SELECT page_id, starts_with({PATH}, '/en/') AS in_scope FROM pages",
    "install_store": "SELECT 'assets-v2' AS store_name, regexp_replace(url, '#.*$', '') AS key, max(sha256(html)) AS body FROM pages GROUP BY ALL",
    "refused_load": "SELECT 'assets-v1' AS published, 'assets-v1' AS store_name, regexp_replace(url, '#.*$', '') AS key, max(sha256(html)) AS body FROM pages GROUP BY ALL",
    "rebound_view": "SELECT regexp_replace(url, '#.*$', '') AS key, max(sha256(html)) AS body FROM pages GROUP BY ALL",
    "xml_documents": "SELECT CAST(page_id AS VARCHAR) AS id, printf('%012d', page_id) AS number, url FROM pages",
    "app_metadata": f"SELECT host AS name, 'Rd' AS short_name, 'Opens documents' AS description, CASE WHEN starts_with(host, 'www.') THEN 'de' ELSE 'en' END AS lang, 'https://' || host || '/app/start.html' AS start_url, 'https://' || host || '/en/' AS scope, 'standalone' AS display, '#102030' AS background_color, '#405060' AS theme_color FROM (SELECT DISTINCT {HOST} AS host FROM pages)",
    "app_icons": f"SELECT host AS name, src, sizes, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, type, purpose, CAST(action AS VARCHAR) AS action FROM (SELECT DISTINCT {HOST} AS host FROM pages), (VALUES {ICONS}) t(src, sizes, width, height, type, purpose, action)",
    "app_accepts": f"SELECT host AS name, './open.html' AS action, 'single-client' AS launch_type, mime, ext FROM (SELECT DISTINCT {HOST} AS host FROM pages), (VALUES ('text/html', '.html'), ('application/xhtml+xml', '.html'), ('application/xhtml+xml', '.xhtml')) t(mime, ext)",
    "app_members": f"""WITH h AS (SELECT DISTINCT {HOST} AS host FROM pages), m(member, kind, wrong) AS (VALUES {", ".join(f"('{c}', '{k}', '{ {'lang': 'BIGINT', 'icons': 'STRING'}.get(c, k)}')" for c, k in descriptor.KINDS.items())}, ('theme', NULL, 'OBJECT'))
SELECT host AS name, member, CASE WHEN starts_with(host, 'www.') THEN wrong ELSE kind END AS kind, CASE WHEN kind IS NULL THEN 'unknown' WHEN starts_with(host, 'www.') AND wrong <> kind THEN 'mistyped' END AS reason
FROM h, m WHERE NOT starts_with(host, 'm.') AND (kind IS NOT NULL OR starts_with(host, 'www.')) UNION ALL SELECT host, NULL, NULL, 'malformed' FROM h WHERE starts_with(host, 'm.')""",
    "app_accepts_odd": f"""WITH h AS (SELECT DISTINCT {HOST} AS host FROM pages)
SELECT host AS name, action, mime, ext, reason FROM h, (VALUES (false, './open.html', 'text/html', '.html', NULL), (false, './open.html', 'application/xhtml+xml', '.html', NULL), (false, './open.html', 'application/xhtml+xml', '.xhtml', NULL),
  (true, './open.html', 'text/html', '.html', 'text'), (true, './open.html', 'application/xml', 'xml', 'no extension'), (true, './open.html', 'application/xml', NULL, 'mistyped'), (true, './open.html', 'text/css', NULL, 'mistyped'), (true, NULL, NULL, NULL, 'mistyped'), (true, './b.html', NULL, NULL, 'mistyped')) t(wrong, action, mime, ext, reason)
WHERE NOT starts_with(host, 'm.') AND wrong = starts_with(host, 'www.')""",
    "route_ext": f"SELECT page_id, '.html' AS ext, './open.html' AS action FROM pages WHERE lower({PATH}) LIKE '%.html'",
    "launch_watched": f"""WITH h AS (SELECT {HOST} AS host, bool_or(url LIKE '%/en/%') AS first FROM pages GROUP BY ALL)
SELECT host AS launch_id, './open.html' AS action, '' AS window, '.json' AS ext, true AS fresh FROM h WHERE first UNION ALL SELECT host, './open.html', '', '.xml', NOT first FROM h""",
    "launch": f"SELECT {HOST} AS launch_id, './open.html' AS action, '' AS window, url AS file FROM pages WHERE lower({PATH}) LIKE '%.html'",
}
