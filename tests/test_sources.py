from __future__ import annotations

import json

from pyspark.sql import functions as F

from larder.functions import keys
from larder.sources import descriptor, documents

# The field names of the web-app descriptor format.
APP = {
    "name": "A", "start_url": "./i.html", "scope": "./", "lang": "en",
    "icons": [{"src": "a", "sizes": "192x128", "type": "image/png"}, {"src": "b", "sizes": "any", "purpose": "maskable"}],
    "file_handlers": [
        {"action": "./open", "accept": {"application/json": [".JSON"], "application/xml": [".xml"], "text/xml": [".xml"], "text/plain": []}, "icons": [{"src": "c", "sizes": "8x8"}], "launch_type": "single-client"},
        {"action": "./many", "accept": {"text/csv": [".csv"]}, "launch_type": "multiple-clients"},
    ],
}


def apps(spark, tmp_path):
    (tmp_path / "app.json").write_text(json.dumps(APP, indent=2))
    return descriptor.read_descriptor(spark, f"file://{tmp_path}/app.json")


def test_descriptor(spark, tmp_path):
    app = apps(spark, tmp_path)
    meta = descriptor.metadata(app).collect()[0]
    assert (meta.name, meta.lang, meta.scope, meta.display) == ("A", "en", "./", None)
    assert [(r.src, r.width, r.height, r.purpose) for r in descriptor.icons(app).collect()] == [("a", 192, 128, "any"), ("b", None, None, "maskable")]
    assert [(r.src, r.width) for r in descriptor.handler_icons(app).collect()] == [("c", 8)]
    assert {(r.mime, r.ext) for r in descriptor.accepted(app).collect()} == {("application/json", ".json"), ("application/xml", ".xml"), ("text/xml", ".xml"), ("text/csv", ".csv")}
    assert descriptor.handlers(app).count() == 2


def test_routes_do_not_double(spark, tmp_path):
    app = apps(spark, tmp_path)
    files = spark.createDataFrame([(1, "x/a.json"), (1, "x/b.XML"), (1, "c.pdf"), (1, None), (2, "d.csv"), (2, "e.csv")], "launch_id int, path string")
    table = descriptor.routes(app)
    assert {(r.path, r.action) for r in descriptor.route_files(files, table).collect()} == {("x/a.json", "./open"), ("x/b.XML", "./open"), ("d.csv", "./many"), ("e.csv", "./many")}
    few, many = (sorted(map(tuple, descriptor.route_files(files, table, most=n).collect())) for n in (100, 1))
    assert few == many
    got = sorted((r.launch_id, r.files) for r in descriptor.launches(files, table).collect())
    assert got == [(1, ["x/a.json", "x/b.XML"]), (2, ["d.csv"]), (2, ["e.csv"])]


def test_opened_files_are_rows(spark, tmp_path):
    files = spark.createDataFrame([(1, "x/a.json"), (1, "x/b.XML"), (2, "d.csv"), (2, "d.csv"), (3, "c.pdf")], "launch_id int, path string")
    got = sorted(tuple(r) for r in descriptor.opened(files, descriptor.routes(apps(spark, tmp_path))).collect())
    assert got == [(1, "./open", "", "x/a.json"), (1, "./open", "", "x/b.XML"), (2, "./many", "d.csv", "d.csv"), (2, "./many", "d.csv", "d.csv")]


def test_malformed_descriptor(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{")
    assert descriptor.metadata(descriptor.read_descriptor(spark, f"file://{tmp_path}/bad.json")).collect()[0].name is None


def test_keys(spark):
    rows = [("https://h.org/a/b.HTML?x=1.js#f",), ("./i/x.tar.gz",), ("i/x",), ("http://h.org",), (None,)]
    got = spark.createDataFrame(rows, "u string").select(keys.canonical_key(F.col("u")).alias("k"), keys.extension(F.col("u")).alias("e"), keys.relative_key(F.col("u")).alias("r"), keys.host(F.col("u")).alias("h")).collect()
    assert [r.k for r in got] == ["https://h.org/a/b.HTML?x=1.js", "i/x.tar.gz", "i/x", "http://h.org", None]
    assert [r.e for r in got] == [".html", ".gz", "", "", None]
    assert [r.r for r in got][1] == "i/x.tar.gz"
    assert [r.h for r in got] == ["h.org", None, None, "h.org", None]
    scope = spark.createDataFrame([("/app/x",), ("/apple",), (None,)], "u string").select(keys.in_scope(F.col("u"), F.lit("/app/")).alias("s"))
    assert [r.s for r in scope.collect()] == [True, False, None]


def test_documents(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.json").write_text('{\n "n": 7,\n "t": "007"\n}')
    (folder / "b.xml").write_text('<doc id="1"><n>007</n></doc>')
    (folder / "c.pdf").write_text("no")
    got = documents.read_json(spark, f"file://{folder}/a.json").collect()[0]
    assert (got.n, got.t) == ("7", "007")
    got = documents.read_xml(spark, f"file://{folder}/b.xml", "doc").collect()[0]
    assert (got._id, got.n) == ("1", "007")
    table = spark.createDataFrame([(".json", "open"), (".xml", "open")], "ext string, action string")
    assert {(r.ext, r.action) for r in documents.read_documents(spark, f"file://{folder}", table).collect()} == {(".json", "open"), (".xml", "open")}
    (folder / "bad.xml").write_text("<doc><n>1</doc>")
    got = documents.read_xml(spark, f"file://{folder}/bad.xml", "doc", "n string, _corrupt_record string").collect()
    assert got[0]._corrupt_record


def relative_urls():
    base = "https://h.org/a/b/site.json?x#y"
    want = {
        "./": "https://h.org/a/b/", ".": "https://h.org/a/b/", "c": "https://h.org/a/b/c", "./c/": "https://h.org/a/b/c/", "../": "https://h.org/a/", "../../../c?q=../#f": "https://h.org/c?q=../#f",
        "/c/./d": "https://h.org/c/d", "//k.org/x": "https://k.org/x", "http://k.org/./x": "http://k.org/./x", "mailto:a": "mailto:a",
    }
    return base, want


def test_resolved(spark):
    base, want = relative_urls()
    rows = [(u, base) for u in want] + [("./", "https://h.org"), (None, base)]
    got = spark.createDataFrame(rows, "u string, b string").select("u", "b", keys.resolved(F.col("u"), F.col("b")).alias("r")).collect()
    assert {r.u: r.r for r in got if r.b == base and r.u} == want
    assert [r.r for r in got][-2:] == ["https://h.org/", None]


def test_located_descriptor_scopes_pages(spark, tmp_path):
    app = descriptor.located(apps(spark, tmp_path), F.lit("https://h.org/app/site.json")).collect()[0]
    assert (app.start_url, app.scope, app.file_handlers[0].action) == ("https://h.org/app/i.html", "https://h.org/app/", "https://h.org/app/open")
    rows = spark.createDataFrame([("https://h.org/app/x",), ("https://h.org/apple",)], "u string").select(keys.in_scope(F.col("u"), F.lit(app.scope)).alias("s"))
    assert [r.s for r in rows.collect()] == [True, False]


def test_spellings_of_a_url(spark):
    cases = {
        "icons/../a": "a", "./a": "a", "./././a#x": "a", "a/./b/": "a/b/", "../a": "../a", "a/../../b": "../b", "..": "../", ".": "", "a/..": "", "a/b/..": "a/", "../..": "../../",
        "HTTP://H.com/A?B=C#d": "http://h.com/A?B=C", "https://h.com:443": "https://h.com", "http://h.com:80/x": "http://h.com/x", "http://h.com:8080?q": "http://h.com:8080?q", "https://h.com:80/": "https://h.com:80/",
        "http://h.com/a/../../b/./c": "http://h.com/b/c", "http://h.com/..": "http://h.com/", "http://h.com/a/.": "http://h.com/a/", "/a/../b": "/b", "/..": "/", "http://U@H.com/a": "http://U@H.com/a",
        "a?x=/../y": "a?x=/../y", "a..b/.c/..d": "a..b/.c/..d", "": "", "#f": "", "?q": "?q", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.k for r in rows.select("url", keys.canonical_key(F.col("url")).alias("k")).collect()} == cases
    twice = rows.select(keys.canonical_key(F.col("url")).alias("k")).select("k", keys.canonical_key(F.col("k")).alias("again"))
    assert twice.where("NOT k <=> again").count() == 0


def test_odd_descriptors(spark, tmp_path):
    texts = ['{"file_handlers": [{"action": "a", "accept": {"x/y": ".A", "x/z": [], "x/w": [".b", null, ["c"]], "x/v": null}}, 5]}', '{"file_handlers": {"accept": {}}, "name": null}', "[1]", "{", "null", "{}"]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(t)
    apps = descriptor.read_variants(spark, f"file://{tmp_path}/*.json").select(F.regexp_extract("path", "([0-9])[.]json", 1).cast("int").alias("i"), "v")
    got = {tuple(r) for r in descriptor.members(apps).collect()}
    assert got == {(0, "file_handlers", "ARRAY", None), (1, "file_handlers", "OBJECT", "mistyped"), (1, "name", "VOID", "mistyped"), (2, None, None, "malformed"), (3, None, None, "malformed"), (4, None, None, "malformed")}
    got = sorted(map(str, map(tuple, descriptor.accepted_anyhow(apps).collect())))
    assert got == sorted(map(str, [(0, "a", "x/y", ".a", "text"), (0, "a", "x/w", ".b", None), (0, "a", "x/w", None, "mistyped"), (0, "a", "x/w", None, "mistyped"), (0, "a", "x/v", None, "mistyped"), (0, None, None, None, "mistyped")]))
