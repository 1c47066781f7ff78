from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from larder.operators import cache
from larder.sources import remote

ATTEMPTS = "id long, attempt int, status int, error string, headers map<string,string>, body string"


def test_recorded_reads(spark, tmp_path):
    rows = [
        (1, 1, 200, None, {"etag": "x"}, "one"),
        (2, 1, 503, None, {}, None), (2, 2, 206, None, None, "part"),
        (3, 3, 200, None, None, "late"), (3, 1, None, "timeout", None, None), (3, 2, 429, None, None, None),
        (4, 1, 500, None, None, None), (4, 2, 500, None, None, None), (4, 3, 500, None, None, "e"), (4, 4, 200, None, None, "too late"),
        (5, 1, 404, None, None, "no"), (5, 2, 200, None, None, "never asked"),
        (6, 1, 301, "refused", None, None),
        (None, 1, 204, None, None, ""),
    ]
    path = f"file://{tmp_path}/reads"
    remote.record(spark.createDataFrame(rows, ATTEMPTS).repartition(3), path)
    found = remote.read_exchanges(spark, path, retries=2)
    outcome = cache.outcome_of(F.col("status"), F.col("error"))
    got = {r.id: tuple(r)[1:] for r in found.select("id", "attempts", "status", "error", "body", outcome, cache.kept_outcome(F.col("status"), F.col("error")), "headers").collect()}
    assert got == {
        1: (1, 200, None, "one", "ok", "ok", {"etag": "x"}),
        2: (2, 206, None, "part", "ok", "not_ok", None),
        3: (3, 200, None, "late", "ok", "ok", None),
        4: (3, 500, None, "e", "not_ok", "not_ok", None),
        5: (1, 404, None, "no", "not_ok", "not_ok", None),
        6: (1, 301, "refused", None, "rejected", "rejected", None),
        None: (1, 204, None, "", "ok", "ok", None),
    }
    assert {r.id: r.status for r in remote.read_exchanges(spark, path, retries=0).collect()}[3] is None


def test_empty_and_wrong(spark, tmp_path):
    assert remote.read_exchanges(spark, f"file://{tmp_path}/none").count() == 0
    spark.createDataFrame([(1, None), (2, [])], "id long, tries array<struct<status:int,error:string,headers:map<string,string>,body:string>>").write.parquet(f"file://{tmp_path}/none")
    assert {tuple(r) for r in remote.read_exchanges(spark, f"file://{tmp_path}/none").select("id", "attempts", "status", "error").collect()} == {(1, 0, None, None), (2, 0, None, None)}
    with pytest.raises(Exception, match="transport"):
        remote.read_exchanges(spark, f"file://{tmp_path}/none", transport="smoke").collect()


@pytest.fixture
def server():
    tries: dict[str, int] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            tries[self.path] = n = tries.get(self.path, 0) + 1
            status = 503 if self.path == "/busy" or (self.path == "/twice" and n < 3) else 404 if self.path == "/absent" else 200
            body = f"{self.path} {n}".encode()
            self.send_response(status)
            self.send_header("X-Try", str(n))
            self.send_header("X-try", "again")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def test_reads_over_http(spark, tmp_path, server):
    asked = [(1, f"{server}/a"), (2, f"{server}/twice"), (3, f"{server}/busy"), (4, f"{server}/absent"), (5, "http://127.0.0.1:1/closed"), (6, "no url"), (7, None)]
    spark.createDataFrame(asked, "id long, url string").coalesce(1).write.parquet(f"file://{tmp_path}/asked")
    found = {r.id: r for r in remote.read_exchanges(spark, f"file://{tmp_path}/asked", transport="http", retries=2, pause=0.01, timeout=5).collect()}
    assert {i: (r.attempts, r.status, r.body, r.error is None) for i, r in found.items()} == {
        1: (1, 200, "/a 1", True), 2: (3, 200, "/twice 3", True), 3: (3, 503, "/busy 3", True), 4: (1, 404, "/absent 1", True),
        5: (3, None, None, False), 6: (3, None, None, False), 7: (3, None, None, False),
    }
    assert found[2].headers["x-try"] == "3, again"
