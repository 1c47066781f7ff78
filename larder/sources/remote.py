"""The reads behind the store as a data source: what each read came to, with status, error, headers and body.

``spark.read.format("exchanges")`` reads Parquet files of reads that are due, a partition for each row group, and gives a row
for each: id, attempts, status, error, headers, body. Two kinds of files:

* ``recorded`` (the default): id and ``tries``, an array of attempts (status, error, headers, body) in their order, as
  ``record`` writes it. The reader goes through them as a client would: a failure that may pass is tried again.
* ``http``: id and url. Each is fetched with GET, ``threads`` at a time in a task, after ``pause`` seconds doubled a try.

Tried again, up to ``retries`` times, are errors (no status) and the statuses in ``RETRIED``. The last attempt's answer is the
read's. A null or empty array of tries is a read that never came back: status and error are null, attempts 0. Bodies are
text; bytes that are no UTF-8 are replaced. Header names are in lower case, repeated ones joined by a comma.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id bigint, attempts int, status int, error string, headers map<string,string>, body string"
ARROW = pa.schema([("id", pa.int64()), ("attempts", pa.int32()), ("status", pa.int32()), ("error", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string())])
#: Statuses after which a read is tried again: fixed values of HTTP.
RETRIED = frozenset({408, 425, 429, 500, 502, 503, 504})


def passing(attempt: dict) -> bool:
    """Whether a failure may pass."""
    return attempt["error"] is not None or attempt["status"] is None or attempt["status"] in RETRIED


def answered(tries: Iterable[dict], retries: int) -> tuple[int, dict]:
    """How many attempts were made, and the last."""
    made, last = 0, {"status": None, "error": None, "headers": None, "body": None}
    for attempt in tries:
        made, last = made + 1, attempt
        if made > retries or not passing(attempt):
            break
    return made, last


def fetch(url: str, timeout: float) -> dict:
    """One attempt over HTTP."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="GET"), timeout=timeout) as reply:
            return response(reply.status, reply.headers, reply.read())
    except urllib.error.HTTPError as e:
        return response(e.code, e.headers, e.read())
    except (OSError, ValueError) as e:
        return {"status": None, "error": str(e) or type(e).__name__, "headers": None, "body": None}


def response(status: int, headers, body: bytes) -> dict:
    found: dict[str, str] = {}
    for name, value in headers.items():
        found[name.lower()] = f"{found[name.lower()]}, {value}" if name.lower() in found else value
    return {"status": status, "error": None, "headers": found, "body": body.decode(errors="replace")}


def waited(attempt: Callable[[], dict], pause: float) -> Iterator[dict]:
    """Attempts without end, after pauses that double."""
    yield attempt()
    while True:
        time.sleep(pause)
        pause *= 2
        yield attempt()


class RowGroup(InputPartition):
    def __init__(self, path: str, group: int) -> None:
        super().__init__(group)
        self.path, self.group = path, group


class Exchanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exchanges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ExchangeReader(dict(self.options))


class ExchangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        get = {k.lower(): v for k, v in options.items()}.get
        self.uri, self.kind, self.retries = get("path"), get("transport", "recorded"), int(get("retries", "2"))
        self.timeout, self.pause, self.threads = float(get("timeout", "30")), float(get("pause", "0.5")), int(get("threads", "8"))
        if not self.uri or self.kind not in ("recorded", "http"):
            raise ValueError("exchanges: the option path, and a transport that is recorded or http")

    def partitions(self) -> list[RowGroup]:
        files, root = fs.FileSystem.from_uri(self.uri)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = sorted(x.path for x in found if x.is_file and x.path.endswith(".parquet"))
        return [RowGroup(p, g) for p in paths for g in range(pq.ParquetFile(files.open_input_file(p)).num_row_groups)] or [RowGroup("", 0)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = fs.FileSystem.from_uri(self.uri)
        with files.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(1000, row_groups=[partition.group]):
                rows = batch.to_pylist()
                if self.kind == "recorded":
                    done = [answered(r["tries"] or [], self.retries) for r in rows]
                else:
                    with ThreadPoolExecutor(self.threads) as pool:
                        done = list(pool.map(lambda r: answered(waited(lambda: fetch(r["url"], self.timeout), self.pause), self.retries), rows))
                out = [{"id": r["id"], "attempts": n, **{c: last[c] for c in ("status", "error", "headers", "body")}} for r, (n, last) in zip(rows, done, strict=True)]
                yield pa.RecordBatch.from_pylist(out, ARROW)


def record(attempts: DataFrame, path: str) -> None:
    """Write attempts (id, attempt, status, error, headers, body) as files of reads; an id has few."""
    of = F.sort_array(F.collect_list(F.struct("attempt", "status", "error", F.map_entries("headers").alias("headers"), "body")))
    tries = F.transform("_tries", lambda t: F.struct(t["status"].alias("status"), t["error"].alias("error"), F.map_from_entries(t["headers"]).alias("headers"), t["body"].alias("body")))
    attempts.groupBy("id").agg(of.alias("_tries")).select("id", tries.alias("tries")).write.parquet(path)


def read_exchanges(spark: SparkSession, path: str, transport: str = "recorded", retries: int = 2, **options: object) -> DataFrame:
    """A row for each read under ``path``; see the module."""
    spark.dataSource.register(Exchanges)
    return spark.read.format("exchanges").options(path=path, transport=transport, retries=str(retries), **{k: str(v) for k, v in options.items()}).load()
