"""WARC archives: one gzip member a record, written by tasks, and a splittable reader.

Reader: a task gets a byte range of a file. It looks for the gzip magic, takes a candidate for a member only if the bytes
from there inflate to a ``WARC/`` header, and reads on from member to member. It owns the records that start in its
range, reading past the range's end to finish the last. Every record is owned by exactly one range.

Writer: of records with equal payloads of ``least`` bytes or more, the one with the largest page_id is a response, the
others are revisits of it that keep the HTTP head and drop the body. Equal payloads are found by an aggregate over
digests; a payload that a third of the pages share is one aggregated row. The digests that repeat are broadcast where they
are few, so that payloads are written by the tasks that read them; beyond a checked size they are joined, and adaptive
execution splits a digest that very many pages share. Pages too small to be revisits meet no digest and are spread.

Nulls: a null html is an empty payload; a null url leaves the header out; a null page_id never wins against another, and
if all of a group are null all are responses. Repeated rows are records of their own (of equal page_ids all that share
the largest are responses). Empty payloads are
records of 0 bytes; very long ones are one record, held whole by a task. No pages give no archive and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import broadcast_if_small, saved, shared_dir
from larder.llm.files import attempt_name, open_read, open_write

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
BATCH_BYTES = 8 << 20
MOST_TASKS = 100_000


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, response: bool, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"]),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        *([] if response else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str | None = None, least: int = 1000, level: int = 4, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) as .warc.gz files; returns their path, bytes and records (a written table)."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    # The key of a small page is no digest, and its own.
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "payload").cast("string"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")).otherwise(own))
    groups = pages.select("page_id", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).where(F.octet_length("payload") >= least)
    groups = groups.groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    # Only payloads that repeat need the join's answer.
    owners = broadcast_if_small(saved(groups.where("n > 1").select("digest", "owner"), "warc-owners"))
    rows = rows.join(owners, "digest", "left").drop("digest")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, size, n = f"{folder}/{attempt_name('.warc.gz')}", 0, 0
        batches = (b for b in batches if b.num_rows)
        if (first := next(iter(batches), None)) is None:
            return
        with open_write(path) as out:
            while first is not None:
                for page_id, url, payload, owner in zip(*(first.column(c).to_pylist() for c in ("page_id", "url", "payload", "owner")), strict=True):
                    response = owner is None or owner == page_id
                    sha1 = hashlib.sha1(payload).digest()
                    member = zlib.compress(record(page_id, url, payload, sha1, response, owner, date), level, wbits=31)
                    out.write(member)
                    size, n = size + len(member), n + 1
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return saved(rows.select("page_id", "url", "payload", "owner").mapInArrow(write, "path string, bytes bigint, records bigint"), "warc-files")


class Bytes:
    """A file as one growing window of bytes from some place on."""

    def __init__(self, file, at: int) -> None:
        self.file, self.start, self.data, self.end = file, at, b"", False
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(CHUNK)
        self.data += got
        self.end = not got
        return bool(got)

    def drop(self, at: int) -> None:
        self.data, self.start = self.data[at - self.start :], at


def inflate(window: Bytes, at: int, most: int = 0) -> tuple[bytes, int] | None:
    """The member at file offset ``at`` (or its first ``most`` bytes) and the offset behind it; None if there is none."""
    z, out, i = zlib.decompressobj(31), [], at - window.start
    try:
        while True:
            piece = window.data[i:]
            i = len(window.data)
            out.append(z.decompress(piece, most))
            if most and (sum(map(len, out)) >= most or z.eof):
                return b"".join(out)[:most], at
            if z.eof:
                return b"".join(out), window.start + i - len(z.unused_data)
            if not window.more():
                return None
    except zlib.error:
        return None


def members(uri: str, start: int, end: int) -> Iterator[bytes]:
    """The inflated members that start in [start, end)."""
    with open_read(uri) as file:
        window, at, known = Bytes(file, start), start, False
        while at < end:
            if not known:  # look for the next magic from here on
                i = window.data.find(MAGIC, at - window.start)
                if i < 0:
                    at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
                    window.drop(at)
                    if not window.more():
                        return
                    continue
                at = window.start + i
                if at >= end:
                    return
                if (inflate(window, at, 5) or (b"", 0))[0] != b"WARC/":
                    at += 1
                    continue
            got = inflate(window, at)
            if got is None or not got[0].startswith(b"WARC/"):
                at, known = at + 1, False
                continue
            yield got[0]
            at, known = got[1], True
            window.drop(at)
            if not window.data and not window.more():
                return


def parse(member: bytes) -> dict:
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind = fields["WARC-Type"]
    if kind == "revisit":
        payload, digest = None, base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    else:
        length, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return {"record_id": fields["WARC-Record-ID"].strip("<>"), "target_uri": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": length, "payload_digest": digest, "refers_to": fields["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in fields else None, "payload": payload}


FIELDS = "record_id string, target_uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"


def read_warc(files: DataFrame, split_bytes: int = 16 << 20, payload: bool = True, most_tasks: int = MOST_TASKS) -> DataFrame:
    """The records of files (path, bytes); ``payload`` (null for revisits) only if asked for.

    There is a task for each range of ``split_bytes``: the number is given, as adaptive execution merges tasks by the size
    of the rows that name the ranges.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payload
    schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in names])
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"))
    tasks = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + split_bytes).alias("end")).repartitionByRange(min(tasks, most_tasks), "path", "start")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows, size = [], 0
                for member in members(r["path"], r["start"], r["end"]):
                    rows.append(parse(member))
                    size += len(member)
                    if size >= BATCH_BYTES or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pydict({c: [x[c] for x in rows] for c in names}, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict({c: [x[c] for x in rows] for c in names}, schema)

    return ranges.mapInArrow(read, FIELDS + ", payload binary" * payload)
