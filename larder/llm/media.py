"""Media columns: content-addressed payloads in tar shards.

``store`` keeps each distinct payload once, as a member of a tar shard named by its digest. Rows carry digest, offset and
length. ``with_metadata`` fills width, height and bit depth by reading the first bytes of a member alone; ``read_back``
reads whole members.

A text becomes an 8-bit greyscale PNG: its UTF-8 bytes, with bytes 255 up to a positive multiple of ``WIDTH``, are the
samples, row by row; PNG keeps them losslessly.

Copies: an aggregate over digests names one row, that of the smallest doc_id, as the one that stores a payload which rows
share, so each is stored once and no payload is shuffled. The digests that repeat are broadcast where they are few; beyond
a checked size they are joined. Only rows of equal doc_id and text may each store theirs, once a task at most; the index, a
written table, then names one of them for all.
Nulls: a null text is an empty text (one row of bytes 255); null and repeated ids are rows like any other. Very long
texts are one payload, held whole by the task that writes or reads it. Equal payloads are one member, whoever names it. No
rows give no shard. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import broadcast_if_small, salted, saved, shared_dir
from larder.llm.files import attempt_name, open_read, open_write

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MOST_TASKS = 100_000


def padded_length(text: Column) -> Column:
    return F.greatest(F.ceil(F.octet_length(text) / WIDTH), F.lit(1)) * WIDTH


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a non-null text with bytes 255 up to a positive multiple of WIDTH."""
    return F.rpad(text.cast("binary"), padded_length(text).cast("int"), F.lit(b"\xff"))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 26 bytes of a PNG."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def decode(data: bytes) -> np.ndarray:
    """The samples of a PNG that ``encode`` made."""
    width, height, depth = header(data)
    if depth != 8:
        raise ValueError(f"{depth} bits a sample")
    at, parts = 8, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return np.ascontiguousarray(lines[:, 1:])


def features(samples: np.ndarray) -> str:
    """Size, mean, deviation and the histogram's shares in sixteenths of the range."""
    shares = np.bincount(samples.ravel() >> 4, minlength=16) / samples.size
    return f"{samples.shape[1]}x{samples.shape[0]} {samples.mean():.4f} {samples.std():.4f} " + ",".join(f"{x:.4f}" for x in shares)


def digest_of(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, digest (binary) for each row of docs (a written table, so texts are hashed for it once)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return saved(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), padded_length(F.col("text")).cast("long").alias("payload_bytes"), digest_of(payload_of(F.col("text"))).alias("digest")), "media-digests")


def store(docs: DataFrame, folder: str | None = None, level: int = 6, keys: DataFrame | None = None) -> DataFrame:
    """digest (binary), shard, offset, length: one row for each distinct payload of docs' ``text`` (a written table).

    ``keys``: the ``digests`` of the same docs, where they are there already.
    """
    folder = folder or shared_dir(docs.sparkSession, "media")
    payload = payload_of(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", digest_of(payload).alias("digest"), payload.alias("payload"))
    keys = digests(docs) if keys is None else keys
    shared = keys.groupBy("digest").agg(F.min("doc_id").alias("_writer"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = broadcast_if_small(saved(shared, "media-shared"))
    rows = rows.join(shared, "digest", "left").where(F.col("_n").isNull() | F.col("doc_id").eqNullSafe(F.col("_writer"))).select("digest", "payload")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, met = f"{folder}/{attempt_name('.tar')}", set()
        batches = (b for b in batches if b.num_rows)
        if (batch := next(iter(batches), None)) is None:
            return
        with open_write(path) as out:
            tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT)
            while batch is not None:
                index: list[tuple[bytes, str, int, int]] = []
                for digest, content in zip(batch.column("digest").to_pylist(), batch.column("payload"), strict=True):
                    if digest in met:
                        continue
                    met.add(digest)
                    data, info = encode(content.as_py(), level), tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(data)
                    index.append((digest, path, tar.offset + tarfile.BLOCKSIZE, len(data)))  # behind the member's head
                    tar.addfile(info, io.BytesIO(data))
                if index:
                    yield pa.RecordBatch.from_pydict(dict(zip(("digest", "shard", "offset", "length"), map(list, zip(*index, strict=True)), strict=True)))
                batch = next(batches, None)
            tar.close()

    members = saved(rows.mapInArrow(write, "digest binary, shard string, offset bigint, length bigint"), "media-members")
    one = members.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("m"))
    return saved(one.select("digest", "m.shard", "m.offset", "m.length"), "media-index")


def spread(index: DataFrame, task_bytes: int = 8 << 20, run_bytes: int = 1 << 20) -> DataFrame:
    """The index dealt out for reading, about ``task_bytes`` of members to a task, in runs of neighbours in a shard.

    Runs are dealt out by hash: ranges would bring a sample of the index to the driver, the larger the more tasks there are.
    """
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // task_bytes
    return index.repartition(min(tasks, MOST_TASKS), "shard", F.floor(F.col("offset") / run_bytes)).sortWithinPartitions("shard", "offset")


class Shards:
    """The shard that is read, one open file at a time."""

    def __init__(self) -> None:
        self.name, self.file = None, None

    def at(self, shard: str):
        if shard != self.name:
            self.close()
            self.name, self.file = shard, open_read(shard)
        return self.file

    def close(self) -> None:
        if self.file:
            self.file.close()


def with_metadata(index: DataFrame) -> DataFrame:
    """Adds width, height and depth; of each member only the first 26 bytes are read."""

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards()
        for b in batches:
            got = [r | dict(zip(("width", "height", "depth"), header(shards.at(r["shard"]).read_at(26, r["offset"])), strict=True)) for r in b.to_pylist()]
            if got:
                yield pa.RecordBatch.from_pylist(got, schema=b.schema.append(pa.field("width", pa.int64())).append(pa.field("height", pa.int64())).append(pa.field("depth", pa.int64())))
        shards.close()

    return spread(index.select("digest", "shard", "offset", "length")).mapInArrow(fill, "digest binary, shard string, offset bigint, length bigint, width bigint, height bigint, depth bigint")


READ = "digest binary, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def read_back(index: DataFrame) -> DataFrame:
    """digest, and of the member read back: payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards()
        for b in batches:
            got = {x.split()[0]: [] for x in READ.split(", ")}
            for r in b.to_pylist():
                data = shards.at(r["shard"]).read_at(r["length"], r["offset"])
                samples = decode(data)
                payload = samples.tobytes()
                for c, x in zip(got, (r["digest"], hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(samples)), strict=True):
                    got[c].append(x)
            if got["digest"]:
                yield pa.RecordBatch.from_pydict(got)
        shards.close()

    return spread(index.select("digest", "shard", "offset", "length")).mapInArrow(read, READ)


def media_columns(docs: DataFrame, folder: str | None = None, level: int = 6) -> DataFrame:
    """doc_id, digest, shard, offset, length, width, height, depth: a row for each row of docs (doc_id, text)."""
    keys = digests(docs)
    return attach(docs, with_metadata(store(docs, folder, level, keys)), keys=keys)


def attach(docs: DataFrame, by_digest: DataFrame, hot: int = 1_000_000, keys: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, digest and the columns of ``by_digest`` for each row of docs.

    A payload that more than ``hot`` rows share is dealt out over several tasks. ``keys``: as for ``store``.
    """
    return salted(digests(docs) if keys is None else keys, by_digest, "digest", hot=hot)
