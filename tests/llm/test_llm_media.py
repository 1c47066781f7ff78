from __future__ import annotations

import hashlib
import tarfile
import zlib
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from larder.llm import media, queries

ROWS = [(1, "a"), (2, None), (3, ""), (4, "é" * 288), (5, "x" * 577), (6, "x" * 577), (7, "x" * 577), (None, "a"), (8, "z" * 2_000_000)]


def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "payload", "shard", "offset", "length", "media")})


def test_png_is_lossless():
    for _, text in ROWS:
        assert media.decode(media.encode(padded(text))).tobytes() == padded(text)


def test_columns(spark):
    got = media.media_columns(docs(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = dict(ROWS).get(r.doc_id)
        assert bytes(r.digest) == hashlib.sha256(padded(text)).digest()
        assert (r.width, r.height, r.depth) == (576, len(padded(text)) // 576, 8)
        with open(urlparse(r.shard).path, "rb") as f:
            f.seek(r.offset)
            assert media.decode(f.read(r.length)).tobytes() == padded(text)
        with tarfile.open(urlparse(r.shard).path) as tar:
            info = tar.getmember(f"{bytes(r.digest).hex()}.png")
            assert (info.offset_data, info.size) == (r.offset, r.length)


def test_copies_share_a_member(spark, monkeypatch):
    """One member of all shards for each payload, though all tasks have copies; also where digests are too many to broadcast."""
    rows = docs(spark, [(i, f"text {i % 3}") for i in range(300)] + [(i, f"alone {i}") for i in range(300, 320)]).repartition(5)
    for _ in range(2):
        got = media.media_columns(rows).collect()
        assert len(got) == 320 and len({(r.shard, r.offset) for r in got}) == 23
        members = []
        for shard in {urlparse(r.shard).path for r in got}:
            with tarfile.open(shard) as tar:
                members += tar.getnames()
        assert len(members) == len(set(members)) == 23
        monkeypatch.setattr(media, "broadcast_if_small", lambda table: table)


def test_a_payload_that_most_rows_share(spark):
    rows = docs(spark, [(i, "hot" if i % 3 else f"text {i}") for i in range(300)])
    index = media.with_metadata(media.store(rows))
    want, got = (sorted(map(tuple, media.attach(rows, index, hot=n).collect())) for n in (1000, 10))
    assert got == want and len(got) == 300 and len({bytes(r[0]) for r in got}) == 101


def test_no_rows(spark):
    assert media.media_columns(docs(spark, [])).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op10_media(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(ROWS)
    for r in got:
        raw = padded(dict(ROWS).get(r.doc_id))
        assert (r.n_bytes, r.payload_bytes) == (len((dict(ROWS).get(r.doc_id) or "").encode()), len(raw))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        png = media.encode(raw)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        shares = [sum(x >> 4 == i for x in raw) / len(raw) for i in range(16)] if len(raw) < 2000 else None
        size, mean, spread, histogram = r.feature.split(" ")
        middle = sum(raw) / len(raw)
        assert size == f"576x{len(raw) // 576}" and float(mean) == pytest.approx(middle, abs=1e-4)
        assert float(spread) == pytest.approx((sum((x - middle) ** 2 for x in raw) / len(raw)) ** 0.5, abs=1e-4)
        assert shares is None or [float(x) for x in histogram.split(",")] == pytest.approx(shares, abs=1e-4)
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_query_has_the_headers(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op10_media(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.width, r.height, r.depth) == (576, r.payload_bytes // 576, 8)
