from __future__ import annotations

import gzip
import random
from urllib.parse import urlparse

from pyspark.sql import functions as F

from larder.llm import warc

PAGES = "page_id long, url string, html string"


def cycle(spark, rows, split=16 << 20, **how):
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("clash") for c in ("payload", "digest", "owner", "n", "path")})
    files = warc.write_warc(pages, **how)
    got = warc.read_warc(files, split_bytes=split, most_tasks=8).collect()
    return files, sorted(((r.record_id, r.target_uri, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in got), key=str)


def test_round_trip_at_any_split(spark):
    draw = random.Random(5)
    noise = lambda n: "".join(chr(draw.randrange(1, 0x800)) for _ in range(n))
    rows = [(i, f"http://h/{i}?é x", noise(draw.choice([0, 10, 5000]))) for i in range(60)]
    _, whole = cycle(spark, rows)
    assert {r[0]: r[6].decode() for r in whole} == {f"urn:page:{i}": h for i, _, h in rows}
    for split in (1, 97, 4096):
        if split > 1:
            assert cycle(spark, rows, split)[1] == whole
    files = warc.write_warc(spark.createDataFrame(rows[:3], PAGES).coalesce(1))
    assert warc.read_warc(files, split_bytes=1, most_tasks=8).count() == 3


def test_revisits(spark):
    big, edge, small = "é" * 600, "x" * 1000, "x" * 999
    rows = [(1, "u1", big), (7, "u7", big), (3, None, big), (None, "n", big), (4, "u", edge), (5, "u", edge), (8, "u", small), (9, "u", small)]
    _, got = cycle(spark, rows)
    kinds = {r[0]: (r[2], r[5], r[3]) for r in got}
    assert kinds["urn:page:7"] == ("response", None, 1200)
    assert kinds["urn:page:1"] == kinds["urn:page:3"] == kinds["urn:page:"] == ("revisit", "urn:page:7", 1200)
    assert kinds["urn:page:4"] == ("revisit", "urn:page:5", 1000)
    assert kinds["urn:page:8"] == kinds["urn:page:9"] == ("response", None, 999)
    assert len({r[4] for r in got if r[3] == 1200}) == 1


def test_hostile_rows(spark):
    rows = [(1, None, None), (2, "u\r\nX: y", ""), (2, "u\r\nX: y", ""), (3, "u", "\x1f\x8b\x08WARC/1.0\r\n\r\n"), (4, "u", "y" * 3_000_000)]
    _, got = cycle(spark, rows, split=1000)
    assert len(got) == 5
    assert {r[0]: r[3] for r in got} == {"urn:page:1": 0, "urn:page:2": 0, "urn:page:3": 16, "urn:page:4": 3_000_000}
    assert all(r[1] is None or "\n" not in r[1] for r in got)
    assert cycle(spark, [])[1] == []


def test_files_are_gzip_members(spark):
    files, _ = cycle(spark, [(1, "u", "a"), (2, "u", "b")])
    for r in files.collect():
        with open(urlparse(r.path).path, "rb") as f:
            assert gzip.decompress(f.read()).count(b"WARC/1.1\r\n") == r.records


def test_false_magic_is_not_a_member(tmp_path):
    path = tmp_path / "x.warc.gz"
    member = gzip.compress(warc.record(1, "u", b"p", bytes(20), True, None, "2000-01-01T00:00:00Z"))
    path.write_bytes(b"\x1f\x8b\x08junk" + gzip.compress(b"not a record") + member + b"\x1f\x8b\x08" + member)
    assert [m[:5] for m in warc.members(str(path), 0, 10_000)] == [b"WARC/"] * 2


def test_the_reader_has_a_task_for_each_range(spark):
    """Ranges are tiny rows, which adaptive execution must not merge into one task."""
    draw = random.Random(6)
    rows = [(i, "u", "".join(chr(draw.randrange(33, 127)) for _ in range(4000))) for i in range(200)]
    files = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3))
    split = 40_000
    ranges = sum(-(-r.bytes // split) for r in files.collect())
    got = warc.read_warc(files, split_bytes=split).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in got) == 200
    assert ranges >= 12 and len(got) >= ranges - 3


def test_revisits_where_the_digests_are_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, "u", "x" * 1500 if i % 3 else f"{i % 10}" * 999 + "é") for i in range(300)] + [(i, "u", "small") for i in range(300, 500)]
    _, want = cycle(spark, rows)
    monkeypatch.setattr(warc, "broadcast_if_small", lambda table: table)
    assert cycle(spark, rows)[1] == want
    assert sum(r[2] == "response" for r in want) == 200 + 1 + 10


def test_repeated_rows_of_the_largest_page_are_all_responses(spark):
    _, got = cycle(spark, [(9, "u", "y" * 2000)] * 3 + [(1, "u", "y" * 2000)])
    assert sorted((r[0], r[2]) for r in got) == [("urn:page:1", "revisit")] + [("urn:page:9", "response")] * 3


def test_query_equals_sql(spark, compare):
    compare(spark, "op8_warc", "sf0.01")
