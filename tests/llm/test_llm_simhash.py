from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import common, simhash
from larder.llm.graph import components

DOCS = "doc_id long, text string"


def fingerprint(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows, k=4, most=4):
    fps = [fingerprint(t, k) for _, t in rows]
    root = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= most])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if root[j] == root[i] and d is not None]
        out.append((doc_id, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("fp", "hash", "place", "root", "node", "component_id")})
    got = simhash.near_duplicates(docs, **how)
    return sorted(((r.doc_id, bytes(r.fp).hex(), r.component_id) for r in got.collect()), key=str)


def edited(draw, text, n):
    w = text.split()
    for _ in range(n):
        w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
    return " ".join(w)


def test_near_copies(spark):
    draw, rows = random.Random(1), []
    for base in range(6):
        text = " ".join(f"w{draw.randrange(500)}" for _ in range(150))
        rows += [(len(rows), edited(draw, text, draw.randrange(4))) for _ in range(12)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_hostile_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one TWO"), (None, "one two"), (None, "alone in here"), (10, long), (3, long), (3, long), (11, "É é"), (12, "é é")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_links_are_complete(spark):
    """All pairs within four bits of a dense cloud and of random ones, with either keys and with places cut into cells."""
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, 30, dtype=np.uint64)
    cloud = [int(base[0])]
    for _ in range(300):
        x = cloud[draw.integers(len(cloud))]
        for b in draw.integers(0, 64, 3):
            x ^= 1 << int(b)
        cloud.append(x)
    fps = np.array(sorted({*cloud, *map(int, base)}), np.uint64)
    table = spark.createDataFrame([(bytearray(int(x).to_bytes(8, "big")),) for x in fps], "fp binary")
    place = {int(x): i for i, x in enumerate(fps)}
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4])
    for how in ({}, {"block": 40}, {"paired": True}, {"paired": True, "block": 20}):
        edges = [(place[int.from_bytes(r.a, "big")], place[int.from_bytes(r.b, "big")]) for r in simhash.links(table, **how).collect()]
        assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 4 for a, b in edges)
        got = union(len(fps), edges)
        assert len({*zip(got, want, strict=True)}) == len(set(want)) == len(set(got))


def test_both_searches_agree(monkeypatch):
    draw = np.random.default_rng(3)
    members = (np.uint64(0xABCDEF) ^ (np.uint64(1) << draw.integers(13, 64, (90, 3), dtype=np.uint64))).max(1)[:, None]
    for wide, most, slack in ((1, 4, 0.0), (2, 16, 3.0)):
        x, chains = np.unique(np.tile(members, (1, wide)), axis=0), simhash.Chains(wide, most, slack)
        found = []
        for few in (0, 1000):
            monkeypatch.setattr(simhash, "FEW", few)
            edges = list(simhash.forest(x, 0, chains))
            found.append(union(len(x), edges))
            assert edges and all(int(np.bitwise_count(x[a] ^ x[b]).sum()) <= most for a, b in edges)
        assert len({*zip(*found, strict=True)}) == len({*found[0]}) == len({*found[1]})


def test_components(spark):
    draw = random.Random(4)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 500)]
    want = union(500, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {w: min(i for i in range(500) if want[i] == w) for w in set(want)}
    assert got == {i: least[want[i]] for i in {x for a, b in pairs if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives(spark):
    draw, rows = random.Random(6), []
    for base in range(8):
        text = " ".join(f"w{draw.randrange(5000)}" for _ in range(200))
        rows += [(len(rows), edited(draw, text, n)) for n in (0, 1, 2, 3)]
    alone = [(100 + i, " ".join(f"u{draw.randrange(5000)}" for _ in range(120))) for i in range(20)]
    rows += [*alone, (0, rows[0][1]), (None, rows[0][1]), (None, "only me"), (200, "Short one"), (201, "short ONE"), (202, "short two")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("root", F.lit(1)).withColumn("hash", F.lit("clash"))
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted([*range(0, 32, 4), *(i for i, _ in alone), None, 200, 202], key=str)


def test_stage_finds_overlaps_of_eight_tenths(spark):
    """On sf0.01, against all pairs by hand: copies and overlaps of 0.8 or more leave one row, rows far from all stay."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    shingles = {}
    for i, t in rows:
        w = t.lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    met, shared = {}, Counter()
    for i, s in shingles.items():
        for g in s:
            for j in met.setdefault(g, []):
                shared[j, i] += 1
            met[g].append(i)
    overlap = {p: n / (len(shingles[p[0]]) + len(shingles[p[1]]) - n) for p, n in shared.items()}
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, DOCS)).select("doc_id").collect()}
    near = [p for p, x in overlap.items() if x >= 0.8]
    assert len(near) > 20 and sum(a in kept and b in kept for a, b in near) <= 0.02 * len(near)
    linked = {i for p, x in overlap.items() if x >= 0.5 for i in p}
    assert set(shingles) - linked <= kept


@pytest.mark.parametrize("hot", [10, 1_000_000])
def test_joins_on_a_hot_key(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "broadcast_if_small", lambda table: table)
    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(300)] + [(300, None)], "x long, k long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 200)], "k long, v string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, common.with_unique(rows, table, "k", how, hot).select("x", "k", "v").collect()), key=str)
        assert got == sorted(map(tuple, rows.join(table, "k", how).select("x", "k", "v").collect()), key=str)
