from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.llm import importance

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, found = features(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found)]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=str)


def got(spark, docs, target, **k):
    rows = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("weight", "score", "rank", "_row", "n")})
    return sorted(map(tuple, importance.resample(rows.repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, item_id long"), **k).collect()), key=str)


def corpus(n, seed=1):
    draw, vocabulary = random.Random(seed), ["Alpha", "beta", "é1", "x-y", "日本", "a_b", "7", "", "\x85", "long\nword"]
    return [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize(("longest", "buckets", "nodes"), [(1, 10_000, 400_000), (1, 7, 3), (3, 50, 400_000), (2, 10_000, 5)])
def test_against_loops(spark, longest, buckets, nodes):
    docs, target = corpus(200), ["alpha beta beta", None, "É1 日本 7", ""]
    assert got(spark, docs, target, longest=longest, buckets=buckets, most_nodes=nodes) == brute(docs, target, longest, buckets)


def test_hostile_rows(spark):
    same = (5, "one two three " * 10)
    docs = [(1, None), (2, ""), (None, "A b " * 20), (None, "A b " * 20), same, same, (6, "w " * 100_000), (7, "x" * 100_000), (8, "\x00\x7f!")]
    target = ["one two"]
    assert got(spark, docs, target, percent=50) == brute(docs, target, percent=50)
    assert got(spark, docs, [], percent=100, least_words=0) == brute(docs, [], percent=100, least=0)


def test_no_rows(spark):
    assert got(spark, [], ["a"]) == []


def test_states_of_the_trie_are_crc32():
    trie = importance.Trie(lambda state: state)
    text = "a bc déf".encode().split()
    assert [n.value for n in trie.walk(text, 3)] == [zlib.crc32(x.encode()) for x in ("a", "a bc", "a bc déf", "bc", "bc déf", "déf")]
    assert len(trie.nodes) == 6 and len(list(trie.walk(text, 3))) == 6 and len(trie.nodes) == 6


def test_query(spark, compare):
    found = compare(spark, "op11_importance")
    assert found["rank"].notna().sum() == (found["n_features"] >= 20).sum() // 10
