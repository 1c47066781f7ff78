from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.llm import quality, queries

DATA = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def documents(n=300):
    draw = random.Random(8)
    good = lambda: " ".join(draw.choice(["the", "house", "was", "old", "and", "warm"]) for _ in range(60))
    bad = lambda: " ".join(draw.choice(["win$$$", "CLICK!!!", "the%%%", "old***"]) for _ in range(60))
    return [(i, bad() if i % 5 == 0 else good()) for i in range(n)]


def test_junk_goes_and_clean_stays(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("key", "log_weight", "rank", "good", "selected")})
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(150)], LABELS)
    scores, kept = quality.resample(docs, labels)
    got = {r.doc_id: r.selected for r in scores.collect()}
    assert got == {i: i % 5 > 0 for i, _ in rows}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s}


class ByHand:
    """Both models in plain Python: buckets of words and word pairs, counted in dicts; all rows are the raw text."""

    def __init__(self, rows, good):
        self.good, self.raw, self.target = good, Counter(), Counter()
        for i, text in rows:
            self.raw.update(self.grams(text))
            if i in good:
                self.target.update(self.grams(text))
        self.all_raw, self.all_target = self.raw.total(), self.target.total()

    @staticmethod
    def grams(text):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@[-`{-~]+", (text or "").encode())
        h = [zlib.crc32(w) for w in words]
        ones = [x * 2654435761 % 2**32 for x in h]
        pairs = [(1 if a == b else (a * 2654435761 + b) % 2**32) * 2246822519 % 2**32 for a, b in zip(h, h[1:])]
        return [x >> 16 for x in ones + pairs]

    def weight(self, i, text, prior=5.0, features=40.0, slack=0.25):
        own, own_target = Counter(self.grams(text)), Counter(self.grams(text)) if i in self.good else Counter()
        n = own.total()
        if not n or not self.all_target:
            return 0.0
        scale = (self.all_target - own_target.total()) / max(1, self.all_raw - n)
        logs = (c * math.log((self.target[b] - own_target[b] + prior) / ((self.raw[b] - c) * scale + prior)) for b, c in own.items())
        return features * min(0.0, sum(logs) / n + slack)


def compare_by_hand(scores, rows, labels, k=None):
    """Weights, the default k and the selection; ``labels`` as (doc_id, quality, toxic)."""
    model = ByHand(rows, {i for i, q, t in labels if q == 1 and not t})
    got = scores.toPandas()
    texts = dict(rows)
    want = {i: model.weight(i, t) for i, t in texts.items()}
    for r in got.itertuples():
        assert r.log_weight == pytest.approx(want[r.doc_id], abs=1e-6)
    k = k or round(sum(min(1.0, math.exp(min(w, 0))) for w in want.values()))
    assert set(got[got["selected"]]["doc_id"]) == set(got.nlargest(k, "key")["doc_id"])
    return got


@pytest.mark.parametrize("k", [25, None])
def test_models_keys_and_k_by_hand(spark, k):
    rows = documents(80)
    labels = [(i, int(i % 5 > 0), int(i == 7)) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    scores, _ = quality.resample(docs, spark.createDataFrame(labels, LABELS), k=k)
    compare_by_hand(scores, rows, labels, k)


def test_gumbel_noise(spark):
    x = spark.range(20_000).select(quality.gumbel("id", 42).alias("g")).toPandas()["g"]
    assert x.mean() == pytest.approx(0.5772, abs=0.05) and x.std() == pytest.approx(1.2825, abs=0.05)


def test_sample_is_bounded_and_agrees(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, None), (4, None, 0), (None, 1, 0), (5, 0, 0), (6, 1, 0), (6, 1, 0)], LABELS)
    assert {r.doc_id: r.good for r in quality.sample(labels, 10, 42).collect()} == {1: False, 2: False, 3: True, 5: False, 6: True}
    assert quality.sample(labels, 2, 42).count() == 2


def test_labels_without_use_do_not_shrink_the_sample(spark):
    labels = spark.range(50_000).selectExpr("id AS doc_id", "CAST(IF(id % 10 = 0, 1, NULL) AS INT) AS quality", "CAST(0 AS INT) AS toxic")
    assert quality.sample(labels.unionByName(labels), 3000, 42).count() == 3000


def test_hostile_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "a b"), (4, "word " * 100_000)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(3, 1, 0)], LABELS)
    scores, kept = quality.resample(docs, labels)
    assert scores.count() == 6 and kept.count() == scores.where("selected").count() == 6
    none = spark.createDataFrame([], LABELS)
    assert quality.resample(docs, none)[1].count() == 6
    assert quality.resample(docs, labels, k=0)[1].count() == 0
    assert quality.resample(spark.createDataFrame([], DOCS), labels)[0].count() == 0


def test_query(spark):
    got = queries.op7_quality(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert len(got) == len(docs)
    compare_by_hand(spark.createDataFrame(got), docs, [tuple(x) for x in labels[["doc_id", "quality", "toxic"]].itertuples(index=False)])
    assert both[(both["quality"] == 1) & (both["toxic"] == 0)]["selected"].mean() > 0.95
    assert both[both["quality"] == 0]["selected"].mean() < 0.1


def test_the_raw_model_is_of_all_documents(spark):
    """Documents without labels change the ratio of others: what they are full of becomes less of the target."""
    rows, labels = documents(60), [(i, int(i % 5 > 0), 0) for i in range(30)]
    more = [(1000 + i, "the house was old " * 30) for i in range(200)]
    a, b = ({r.doc_id: r.log_weight for r in quality.resample(spark.createDataFrame(x, DOCS), spark.createDataFrame(labels, LABELS), k=1)[0].collect()} for x in (rows, rows + more))
    assert any(a[i] != b[i] for i in a) and all(a[i] >= b[i] for i, t in rows if i % 5)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_clean_documents_stay(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    both = quality.resample(docs, labels)[0].toPandas().merge(labels.toPandas(), on="doc_id")
    assert both[(both["quality"] == 1) & (both["toxic"] == 0)]["selected"].mean() > 0.99
    assert both[both["quality"] == 0]["selected"].mean() < 0.1
