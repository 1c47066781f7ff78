from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import langid, queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op4_language(spark, DATA).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]
    both = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98


def test_counts_equal_a_plain_count(spark):
    rows = [("en", "The  cat, the CAT."), ("en", "É"), (None, "x"), ("de", None), ("de", "")]
    got = {(r.lang, r.bucket): r.n for r in langid.count_trigrams(spark.createDataFrame(rows, "lang string, text string")).collect()}
    want: dict = {}
    for lang, text in rows:
        if lang is None or text is None:
            continue
        b = " ".join(["", *"".join(c if c.isalpha() else " " for c in text.lower()).split(), ""]).encode()
        for i in range(len(b) - 2):
            key = (lang, ((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 17)
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_mixture_finds_the_proportions(spark, model):
    names, table = model
    texts = {r.lang: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 3000").collect()}
    mixed = texts["de"][:2000] + " " + texts["es"][:1000]
    i, score = langid.predict(mixed, table)
    assert names[i] == "de" and 0.55 < score < 0.8
    i, score = langid.predict(texts["fr"][:2000], table)
    assert names[i] == "fr" and score > 0.9


def test_em_maximises(model):
    draw = np.random.default_rng(0)
    likelihood, n = draw.random((50, 2)), draw.integers(1, 5, 50).astype(float)
    share, fit = langid.mixture(likelihood, n, 200)
    grid = [float(n @ np.log(likelihood @ np.array([p, 1 - p]))) for p in np.linspace(0.001, 0.999, 999)]
    assert fit == pytest.approx(max(grid), abs=1e-3) and share.sum() == pytest.approx(1)


def test_hostile_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ---"), (4, "der und die " * 50_000), (5, "x"), (5, "x"), (None, "the of and is"), (6, "퟿中")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit("clash"))
    find = langid.predictor(docs, model)
    got = [(r.doc_id, r.f.lang, r.f.score) for r in docs.select("doc_id", find("text").alias("f")).collect()]
    assert [(g[1], g[2]) for g in got[:3]] == [("und", 0.0)] * 3
    assert got[3][1] == "de" and got[6][1] == "en" and got[4] == got[5]
    assert all(0 <= g[2] <= 1 for g in got)


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty)
    docs = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert docs.select(langid.predictor(docs, model)("text").alias("f")).collect()[0].f.lang == "und"


def test_no_language_is_left_out(spark):
    """300 languages, each with words of its own, are all learned and found; too many are an error."""
    word = lambda i, k: "".join(chr(97 + (i * 7 + k * 11 + j * (i % 23 + 3)) % 26) for j in range(9))
    rows = [(i, f"l{i:03}", " ".join(word(i, k) for k in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    names, table = model = langid.fit(docs)
    assert names == [f"l{i:03}" for i in range(300)] and table.shape == (langid.BUCKETS, 300)
    got = docs.select("lang", langid.predictor(docs, model)("text").alias("f")).collect()
    assert sum(r.lang == r.f.lang for r in got) > 290
    with pytest.raises(ValueError, match="more than 299"):
        langid.fit(docs, most=299)


def by_hand(text, table, cost=2.0, rounds=12):
    """Prediction in plain Python: all shares by EM, then sets of the largest languages while the penalised fit rises."""
    b = " ".join(["", *"".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).split(" "), ""])
    b = " ".join(["", *b.split(" "), ""]).encode()
    b = re.sub(rb" +", b" ", b)
    counts = Counter((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32 >> 17 for i in range(len(b) - 2))
    total = sum(counts.values())

    def em(langs):
        share = {x: 1 / len(langs) for x in langs}
        for _ in range(rounds if len(langs) > 1 else 0):
            new = dict.fromkeys(langs, 0.0)
            for g, n in counts.items():
                mix = sum(share[x] * table[g, x] for x in langs)
                for x in langs:
                    new[x] += n * share[x] * table[g, x] / mix / total
            share = new
        return share, sum(n * math.log(sum(share[x] * table[g, x] for x in langs)) for g, n in counts.items())

    share, _ = em(range(table.shape[1]))
    order, best, found = sorted(share, key=lambda x: -share[x]), -math.inf, None
    for k in range(1, len(order) + 1):
        part, fit = em(order[:k])
        value = fit / 3 - cost * math.log(total + 1) * k
        if value <= best:
            break
        best, found = value, max(((p, x) for x, p in part.items()))
    return found[1], found[0]


def test_predictions_by_hand(spark, model):
    names, table = model
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) BETWEEN 20 AND 1500").orderBy("doc_id").limit(40).collect()]
    texts += [a[:400] + " " + b[:300] for a, b in zip(texts[:10], texts[20:], strict=False)]
    for t in texts:
        i, score = langid.predict(t, table)
        want, share = by_hand(t, table.astype(float))
        assert (i, score) == (want, pytest.approx(share, abs=1e-6))


def test_no_documents(spark, model):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert docs.select(langid.predictor(docs, model)("text").alias("f")).collect() == []
