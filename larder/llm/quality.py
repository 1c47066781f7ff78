"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs, one of target texts and one of raw texts, give each document the
log of their ratio. The raw model counts all documents. The target model counts at most ``sample_rows`` labelled ones, taken
by hashed doc_id, of those that are of quality 1 and not toxic, and is drawn towards the raw model by a prior: with t of the
target's features in a bucket where e are expected of raw text, the ratio is (t + prior) / (e + prior). A document's own
features are left out of both models when it is weighed, or its rare words would all speak against it.

The log ratio is that of ``features`` features, each with the document's mean, so a long document is not judged more
strictly than a short one. The weight is truncated: a mean within ``slack`` of 0 counts as 0, for a bounded sample has its
chance mix of languages and topics. Gumbel top-k, the k highest of weight + Gumbel noise, draws k documents without
replacement in proportion to the ratio. By default k is the sum of the ratios, each at most 1: the documents that
rejection sampling towards the target would accept. The noise is a hash of doc_id and seed, so reruns agree.

The bound of the sample makes the broadcast of its ids safe; of the models 2 x BUCKETS numbers meet on the driver. The k-th
key comes from a distributed rank over (key, doc_id); the rows below it leave by a join on doc_id and the text's hash, so no
text is scored twice.

Nulls: a null or empty text has weight 0; a null doc_id has its own noise; null labels and ids teach nothing; a doc_id with
several labels is a target only if all agree, and all rows of a target's doc_id are. Without any target row every ratio is 1.
Very long texts are read whole, one at a time. Equal keys (repeated rows) stay or go together. No rows give no rows. Extra
columns, whatever their names, pass through the filter untouched.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import broadcast_if_small, ranked, saved

BITS = 16
BUCKETS = 1 << BITS
#: Runs of letters and digits (any byte from 128 on counts as one), and runs of other visible characters.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")


class Hashes(dict):
    """Word -> 32-bit hash; each word is hashed once while it is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def grams(text: bytes, hashes: Hashes) -> np.ndarray:
    """Buckets of the words and word pairs of a text; all pairs of a word with itself are one."""
    words = TOKEN.findall(text)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint32, len(words))
    pairs = np.where(h[:-1] == h[1:], np.uint32(1), h[:-1] * np.uint32(2654435761) + h[1:]) * np.uint32(2246822519)
    return np.concatenate([h * np.uint32(2654435761), pairs]) >> np.uint32(32 - BITS)


def sample(labels: DataFrame, sample_rows: int, seed: int) -> DataFrame:
    """doc_id, good: at most ``sample_rows`` labelled documents."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    rows = known.agg((F.min("quality") == 1).alias("clean"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / float(1 << 53)
    rows = saved(rows.select("doc_id", (F.col("clean") & (F.col("toxic") == 0)).alias("good"), u.alias("u")), "labelled")
    # Only about four times the sample is ever sorted, however many labels there are.
    share = 4 * sample_rows / max(1, rows.count())
    return rows.where(F.col("u") < share).orderBy("u", "doc_id").limit(sample_rows).select("doc_id", "good")


def marked(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text as binary, hash of the text, and whether the document is in the target."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("hash"))
    good = F.broadcast(chosen.where("good"))  # at most the sample's rows
    return rows.join(good, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))


def fit(rows: DataFrame) -> np.ndarray:
    """Features of all rows of ``marked`` (first row) and of the target's (second), by bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, hashes = np.zeros((2, BUCKETS), np.int64), Hashes()
        for b in batches:
            for t, good in zip(b.column("text"), b.column("good").to_pylist(), strict=True):
                buckets, n = np.unique(grams(t.as_py(), hashes), return_counts=True)
                sums[0, buckets] += n
                if good:
                    sums[1, buckets] += n
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["bucket", "raw", "target"])

    found = rows.where("text IS NOT NULL").select("text", "good").mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    model = np.zeros((2, BUCKETS))
    for bucket, raw, target in found.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # at most BUCKETS rows
        model[:, bucket] = raw, target
    return model


def mean_ratio(found: np.ndarray, good: bool, model: np.ndarray, sums: np.ndarray, prior: float) -> float:
    """The mean log ratio of a document's features, by the models (``sums``: all of each) without the document."""
    buckets, n = np.unique(found, return_counts=True)
    expected, ratio = model[0, buckets] - n, model[1, buckets] - n * good
    expected *= (sums[1] - len(found) * good) / max(sums[0] - len(found), 1.0)
    expected += prior
    ratio += prior
    ratio /= expected
    return float(n @ np.log(ratio)) / len(found)


def weigher(docs: DataFrame, model: np.ndarray, prior: float, features: float, slack: float):
    """A column function: text as binary, and whether it is in the target -> weight."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table, hashes = shared.value, Hashes()
        sums = table.sum(1)

        def weight(text: bytes | None, good: bool) -> float:
            found = grams(text, hashes) if text and sums[1] else ()
            return features * min(0.0, mean_ratio(found, good, table, sums, prior) + slack) if len(found) else 0.0

        for texts, goods in parts:
            yield pd.Series([weight(t, g) for t, g in zip(texts, goods, strict=True)], dtype=float)

    return run


def gumbel(doc_id: str, seed: int) -> Column:
    """Gumbel noise from a hash: -ln(-ln u), u in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 12) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, sample_rows: int = 30_000, seed: int = 42, prior: float = 5.0, features: float = 40.0, slack: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Scores (doc_id, log_weight, key, selected: a row for each row of docs) and the selected rows of ``docs``."""
    rows = marked(docs, saved(sample(labels, sample_rows, seed), "sample"))
    weigh = weigher(docs, fit(rows), prior, features, slack)
    scored = rows.select("doc_id", "hash", weigh("text", "good").alias("log_weight")).withColumn("key", F.col("log_weight") + gumbel("doc_id", seed))
    scored = saved(scored, "scores")
    if k is None:
        k = round(scored.agg(F.sum(F.exp(F.least("log_weight", F.lit(0.0))))).first()[0] or 0)
    last = ranked(scored.select("key", "doc_id"), F.desc("key"), F.asc("doc_id")).where(F.col("rank") == k - 1).select("key").first()
    if k <= 0:
        bound = math.inf
    else:
        bound = last[0] if last else -math.inf
    goes = broadcast_if_small(saved(scored.where(F.col("key") < bound).select("doc_id", "hash").distinct(), "below"))
    kept = docs.join(goes, docs["doc_id"].eqNullSafe(goes["doc_id"]) & (F.xxhash64(docs["text"]) == goes["hash"]), "left_anti")
    return scored.select("doc_id", "log_weight", "key", (F.col("key") >= bound).alias("selected")), kept
