"""Language identification by multilingual mixture inference.

Training counts hashed byte trigrams of each language over all training rows. A document is a mixture of languages:
expectation-maximisation estimates the proportions from its trigrams' likelihoods, and the set of languages is the one
with the highest penalised likelihood (languages are taken in order of their proportion until one more does not pay).
The prediction is the language with the largest proportion, the score that proportion.

Trigrams overlap, so the log-likelihood counts a third; each language of a set costs ``cost`` x log(length).
The model has ``BUCKETS`` numbers of 4 bytes (128 KB) a language, in every task. None is left out: more than ``most``
languages are an error, as their model would not fit the tasks.

Nulls: rows with a null text or label are not learned from. A null text, one without a letter, and every text if nothing
was learned get ``und`` and score 0. Any length works; documents are handled one at a time. Repeated rows count as often
as they occur in training. Of equal proportions the language that is first by name is taken. No documents give no rows.
Other columns are ignored or passed on untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
BUCKETS = 1 << BITS
LETTER = regex.compile(r"\p{L}")
#: ASCII letters and all bytes from 128 on stay, others become a space.
PLAIN = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, with runs of other characters as one space."""
    b = PLAIN[np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)]
    space = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    b = b[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return ((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def count_trigrams(docs: DataFrame, label: str = "lang", text: str = "text") -> DataFrame:
    """lang, bucket, n over all rows of ``docs`` that have both."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                if name not in sums and len(sums) >= 64:
                    yield from rows(sums)
                    sums = {}
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                sums[name] += np.bincount(trigrams(t.as_py()), minlength=BUCKETS)
        yield from rows(sums)

    def rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    known = docs.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = known.mapInArrow(count, "lang string, bucket bigint, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, label: str = "lang", text: str = "text", most: int = 2048) -> tuple[list[str], np.ndarray]:
    """The languages and their smoothed trigram probabilities (BUCKETS x languages)."""
    counts = count_trigrams(docs, label, text)
    counts.persist()
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(most + 1).collect())
    if len(names) > most:
        counts.unpersist()
        raise ValueError(f"more than {most} languages")
    table = np.full((BUCKETS, len(names)), 0.5, np.float32)
    place = {name: i for i, name in enumerate(names)}
    for r in counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).toLocalIterator():
        table[np.array(r["b"], np.int64), place[r["lang"]]] += np.array(r["n"], np.float32)
    counts.unpersist()
    table /= table.sum(0, dtype=float).astype(np.float32)
    return names, table


def mixture(likelihood: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the columns and the log-likelihood, by expectation-maximisation from equal shares."""
    share, total = np.full(likelihood.shape[1], 1 / likelihood.shape[1]), n.sum()
    if len(share) > 1:
        for _ in range(rounds):
            share = share * (likelihood.T @ (n / (likelihood @ share))) / total
    return share, float(n @ np.log(likelihood @ share))


def predict(text: str, probabilities: np.ndarray, cost: float = 2.0, rounds: int = 12) -> tuple[int, float]:
    """Place of the main language and its proportion; -1 for a text without trigrams."""
    counts = np.bincount(trigrams(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    if not len(at) or not probabilities.shape[1]:
        return -1, 0.0
    n, likelihood = counts[at].astype(float), probabilities[at].astype(float)
    share, _ = mixture(likelihood, n, rounds)
    order, price = np.argsort(-share, kind="stable"), cost * np.log(n.sum() + 1)
    best, found = -np.inf, (-1, 0.0)
    for k in range(1, len(order) + 1):
        share, fit_ = mixture(likelihood[:, order[:k]], n, rounds)
        if fit_ / 3 - price * k <= best:
            break
        best, found = fit_ / 3 - price * k, (int(order[share.argmax()]), float(share.max()))
    return found


def predictor(docs: DataFrame, model: tuple[list[str], np.ndarray], **how: float):
    """A column function text -> struct<lang, score>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, table = shared.value
        for batch in texts:
            out = []
            for t in batch:
                i, score = predict(t, table, **how) if isinstance(t, str) and LETTER.search(t) else (-1, 0.0)
                out.append((names[i], min(score, 1.0)) if i >= 0 else ("und", 0.0))
            yield pd.DataFrame(out, columns=["lang", "score"])

    return run


def remainder(column: str, divisor: int) -> Column:
    """crc32 of a column as text, modulo ``divisor``; 0 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(0))
