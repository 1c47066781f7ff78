"""Importance resampling towards a target distribution, with word tries.

Features are runs of 1 to ``longest`` consecutive words; their buckets are the CRC-32 of their UTF-8 bytes (words joined by
one space) modulo ``buckets``. Each task grows a trie of the words it meets: a node is a feature, holds the CRC state of its
path, from which a child's state is one step, and in the first pass its count. The tasks' bucket totals are merged; the
gain of a bucket is the log ratio of its smoothed shares in target and raw text. In the second pass each node gets its
bucket's gain when it is grown, and a document's gains are read off by walking its words along the paths. A trie that has
grown beyond ``most_nodes`` is emptied (its counts are added to the bucket totals first), so memory is bounded and no
feature is lost. Only bucket totals meet on the driver, at most ``buckets`` rows.

A document's weight is the floored mean of its gains; score is the weight plus Gumbel noise from a hash of seed and doc_id;
of the documents with enough words the highest scores are drawn, ties to the smaller doc_id. Their ranks come from a range
sort of narrow rows, no task has them all.

Nulls: a null text has no words, as an empty one: weight 0, never drawn where ``least_words`` is above 0. A null doc_id has
the noise of an empty one and comes before others at equal scores. Repeated rows are documents of their own; rows that are
equal in score and doc_id are ranked by their features, then arbitrarily. Very long texts are read whole, a task holds one
at a time as words. An empty table has no rows; an empty target makes all gains those of the smoothing. Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ranked, saved

#: A-Z to lower case; bytes that are no part of a word (all ASCII but letters and digits) to a space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(BYTES).split() if text else []


class Node(dict):
    """A feature: its CRC state, its count or gain, and its longer features by their next word."""

    __slots__ = ("state", "trie", "value")

    def __init__(self, trie: Trie, state: int, value: int) -> None:
        self.trie, self.state, self.value = trie, state, value

    def __missing__(self, word: bytes) -> Node:
        trie = self.trie
        state = zlib.crc32(word if self is trie.root else b" " + word, self.state)
        self[word] = node = Node(trie, state, trie.start(state))
        trie.nodes.append(node)
        return node


class Trie:
    def __init__(self, start) -> None:
        """``start`` gives a new node's value from its CRC state."""
        self.start, self.nodes = start, []
        self.root = Node(self, 0, 0)

    def walk(self, text: list[bytes], longest: int) -> Iterator[Node]:
        """The nodes of all features of a text."""
        root = self.root
        if longest == 1:
            yield from map(root.__getitem__, text)
            return
        for i in range(len(text)):
            node = root
            for word in text[i : i + longest]:
                node = node[word]
                yield node


def totals(docs: DataFrame, longest: int, buckets: int, most_nodes: int) -> dict[int, int]:
    """Features of all texts by bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, trie = np.zeros(buckets, np.int64), Trie(lambda state: 0)

        def add() -> None:
            at = np.fromiter((n.state for n in trie.nodes), np.int64, len(trie.nodes)) % buckets
            np.add.at(sums, at, np.fromiter((n.value for n in trie.nodes), np.int64, len(trie.nodes)))

        for b in batches:
            for text in b.column("text"):
                for node in trie.walk(words(text.as_py()), longest):
                    node.value += 1
                if len(trie.nodes) > most_nodes:
                    add()
                    trie = Trie(lambda state: 0)
        add()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    found = docs.select(F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").mapInArrow(count, "bucket bigint, n bigint")
    return dict(map(tuple, found.groupBy("bucket").agg(F.sum("n")).collect()))  # at most ``buckets`` rows


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """The gain of each bucket in thousandths."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((raw.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], longest: int = 1, seed: int = 2024, most_nodes: int = 400_000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        fresh = lambda: Trie(lambda state: table[state % len(table)])
        trie = fresh()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                found = words(text.as_py())
                values = [node.value for node in trie.walk(found, longest)]
                weight = sum(values) // len(values) if values else 0
                rows.append((doc_id, len(found), len(values), weight, weight + noise(doc_id, seed)))
                if len(trie.nodes) > most_nodes:
                    trie = fresh()
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(score, SCORED)


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, most_nodes: int = 400_000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and the rank of the drawn, null for others: a row for each row of ``docs``."""
    gain = gains(totals(docs, longest, buckets, most_nodes), totals(target, longest, buckets, most_nodes), buckets)
    rows = saved(scored(docs, gain, longest, seed, most_nodes).withColumn("_row", F.monotonically_increasing_id()), "importance")
    able = F.col("n_words") >= least_words
    drawn = percent * rows.where(able).count() // 100
    rows = ranked(rows, F.desc(able), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("_row"), name="_place")
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", F.when(able & (F.col("_place") < drawn), F.col("_place") + 1).alias("rank"))
