"""Packing of tokenized documents into sequences of bounded length: first-fit decreasing in randomised groups.

1. A document's token ids, with an end id, are cut into pieces of ``capacity``; the last one is shorter. Ids come from a
   tokenizer of the library tokenizers. A byte-level one is asked once for each stretch of text while its ids are kept: its
   tokens reach neither from a word into the white space after it nor from a run of letters into what else follows, so
   such stretches have the same ids by themselves. A text with one of the tokenizer's added tokens, or with white space
   beyond ASCII's, is encoded as a whole, as are all texts by a tokenizer of another kind.
2. Documents are dealt into groups of about ``group_docs`` by a hash of id, text and row. In each group the pieces are
   placed longest first into the first sequence with room, found by going down a tournament tree whose inner nodes hold
   the most room below them. A group is one task's; groups do not know of each other, so they run anywhere and grow with
   the input in number, not in size.

What is not filled is padding: a sequence is padded to ``capacity``, unless its length is a power of two. ``pieces`` has
the ids, ``packed`` places any rows with a length and carries their columns, ``sequences`` has the padded ids.

Nulls: a null text is empty; an empty text is its end id alone; a null doc_id is packed like any other. Very long texts are
tokenized whole, one at a time, and give one row a piece. Ties of length are placed by doc_id (null first), then start.
Repeated rows are documents of their own. An empty table gives no rows. Extra columns are ignored by ``pieces``.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A space and a run of Latin letters that no other letter follows; or white space and what comes before the next.
STRETCH = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\W\d_])|[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: How byte-level vocabularies write bytes: visible Latin-1 characters as they are, the others as those from 256 on.
OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173)]
CHARS = [chr(256 + OTHERS.index(b)) if b in OTHERS else chr(b) for b in range(256)]
#: White space beyond ASCII's, and controls that some count as such.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, deal bigint"


def in_chars(word: str) -> str:
    """A word of ``WORD`` as byte-level vocabularies write it."""
    if word.isascii():
        return CHARS[32] + word[1:] if word[0] == " " else word
    return "".join(map(CHARS.__getitem__, word.encode()))


class Encoder:
    """Text to ids as unsigned 32-bit little-endian bytes. Of the stretches met before, up to 2 * ``most`` are kept."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.older, self.most = Tokenizer.from_file(path), {}, {}, most
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        self.by_bytes = made["model"]["type"] == "BPE" and not made["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def __call__(self, text: str) -> bytes:
        if not self.by_bytes or OTHER_SPACE.search(text) or any(a in text for a in self.added):
            return self._encode([text])[0]
        stretches = STRETCH.findall(text)
        if len(self.kept) > self.most:
            self.kept, self.older = {}, self.kept
        kept, older, others, tokenize = self.kept, self.older, [], self.tokenizer.model.tokenize
        for s in set(stretches).difference(kept):
            if s in older:
                kept[s] = older[s]
            elif WORD.fullmatch(s):  # one word to the model, as it is
                ids = [t.id for t in tokenize(in_chars(s))]
                kept[s] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(s)
        kept.update(zip(others, self._encode(others), strict=True))
        return b"".join(map(kept.__getitem__, stretches))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (4 bytes each), deal: the pieces of each document; deal is its random number."""
    end = struct.pack("<I", end_id)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            rows, size = [], 0
            for doc_id, text, deal in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("deal").to_pylist(), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(part) // 4, n, part, deal))
                    size += len(part)
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for x, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    deal = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", deal.alias("deal")).mapInArrow(cut, PIECES)


class Rooms:
    """A tournament tree over sequences: each inner node has the most room below it."""

    def __init__(self, most: int, capacity: int) -> None:
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The first sequence with room for ``length``, and the room it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        had, found = room[at], at - self.leaves
        room[at] = had - length
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found, had


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length, in their order."""
    rooms, sequence, offset = Rooms(len(lengths), capacity), [], []
    for n in lengths:
        if not 0 < n <= capacity:
            raise ValueError(f"no sequence of {capacity} holds {n}")
        at, had = rooms.place(n)
        sequence.append(at)
        offset.append(capacity - had)
    return sequence, offset


def packed(rows: DataFrame, documents: int, capacity: int = 2048, group_docs: int = 4096) -> DataFrame:
    """``rows`` (doc_id, start, length, deal and any others) with sequence_id and offset in place of deal.

    ``documents``: how many there are, from which the number of groups follows.
    """
    groups = max(1, -(-documents // group_docs))
    rows = rows.withColumn("_group", F.pmod("deal", F.lit(groups))).drop("deal")
    out = [f for f in rows.schema.fields if f.name != "_group"]

    def place(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_pylist()
        ids, starts = group.column("doc_id").to_pylist(), group.column("start").to_pylist()
        by = sorted(range(len(lengths)), key=lambda i: (-lengths[i], ids[i] is not None, ids[i] or 0, starts[i]))
        group = group.take(pa.array(by, pa.int64()))
        sequence, offset = first_fit([lengths[i] for i in by], capacity)
        first = (group.column("_group")[0].as_py() if by else 0) << 32
        return group.drop_columns(["_group"]).append_column("sequence_id", pa.array([first + s for s in sequence], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", sequence_id bigint, offset bigint"
    return rows.groupBy("_group").applyInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group_docs: int = 4096) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset: the pieces in their sequences."""
    return packed(pieces(docs, tokenizer, capacity, end_id), docs.count(), capacity, group_docs)


def sequences(placed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, length, ids: the pieces of ``pack`` as whole sequences, padded to ``capacity`` unless their length is a power of two."""
    one = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: F.hex(p["ids"])), "")
    whole = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    missing = F.when(whole, 0).otherwise(capacity - F.col("length")).cast("int")
    return one.select("sequence_id", "length", F.unhex(F.concat(text, F.repeat(F.lit(struct.pack("<I", pad_id).hex()), missing))).alias("ids"))
