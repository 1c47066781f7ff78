from __future__ import annotations

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from larder.llm import packing, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    """Ids of a text by the tokenizer alone, then the end id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


SPACES = ["a  b\n\n c\t d ", "  lead", "trail  ", "\n", " ", "it's  we'll\r\n'tis ' s", "nbsp\xa0 \xa0x", "\x1c \x1fy", "a  　b", "zero​ w", "x\x85 y", "<|endoftext|> no<|endoftext|>", "日本 語  テキスト", "é \U0001f600\U0001f600", "1 23  4,5.6", "\x00 \x7f", "tab\t\tword \x0b\x0c end"]


def test_stretches_have_the_same_ids(spark, plain):
    encode = packing.Encoder(PATH, most=50)
    draw = random.Random(2)
    texts = SPACES + ["".join(draw.choices([" ", "  ", "\n", "a", "B", "é", "'s", "1", ".", "\t", "日"], k=40)) for _ in range(500)]
    texts += ["wordş ab²x ab1 e\u0301é ªb ßÿ×÷ don'state x'll's|y word.%%% a-b_c éÉ.é", "Straße, naïve… œuvre Ÿ"]
    texts += ["".join(draw.choices([" ", "'", "s", "S", "é", "ş", "²", "1", "_", ".", "%", "ª", "\u0301", "\n"], k=30)) for _ in range(2000)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for _ in range(2):
        for t in texts:
            assert encode(t) == struct.pack(f"<{len(plain(t)) - 1}I", *plain(t)[:-1])


def checked(rows, docs, plain, capacity):
    """Pieces are each document's ids once; sequences are gapless. Returns the lengths of sequences."""
    by = {}
    for r in sorted(rows, key=lambda r: r.start):
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {d for d, _ in docs}
    for doc_id, text in docs:
        ids = plain(text)
        assert [i for r in by[doc_id] for i in struct.unpack(f"<{r.length}I", r.ids)] == ids
        assert [r.start for r in by[doc_id]] == [sum(x.length for x in by[doc_id][:i]) for i in range(len(by[doc_id]))]
        assert all(r.doc_tokens == len(ids) for r in by[doc_id])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return {s: sum(n for _, n in parts) for s, parts in sequences.items()}


def test_pack(spark, plain):
    docs = [(i, " ".join(["word"] * (i * 37 % 91))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(SPACES)] + [(2000, None), (2001, ""), (2002, "long text " * 40_000), (2003, "x" * 5000)]
    given = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("start", "deal", "ids", "length", "sequence_id")})
    for groups in (1000, 40):
        rows = packing.pack(given.repartition(4), PATH, capacity=64, group_docs=groups)
        filled = checked(rows.collect(), docs, plain, 64)
        assert sum(filled.values()) / (64 * len(filled)) > 0.99
        whole = {r.sequence_id: r for r in packing.sequences(rows, 64, pad_id=9).collect()}
        for s, n in filled.items():
            ids = struct.unpack(f"<{len(whole[s].ids) // 4}I", whole[s].ids)
            assert whole[s].length == n and len(ids) == (n if n & (n - 1) == 0 else 64) and set(ids[n:]) <= {9}


def slow_first_fit(lengths, capacity):
    rooms, out = [], []
    for n in lengths:
        at = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
        out.append((at, capacity - rooms[at]))
        rooms[at] -= n
    return out


def test_first_fit_by_hand():
    draw = random.Random(4)
    for n in (0, 1, 2, 3, 200):
        for order in (sorted, list):
            lengths = order(draw.randint(1, 100) for _ in range(n))[::-1]
            assert list(zip(*packing.first_fit(lengths, 100), strict=True)) == slow_first_fit(lengths, 100)
    with pytest.raises(ValueError, match="holds 101"):
        packing.first_fit([101], 100)


def test_groups_are_packed_longest_first(spark):
    """Each group's pieces are where plain first-fit decreasing puts them."""
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") * 37 % 50 + 1).alias("length"), F.xxhash64("id").alias("deal"))
    placed = packing.packed(rows, 500, capacity=64, group_docs=100).join(rows.select("doc_id", "deal"), "doc_id").collect()
    groups = {}
    for r in placed:
        groups.setdefault(r.deal % 5, []).append(r)
    assert len(groups) == 5
    for g, members in groups.items():
        members.sort(key=lambda r: (-r.length, r.doc_id))
        assert [(r.sequence_id - (g << 32), r.offset) for r in members] == slow_first_fit([r.length for r in members], 64)


def test_no_rows_and_repeated_rows(spark, plain):
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b")], DOCS), PATH).collect()
    assert len(rows) == 4 and {r.length for r in rows} == {len(plain("a b"))} and len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tokens = {d: plain(t) for d, t in docs}
    found = queries.op12_pack(spark, sf).collect()
    assert sum(r.length for r in found) == sum(map(len, tokens.values()))
    filled = {}
    for r in found:
        ids = tokens[r.doc_id][r.start : r.start + r.length]
        assert (r.length, r.doc_tokens, r.ids_crc32) == (len(ids), len(tokens[r.doc_id]), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 2048 and sum(filled.values()) / (2048 * len(filled)) > 0.98


def test_a_tokenizer_of_another_kind(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
    for text in ("Some Words, and  MORE.", "é \n ü"):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert not encode.by_bytes and encode(text) == struct.pack(f"<{len(ids)}I", *ids)
