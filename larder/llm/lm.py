"""Language-model scoring with a weighted backoff automaton.

Training counts every word, pair and triple of words of the training rows; none is dropped for its rank or count. Counts
are smoothed by a hierarchy of Dirichlet priors (MacKay and Peto, 1995): with n(h) the count of a context h, its word w
has p(w | h) = (n(hw) + m p(w | h')) / (n(h) + m), where h' is h without its first word and m the prior's weight at that
length; below all is the add-one share of the word. As an automaton: a state is a context of up to two words, an arc reads
a word with count above 0 and carries log p, a failure arc leads to the next shorter context and carries
log(m / (n(h) + m)), and the empty context has an arc for every word.

The automaton is never in one place. Texts are written as slices of about ``slice_tokens`` tokens. A slice asks for the
counts of its distinct n-grams only: their sorted 64-bit keys are dealt out by key range, the counts of all slices are
summed there, and every slice gets back one number for each key it asked for, in its order. Words and pairs come first;
then triples, but for those with a pair that no other slice has: all of these are in the slice, which counts them itself.
With the counts it has each arc and failure arc that its texts can meet, and scores each text in one left-to-right
traversal, whose state after a token is the pair that ends there. An n-gram of any frequency is one entry a slice, so no
word or context is a hot key.

Keys: a word's key is a 64-bit hash; words whose keys meet are found by 16 further bits of another hash, and another seed
is taken. Keys of pairs and triples are mixes of their words' keys and could meet with a chance of n^2 / 2^65 for n of them.
``base`` is the add-one unigram score of the same training counts.

Nulls: a null text is empty: one token, the end. A null doc_id counts as not held out. Repeated rows are scored, and in
training counted, each. With no training row every count is 0, no rows give no
rows. There is no ranking, so there are no ties. Any length works; a text is never cut, one that is longer
than a slice is a slice of its own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import saved, shared_dir
from larder.llm.files import attempt_name, open_read, open_write

#: Keys of no word: the end of a text (the empty string) and what is before it.
END, PAD = b"", b" "
ORDERS = (1, 2, 3)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_keys(words: list[bytes], seed: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A key of ``bits`` bits and 16 bits of another hash for each word."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, seed) for w in words), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0] >> np.uint64(64 - bits), (both[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of each n-gram from that of its beginning and that of its last word."""
    h = a >> np.uint64(29)
    h += b
    h ^= a * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes, so that small ones take little room."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


class Numbers(dict):
    """Word -> number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Slice:
    """Some whole texts: ids, held_out and size (in tokens) of each, all tokens as numbers, and the words of the numbers."""

    def __init__(self, doc_ids: list, held_out: np.ndarray, size: np.ndarray, tokens: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        self.doc_ids, self.held_out, self.size, self.tokens, self.keys, self.checks = doc_ids, held_out, size, tokens, keys, checks
        starts = np.cumsum(size) - size
        self.first = np.zeros(len(tokens), bool)
        self.first[starts] = True  # every text has a token, the end

    def write(self, uri: str, kind: pa.DataType) -> None:
        columns = [pa.array([self.doc_ids], pa.list_(kind)), *(pa.array([pack(x)], pa.binary()) for x in (self.held_out, self.size, self.tokens, self.keys, self.checks))]
        batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "size", "tokens", "keys", "checks"])
        with open_write(uri) as out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)

    @staticmethod
    def read(uri: str) -> Slice:
        with open_read(uri) as file, pa.ipc.open_stream(file) as reader:
            row = reader.read_next_batch().to_pylist()[0]
        return Slice(row["doc_id"], *(unpack(row[c], k) for c, k in (("held_out", bool), ("size", np.int64), ("tokens", np.int32), ("keys", np.uint64), ("checks", np.uint16))))

    def before(self, x: np.ndarray, start) -> np.ndarray:
        """What each token has before it: the value at the last token, ``start`` at the beginning of a text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    def grams(self, order: int, pad: np.uint64) -> np.ndarray:
        """The key of the n-gram that ends at each token. A text's first triple would tell what its first pair tells."""
        word = self.keys[self.tokens]
        if order == 1:
            return word
        keys = mixed(self.before(word, pad), word)
        if order > 2:
            keys = self.before(keys, pad)  # the pairs themselves are not held any longer
            keys = mixed(keys, word)
        return keys

    def by_text(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, np.flatnonzero(self.first))

    def own(self, order: int, pad: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams, sorted by key, and how often training texts of this slice have them."""
        all_ = self.grams(order, pad)
        keys, n = np.unique(all_, return_counts=True)
        held, m = np.unique(all_[np.repeat(self.held_out, self.size)], return_counts=True)
        n[np.searchsorted(keys, held)] -= m
        return keys, n

    def requests(self, seed: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(order, keys, counts, checks of words): the distinct words and pairs."""
        pad = word_keys([PAD], seed, bits)[0][0]
        for order in ORDERS[:2]:
            keys, n = self.own(order, pad)
            checks = np.zeros(0, np.uint16)
            if order == 1:
                checks = np.zeros(len(keys), np.uint16)
                checks[np.searchsorted(keys, self.keys)] = self.checks
            yield order, keys, n, checks

    def shared_triples(self, shared: np.ndarray, pad: np.uint64) -> np.ndarray:
        """Whether other slices can have a distinct triple, from whether they have each distinct pair."""
        _, at = np.unique(self.grams(2, pad), return_inverse=True)
        pair = shared[at]
        pair &= self.before(pair, True)
        _, first = np.unique(self.grams(3, pad), return_index=True)
        return pair[first]

    def score(self, counts: dict[int, np.ndarray], shared: np.ndarray, seed: int, bits: int, tokens: int, types: int, docs: int, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base and score of each text, from the counts of the words, pairs and shared triples."""
        pad = word_keys([PAD], seed, bits)[0][0]

        def count(order: int) -> np.ndarray:
            found = counts.pop(order)
            if order > 2:
                at = self.shared_triples(shared, pad)
                _, n = self.own(order, pad)
                n[at] = found
                found = n
            _, at = np.unique(self.grams(order, pad), return_inverse=True)
            return found[at]

        last = count(3)  # before other arrays are held
        n = count(1)
        p = (n + 1) / (tokens + types + 1)
        known, base = self.by_text((n > 0).astype(np.int64)), self.by_text(np.log10(p))
        state = self.before(n, docs)  # the count of the context of one word before each token
        for order, weight in zip(ORDERS[1:], weights, strict=True):
            n = last if order > 2 else count(order)
            if order > 2:
                n[self.first] = 0  # the context of two words has not been entered
            shorter = p
            p = weight / (state + weight)  # the failure arc
            p *= shorter
            arc = n > 0
            p[arc] = (n[arc] + weight * shorter[arc]) / (state[arc] + weight)
            state = self.before(n, 0)
        return known, base, self.by_text(np.log10(p))


def write_slices(docs: DataFrame, seed: int, slice_tokens: int, bits: int) -> DataFrame:
    """Writes the texts as slices; returns their path, and the tokens and texts to learn from (a written table)."""
    folder = shared_dir(docs.sparkSession, "slices")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, doc_ids, held_out, size, tokens, total, n = Numbers({END: 0}), [], [], [], [], 0, 0
        kind = pa.null()

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{attempt_name(f'-{n}.arrow')}"
            out, sizes = np.array(held_out, bool), np.array(size, np.int64)
            Slice(doc_ids, out, sizes, np.concatenate(tokens), *word_keys(list(numbers), seed, bits)).write(path, kind)
            return pa.RecordBatch.from_pydict({"path": [path], "tokens": [int(sizes[~out].sum())], "docs": [int((~out).sum())]})

        for b in batches:
            kind = b.column("doc_id").type
            for doc_id, t, out in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("held_out").to_pylist(), strict=True):
                words = words_of(t.as_py())
                if total and total + len(words) > slice_tokens:
                    yield flush()
                    numbers, doc_ids, held_out, size, tokens, total, n = Numbers({END: 0}), [], [], [], [], 0, n + 1
                ids = np.zeros(len(words) + 1, np.int32)
                ids[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                doc_ids.append(doc_id)
                held_out.append(out)
                size.append(len(ids))
                tokens.append(ids)
                total += len(ids)
        if total:
            yield flush()

    return saved(docs.mapInArrow(write, "path string, tokens bigint, docs bigint"), "slice-index")


def dealt(index: DataFrame, slices: int) -> DataFrame:
    """One slice a row, spread over tasks."""
    return index.select("path").repartition(max(1, min(slices, 1 << 16)))


ASKED = "path string, order int, range bigint, keys binary, n binary, checks binary"
COUNTED = "path string, order int, range bigint, counts binary, shared binary, types bigint, clash boolean"


def request(path: str, order: int, ranges: int, below: int, keys: np.ndarray, n: np.ndarray, checks: np.ndarray) -> pa.RecordBatch:
    """A slice's sorted keys by key range, which is told by the 32 bits from ``below``."""
    place = ((keys >> np.uint64(below)) * np.uint64(ranges)) >> np.uint64(32)
    # Keys are sorted, so a range is a run of them.
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(place.astype(np.int64))) + 1, [len(keys)]]))
    rows: list[tuple] = []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        # Differences of sorted keys are smaller than keys.
        rows.append((path, order, int(place[i]), pack(np.diff(keys[i:j], prepend=np.uint64(0))), pack(n[i:j].astype(np.int64)), pack(checks[i:j])))
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "order", "range", "keys", "n", "checks"])


def add(group: pa.Table) -> pa.Table:
    """The counts of all slices for the keys of one range; each slice gets those it asked for."""
    order = group.column("order")[0].as_py()
    keys = [np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in group.column("keys")]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    # Counts are whole numbers; their sum is exact in floats below 2^53.
    total = np.bincount(at, np.concatenate([unpack(x.as_py(), np.int64) for x in group.column("n")]), len(distinct)).astype(np.int64)
    clash = False
    if order == 1:
        checks = np.concatenate([unpack(x.as_py(), np.uint16) for x in group.column("checks")])
        one = np.zeros(len(distinct), np.uint16)
        one[at] = checks
        clash = bool((one[at] != checks).any())
    several = np.bincount(at, minlength=len(distinct)) > 1 if order == 2 else np.zeros(0, bool)
    rows, end = [], 0
    for k in keys:
        mine, end = at[end : end + len(k)], end + len(k)
        rows.append((pack(total[mine]), pack(several[mine]) if order == 2 else b"", int((total > 0).sum()) if order == 1 and not rows else 0, clash))
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    return pa.table([*(group.column(c) for c in ("path", "order", "range")), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["path", "order", "range", "counts", "shared", "types", "clash"])


def joined(group: pa.Table, column: str, order: int, kind: type) -> np.ndarray:
    """A slice's numbers of all ranges, in the order of its keys."""
    rows = sorted((r, x) for o, r, x in zip(*(group.column(c).to_pylist() for c in ("order", "range", column)), strict=True) if o == order)
    return np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for _, x in rows)])


def by_slice(rows: DataFrame, slices: int):
    """Groups of one slice each. Their number of tasks is set, as their bytes say little of their work."""
    return rows.repartition(max(1, min(slices, 1 << 16)), "path").groupBy("path")


def counted(asked: DataFrame, ranges: int) -> DataFrame:
    """The counts of n-grams, a row for each request (a written table); tasks are as many as ranges of keys.

    ``types`` sums to the distinct words with a count; ``clash`` tells that two words have one key; ``shared`` tells of pairs
    whether several slices have them.
    """
    return saved(asked.repartition(min(ranges, 1 << 16), "order", "range").groupBy("order", "range").applyInArrow(add, COUNTED), "counts")


def words_and_pairs(index: DataFrame, slices: int, ranges: int, seed: int, bits: int) -> DataFrame:
    """The counts of the words and pairs of each slice."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                for order, keys, n, checks in Slice.read(path).requests(seed, bits):
                    yield request(path, order, ranges, bits - 32 if order == 1 else 32, keys, n, checks)

    return counted(dealt(index, slices).mapInArrow(ask, ASKED), ranges)


def triples(counts: DataFrame, slices: int, ranges: int, seed: int, bits: int) -> DataFrame:
    """The counts of the triples of each slice that others can have."""

    def ask(group: pa.Table) -> pa.Table:
        path, pad = group.column("path")[0].as_py(), word_keys([PAD], seed, bits)[0][0]
        part = Slice.read(path)
        at = part.shared_triples(joined(group, "shared", 2, bool), pad)
        keys, n = part.own(3, pad)
        return pa.Table.from_batches([request(path, 3, ranges, 32, keys[at], n[at], np.zeros(0, np.uint16))])

    return counted(by_slice(counts.where("order = 2").select("path", "order", "range", "shared"), slices).applyInArrow(ask, ASKED), ranges)


def score(docs: DataFrame, held_out: str = "held_out", weights: tuple[float, float] = (256.0, 2.0), slice_tokens: int = 3_000_000, range_bytes: int = 8 << 20, bits: int = 64, seeds: Iterable[int] = range(256)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of ``docs``.

    ``docs`` has doc_id, text and a boolean column that is true for rows not to learn from. ``weights`` are the priors'
    weights of contexts of one and two words. ``slice_tokens`` bounds the memory of a task, as does ``range_bytes``, the
    text for which there is one range of keys; neither changes a result, nor do the ``bits`` (32 to 64) of a word's key.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    ranges = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes
    for seed in seeds:
        index = write_slices(rows, seed, slice_tokens, bits)
        slices, n, n_docs = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
        counts = words_and_pairs(index, slices, ranges, seed, bits)
        v, clash = counts.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.max("clash"), F.lit(False))).first()
        if not clash:
            break
    else:
        raise ValueError("no seed tells the words apart")

    def answer(group: pa.Table) -> pa.Table:
        mine = {order: joined(group, "counts", order, np.int64) for order in ORDERS}
        part = Slice.read(group.column("path")[0].as_py())
        known, base, found = part.score(mine, joined(group, "shared", 2, bool), seed, bits, n, v, n_docs, weights)
        return pa.table({"doc_id": pa.array(part.doc_ids, schema_kind), "held_out": part.held_out, "n_tokens": part.size, "n_known": known, "train_tokens": np.full(len(known), n), "base_score": base, "score": found})

    from pyspark.sql.pandas.types import to_arrow_type

    schema_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    both = counts.unionByName(triples(counts, slices, ranges, seed, bits)).select("path", "order", "range", "counts", "shared")
    return by_slice(both, slices).applyInArrow(answer, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
