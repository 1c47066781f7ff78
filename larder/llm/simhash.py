"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: words are runs without ASCII white space, A-Z lower-cased; each shingle of ``size`` words (all of them where
there are fewer) votes with its XXH64; a bit is 1 where over half of the shingles, repeats included, have it. A text
without words has fingerprint 0. With ``wide`` > 1 the fingerprint has 64 x wide bits, by further mixes of the XXH64.

Links: two fingerprints within ``most`` bits. The bits are cut into segments on a ring, five to 64 bits. If the
differences sum to at most ``most``, some segment starts a chain in which the first l of m segments differ in at most
l * most / m bits, for every l. Fingerprints meet on (segment, its bits), and a pair goes on only while its running sums
keep within each budget; the last budget is the full Hamming check. With most = 4 and 64 bits the first segment of the
chain must be equal, so all links are found. For wide fingerprints chains that start with an unequal segment are missed
at that start; their budgets get ``slack`` deviations on top, and a pair within ``most`` has many starts to be found at.

``paired`` keys hold the next segment too, in all forms within its budget of one bit: 70 keys of 25 bits a fingerprint in
place of 5 of 13, the same links. They cost a larger shuffle and save comparisons, which grow with the square of the
number of fingerprints; ``near_duplicates`` uses them from ``PAIRED_FROM`` fingerprints on.

Within a meeting place a search over the members not yet reached yields a spanning forest, never all pairs, so a dense
group costs one edge a member. Places of over ``block`` members are dealt out as pairs of blocks. Copies share one
fingerprint and are one row before anything is compared. Only edges that close a cycle are left out.

Nulls: a null text has no words. A null doc_id takes part, and is never the smallest of a component that has another;
alone it is its own component (null). Repeated rows are linked like any copies. Empty
texts have the fingerprint zero; very long ones are read whole, one at a time. Links have no order, so there are no ties. No
documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import broadcast_if_small, saved, with_unique
from larder.llm.graph import components

SEED = 42
#: Shingles whose bits are counted at once: 255 fit an 8-bit sum.
RUN, CHUNK = 255, 255 * 64
PAIRED_FROM = 1 << 28
PER_WORD = 5


def mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash of each shingle: the XXH64 itself, then finalised mixes of it."""
    if not i:
        return h
    h = h + np.uint64((i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes | None, size: int = 4, wide: int = 1) -> bytes:
    """The 8 x wide bytes of a fingerprint, highest bit first in each 64."""
    words = (text or b"").lower().split()
    if not words:
        return bytes(8 * wide)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, k = ends - lengths, min(size, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    votes, digest = np.zeros(64 * wide, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        s, e = starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist()
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(s, e, strict=True)), np.uint64, len(s))
        raw = np.empty((len(h), wide), ">u8")
        for w in range(wide):
            raw[:, w] = mixed(h, w)
        bits = np.unpackbits(raw.view(np.uint8), axis=1)
        full = len(h) // RUN * RUN
        if full:
            votes += np.add.reduce(bits[:full].reshape(-1, RUN, 64 * wide), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        if full < len(h):
            votes += np.add.reduce(bits[full:], axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(starts)).tobytes()


def fingerprints(docs: DataFrame, size: int = 4, wide: int = 1) -> DataFrame:
    """doc_id, hash (of the text), fp (binary): a row for each row of ``docs`` (a written table)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py(), size, wide) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(fps, pa.binary())], ["doc_id", "hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    return saved(rows.mapInArrow(hashed, f"doc_id {kind}, hash bigint, fp binary"), "fingerprints")


def segments() -> list[tuple[int, int]]:
    """(shift, width) of the nearly equal segments of 64 bits."""
    out, at = [], 0
    for i in range(PER_WORD):
        width = 64 // PER_WORD + (i < 64 % PER_WORD)
        out.append((at, width))
        at += width
    return out


WIDTH = max(w for _, w in segments())


class Chains:
    """Budgets of the chains of a ring: for each first segment the words, masks and budget of some lengths."""

    def __init__(self, wide: int, most: int, slack: float) -> None:
        n = PER_WORD * wide
        self.wide, self.steps = wide, []
        lengths = sorted({*range(2, min(n, PER_WORD) + 1), *(PER_WORD << i for i in range(10) if PER_WORD << i < n), n})
        for first in range(n):
            steps = []
            for length in lengths:
                masks = np.zeros(wide, np.uint64)
                for k in range(first, first + length):
                    shift, width = segments()[k % n % PER_WORD]
                    masks[k % n // PER_WORD] |= np.uint64(((1 << width) - 1) << shift)
                mean = length * most / n
                words = np.flatnonzero(masks)
                steps.append((words, masks[words], most if length == n else int(mean + slack * mean**0.5)))
            self.steps.append(steps)

    def near(self, members: np.ndarray, a: np.ndarray, first: int) -> np.ndarray:
        """Places of the members whose chain with ``a`` from segment ``first`` keeps within every budget."""
        at = None
        for words, masks, budget in self.steps[first]:
            rows = members[:, words] if at is None else members[np.ix_(at, words)]
            ok = np.flatnonzero(np.bitwise_count((rows ^ a[words]) & masks).sum(1) <= budget)
            at = ok if at is None else at[ok]
            if not len(at):
                break
        return at

    def pairs(self, members: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for all pairs of a few members."""
        i, j = np.triu_indices(len(members), 1)
        for words, masks, budget in self.steps[first]:
            ok = np.bitwise_count((members[i][:, words] ^ members[j][:, words]) & masks).sum(1) <= budget
            i, j = i[ok], j[ok]
            if not len(i):
                break
        return i, j


#: Up to so many members a place is compared at once.
FEW = 128


def forest(members: np.ndarray, first: int, chains: Chains) -> Iterator[tuple[int, int]]:
    """Edges (places) of a spanning forest of the links among members that share segment ``first``."""
    if len(members) <= FEW:
        root = list(range(len(members)))
        for a, b in zip(*(x.tolist() for x in chains.pairs(members, first)), strict=True):
            i, j = a, b
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            if i != j:
                root[j] = i
                yield a, b
        return
    left, place = members, np.arange(len(members))
    while len(left) > 1:
        queue, left, place = [place[0]], left[1:], place[1:]
        while queue and len(left):
            a = queue.pop()
            near = chains.near(left, members[a], first)
            if len(near):
                found = place[near]
                left, place = np.delete(left, near, 0), np.delete(place, near)
                queue.extend(found)
                yield from ((int(a), int(x)) for x in found)


def unpacked(column: pa.Array, wide: int) -> np.ndarray:
    """Fingerprints as rows of ``wide`` numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, wide)


def segment(x: np.ndarray, i: int) -> np.ndarray:
    """The bits of the i-th segment of each fingerprint."""
    shift, width = segments()[i % PER_WORD]
    return ((x[:, i // PER_WORD] >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)


def links(fps: DataFrame, most: int = 4, wide: int = 1, slack: float = 0.0, block: int = 20_000, paired: bool = False) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) whose components are those of all links found."""
    chains = Chains(wide, most, slack)
    if paired and chains.steps[0][0][2] != 1:
        raise ValueError("paired keys are for a second segment within one bit")
    below = 2 * WIDTH if paired else WIDTH

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, fp = unpacked(b.column("fp"), wide), b.column("fp")
            for i in range(PER_WORD * wide):
                place = (i << WIDTH) + segment(x, i)
                flips = [0]
                if paired:
                    place = (place << WIDTH) + segment(x, (i + 1) % (PER_WORD * wide))
                    flips += [1 << b for b in range(segments()[(i + 1) % PER_WORD][1])]
                for flip in flips:
                    yield pa.RecordBatch.from_arrays([pa.array(place ^ flip), fp], ["place", "fp"])

    keys = fps.select("fp").mapInArrow(deal, "place bigint, fp binary")
    crowded = saved(keys.groupBy("place").count().where(F.col("count") > block).select("place", F.ceil(F.col("count") / block).alias("blocks")), "crowded")
    keys = keys.withColumn("cell", F.lit(0).cast("bigint"))
    if not crowded.isEmpty():
        own, other = F.pmod(F.xxhash64("fp"), F.col("blocks")), F.explode(F.expr("sequence(0L, coalesce(blocks, 1L) - 1)"))
        keys = keys.join(crowded, "place", "left").withColumn("_other", other).withColumn("_own", F.coalesce(own, F.lit(0)))
        keys = keys.withColumn("cell", F.least("_own", "_other") * (1 << 31) + F.greatest("_own", "_other"))
    keys = keys.select("place", "cell", "fp").repartition("place", "cell").sortWithinPartitions("place", "cell")

    def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """(place, members) of each place and cell with two members or more; one such group is held at a time."""
        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, wide), np.uint64)]
        for b in batches:
            if not b.num_rows:
                continue
            new = (b.column("place").to_numpy(), b.column("cell").to_numpy(), unpacked(b.column("fp"), wide))
            place, cell, fp = kept = [np.concatenate([old, x]) for old, x in zip(kept, new, strict=True)]
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (cell[1:] != cell[:-1])) + 1
            edges = np.concatenate([[0], cuts])
            for i in np.flatnonzero(np.diff(edges) > 1):
                yield int(place[edges[i]]), fp[edges[i] : edges[i + 1]]
            kept = [x[edges[-1] :] for x in kept]
        if len(kept[0]) > 1:
            yield int(kept[0][0]), kept[2]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, bytes]] = []
        for where, members in grouped(batches):
            raw = members.astype(">u8")
            found.extend((raw[i].tobytes(), raw[j].tobytes()) for i, j in forest(members, where >> below, chains))
            if len(found) >= 20_000:
                yield batch(found)
                found = []
        if found:
            yield batch(found)

    def batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["a", "b"])

    return keys.mapInArrow(search, "a binary, b binary")


def grouped_fingerprints(rows: DataFrame, most: int, wide: int, slack: float) -> DataFrame:
    """fp, root, best, n of each fingerprint that several rows or a link share (a written table).

    ``best`` is the first of its rows: none (whether its doc_id is null), doc_id, hash.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    distinct = saved(rows.groupBy("fp").agg(first.alias("best"), F.count(F.lit(1)).alias("n")), "distinct-fps")
    paired = wide == 1 and most == 4 and distinct.count() >= PAIRED_FROM
    roots = components(links(distinct, most, wide, slack, paired=paired))
    groups = distinct.join(roots, distinct.fp == roots.node, "left").where("n > 1 OR root IS NOT NULL")
    return saved(groups.select("fp", F.coalesce("root", "fp").alias("root"), "best", "n"), "groups")


def named(groups: DataFrame) -> DataFrame:
    """fp, first: for each fingerprint of a group the first row of the group (a written table)."""
    first = saved(groups.groupBy("root").agg(F.min("best").alias("first")), "firsts")
    return saved(with_unique(groups.select("fp", "root"), first, "root").select("fp", "first"), "named")


def near_duplicates(docs: DataFrame, size: int = 4, most: int = 4, wide: int = 1, slack: float = 0.0) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links): a row for each row of ``docs``."""
    rows = fingerprints(docs, size, wide)
    out = with_unique(rows, named(grouped_fingerprints(rows, most, wide, slack)), "fp", "left")
    # Any other document is its own component.
    return out.select("doc_id", "fp", F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, size: int = 5, most: int = 90, wide: int = 8, slack: float = 3.0) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest doc_id (nulls last), then of the smallest text hash.

    The defaults link texts whose five-word shingles overlap by 0.8 (Jaccard) or more: of 512 bits such a pair differs in
    77.6 by expectation, with a deviation of 8.1, or in fewer.
    """
    rows = fingerprints(docs, size, wide)
    judged = with_unique(rows, named(grouped_fingerprints(rows, most, wide, slack)), "fp")
    judged = judged.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash")))
    judged = saved(judged.groupBy("doc_id", "hash").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "judged")
    same = lambda table: docs["doc_id"].eqNullSafe(table["doc_id"]) & (F.xxhash64(docs["text"]) == table["hash"])
    goes = broadcast_if_small(saved(judged.where("NOT stays").select("doc_id", "hash"), "goes"))
    kept = docs.join(goes, same(goes), "left_anti")
    again = saved(judged.where("stays AND n > 1").select("doc_id", "hash"), "again")
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again)
    return kept.join(again, same(again), "left_anti").unionByName(kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))
