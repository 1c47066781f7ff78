"""Merkle manifest of a dataset: a tree over the rows of each group, a tree over the groups' roots, a proof for each row.

H is the lower-case hex SHA-256 of concatenated inputs, digests as hex text. The leaves of a group are in order; while
several nodes remain, every ``ARITY`` consecutive ones (the last run fewer, even one) become their H. The groups' roots, in
the order of the groups, likewise give the root. The proof of a row are its siblings from its leaf to the root.

1. Leaves are hashed where the rows lie. A range sort over (group, order) gives their places; a group may have any share.
2. Nodes above the leaves come from grouped aggregates of at most ``ARITY`` rows, a level at a time, up to the root; what
   lies above a block of ``ARITY ** (height * stack)`` leaves is followed down again as the block's upper proof.
3. A task walks through a block by fractal traversal. For each of ``stack`` heights it keeps an existing subtree, which gives
   siblings to the current leaf, and below the topmost a desired one, which takes one leaf a step from its own place ahead
   and replaces the existing one when that is used up. So a task holds stack * 2 * ARITY ** height nodes and the leaves of
   the longest way ahead, not the block. The block's upper proof is appended to each path.

Nulls: a null field is ``-``; a null group is a group of its own and comes first; null order values come first in a group.
Equal order values are ordered by their leaf, and rows equal in all are leaves of their own. Empty texts are values of no
bytes; very long texts are hashed whole and never shuffled. An empty table has no rows and no root. Columns that are no
field, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ranked, saved, with_unique

ARITY = 8
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def parents(nodes: DataFrame) -> DataFrame:
    """The nodes (tree, n, place, digest) one level up, n the nodes of that level, with the run below each.

    The one node of a finished tree is carried up as it is.
    """
    run = F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
    up = nodes.groupBy("tree", "n", F.floor(F.col("place") / ARITY).alias("at")).agg(run.alias("run"))
    digest = F.when(F.col("n") == 1, F.col("run")[0]).otherwise(F.unhex(F.sha2(F.array_join(F.transform("run", as_hex), ""), 256)))
    return up.select("tree", F.ceil(F.col("n") / ARITY).alias("n"), F.col("at").alias("place"), digest.alias("digest"), "run", (F.col("n") == 1).alias("carried"))


def to_top(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes`` and all levels above until each tree, of at most ``most`` nodes, has one."""
    levels = [nodes]
    while most > 1:
        levels.append(saved(parents(levels[-1].select("tree", "n", "place", "digest")), "manifest-level"))
        most = -(-most // ARITY)
    return levels


def down(paths: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The paths (tree, place, path) of the nodes of the lowest level, from those of the highest."""
    side = lambda a, n: F.array_join(F.transform(F.slice("run", a, n), as_hex), "")
    for level in reversed(levels[1:]):
        below = level.join(paths, ["tree", "place"]).select("tree", "place", "path", "run", "carried", F.posexplode("run").alias("pos", "_digest"))
        own = F.array(F.struct(side(F.lit(1), F.col("pos")).alias("left"), side(F.col("pos") + 2, F.lit(ARITY)).alias("right")))
        path = F.when(F.col("carried"), F.col("path")).otherwise(F.concat(own, F.col("path")))
        paths = below.select("tree", (F.col("place") * ARITY + F.col("pos")).alias("place"), path.alias("path"))
    return paths


def digest_of(nodes: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Subtree:
    """Nodes of the heights low .. high - 1 over consecutive leaves that are added one at a time.

    Below ``low`` only the open run of each height is held.
    """

    def __init__(self, low: int, high: int) -> None:
        self.low, self.rows = low, [[] for _ in range(high)]

    def push(self, node: bytes, height: int = 0) -> None:
        row = self.rows[height]
        row.append(node)
        if height + 1 < len(self.rows) and len(row) % ARITY == 0:
            self._join(height, ARITY)

    def _join(self, height: int, n: int) -> None:
        row = self.rows[height]
        parent = digest_of(row[-n:])
        if height < self.low:
            row.clear()
        self.push(parent, height + 1)

    def closed(self) -> Subtree:
        """With the last runs, which are shorter, joined as well."""
        for height in range(len(self.rows) - 1):
            if rest := len(self.rows[height]) % ARITY:
                self._join(height, rest)
        return self

    def siblings(self, at: int, height: int) -> tuple[bytes, bytes]:
        """Those left and right of the node over the leaf ``at`` of this subtree."""
        row, i = self.rows[height], at // ARITY**height
        first = i - i % ARITY
        return b"".join(row[first:i]), b"".join(row[i + 1 : first + ARITY])


def traverse(leaves: Iterator[tuple[bytes, object]], tops: Sequence[bytes], levels: int, height: int, stack: int) -> Iterator[tuple[bytes, object, list[tuple[bytes, bytes]]]]:
    """Each leaf of a block and what came with it, with its path of ``levels`` pairs of siblings.

    ``tops``: the block's nodes at the lowest height of its topmost subtree.
    """
    spans = [ARITY ** (height * i) for i in range(1, stack)]
    ahead = spans[-1] if spans else 1
    top = Subtree(height * (stack - 1), height * stack)
    for node in tops:
        top.push(node, top.low)
    top.closed()
    exist, desired = [None] * len(spans), [Subtree(height * i, height * (i + 1)) for i in range(len(spans))]
    window: list[tuple[bytes, object]] = []

    def fill(n: int) -> None:
        while len(window) < n and (more := next(leaves, None)) is not None:
            window.append(more)

    fill(ahead)
    for i, span in enumerate(spans):
        for node, _ in window[:span]:
            desired[i].push(node)
    at = base = 0  # the current leaf, and the one that the window begins with
    while True:
        for i, span in enumerate(spans):
            if at % span == 0:
                exist[i], desired[i] = desired[i].closed(), Subtree(height * i, height * (i + 1))
        if at == base + ahead:
            del window[:ahead]
            base = at
        fill(at - base + ahead + 1)
        if at - base >= len(window):
            return
        path = []
        for k in range(levels):
            i = k // height
            path.append(top.siblings(at, k) if i == len(spans) else exist[i].siblings(at % spans[i], k))
        yield *window[at - base], path
        for i, span in enumerate(spans):
            if at - base + span < len(window):
                desired[i].push(window[at - base + span][0])
        at += 1


def folded(leaf_hex: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf_hex = digest_of((left, leaf_hex, right))
    return leaf_hex


def tree_height(n: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def prove(rows: DataFrame, tree: str, order: str, height: int = 2, stack: int = 2, proofs: bool = False) -> DataFrame:
    """``order``, leaf, subroot, root, proof_sha256, folded_root for each row of ``rows``.

    ``rows`` has the columns ``tree`` (the group), ``order``, leaf and claimed, the digest that is folded along the proof; a
    null one is the leaf. ``proofs`` adds the proof itself, its siblings from leaf to root as one text.
    """
    block = ARITY ** (height * stack)
    given = saved(rows.select(F.struct(tree).alias("_tree"), F.col(order).alias("_order"), "leaf", "claimed", F.monotonically_increasing_id().alias("_row")), "manifest-leaves")
    placed = ranked(given, F.asc_nulls_first("_tree"), F.asc_nulls_first("_order"), F.asc("leaf"), F.asc("_row"))
    trees = saved(placed.groupBy("_tree").agg(F.min("rank").alias("tree"), F.count(F.lit(1)).alias("n")), "manifest-trees")
    most, count = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    placed = with_unique(placed, trees, "_tree").select("tree", "n", (F.col("rank") - F.col("tree")).alias("place"), "_order", "leaf", "claimed")

    # Nodes at the foot of the topmost subtrees, then the blocks' roots and what lies above them.
    def raised(nodes: DataFrame, levels: int) -> DataFrame:
        for _ in range(levels):
            nodes = parents(nodes).select("tree", "n", "place", "digest")
        return nodes

    tops = saved(raised(placed.select("tree", "n", "place", F.col("leaf").alias("digest")), height * (stack - 1)), "manifest-tops")
    levels = to_top(saved(raised(tops, height), "manifest-blocks"), -(-(most or 1) // block))
    subroots = levels[-1].select("tree", F.col("digest").alias("subroot"))
    forest = ranked(subroots, F.asc("tree"), name="place")
    forest = to_top(forest.select(F.lit(0).alias("tree"), F.lit(count).alias("n"), "place", F.col("subroot").alias("digest"), F.col("tree").alias("of")), count)
    root = forest[-1].select("digest").first()
    upper = down(forest[-1].select("tree", "place", F.array().cast(PATH).alias("path")), [x.withColumn("tree", F.lit(0)) for x in forest])
    upper = upper.join(forest[0].select("place", F.col("of"), F.col("digest").alias("subroot")), "place").select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("place"), "path", "subroot")
    subroots = upper.select("tree", "subroot")
    upper = down(upper.select("tree", "place", "path"), levels).join(subroots, "tree")
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
    heads = tops.groupBy("tree", F.floor(F.col("place") / ARITY**height).alias("block")).agg(nodes.alias("tops"))
    heads = heads.join(upper.withColumnRenamed("place", "block"), ["tree", "block"])

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kind = rows.schema[order].dataType
    heads = heads.select("tree", "block", F.lit(-1).cast("bigint").alias("place"), none("bigint", "n"), none(kind, "_order"), none("binary", "leaf"), none("binary", "claimed"), "tops", "path", "subroot")
    leaves = placed.select("tree", F.floor(F.col("place") / block).alias("block"), "place", "n", "_order", "leaf", "claimed", none("array<binary>", "tops"), none(PATH, "path"), none("binary", "subroot"))
    dealt = leaves.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    names = [order, "leaf", "subroot", "root", "proof_sha256", "folded_root", *["proof"] * proofs]
    root_hex, inner = root[0].hex() if root else "", height * stack
    order_type = pa_type(kind)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("place", "n", "_order", "leaf", "claimed", "tops", "path", "subroot")), strict=True))
        head = next(rows, None)
        while head is not None:
            _, _, _, _, _, tops, above, subroot = head
            first, after = next(rows), []

            def block_leaves(first=first, after=after):
                r = first
                while r is not None and r[0] >= 0:
                    yield r[3].hex().encode(), (r[2], r[4])
                    r = next(rows, None)
                after.append(r)

            above = [(x["left"].encode(), x["right"].encode()) for x in above]
            for leaf_hex, (key, claimed), path in traverse(block_leaves(), [x.hex().encode() for x in tops], min(inner, tree_height(first[1])), height, stack):
                path += above
                siblings = b"".join(x for pair in path for x in pair)
                end = folded(claimed.hex().encode() if claimed is not None else leaf_hex, path)
                out.append((key, leaf_hex.decode(), subroot.hex(), root_hex, hashlib.sha256(siblings).hexdigest(), end.decode(), *[siblings.decode()] * proofs))
                if len(out) >= 1000:
                    yield batch_of(out)
                    out.clear()
            head = after[0]
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], order_type), *(pa.array(c, pa.string()) for c in columns[1:])], names)

    return dealt.mapInArrow(walk, ", ".join([f"`{order}` {kind.simpleString()}", *(f"{c} string" for c in names[1:])]))


def pa_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
