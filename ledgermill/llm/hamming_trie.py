"""Links of 64-bit fingerprints at a small Hamming distance, by a self-join of their binary trie.

Pairs of nodes of one depth are visited together, from the pair (root, root) on. A pair carries the bits
in which its two paths differ, and is left as soon as they exceed the budget, or when one side is empty.

Of two fingerprints at distance r or less, one half of the bits differs in r // 2 places or less. So the
trie is walked twice, once with either half on top, and in the top half a pair may differ in r // 2 bits
only, in all in r: far fewer pairs of nodes than r differences near the root would leave.

The top of the trie is walked by Spark: a fingerprint is dealt to the pairs of nodes that it can meet others
in, by masks of few bits. Pairs of nodes that are small enough go to a task, which walks on with numpy arrays;
larger ones are walked down some levels more by another round. At the lowest level a node is one fingerprint, so
rounds end. A task returns a spanning forest of the links it finds, fewer edges than it has fingerprints,
so a dense cloud of near fingerprints is never expanded into all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.shared import stage

BITS = 64
#: Fingerprints of a node where Spark's first round ends, on average.
NODE_ROWS = 4096
#: Fingerprints of a pair of nodes that a task may walk.
TASK_ROWS = 1 << 17
#: Levels that a further round walks down.
STEP = 8
#: Pairs of nodes that a task handles at once.
CHUNK = 1 << 18
#: Pairs of nodes with at most so many pairs of fingerprints are compared directly.
LEAF_PAIRS = 32

_EDGES, _EDGES_DDL = pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long"


def budget(depth: int, radius: int) -> int:
    """Bits in which the paths of a pair of nodes may differ."""
    return radius if depth > BITS // 2 else radius // 2


def hamming_links(fingerprints: DataFrame, radius: int, node_rows: int = NODE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Edges (a, b) whose connected components are those of all pairs of the distinct longs ``fp`` at distance <= radius."""
    n_rows = fingerprints.count()
    depth = min(max(0, (max(1, n_rows) // node_rows).bit_length()), BITS // 2)
    turned = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fp").alias("path")), F.struct(F.lit(1).alias("turn"), F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)").alias("path"))))
    rows = fingerprints.select(turned.alias("x")).select("x.turn", "x.path", F.lit(0).alias("differ"), F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), F.lit(2).alias("side"))
    found, done, at = None, 0, depth
    while True:
        rows = stage(_descend(rows, done, at, radius))
        key = ("turn", "left", "right")
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("pair_rows"), F.count_if(F.col("side") != 1).alias("n_left"), F.count_if(F.col("side") != 0).alias("n_right"))
        # a pair with an empty side, or of one fingerprint with itself, holds no link
        sizes = stage(sizes.where("n_left > 0 AND n_right > 0 AND pair_rows > 1"))
        small = rows.join(sizes.where(F.col("pair_rows") <= task_rows).select(*key), list(key))
        edges = small.groupBy(*key).applyInArrow(_walker(at, radius), _EDGES_DDL)
        found = edges if found is None else found.unionByName(edges)
        large = sizes.where(F.col("pair_rows") > task_rows).select(*key)
        if at == BITS or large.isEmpty():
            return found
        rows, done, at = rows.join(large, list(key)), at, min(BITS // 2 if at < BITS // 2 else BITS, at + STEP)


def _descend(rows: DataFrame, done: int, at: int, radius: int) -> DataFrame:
    """rows of pairs of nodes at depth ``done`` dealt to the pairs below them at depth ``at``: a row goes to each node that its own may differ from."""
    if at == done:
        return rows
    width, most = at - done, budget(at, radius)
    masks = [(sum(1 << i for i in bits), n) for n in range(most + 1) for bits in combinations(range(width), n)]
    table = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("n")) for m, n in masks))
    step = F.shiftrightunsigned(F.col("path"), BITS - at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    dealt = rows.withColumn("m", F.explode(table)).where(F.col("differ") + F.col("m.n") <= most).withColumn("own", step).withColumn("other", step.bitwiseXOR(F.col("m.mask")))
    down = lambda node, bits: F.shiftleft(F.col(node), width).bitwiseOR(F.col(bits))
    # side 0 stands left, 1 right, 2 on both sides; a pair of a node with itself splits into pairs whose left node is the smaller
    is_left = (F.col("side") == 0) | ((F.col("side") == 2) & (F.col("own") <= F.col("other")))
    side = F.when((F.col("side") == 2) & (F.col("m.n") == 0), F.lit(2)).when(is_left, F.lit(0)).otherwise(F.lit(1))
    left = F.when(is_left, down("left", "own")).otherwise(down("left", "other"))
    right = F.when(is_left, down("right", "other")).otherwise(down("right", "own"))
    return dealt.select("turn", "path", (F.col("differ") + F.col("m.n")).alias("differ"), left.alias("left"), right.alias("right"), side.alias("side"))


def _walker(depth: int, radius: int):
    def walk(table: pa.Table) -> pa.Table:
        path = table.column("path").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        turn, differ = table.column("turn")[0].as_py(), table.column("differ")[0].as_py()
        both = side[0] == 2
        left = np.sort(path[side != 1])
        right = left if both else np.sort(path[side == 1])
        nodes = left if both else np.concatenate([left, right])
        roots = _Forest(len(nodes))
        for i, j in near_pairs(left, right, both, depth, differ, radius):
            roots.unite(i, j if both else j + len(left))
        a, b = roots.edges()
        ends = [x if turn == 0 else (x << np.uint64(32)) | (x >> np.uint64(32)) for x in (nodes[a], nodes[b])]
        return pa.table([pa.array(x.view(np.int64)) for x in ends], schema=_EDGES)

    return walk


def near_pairs(left: np.ndarray, right: np.ndarray, same: bool, depth: int, differ: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays of the pairs at distance <= radius of two sorted arrays that are nodes of one depth; of an array with itself, each pair once."""
    if not len(left) or not len(right):
        return
    whole = np.array([[0, len(left), 0, len(right), differ]], dtype=np.int64).T
    todo = [(depth, whole)]
    while todo:
        level, pairs = todo.pop()
        if pairs.shape[1] > CHUNK:
            half = pairs.shape[1] // 2
            todo += [(level, pairs[:, half:]), (level, pairs[:, :half])]
            continue
        n_left, n_right = pairs[1] - pairs[0], pairs[3] - pairs[2]
        leaf = (n_left * n_right <= LEAF_PAIRS) | (level == BITS)
        if leaf.any():
            i, j = _expand(pairs[:4, leaf])
            near = np.bitwise_count(left[i] ^ right[j]) <= radius
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if not leaf.all():
            todo.append((level + 1, _children(left, right, same, level, pairs[:, ~leaf], radius)))


def _children(left: np.ndarray, right: np.ndarray, same: bool, level: int, pairs: np.ndarray, radius: int) -> np.ndarray:
    """The pairs of children within the budget, with both sides filled."""
    a_lo, a_hi, b_lo, b_hi, differ = pairs
    bit = np.uint64(1 << (BITS - 1 - level))
    above = ~np.uint64((1 << (BITS - level)) - 1) if level else np.uint64(0)
    a_mid = np.searchsorted(left, (left[a_lo] & above) | bit)
    b_mid = np.searchsorted(right, (right[b_lo] & above) | bit)
    twin = (a_lo == b_lo) & same  # a node with itself: its two children meet once
    most = budget(level + 1, radius)
    groups = [(a_lo, a_mid, b_lo, b_mid, differ), (a_mid, a_hi, b_mid, b_hi, differ), (a_lo, a_mid, b_mid, b_hi, differ + 1), (a_mid, a_hi, b_lo, b_mid, np.where(twin, radius + 1, differ + 1))]
    out = []
    for lo, hi, low, high, count in groups:
        keep = (lo < hi) & (low < high) & (count <= most)
        out.append(np.stack([x[keep] for x in (lo, hi, low, high, count)]))
    return np.concatenate(out, axis=1)


def _expand(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of pairs of ranges."""
    a_lo, a_hi, b_lo, b_hi = pairs
    width, count = b_hi - b_lo, (a_hi - a_lo) * (b_hi - b_lo)
    which = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return a_lo[which] + place // width[which], b_lo[which] + place % width[which]


class _Forest:
    """Disjoint sets of 0..n-1: every node points to the least of its set once ``edges`` is called."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            if not apart.any():
                return
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, high, low)
            self._flatten()
            a, b = low, high

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        below = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return below, self.parent[below]
