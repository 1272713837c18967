"""SimHash fingerprints, linked within a Hamming distance through a Gray-order hierarchical index.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64
hashes (seed 42) of the text's word shingles. Distinct fingerprints are spread by
the bits of some blocks: of ``radius + 1`` equal blocks two fingerprints within the
radius share one, so each block value is searched on its own and no link is lost.
Within a block value the fingerprints are sorted by Gray rank and an index is built
over them: a node covers ``FANOUT`` neighbours, keeps the bits in which all of them
agree as a masked pattern, and a child keeps only what its parent has not settled.
A query goes down with the differences it has gathered; a node beyond the radius
goes with all that it covers. What is found is merged to a forest on the spot, so
that a group of n fingerprints gives n - 1 edges at most, not all its pairs.

Defined results: null and empty texts and texts without words have fingerprint 0 and
are linked with each other like any other; rows with a null id keep their row and
take part in no link; repeated rows repeat their result; an empty table gives an
empty result; other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_group, checkpointed, counted

BITS = 64
FANOUT = 8
PAIRS_AT_ONCE = 1 << 20
SHINGLES_AT_ONCE = 1 << 16
EDGES_AT_ONCE = 1 << 18


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
        starts = [0, *[e + 1 for e in ends[: len(ends) - shingle]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    ones = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = np.array(hashes[low : low + SHINGLES_AT_ONCE], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    majority = ones * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over codes that are sorted by (group, Gray rank)."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray, fanout: int = FANOUT):
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        size = np.diff(np.r_[first, len(codes)])
        alike_and = alike_or = codes
        # From the leaves up: pattern and mask of each level, and the first child of each node.
        levels = [(codes, np.full(len(codes), ~np.uint64(0)), None, np.arange(1, len(codes) + 1))]
        while size.max(initial=0) > 1:
            nodes = -(-size // fanout)
            start = np.repeat(first, nodes) + fanout * (np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes))
            alike_and = np.bitwise_and.reduceat(alike_and, start)
            alike_or = np.bitwise_or.reduceat(alike_or, start)
            mask = ~(alike_and ^ alike_or)
            child_end = np.r_[start[1:], len(levels[-1][0])]
            levels.append((alike_and & mask, mask, start, levels[-1][3][child_end - 1]))
            first, size = np.cumsum(nodes) - nodes, nodes
        self.levels = []
        above = None
        for pattern, mask, start, end in reversed(levels):
            own = mask if above is None else mask & ~np.repeat(above[1], np.diff(np.r_[above[2], len(mask)]))
            self.levels.append((pattern, own, start, end))
            above = (pattern, mask, start)
        self.root = np.repeat(np.arange(len(size)), np.diff(np.r_[np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]), len(codes)]))
        self.codes = codes

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places a < b of one group whose codes differ in ``radius`` bits at most."""
        step = 4096
        for low in range(0, len(self.codes), step):
            query = np.arange(low, min(low + step, len(self.codes)))
            yield from self._down(0, query, self.root[query], np.zeros(len(query), np.int64), radius)

    def _down(self, depth: int, query, node, so_far, radius: int):
        pattern, own, start, end = self.levels[depth]
        so_far = so_far + np.bitwise_count((self.codes[query] ^ pattern[node]) & own[node])
        near = (so_far <= radius) & (end[node] > query + 1)
        query, node, so_far = query[near], node[near], so_far[near]
        if depth == len(self.levels) - 1:
            if len(query):
                yield query, node
            return
        below = len(self.levels[depth + 1][0])
        children = np.r_[start[1:], below][node] - start[node]
        for low in _blocks(children):
            part = slice(*low)
            n = children[part]
            child = np.repeat(start[node[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield from self._down(depth + 1, np.repeat(query[part], n), child, np.repeat(so_far[part], n), radius)


def _blocks(children: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds the pairs that are expanded at once."""
    step = PAIRS_AT_ONCE // FANOUT
    for low in range(0, len(children), step):
        yield low, min(low + step, len(children))


def merged(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the links (a, b) into a forest of smallest places."""
    while len(a):
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if not (low != high).any():
            break
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def near_edges(reps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges ``u > v`` between nodes (``node``, ``fp``) whose links join what lies within the radius."""
    blocks = radius + 1
    width = BITS // blocks
    keys = F.array(*[F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1) + (k << width) for k in range(blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "key"):
            key, node = table.column("key").to_numpy(), table.column("node").to_numpy()
            code = table.column("fp").to_numpy().view(np.uint64)
            order = np.lexsort((gray_rank(code), key))
            key, node, code = key[order], node[order], code[order]
            alone = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True]
            key, node, code = key[~alone], node[~alone], code[~alone]
            if not len(key):
                continue
            parent = np.arange(len(key))
            for a, b in GrayIndex(code, key).links(radius):
                parent = merged(parent, a, b)
            least = np.full(len(key), np.iinfo(np.int64).max)
            np.minimum.at(least, parent, node)
            v = least[parent]
            far = v != node
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(v[far])], ["u", "v"])

    spread = reps.where("node is not null").select("node", "fp", F.explode(keys).alias("key"))
    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task to stars: each node with the smallest one that they join it to."""

    def joined(u: list[np.ndarray], v: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        nodes, place = np.unique(np.concatenate([*u, *v]), return_inverse=True)
        half = len(place) // 2
        parent = merged(np.arange(len(nodes)), place[:half], place[half:])
        far = parent != np.arange(len(nodes))
        return nodes[far], nodes[parent[far]]

    us, vs, n = [], [], 0
    for batch in batches:
        us.append(batch.column("u").to_numpy())
        vs.append(batch.column("v").to_numpy())
        n += batch.num_rows
        if n >= 2 * EDGES_AT_ONCE:
            u, v = joined(us, vs)
            us, vs, n = [u], [v], len(u)
            if n >= EDGES_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                us, vs, n = [], [], 0
    if n:
        u, v = joined(us, vs)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for each node of ``edges`` (u > v).

    Edges are first joined to stars within tasks of ``EDGES_AT_ONCE`` at most. If there are more tasks than one, large-star and
    small-star alternate: neighbours are hung below the smallest
    one until each component is a star. A round is a few joins; the rounds grow with
    the logarithm of the longest path. Each round is checkpointed.
    """
    edges, n = counted(edges)
    tasks = max(1, -(-n // EDGES_AT_ONCE))
    edges = checkpointed(edges.coalesce(tasks).mapInArrow(_forest, "u long, v long"))
    seen = None
    for _ in range(most_rounds if tasks > 1 else 0):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, large.u == least.w)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.*").where("u <> v").distinct())
    else:
        if tasks > 1:
            raise RuntimeError(f"no stars after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row."""
    known = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    reps = known.groupBy("fp").agg(F.min("doc_id").alias("node"))
    roots = components(near_edges(reps, radius))
    groups = reps.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    named = known.join(groups, "fp")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component)
