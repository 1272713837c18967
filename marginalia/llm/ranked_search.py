"""Ranked lexical search: K2-treaps over grids of terms and documents.

An index row is a shard: some documents (``SHARD_BYTES`` of text), its terms and a K2-treap of their grid.
Rows of the grid are terms, frequent ones first; columns are documents, short ones first; a point is
a term's impact on a document. A treap node is a quadrant that holds its largest point, which is taken out before what remains is
parted in four. So a node stands for one point, values fall downwards, and a node is
stored as a four-bit mask of its children, the difference to its parent's value and its point's place within
the quadrant.

A search descends from the root with all of an item's rows at once. A state is a range of documents
with one node, or none, for each row; its bound is the weighted sum of the larger of that node's value and the points of the row
already taken out above. The states with the highest bounds are halved first, ``WAVE`` at a time; a range of one document has
its exact score; states below the k-th best score so far, of all shards that the task has seen, are dropped. All
numbers are whole, so results are exact.

Impacts need the number of documents and of terms, which a first pass counts. Building is a map; what is
shuffled is frequencies of items' terms and k hits a task. Items come in blocks of ``BLOCK_TERMS``
terms, which are broadcast if they are few and joined by number if not.

Defined results: null and empty texts have no terms and are counted nowhere; a very long text is a document, in a shard of its own
if need be; an item is all rows of its item_id, a null one included, with each term once; an item without a known term has no hits;
repeated rows of documents are hits of their own; of equal scores the smaller doc_id comes first, null last;
an empty table gives an empty result; columns besides ids and texts are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, remove, shared_folder

TOP = 10
SHARD_BYTES = 12 << 20
SHARD_DOCS = 1 << 13
WAVE = 128
BLOCK_TERMS = 1 << 16
#: Blocks of items that are broadcast together: some 4 MB each.
BROADCAST_BLOCKS = 8
#: A term is a run of bytes that are letters, digits or above ASCII. Others become spaces, A-Z become a-z, other bytes stay.
_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 if b < 128 else b for b in range(256))


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """How many terms each text has, and all of them in order."""
    words = pc.ascii_split_whitespace(pa.array([t.translate(_BYTES) for t in texts], pa.binary()).view(pa.string()))
    flat = words.flatten()
    # White space at an end of a text leaves an empty word there.
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return np.diff(before[words.offsets.to_numpy()]), flat.filter(real)


def spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2**31 at every other place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def gathered(x: np.ndarray) -> np.ndarray:
    """The inverse of ``spread``."""
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


def _width(most: int) -> str:
    return next(f"<u{n}" for n in (1, 2, 4, 8) if most < 1 << 8 * n)


def build_treap(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, bits: int) -> bytes:
    """Serialised treap of points on a grid of 2**bits rows and columns, level by level."""
    z = (spread(rows) << np.uint64(1)) | spread(columns)
    order = np.argsort(z, kind="stable")
    z, values = z[order], values[order]
    cells, most, place = [], [], []
    for level in range(bits + 1):
        if not len(z):
            break
        cell = z >> np.uint64(2 * (bits - level))
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(z))))
        top = np.maximum.reduceat(values, starts)
        at = np.flatnonzero(values == top[group])
        at = at[np.concatenate([[True], group[at][1:] != group[at][:-1]])]
        cells.append(cell[starts])
        most.append(top)
        place.append(z[at])
        stays = np.ones(len(z), bool)
        stays[at] = False
        z, values = z[stays], values[stays]
    out = [np.array([bits, *map(len, cells)], "<i8").tobytes()]
    head = [len(cells)]
    for level, cell in enumerate(cells):
        mask = np.zeros(len(cell) + len(cell) % 2, np.uint8)
        if level + 1 < len(cells):
            above = np.searchsorted(cell, cells[level + 1] >> np.uint64(2))
            np.bitwise_or.at(mask, above, np.uint8(1) << (cells[level + 1] & np.uint64(3)).astype(np.uint8))
        parent = np.searchsorted(cells[level - 1], cell >> np.uint64(2)) if level else None
        less = most[level - 1][parent] - most[level] if level else most[0]
        inside = place[level] & np.uint64((1 << 2 * (bits - level)) - 1)
        for x in (less, inside):
            width = _width(int(x.max()))
            head.append(int(width[2]))
            out.append(x.astype(width).tobytes())
        out.append((mask[::2] | (mask[1::2] << 4)).tobytes())
    return np.array(head, "<i4").tobytes() + b"".join(out)


_ONES = np.array([bin(m).count("1") for m in range(16)], np.int64)


class Treap:
    """A treap read again. Nodes are numbered level by level: value, row and column of the point, mask, first child."""

    def __init__(self, raw: bytes):
        levels = int(np.frombuffer(raw, "<i4", 1)[0])
        widths = np.frombuffer(raw, "<i4", 2 * levels, 4).tolist()
        at = 4 * (1 + 2 * levels)
        self.bits, *sizes = np.frombuffer(raw, "<i8", 1 + levels, at).tolist()
        at += 8 * (1 + levels)
        values, places, masks, cells = [], [], [], None
        for level, n in enumerate(sizes):
            less = np.frombuffer(raw, f"<u{widths[2 * level]}", n, at).astype(np.int64)
            at += n * widths[2 * level]
            inside = np.frombuffer(raw, f"<u{widths[2 * level + 1]}", n, at).astype(np.uint64)
            at += n * widths[2 * level + 1]
            packed = np.frombuffer(raw, np.uint8, (n + 1) // 2, at)
            at += (n + 1) // 2
            mask = np.stack([packed & 15, packed >> 4], 1).ravel()[:n]
            if level:
                quadrant = np.nonzero((before[:, None] >> np.arange(4)) & 1)  # noqa: F821
                cells = (cells[quadrant[0]] << np.uint64(2)) | quadrant[1].astype(np.uint64)
                less = values[-1][quadrant[0]] - less
            else:
                cells = np.zeros(n, np.uint64)
            before = mask
            values.append(less)
            places.append((cells << np.uint64(2 * (self.bits - level))) | inside)
            masks.append(mask)
        self.value = np.concatenate(values) if values else np.zeros(0, np.int64)
        place = np.concatenate(places) if places else np.zeros(0, np.uint64)
        self.row, self.column = gathered(place >> np.uint64(1)), gathered(place)
        self.mask = np.concatenate(masks).astype(np.int64) if masks else np.zeros(0, np.int64)
        self.first = 1 + np.concatenate([[0], np.cumsum(_ONES[self.mask])])[:-1]

    def child(self, nodes: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Numbers of children; -1 where there is none."""
        mask = self.mask[nodes]
        there = (nodes >= 0) & ((mask >> quadrant) & 1 == 1)
        return np.where(there, self.first[nodes] + _ONES[mask & ((1 << quadrant) - 1)], -1)


class Best:
    """The k best hits: scores and ids, of equal scores the smaller id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.hits: list[tuple[int, bool, int]] = []

    @property
    def least(self) -> int:
        return -self.hits[-1][0] if len(self.hits) == self.k else 1

    def add(self, scores: list[int], ids: list[int | None]) -> None:
        self.hits = sorted([*self.hits, *((-s, i is None, i or 0) for s, i in zip(scores, ids, strict=True))])[: self.k]


def descend(treap: Treap, rows: np.ndarray, weights: np.ndarray, ids: list[int | None], best: Best, wave: int = WAVE) -> int:
    """Adds the best documents of a shard for one item; the number of states looked at."""
    bits, columns = treap.bits, max(1, len(ids) - 1).bit_length()
    t = len(rows)
    # Points taken out so far: for each row a tree of maxima over the documents.
    taken = np.zeros((t, 2 << columns), np.int64)
    flat, own = taken.ravel(), np.arange(t) * (2 << columns)

    def look(nodes: np.ndarray, level: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Bounds of states; points of the rows themselves are taken out."""
        at = np.maximum(nodes, 0)
        value = np.where(nodes >= 0, treap.value[at], 0)
        s, k = np.nonzero((nodes >= 0) & (treap.row[at] == rows))
        if len(s):
            n = nodes[s, k]
            leaf, points = (1 << columns) + treap.column[n], treap.value[n]
            k = k * (2 << columns)
            for up in range(columns + 1):
                np.maximum.at(flat, k + (leaf >> up), points)
        depth = np.maximum(0, columns - (bits - level))
        place = np.where(depth > 0, (1 << depth) + column, 1)
        return (np.maximum(value, flat[own[None, :] + place[:, None]]) * weights).sum(axis=1)

    nodes, level, column = np.zeros((1, t), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = look(nodes, level, column)
    looked = 1
    while len(bound):
        if len(bound) > wave:
            first = np.argpartition(-bound, wave)
            now, later = first[:wave], first[wave:]
        else:
            now, later = np.arange(len(bound)), np.zeros(0, np.int64)
        ends = level[now] == bits
        if ends.any():
            done = now[ends]
            best.add(bound[done].tolist(), [ids[c] for c in column[done].tolist()])
            now = now[~ends]
        half = 2 * ((rows[None, :] >> (bits - 1 - level[now])[:, None]) & 1)
        below = np.concatenate([treap.child(nodes[now], half), treap.child(nodes[now], half + 1)])
        down = np.concatenate([level[now], level[now]]) + 1
        across = np.concatenate([2 * column[now], 2 * column[now] + 1])
        # Ranges beyond the last document are none.
        real = across << (bits - down) < len(ids)
        below, down, across = below[real], down[real], across[real]
        fresh = look(below, down, across)
        looked += len(fresh)
        nodes, level, column, bound = (np.concatenate([x[later], y]) for x, y in ((nodes, below), (level, down), (column, across), (bound, fresh)))
        stays = bound >= best.least
        nodes, level, column, bound = nodes[stays], level[stays], column[stays], bound[stays]
    return looked


def shard_of(ids: list[int | None], texts: list[bytes], documents: int, all_terms: int) -> tuple | None:
    """An index row, or None where no text has a term."""
    length, flat = terms_of(texts)
    flat = flat.dictionary_encode()
    if not len(flat):
        return None
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    column = np.zeros(len(ids), np.int64)
    column[order] = np.arange(len(order))
    terms = len(flat.dictionary)
    keys, tf = np.unique(np.repeat(column, length) * terms + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
    column, term = keys // terms, keys % terms
    frequency = np.bincount(term, minlength=terms)
    by_frequency = np.argsort(-frequency, kind="stable")
    row = np.zeros(terms, np.int64)
    row[by_frequency] = np.arange(terms)
    damp = np.array([10 + 90 * n * documents // all_terms for n in length[order].tolist()], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * damp[column])
    bits = max(1, (max(terms, len(order)) - 1).bit_length())
    treap = build_treap(row[term], column, impact, bits)
    vocabulary = flat.dictionary.view(pa.binary()).take(pa.array(by_frequency))
    return [ids[k] for k in order.tolist()], vocabulary, frequency[by_frequency].astype(np.int64), treap


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with terms, and their terms, of a task."""
    documents = terms = 0
    for batch in batches:
        for text in as_bytes(batch.column(0)):
            n = len(text.translate(_BYTES).split())
            documents += n > 0
            terms += n
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], ["documents", "terms"])


INDEX_DDL = "doc_ids array<long>, terms array<binary>, frequencies array<long>, treap binary"


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """An index row for each shard, and the number of documents with terms in ``n_documents``."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    documents, all_terms = picked.select("text").mapInArrow(_counts, "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = shard_of(ids, texts, documents, all_terms)
            if found:
                names, terms, frequencies, treap = found
                one = pa.array([0, len(terms)], pa.int32())
                columns = [pa.array([names], pa.list_(pa.int64())), pa.ListArray.from_arrays(one, terms), pa.ListArray.from_arrays(one, pa.array(frequencies)), pa.array([treap], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_ids", "terms", "frequencies", "treap"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held >= shard_bytes or len(ids) >= shard_docs:
                    yield from flush()
                    ids, texts, held = [], [], 0
        yield from flush()

    return picked.mapInArrow(run, INDEX_DDL).withColumn("n_documents", F.lit(documents))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term``, each term of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, words = terms_of(as_bytes(batch.column(1)))
            names = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), length)))
            yield pa.RecordBatch.from_arrays([names, words.view(pa.binary())], ["item_id", "term"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id long, term binary").distinct()


def _hits(k: int):
    """The k best documents of a task's shards for each item of the blocks beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, Best] = {}
        number, names, starts, terms, weights = None, [], None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                if row.column("block")[0].as_py() != number:
                    number, items = row.column("block")[0].as_py(), row.column("items").flatten()
                    own = items.field("terms")
                    names, starts = items.field("item_id").to_pylist(), own.offsets.to_numpy() - own.offsets[0].as_py()
                    terms, weights = own.flatten().field("term"), own.flatten().field("weight").to_numpy()
                treap, ids = Treap(row.column("treap")[0].as_py()), row.column("doc_ids").flatten().to_pylist()
                place = pc.fill_null(pc.index_in(terms, value_set=row.column("terms").flatten()), -1).to_numpy()
                for name, low, high in zip(names, starts, starts[1:], strict=False):
                    there = place[low:high] >= 0
                    if there.any():
                        descend(treap, place[low:high][there].astype(np.int64), weights[low:high][there], ids, best.setdefault(name, Best(k)))
        rows = [(name, None if none else i, -s) for name, own in best.items() for s, none, i in own.hits]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return run


def search(shards: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents of each item, by an index that has been stored."""
    wanted = checkpointed(item_terms(items))
    blocks = max(1, ceil(wanted.count() / block_terms))
    distinct = wanted.select("term").distinct()
    if blocks <= BROADCAST_BLOCKS:
        distinct = F.broadcast(distinct)
    every = shards.select("n_documents", F.explode(F.arrays_zip("terms", "frequencies")).alias("x")).select("n_documents", F.col("x.terms").alias("term"), F.col("x.frequencies").alias("df"))
    frequency = every.join(distinct, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.max("n_documents").alias("n"))
    weight = F.floor(1000 * F.log((2.0 * F.col("n") + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("weight")
    weighted = wanted.join(frequency, "term").select("item_id", "term", weight).where("weight > 0")
    listed = weighted.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    by_block = listed.select(block, F.struct("item_id", "terms").alias("x")).groupBy("block").agg(F.collect_list("x").alias("items"))
    if blocks <= BROADCAST_BLOCKS:
        by_block = F.broadcast(by_block)
    # Each shard meets each block.
    met = shards.select("doc_ids", "terms", "treap", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(by_block, "block")
    hits = met.select("block", "items", "doc_ids", "terms", "treap").mapInArrow(_hits(k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, **how: int) -> DataFrame:
    """Builds an index of all documents in the shared folder, searches it for all items and deletes it."""
    spark, place = docs.sparkSession, shared_folder(docs.sparkSession)
    index(docs, **how).write.option("compression", "zstd").parquet(place)
    found = checkpointed(search(spark.read.parquet(place), items, k))
    remove(spark, place)
    return found
