"""Benchmark decontamination by greedy string tiling.

The benchmark is the query set: its items are read in blocks of a bounded number of
words, and each block meets all documents. Words outside a block's vocabulary cannot
match, so a document becomes an array of the block's word numbers. Running
Karp-Rabin hashes of ``min_match`` words are joined with those of the block: shared
seeds. For each item that shares a seed, seeds on one diagonal form matches; the
longest is marked in both texts, again and again, until no unmarked match of
``min_match`` words is left. Tiles may stand in any order, so a reordered passage is
covered as well. An item is found in a document if the tiles cover ``threshold`` of it. Where
texts repeat themselves so that seeds would give too many pairs of places, the same tiles are found
length by length instead, without pairs.

Words are runs of letters and digits after lower-casing A-Z (all non-ASCII characters
count as letters). Defined results: null and empty texts match nothing; an item of fewer
words than ``min_match`` must stand in the document as a whole; a very long text takes memory
in proportion to its words; an item without words
matches nothing; repeated documents and items repeat their rows; ties between matches of
equal length go to the earliest place in the document, then in the item; empty tables
give an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

MIN_MATCH = 5
THRESHOLD = 0.6
BLOCK_WORDS = 1 << 20
#: Pairs of places of a document and an item that are held at once.
MOST_PAIRS = 1 << 20
#: Bytes of text that meet one block after another, where there are several.
WINDOW = 64 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Of a byte: itself, in lower case, if it is part of a word; a space if not.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def running_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``n`` numbers, modulo 2**64."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + (ids[k : len(ids) - n + 1 + k].astype(np.uint64) + np.uint64(1))
    return out


class Block:
    """Items of a benchmark with their seeds, as sent to the executors."""

    def __init__(self, items: list[tuple[int, list[bytes]]], min_match: int):
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.ids = [i for i, _ in items]
        self.texts = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]
        self.least = [min(min_match, len(t)) for t in self.texts]
        #: By seed length: distinct pairs of a seed and an item that has it, sorted.
        self.seeds = {}
        for n in sorted(set(self.least) - {0}):
            found = [(np.unique(running_hashes(t, n)), k) for k, (t, m) in enumerate(zip(self.texts, self.least, strict=True)) if m == n]
            hashes = np.concatenate([h for h, _ in found])
            owner = np.concatenate([np.full(len(h), k) for h, k in found])
            order = np.argsort(hashes, kind="stable")
            self.seeds[n] = hashes[order], owner[order]

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Number of an item, and its tiles in the document, for each item that shares a seed."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, (hashes, owner) in self.seeds.items():
            if len(ids) < n:
                continue
            known = np.r_[0, np.cumsum(ids >= 0)]
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            own = np.zeros(len(at), np.uint64)
            for k in range(n):
                own = own * BASE + (ids[at + k].astype(np.uint64) + np.uint64(1))
            seeds = np.unique(own)
            low, high = np.searchsorted(hashes, seeds), np.searchsorted(hashes, seeds, "right")
            for item in {int(k) for a, b in zip(low[high > low], high[high > low], strict=True) for k in owner[a:b]}:
                items[item] = at, own
        for item, (at, own) in sorted(items.items()):
            text, least = self.texts[item], self.least[item]
            seeds = running_hashes(text, least)
            place = np.argsort(seeds, kind="stable")
            low, high = np.searchsorted(seeds[place], own), np.searchsorted(seeds[place], own, "right")
            each = high - low
            hit = each > 0
            if each.sum() > MOST_PAIRS:
                yield item, tiles_by_length(ids, text, at[hit], least)
                continue
            low, each, start = low[hit], each[hit], at[hit]
            j = place[np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
            yield item, tiles(ids, text, np.repeat(start, each), j, least)


def tiles(doc: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the seeds (i, j): (place in the document, place in the item, length)."""
    same = np.ones(len(i), bool)
    for k in range(least):
        same &= doc[i + k] == item[j + k]
    i, j = i[same], j[same]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    in_doc, in_item = np.zeros(len(doc) + 1, bool), np.zeros(len(item) + 1, bool)
    out = []
    while len(i):
        new = np.r_[True, (np.diff(i) != 1) | (np.diff(i - j) != 0)]
        first = np.flatnonzero(new)
        length = np.diff(np.r_[first, len(i)]) + least - 1
        for k in np.lexsort((j[first], i[first], -length)):
            a, b, n = int(i[first[k]]), int(j[first[k]]), int(length[k])
            if n < length.max():
                break
            if in_doc[a : a + n].any() or in_item[b : b + n].any():
                continue
            in_doc[a : a + n] = in_item[b : b + n] = True
            out.append((a, b, n))
        # A seed stays if none of its words is marked.
        d, t = np.r_[0, np.cumsum(in_doc)], np.r_[0, np.cumsum(in_item)]
        free = (d[i + least] == d[i]) & (t[j + least] == t[j])
        i, j = i[free], j[free]
    return sorted(out)


def tiles_by_length(doc: np.ndarray, item: np.ndarray, starts: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The same tiles without any pairs of places, for texts that repeat themselves: their number grows as length times length.

    The longest length of which an unmarked run is common is found by halving, as a common run
    has common parts; at each length running hashes are compared, and what is equal is marked in order.
    """
    # Only stretches of the document around seeds can be part of a tile.
    near = np.zeros(len(doc) + 1, np.int64)
    np.add.at(near, starts, 1)
    np.add.at(near, starts + least, -1)
    in_doc, in_item = np.cumsum(near)[: len(doc)] == 0, np.zeros(len(item), bool)
    out = []

    def free_runs(ids: np.ndarray, marked: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        hashes = running_hashes(ids, n)
        sums = np.r_[0, np.cumsum(marked)]
        at = np.flatnonzero(sums[n:] == sums[:-n])
        return at, hashes[at]

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at, own = free_runs(doc, in_doc, n)
        place, theirs = free_runs(item, in_item, n)
        hit = np.isin(own, theirs)
        return at[hit], own[hit], place, theirs

    high = min(len(doc), len(item))
    while True:
        low = least - 1
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            return sorted(out)
        at, own, place, theirs = common(low)
        by_hash: dict[int, list[int]] = {}
        for j, h in zip(place.tolist(), theirs.tolist(), strict=True):
            by_hash.setdefault(h, []).append(j)
        end = 0
        for a, h in zip(at.tolist(), own.tolist(), strict=True):
            if a < end:
                continue
            for b in by_hash.get(h, ()):
                if not in_item[b : b + low].any() and (doc[a : a + low] == item[b : b + low]).all():
                    in_doc[a : a + low] = in_item[b : b + low] = True
                    out.append((a, b, low))
                    end = a + low
                    break
            else:
                # Marked through in the item: no later place of this run can match at this length.
                by_hash[h] = []
        high = low


def blocks_of(benchmark: DataFrame, min_match: int, block_words: int) -> Iterator[Block]:
    held: list[tuple[int, list[bytes]]] = []
    n = 0
    for item_id, text in benchmark.toLocalIterator():
        words = words_of((text or "").encode())
        held.append((item_id, words))
        n += len(words)
        if n >= block_words:
            yield Block(held, min_match)
            held, n = [], 0
    if held:
        yield Block(held, min_match)


class Search:
    """Finds items in batches of texts. Of several blocks one is held at a time, and meets a window of texts."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, min_match: int, threshold: float, block_words: int):
        context = docs.sparkSession.sparkContext
        self.threshold = threshold
        self.blocks = [context.broadcast(b) for b in blocks_of(benchmark.select(F.col("item_id").cast("long"), "text"), min_match, block_words)]

    def windows(self, batches: Iterator[pa.RecordBatch], place: int) -> Iterator[list[pa.RecordBatch]]:
        held, n = [], 0
        for batch in slices(batches):
            held.append(batch)
            n += batch.column(place).nbytes
            if len(self.blocks) < 2 or n >= WINDOW:
                yield held
                held, n = [], 0
        if held:
            yield held

    def found(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, list[tuple[int, int, int]]]]:
        """Number of the text, item, its words, those covered, its tiles."""
        for block in self.blocks:
            own = block.value
            for number, text in enumerate(texts):
                for item, tiling in own.matches(words_of(text)):
                    n, covered = len(own.texts[item]), sum(x[2] for x in tiling)
                    if covered >= self.threshold * n:
                        yield number, own.ids[item], n, covered, tiling
            if len(self.blocks) > 1:
                # What a worker has read of a broadcast stays with it else.
                block.__dict__.pop("_value", None)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, item_words, covered_words, coverage, tiles`` for each item found in a document.

    ``tiles`` lists document word:item word:length, comma-joined, in the document's order.
    """
    schema = "doc_id long, item_id long, item_words long, covered_words long, coverage double, tiles string"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
    search = Search(docs, benchmark, min_match, threshold, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window in search.windows(batches, 1):
            ids = [i for batch in window for i in batch.column(0).to_pylist()]
            texts = [t for batch in window for t in as_bytes(batch.column(1))]
            rows = [(ids[number], item, n, covered, covered / n, ",".join("%d:%d:%d" % x for x in tiling)) for number, item, n, covered, tiling in search.found(texts)]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in whose own text no item is found."""
    search, place = Search(docs, benchmark, min_match, threshold, block_words), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window in search.windows(batches, place):
            gone = {number for number, *_ in search.found([t for batch in window for t in as_bytes(batch.column(place))])}
            number = 0
            for batch in window:
                yield batch.filter(pa.array([k not in gone for k in range(number, number + batch.num_rows)], pa.bool_()))
                number += batch.num_rows

    return docs.mapInArrow(run, docs.schema)
