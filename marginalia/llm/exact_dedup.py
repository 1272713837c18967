"""Exact deduplication by Grace hash partitioning.

Texts are compared after lower-casing A-Z. Three steps:

1. Where a task reads its rows it keeps one copy of each text it has seen within a
   window of rows; further copies travel as ids that point at it. A text that a third
   of all rows share is thus shuffled a few times a task, not once a row.
2. The copies are partitioned by leading bits of their digest, to buckets of a quarter of the bound on average. A bucket
   whose distinct texts are over the bound is partitioned again by the bits that follow, and so on,
   until it fits or holds a single digest (then it fits as one copy, since only distinct
   contents are held). Only such buckets are told to the driver; with evenly spread digests a bucket is one only if
   some of its texts are about as large as the bound. Spark's shuffle files are the spill files. Each bucket
   is then read through an open-addressing table that compares complete contents.
3. The ids meet the answer of their copy again.

Defined results: null counts as the empty text; equal rows and repeated ids form one
group and all their rows carry it, the largest id is kept (a row is ``kept`` if its id
is the kept id; of rows that repeat that id, each is); a group with only null ids keeps
none; a very long text is a record like any other, and the bound grows to it; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, ascii_lower

BUCKET_BYTES = 32 << 20
WINDOW_BYTES = 16 << 20
KEY_BITS = 63
LEAST_BITS = 8
FANOUT_BITS = 4
#: Tasks of the shuffle at most, however many buckets there are: a task reads bucket after bucket.
MOST_TASKS = 10_000
ANSWER = ["is_row", "doc_id", "copy_of", "keep_id", "group_size", "text_sha256"]


class ContentTable:
    """Open addressing with linear probing; slots hold places of records, a probe compares hash, then content."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def place(self, h: int, content: bytes) -> int:
        """Place of the equal record, or of this one if it is new."""
        if 3 * len(self.hashes) >= 2 * len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return int(k)
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        return len(self.hashes) - 1

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


RECORD = pa.schema([("is_row", pa.bool_()), ("doc_id", pa.int64()), ("copy_of", pa.string()), ("bucket", pa.string()), ("h", pa.int64()), ("n", pa.int64()), ("most", pa.int64()), ("text", pa.binary())])
RECORD_DDL = "is_row boolean, doc_id long, copy_of string, bucket string, h long, n long, most long, text binary"
ANSWER_DDL = "is_row boolean, doc_id long, copy_of string, keep_id long, group_size long, text_sha256 string"


def bucket_of(h: int, bits: int, split: frozenset[tuple[int, int]]) -> str:
    """Walks down the partitioning: a bucket that was split sends its records on by the next bits."""
    depth = bits
    while (depth, h >> (KEY_BITS - depth)) in split:
        depth += FANOUT_BITS
    return f"{depth}:{h >> (KEY_BITS - depth)}"


def split_buckets(keyed: DataFrame, bits: int, limit: int) -> frozenset[tuple[int, int]]:
    """Buckets of ``keyed`` (h, bytes) whose distinct texts are over the limit, level by level; they alone come to the driver."""
    split: set[tuple[int, int]] = set()
    depth, left = bits, keyed.groupBy("h").agg(F.max("bytes").alias("bytes"))
    while depth + FANOUT_BITS <= KEY_BITS:
        sized = left.groupBy(F.shiftright("h", KEY_BITS - depth).alias("b")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
        full = [r.b for r in sized.where((F.col("bytes") > limit) & (F.col("low") < F.col("high"))).select("b").collect()]
        if not full:
            break
        split.update((depth, b) for b in full)
        left = left.where(F.shiftright("h", KEY_BITS - depth).isin(full))
        depth += FANOUT_BITS
    return frozenset(split)


def _collapse(bits: int, split: frozenset[tuple[int, int]], row_buckets: int):
    """For each window of rows: one record with each distinct content, and one without content for each row."""

    def flush(window: list[tuple[int | None, bytes]], own: str) -> pa.RecordBatch:
        table, count, most, place = ContentTable(), [], [], []
        for doc_id, text in window:
            k = table.place(xxhash.xxh64_intdigest(text, 42) >> 1, text)
            if k == len(count):
                count.append(0)
                most.append(None)
            place.append(k)
            count[k] += 1
            if doc_id is not None and (most[k] is None or doc_id > most[k]):
                most[k] = doc_id
        # Of equal texts only rows that repeat an id can share a name, and those share the answer. Texts without ids are named by their window.
        name = [f"{own if m is None else m}:{h:x}:{len(t)}" for m, h, t in zip(most, table.hashes, table.contents, strict=True)]
        rows: list[tuple] = [(False, None, name[k], bucket_of(h, bits, split), h, count[k], most[k], text) for k, (h, text) in enumerate(zip(table.hashes, table.contents, strict=True))]
        rows += [(True, doc_id, name[k], f"row:{number % row_buckets}", 0, None, None, None) for number, ((doc_id, _), k) in enumerate(zip(window, place, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[tuple[int | None, bytes]] = []
        held, number, task = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                window.append((doc_id, text.lower()))
                held += len(text) + 64
                if held > WINDOW_BYTES:
                    yield flush(window, f"task {task}.{number}")
                    window, held, number = [], 0, number + 1
        if window:
            yield flush(window, f"task {task}.{number}")

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads bucket after bucket; one table of distinct contents is held at a time."""
    bucket, table = None, ContentTable()
    named: list[tuple[str, int]] = []
    count: list[int] = []
    most: list[int | None] = []

    def answers() -> pa.RecordBatch:
        sha = [hashlib.sha256(t).hexdigest() for t in table.contents]
        rows = [(False, None, name, most[k], count[k], sha[k]) for name, k in named]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ANSWER)

    for batch in batches:
        is_row = batch.column("is_row")
        through = batch.filter(is_row)
        if through.num_rows:
            none = pa.nulls(through.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([through.column("is_row"), through.column("doc_id"), through.column("copy_of"), none, none, pa.nulls(through.num_rows, pa.string())], ANSWER)
        own = batch.filter(pc.invert(is_row))
        for name, b, h, n, m, text in zip(*(own.column(c).to_pylist() for c in ("copy_of", "bucket", "h", "n", "most", "text")), strict=True):
            if b != bucket:
                yield answers()
                bucket, table, named, count, most = b, ContentTable(), [], [], []
            k = table.place(h, text)
            if k == len(count):
                count.append(0)
                most.append(None)
            named.append((name, k))
            count[k] += n
            if m is not None and (most[k] is None or m > most[k]):
                most[k] = m
    yield answers()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = picked.select(F.shiftrightunsigned(F.xxhash64(ascii_lower(F.col("text"))), 1).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 64).cast("long").alias("bytes"))
    total = picked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(KEY_BITS, max(LEAST_BITS, ceil(log2(max(1, 4 * total / bucket_bytes)))))
    split = split_buckets(keyed, bits, bucket_bytes)
    # Tasks grow in number with the data, up to a bound; beyond it they read more buckets each.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most_tasks, ceil(total / bucket_bytes)))
    records = picked.mapInArrow(_collapse(bits, split, 16 * tasks), RECORD_DDL)
    answers = records.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, ANSWER_DDL)
    copies = Window.partitionBy("copy_of")
    met = answers.select("is_row", "doc_id", *[F.max(c).over(copies).alias(c) for c in ("keep_id", "group_size", "text_sha256")])
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept")
    return met.where("is_row").select("doc_id", "keep_id", "group_size", kept, "text_sha256")
