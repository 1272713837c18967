"""Batches of whole items: items are taken in order until a batch has a number of chunks, then the next begins.

Where a batch begins depends on all items before it, but only through the number of chunks that the open batch has
when a task's range begins. So each task first tells, for every such number, what it would leave open and how many batches it
would close; these are composed from range to range, and each task then deals its items once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def carried(sizes: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """For every number of chunks that may be open before: what is open after the items, and the batches closed."""
    still, closed = np.arange(target), np.zeros(target, np.int64)
    for n in sizes.tolist():
        still = still + n
        full = still >= target
        closed += full
        still[full] = 0
    return still, closed


def _facts(target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        still, closed = np.arange(target), np.zeros(target, np.int64)
        for batch in batches:
            after, more = carried(batch.column(0).to_numpy(), target)
            closed, still = closed + more[still], after[still]
        part = pa.array([TaskContext.get().partitionId()], pa.int64())
        yield pa.RecordBatch.from_arrays([part, pa.array([still.tolist()], pa.list_(pa.int64())), pa.array([closed.tolist()], pa.list_(pa.int64()))], ["part", "still", "closed"])

    return run


def _dealt(target: int, starts: dict[int, tuple[int, int]], size_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        still, number = starts[TaskContext.get().partitionId()]
        for batch in batches:
            out = []
            for n in batch.column(size_at).to_pylist():
                out.append(number)
                still += n
                if still >= target:
                    still, number = 0, number + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "batch"])

    return run


def item_batches(items: DataFrame, order: list[str], target: int) -> DataFrame:
    """``items`` (n_chunks) with ``batch``, from 0, in the given order. Items without chunks are in none and are left out; ``order`` has to be unique.

    What is told of a range has ``target`` numbers; the driver composes as many of them as there are tasks.
    """
    target = max(1, target)
    own = items.where("n_chunks > 0").withColumn("n_chunks", F.col("n_chunks").cast("long"))
    # Both passes have to see the same ranges.
    ranged = own.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)
    facts = ranged.select("n_chunks").mapInArrow(_facts(target), "part long, still array<long>, closed array<long>").collect()
    starts, still, number = {}, 0, 0
    for r in sorted(facts, key=lambda r: r.part):
        starts[r.part] = still, number
        still, number = r.still[still], number + r.closed[still]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    return ranged.mapInArrow(_dealt(target, starts, ranged.columns.index("n_chunks")), f"{schema}, batch long")


def items_of(chunks: DataFrame) -> DataFrame:
    """``source_id, n_chunks`` of items some of whose text isn't blank; others count as none."""
    return chunks.groupBy("source_id").agg(F.when(F.bool_or(tx.trimmed(F.col("content")) != ""), F.count("*")).otherwise(0).alias("n_chunks"))
