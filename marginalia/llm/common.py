"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` bears, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"__{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; tests and laptops set one of their own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new path below the shared folder, for tables that are written and read again."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4()}"


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a table that was written below the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage; the files go to the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpointed, and how many rows were written, which the job that writes them tells."""
    seen = Observation()
    df = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return df, seen.get["n"]


def compact(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """Checkpointed, in tasks of ``rows`` rows at most where it has fewer: what one task can hold needs no more shuffles."""
    df, n = counted(df)
    tasks = max(1, -(-n // rows))
    return df.coalesce(tasks) if tasks < df.rdd.getNumPartitions() else df


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of batches, so that what is made of their texts is held for some rows at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def by_group(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Cuts a stream that is sorted by ``key`` into tables of about ``rows`` rows, never inside a key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).combine_chunks()
        last = keys[-1]
        cut = n - 1
        values = keys.to_numpy(zero_copy_only=False)
        cut = int((values == last.as_py()).argmax())
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)
