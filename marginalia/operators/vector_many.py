"""Nearest vectors of many queries at once, and a stored index of sign bits.

Many queries: a task reads its vectors batch by batch and keeps for each query the pool of the nearest by sign
bits, with their exact distances. Only pools leave a task; they are merged by query in two
steps, first those of some tasks, then all. No pair beside them is ever a row.

Index: the bits of a vector are cut to bands of BAND_BITS, and stored as a table of bands, values and ids, partitioned
by band and sorted by value. Two bit strings at a distance of m * s + a at most (m bands) are within s in one of the first a + 1 bands or
within s - 1 in one of the others. So looking up shell after shell of values finds everything up to a radius that grows by one a
step; the pool is complete once enough lies within it. A summary of values and their counts (65,536 a band at most)
tells how many steps are needed at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as vf
from . import vector

#: Queries that meet the vectors together; of 1024 dimensions some 4 MB. Batches of tasks whose pools are merged first.
QUERY_BLOCK = 1024
MERGE_FIRST = 64
BAND_BITS = 16
#: Values that a lookup names one by one; larger shells are told by their distance.
NAMED_VALUES = 1024


class Pools:
    """Pools of the queries of one dimension: distance in bits, id and exact distance, the nearest first."""

    def __init__(self, ids: list[int], queries: np.ndarray, size: int):
        self.ids, self.queries, self.size = ids, queries.astype(np.float64), size
        self.bits = np.packbits(queries > 0, axis=1)
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        self.worst = np.full(len(ids), np.iinfo(np.int64).max)

    def meet(self, names: np.ndarray, found: np.ndarray) -> None:
        bits = np.packbits(found > 0, axis=1)
        far = np.zeros((len(self.ids), len(names)), np.int64)
        for word in range(bits.shape[1]):
            far += np.bitwise_count(self.bits[:, word, None] ^ bits[None, :, word])
        exact = found.astype(np.float64)
        near = far <= self.worst[:, None]
        for q in np.flatnonzero(near.any(axis=1)).tolist():
            at = np.flatnonzero(near[q])
            if len(at) > self.size:
                at = at[np.lexsort((names[at], far[q, at]))[: self.size]]
            distance = ((exact[at] - self.queries[q]) ** 2).sum(axis=1)
            h, i, d = (np.concatenate([a, b]) for a, b in zip(self.kept[q], (far[q, at], names[at], distance), strict=True))
            order = np.lexsort((i, h))[: self.size]
            self.kept[q] = (h[order], i[order], d[order])
            if len(order) == self.size:
                self.worst[q] = h[order[-1]]


def _pools(queries: list[tuple[int, list[float]]], size: int):
    """Pools of one task. Query vectors of several lengths meet only vectors of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = sorted({len(v) for _, v in queries if v})
        pools = {n: Pools([i for i, v in queries if v and len(v) == n], np.array([v for _, v in queries if v and len(v) == n], np.float32), size) for n in lengths}
        for batch in batches:
            embedding = batch.column(1)
            sizes = np.array([n if n is not None else 0 for n in pc.list_value_length(embedding).to_pylist()])
            for n, own in pools.items():
                at = np.flatnonzero(sizes == n)
                if len(at):
                    rows = embedding.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                    own.meet(batch.column(0).take(pa.array(at)).to_numpy(), rows)
        rows = [(own.ids[q], *x) for own in pools.values() for q, kept in enumerate(own.kept) for x in zip(*(c.tolist() for c in kept), strict=True)]
        task = TaskContext.get().partitionId() // MERGE_FIRST
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(rows), pa.int64())], ["query_id", "hamming", "document_id", "distance", "part"])

    return run


def search_many(vectors: DataFrame, queries: DataFrame, top_k: int, leave_out_self: bool = False) -> DataFrame:
    """``query_id, document_id, distance``: for each row of ``queries`` (query_id, embedding) what ``vector_search`` gives for its vector.

    ``leave_out_self`` looks for one more and leaves the vector of the query's own id out. Queries come in blocks of QUERY_BLOCK, each broadcast.
    """
    spark = vectors.sparkSession
    wanted = top_k + leave_out_self
    size = vector.pool_size(wanted, False)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        # Hashes spread queries evenly, so that a block is about as large as any other.
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", F.col("embedding").cast("array<float>")).collect()
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in own])
        pools = vectors.where("embedding is not null").select("document_id", "embedding").mapInArrow(_held_pools(held, size), "query_id long, hamming long, document_id long, distance double, part long")
        found = pools if found is None else found.unionByName(pools)
    for key in (["query_id", "part"], ["query_id"]):
        nearest = F.row_number().over(Window.partitionBy(*key).orderBy("hamming", "document_id"))
        found = found.withColumn("place", nearest).where(F.col("place") <= size)
    best = Window.partitionBy("query_id").orderBy("distance", "document_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= wanted)
    if leave_out_self:
        found = found.where("document_id <> query_id").withColumn("place", F.row_number().over(best)).where(F.col("place") <= top_k)
    return found.select("query_id", "document_id", "distance")


def _held_pools(held, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pools(held.value, size)(batches)

    return run


# ---- stored index of sign bits ----


def band_values(bits: list[int], dimension: int) -> list[int]:
    """Values of the bands of a quantized vector at hand."""
    return [(bits[low // 64] >> low % 64) & ((1 << BAND_BITS) - 1) for low in range(0, dimension, BAND_BITS)]


def shell(value: int, distance: int, width: int) -> list[int]:
    """All values of ``width`` bits at that distance."""
    return [value ^ sum(1 << b for b in own) for own in combinations(range(width), distance)]


@dataclass(frozen=True)
class BitIndex:
    """Bands of the sign bits of all vectors of one dimension, stored at a place."""

    spark: SparkSession
    place: str
    dimension: int

    @property
    def bands(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/bands")

    @property
    def summary(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/summary")

    @staticmethod
    def written(vectors: DataFrame, place: str, dimension: int) -> BitIndex:
        """A row for each vector and band: value, id, and all bits for the distance."""
        spark = vectors.sparkSession
        own = vectors.where(F.size("embedding") == dimension).select("document_id", vf.quantized(F.col("embedding"), dimension).alias("bits"))
        cut = [F.struct(F.lit(low // BAND_BITS).alias("band"), F.shiftrightunsigned(F.col("bits")[low // 64], low % 64).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int").alias("value")) for low in range(0, dimension, BAND_BITS)]
        rows = own.select("document_id", "bits", F.explode(F.array(*cut)).alias("x")).select("x.band", "x.value", "document_id", "bits")
        rows.repartitionByRange("band", "value", "document_id").sortWithinPartitions("band", "value", "document_id").write.mode("overwrite").partitionBy("band").parquet(f"{place}/bands")
        stored = spark.read.parquet(f"{place}/bands")
        stored.groupBy("band", "value").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{place}/summary")
        return BitIndex(spark, place, dimension)

    @staticmethod
    def opened(vectors: DataFrame, place: str, dimension: int) -> BitIndex:
        """The stored index, or a new one if it holds another number of vectors than there are."""
        spark = vectors.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/summary/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            index = BitIndex(spark, place, dimension)
            stored = index.summary.where("band = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if stored == vectors.where(F.size("embedding") == dimension).count():
                return index
        return BitIndex.written(vectors, place, dimension)

    def steps(self, query: list[float], size: int) -> int:
        """Steps after which ``size`` rows may have been looked up: fewer can't complete a pool."""
        values, m = band_values([w & 0xFFFFFFFFFFFFFFFF for w in vf.quantized_query(query)], self.dimension), self.band_count
        of_band = F.element_at(F.array(*map(F.lit, values)), F.col("band") + 1)
        far = F.bit_count(F.col("value").bitwiseXOR(of_band)).alias("far")
        # BAND_BITS + 1 rows a band.
        shells = {(r.far, r.band): r.n for r in self.summary.groupBy("band", far).agg(F.sum("n").alias("n")).collect()}
        total, step = 0, 0
        while step < m * (BAND_BITS + 1):
            total += shells.get((step // m, step % m), 0)
            step += 1
            if total >= size:
                break
        return step

    @property
    def band_count(self) -> int:
        return -(-self.dimension // BAND_BITS)

    def looked_up(self, query: list[float], steps: int) -> DataFrame:
        """``document_id, hamming`` of what the first ``steps`` shells hold; complete up to a distance of ``steps - 1``."""
        words = vf.quantized_query(query)
        values, m = band_values([w & 0xFFFFFFFFFFFFFFFF for w in words], self.dimension), self.band_count
        test = F.lit(False)
        for band in range(m):
            # Shells of this band: those of distance 0 up to ``last``.
            last = (steps - 1 - band) // m if steps > band else -1
            if last < 0:
                continue
            width = min(BAND_BITS, self.dimension - band * BAND_BITS)
            named = [v for d in range(min(last, width) + 1) for v in shell(values[band], d, width)] if last < 3 else []
            inside = F.col("value").isin(named) if named and len(named) <= NAMED_VALUES else F.bit_count(F.col("value").bitwiseXOR(F.lit(values[band]))) <= last
            test = test | ((F.col("band") == band) & inside)
        wanted = F.array(*[F.lit(w).cast("bigint") for w in words])
        # A vector that several shells hold is one row.
        return self.bands.where(test).select("document_id", vf.hamming(F.col("bits"), wanted).alias("hamming")).distinct()

    def pool(self, query: list[float], size: int) -> DataFrame:
        """The same as ``hamming_pool`` over all vectors: the ``size`` nearest, ties by id."""
        steps, last, more = self.steps(query, size), self.band_count * (BAND_BITS + 1), 1
        while steps < last:
            # The farthest of the nearest found so far is no nearer than the pool's, so that radius is enough.
            found = self.looked_up(query, steps).orderBy("hamming", "document_id").limit(size).agg(F.count("*").alias("n"), F.max("hamming").alias("far")).first()
            if found.n == size and found.far < steps:
                break
            steps, more = min(last, found.far + 1 if found.n == size else steps + more), 2 * more
        return self.looked_up(query, steps).orderBy("hamming", "document_id").limit(size)

    def search(self, vectors: DataFrame, query: list[float], top_k: int, allowed: DataFrame | None = None) -> DataFrame:
        """The same as ``vector_search``; of the vectors only those of the pool are fetched."""
        pool = self.pool(query, vector.pool_size(top_k, allowed is not None))
        found = vector.exact(vectors.join(F.broadcast(pool.select("document_id")), "document_id", "left_semi"), query)
        if allowed is not None:
            found = found.join(allowed, "document_id", "left_semi")
        return found.orderBy("distance", "document_id").limit(top_k)
