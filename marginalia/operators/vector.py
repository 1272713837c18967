"""Vector search in two stages: a pool by Hamming distance of sign bits, then exact distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vf


def pool_size(top_k: int, filtered: bool) -> int:
    return min(4000, max(1000, 100 * top_k) if filtered else max(200, 20 * top_k))


def with_bits(vectors: DataFrame, dimension: int) -> DataFrame:
    """Sign bits beside the vectors: a derived column, so the two never part."""
    return vectors.withColumn("bits", vf.quantized(F.col("embedding"), dimension))


def hamming_pool(vectors: DataFrame, query: list[float], size: int) -> DataFrame:
    """The ``size`` nearest by sign bits; ties by id. A top-k, so each partition keeps ``size`` rows at most."""
    bits = F.col("bits") if "bits" in vectors.columns else vf.quantized(F.col("embedding"), len(query))
    wanted = F.array(*[F.lit(w).cast("bigint") for w in vf.quantized_query(query)])
    near = vectors.where(F.size("embedding") == len(query)).withColumn("hamming", vf.hamming(bits, wanted))
    return near.orderBy("hamming", "document_id").limit(size)


def exact(vectors: DataFrame, query: list[float]) -> DataFrame:
    """``document_id, distance``: squared Euclidean."""
    wanted = F.array(*[F.lit(float(x)).cast("float") for x in query])
    return vectors.select("document_id", vf.squared_l2(F.col("embedding"), wanted).alias("distance"))


def vector_search(vectors: DataFrame, query: list[float], top_k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The ``top_k`` nearest of the pool; ``allowed`` (document_id) is applied to the pool, after ranking."""
    found = exact(hamming_pool(vectors, query, pool_size(top_k, allowed is not None)), query)
    if allowed is not None:
        found = found.join(allowed, "document_id", "left_semi")
    return found.orderBy("distance", "document_id").limit(top_k)


def related(vectors: DataFrame, seed_id: int, top_k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Nearest neighbours of a stored vector, itself left out. The seed is one row."""
    seed = vectors.where(F.col("document_id") == seed_id).select("embedding").first()
    if seed is None:
        return vectors.select("document_id", F.lit(0.0).alias("distance")).where(F.lit(False))
    return vector_search(vectors, list(seed[0]), top_k + 1, allowed).where(F.col("document_id") != seed_id).orderBy("distance", "document_id").limit(top_k)


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk is gone."""
    return vectors.join(chunks.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def query_vector(cache: DataFrame, model_key: str, query: str) -> Column:
    """A cached vector for (model, exact text), as a scalar; null is a miss."""
    return cache.where((F.col("model_key") == model_key) & (F.col("query") == query)).select("embedding").limit(1).scalar()
