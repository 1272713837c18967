"""Hybrid search: vector and full-text candidates, filtered, fused by rank, then fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, lexical, vector
from ..operators.filters import Filters


def hybrid_search(
    joined: DataFrame, vectors: DataFrame, query: str, query_vector: list[float] | None, filters: Filters | None = None,
    top_k: int = 0, k: int = fusion.RRF_K, vector_weight: float = fusion.VECTOR_WEIGHT, text_weight: float = fusion.TEXT_WEIGHT,
    chunks: DataFrame | None = None, index: lexical.TextIndex | None = None,
) -> DataFrame:
    """``id, title, content, metadata, collection, source_path, source_type, score``, the best first.

    ``joined`` has chunks with source and collection. Without a query vector the full text
    alone ranks. Both lists are top-k before they meet, so fusion and fetch handle 2 k rows. The text is ranked by the stored ``index``
    if there is one, else over ``chunks``, which need no sources, if they are given.
    """
    filters = filters or Filters()
    top_k = filters.top_k or top_k or fusion.TOP_K
    predicate = filters.predicate()
    ranked = index.bm25(query) if index is not None else None if chunks is None else lexical.bm25(chunks, query)
    text = fusion.ranked(lexical.fts_search(joined, query, top_k, predicate, ranked=ranked), "rank", "doc_id")
    if query_vector is None:
        near = text.where(F.lit(False))
    else:
        allowed = None if predicate is None else joined.where(predicate).select(F.col("id").alias("document_id"))
        found = vector.vector_search(vectors, query_vector, top_k, allowed).withColumnRenamed("document_id", "doc_id")
        near = fusion.ranked(found, "distance", "doc_id")
    fused = fusion.rrf(near, text, k, vector_weight, text_weight)
    rows = joined.join(F.broadcast(fused), joined.id == fused.doc_id)
    return rows.select("id", "title", "content", "metadata", "collection", "source_path", "source_type", "score").orderBy(F.desc("score"), "id").limit(top_k)
