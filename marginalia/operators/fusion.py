"""Weighted reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, VECTOR_WEIGHT, TEXT_WEIGHT, TOP_K = 60, 0.7, 0.3, 10


def ranked(hits: DataFrame, *order: str) -> DataFrame:
    """``doc_id, place`` from 0. ``hits`` is a top-k, so that one window over it is small."""
    return hits.select("doc_id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("place"))


def rrf(vector_hits: DataFrame, text_hits: DataFrame, k: int = RRF_K, vector_weight: float = VECTOR_WEIGHT, text_weight: float = TEXT_WEIGHT) -> DataFrame:
    """``doc_id, score`` from ranked lists (doc_id, place). The best possible score is 1; a weight of 0 keeps its rows."""
    base = k + 1 if k + 1 > 0 else 1
    whole = (vector_weight + text_weight) / base
    whole = whole if whole > 0 else 1.0
    parts = [hits.select("doc_id", (F.lit(float(w)) / (F.lit(k) + F.col("place") + 1)).alias("part")) for hits, w in ((vector_hits, vector_weight), (text_hits, text_weight))]
    return parts[0].unionByName(parts[1]).groupBy("doc_id").agg((F.sum("part") / F.lit(whole)).alias("score"))
