"""Tables of a document library.

A chunk's id is ``source id * CHUNKS_PER_SOURCE + chunk index``, so ids are made where
the rows are, without a counter.
"""

from __future__ import annotations

from pyspark.sql import types as T

CHUNKS_PER_SOURCE = 1 << 20
SCHEMA_VERSION = 4
DEFAULT_DIMENSION = 1024

COLLECTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("collection_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("paths", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.StringType()),
    ]
)
SOURCES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("collection_id", T.LongType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("file_modified_at", T.StringType()),
        T.StructField("last_indexed_at", T.StringType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("collection_id", T.LongType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)
VECTORS = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
MODELS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("dimensions", T.IntegerType()),
        T.StructField("context_window", T.IntegerType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("is_active", T.BooleanType()),
    ]
)
QUERY_CACHE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("model_key", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
