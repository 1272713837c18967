"""Maintenance: change detection, and each mutation as the next state of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

CACHE_ROWS = 2000


# ---- change detection ----


def changes(files: DataFrame, sources: DataFrame, force: bool = False) -> DataFrame:
    """``status`` of each file (source_path, file_hash, file_modified_at) against what is indexed.

    skip: the time is the same, or forced off; touch: only the time is new; parse: the content is.
    """
    known = sources.select("source_path", F.col("file_hash").alias("old_hash"), F.col("file_modified_at").alias("old_time"))
    status = F.when(F.lit(force) | F.col("old_hash").isNull(), "parse").when(F.col("old_time") == F.col("file_modified_at"), "skip").when(F.col("old_hash") == F.col("file_hash"), "touch").otherwise("parse")
    return files.join(known, "source_path", "left").select("source_path", status.alias("status"))


def removed(sources: DataFrame, present: DataFrame) -> DataFrame:
    """Indexed sources that the listing lacks."""
    return sources.join(present.select("source_path"), "source_path", "left_anti")


def run_counts(statuses: DataFrame) -> DataFrame:
    s = F.col("status")
    return statuses.agg(F.count_if(s == "parse").alias("indexed"), F.count_if(s.isin("skip", "touch")).alias("skipped"), F.count_if(s == "failed").alias("failed"), F.count("*").alias("total_found"))


# ---- next states ----


def upserted(table: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows by key, those of ``new`` before old ones, of several the latest by ``order``."""
    both = table.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new"), F.desc(order)))
    return both.withColumn("__place", place).where("__place = 1").drop("__place", "__new")


def replaced(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Chunks after a run: items (source_id, chunk rows) that are whole replace their source's chunks.

    An item with a chunk that could not be embedded is left out whole, and its source keeps
    what it had.
    """
    whole = complete_items(items)
    fresh = items.join(whole, "source_id", "left_semi").drop("embedding")
    return chunks.join(whole, "source_id", "left_anti").unionByName(fresh.select(chunks.columns))


def complete_items(items: DataFrame) -> DataFrame:
    """``source_id`` of items all of whose chunks have a vector and some of whose text isn't blank."""
    kept = items.groupBy("source_id").agg(F.bool_and(F.col("embedding").isNotNull()).alias("all"), F.bool_or(tx.trimmed(F.col("content")) != "").alias("some"))
    return kept.where(F.col("all") & F.col("some")).select("source_id")


def cascade(gone: DataFrame, sources: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, chunks and vectors without the sources in ``gone`` (id)."""
    ids = gone.select("id").distinct()
    left_sources = sources.join(ids, "id", "left_anti")
    left_chunks = chunks.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    dead = chunks.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("id").alias("document_id"))
    return left_sources, left_chunks, vectors.join(dead, "document_id", "left_anti")


def cascade_counts(gone: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: how many sources, chunks and vectors go with the sources in ``gone`` (id)."""
    ids = gone.select("id").distinct()
    dead = chunks.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("id").alias("document_id"))
    n_vectors = vectors.join(dead, "document_id", "left_semi").agg(F.count("*")).scalar()
    return ids.agg(F.count("*").alias("sources")).select("sources", dead.agg(F.count("*")).scalar().alias("chunks"), n_vectors.alias("vectors"))


def prune(sources: DataFrame, chunks: DataFrame, vectors: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without what the listing lacks; sources with a scheme in their path aren't files and stay."""
    gone = removed(sources.where(~F.contains("source_path", F.lit("://"))), present)
    return cascade(gone, sources, chunks, vectors)


def clear_prefix(sources: DataFrame, chunks: DataFrame, vectors: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return cascade(sources.where(tx.starts_with("source_path", prefix)), sources, chunks, vectors)


def clear_collection(sources: DataFrame, chunks: DataFrame, vectors: DataFrame, collection_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    return cascade(sources.where(F.col("collection_id") == collection_id), sources, chunks, vectors)


def without_chunks(chunks: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return chunks.join(ids, "id", "left_anti"), vectors.join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_anti")


def paths_rewritten(sources: DataFrame, old: str, new: str) -> DataFrame:
    return sources.withColumn("source_path", tx.rewrite_prefix("source_path", old, new))


def rewritten_count(sources: DataFrame, old: str) -> DataFrame:
    """One row: how many paths a rewrite of the prefix changes."""
    return sources.where(tx.starts_with("source_path", old)).agg(F.count("*").alias("rewritten"))


def rebuilt_vectors(vectors: DataFrame, cache: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Vectors and cached query vectors after a change of the dimension: none of another one stays, and all chunks have to be embedded anew."""
    return vectors.where(F.size("embedding") == dimension), cache.where(F.size("embedding") == dimension)


# ---- collections ----


class TypeConflictError(ValueError):
    """A collection's name is taken by another type."""


def collection_created(collections: DataFrame, collection_id: int, name: str, kind: str, paths: list[str] | None = None) -> DataFrame:
    """The collection as it is, with new paths if given, or a new one."""
    known = collections.where(F.col("name") == name).select("collection_type").first()
    if known and known[0] != kind:
        raise TypeConflictError(f"collection {name!r} is of type {known[0]!r}")
    if known:
        return collections if paths is None else with_paths(collections, name, paths)
    values = (collection_id, name, kind, "", paths or [], "")
    row = collections.sparkSession.createDataFrame([values], "id long, name string, collection_type string, description string, paths array<string>, created_at string")
    return collections.unionByName(row.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")), allowMissingColumns=True)


def with_paths(collections: DataFrame, name: str, paths: list[str]) -> DataFrame:
    return collections.withColumn("paths", F.when(F.col("name") == name, F.array(*map(F.lit, paths)).cast("array<string>")).otherwise(F.col("paths")))


def name_conflicts(claims: DataFrame) -> DataFrame:
    """Names that more than one kind of configuration claims."""
    kinds = claims.groupBy("name").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return kinds.where(F.size("kinds") > 1)


# ---- models, cache ----


def model_upserted(models: DataFrame, new: DataFrame) -> DataFrame:
    """By path: the name is always taken; dimensions if positive; context and batch size where none was stored."""
    n = new.select("path", *[F.col(c).alias(f"new_{c}") for c in new.columns if c != "path"])
    both = models.join(n, "path", "full_outer")
    fresh = F.col("id").isNull()
    take: dict[str, Column] = {
        "id": F.coalesce("id", "new_id"),
        "name": F.coalesce("new_name", "name"),
        "dimensions": F.when(fresh | (F.col("new_dimensions") > 0), F.col("new_dimensions")).otherwise(F.col("dimensions")),
        "context_window": F.when(fresh | ((F.col("context_window") == 0) & F.col("new_context_window").isNotNull()), F.col("new_context_window")).otherwise(F.col("context_window")),
        "batch_size": F.when(fresh | ((F.col("batch_size") <= 0) & F.col("new_batch_size").isNotNull()), F.col("new_batch_size")).otherwise(F.col("batch_size")),
        "is_active": F.coalesce("is_active", F.lit(False)),
    }
    return both.select(*[take[c].alias(c) if c in take else F.col(c) for c in models.columns])


def models_listed(models: DataFrame) -> DataFrame:
    """Newest first."""
    return models.orderBy(F.desc("id"))


def model_activated(models: DataFrame, path: str) -> DataFrame:
    if models.where(F.col("path") == path).isEmpty():
        raise KeyError(path)
    return models.withColumn("is_active", F.col("path") == path)


def cache_put(cache: DataFrame, new: DataFrame, most: int = CACHE_ROWS) -> DataFrame:
    """The first vector for (model, query) stays; empty ones don't enter; the newest ``most`` rows remain."""
    both = cache.unionByName(new.where(F.size("embedding") > 0))
    first = F.row_number().over(Window.partitionBy("model_key", "query").orderBy("id"))
    return cache_evicted(both.withColumn("__n", first).where("__n = 1").drop("__n"), most)


def cache_evicted(cache: DataFrame, most: int = CACHE_ROWS) -> DataFrame:
    """The newest rows by id. A top-k: at most ``most`` rows leave any partition."""
    return cache.orderBy(F.desc("id")).limit(most)


def cache_stats(cache: DataFrame) -> DataFrame:
    size = F.sum(4 * F.size("embedding") + F.char_length("query"))
    return cache.agg(F.count("*").alias("entries"), F.coalesce(size, F.lit(0)).alias("bytes"))
