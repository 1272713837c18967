"""The tools over a library: thirteen functions from parameters to DataFrames or small answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..functions import text as tx
from ..operators import filters, lexical, library, maintain, vector
from ..operators.embed import Embedder
from ..operators.filters import Filters
from ..schema import QUERY_CACHE
from ..sources.settings import Settings
from .hybrid import hybrid_search


class WriteDeniedError(PermissionError):
    """Writing tools are off in the settings."""


@dataclass
class Tools:
    collections: DataFrame
    sources: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    embedder: Embedder | None = None
    settings: Settings = field(default_factory=Settings)
    #: Query vectors by (model_key, query), and the key of the model in use.
    cache: DataFrame | None = None
    model_key: str = ""
    #: The stored inverted index of the chunks, if there is one.
    index_of_text: lexical.TextIndex | None = None
    #: Length of the vectors, if a rebuild has recorded it; else that of the stored ones.
    dimension: int | None = None

    def query_vector(self, query: str) -> list[float] | None:
        """From the cache if it is there, else from the model; None if there is none or it fails."""
        if self.embedder is None or not query.strip():
            return None
        if self.cache is not None:
            row = self.cache.where((F.col("model_key") == self.model_key) & (F.col("query") == query)).select("embedding").first()
            # A vector of another length than the model's is corrupt, and is made anew.
            if row is not None and row[0] and len(row[0]) == (self._dimension() or len(row[0])):
                return list(row[0])
        try:
            made = self.embedder.embed_batch([query])[0]
        except Exception:  # noqa: BLE001  the full text alone answers then
            return None
        if self.cache is not None and len(made):
            self.cache = self._remembered(query, made)
        return made

    def _dimension(self) -> int | None:
        """Length of the stored vectors."""
        if self.dimension:
            return self.dimension
        row = self.vectors.where("embedding is not null").select(F.size("embedding").alias("n")).first()
        return row["n"] if row else None

    def _remembered(self, query: str, made: list[float]) -> DataFrame:
        """The cache with a vector that it missed, without one that was of no use; the oldest rows beyond its bound go."""
        known = (F.col("model_key") == self.model_key) & (F.col("query") == query)
        self.cache = self.cache.where(~known)
        last = self.cache.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first()["id"]
        row = self.cache.sparkSession.createDataFrame([(last + 1, self.model_key, query, [float(x) for x in made])], QUERY_CACHE)
        return maintain.cache_put(self.cache, row)

    @property
    def joined(self) -> DataFrame:
        return library.joined(self.chunks, self.sources, self.collections)

    def _excerpted(self, rows: DataFrame, max_chars: int) -> DataFrame:
        vaults = {v: v.rstrip("/").rpartition("/")[2] for v in self.settings.vaults}
        shown = rows.withColumn("snippet", tx.snippet("content", tx.clamp(max_chars, 1200, 200, 8000)))
        uri = md.source_uri(F.col("source_path"), F.col("source_type"), F.col("metadata"), vaults)
        return shown.select(*[c for c in rows.columns if c != "content"], F.col("snippet.text").alias("content"), "snippet.truncated", uri.alias("source_uri"))

    def _scope(self, collection: str = "", source_type: str = "", path: str = "") -> DataFrame:
        own = Filters(collection=collection, source_type=source_type, path=path).predicate()
        return self.joined if own is None else self.joined.where(own)

    # ---- reading ----

    def search(self, query: str, chosen: Filters | None = None, max_chars: int = 1200) -> DataFrame:
        """A model that is missing or fails leaves the full text alone."""
        wanted = self.query_vector(query)
        s = self.settings.search
        found = hybrid_search(self.joined, self.vectors, query, wanted, chosen, s.top_k, s.rrf_k, s.vector_weight, s.fts_weight, self.chunks, self.index_of_text)
        return self._excerpted(found, max_chars).orderBy(F.desc("score"), "id")

    def list_collections(self) -> DataFrame:
        return library.collection_rollup(self.collections, self.sources, self.chunks, self.vectors, self.settings.disabled_collections)

    def collection_info(self, name: str) -> dict[str, Any]:
        row = self.list_collections().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        ids = self.collections.where(F.col("name") == name).select(F.col("id").alias("collection_id"))
        own_sources, own_chunks = (df.join(ids, "collection_id", "left_semi") for df in (self.sources, self.chunks))
        types = {r["source_type"]: r["n"] for r in library.source_types(own_sources).collect()}
        return {**row.asDict(), "source_types": types, "sample_titles": [r["title"] for r in library.sample_titles(own_chunks).collect()]}

    def get_chunk(self, chunk_id: int, before: int = 0, after: int = 0) -> DataFrame:
        return library.neighbours(self.chunks, chunk_id, before, after)

    def read_source(self, path: str, collection: str = "", heading: str = "", max_chars: int = 60_000) -> dict[str, Any]:
        """The text of the source of that path, or the candidates if there are several."""
        named = self.sources.join(self.collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection")), "collection_id")
        found = library.resolve_source(named, path, collection).select("id", "collection").take(20)
        if not found:
            raise KeyError(path)
        if len(found) > 1:
            return {"candidates": [r["collection"] for r in found]}
        row = library.read_source(self.chunks, found[0]["id"], heading, max_chars).first()
        return {"content": row["content"], "truncated": row["truncated"]} if row else {"content": "", "truncated": False}

    def grep_report(self, pattern: str, regex: bool = False, collection: str = "", source_type: str = "", path: str = "", limit: int = 20) -> DataFrame:
        return lexical.grep_report(self._scope(collection, source_type, path), pattern, regex, limit)

    def grep(self, pattern: str, regex: bool = False, collection: str = "", source_type: str = "", path: str = "", limit: int = 20) -> DataFrame:
        return lexical.grep(self._scope(collection, source_type, path), pattern, regex, limit)

    def status(self) -> dict[str, Any]:
        return library.status_counts(self.collections, self.sources, self.chunks, self.vectors).first().asDict()

    def list_sources(self, collection: str = "", match: str = "", limit: int = 200) -> DataFrame:
        own = self.sources
        if collection:
            own = own.join(self.collections.where(F.col("name") == collection).select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
        return library.list_sources(own, self.chunks, match, limit)

    def facets(self, collection: str = "") -> dict[str, DataFrame]:
        """Four answers from one scan of the scope, whose counts are stored as a checkpoint where there is a folder for it."""
        found = library.facets_at_once(self._scope(collection))
        if found.sparkSession.sparkContext.getCheckpointDir() is not None:
            found = found.checkpoint(eager=True)

        def part(kind: str) -> DataFrame:
            return found.where(F.col("kind") == kind)

        return {
            "source_types": part("source_type").select(F.col("name").alias("source_type"), "n").orderBy(F.desc("n"), "source_type"),
            "keys": part("key").select(F.col("name").alias("key"), "n").orderBy(F.desc("n"), "key"),
            "values": part("value").select(F.col("name").alias("key"), "value", "n"),
            "date_range": part("dates").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")),
        }

    def find_related(self, chunk_id: int, collection: str = "", top_k: int = 10, max_chars: int = 1200) -> DataFrame:
        allowed = self._scope(collection).select(F.col("id").alias("document_id")) if collection else None
        near = vector.related(self.vectors, chunk_id, top_k, allowed)
        rows = self.joined.join(F.broadcast(near), F.col("id") == F.col("document_id")).drop("document_id")
        return self._excerpted(rows, max_chars).orderBy("distance", "id")

    def timeline(self, collection: str = "", source_type: str = "", date_from: str = "", date_to: str = "", limit: int = 50) -> DataFrame:
        own = Filters(collection=collection, source_type=source_type).predicate()
        return library.timeline(self.joined, own, date_from, date_to, limit)

    # ---- writing: the next state of the tables, if the settings allow it ----

    def _may_write(self) -> None:
        if not self.settings.allow_write:
            raise WriteDeniedError("allow_write is off")

    def index(self, files: DataFrame, take_in: Callable[[DataFrame], DataFrame], force: bool = False) -> tuple[DataFrame, DataFrame]:
        """Statuses of the files (with hashes and times), and the chunks of those that ``take_in`` has to parse."""
        self._may_write()
        statuses = maintain.changes(files, self.sources, force)
        return statuses, take_in(files.join(statuses.where("status = 'parse'"), "source_path", "left_semi"))

    def prune(self, present: DataFrame, collection: str = "") -> Tools:
        """Without sources that the listing lacks, in one collection, in those of a type, or in all."""
        self._may_write()
        own = self.sources.where(~F.contains("source_path", F.lit("://")))
        if collection:
            chosen = F.col("collection_type") == collection if collection in filters.COLLECTION_TYPES else F.col("name") == collection
            own = own.join(self.collections.where(chosen).select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
        gone = maintain.removed(own, present)
        return self.changed(*maintain.cascade(gone, self.sources, self.chunks, self.vectors))

    def changed(self, sources: DataFrame, chunks: DataFrame, vectors: DataFrame) -> Tools:
        """The tools over new tables: the model stays, query vectors are forgotten, and the text index is none until it is written again."""
        cache = None if self.cache is None else self.cache.limit(0)
        return replace(self, sources=sources, chunks=chunks, vectors=vectors, cache=cache, index_of_text=None)

    def with_model(self, embedder: Embedder | None, model_key: str) -> Tools:
        """Another model: no vector of a query that the old one made stays."""
        return replace(self, embedder=embedder, model_key=model_key, cache=None if self.cache is None else self.cache.limit(0))

    def rebuilt(self, dimension: int) -> Tools:
        """Vectors of another dimension from now on: all stored ones and those of queries go, sources and chunks stay to be embedded anew."""
        self._may_write()
        return replace(self, vectors=self.vectors.limit(0), cache=None if self.cache is None else self.cache.limit(0), dimension=dimension)
