"""The given tables as a document library: each document a source, its windows the chunks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, library
from ..schema import CHUNKS_PER_SOURCE


@dataclass(frozen=True)
class Library:
    """Tables are built on use; nothing is read before an action."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """Rows dealt out by a key if the scan has fewer splits than there are cores; else as they are.

        A file that Spark can't split would keep one core busy. A table of many splits isn't shuffled.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def documents(self) -> DataFrame:
        number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long")
        return self.dealt(self.table("documents"), "doc_id").where("doc_id IS NOT NULL AND source IS NOT NULL").withColumn("collection_id", F.coalesce(number, F.lit(-1)))

    @cached_property
    def collections(self) -> DataFrame:
        kinds = F.element_at(F.array(F.lit("project"), F.lit("code"), F.lit("system")), (F.pmod("collection_id", F.lit(3)) + 1).cast("int"))
        return self.documents.select(F.col("collection_id").alias("id"), F.col("source").alias("name"), kinds.alias("collection_type")).distinct()

    @cached_property
    def sources(self) -> DataFrame:
        """Path /source/lang/id.txt; indexed when the event of the same number took place."""
        times = self.table("events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_indexed_at"))
        own = self.documents.select(F.col("doc_id").alias("id"), "collection_id", F.col("lang").alias("source_type"), self.path.alias("source_path"))
        return own.join(times, "id", "left")

    @property
    def path(self):
        return F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))

    @property
    def metadata(self):
        """A third of the documents has a date, a third an author's date, a fifth a sender."""
        shown = F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z"))
        return F.to_json(
            F.struct(
                "lang",
                "n_chars",
                F.array(F.col("lang"), F.when(F.col("n_chars") > 1000, F.lit("long")).otherwise(F.lit("short"))).alias("tags"),
                F.array(F.concat(F.lit("Author A"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("Writer "), "lang")).alias("authors"),
                F.when(F.col("doc_id") % 3 == 1, shown).alias("date"),
                F.when(F.col("doc_id") % 3 == 2, shown).alias("author_date"),
                F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("user"), (F.col("doc_id") % 11).cast("string"), F.lit("@mail.example"))).alias("sender"),
            )
        )

    @cached_property
    def chunks(self) -> DataFrame:
        rows = self.documents.select(F.col("doc_id").alias("source_id"), "collection_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("title"), self.metadata.alias("metadata"), "text")
        cut = chunking.chunk_plain(rows).withColumn("chunk_index", F.col("chunk_index").cast("long"))
        # A source of more chunks would run into the next one's ids.
        index = F.when(F.col("chunk_index") < CHUNKS_PER_SOURCE, F.col("chunk_index")).otherwise(F.raise_error(F.lit("a source has too many chunks")).cast("long"))
        return cut.withColumn("id", F.col("source_id") * CHUNKS_PER_SOURCE + index)

    @cached_property
    def joined(self) -> DataFrame:
        return library.joined(self.chunks, self.sources, self.collections)

    @cached_property
    def vectors(self) -> DataFrame:
        """A vector belongs to the first chunk of the document of its number."""
        return self.table("embeddings").select((F.col("vec_id") * CHUNKS_PER_SOURCE).alias("document_id"), "embedding")

    def vector_of(self, vec_id: int) -> list[float]:
        """One stored vector, as a query."""
        row = self.table("embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
        return list(row[0]) if row else [0.0] * 64


#: The same tables in SQL: documents without nulls, collections, sources, chunks.
LIBRARY_SQL = """
docs AS (
  SELECT *, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS collection_id FROM documents),
collections AS (
  SELECT DISTINCT collection_id AS id, source AS name, ['project', 'code', 'system'][collection_id % 3 + 1] AS collection_type FROM docs),
sources AS (
  SELECT d.doc_id AS id, d.collection_id, d.lang AS source_type, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS source_path,
         strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS last_indexed_at
  FROM docs d LEFT JOIN events e ON e.event_id = d.doc_id),
worded AS (
  SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM docs),
numbered AS (
  SELECT *, unnest(range(CASE WHEN len(w) <= 500 THEN 1 ELSE CAST(ceil((len(w) - 500) / 450.0) AS BIGINT) + 1 END)) AS chunk_index FROM worded),
chunks AS (
  SELECT doc_id * 1048576 + chunk_index AS id, doc_id AS source_id, collection_id, chunk_index, doc_id || '.txt' AS title,
         CASE WHEN len(w) = 0 THEN '' WHEN len(w) <= 500 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g')
              ELSE array_to_string(w[chunk_index * 450 + 1 : chunk_index * 450 + 500], ' ') END AS content,
         lang, n_chars, [lang, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END] AS tags,
         ['Author A' || (doc_id % 7), 'Writer ' || lang] AS authors,
         CASE WHEN doc_id % 3 = 1 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INT), '%Y-%m-%d') || 'T00:00:00Z' END AS date,
         CASE WHEN doc_id % 3 = 2 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INT), '%Y-%m-%d') || 'T00:00:00Z' END AS author_date,
         CASE WHEN doc_id % 5 = 0 THEN 'user' || (doc_id % 11) || '@mail.example' END AS sender
  FROM numbered),
joined AS (
  SELECT c.*, s.source_type, s.source_path, s.last_indexed_at, l.name AS collection, l.collection_type
  FROM chunks c JOIN sources s ON c.source_id = s.id JOIN collections l ON c.collection_id = l.id),
vectors AS (
  SELECT vec_id * 1048576 AS document_id, embedding FROM embeddings)
"""
