"""Functions of SQL over a library: a folding of case, and tools that return tables.

``register`` makes views of the tables and temporary functions of the session; Catalyst inlines both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..functions import text as tx
from ..operators import filters, library


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, joined: DataFrame, sources: DataFrame) -> None:
    """``vfold(text)``, ``library_timeline(collection, source_type, date_from, date_to, most)``, ``library_sources_like(match, most)``, ``library_keys_of(collection, most)``."""
    joined.withColumn("doc_date", library.document_date()).createOrReplaceTempView("library_joined")
    sources.createOrReplaceTempView("library_sources")
    joined.select("collection", "collection_type", F.explode(md.keys("metadata")).alias("key"), "metadata").createOrReplaceTempView("library_keys")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vfold(t STRING) RETURNS STRING RETURN translate(t, {_quoted(tx.ORBIT_FROM)}, {_quoted(tx.ORBIT_TO)})")
    types = ", ".join(map(_quoted, sorted(filters.COLLECTION_TYPES)))
    scope = f"(wanted = '' OR CASE WHEN wanted IN ({types}) THEN collection_type = wanted ELSE collection = wanted END)"
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION library_timeline(wanted STRING, kind STRING, date_from STRING, date_to STRING, most INT)
RETURNS TABLE(id BIGINT, title STRING, collection STRING, source_path STRING, source_type STRING, doc_date STRING)
RETURN SELECT id, title, collection, source_path, source_type, doc_date FROM (
  SELECT id, title, collection, source_path, source_type, doc_date, row_number() OVER (ORDER BY doc_date DESC, id) AS place FROM library_joined
  WHERE {scope} AND (kind = '' OR source_type = kind) AND (date_from = '' OR left(doc_date, 10) >= left(date_from, 10)) AND (date_to = '' OR left(doc_date, 10) <= left(date_to, 10)))
WHERE place <= least(greatest(CASE WHEN most > 0 THEN most ELSE 50 END, 1), 500)""")
    spark.sql("""
CREATE OR REPLACE TEMPORARY FUNCTION library_sources_like(wanted STRING, most INT)
RETURNS TABLE(id BIGINT, source_path STRING, source_type STRING, last_indexed_at STRING)
RETURN SELECT id, source_path, source_type, last_indexed_at FROM (
  SELECT id, source_path, source_type, last_indexed_at, row_number() OVER (ORDER BY source_path, id) AS place FROM library_sources WHERE contains(vfold(source_path), vfold(wanted)))
WHERE place <= least(greatest(CASE WHEN most > 0 THEN most ELSE 200 END, 1), 1000)""")
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION library_keys_of(wanted STRING, most INT)
RETURNS TABLE(key STRING, n BIGINT)
RETURN SELECT key, n FROM (
  SELECT key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key) AS place FROM library_keys WHERE {scope} GROUP BY key) WHERE place <= most""")
