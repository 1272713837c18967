"""Book catalogs kept in SQLite: tables read as rows, joined by Spark."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunking import OVERLAP, SIZE, chunk_plain

PREFERRED = ("EPUB", "PDF")
# Tables of a catalog and their columns.
TABLES = {
    "books": "id long, title string, path string, pubdate string, last_modified string, series_index double",
    "books_authors_link": "id long, book long, author long",
    "authors": "id long, name string",
    "books_tags_link": "id long, book long, tag long",
    "tags": "id long, name string",
    "books_series_link": "id long, book long, series long",
    "series": "id long, name string",
    "books_publishers_link": "id long, book long, publisher long",
    "publishers": "id long, name string",
    "books_ratings_link": "id long, book long, rating long",
    "ratings": "id long, rating long",
    "books_languages_link": "id long, book long, lang_code long",
    "languages": "id long, lang_code string",
    "identifiers": "book long, type string, val string",
    "comments": "book long, text string",
    "data": "book long, format string, name string",
}


def catalog(spark: SparkSession, library: str) -> dict[str, DataFrame]:
    """The tables of a library's ``metadata.db``, opened read-only."""
    connection = sqlite3.connect(f"file:{os.path.join(library, 'metadata.db')}?mode=ro", uri=True)
    try:
        out = {}
        for table, schema in TABLES.items():
            columns = ", ".join(f'"{c.split()[0]}"' for c in schema.split(", "))
            out[table] = spark.createDataFrame(connection.execute(f"SELECT {columns} FROM {table}").fetchall(), schema)
        return out
    finally:
        connection.close()


def books(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each book; lists in the order of their links."""

    def linked(link: str, side: str, key: str, value: str) -> DataFrame:
        names = tables[side].select(F.col("id").alias("side_id"), F.col(value).alias("value"))
        return tables[link].join(names, F.col(key) == F.col("side_id")).select("book", F.col("id").alias("place"), "value")

    def listed(df: DataFrame, name: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct("place", "value")))
        return df.groupBy("book").agg(F.transform(pairs, lambda p: p["value"]).alias(name))

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("book").agg(F.min_by("value", "place").alias(name))

    parts = [
        listed(linked("books_authors_link", "authors", "author", "name"), "authors"),
        listed(linked("books_tags_link", "tags", "tag", "name"), "tags"),
        one(linked("books_series_link", "series", "series", "name"), "series"),
        one(linked("books_publishers_link", "publishers", "publisher", "name"), "publisher"),
        one(linked("books_ratings_link", "ratings", "rating", "rating"), "rating"),
        listed(linked("books_languages_link", "languages", "lang_code", "lang_code"), "languages"),
        tables["identifiers"].groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("type", "val"))).alias("identifiers")),
        tables["comments"].groupBy("book").agg(F.max("text").alias("description")),
        tables["data"].groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct(F.upper("format"), "name"))).alias("formats")),
    ]
    out = tables["books"].withColumnRenamed("id", "book")
    for part in parts:
        out = out.join(part, "book", "left")
    return out.withColumnRenamed("book", "book_id")


def best_format(found: DataFrame, library: str, present: DataFrame) -> DataFrame:
    """``file_path`` and ``format``: the first preferred format whose file is among ``present`` (file_path)."""
    options = F.posexplode(F.array(*map(F.lit, PREFERRED))).alias("place", "format")
    paths = found.select("book_id", "path", "formats", options)
    name = F.element_at("formats", F.col("format"))
    paths = paths.select("book_id", "place", "format", F.concat(F.lit(library.rstrip("/") + "/"), "path", F.lit("/"), name, F.lit("."), F.lower("format")).alias("file_path"))
    kept = paths.join(present.select("file_path"), "file_path", "left_semi")
    first = kept.groupBy("book_id").agg(F.min_by(F.struct("file_path", "format"), "place").alias("best")).select("book_id", "best.*")
    return found.join(first, "book_id", "left")


def book_chunks(pages: DataFrame, descriptions: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of a book's chapters or pages (book_id, number, text), then of its description, numbered through."""
    body = chunk_plain(pages.select("book_id", F.lit(0).alias("kind"), "number", "text"), size=size, overlap=overlap)
    about = descriptions.where("trim(coalesce(description, '')) <> ''").select("book_id", F.lit(1).alias("kind"), F.lit(0).alias("number"), F.col("description").alias("text"))
    both = body.unionByName(chunk_plain(about, size=size, overlap=overlap))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("kind", "number", "chunk_index")) - 1
    kind = F.when(F.col("kind") == 1, "description").otherwise("text")
    return both.select("book_id", kind.alias("chunk_type"), "number", place.alias("chunk_index"), "content")


def gone_books(sources: DataFrame, books: DataFrame) -> DataFrame:
    """Sources of books (calibre://library/path) that no catalog lists any more; ``books`` has library and path."""
    listed = books.select(F.concat(F.lit("calibre://"), "library", F.lit("/"), "path").alias("source_path"))
    return sources.where(F.startswith("source_path", F.lit("calibre://"))).join(listed, "source_path", "left_anti")
