"""Read queries over a library: rollups, facets, timelines, pages, neighbours, whole sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..functions import text as tx

FACET_FIELDS = ("tags", "authors", "language", "symbol_type", "sender")
PAGE, MOST_PAGE = 100, 500


def joined(chunks: DataFrame, sources: DataFrame, collections: DataFrame) -> DataFrame:
    """Chunks with their source and collection (equi-joins; Spark picks by size)."""
    s = sources.select(F.col("id").alias("source_id"), "source_type", "source_path", "last_indexed_at")
    c = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection"), "collection_type")
    return chunks.join(s, "source_id").join(c, "collection_id")


# ---- rollups ----


def status_counts(collections: DataFrame, sources: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts and the last time of indexing."""
    parts = [df.agg(F.count("*")).scalar().alias(n) for n, df in (("collections", collections), ("sources", sources), ("chunks", chunks), ("vectors", vectors))]
    last = sources.agg(F.max(F.nullif("last_indexed_at", F.lit("")))).scalar().alias("last_indexed_at")
    return collections.sparkSession.range(1).select(*parts, last)


def collection_rollup(collections: DataFrame, sources: DataFrame, chunks: DataFrame, vectors: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each collection by aggregates that are joined, and whether it holds chunks without any vector."""
    s = sources.groupBy("collection_id").agg(F.count("*").alias("source_count"), F.max(F.nullif("last_indexed_at", F.lit(""))).alias("last_indexed_at"))
    own = vectors.select(F.col("document_id").alias("id"), F.lit(1).alias("vector")).distinct()
    c = chunks.select("id", "collection_id").join(own, "id", "left").groupBy("collection_id").agg(F.count("*").alias("chunk_count"), F.count("vector").alias("vector_count"))
    out = collections.join(s, collections.id == s.collection_id, "left").drop("collection_id").join(c, collections.id == c.collection_id, "left")
    return out.select(
        "name", "collection_type", F.coalesce("source_count", F.lit(0)).alias("source_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "last_indexed_at",
        F.coalesce((F.col("chunk_count") > 0) & (F.col("vector_count") == 0), F.lit(False)).alias("needs_reindex"),
        (~F.col("name").isin(*disabled) if disabled else F.lit(True)).alias("enabled"),
    ).orderBy("name")


def source_types(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_type")


def sample_titles(chunks: DataFrame, most: int = 10) -> DataFrame:
    """The first titles in order; blank ones go after the cut."""
    return chunks.select("title").where("title IS NOT NULL").distinct().orderBy("title").limit(most).where("trim(title) <> ''")


# ---- facets ----


def facet_keys(chunks: DataFrame, most: int = 40) -> DataFrame:
    return chunks.select(F.explode(md.keys("metadata")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(most)


def facet_values(chunks: DataFrame, fields: tuple[str, ...] = FACET_FIELDS, most: int = 8) -> DataFrame:
    """The most frequent values of each field."""

    def named(key: str) -> Column:
        return F.transform(md.values("metadata", key), lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))

    pairs = F.flatten(F.array(*map(named, fields)))
    counted = chunks.select(F.explode(pairs).alias("p")).select("p.key", "p.value").where("value <> ''").groupBy("key", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "value"))
    return counted.withColumn("place", place).where(F.col("place") <= most).drop("place")


def document_date(metadata: Column | str = "metadata", indexed: Column | str = "last_indexed_at") -> Column:
    """The document's own date, or when it was indexed."""
    return F.coalesce(md.own_date(metadata), F.col(indexed) if isinstance(indexed, str) else indexed)


def facet_dates(chunks_joined: DataFrame) -> DataFrame:
    own = F.nullif(tx.day(document_date()), F.lit(""))
    return chunks_joined.agg(F.min(own).alias("first_day"), F.max(own).alias("last_day"))


def facets_at_once(chunks_joined: DataFrame, fields: tuple[str, ...] = FACET_FIELDS, most_keys: int = 40, most_values: int = 8) -> DataFrame:
    """All facets from one scan: ``kind, name, value, n, first_day, last_day``.

    kind is source_type (name: the type, n: its sources), key (name: the key, n: chunks), value (name: the field) or dates. A
    chunk is taken apart to entries; a first aggregate counts equal ones, a second one counts a type's sources. Values of a field that
    a third of all chunks share are one row a task after the first.
    """

    def entry(kind: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("string").alias("value"))

    def values(name: str) -> Column:
        return F.transform(md.values("metadata", name), lambda v: entry("value", F.lit(name), v))

    nothing = F.lit(None).cast("string")
    parts = [
        F.array(entry("source_type", F.col("source_type"), F.col("source_id")), entry("dates", nothing, nothing)),
        F.transform(md.keys("metadata"), lambda k: entry("key", k, nothing)),
        *map(values, fields),
    ]
    own = F.nullif(tx.day(document_date()), F.lit(""))
    entries = chunks_joined.select(own.alias("day"), F.explode(F.concat(*parts)).alias("e")).select("e.*", F.when(F.col("e.kind") == "dates", F.col("day")).alias("day"))
    kept = entries.where("kind <> 'value' OR value <> ''")
    counted = kept.groupBy("kind", "name", "value").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    value = F.when(F.col("kind") == "value", F.col("value"))
    summed = counted.groupBy("kind", "name", value.alias("value")).agg(F.sum(F.when(F.col("kind") == "source_type", 1).otherwise(F.col("n"))).alias("n"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    group = F.when(F.col("kind") == "value", F.col("name"))
    place = F.row_number().over(Window.partitionBy("kind", group).orderBy(F.desc("n"), "name", "value"))
    most = F.when(F.col("kind") == "key", most_keys).when(F.col("kind") == "value", most_values)
    return summed.withColumn("place", place).where(most.isNull() | (F.col("place") <= most)).drop("place")


# ---- timeline, sources ----


def timeline(chunks_joined: DataFrame, predicate: Column | None = None, date_from: str = "", date_to: str = "", limit: int = 50) -> DataFrame:
    rows = chunks_joined.withColumn("doc_date", document_date())
    if predicate is not None:
        rows = rows.where(predicate)
    if date_from:
        rows = rows.where(tx.day("doc_date") >= date_from[:10])
    if date_to:
        rows = rows.where(tx.day("doc_date") <= date_to[:10])
    return rows.select("id", "title", "collection", "source_path", "source_type", "doc_date").orderBy(F.desc("doc_date"), "id").limit(tx.clamp(limit, 50, 1, 500))


def with_chunk_counts(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"))
    return sources.join(n, sources.id == n.source_id, "left").drop("source_id").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def list_sources(sources: DataFrame, chunks: DataFrame, match: str = "", limit: int = 200) -> DataFrame:
    rows = sources.where(tx.contains_folded("source_path", match)) if match else sources
    # The page is cut before chunks are counted for it.
    page = rows.orderBy("source_path", "id").limit(tx.clamp(limit, 200, 1, 1000))
    return with_chunk_counts(page, chunks).select("id", "source_path", "source_type", "last_indexed_at", "chunk_count").orderBy("source_path", "id")


# ---- pages ----


@dataclass(frozen=True)
class Cursor:
    source_id: int = 0
    chunk_index: int = 0

    def __str__(self) -> str:
        return f"{self.source_id}:{self.chunk_index}" if self.source_id or self.chunk_index else ""

    @staticmethod
    def parse(written: str) -> Cursor:
        """What isn't a cursor is read as the zero cursor."""
        a, _, b = written.partition(":")
        try:
            return Cursor(int(a), int(b))
        except ValueError:
            return Cursor()


def page_size(limit: int) -> int:
    return PAGE if limit <= 0 else min(limit, MOST_PAGE)


def _chunk_rows(chunks: DataFrame, cursor: str, n: int, backward: bool, collection_id: int | None) -> DataFrame:
    rows = chunks.select("id", "source_id", "collection_id", "chunk_index", "title")
    if collection_id is not None:
        rows = rows.where(F.col("collection_id") == collection_id)
    if backward and not cursor:
        return rows.where(F.lit(False))
    if cursor:
        at = Cursor.parse(cursor)
        s, i = F.col("source_id"), F.col("chunk_index")
        if backward:
            rows = rows.where((s <= at.source_id) & ((s < at.source_id) | (i < at.chunk_index)))
        else:
            rows = rows.where((s >= at.source_id) & ((s > at.source_id) | (i > at.chunk_index)))
    order = [F.desc("source_id"), F.desc("chunk_index")] if backward else ["source_id", "chunk_index"]
    return rows.orderBy(*order).limit(n).orderBy("source_id", "chunk_index")


def chunk_page(chunks: DataFrame, cursor: str = "", limit: int = PAGE, backward: bool = False, collection_id: int | None = None) -> DataFrame:
    """Rows after (before) the cursor in the order (source_id, chunk_index), without contents; of one collection or all.

    A page is a top-k over the key; files sorted by the key are skipped by their statistics.
    """
    return _chunk_rows(chunks, cursor, page_size(limit), backward, collection_id)


def _page(rows: list, n: int, cursor: str, backward: bool, key: Callable[[Row], str]) -> tuple[list, str, str]:
    """Cuts ``n + 1`` rows or less to a page and gives the cursors before and after it (empty: there is none).

    The row too many tells only of the direction walked; on the other side there is what the cursor came from.
    """
    more = len(rows) > n
    if more:
        rows = rows[1:] if backward else rows[:-1]
    if not rows:
        return [], "", ""
    before = key(rows[0]) if (more if backward else bool(cursor)) else ""
    after = key(rows[-1]) if backward or more else ""
    return rows, before, after


def page_with_cursors(chunks: DataFrame, cursor: str = "", limit: int = PAGE, backward: bool = False, collection_id: int | None = None) -> tuple[list, str, str]:
    """A page for a caller: its rows, and cursors to the page before and after."""
    n = page_size(limit)
    rows = _chunk_rows(chunks, cursor, n + 1, backward, collection_id).collect()
    return _page(rows, n, cursor, backward, lambda r: str(Cursor(r.source_id, r.chunk_index)))


def chunk_pages(chunks: DataFrame, limit: int = PAGE) -> DataFrame:
    """``page, rows, before, after``: all pages that a walk forward by ``page_with_cursors`` sees, from one sort of the keys.

    A row's place is that within its range and the number of rows in the ranges before; only these numbers, one a task, reach the driver.
    """
    n = page_size(limit)
    # Counting and numbering have to see the same ranges.
    ranged = chunks.select("source_id", "chunk_index").repartitionByRange("source_id", "chunk_index").sortWithinPartitions("source_id", "chunk_index").checkpoint(eager=True)
    counts = {r.part: r.n for r in ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()}
    starts = list(accumulate((counts.get(p, 0) for p in range(max(counts, default=0))), initial=0))
    # Task and place of a row within it.
    placed = ranged.withColumn("spot", F.monotonically_increasing_id())
    place = F.get(F.lit(starts), F.shiftright("spot", 33).cast("int")) + F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))
    row = F.struct(place.alias("place"), "source_id", "chunk_index")
    pages = placed.select(place.alias("place"), row.alias("row")).groupBy(F.floor(F.col("place") / n).cast("long").alias("page"))
    found = pages.agg(F.count("*").alias("rows"), F.min("row").alias("first"), F.max("row").alias("last"))

    def cursor(row: str) -> Column:
        return F.concat_ws(":", F.col(f"{row}.source_id").cast("string"), F.col(f"{row}.chunk_index").cast("string"))

    before = F.when(F.col("page") > 0, cursor("first")).otherwise("")
    after = F.when(F.col("last.place") + 1 < sum(counts.values()), cursor("last")).otherwise("")
    return found.select("page", "rows", before.alias("before"), after.alias("after"))


def _source_rows(sources: DataFrame, chunks: DataFrame, cursor: str, n: int, backward: bool, collection_id: int | None) -> DataFrame:
    rows = sources if collection_id is None else sources.where(F.col("collection_id") == collection_id)
    if backward and not cursor:
        rows = rows.where(F.lit(False))
    elif cursor:
        rows = rows.where(F.col("source_path") < cursor if backward else F.col("source_path") > cursor)
    page = rows.orderBy(F.desc("source_path") if backward else F.asc("source_path")).limit(n)
    return with_chunk_counts(page, chunks).select("id", "collection_id", "source_path", "source_type", "chunk_count", "last_indexed_at").orderBy("source_path")


def source_page(sources: DataFrame, chunks: DataFrame, cursor: str = "", limit: int = PAGE, backward: bool = False, collection_id: int | None = None) -> DataFrame:
    """Sources after (before) a path, in the order of paths; of one collection or all."""
    return _source_rows(sources, chunks, cursor, page_size(limit), backward, collection_id)


def source_page_with_cursors(sources: DataFrame, chunks: DataFrame, cursor: str = "", limit: int = PAGE, backward: bool = False, collection_id: int | None = None) -> tuple[list, str, str]:
    n = page_size(limit)
    rows = _source_rows(sources, chunks, cursor, n + 1, backward, collection_id).collect()
    return _page(rows, n, cursor, backward, lambda r: r.source_path)


# ---- chunks of a source ----


def neighbours(chunks: DataFrame, seed_id: int, before: int = 0, after: int = 0) -> DataFrame:
    """The chunk and those around it in its source, twenty to a side at most."""
    b, a = min(max(before, 0), 20), min(max(after, 0), 20)
    seed = chunks.where(F.col("id") == seed_id).select(F.col("source_id").alias("seed_source"), F.col("chunk_index").alias("seed_index"))
    near = (chunks.source_id == seed.seed_source) & chunks.chunk_index.between(seed.seed_index - b, seed.seed_index + a)
    return chunks.join(seed, near).select("id", "source_id", "chunk_index", "title", "content").orderBy("chunk_index")


def read_source(chunks: DataFrame, source_id: Column | int, heading: str = "", max_chars: int = 60_000) -> DataFrame:
    """The source's text: chunks in order with blank lines between, cut at a budget: ``source_id, content, truncated``."""
    most = tx.clamp(max_chars, 60_000, 1_000, 500_000)
    rows = chunks.where(F.col("source_id") == source_id)
    if heading:
        rows = rows.where(tx.contains_lower(F.coalesce(md.field("metadata", "heading_path"), F.lit("")), heading))
    # Only what the budget can reach is gathered.
    so_far = F.sum(F.char_length("content") + 2).over(Window.partitionBy("source_id").orderBy("chunk_index")) - F.char_length("content") - 2
    reached = rows.withColumn("__before", so_far)
    whole = reached.groupBy("source_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__before") < most, F.struct("chunk_index", "content")))), lambda x: x["content"]), "\n\n").alias("text"),
        F.max(F.col("__before") + F.char_length("content")).alias("length"),
    )
    return whole.select("source_id", F.left("text", F.lit(most)).alias("content"), (F.col("length") > most).alias("truncated"))


def resolve_source(sources_joined: DataFrame, path: str, collection: str = "") -> DataFrame:
    """Sources of that path: none, the one, or the candidates to choose from."""
    rows = sources_joined.where(F.col("source_path") == path)
    return rows.where(F.col("collection") == collection) if collection else rows
