"""Indexing: from a listing of files to the next state of a library.

scan -> status of each file -> parse and chunk what changed -> embed -> leave out items that are
not whole -> replace the chunks of their sources. Old chunks stay until the new ones are complete.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import maintain
from ..operators.embed import Embedder, embedded
from ..schema import CHUNKS_PER_SOURCE
from ..sources import files as fs
from ..sources.settings import Settings
from .tools import Tools

_running = threading.Lock()


class BusyError(RuntimeError):
    """A run is under way."""


@contextmanager
def single_run() -> Iterator[None]:
    """One run at a time in this driver; a second one is refused."""
    if not _running.acquire(blocking=False):
        raise BusyError("an indexing run is under way")
    try:
        yield
    finally:
        _running.release()


def run_order(settings: Settings) -> list[tuple[str, str]]:
    """Vaults, catalogs, then repositories and projects by name; names that conflict are left out."""
    bad = settings.name_conflicts()
    named = [("repo", n) for n in sorted(settings.repositories)] + [("project", n) for n in sorted(settings.projects)]
    fixed = [("vault", "obsidian")] * bool(settings.vaults) + [("catalog", "calibre")] * bool(settings.catalogs)
    return [(k, n) for k, n in fixed + named if n not in bad]


def numbered(df: DataFrame, start: int, name: str = "id") -> DataFrame:
    """Numbers from ``start`` on without gaps: places within partitions plus the sizes of those before.

    ``df`` has to be stored (read from files or checkpointed), so that both passes see the same partitions.
    """
    placed = df.withColumn("__part", F.spark_partition_id()).withColumn("__order", F.monotonically_increasing_id())
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    # A row for each partition.
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__order"))
    return placed.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__place") - 1 + start).drop("__part", "__order", "__place", "__before")


def indexed(tools: Tools, collection_id: int, files: DataFrame, make: Callable[[], Embedder], force: bool = False, store: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Tools, DataFrame]:
    """The library after a run over ``files`` (source_path, source_type, content, file_hash, file_modified_at), and its counters.

    ``store`` keeps an intermediate table (by default a checkpoint) so that parsing and
    embedding happen once.
    """
    tools._may_write()
    keep = store or (lambda df: df.checkpoint(eager=True))
    own = tools.sources.where(F.col("collection_id") == collection_id)
    statuses = keep(maintain.changes(files, own, force))
    parsed = fs.parsed(files.join(statuses.where("status = 'parse'"), "source_path", "left_semi"), tools.settings.chunk_size, tools.settings.chunk_overlap)
    rows = keep(embedded(parsed, make))

    known = own.select("source_path", F.col("id").alias("source_id"))
    fresh = keep(rows.where("status = 'indexed'").select("source_path").distinct().join(known, "source_path", "left_anti"))
    first = (tools.sources.agg(F.max("id")).first()[0] or 0) + 1
    ids = known.unionByName(numbered(fresh, first, "source_id").select("source_path", "source_id"))

    items = rows.where("status = 'indexed'").join(ids, "source_path")
    items = items.select(
        (F.col("source_id") * CHUNKS_PER_SOURCE + F.col("chunk_index")).alias("id"), "source_id", F.lit(collection_id).cast("long").alias("collection_id"),
        F.col("chunk_index").cast("long").alias("chunk_index"), "title", "content", "metadata", "embedding",
    )
    items = keep(items)
    whole = keep(maintain.complete_items(items))
    chunks = maintain.replaced(tools.chunks, items)
    old = tools.chunks.join(whole, "source_id", "left_semi").select(F.col("id").alias("document_id"))
    vectors = tools.vectors.join(old, "document_id", "left_anti").unionByName(items.join(whole, "source_id", "left_semi").select(F.col("id").alias("document_id"), "embedding"))

    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    taken = files.join(ids, "source_path").join(whole, "source_id", "left_semi")
    new = taken.select(F.col("source_id").alias("id"), F.lit(collection_id).cast("long").alias("collection_id"), "source_type", "source_path", "file_hash", "file_modified_at", now.alias("last_indexed_at"))
    touched = files.join(statuses.where("status = 'touch'"), "source_path", "left_semi").select("source_path", F.col("file_modified_at").alias("__time"))
    rest = tools.sources.join(new.select("id"), "id", "left_anti").join(touched, "source_path", "left")
    mine = F.col("collection_id") == collection_id
    rest = rest.withColumn("file_modified_at", F.when(mine & F.col("__time").isNotNull(), F.col("__time")).otherwise(F.col("file_modified_at"))).select(tools.sources.columns)
    sources = rest.unionByName(new.select(tools.sources.columns))

    failed = files.join(statuses.where("status = 'parse'"), "source_path", "left_semi").join(ids.join(whole, "source_id", "left_semi"), "source_path", "left_anti").select("source_path", F.lit("failed").alias("status"))
    counted = statuses.join(failed.select("source_path"), "source_path", "left_anti").unionByName(failed)
    return tools.changed(sources, chunks, vectors), maintain.run_counts(counted)


def ocr_languages(wanted: Iterable[str], installed: Iterable[str]) -> list[str]:
    """Those that are installed, in the order wanted; English if none is."""
    have = set(installed)
    return [x for x in wanted if x in have] or ["eng"]
