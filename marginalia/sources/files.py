"""File scans, and files as chunks."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import OVERLAP, SIZE, markdown_chunks, window_texts
from . import formats

# Source types by extension.
TYPES = {
    ".md": "markdown", ".pdf": "pdf", ".docx": "docx", ".dotx": "docx", ".html": "html", ".htm": "html", ".txt": "plaintext", ".csv": "plaintext",
    ".json": "plaintext", ".yaml": "plaintext", ".yml": "plaintext", ".epub": "epub", ".xlsx": "xlsx", ".pptx": "pptx", ".ipynb": "ipynb", ".xml": "xml",
    ".sql": "sql", ".sh": "shell", ".bash": "shell",
}


def source_type(path: Column) -> Column:
    """By the extension, whatever its case; null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.[^./]*$", 0)))


def excluded_names(names: Iterable[str]) -> list[str]:
    return [n.strip() for n in names if n.strip()]


def wanted(path: Column, root: str = "", exclude: Iterable[str] = ()) -> Column:
    """No hidden part and no excluded name below the root."""
    below = F.split(F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.char_length(path))).otherwise(path), "/")
    out = ~F.exists(below, lambda x: F.startswith(x, F.lit(".")))
    names = excluded_names(exclude)
    return out & ~F.arrays_overlap(below, F.array(*map(F.lit, names))) if names else out


def scan(spark: SparkSession, roots: list[str], exclude: Iterable[str] = (), content: bool = True) -> DataFrame:
    """``source_path, source_type, file_modified_at, length, content`` of files of a known type below the roots."""
    found = None
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        path = F.regexp_replace("path", "^file:/+", "/")
        # The root may itself be hidden or bear an excluded name.
        rows = files.select(path.alias("source_path"), source_type(path).alias("source_type"), F.col("modificationTime").cast("string").alias("file_modified_at"), "length", *(["content"] if content else []))
        rows = rows.where(F.col("source_type").isNotNull() & wanted(F.col("source_path"), posixpath.dirname(root) if posixpath.splitext(root)[1] else root, exclude))
        found = rows if found is None else found.unionByName(rows)
    return found.dropDuplicates(["source_path"]) if len(roots) > 1 else found


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2("content", 256))


def chunks_of(parts: list[formats.Part], kind: str, name: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[dict]:
    """Chunks of a parsed file, numbered through; metadata of a chunk goes over that of its part."""
    number = 0
    for part in parts:
        found = markdown_chunks(part.text, size, overlap) if kind in formats.SECTIONED else [(w, {}) for w in window_texts(part.text.strip(), size, overlap) or [""]]
        page = part.metadata.get("page_number") if kind == "pdf" else None
        title = part.title or (f"{name} (page {page})" if page else name)
        for text, own in found:
            metadata = {**part.metadata, **own}
            yield {"chunk_index": number, "title": title, "content": text, "metadata": json.dumps(metadata, ensure_ascii=False, default=str) if metadata else ""}
            number += 1


PARSED = "source_path string, source_type string, status string, message string, chunk_index int, title string, content string, metadata string"


def parsed(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk of each file; a file that can't be read, or has no text, gives one row with status ``failed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["source_path"], batch["source_type"], batch["content"], strict=True):
                name = posixpath.basename(path)
                try:
                    own = [c for c in chunks_of(formats.PARSERS[kind](bytes(content), name), kind, name, size, overlap)]
                    if not any(c["content"].strip() for c in own):
                        raise ValueError("no text")
                    rows += [{"source_path": path, "source_type": kind, "status": "indexed", "message": None, **c} for c in own]
                except Exception as e:  # noqa: BLE001  one bad file doesn't end the run; it is counted
                    rows.append({"source_path": path, "source_type": kind, "status": "failed", "message": f"{type(e).__name__}: {e}"[:500], "chunk_index": None, "title": None, "content": None, "metadata": None})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return files.select("source_path", "source_type", "content").mapInPandas(run, PARSED)
