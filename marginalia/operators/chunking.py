"""Chunkers: a row of text becomes rows of chunks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

SIZE, OVERLAP = 500, 50


def plain_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of the trimmed text; a blank one gives one empty chunk."""
    size, overlap = tx.clamp_window(size, overlap)
    found = tx.bound(tx.trimmed(text), lambda t: tx.windows(t, size, overlap))
    return tx.bound(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit(""))).otherwise(f))


def _overlapping(df: DataFrame, text_col: str, text: Column, size: int, overlap: int) -> DataFrame:
    """The rows of ``posexplode(tx.windows(text, size, overlap))`` where windows share most of their words; a text without words is left as it is.

    Words are joined once for the windows that begin within four times ``size`` words, and each window is cut out of their bytes, so a row holds five windows' words at most.
    """
    kept = [c for c in df.columns if c != text_col]
    step = size - overlap
    blocks = df.select(*kept, F.explode(tx.bound(text, lambda t: tx.window_blocks(t, size, overlap, 4 * size // step))).alias("block"))
    placed = blocks.select(*kept, F.col("block.first").alias("first"), F.array_join("block.words", " ").cast("binary").alias("joined"), tx.word_starts(F.col("block.words")).alias("starts"))
    # The last of the starts is where a next word would begin.
    last = F.size("starts") - 1
    more = F.greatest(F.ceil((last - size) / F.lit(step)).cast("int"), F.lit(0))
    cut = placed.select(*kept, "first", "joined", "starts", F.explode(F.sequence(F.lit(0), more)).alias("i"))
    begin, end = F.get("starts", F.col("i") * step), F.get("starts", F.least(F.col("i") * step + size, last))
    return cut.select(*kept, (F.col("first") + F.col("i")).alias("chunk_index"), F.substring("joined", begin + 1, end - begin - 1).cast("string").alias("content"))


def chunk_plain(df: DataFrame, text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_index`` and ``content`` beside the columns of ``df`` other than its text."""
    n, shared = tx.clamp_window(size, overlap)
    if 2 * shared > n:
        return _overlapping(df, text_col, tx.trimmed(F.col(text_col)), n, shared)
    return df.select(*[c for c in df.columns if c != text_col], F.posexplode(plain_chunks(F.col(text_col), size, overlap)).alias("chunk_index", "content"))


def chunk_code_windows(df: DataFrame, text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    size, overlap = tx.clamp_code_window(size, overlap)
    if 2 * overlap > size:
        return _overlapping(df.where(F.size(tx.words(text_col)) > 0), text_col, F.col(text_col), size, overlap)
    return df.select(*[c for c in df.columns if c != text_col], F.posexplode(tx.windows(F.col(text_col), size, overlap)).alias("chunk_index", "content"))


# ---- Markdown ----

FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})(.*)$", re.ASCII)
HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE | re.ASCII)


def fence_lines(lines: list[str]) -> list[bool]:
    """Which lines belong to fenced code; a fence without an end runs to the last line."""
    out, fence = [], None
    for line in lines:
        m = FENCE.match(line)
        if fence is None:
            if m:
                fence = m[1]
            out.append(fence is not None)
            continue
        out.append(True)
        if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            fence = None
    return out


def markdown_sections(text: str) -> list[tuple[list[str], str]]:
    """(heading path, body) in order; headings inside fences are text."""
    lines = text.split("\n")
    inside = fence_lines(lines)
    # Fenced lines are blanked for the search of headings; places stay the same.
    masked = "\n".join("\x00" * len(line) if own else line for line, own in zip(lines, inside, strict=True))
    sections, path, at = [], [], 0
    for m in HEADING.finditer(masked):
        sections.append((list(path_names(path)), text[at : m.start()]))
        level = len(m[1])
        path = [p for p in path if p[0] < level] + [(level, text[m.start(2) : m.end(2)].strip())]
        at = m.end()
    sections.append((list(path_names(path)), text[at:]))
    return sections


def path_names(path: list[tuple[int, str]]) -> list[str]:
    return [name for _, name in path]


def window_texts(text: str, size: int, overlap: int) -> list[str]:
    size, overlap = tx.clamp_window(size, overlap)
    own = text.split()
    if len(own) <= size:
        return [text] if own else []
    step = size - overlap
    return [" ".join(own[s : s + size]) for s in range(0, -(-(len(own) - size) // step) * step + 1, step)]


def markdown_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, dict]]:
    """(text, metadata) of each chunk; a section's heading path leads each of its chunks."""
    out: list[tuple[str, dict]] = []
    for path, body in markdown_sections(text):
        body = body.strip()
        if not body:
            continue
        name = " > ".join(path)
        lead = f"[{name}] " if path else ""
        meta = {"heading_path": name} if path else {}
        if len((lead + body).split()) <= size:
            out.append((lead + body, meta))
        else:
            out += [(lead + w, meta) for w in window_texts(body, size - len(lead.split()), overlap)]
    return out or [(text.strip(), {})]


def chunk_markdown(df: DataFrame, text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_index, content, metadata`` beside the other columns; the state of fences needs Python."""

    @F.pandas_udf("array<struct<content string, metadata string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"content": c, "metadata": json.dumps(m, ensure_ascii=False) if m else ""} for c, m in markdown_chunks(t or "", size, overlap)])

    others = [c for c in df.columns if c != text_col]
    parts = df.select(*others, F.posexplode(split(F.col(text_col))).alias("chunk_index", "__chunk"))
    return parts.select(*others, "chunk_index", "__chunk.content", "__chunk.metadata")


def commit_prefix(repo: Column, path: Column, sha: Column, date: Column) -> Column:
    return F.concat(F.lit("["), repo, F.lit("/"), path, F.lit("] [commit: "), F.left(sha, F.lit(7)), F.lit("] ["), tx.day(date), F.lit("]\n"))


def chunk_commits(changes: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = 50) -> DataFrame:
    """Chunks of text changes (repo, sha, author_date, subject, file_path, is_binary, diff), led by where and when."""
    kept = changes.where("NOT is_binary AND trim(coalesce(diff, '')) <> ''")
    lead = commit_prefix(F.col("repo"), F.col("file_path"), F.col("sha"), F.col("author_date"))
    body = F.concat(F.col("subject"), F.lit("\n\n"), F.col("diff"))
    kept = kept.withColumn("__lead", lead).withColumn("__body", body)
    room = F.greatest(F.lit(least), F.lit(size) - tx.word_count("__lead"))
    whole = tx.word_count(F.concat("__lead", "__body")) <= size

    def cut(own: Column) -> Column:
        """Windows of a size that depends on the row."""
        step = F.greatest(room - overlap, F.lit(1))
        last = (F.ceil((F.size(own) - room) / step) * step).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last, step), lambda s: F.array_join(F.slice(own, s + 1, room), " "))
        return F.when(whole | (F.size(own) <= room), F.array("__body")).otherwise(parts)

    bodies = tx.bound(tx.words("__body"), cut)
    out = kept.select(*changes.columns, "__lead", F.posexplode(bodies).alias("chunk_index", "__part"))
    return out.select(*changes.columns, "chunk_index", F.concat("__lead", "__part").alias("content"))
