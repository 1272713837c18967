"""Source code as blocks: definitions where the language is understood, windows of lines where not."""

from __future__ import annotations

import ast
import json
import posixpath
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.chunking import OVERLAP, SIZE

# Languages by extension and by file name.
LANGUAGES = {
    ".py": "python", ".go": "go", ".tf": "hcl", ".tfvars": "hcl", ".hcl": "hcl", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript",
    ".jsx": "javascript", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp",
    ".rb": "ruby", ".sh": "bash", ".bash": "bash", ".yaml": "yaml", ".yml": "yaml", ".json": "plaintext", ".txt": "plaintext",
    ".csv": "plaintext", ".md": "markdown", ".rst": "plaintext", ".toml": "toml", ".sql": "sql", ".xml": "plaintext", ".html": "html",
    ".htm": "html", ".css": "css", ".scss": "plaintext",
}
FILE_NAMES = {"Dockerfile": "dockerfile", "Makefile": "plaintext"}


class Block(NamedTuple):
    text: str
    start_line: int
    end_line: int
    symbol_name: str = ""
    symbol_type: str = ""
    symbol_path: str = ""


def language_of(path: str) -> str | None:
    name = posixpath.basename(path)
    return FILE_NAMES.get(name) or LANGUAGES.get(posixpath.splitext(name)[1].lower())


def n_words(lines: list[str]) -> int:
    return sum(len(line.split()) for line in lines)


def line_windows(lines: list[str], first: int, most: int, name: str = "", kind: str = "", path: str = "") -> Iterator[Block]:
    """Runs of whole lines of ``most`` words; a longer line is a block of its own."""
    held: list[str] = []
    at = first
    for k, line in enumerate([*lines, None]):
        if line is None or (held and n_words(held) + len(line.split()) > most):
            if any(x.strip() for x in held):
                yield Block("\n".join(held), at, at + len(held) - 1, name, kind, path)
            held, at = [], first + k
        if line is not None:
            held.append(line)


def python_blocks(text: str, most: int) -> list[Block] | None:
    """Definitions within the budget are blocks; larger ones are entered; what lies between is merged. None: not Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None
    lines = text.split("\n")
    definitions = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)

    def of(nodes: list[ast.stmt], first: int, last: int, path: str) -> Iterator[Block]:
        at = first
        for node in nodes:
            if not isinstance(node, definitions):
                continue
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            yield from line_windows(lines[at - 1 : start - 1], at, most)
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            own = lines[start - 1 : node.end_lineno]
            if n_words(own) <= most:
                yield Block("\n".join(own), start, node.end_lineno, node.name, kind, path)
            elif any(isinstance(x, definitions) for x in node.body):
                yield from of(node.body, start, node.end_lineno, f"{path} > {node.name}" if path else node.name)
            else:
                yield from line_windows(own, start, most, node.name, kind, path)
            at = node.end_lineno + 1
        yield from line_windows(lines[at - 1 : last], at, most)

    return list(of(tree.body, 1, len(lines), ""))


def blocks_of(text: str, language: str, most: int = SIZE) -> list[Block]:
    found = python_blocks(text, most) if language == "python" else None
    return found or list(line_windows(text.split("\n"), 1, most))


def header(block: Block, path: str, language: str) -> str:
    """Where a block stands: ``[path:lines] [language] [type: symbol]``."""
    shown = block.symbol_name
    if block.symbol_path:
        shown = block.symbol_path if not shown or shown.startswith("(") else f"{block.symbol_path} > {shown}"
    symbol = f" [{block.symbol_type}: {shown}]" if block.symbol_type and shown else ""
    return f"[{path}:{block.start_line}-{block.end_line}] [{language}]{symbol}\n"


CODE = "source_path string, chunk_index int, title string, content string, metadata string"


def code_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of code files (source_path, content as bytes), each led by its header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["source_path"], batch["content"], strict=True):
                language = language_of(path)
                if language is None:
                    continue
                for k, b in enumerate(blocks_of(bytes(content).decode("utf-8", "replace"), language, size)):
                    own = {"language": language, "symbol_name": b.symbol_name, "symbol_type": b.symbol_type, "start_line": b.start_line, "end_line": b.end_line, "file_path": path}
                    own |= {"symbol_path": b.symbol_path} if b.symbol_path else {}
                    rows.append((path, k, posixpath.basename(path), header(b, path, language) + b.text, json.dumps(own, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["source_path", "chunk_index", "title", "content", "metadata"])

    return files.select("source_path", "content").mapInPandas(run, CODE)
