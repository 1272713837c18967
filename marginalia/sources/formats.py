"""Formats: bytes of a file to parts of text, by the standard library alone."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Part(NamedTuple):
    """A stretch of a file (a page, a chapter, all of it) with its own title and metadata."""

    text: str
    title: str | None = None
    metadata: dict = {}


def decoded(data: bytes) -> str:
    return data.decode("utf-8-sig", "replace")


# ---- plain text, CSV, JSON, XML, SQL, shell ----


def csv_text(text: str) -> str:
    """Fields joined by bars, blank rows dropped; what isn't CSV stays as it is."""
    try:
        rows = [" | ".join(field.strip() for field in row) for row in csv.reader(io.StringIO(text), strict=True)]
    except csv.Error:
        return text
    return "".join(f"{row}\n" for row in rows if row.strip(" |"))


def json_text(text: str) -> str:
    """Indented by two, keys sorted; what isn't JSON stays as it is."""
    try:
        pretty = json.dumps(json.loads(text), indent=2, sort_keys=True, ensure_ascii=False)
    except ValueError:
        return text
    return pretty.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def plain_parts(data: bytes, name: str) -> list[Part]:
    text, end = decoded(data), name.lower().rpartition(".")[2]
    return [Part(csv_text(text) if end == "csv" else json_text(text) if end == "json" else text)]


def trimmed_parts(data: bytes, name: str) -> list[Part]:
    return [Part(decoded(data).strip())]


# ---- HTML ----

class _Texts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.silent: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent = tag

    def handle_endtag(self, tag):
        if tag == self.silent:
            self.silent = None

    def handle_data(self, data):
        if self.silent is None and data.strip():
            self.found.append(data.strip())


def text_of_html(markup: str) -> str:
    """A line for each text node and each line in one, trimmed; scripts and styles are silent.

    Blank lines are dropped, so block elements, which only add some, need no rule.
    """
    parser = _Texts()
    parser.feed(markup)
    parser.close()
    return "\n".join(line.strip() for node in parser.found for line in node.split("\n") if line.strip())


def html_text(markup: Column) -> Column:
    """Text of each page. Of a batch some pages at a time are taken apart, as all of them at once would stand in memory several times."""

    @F.arrow_udf("string")
    def run(markups: pa.Array) -> pa.Array:
        return texts_of_html(markups)

    return run(markup)


#: Pages of a batch that are taken apart at once.
PAGES_AT_ONCE = 100


def texts_of_html(markups: pa.Array) -> pa.Array:
    parts = [pa.array([text_of_html(m or "") for m in markups.slice(low, PAGES_AT_ONCE).to_pylist()], pa.string()) for low in range(0, len(markups), PAGES_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def html_parts(data: bytes, name: str) -> list[Part]:
    return [Part(text_of_html(decoded(data)))]


# ---- Markdown notes ----

FENCE = "`" * 3


def front_matter(text: str) -> tuple[dict, str]:
    """What YAML between two lines of three dashes at the very start holds, and the rest; what isn't YAML is text."""
    lines = text.split("\n")
    end = next((k for k, line in enumerate(lines[1:], 1) if line.rstrip() == "---"), 0) if lines[0].rstrip() == "---" else 0
    if end:
        try:
            import yaml

            held = yaml.safe_load("\n".join(lines[1:end]))
            if held is None or isinstance(held, dict):
                return held or {}, "\n".join(lines[end + 1 :])
        except Exception:  # noqa: BLE001  a broken block stays in the text
            pass
    return {}, text


def outside_fences(text: str) -> Iterator[str]:
    """Lines that no fenced block holds."""
    inside = False
    for line in text.split("\n"):
        if line.startswith(FENCE):
            inside = not inside
        elif not inside:
            yield line


def tags_of(text: str) -> Iterator[str]:
    """Words led by a hash at the start of a line or after a blank, outside of code; a heading's hashes lead none."""
    for line in outside_fences(text):
        parts = line.split("`")
        for word in " ".join(parts[::2] if len(parts) % 2 else [*parts[:-1:2], parts[-1]]).split():
            if word[0] == "#" and len(word) > 1 and (word[1].isalnum() or word[1] == "_") and word[1].isascii():
                end = next((k for k, c in enumerate(word[1:], 1) if not (c.isascii() and (c.isalnum() or c in "_/-"))), len(word))
                yield word[1:end]


def without_queries(text: str) -> str:
    """Without fenced blocks of queries over notes."""
    kept, inside = [], False
    for line in text.split("\n"):
        if line.startswith(FENCE) and (inside or line[3:].strip() == "dataview"):
            inside = not inside
        elif not inside:
            kept.append(line)
    return "\n".join(kept)


def unlinked(text: str) -> tuple[str, list[str]]:
    """Links shown as their label and target, embedded files left out; and the targets of the links."""
    shown, targets, at = [], [], 0
    while (begin := text.find("[[", at)) >= 0 and (end := text.find("]]", begin)) >= 0:
        embedded = begin > at and text[begin - 1] == "!"
        shown.append(text[at : begin - embedded])
        target, bar, label = text[begin + 2 : end].partition("|")
        if not embedded:
            targets.append(target.strip())
            shown.append(f"{label} ({target})" if bar else target)
        at = end + 2
    return "".join([*shown, text[at:]]), targets


def few_blanks(text: str) -> str:
    """Two line feeds at most in a row."""
    while "\n" * 3 in text:
        text = text.replace("\n" * 3, "\n" * 2)
    return text.strip()


def markdown_note(text: str, name: str) -> Part:
    """Body, title, and metadata: front matter, tags (front matter's, then inline ones), links."""
    front, text = front_matter(text)
    given = front.pop("tags", None)
    tags = [t for t in given if isinstance(t, str)] if isinstance(given, list) else [t.strip() for t in given.split(",")] if isinstance(given, str) else []
    tags = list(dict.fromkeys(t for t in [*tags, *tags_of(text)] if t))
    body, links = unlinked(without_queries(text))
    title = front.get("title") if isinstance(front.get("title"), str) and front.get("title") else stem(name)
    metadata = {str(k): v for k, v in front.items()} | ({"tags": tags} if tags else {}) | ({"links": list(dict.fromkeys(links))} if links else {})
    return Part(few_blanks(body), title, metadata)


def stem(name: str) -> str:
    return posixpath.splitext(posixpath.basename(name))[0]


def markdown_parts(data: bytes, name: str) -> list[Part]:
    return [markdown_note(decoded(data), name)]


# ---- notebooks ----


def notebook_text(text: str) -> str:
    """Markdown cells as they are, code cells fenced with the kernel's language, outputs left out."""
    try:
        held = json.loads(text)
    except ValueError:
        return text.strip()
    if not isinstance(held, dict):
        return text.strip()
    about = held.get("metadata") or {}
    language = (about.get("language_info") or {}).get("name") or (about.get("kernelspec") or {}).get("language") or "python"
    language = re.sub(r"[^a-z0-9+#-]", "", str(language).lower()) or "python"
    cells = []
    for cell in held.get("cells") or []:
        source = cell.get("source") or ""
        source = "".join(source) if isinstance(source, list) else str(source)
        if source.strip() and cell.get("cell_type") in ("markdown", "code"):
            cells.append(source.strip() if cell["cell_type"] == "markdown" else f"```{language}\n{source.strip()}\n```")
    return "\n\n".join(cells)


def notebook_parts(data: bytes, name: str) -> list[Part]:
    return [Part(notebook_text(decoded(data)))]


# ---- Office documents ----


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """(type, path) of what a part refers to, by id; targets that lead out of the archive are left out."""
    folder, base = posixpath.split(part)
    try:
        root = ElementTree.fromstring(archive.read(posixpath.join(folder, "_rels", f"{base}.rels")))
    except (KeyError, ElementTree.ParseError):
        return {}
    out = {}
    for r in root:
        target = r.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        if not path.startswith(".."):
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], path)
    return out


def _paragraphs(root: ElementTree.Element, paragraph: str, run: str, breaks: dict[str, str]) -> Iterator[str]:
    for p in root.iter():
        if _local(p.tag) == paragraph:
            yield "".join((x.text or "") if _local(x.tag) == run else breaks.get(_local(x.tag), "") for x in p.iter())


def docx_parts(data: bytes, name: str) -> list[Part]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        main = next((path for kind, path in _relations(archive, "").values() if kind == "officeDocument"), "word/document.xml")
        root = ElementTree.fromstring(archive.read(main))
    return [Part("\n".join(t for t in _paragraphs(root, "p", "t", {"tab": "\t", "br": "\n"}) if t).strip())]


def pptx_parts(data: bytes, name: str) -> list[Part]:
    """Slides in the order of the presentation, else of their numbers; those with text are numbered."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        order: list[str] = []
        if "ppt/presentation.xml" in names:
            known = _relations(archive, "ppt/presentation.xml")
            ids = [v for x in ElementTree.fromstring(archive.read("ppt/presentation.xml")).iter() if _local(x.tag) == "sldId" for k, v in x.attrib.items() if _local(k) == "id" and k != "id"]
            order = [known[i][1] for i in ids if i in known and known[i][1] in names]
        if not order:
            order = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        slides = []
        for path in order:
            texts = _paragraphs(ElementTree.fromstring(archive.read(path)), "p", "t", {"br": "\n"})
            own = "\n".join(line.strip() for t in texts for line in t.split("\n") if line.strip())
            if own:
                slides.append(f"## Slide {len(slides) + 1}\n\n{own}")
    return [Part("\n\n".join(slides))]


SHEET_ROWS = 200_000


def xlsx_parts(data: bytes, name: str) -> list[Part]:
    """Each sheet as a section; formulas by their stored values; numbers as they are stored."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        known = _relations(archive, "xl/workbook.xml")
        sheets = [(x.get("name", ""), next((v for k, v in x.attrib.items() if _local(k) == "id" and k != "id"), "")) for x in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
        sections = []
        for title, relation in sheets:
            if relation not in known:
                continue
            rows = []
            for row in (x for x in ElementTree.fromstring(archive.read(known[relation][1])).iter() if _local(x.tag) == "row"):
                cells: list[str] = []
                for cell in row:
                    place = _column(cell.get("r", ""))
                    cells += [""] * (place - len(cells))
                    cells.append(_cell(cell, shared))
                if any(c.strip() for c in cells):
                    rows.append(" | ".join(cells))
                if len(rows) >= SHEET_ROWS:
                    break
            if rows:
                sections.append(f"## Sheet: {title}\n\n" + "\n".join(rows))
    return [Part("\n\n".join(sections))]


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return max(n - 1, 0)


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    value = next((v.text or "" for v in cell if _local(v.tag) == "v"), "")
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    return value


# ---- EPUB ----


def epub_parts(data: bytes, name: str) -> list[Part]:
    """A part for each chapter of the spine; its number is its place among those of text."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        opf = next(x.get("full-path", "") for x in container.iter() if _local(x.tag) == "rootfile")
        package = ElementTree.fromstring(archive.read(opf))
        items = {x.get("id"): x for x in package.iter() if _local(x.tag) == "item"}
        spine = [items[x.get("idref")] for x in package.iter() if _local(x.tag) == "itemref" and x.get("idref") in items]
        parts, number = [], 0
        for item in spine:
            if not re.search("html|xml", item.get("media-type", "")):
                continue
            number += 1
            path = posixpath.normpath(posixpath.join(posixpath.dirname(opf), item.get("href", "")))
            try:
                text = text_of_html(decoded(archive.read(path)))
            except KeyError:
                continue
            if text.strip():
                parts.append(Part(text, None, {"chapter_number": number}))
    return parts


# ---- PDF ----

PAGE_WORDS = 10


def pdf_parts(pages: list[str], ocr: Callable[[int], str] | None = None) -> list[Part]:
    """Decides on pages that a reader of the caller's choice has extracted: text of ten words, else
    what character recognition finds, else the sparse text."""
    parts = []
    for number, text in enumerate(pages, 1):
        seen = ocr(number) if ocr and len(text.split()) < PAGE_WORDS else ""
        if seen.strip():
            parts.append(Part(seen, None, {"page_number": number, "ocr": True}))
        elif text.strip():
            parts.append(Part(text, None, {"page_number": number}))
    return parts


def read_pdf(data: bytes, name: str) -> list[Part]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise NotImplementedError("reading PDF needs pypdf") from e
    return pdf_parts([p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages])


PARSERS: dict[str, Callable[[bytes, str], list[Part]]] = {
    "markdown": markdown_parts,
    "plaintext": plain_parts,
    "html": html_parts,
    "xml": trimmed_parts,
    "sql": trimmed_parts,
    "shell": trimmed_parts,
    "ipynb": notebook_parts,
    "docx": docx_parts,
    "pptx": pptx_parts,
    "xlsx": xlsx_parts,
    "epub": epub_parts,
    "pdf": read_pdf,
}
#: Types whose headings become sections.
SECTIONED = {"markdown", "xlsx", "pptx", "ipynb"}
