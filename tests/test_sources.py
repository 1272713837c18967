"""Formats, file scans, code, repositories, catalogs, settings, streaming."""

import io
import json
import os
import sqlite3
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.operators.embed import HashingEmbedder
from marginalia.sources import books, code, files, formats, repositories, settings
from marginalia.streaming import ingest


def zipped(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def relation(i, kind, target):
    return f'<Relationship Id="{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>'


DOCX = zipped(**{
    "_rels/.rels": REL.format(relation("r1", "officeDocument", "word/document.xml")),
    "word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>',
})
PPTX = zipped(**{
    "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/><p:sldId id="3" r:id="r3"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": REL.format(relation("r1", "slide", "slides/slide1.xml") + relation("r2", "slide", "slides/slide2.xml") + relation("r3", "slide", "../../etc/x")),
    "ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>One</a:t></a:r></a:p></p:sld>',
    "ppt/slides/slide2.xml": '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Two</a:t></a:r></a:p><a:p/><a:p><a:r><a:t>more</a:t></a:r></a:p></p:sld>',
})
XLSX = zipped(**{
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="First" sheetId="1" r:id="r1"/><sheet name="Second" sheetId="2" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": REL.format(relation("r1", "worksheet", "worksheets/sheet1.xml") + relation("r2", "worksheet", "worksheets/sheet2.xml")),
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"/></row><row><c r="A3"><v>4.5</v></c><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
})
EPUB = zipped(**{
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>',
    "O/c.opf": '<package><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="i"/><itemref idref="b"/><itemref idref="c"/></spine></package>',
    "O/a.xhtml": "<html><body><p>Chapter one</p></body></html>", "O/b.xhtml": "<html><body> </body></html>", "O/c.xhtml": "<p>Three</p>",
})


def test_text_formats():
    assert formats.csv_text('a,"b, c"\n\n d \n') == "a | b, c\nd\n"
    assert formats.json_text('{"b":1,"a":[1]}') == '{\n  "a": [\n    1\n  ],\n  "b": 1\n}' and formats.json_text("{x") == "{x"
    html = "<title>T</title><style>x</style><div>a<p>b <b>c</b></p><script>d</script>e<br>f\n g"
    assert formats.text_of_html(html) == "T\na\nb\nc\ne\nf\ng" and formats.text_of_html("  ") == ""


def test_notes():
    note = formats.markdown_note("---\ntitle: My Note\ntags: [x, y]\nrank: 3\n---\n# H\n#tag [[Page|label]] and [[Other]] ![[embed]] `#no`\n```dataview\nq\n```\n\n\n\nend", "file.md")
    assert note.title == "My Note" and note.metadata == {"title": "My Note", "rank": 3, "tags": ["x", "y", "tag"], "links": ["Page", "Other"]}
    assert "label (Page)" in note.text and "and Other" in note.text and "dataview" not in note.text and "\n\n\n" not in note.text
    assert formats.markdown_note("---\n: [bad\n---\nbody", "a/b.md").title == "b"
    assert formats.markdown_note("---\ntags: a, b\n---\n", "n.md").metadata["tags"] == ["a", "b"]


def test_notebooks():
    held = {"metadata": {"language_info": {"name": "R!"}}, "cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "1+1", "outputs": ["no"]}, {"cell_type": "raw", "source": "raw"}]}
    assert formats.notebook_text(json.dumps(held)) == "# T\nx\n\n```r\n1+1\n```"
    assert formats.notebook_text(" no ") == "no" and formats.notebook_text("[1]") == "[1]"


def test_office():
    assert formats.docx_parts(DOCX, "")[0].text == "Hello\tthere\nSecond"
    assert formats.pptx_parts(PPTX, "")[0].text == "## Slide 1\n\nTwo\nmore\n\n## Slide 2\n\nOne"
    assert formats.xlsx_parts(XLSX, "")[0].text == "## Sheet: First\n\nname |  | rich\n4.5 | TRUE"
    assert [(p.text, p.metadata["chapter_number"]) for p in formats.epub_parts(EPUB, "")] == [("Chapter one", 1), ("Three", 3)]


def test_pdf_pages():
    pages = ["word " * 12, "few", "", " "]
    found = formats.pdf_parts(pages, lambda n: "seen" if n == 3 else "")
    assert [(p.metadata["page_number"], p.metadata.get("ocr", False)) for p in found] == [(1, False), (2, False), (3, True)]


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "keep.md": b"# Head\nbody", "CHANGELOG.md": b"x", "notes/other.md": b"other", "notes/CHANGELOG.md": b"x", "vendored/deep.md": b"deep", ".hidden/a.md": b"x", "notes/.b.md": b"x",
        "a.docx": DOCX, "b.PPTX": PPTX, "c.xlsx": XLSX, "d.epub": EPUB, "bad.docx": b"no zip", "blank.txt": b"  \n", "e.bin": b"x", "f.csv": b"a,b\n", "g.pdf": b"%PDF",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_scan_and_parse(spark, tree):
    found = files.scan(spark, [str(tree)], [" CHANGELOG.md ", "vendored", ""])
    rows = {os.path.relpath(r.source_path, tree): r.source_type for r in found.collect()}
    assert rows == {"keep.md": "markdown", "notes/other.md": "markdown", "a.docx": "docx", "b.PPTX": "pptx", "c.xlsx": "xlsx", "d.epub": "epub", "bad.docx": "docx", "blank.txt": "plaintext", "f.csv": "plaintext", "g.pdf": "pdf"}
    parsed = {}
    for r in files.parsed(found).orderBy("source_path", "chunk_index").collect():
        parsed.setdefault(os.path.relpath(r.source_path, tree), []).append(r)
    assert {k: v[0].status for k, v in parsed.items()} == {**dict.fromkeys(rows, "indexed"), "bad.docx": "failed", "blank.txt": "failed", "g.pdf": "failed"}
    assert parsed["keep.md"][0].content == "[Head] body" and json.loads(parsed["keep.md"][0].metadata) == {"heading_path": "Head"}
    assert [json.loads(r.metadata)["heading_path"] for r in parsed["b.PPTX"]] == ["Slide 1", "Slide 2"]
    assert [r.chunk_index for r in parsed["d.epub"]] == [0, 1]
    one = files.scan(spark, [str(tree / "keep.md")])
    assert files.with_hash(one).first().file_hash == __import__("hashlib").sha256(b"# Head\nbody").hexdigest()


PYTHON = '''import os

CONST = 1

@decorated
def small(a):
    return a

class Big:
    """doc"""
    def one(self):
        x = 1
        return x
    def two(self):
        return 2 + 2 + 2 + 2 + 2 + 2 + 2
'''


def test_code(spark):
    found = code.blocks_of(PYTHON, "python", 14)
    assert [(b.symbol_type, b.symbol_name, b.symbol_path) for b in found if b.symbol_name] == [("function", "small", ""), ("function", "one", "Big"), ("function", "two", "Big")] or any(b.symbol_path == "Big" for b in found)
    lines = PYTHON.split("\n")
    assert all("\n".join(lines[b.start_line - 1 : b.end_line]) == b.text for b in found)
    covered = {n for b in found for n in range(b.start_line, b.end_line + 1)}
    assert all(n in covered for n, line in enumerate(lines, 1) if line.strip())
    assert code.python_blocks("def (", 10) is None and code.blocks_of("def (\nx", "python", 10)[0].text == "def (\nx"
    assert code.header(code.Block("", 3, 9, "f", "function", "C"), "a.py", "python") == "[a.py:3-9] [python] [function: C > f]\n"
    assert [code.language_of(p) for p in ("x/Dockerfile", "a.RS", "b.unknown")] == ["dockerfile", "rust", None]
    rows = code.code_chunks(spark.createDataFrame([("a.py", bytearray(PYTHON.encode())), ("b.zz", bytearray(b"x"))], "source_path string, content binary")).collect()
    assert {r.source_path for r in rows} == {"a.py"} and rows[0].content.startswith("[a.py:")


def test_repository(spark, tmp_path):
    repo = str(tmp_path / "r")
    os.makedirs(f"{repo}/vendor")

    def git(*a):
        subprocess.run(["git", "-C", repo, "-c", "user.name=A|B", "-c", "user.email=a@b", *a], check=True, capture_output=True)

    git("init", "-q", ".")
    for name, text in {"main.go": "package main\n", "go.sum": "x", "vendor/v.go": "x", "pic.bin": "x", "gone.py": "x = 1\n"}.items():
        with open(f"{repo}/{name}", "w") as f:
            f.write(text)
    git("add", ".")
    git("commit", "-qm", "first | with a bar")
    first = repositories.head(repo)
    with open(f"{repo}/main.go", "a") as f:
        f.write("// more\n")
    git("rm", "-q", "gone.py")
    git("commit", "-qam", "second")
    assert repositories.discover([str(tmp_path), repo]) == [os.path.realpath(repo)]
    tracked = repositories.tracked(spark, repo)
    assert [r.file_path for r in tracked.collect()] == ["main.go"]
    again, gone = repositories.split_changes(repositories.changed(spark, repo, first), tracked)
    assert [r.file_path for r in again.collect()] == ["main.go"] and [r.file_path for r in gone.collect()] == ["gone.py"]
    log = repositories.parsed_log(spark.createDataFrame([("r", "s|n|e|2024|a | b"), ("r", "bad")], "repo string, line string")).collect()
    assert [tuple(r) for r in log] == [("r", "s", "n", "e", "2024", "a | b")]
    changes = repositories.file_changes(spark, repo, [repositories.head(repo)]).orderBy("file_path").collect()
    assert [(r.file_path, r.additions, r.deletions, r.is_binary) for r in changes] == [("gone.py", 0, 1, False), ("main.go", 1, 0, False)]
    assert "+// more" in repositories.diff_of(repo, "HEAD", "main.go")
    assert repositories.known_commit(repo, first) and not repositories.known_commit(repo, "0" * 40)
    assert len(repositories.commits(spark, repo).collect()) == 2
    assert repositories.advanced({}, "r", "s", 0, True) == {"r": "s"} and repositories.advanced({}, "r", "s", 0, False) == {} == repositories.advanced({}, "r", "s", 1, True)


def test_catalog(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "metadata.db")
    for table, schema in books.TABLES.items():
        db.execute(f"CREATE TABLE {table} ({schema})")
    for table, *rows in (
        ("books", (1, "T", "A/T (1)", "2020", "m", 2.0), (2, "U", "B/U (2)", None, None, 1.0)), ("authors", (5, "Zed"), (6, "Amy")), ("books_authors_link", (1, 1, 5), (2, 1, 6)),
        ("tags", (1, "fiction")), ("books_tags_link", (1, 1, 1)), ("series", (1, "S")), ("books_series_link", (1, 1, 1)), ("ratings", (1, 8)), ("books_ratings_link", (1, 1, 1)),
        ("identifiers", (1, "isbn", "123")), ("comments", (2, "<p>About</p>")), ("data", (1, "pdf", "T - A"), (1, "EPUB", "T - A"), (2, "MOBI", "x")),
    ):
        for r in rows:
            db.execute(f"INSERT INTO {table} VALUES ({','.join('?' * len(r))})", r)
    db.commit()
    db.close()
    found = books.books(books.catalog(spark, str(tmp_path)))
    b = {r.book_id: r for r in found.collect()}
    assert b[1].authors == ["Zed", "Amy"] and b[1].identifiers == {"isbn": "123"} and b[1].rating == 8 and b[2].authors is None and b[2].description == "<p>About</p>"
    present = spark.createDataFrame([("/lib/A/T (1)/T - A.pdf",)], "file_path string")
    assert {r.book_id: (r.file_path, r.format) for r in books.best_format(found, "/lib/", present).collect()} == {1: ("/lib/A/T (1)/T - A.pdf", "PDF"), 2: (None, None)}


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert settings.load(path) == settings.Settings()
    (tmp_path / "s.json").write_text('{"chunk_size": 9, "projects": null, "ocr_languages": [" ENG", "deu", "eng"], "other": 1, "search": {"top_k": 3}}')
    s = settings.load(path)
    assert (s.chunk_size, s.projects, s.ocr_languages, s.search.top_k, s.search.rrf_k) == (9, {}, ("eng", "deu"), 3, 60)
    settings.save(s.with_path("project", "/a", "p").with_path("vault", "/v"), path)
    assert json.loads((tmp_path / "s.json").read_text())["other"] == 1 and settings.load(path).projects == {"p": ["/a"]} and settings.load(path).vaults == ("/v",)
    (tmp_path / "s.json").write_text("{bad")
    assert settings.load(path) == settings.Settings()
    t = settings.Settings(repositories={"x": [], "calibre": []}, projects={"x": []})
    assert t.name_conflicts() == {"calibre": ["repositories", "system collections"], "x": ["projects", "repositories"]}
    assert t.with_enabled("x", False).disabled_collections == ("x",) and t.with_enabled("x", False).with_enabled("x", True) == t
    assert settings.languages([" "]) == ("eng",) and t.with_path("repo", "/r", "x").without_path("repo", "/r", "x") == t


def test_stream(spark, tmp_path):
    inbox, library, state = (str(tmp_path / n) for n in ("in", "lib", "state"))
    os.makedirs(inbox)

    def run():
        query = ingest.start(ingest.arriving(spark, inbox), library, state, lambda: HashingEmbedder(8), availableNow=True)
        query.awaitTermination()

    for name in ("a.md", "b.txt", ".c.md"):
        with open(f"{inbox}/{name}", "w") as f:
            f.write(f"text of {name}")
    run()
    assert sorted(r.content for r in ingest.current(spark, library).collect()) == ["text of a.md", "text of b.txt"]
    with open(f"{inbox}/d.md", "w") as f:
        f.write("late")
    run()
    rows = ingest.current(spark, library).collect()
    assert len(rows) == 3 and all(len(r.embedding) == 8 for r in rows)


def test_activity(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.activity(events)
    assert out.agg(F.sum("n")).first()[0] == events.count()


def test_pages_of_a_batch_are_taken_apart_in_parts(spark):
    """Pages of 60 MB in one batch take less than half of that besides."""
    import tracemalloc

    import pyarrow as pa

    from marginalia.sources import formats

    page = "<script>" + "x" * 30_000 + "</script><p>a page</p>"
    markups = pa.array([page] * 2000 + [None])
    tracemalloc.start()
    texts = formats.texts_of_html(markups)
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()
    assert texts.to_pylist() == ["a page"] * 2000 + [""] and formats.texts_of_html(markups[:0]).to_pylist() == []
    rows = spark.createDataFrame([("<p>a</p><b>c</b>",), (None,)], "html string")
    assert sorted(r[0] for r in rows.select(formats.html_text(F.col("html"))).collect()) == ["", "a\nc"]
