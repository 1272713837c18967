"""A library from nothing, through changes, to pruning."""

import os
import time

import pytest
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.operators.embed import HashingEmbedder
from marginalia.plans import indexing
from marginalia.plans.tools import Tools, WriteDeniedError
from marginalia.sources import books, files
from marginalia.sources.settings import Settings


def listing(spark, folder):
    return files.with_hash(files.scan(spark, [str(folder)]))


def test_runs(spark, tmp_path):
    collections = spark.createDataFrame([(1, "notes", "project", "", [], "")], schema.COLLECTIONS)
    lib = Tools(collections, *(spark.createDataFrame([], s) for s in (schema.SOURCES, schema.CHUNKS, schema.VECTORS)), HashingEmbedder(16), Settings(allow_write=True))
    for name, text in {"a.md": "# One\nalpha beta", "b.txt": "gamma", "blank.txt": " "}.items():
        (tmp_path / name).write_text(text)
    lib, counts = indexing.indexed(lib, 1, listing(spark, tmp_path), lambda: HashingEmbedder(16))
    assert tuple(counts.first()) == (2, 0, 1, 3)
    assert sorted(r.content for r in lib.chunks.collect()) == ["[One] alpha beta", "gamma"]
    assert {r.id for r in lib.chunks.collect()} == {r.document_id for r in lib.vectors.collect()}
    assert lib.search("gamma").first().content == "gamma"

    lib = Tools(*(df.checkpoint() for df in (lib.collections, lib.sources, lib.chunks, lib.vectors)), lib.embedder, lib.settings)
    time.sleep(1.1)
    (tmp_path / "b.txt").write_text("delta now")
    os.utime(tmp_path / "a.md")
    (tmp_path / "c.md").write_text("new one")
    before = {r.source_path: r.id for r in lib.sources.collect()}
    lib, counts = indexing.indexed(lib, 1, listing(spark, tmp_path), lambda: HashingEmbedder(16))
    assert tuple(counts.first()) == (2, 1, 1, 4)
    assert sorted(r.content for r in lib.chunks.collect()) == ["[One] alpha beta", "delta now", "new one"]
    after = {r.source_path: r.id for r in lib.sources.collect()}
    assert all(after[p] == i for p, i in before.items()) and len(set(after.values())) == 3
    times = {os.path.basename(r.source_path): r.file_modified_at for r in lib.sources.collect()}
    assert times["a.md"] == listing(spark, tmp_path).where("source_path LIKE '%a.md'").first().file_modified_at

    left = lib.prune(listing(spark, tmp_path).where("source_path NOT LIKE '%c.md'"))
    assert left.chunks.count() == 2 and left.vectors.count() == 2
    with pytest.raises(WriteDeniedError):
        indexing.indexed(Tools(lib.collections, lib.sources, lib.chunks, lib.vectors), 1, lib.sources, lambda: HashingEmbedder(16))


def test_failing_model_keeps_old_chunks(spark, tmp_path):
    class Failing(HashingEmbedder):
        def embed_batch(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return super().embed_batch(texts)

    (tmp_path / "a.md").write_text("# A\nold\n# B\ntext")
    collections = spark.createDataFrame([(1, "n", "project", "", [], "")], schema.COLLECTIONS)
    lib = Tools(collections, *(spark.createDataFrame([], s) for s in (schema.SOURCES, schema.CHUNKS, schema.VECTORS)), None, Settings(allow_write=True))
    lib, _ = indexing.indexed(lib, 1, listing(spark, tmp_path), lambda: Failing(8))
    (tmp_path / "a.md").write_text("# A\nnew\n# B\nbad")
    lib, counts = indexing.indexed(lib, 1, listing(spark, tmp_path), lambda: Failing(8), force=True)
    assert sorted(r.content for r in lib.chunks.collect()) == ["[A] old", "[B] text"] and counts.first().failed == 1


def test_order_and_lock():
    s = Settings(vaults=("/v",), repositories={"b": [], "x": []}, projects={"a": [], "x": []})
    assert indexing.run_order(s) == [("vault", "obsidian"), ("repo", "b"), ("project", "a")]
    with indexing.single_run(), pytest.raises(indexing.BusyError), indexing.single_run():
        pass
    assert indexing.ocr_languages(["deu", "eng"], ["deu"]) == ["deu"] and indexing.ocr_languages(["fra"], []) == ["eng"]


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 100, 1, 7).checkpoint()
    assert sorted(r.n for r in indexing.numbered(df, 5, "n").collect()) == list(range(5, 105))


def test_book_chunks(spark):
    pages = spark.createDataFrame([(1, 1, "a " * 30), (1, 2, "b"), (2, 1, "c")], "book_id long, number int, text string")
    about = spark.createDataFrame([(1, "about it"), (2, None)], "book_id long, description string")
    rows = books.book_chunks(pages, about, 20, 0).orderBy("book_id", "chunk_index").collect()
    assert [(r.book_id, r.chunk_index, r.chunk_type, r.number) for r in rows] == [(1, 0, "text", 1), (1, 1, "text", 1), (1, 2, "text", 2), (1, 3, "description", 0), (2, 0, "text", 1)]


def test_cached_vectors(spark):
    cache = spark.createDataFrame([(1, "m", "q", [1.0, 2.0])], schema.QUERY_CACHE)
    empty = [spark.createDataFrame([], s) for s in (schema.COLLECTIONS, schema.SOURCES, schema.CHUNKS, schema.VECTORS)]
    lib = Tools(*empty, HashingEmbedder(2), cache=cache, model_key="m")
    assert lib.query_vector("q") == [1.0, 2.0] and lib.query_vector("other") != [1.0, 2.0] and lib.query_vector(" ") is None
    assert lib.search("q").count() == 0 and F is not None


def test_query_vectors_are_forgotten_and_the_model_stays(spark):
    cache = spark.createDataFrame([(1, "m", "q", [1.0, 2.0]), (2, "m", "torn", [1.0])], schema.QUERY_CACHE)
    collections, sources, chunks = (spark.createDataFrame([], s) for s in (schema.COLLECTIONS, schema.SOURCES, schema.CHUNKS))
    vectors = spark.createDataFrame([(5, [1.0, 0.0])], schema.VECTORS)
    lib = Tools(collections, sources, chunks, vectors, HashingEmbedder(2), Settings(allow_write=True), cache=cache, model_key="m")
    # A vector of another length than the stored ones is dropped and made anew.
    assert len(lib.query_vector("torn")) == 2 and sorted(len(r.embedding) for r in lib.cache.collect()) == [2, 2]
    pruned = lib.prune(spark.createDataFrame([], "source_path string"))
    assert (pruned.cache.count(), pruned.model_key, pruned.index_of_text) == (0, "m", None)
    assert pruned.query_vector("q") != [1.0, 2.0] and pruned.cache.count() == 1
    other = lib.with_model(HashingEmbedder(2), "n")
    assert (other.cache.count(), other.model_key) == (0, "n")
    anew = lib.rebuilt(3)
    assert (anew.vectors.count(), anew.cache.count(), anew.model_key, anew._dimension()) == (0, 0, "m", 3)
    with pytest.raises(WriteDeniedError):
        Tools(collections, sources, chunks, vectors).rebuilt(3)
