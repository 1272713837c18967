"""Search, reading and maintenance on a small seeded library."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from marginalia.operators import filters, fusion, lexical, library, maintain, vector
from marginalia.operators.embed import HashingEmbedder, embedded
from marginalia.operators.filters import Filters
from marginalia.plans.hybrid import hybrid_search
from marginalia.plans.tools import Tools, WriteDeniedError
from marginalia.sources.settings import Settings


@pytest.fixture(scope="module")
def lib(spark):
    collections = spark.createDataFrame([(1, "notes", "system"), (2, "books", "project")], "id long, name string, collection_type string")
    sources = spark.createDataFrame(
        [(1, 1, "markdown", "/vault/a.md", "2026-01-02 03:00:00"), (2, 1, "markdown", "/vault/b.md", "2026-06-01 09:00:00"), (3, 2, "markdown", "/vault/a.md", "2026-02-01 00:00:00")],
        "id long, collection_id long, source_type string, source_path string, last_indexed_at string",
    )
    rows = [
        (1, 1, 1, 0, "a", "intro alpha content", json.dumps({"heading_path": "Intro", "tags": ["work"]})),
        (2, 1, 1, 1, "a", "second beta paragraph", json.dumps({"heading_path": "Body", "n": 42})),
        (3, 2, 1, 0, "b", "dated note gamma", json.dumps({"date": "2026-05-01", "authors": ["Ann Lee"], "sender": "Bob@x"})),
        (4, 3, 2, 0, "a", "book copy of a", "{}"),
    ]
    chunks = spark.createDataFrame(rows, "id long, source_id long, collection_id long, chunk_index long, title string, content string, metadata string")
    vectors = embedded(chunks.select("id", "content"), lambda: HashingEmbedder(64)).select(F.col("id").alias("document_id"), "embedding")
    return Tools(collections, sources, chunks, vectors, HashingEmbedder(64), Settings(vaults=("/vault",)))


def ids(df, name="id"):
    return [r[name] for r in df.collect()]


def test_reading(lib):
    assert ids(lib.get_chunk(2, 1, 1)) == [1, 2]
    assert lib.read_source("/vault/a.md") == {"candidates": ["books", "notes"]} or set(lib.read_source("/vault/a.md")["candidates"]) == {"books", "notes"}
    assert lib.read_source("/vault/a.md", "books")["content"] == "book copy of a"
    assert lib.read_source("/vault/a.md", "notes")["content"] == "intro alpha content\n\nsecond beta paragraph"
    assert lib.read_source("/vault/a.md", "notes", "intro")["content"] == "intro alpha content"
    with pytest.raises(KeyError):
        lib.read_source("/none")
    assert lib.status() == {"collections": 2, "sources": 3, "chunks": 4, "vectors": 4, "last_indexed_at": "2026-06-01 09:00:00"}
    assert lib.collection_info("notes")["sample_titles"] == ["a", "b"]
    assert ids(lib.list_sources(match="B.MD")) == [2] and lib.list_sources().count() == 3
    assert [r.name for r in lib.list_collections().collect()] == ["books", "notes"]


def test_grep(lib):
    assert ids(lib.grep("BETA")) == [2] and ids(lib.grep("ALPHA", regex=True)) == [] and ids(lib.grep(r"beta\s+paragraph", regex=True)) == [2]
    assert ids(lib.grep("beta", source_type="code")) == [] and lib.grep("a", collection="books").first().match == "a"


def test_timeline_and_facets(lib):
    assert ids(lib.timeline()) == [3, 4, 1, 2] or ids(lib.timeline())[0] == 3 and len(ids(lib.timeline())) == 4
    assert ids(lib.timeline(date_from="2026-05-01", date_to="2026-05-31")) == [3]
    found = lib.facets("notes")
    assert {(r.key, r.value): r.n for r in found["values"].collect()} == {("tags", "work"): 1, ("authors", "Ann Lee"): 1, ("sender", "Bob@x"): 1}
    assert tuple(found["date_range"].first()) == ("2026-01-02", "2026-05-01")
    assert {r.key: r.n for r in found["keys"].collect()}["heading_path"] == 2


@pytest.mark.parametrize(
    ("chosen", "want"),
    [
        (Filters(collection="system"), [1, 2, 3]), (Filters(collection="books"), [4]), (Filters(path="B.MD"), [3]), (Filters(sender="bob"), [3]), (Filters(author="LEE"), [3]),
        (Filters(date_from="2026-06-01"), [1, 2, 4]), (Filters(date_to="2026-05-01"), [1, 2, 3, 4]), (Filters(metadata={"n": "42"}), [2]), (Filters(metadata={"n": "4"}), []),
        (Filters(metadata={"tags": "WOR"}), [1]), (Filters(metadata={"heading_path": "bod"}), [2]), (Filters(metadata={"none": "x"}), []),
    ],
)
def test_filters(lib, chosen, want):
    assert sorted(ids(lib.joined.where(chosen.predicate()))) == want and chosen.any()


def test_no_filters():
    assert Filters(top_k=3).predicate() is None and not Filters(top_k=3).any()


def test_search(lib):
    found = lib.search("second beta").collect()
    assert found[0].id == 2 and 0 < found[0].score <= 1 and found[0].source_uri == "obsidian://open?vault=vault&file=a.md"
    lib_text = Tools(lib.collections, lib.sources, lib.chunks, lib.vectors)
    assert [r.id for r in lib_text.search("gamma").collect()] == [3]
    assert [r.id for r in lib_text.search("gamma", Filters(collection="books")).collect()] == []
    assert ids(lib.find_related(1, top_k=2), "id").count(1) == 0


def test_vectors(spark):
    rows = [(1, [1.0] + [0.0] * 1023), (2, [0.0, 1.0] + [0.0] * 1022), (3, [0.5] * 1024), (4, [0.5] * 1024), (5, [1.0])]
    v = spark.createDataFrame(rows, "document_id long, embedding array<float>")
    assert ids(vector.vector_search(v, rows[0][1], 1), "document_id") == [1]
    assert ids(vector.related(v, 3, 1), "document_id") == [4]
    assert vector.pool_size(10, False) == 200 and vector.pool_size(500, True) == 4000


def test_rrf(spark):
    a = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, place int")
    b = spark.createDataFrame([(0, 4), (2, 1)], "doc_id long, place int")
    scores = {r.doc_id: r.score for r in fusion.rrf(a, b).collect()}
    assert (round(scores[0], 2), round(scores[1], 2), round(scores[2], 2)) == (0.98, 0.69, 0.30)
    assert {r.doc_id: r.score for r in fusion.rrf(a, b, text_weight=0.0).collect()}[2] == 0.0


WORDS = "alpha beta gamma delta of the épsilon zeta".split()
SCRIPTS = "мой Дом й άλφα ΆΛΦΑ σίγμας ΣΊΓΜΑΣ 한국 한국어 がん カギ ガギ हिन्दी हन नमस्ते école ếch x́y ſoft straße STRASSE İki ǅ".split()
SCRIPT_QUERIES = ["мой", "МОЙ дом", "й", "άλφα", "σίγμας", "ΣΊΓΜΑΣ", "한국", "がん", "ガギ", "हिन्दी", "हन", "नमस्ते-école", "ecole", "ếch", "ech", "xy", "SOFT", "straße", "iki", "ǆ"]


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "gamma-delta", "of", "ALPHA gamma", "--", "alpha --", *SCRIPT_QUERIES])
def test_bm25_against_sqlite(spark, query):
    rng = random.Random(7)
    vocabulary = WORDS + SCRIPTS
    odds = [1, 2, 3, 1, 9, 9, 1, 1, *[2] * len(SCRIPTS)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=2)), " ".join(rng.choices(vocabulary, odds, k=rng.randrange(1, 25)))) for i in range(60)]
    connection = sqlite3.connect(":memory:")
    connection.execute("CREATE VIRTUAL TABLE f USING fts5(title, content)")
    connection.executemany("INSERT INTO f(rowid, title, content) VALUES (?, ?, ?)", rows)
    from marginalia.functions.text import escape_query

    want = connection.execute("SELECT rowid, rank FROM f WHERE f MATCH ? ORDER BY rank, rowid", (escape_query(query),)).fetchall()
    chunks = spark.createDataFrame(rows, "id long, title string, content string")
    found = [(r.doc_id, r["rank"]) for r in lexical.bm25(chunks, query).orderBy("rank", "doc_id").collect()]
    assert sorted(i for i, _ in found) == sorted(i for i, _ in want)
    assert all(dict(found)[i] == pytest.approx(r, rel=1e-12) for i, r in want)


@pytest.mark.parametrize("n", [0, 1, 9, 10, 47])
def test_all_pages_at_once(spark, n):
    rows = [(k, 7 * k % 11, k) for k in range(n)]
    chunks = spark.createDataFrame(rows, "id long, source_id long, chunk_index long").withColumn("collection_id", F.lit(1)).withColumn("title", F.lit("t")).repartition(5)
    want, cursor = [], ""
    while n and (cursor or not want):
        page, before, after = library.page_with_cursors(chunks, cursor, 10)
        want.append((len(want), len(page), before, after))
        cursor = after
    assert [tuple(r) for r in library.chunk_pages(chunks, 10).orderBy("page").collect()] == want


def test_statistics_and_ranks_share_one_scan(spark):
    """Tokens of a chunk are made once, however often the counts are read."""
    chunks = spark.createDataFrame([(k, "t", "some words " * k) for k in range(9)], "id long, title string, content string")
    plan = lexical.bm25(chunks, "words")._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "ExistingRDD" in plan


def test_pages(spark):
    rows = [(10 * k + s, s, 1, k, "t") for k in range(5) for s in (2, 1)]
    chunks = spark.createDataFrame(rows, "id long, source_id long, collection_id long, chunk_index long, title string")
    order = sorted(((s, k) for _, s, _, k, _ in rows))
    seen, cursor = [], ""
    while True:
        page, before, after = library.page_with_cursors(chunks, cursor, 3)
        seen.append([(r.source_id, r.chunk_index) for r in page])
        assert (before == "") == (cursor == "")
        if not after:
            break
        cursor = after
    assert sum(seen, []) == order and [len(p) for p in seen] == [3, 3, 3, 1]
    page, before, after = library.page_with_cursors(chunks, "2:2", 3, backward=True)
    assert [(r.source_id, r.chunk_index) for r in page] == [(1, 4), (2, 0), (2, 1)] and before and after
    assert library.page_with_cursors(chunks, "", 3, backward=True)[0] == []
    assert (str(library.Cursor()), str(library.Cursor(3, 4)), library.Cursor.parse("x"), library.Cursor.parse("3:4")) == ("", "3:4", library.Cursor(), library.Cursor(3, 4))
    assert [library.page_size(n) for n in (0, -1, 7, 9999)] == [100, 100, 7, 500]


# ---- maintenance ----


def test_changes(spark):
    known = spark.createDataFrame([("a", "h1", "t1"), ("b", "h2", "t1"), ("c", "h3", "t1"), ("d", "h4", "t1")], "source_path string, file_hash string, file_modified_at string")
    files = spark.createDataFrame([("a", "h1", "t1"), ("b", "h2", "t2"), ("c", "hx", "t2"), ("e", "h5", "t1")], known.schema)
    assert {r.source_path: r.status for r in maintain.changes(files, known).collect()} == {"a": "skip", "b": "touch", "c": "parse", "e": "parse"}
    assert {r.status for r in maintain.changes(files, known, force=True).collect()} == {"parse"}
    assert [r.source_path for r in maintain.removed(known, files).collect()] == ["d"]


def test_replacement_is_all_or_nothing(spark):
    chunks = spark.createDataFrame([(1, 1, "old"), (2, 2, "old")], "id long, source_id long, content string")
    items = spark.createDataFrame([(3, 1, "new", [1.0]), (4, 2, "new", [1.0]), (5, 2, "bad", None), (6, 3, " ", [1.0])], "id long, source_id long, content string, embedding array<float>")
    assert sorted((r.source_id, r.content) for r in maintain.replaced(chunks, items).collect()) == [(1, "new"), (2, "old")]


def test_prune_and_clear(lib):
    present = lib.sources.where("id = 1").select("source_path")
    with pytest.raises(WriteDeniedError):
        lib.prune(present)
    allowed = Tools(lib.collections, lib.sources, lib.chunks, lib.vectors, settings=Settings(allow_write=True))
    left = allowed.prune(present)
    assert ids(left.sources) == [1, 3] and sorted(ids(left.chunks)) == [1, 2, 4] and sorted(ids(left.vectors, "document_id")) == [1, 2, 4]
    assert sorted(ids(maintain.clear_collection(lib.sources, lib.chunks, lib.vectors, 1)[1])) == [4]
    assert ids(vector.orphans(left.vectors, lib.chunks.where("id <> 4")), "document_id") == [4]


def test_collections_and_models(spark, lib):
    with pytest.raises(maintain.TypeConflictError):
        maintain.collection_created(lib.collections, 9, "notes", "project")
    new = maintain.collection_created(lib.collections.withColumn("paths", F.array().cast("array<string>")), 9, "new", "project", ["/x"])
    assert new.where("name = 'new'").first().paths == ["/x"]
    models = spark.createDataFrame([(1, "m", "p", 8, 0, 0, True)], "id long, name string, path string, dimensions int, context_window int, batch_size int, is_active boolean")
    change = spark.createDataFrame([(7, "m2", "p", 0, 512, 16), (8, "n", "q", 4, 1, 1)], "id long, name string, path string, dimensions int, context_window int, batch_size int")
    out = {r.path: r for r in maintain.model_upserted(models, change).collect()}
    assert tuple(out["p"])[:6] == (1, "m2", "p", 8, 512, 16) and out["q"].id == 8 and not out["q"].is_active
    assert {r.path: r.is_active for r in maintain.model_activated(maintain.model_upserted(models, change), "q").collect()} == {"p": False, "q": True}
    with pytest.raises(KeyError):
        maintain.model_activated(models, "zzz")


def test_cache(spark):
    schema = "id long, model_key string, query string, embedding array<float>"
    cache = spark.createDataFrame([], schema)
    new = spark.createDataFrame([(i, "m", f"q{i % 7}", [float(i)] * 3) for i in range(8)] + [(9, "m", "empty", [])], schema)
    kept = maintain.cache_put(cache, new, 5)
    assert sorted(r["query"] for r in kept.collect()) == ["q2", "q3", "q4", "q5", "q6"]
    assert tuple(maintain.cache_stats(kept).first()) == (5, 5 * (12 + 2))
    assert spark.range(1).select(vector.query_vector(new, "m", "q1").alias("v")).first().v == [1.0] * 3


def test_plans_have_no_product(lib):
    for df in (lib.search("alpha"), lib.timeline(), lib.list_collections()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
    assert "TakeOrderedAndProject" in library.chunk_page(lib.chunks)._jdf.queryExecution().executedPlan().toString()
    assert not filters.not_blacklisted(F.lit("x"), []) is None and hybrid_search is not None


def test_embedding_failures(spark):
    class Failing(HashingEmbedder):
        def embed_batch(self, texts):
            if "bad" in texts:
                raise ValueError
            return super().embed_batch(texts)

    df = spark.createDataFrame([(f"t{i}",) for i in range(9)] + [("bad",)], "content string")
    found = {r.content: r.embedding for r in embedded(df, lambda: Failing(8)).collect()}
    assert found["bad"] is None and sum(v is not None for v in found.values()) == 9


def test_largest_pages_and_collections(spark):
    rows = [(k, k // 7, k // 7 % 2, k % 7, "t") for k in range(1200)]
    chunks = spark.createDataFrame(rows, "id long, source_id long, collection_id long, chunk_index long, title string").repartition(3)
    for own in (None, 1):
        want = [r[0] for r in rows if own is None or r[2] == own]
        seen, cursor, cursors = [], "", []
        while cursor or not seen:
            page, before, cursor = library.page_with_cursors(chunks, cursor, 500, collection_id=own)
            seen += [r.id for r in page]
            cursors.append(before)
        assert seen == want
        back, _, after = library.page_with_cursors(chunks, cursors[-1], 500, True, own)
        assert [r.id for r in back][-1] < want[500 * (len(cursors) - 1)] and len(back) == 500 and after
    sources = spark.createDataFrame([(k, k % 2, "text", f"/p{k:04}", "") for k in range(30)], "id long, collection_id long, source_type string, source_path string, last_indexed_at string")
    page, before, after = library.source_page_with_cursors(sources, chunks, "", 10, collection_id=1)
    assert [r.id for r in page] == list(range(1, 20, 2)) and (before, after) == ("", "/p0019")
    page, before, after = library.source_page_with_cursors(sources, chunks, after, 10, collection_id=1)
    assert [r.id for r in page] == list(range(21, 30, 2)) and (before, after) == ("/p0021", "")
    page, before, after = library.source_page_with_cursors(sources, chunks, before, 5, True, 1)
    assert [r.id for r in page] == list(range(11, 20, 2)) and (before, after) == ("/p0011", "/p0019")


def test_grep_report(spark):
    rows = [(k, k, 1, 0, "beta" if k % 2 else "no", json.dumps({"start_line": 3, "end_line": 9})) for k in range(60)]
    chunks = spark.createDataFrame(rows, "id long, source_id long, collection_id long, chunk_index long, content string, metadata string")
    report = lexical.grep_report(chunks, "b.ta", True, 10).first()
    assert (report.matches, report.limit_reached, report.scanned) == (10, True, 20)
    report = lexical.grep_report(chunks, "b.ta", True, 100).first()
    assert (report.matches, report.limit_reached, report.scanned) == (30, False, 60)
    assert lexical.grep_report(chunks, "BETA", limit=5).first().limit_reached
    assert {(r.start_line, r.end_line) for r in lexical.grep(chunks, "beta").collect()} == {(3, 9)}


def test_stored_index_ranks_like_the_chunks(lib, tmp_path):
    index = lexical.TextIndex.written(lib.chunks, str(tmp_path))
    for query in ("a", "second-beta", "alpha content", "nothing", "", "a a"):
        want, found = ({r.doc_id: r["rank"] for r in df.collect()} for df in (lexical.bm25(lib.chunks, query), index.bm25(query)))
        assert found == pytest.approx(want), query
    by_index = hybrid_search(lib.joined, lib.vectors, "beta", None, index=index).collect()
    assert by_index == hybrid_search(lib.joined, lib.vectors, "beta", None, chunks=lib.chunks).collect() == hybrid_search(lib.joined, lib.vectors, "beta", None).collect()


def test_a_missed_query_vector_is_kept(lib, spark):
    from marginalia.schema import QUERY_CACHE

    tools = Tools(lib.collections, lib.sources, lib.chunks, lib.vectors, lib.embedder, cache=spark.createDataFrame([], QUERY_CACHE), model_key="m")
    made = tools.query_vector("words")
    assert tools.cache.count() == 1 and tools.query_vector("words") == pytest.approx(list(made)) and tools.cache.count() == 1
    vectors, cache = maintain.rebuilt_vectors(lib.vectors, tools.cache, 32)
    assert vectors.count() == 0 and cache.count() == 0


def test_prune_of_a_type_reaches_all_its_collections(spark, lib):
    collections = lib.collections.withColumn("collection_type", F.lit("system"))
    tools = Tools(collections, lib.sources, lib.chunks, lib.vectors, settings=Settings(allow_write=True))
    assert tools.prune(lib.sources.where("false"), "system").sources.count() == 0
    counts = maintain.cascade_counts(lib.sources.where("collection_id = 1"), lib.chunks, lib.vectors).first()
    assert (counts.sources, counts.chunks, counts.vectors) == (2, 3, 3)
