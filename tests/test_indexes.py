"""Stored indexes against the plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import lexical, segments, vector, vector_many


@pytest.fixture
def place(tmp_path):
    return str(tmp_path)


# ---- vectors ----


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "document_id long, embedding array<float>").repartition(5)


def clustered(seed, n, dimension, centres=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dimension))
    return [(int(k), middle[k % centres] + rng.normal(size=dimension) * 0.3) for k in rng.permutation(n)]


def test_many_queries_are_single_ones(spark):
    rows = [*clustered(1, 700, 16), (9000, None), (9001, [1.0] * 8), (9002, [1.0] * 8), (9003, [])]
    v = vectors_of(spark, rows)
    asked = [(i, x) for i, x in rows if i in (3, 77, 500, 9001)]
    queries = vectors_of(spark, asked).withColumnRenamed("document_id", "query_id")
    found = {}
    for r in vector_many.search_many(v, queries, 5).collect():
        found.setdefault(r.query_id, []).append((round(r.distance, 6), r.document_id))
    for i, x in asked:
        want = [(round(r.distance, 6), r.document_id) for r in vector.vector_search(v, [float(np.float32(c)) for c in x], 5).collect()]
        assert sorted(found[i]) == sorted(want)
    alone = vector_many.search_many(v, queries, 5, leave_out_self=True)
    assert alone.where("query_id = document_id").count() == 0 and {r["count"] for r in alone.where("query_id < 9000").groupBy("query_id").count().collect()} == {5}
    assert vector_many.search_many(v, queries.limit(0), 5).count() == 0


def test_queries_in_blocks(spark, monkeypatch):
    v = vectors_of(spark, clustered(2, 300, 8))
    queries = v.where("document_id % 20 = 0").withColumnRenamed("document_id", "query_id")
    whole = sorted(map(tuple, vector_many.search_many(v, queries, 3).collect()))
    monkeypatch.setattr(vector_many, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, vector_many.search_many(v, queries, 3).collect())) == whole and len(whole) == 45


def test_only_pools_leave_a_task(spark):
    v = vectors_of(spark, clustered(3, 2000, 8))
    queries = [(i, [1.0] * 8) for i in range(4)]
    held = spark.sparkContext.broadcast(queries)
    rows = v.mapInArrow(vector_many._held_pools(held, 10), "query_id long, hamming long, document_id long, distance double, part long")
    assert rows.count() <= 4 * 10 * v.rdd.getNumPartitions()


@pytest.mark.parametrize(("dimension", "size"), [(64, 250), (100, 40)])
def test_bit_index_has_the_same_pool(spark, place, dimension, size):
    rows = clustered(dimension + size, 300, dimension)
    v = vectors_of(spark, [*rows, (5000, None), (5001, [1.0] * 3)])
    index = vector_many.BitIndex.written(v, place, dimension)
    for _, x in rows[:1]:
        query = [float(c) for c in x]
        want = [(r.document_id, r.hamming) for r in vector.hamming_pool(v, query, size).collect()]
        assert [(r.document_id, r.hamming) for r in index.pool(query, size).collect()] == want
        assert [r.document_id for r in index.search(v, query, 3).collect()] == [r.document_id for r in vector.vector_search(v, query, 3).collect()]


def test_bit_index_reads_some_bands_only(spark, place):
    """Near copies of the query are found within a step or two, from the bands of these steps."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=64)) for k in range(1000)]
    rows += [(2000 + k, rows[0][1] + rng.normal(size=64) * 1e-3) for k in range(20)]
    v = vectors_of(spark, rows)
    index = vector_many.BitIndex.written(v, place, 64)
    query = [float(c) for c in rows[0][1]]
    assert index.steps(query, 20) <= 2
    found = index.looked_up(query, 2)
    assert found.count() < 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "band" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert [r.document_id for r in index.pool(query, 10).collect()] == [r.document_id for r in vector.hamming_pool(v, query, 10).collect()]


def test_bit_index_follows_the_number_of_vectors(spark, place):
    v = vectors_of(spark, clustered(4, 50, 64))
    vector_many.BitIndex.opened(v, place, 64)
    more = v.unionByName(vectors_of(spark, [(999, np.ones(64))]))
    assert vector_many.BitIndex.opened(more, place, 64).bands.select("document_id").distinct().count() == 51


# ---- text ----

WORDS = "alpha beta gamma delta of the épsilon zeta мой 한국".split()


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, content string").repartition(3)


def some_rows(ids, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(WORDS), " ".join(rng.choices(WORDS, [1, 2, 3, 1, 9, 9, 1, 1, 1, 1], k=rng.randrange(0, 25)))) for i in ids]


def same_ranks(index, spark, live):
    chunks = chunks_of(spark, sorted(live.values()))
    for query in ("of the-of", "мой gamma"):
        want = {r.doc_id: r["rank"] for r in lexical.bm25(chunks, query).collect()}
        found = {r.doc_id: r["rank"] for r in index.bm25(query).collect()}
        assert found.keys() == want.keys() and all(found[i] == pytest.approx(r, rel=1e-12) for i, r in want.items()), query
    for query in ("of the", "of the-of"):
        want = lexical.bm25(chunks, query).orderBy("rank", "doc_id").limit(4).collect()
        assert [r["rank"] for r in index.top(query, 4).collect()] == pytest.approx([r["rank"] for r in want])
    assert (index.manifest.chunks, index.index().lengths.count()) == (len(live), len(live))


def test_segments_follow_changes(spark, place):
    index = segments.SegmentedIndex(spark, place)
    assert index.bm25("alpha").count() == 0 and index.top("alpha", 3).count() == 0
    live = {}

    def put(rows, gone=()):
        added = chunks_of(spark, rows) if rows else None
        removed = spark.createDataFrame([(i,) for i in gone], "id long") if gone else None
        index.applied(added, removed)
        for i in gone:
            live.pop(i, None)
        live.update({r[0]: r for r in rows})

    put(some_rows(range(40), 1))
    put(some_rows(range(40, 60), 2), gone=[3, 4, 5, 999])
    put(some_rows(range(10, 25), 3))
    same_ranks(index, spark, live)
    put([], gone=[10, 41])
    put(some_rows([3, 10], 4))
    same_ranks(index, spark, live)
    before = index.manifest
    after = index.merged(2)
    assert len(after.segments) < len(before.segments)
    same_ranks(index, spark, live)
    put(some_rows([7, 70], 5), gone=[10])
    index.merged(2)
    assert index.vacuumed()
    same_ranks(index, spark, live)


def test_a_change_that_fails_leaves_the_state_before(spark, place, monkeypatch):
    index = segments.SegmentedIndex(spark, place)
    index.applied(chunks_of(spark, some_rows(range(20), 1)))
    before = index.manifest, sorted(map(tuple, index.bm25("of").collect()))

    def fails(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(segments, "write_manifest", fails)
        with pytest.raises(OSError):
            index.applied(chunks_of(spark, some_rows(range(5, 30), 2)))
    assert (index.manifest, sorted(map(tuple, index.bm25("of").collect()))) == before
    assert any(n.startswith("segment-2") for n in index.vacuumed())
    with pytest.raises(RuntimeError):
        segments.write_manifest(spark, place, before[0])


def test_blocks_that_cannot_reach_the_rank_are_skipped(spark, place):
    """Short chunks full of the word are in the first blocks; long ones hold it once."""
    rows = [(i, "t", "word " * 5) for i in range(20)] + [(i, "t", "word " + "filler " * (30 + i % 9)) for i in range(100, 2500)] + [(i, "t", "other") for i in range(3000, 7000)]
    index = segments.SegmentedIndex(spark, place)
    index.applied(chunks_of(spark, rows))
    m = index.manifest
    having = index._having(index.index(m), m, ["word"])
    bounds = index.bounds([["word"]], [having], m)
    found = index.top("word", 10).collect()
    assert having == 2420 and [r.doc_id for r in found] == list(range(10))
    reached = bounds.where(F.col("bound") >= -found[-1]["rank"] * (1 - 1e-12)).count()
    assert 1 <= reached <= 3 and bounds.count() > 15
    assert [r["rank"] for r in found] == pytest.approx([r["rank"] for r in lexical.bm25(chunks_of(spark, rows), "word").orderBy("rank", "doc_id").limit(10).collect()])


def test_postings_of_chunks_need_no_shuffle(spark):
    rows = [*some_rows(range(700), 6), (900, "of", None), (901, None, "of the of"), (902, None, None), (903, "", "-")]
    found = lexical.postings(chunks_of(spark, rows).coalesce(1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == chunks_of(spark, rows)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    want = {}
    for i, *columns in rows:
        for name, text in zip(("title", "content"), columns, strict=True):
            for k, term in enumerate(tx.tokens_of(text or "")):
                want.setdefault((i, name, term), []).append(k)
    assert sorted((r.doc_id, r.column_name, r.term, r.tf, r.positions) for r in found.collect()) == sorted((*key, len(at), at) for key, at in want.items())
    whole = {r.doc_id: r.tf for r in lexical.inverted(chunks_of(spark, rows)).where("term is null").collect()}
    assert whole == {i: sum(len(at) for key, at in want.items() if key[0] == i) for i, *_ in rows}


def shuffled_rows(spark, work):
    """Rows that the stages of some work write to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.jvm.java.util.ArrayList

    def rows():
        found = store.stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), none())
        return sum(found.apply(k).shuffleWriteRecords() for k in range(found.size()))

    before = rows()
    work()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return rows() - before


def test_postings_of_a_segment_are_neither_shuffled_nor_written_twice(spark, place):
    """What a change and a merge shuffle and store follows from chunks and terms."""
    rng = random.Random(8)
    rows = [(i, "t", " ".join(rng.choices([f"w{k}" for k in range(60)], k=80))) for i in range(1200)]
    spark.createDataFrame(rows, "id long, title string, content string").coalesce(3).write.parquet(f"{place}/chunks")
    chunks = spark.read.parquet(f"{place}/chunks")
    n = lexical.postings(chunks).count()
    index = segments.SegmentedIndex(spark, f"{place}/index")
    assert n > 50_000
    assert shuffled_rows(spark, lambda: index.applied(chunks.where("id < 700"))) < n / 20
    assert shuffled_rows(spark, lambda: index.applied(chunks.where("id >= 600"))) < n / 20
    assert shuffled_rows(spark, lambda: index.merged(2)) < n / 20
    m = index.manifest
    assert len(m.segments) == 1 and m.chunks == 1200
    # A row for each term and block.
    assert index._table("rows", m.segments, segments.ROWS).where("term is not null").count() < n / 5
    same_ranks_of(index, chunks, ["w1-w2 w7", "w3 w4"])


def same_ranks_of(index, chunks, queries):
    for query in queries:
        want = {r.doc_id: pytest.approx(r["rank"], rel=1e-12) for r in lexical.bm25(chunks, query).collect()}
        assert want and {r.doc_id: r["rank"] for r in index.bm25(query).collect()} == want
        best = lexical.bm25(chunks, query).orderBy("rank", "doc_id").limit(5).collect()
        assert [(r.doc_id, r["rank"]) for r in index.top(query, 5).collect()] == [(r.doc_id, pytest.approx(r["rank"])) for r in best]


@pytest.mark.parametrize("sent", [0, segments.SENT_IDS])
def test_small_blocks_are_dealt_anew_by_a_merge(spark, place, monkeypatch, sent):
    """Many small changes, most of them gone again, leave no more blocks than one large change does; whether tables are broadcast or joined."""
    monkeypatch.setattr(segments, "SENT_IDS", sent)
    rows = [(i, "t", "word " * (1 + i % 3) + "filler " * (60 - i % 3)) for i in range(80)]
    index = segments.SegmentedIndex(spark, place)
    for low in range(0, 80, 20):
        index.applied(chunks_of(spark, rows[low : low + 20]), spark.range(low - 10, low))
    live = [r for r in rows if r[0] >= 70 or r[0] % 20 < 10]
    before = index.bounds([["word"]], [len(live)], index.manifest).count()
    index.merged(2)
    m = index.manifest
    assert (m.chunks, len(m.segments), m.gone) == (len(live), 1, ())
    assert index.bounds([["word"]], [len(live)], m).count() == 1 < before
    same_ranks_of(index, chunks_of(spark, live), ["word", "word-filler"])


def test_rows_of_blocks():
    """Each posting once, with its block's bounds; texts without tokens are counted."""
    import pyarrow as pa

    rng = random.Random(3)
    columns = [[None if rng.random() < 0.1 else rng.choices(WORDS, k=rng.randrange(0, 25) if k else 1) for _ in range(600)] for k in range(2)]
    ids = rng.sample(range(10**6), 600)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(c, pa.list_(pa.string())) for c in columns]], ["id", "title", "content"]).slice(50)
    made, blocks = segments._rows_of(batch, 1000)
    rows = made.to_pylist()
    own = {c["doc_id"]: (r["block"], c["length"]) for r in rows if r["term"] is None for c in r["chunks"]}
    size = {i: len(a or ()) + len(b or ()) for i, a, b in list(zip(ids, *columns))[50:]}
    assert {i: n for i, (_, n) in own.items()} == size and {b for b, _ in own.values()} == set(range(1000, 1000 + blocks))
    assert all(r["n"] == len(r["chunks"] or r["docs"]) <= segments.BLOCK_ROWS for r in rows)
    want = {}
    for i, *texts in list(zip(ids, *columns))[50:]:
        for k, text in enumerate(texts):
            for at, term in enumerate(text or ()):
                want.setdefault((term, own[i][0]), {}).setdefault(i, ([], []))[k].append(at)
    found = {(r["term"], r["block"]): r for r in rows if r["term"] is not None}
    assert len(found) + blocks == len(rows)
    assert {key: {d["doc_id"]: (d["title"], d["content"]) for d in r["docs"]} for key, r in found.items()} == want
    for key, r in found.items():
        assert r["most"] == max(len(a) + len(b) for a, b in want[key].values()) and r["least"] == min(size[i] for i in want[key])
    nothing = pa.RecordBatch.from_arrays([pa.array([7, 8]), *[pa.array([None, []], pa.list_(pa.string()))] * 2], ["id", "title", "content"])
    assert [(r["term"], r["chunks"]) for r in segments._rows_of(nothing, 5)[0].to_pylist()] == [(None, [{"doc_id": 7, "length": 0}, {"doc_id": 8, "length": 0}])]


# ---- trigrams ----

TEXTS = ["The quick brown fox", "the QUICK fox", "ab", "", None, "a\nmatch over\nlines", "Straße KELVIN ſoft", "İstanbul ıstanbul istanbul", "quack quick quock", "(group) [x] 1+1=2", "мой Дом", "thble of and", "aXXXb aXXb"]
PATTERNS = [
    ("quick", False), ("QUICK FOX", False), ("ab", False), ("KELVIN", False), ("soft", False), ("ISTANBUL", False), ("мой дом", False), ("1+1", False), ("", False), ("straße", False),
    ("qu[ia]ck", True), ("(quick|brown) fox", True), ("quick|", True), ("(?:qua|quo)ck", True), ("(over\\s+)+lines", True), ("x{0,2}fox", True), ("aX{2}b", True), ("(?i)KELVIN", True),
    ("th[a-z]+ of (?:the|and)", True), ("match.over", True), ("^the", True), ("\\p{Lu}om", True), ("(?<=quick )fox", True), ("fox(?!x)", True),
]


@pytest.fixture(scope="module")
def gram_index(spark, tmp_path_factory):
    from marginalia.operators import grams

    rows = [(i, i, 1, 0, t) for i, t in enumerate(TEXTS)]
    chunks = spark.createDataFrame(rows, "id long, source_id long, collection_id long, chunk_index int, content string").repartition(2)
    return chunks, grams.GramIndex.written(chunks, str(tmp_path_factory.mktemp("grams")))


@pytest.mark.parametrize(("pattern", "regex"), PATTERNS)
def test_trigrams_find_what_a_scan_finds(gram_index, pattern, regex):
    chunks, index = gram_index
    want = [tuple(r) for r in lexical.matched(chunks, pattern, regex, None, 20).orderBy("id").collect()]
    assert [tuple(r) for r in index.grep(chunks, pattern, regex, context=20).orderBy("id").collect()] == want


def test_needs_of_patterns():
    from marginalia.operators import grams

    assert grams.pattern_needs("ab") == grams.Needs() == grams.pattern_needs("(abc|d)") == grams.pattern_needs("(abc)*") == grams.pattern_needs("(")
    assert grams.pattern_needs("abcd").grams == {"ABC", "BCD"}
    assert grams.pattern_needs("(abc)+x(def|ghi)").all_grams() == {"ABC", "DEF", "GHI"}
    assert not grams.literal_needs("xy")


def test_a_run_is_one_row_for_many_chunks(spark, place):
    from marginalia.operators import grams

    rng = random.Random(2)
    texts = ["".join(rng.choices("abc мÄ\U0001F600", k=rng.randrange(12))) for _ in range(300)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, content string").coalesce(1)
    rows = spark.read.parquet(f"{grams.GramIndex.written(chunks, place).place}/grams").collect()
    want = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 2):
            want.setdefault(grams.key_of(grams.folded_of(t)[i : i + 3]), set()).add(k)
    assert len(rows) == len(want) and {r.gram: set(r.ids) for r in rows} == want


def test_candidates_are_few(gram_index):
    from marginalia.operators import grams

    _, index = gram_index
    assert {r.id for r in index.candidates(grams.literal_needs("quock")).collect()} == {8}
    assert {r.id for r in index.candidates(grams.pattern_needs("(brown|quock)")).collect()} == {0, 8}
