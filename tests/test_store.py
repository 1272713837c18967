"""Stored tables and batches of whole items."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import batching, store


def tables_of(spark, rows):
    """Rows (collection, id): a source with a chunk and a vector each."""
    df = spark.createDataFrame(rows, "collection_id long, id long")
    return {
        "sources": df.select("id", "collection_id", F.lit("md").alias("source_type"), F.concat(F.lit("/"), "id").alias("source_path")),
        "chunks": df.select("id", F.col("id").alias("source_id"), "collection_id", F.lit(0).cast("long").alias("chunk_index"), F.lit("t").alias("title"), F.lit("c").alias("content"), F.lit("").alias("metadata")),
        "vectors": df.select(F.col("id").alias("document_id"), "collection_id", F.array(F.lit(1.0).cast("float")).alias("embedding")),
    }


def held(own):
    return {t: sorted((r[0], r[1]) for r in own.table(t).select("collection_id", store.TABLES[t][0]).collect()) for t in store.TABLES}


def test_changes_by_collection(spark, tmp_path):
    own = store.Store(spark, str(tmp_path))
    assert held(own) == {t: [] for t in store.TABLES}
    told = own.put([1, 2], **tables_of(spark, [(1, 10), (1, 11), (2, 20)]))
    assert {tuple(r) for r in told.collect()} == {(t, 0, 3, 0) for t in store.TABLES}
    told = own.put([1], **tables_of(spark, [(1, 11), (1, 12), (2, 99)]))
    assert {tuple(r) for r in told.collect()} == {(t, 1, 1, 1) for t in store.TABLES}
    assert held(own) == {t: [(1, 11), (1, 12), (2, 20)] for t in store.TABLES}
    # One collection is read from its own folder.
    assert all("part=2" in f for f in own.table("chunks", 2).inputFiles())
    told = own.put([2])
    assert {tuple(r) for r in told.collect()} == {(t, 1, 0, 0) for t in store.TABLES}
    before = held(own)
    assert own.vacuumed() >= 4 and held(own) == before == {t: [(1, 11), (1, 12)] for t in store.TABLES}


@pytest.mark.parametrize("at", ["table", "manifest"])
def test_a_run_that_dies_leaves_the_state_before(spark, tmp_path, monkeypatch, at):
    own = store.Store(spark, str(tmp_path))
    own.put([1, 2], **tables_of(spark, [(1, 10), (2, 20)]))
    before = held(own)
    calls = []

    def dies(self, name, rows, g, written=store.Store._written):
        calls.append(name)
        if len(calls) == 2:
            raise OSError("killed")
        return written(self, name, rows, g)

    def dies_late(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(*((store.Store, "_written", dies) if at == "table" else (store, "swap", dies_late)))
        with pytest.raises(OSError):
            own.put([1], **tables_of(spark, [(1, 77)]))
    assert held(own) == before
    assert {tuple(r) for r in own.put([1], **tables_of(spark, [(1, 77)])).collect()} == {(t, 1, 1, 0) for t in store.TABLES}
    with pytest.raises(RuntimeError):
        store.swap(spark, own.place, {"generation": 2, "folders": {}})


def test_dimension_is_recorded(spark, tmp_path):
    own = store.Store(spark, str(tmp_path))
    assert own.dimension is None
    tables = tables_of(spark, [(1, 10), (1, 11), (2, 20)])
    own.put([1, 2], **tables)
    before = held(own)
    assert own.dimension == 1 and own.unembedded().count() == 0
    wide = tables["vectors"].withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")))
    with pytest.raises(Exception, match="a vector of 2 numbers"):
        own.put([1], **{**tables, "vectors": wide})
    assert held(own) == before
    assert sorted(tuple(r) for r in own.rebuilt(2).collect()) == [(1, 2), (2, 1)]
    assert held(own) == {**before, "vectors": []} and own.dimension == 2
    assert sorted(r.id for r in own.unembedded().collect()) == [10, 11, 20]
    with pytest.raises(Exception, match="a vector of 1 numbers"):
        own.put([1], **tables)
    own.put([1], **{**tables, "vectors": wide})
    assert held(own)["vectors"] == [(1, 10), (1, 11)] and [r.id for r in own.unembedded().collect()] == [20]


def test_orphans_go_with_counts(spark, tmp_path):
    own = store.Store(spark, str(tmp_path))
    tables = tables_of(spark, [(1, 10), (1, 11), (2, 20), (3, 30)])
    own.put([1, 2, 3], **{**tables, "chunks": tables["chunks"].where("id not in (11, 30)")})
    generation, untouched = store.latest(spark, own.place)["generation"], own.table("vectors", 2).inputFiles()
    assert sorted(tuple(r) for r in own.without_orphans().collect()) == [(1, 1), (3, 1)]
    assert held(own)["vectors"] == [(1, 10), (2, 20)] and own.table("vectors", 2).inputFiles() == untouched
    assert own.without_orphans().count() == 0 and store.latest(spark, own.place)["generation"] == generation + 1


def test_rows_are_made_once_for_a_write(spark, tmp_path):
    own, made = store.Store(spark, str(tmp_path)), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    tables = tables_of(spark, [(k % 3, k) for k in range(300)])
    tables["chunks"] = tables["chunks"].mapInPandas(counted, tables["chunks"].schema)
    own.put([0, 1, 2], **tables)
    assert made.value == 300 and len(held(own)["chunks"]) == 300
    assert {c: len(f) for c, f in store.latest(spark, own.place)["folders"].items()} == dict.fromkeys(store.TABLES, 3)


def test_a_large_collection_is_several_files(spark, tmp_path):
    own, key = store.Store(spark, str(tmp_path)), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    tables = tables_of(spark, [(1 + (k == 0), k) for k in range(20000)])
    tables["chunks"] = tables["chunks"].withColumn("content", F.sha2(F.col("id").cast("string"), 512)).repartition(8, "id")
    spark.conf.set(key, "200k")
    own.put([1, 2], **tables)
    spark.conf.unset(key)
    assert len(own.table("chunks", 1).inputFiles()) > 2 and own.table("chunks", 1).count() == 19999


def walked(sizes, target):
    out, still, number = [], 0, 0
    for n in sizes:
        out.append(number)
        still += n
        if still >= target:
            still, number = 0, number + 1
    return out


@pytest.mark.parametrize(("seed", "target"), [(0, 1), (1, 8), (2, 32)])
def test_batches_are_those_of_a_walk(spark, seed, target):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 1, 2, 3, 9, 40]) for _ in range(200)]
    items = spark.createDataFrame(list(enumerate(sizes)), "k long, n_chunks int").repartition(5)
    found = {r.k: r.batch for r in batching.item_batches(items, ["k"], target).collect()}
    spark.conf.unset(key)
    kept = [k for k, n in enumerate(sizes) if n]
    assert found == dict(zip(kept, walked([sizes[k] for k in kept], target), strict=True))


def test_ranges_compose():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 20, 60)
    for cut in (0, 1, 17, 60):
        a, b = batching.carried(sizes[:cut], 8), batching.carried(sizes[cut:], 8)
        whole = batching.carried(sizes, 8)
        assert (b[0][a[0]] == whole[0]).all() and (a[1] + b[1][a[0]] == whole[1]).all()
