"""Change detection and watermarks as keyed state of streams."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import maintain
from marginalia.streaming import ledger

LISTING = "run long, source_path string, file_hash string, file_modified_at string"
OUTCOME = "source_path string, file_hash string, file_modified_at string, ok boolean"


class Runs:
    """A ladder over folders; each run restarts it from its checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.run = spark, folder, 0
        spark.createDataFrame([], OUTCOME).write.parquet(f"{folder}/outcomes")

    def stream(self, force=False):
        listing = self.spark.readStream.schema(LISTING).parquet(f"{self.folder}/listing")
        outcomes = self.spark.readStream.schema(OUTCOME).parquet(f"{self.folder}/outcomes")
        return ledger.ladder(listing, outcomes, force)

    def ask(self, files, force=False):
        self.run += 1
        self.spark.createDataFrame([(self.run, *f) for f in files], LISTING).write.mode("append").parquet(f"{self.folder}/listing")
        ledger.stored(self.stream(force), f"{self.folder}/result", f"{self.folder}/checkpoint").awaitTermination()
        rows = self.spark.read.parquet(f"{self.folder}/result").where(F.col("run") == self.run).collect()
        return sorted((r.source_path, r.status) for r in rows)

    def tell(self, files, ok=True):
        self.spark.createDataFrame([(*f, ok) for f in files], OUTCOME).write.mode("append").parquet(f"{self.folder}/outcomes")


def test_restarts_give_the_ladder_of_change_detection(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    runs = Runs(spark, str(tmp_path))
    first = [(f"/{k}", f"h{k}", "t1") for k in range(12)] + [(None, "h", "t")]
    assert {s for _, s in runs.ask(first)} == {"parse"} and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    # The run died before anything was stored: all are parsed again.
    assert {s for _, s in runs.ask(first)} == {"parse"}
    runs.tell(first[:9])
    runs.tell(first[9:12], ok=False)
    second = [(p, h if k % 3 else h + "!", "t1" if k % 2 else "t2") for k, (p, h, _) in enumerate(first[:12])] + [("/new", "h", "t")]
    known = spark.createDataFrame(first[:9], "source_path string, file_hash string, file_modified_at string")
    want = maintain.changes(spark.createDataFrame(second, "source_path string, file_hash string, file_modified_at string"), known)
    assert runs.ask(second) == sorted((r.source_path, r.status) for r in want.collect())
    # Touched ones have their new time; those to be parsed wait for their outcome, which may be told twice.
    parsed = [f for f, (_, s) in zip(sorted(second), sorted((r.source_path, r.status) for r in want.collect()), strict=True) if s == "parse"]
    runs.tell(parsed)
    runs.tell(parsed)
    assert {s for _, s in runs.ask(second)} == {"skip"}
    assert {s for _, s in runs.ask(second, force=True)} == {"parse"}
    # Neither hash nor time: parsed; a time alone is as good as before.
    assert runs.ask([("/0", None, None), ("/1", None, "t1")]) == [("/0", "parse"), ("/1", "skip")]


def test_a_stream_that_fails_goes_on_where_it_was(spark, tmp_path):
    runs = Runs(spark, str(tmp_path))
    files = [(f"/{k}", f"h{k}", "t") for k in range(4)]
    runs.ask(files)
    runs.tell(files)
    runs.run += 1
    spark.createDataFrame([(runs.run, *f) for f in files], LISTING).write.mode("append").parquet(f"{tmp_path}/listing")
    # The batch fails after the state has been asked, before anything is stored.
    broken = runs.stream().withColumn("status", F.when(F.col("run") == runs.run, F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="lost"):
        ledger.stored(broken, f"{tmp_path}/result", f"{tmp_path}/checkpoint").awaitTermination()
    ledger.stored(runs.stream(), f"{tmp_path}/result", f"{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/result").where(F.col("run") == runs.run).collect()
    assert sorted((r.source_path, r.status) for r in rows) == [(f"/{k}", "skip") for k in range(4)]


def test_watermarks_move_with_clean_runs_only(spark, tmp_path):
    schema = "run long, repo string, number long, sha string, error boolean, cancelled boolean"
    commits = [
        [(1, "a", 1, "a1", False, False), (1, "a", 2, "a2", False, False), (1, "b", 1, "b1", False, None), (1, "b", 2, "b2", True, False), (1, None, 3, "x", False, False)],
        [(2, "a", 3, "a3", False, True), (2, "b", 2, "b2", False, False), (3, "a", 4, "a4", None, None)],
        [(4, "a", 5, "a5", True, False), (4, "b", 1, "b1", False, False)],
    ]
    for rows in commits:
        ledger.summaries(spark.createDataFrame(rows, schema)).write.mode("append").parquet(f"{tmp_path}/runs")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/runs")
        ledger.stored(ledger.watermarks(stream), f"{tmp_path}/marks", f"{tmp_path}/checkpoint").awaitTermination()
    found = {(r.run, r.mark): r.sha for r in spark.read.parquet(f"{tmp_path}/marks").collect()}
    assert found == {
        (1, "a"): "a2", (1, "a:history"): "a2", (1, "b"): None, (1, "b:history"): None,
        (2, "a"): "a2", (2, "a:history"): "a3", (2, "b"): "b2", (2, "b:history"): "b2",
        (3, "a"): "a4", (3, "a:history"): "a4", (4, "a"): "a4", (4, "a:history"): "a4", (4, "b"): "b2", (4, "b:history"): "b2",
    }
