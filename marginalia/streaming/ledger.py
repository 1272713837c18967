"""Change detection as keyed state of a stream: what is indexed of each path, and how far each repository is.

``ladder`` holds hash and time of each path in Spark's state store. A listing row asks what has to be
done with its file (see ``maintain.changes``); only an outcome row, written once the file's chunks are stored, says that it is indexed. So
a file whose run failed or died before is parsed again by the next one, and a stream restarted from its checkpoint
goes on where it was. Where a micro-batch holds rows of several kinds or runs for a path, outcomes come first, then listings by run.

``watermarks`` holds the newest commit of each repository, told by a row a run (``summaries``). A run moves it if it came to its end
without an error; the history's (``<repo>:history``) is moved by any run without an error.

Both are dealt by key to as many tasks as spark.sql.shuffle.partitions says at the first start; a row costs one exchange with
the state store, a key one entry. Null paths and repositories are rows of no file and are left out; a null hash or time
equals nothing, so that its file is parsed. Rows that come twice change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "run long, source_path string, status string, file_hash string, file_modified_at string"
MARK = "run long, mark string, sha string"


class _Ladder(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.indexed = handle.getValueState("indexed", "file_hash string, file_modified_at string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = old = self.indexed.get() if self.indexed.exists() else (None, None)
        asked = []
        for row in rows:
            if row.ok is None:
                asked.append(row)
            elif row.ok:
                held = (row.file_hash, row.file_modified_at)
        for row in sorted(asked, key=lambda r: (r.run, str(r.file_modified_at), str(r.file_hash))):
            status = "parse"
            if not row.force and row.file_modified_at is not None and row.file_modified_at == held[1]:
                status = "skip"
            elif not row.force and row.file_hash is not None and row.file_hash == held[0]:
                status, held = "touch", (held[0], row.file_modified_at)
            yield Row(run=row.run, source_path=key[0], status=status, file_hash=row.file_hash, file_modified_at=row.file_modified_at)
        if held != old:
            self.indexed.update(held)

    def close(self) -> None:
        pass


class _Watermarks(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getValueState("reached", "number long, sha string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest, bad = {}, set()
        for row in rows:
            if not row.ok:
                bad.add(row.run)
            newest[row.run] = max(newest.get(row.run, (row.number, row.sha)), (row.number, row.sha))
        held = old = self.reached.get() if self.reached.exists() else None
        for run in sorted(newest):
            if run not in bad and (held is None or newest[run][0] > held[0]):
                held = newest[run]
            yield Row(run=run, mark=key[0], sha=None if held is None else held[1])
        if held is not None and held != old:
            self.reached.update(held)

    def close(self) -> None:
        pass


def ladder(listing: DataFrame, outcomes: DataFrame, force: bool = False) -> DataFrame:
    """Status of each row of the stream ``listing`` (run, source_path, file_hash, file_modified_at): skip, touch or parse.

    ``outcomes`` (source_path, file_hash, file_modified_at, ok) is the stream of what became of the files to be parsed.
    """
    file = ["source_path", "file_hash", "file_modified_at"]
    asks = listing.select(F.col("run").cast("long"), *file, F.lit(None).cast("boolean").alias("ok"))
    told = outcomes.select(F.lit(None).cast("long").alias("run"), *file, F.coalesce("ok", F.lit(False)).alias("ok"))
    both = asks.unionByName(told).where("source_path is not null").withColumn("force", F.lit(force))
    return both.groupBy("source_path").transformWithState(_Ladder(), STATUS, "append", "none")


def summaries(commits: DataFrame) -> DataFrame:
    """A row for each run and repository of ``commits`` (run, repo, number, sha, error, cancelled): its newest commit, and whether anything went wrong."""
    newest = F.max(F.struct("number", "sha"))
    return commits.groupBy("run", "repo").agg(newest.alias("newest"), F.bool_or("error").alias("error"), F.bool_or("cancelled").alias("cancelled")).select("run", "repo", "newest.*", "error", "cancelled")


def watermarks(runs: DataFrame) -> DataFrame:
    """For each run and mark of the stream ``runs`` (see ``summaries``) the commit that is reached after it."""
    bad = F.coalesce("error", F.lit(False))
    own = F.struct(F.col("repo").alias("mark"), (~bad & ~F.coalesce("cancelled", F.lit(False))).alias("ok"))
    history = F.struct(F.concat("repo", F.lit(":history")).alias("mark"), (~bad).alias("ok"))
    rows = runs.where("repo is not null").select("run", "number", "sha", F.explode(F.array(own, history)).alias("m"))
    return rows.select("run", "number", "sha", "m.*").groupBy("mark").transformWithState(_Watermarks(), MARK, "append", "none")


def stored(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stores the stream's rows as Parquet, each once whatever is lost meanwhile. The session is left as it was found."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKS)
    try:
        return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(key, before)
