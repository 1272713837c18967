"""Continuous ingestion: new and changed files become chunks, by micro-batches that merge by source.

Each batch writes its own generation under the library's folder; a reader takes of each
source the newest generation. A batch that is run again writes the same folder again, so
a lost executor or driver leaves no half-stored source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.embed import Embedder, embedded
from ..sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """Files of known types as they come."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = stream.select(path.alias("source_path"), files.source_type(path).alias("source_type"), F.col("modificationTime").alias("file_modified_at"), "content")
    return rows.where(F.col("source_type").isNotNull() & files.wanted(F.col("source_path"), folder))


def start(stream: DataFrame, library: str, checkpoint: str, make: Callable[[], Embedder] | None = None, **trigger) -> StreamingQuery:
    """Runs until stopped, or with ``availableNow=True`` until all that is there has been taken in."""

    def store(batch: DataFrame, generation: int) -> None:
        rows = files.parsed(batch).where("status = 'indexed'")
        if make is not None:
            rows = embedded(rows, make)
            # A source with a text that could not be embedded keeps what it had.
            whole = F.min(F.col("embedding").isNotNull()).over(Window.partitionBy("source_path"))
            rows = rows.withColumn("whole", whole).where("whole").drop("whole")
        rows.drop("status", "message").write.mode("overwrite").parquet(f"{library}/generation={generation}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def current(spark: SparkSession, library: str) -> DataFrame:
    """The chunks of each source's newest generation."""
    rows = spark.read.parquet(library)
    newest = rows.groupBy("source_path").agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["source_path", "generation"], "left_semi")


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of time, for a batch or a stream; late ones count until the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
