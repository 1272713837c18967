"""Corpus pipeline: five stages from raw documents to a training mixture.

A stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last give the columns of
documents.

quality classifier     documents scored below 0.5 go
line dedup             lines that an earlier line equals, but for one edit, go from the texts
SimHash near-dedup     of each group of documents linked by SimHash fingerprints three bits apart at most, or by a five-word similarity
                       of 0.8, that with the smallest id stays
decontamination        documents in which a benchmark item is found go
source mixing          documents are repeated so that all sources weigh the same

Each row is judged by its own text, whatever other rows share its id; of rows of equal id and text
one stays after near-dedup. A row with a null id is no near-duplicate of any. Null and empty texts are
judged like any other: the classifier scores them, and texts without words are one group in near-dedup, of which one stays.
Very long texts are worked on whole. Ties go to the smallest id, then to the smaller hash of the text. An empty
table gives an empty result at each stage; further columns of documents, also such as bear names that the operators use
themselves, are kept as they are (but ``copy_no``, which mixing adds).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, line_dedup, mixing, near_copies, quality
from marginalia.llm.common import remove, shared_folder


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows of an Arrow batch: with long texts ten thousand, Spark's default, take hundreds of megabytes beside the heap of an executor.
BATCH_ROWS = 1000
#: Bits in which the fingerprints of near copies differ at most.
NEAR_BITS = 3


def in_small_batches(stage: Stage) -> Stage:
    """The stage, with smaller Arrow batches unless the session has smaller ones still."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_small_batches
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.deduplicated(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs, radius=NEAR_BITS)


@in_small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]

#: The classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            place = f"{shared_folder(spark)}/stage-{k}"
            docs.write.parquet(place)
            docs = spark.read.parquet(place)
            if before:
                # The result reads the last stage's table alone.
                remove(spark, before)
            before = place
    return docs
