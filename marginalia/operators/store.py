"""Stored library: tables by collection, changed as a whole or not at all.

A generation writes new folders for the collections that it changes; a manifest names the folder of each table and
collection and is renamed into place last. Readers see the generation before or the one after, and a run
that dies leaves folders that nobody names. Each change tells how many rows went, came and stayed.

The manifest records the dimension of the vectors, that of the first ones stored; others are refused until ``rebuilt`` drops all
vectors and records another one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "sources": ("id", "id long, collection_id long, source_type string, source_path string, file_hash string, file_modified_at string, last_indexed_at string"),
    "chunks": ("id", "id long, source_id long, collection_id long, chunk_index long, title string, content string, metadata string"),
    "vectors": ("document_id", "document_id long, collection_id long, embedding array<float>"),
}


def latest(spark: SparkSession, place: str) -> dict:
    """The newest manifest; an empty one where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/manifest")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []
    names = [n for n in names if n.endswith(".json")]
    return json.loads(spark.read.text(f"{place}/manifest/{names[-1]}", wholetext=True).first()[0]) if names else {"generation": 0, "folders": {t: {} for t in TABLES}}


def swap(spark: SparkSession, place: str, manifest: dict) -> None:
    """Puts the next manifest in place; fails if another writer was first."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{place}/manifest/{n}") for n in (f".{uuid.uuid4()}", f"{manifest['generation']:012d}.json")]
    files = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(paths[0])
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if files.exists(paths[1]) or not files.rename(*paths):
        raise RuntimeError(f"generation {manifest['generation']} has been written by another")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    place: str

    def table(self, name: str, collection_id: int | None = None, state: dict | None = None) -> DataFrame:
        """All rows, or those of one collection, which are the only ones read then."""
        folders = (state or latest(self.spark, self.place))["folders"][name]
        paths = [p for c, p in sorted(folders.items()) if collection_id is None or int(c) == collection_id]
        schema = TABLES[name][1]
        return self.spark.read.schema(schema).parquet(*[f"{self.place}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _written(self, name: str, rows: DataFrame, generation: int) -> dict[str, str]:
        """New folders by collection. Rows are dealt by collection, and adaptive execution splits large ones, so that these are several files; the rows are made once."""
        _, schema = TABLES[name]
        folder = f"{name}/g{generation}-{uuid.uuid4()}"
        columns = [c.split()[0] for c in schema.split(", ")]
        dealt = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).hint("rebalance", "collection_id")
        dealt.withColumn("part", F.col("collection_id")).write.partitionBy("part").parquet(f"{self.place}/{folder}")
        return {p.removeprefix("part="): f"{folder}/{p}" for p in self._parts(folder)}

    def _parts(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{folder}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        # As many as there are collections.
        return [x.getPath().getName() for x in found if x.isDirectory() and x.getPath().getName().startswith("part=")]

    def put(self, collection_ids: list[int], **tables: DataFrame) -> DataFrame:
        """Replaces the collections by the rows of ``sources``, ``chunks`` and ``vectors`` (all with collection_id; a table not given becomes empty there).

        Returns ``table_name, went, came, stayed``, by keys.
        """
        old = latest(self.spark, self.place)
        g = old["generation"] + 1
        new = {**old, "generation": g, "folders": {t: {c: p for c, p in old["folders"][t].items() if int(c) not in collection_ids} for t in TABLES}}
        for name, rows in tables.items():
            rows = rows.where(F.col("collection_id").isin(collection_ids))
            if name == "vectors":
                new["dimension"] = old.get("dimension") or self._dimension_of(rows)
                rows = rows.withColumn("embedding", self._fitting(new["dimension"]))
            new["folders"][name] |= self._written(name, rows, g)
        swap(self.spark, self.place, new)
        return self._told(collection_ids, old, new)

    @staticmethod
    def _dimension_of(vectors: DataFrame) -> int | None:
        row = vectors.where("size(embedding) > 0").select(F.size("embedding").alias("n")).first()
        return row.n if row else None

    @staticmethod
    def _fitting(dimension: int | None):
        """The vector; one of another dimension fails the write, and so the change. A null one has none."""
        size = F.size("embedding")
        wrong = F.raise_error(F.format_string("a vector of %s numbers, where %s are stored", size, F.lit(str(dimension)))).cast("array<float>")
        return F.when(F.col("embedding").isNull() | (size == F.lit(dimension)), F.col("embedding")).otherwise(wrong)

    @property
    def dimension(self) -> int | None:
        """Length of the stored vectors; none before any is stored."""
        return latest(self.spark, self.place).get("dimension")

    def rebuilt(self, dimension: int) -> DataFrame:
        """Drops the vectors of all collections and records the new dimension. Returns ``collection_id, went``."""
        old = latest(self.spark, self.place)
        swap(self.spark, self.place, {"generation": old["generation"] + 1, "dimension": dimension, "folders": {**old["folders"], "vectors": {}}})
        return self.table("vectors", None, old).groupBy("collection_id").agg(F.count("*").alias("went"))

    def unembedded(self) -> DataFrame:
        """Chunks without a vector: what has to be embedded after ``rebuilt``, or after a run that broke off."""
        state = latest(self.spark, self.place)
        return self.table("chunks", None, state).join(self.table("vectors", None, state).select(F.col("document_id").alias("id")), "id", "left_anti")

    def without_orphans(self) -> DataFrame:
        """Removes vectors whose chunk is gone; only collections that hold some are written. Returns ``collection_id, went``."""
        old = latest(self.spark, self.place)
        ids = self.table("chunks", None, old).select(F.col("id").alias("document_id"))
        gone = self.table("vectors", None, old).join(ids, "document_id", "left_anti").groupBy("collection_id").agg(F.count("*").alias("went"))
        # As many as there are collections.
        found = [r.collection_id for r in gone.collect()]
        if found:
            g = old["generation"] + 1
            own = self.table("vectors", None, old).where(F.col("collection_id").isin(found)).join(ids, "document_id", "left_semi")
            kept = {c: p for c, p in old["folders"]["vectors"].items() if int(c) not in found} | self._written("vectors", own, g)
            swap(self.spark, self.place, {**old, "generation": g, "folders": {**old["folders"], "vectors": kept}})
        return gone

    def _told(self, collection_ids: list[int], old: dict, new: dict) -> DataFrame:
        out = None
        for name, (key, _) in TABLES.items():
            sides = [self.table(name, None, x).where(F.col("collection_id").isin(collection_ids)).select(F.col(key).alias("key"), F.lit(k).alias("side")) for k, x in ((1, old), (2, new))]
            one = sides[0].unionByName(sides[1]).groupBy("key").agg(F.bit_or("side").alias("sides")).agg(*[F.count_if(F.col("sides") == k).alias(n) for k, n in ((1, "went"), (2, "came"), (3, "stayed"))])
            one = one.select(F.lit(name).alias("table_name"), "went", "came", "stayed")
            out = one if out is None else out.unionByName(one)
        return out

    def vacuumed(self) -> int:
        """Deletes folders and manifests that the latest state doesn't name; how many. For times when nobody reads an older state."""
        state = latest(self.spark, self.place)
        named = {p for own in state["folders"].values() for p in own.values()}
        fs = self.spark._jvm.org.apache.hadoop.fs
        files = fs.Path(self.place).getFileSystem(self.spark._jsc.hadoopConfiguration())
        n = 0
        for name in (*TABLES, "manifest"):
            root = fs.Path(f"{self.place}/{name}")
            for x in files.listStatus(root) if files.exists(root) else []:
                own = f"{name}/{x.getPath().getName()}"
                kept = own == f"manifest/{state['generation']:012d}.json" or any(p.startswith(f"{own}/") for p in named)
                n += not kept and files.delete(x.getPath(), True)
        return n
