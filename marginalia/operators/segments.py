"""A full-text index that follows insertions, deletions and rewritings, and a top-k that reads few postings.

The index is a set of segments, each written once. A change writes a segment of what is new and a table of
what is gone; both bear its generation, and a row is live unless its id is gone by a later generation. The number of
chunks, their tokens and the chunks of each term are kept as sums of segments less those of what is gone, so no
statistic needs a scan. Which tables count is told by a manifest that is renamed into place last: readers see
the state before a change or the one after it, whatever fails between. ``merged`` writes segments of one size class as one, without what is gone.

A task inverts its own chunks: no posting is shuffled, and none is written twice. Some thousand chunks at a time are ordered by length, and BLOCK_ROWS at
most, whose lengths lie within a twelfth of each other, make a block. A row has the postings of a term and a block, and with them the largest
frequency and the smallest length, which bound what the term can add to a rank; a row without a term has the block's chunks and their lengths. ``top`` ranks the
blocks by the sum of their terms' bounds, scores the best ones, and then those blocks alone that may still reach the k-th rank.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import lexical

BLOCK_ROWS = 128
#: Blocks that are scored first; segments of a size class that are merged, and how far sizes in a class lie apart.
FIRST_BLOCKS = 8
FANOUT = 4
#: Classes of length for each doubling; a block has chunks of one class.
CLASSES = 8
#: Blocks that a scan names one by one.
NAMED_BLOCKS = 500
#: Chunks and tokens that are inverted at once, which bound a task's memory.
AT_ONCE = 4096
TOKENS_AT_ONCE = 2**20
#: Ids of what is gone that are broadcast; more are joined as Spark decides.
SENT_IDS = 2**22
ROWS = "term string, block long, most long, least long, n long, docs array<struct<doc_id: long, title: array<int>, content: array<int>>>, chunks array<struct<doc_id: long, length: long>>"
NAMES = ["term", "block", "most", "least", "n", "docs", "chunks"]


def _block_rows(generation: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """ROWS of chunks (id, tokens of the title, of the content). Blocks are numbered by task, so that none is in two."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Far beyond these ranges two blocks may get one number, which makes one larger block.
        block = (generation % 2**20 << 43) + (TaskContext.get().partitionId() % 2**20 << 23)
        for batch in batches:
            tokens = np.cumsum(sum(_sizes(batch)))
            low = 0
            while low < batch.num_rows:
                most = np.searchsorted(tokens, (tokens[low - 1] if low else 0) + TOKENS_AT_ONCE, "right")
                high = min(low + AT_ONCE, max(low + 1, int(most)), batch.num_rows)
                made, blocks = _rows_of(batch.slice(low, high - low), block)
                yield made
                block, low = block + blocks, high

    return rows


def _sizes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)]


def _new(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; the first one does."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def _rows_of(batch: pa.RecordBatch, block: int) -> tuple[pa.RecordBatch, int]:
    """Rows of the blocks of these chunks, numbered from ``block`` on, and how many blocks these are."""
    n, sizes = batch.num_rows, _sizes(batch)
    length = sum(sizes)
    order = np.argsort(length, kind="stable")
    at, sorted_length = np.arange(n), length[order]
    new = _new(np.floor(np.log2(sorted_length + 1) * CLASSES))
    edges = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % BLOCK_ROWS == 0))
    blocks, own = len(edges), np.repeat(np.arange(len(edges)), np.diff(np.r_[edges, n]))
    ranked = np.empty(n, np.int64)
    ranked[order] = at

    values = pa.concat_arrays([batch.column(k).flatten() for k in (1, 2)]).dictionary_encode()
    # Rows that are in order by term within a window leave Spark's sort little to do.
    ordered = pc.array_sort_indices(values.dictionary).to_numpy()
    code = np.argsort(ordered)[values.indices.to_numpy(zero_copy_only=False)]
    chunk = ranked[np.concatenate([np.repeat(at, x) for x in sizes])]
    column = np.repeat(np.arange(2), [x.sum() for x in sizes])
    place = np.concatenate([np.arange(x.sum()) - np.repeat(np.cumsum(x) - x, x) for x in sizes])
    row = code * blocks + own[chunk]
    # By term, block and chunk; titles come first and places ascend already.
    by = np.argsort(row * n + chunk, kind="stable")
    code, row, chunk, column, place = code[by], row[by], chunk[by], column[by], place[by]

    first = np.flatnonzero(_new(row, chunk))
    f = np.diff(np.r_[first, len(row)])
    doc = np.repeat(np.arange(len(first)), f)
    places = []
    for k in (0, 1):
        ends = np.cumsum(np.bincount(doc[column == k], minlength=len(first)))
        places.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(place[column == k], pa.int32())))
    code, row, chunk = code[first], row[first], chunk[first]
    lead = np.flatnonzero(_new(row))
    terms, none = len(lead), np.zeros(blocks, np.int64)
    ids = batch.column(0).take(pa.array(order))
    docs = pa.StructArray.from_arrays([ids.take(pa.array(chunk)), *places], ["doc_id", "title", "content"])
    chunks = pa.StructArray.from_arrays([ids, pa.array(sorted_length)], ["doc_id", "length"])
    columns = [
        pa.concat_arrays([pa.nulls(blocks, pa.string()), values.dictionary.take(pa.array(ordered[code[lead]])).cast(pa.string())]),
        pa.array(block + np.r_[np.arange(blocks), own[chunk[lead]]]),
        pa.array(np.r_[none, np.maximum.reduceat(f, lead) if terms else lead]),
        pa.array(np.r_[sorted_length[edges], np.minimum.reduceat(sorted_length[chunk], lead) if terms else lead]),
        pa.array(np.r_[np.diff(np.r_[edges, n]), np.diff(np.r_[lead, len(row)])]),
        _listed(docs, np.r_[lead, len(row)], blocks, 0),
        _listed(chunks, np.r_[edges, n], 0, terms),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES), blocks


def _listed(values: pa.Array, edges: np.ndarray, before: int, after: int) -> pa.Array:
    """Lists between the edges, and nulls before and after them."""
    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
    return pa.concat_arrays([pa.nulls(before, lists.type), lists, pa.nulls(after, lists.type)])


@dataclass(frozen=True)
class Manifest:
    """The tables of one state: (name, generation, chunks, tokens) of segments and of what is gone."""

    generation: int = 0
    segments: tuple[tuple[str, int, int, int], ...] = ()
    gone: tuple[tuple[str, int, int, int], ...] = ()

    @property
    def chunks(self) -> int:
        return sum(x[2] for x in self.segments) - sum(x[2] for x in self.gone)

    @property
    def tokens(self) -> int:
        return sum(x[3] for x in self.segments) - sum(x[3] for x in self.gone)


def _files(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, place: str) -> Manifest:
    """The latest one; the empty state where there is none."""
    path, files = _files(spark, f"{place}/manifest")
    names = sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return Manifest()
    known = json.loads(spark.read.text(f"{place}/manifest/{names[-1]}", wholetext=True).first()[0])
    return Manifest(known["generation"], *(tuple(map(tuple, known[k])) for k in ("segments", "gone")))


def write_manifest(spark: SparkSession, place: str, manifest: Manifest) -> None:
    """Renamed into place when it is whole; fails if another writer was first."""
    draft, files = _files(spark, f"{place}/manifest/.{uuid.uuid4()}")
    out = files.create(draft)
    out.write(bytearray(json.dumps({"generation": manifest.generation, "segments": manifest.segments, "gone": manifest.gone}).encode()))
    out.close()
    final = _files(spark, f"{place}/manifest/{manifest.generation:012d}.json")[0]
    if files.exists(final) or not files.rename(draft, final):
        raise RuntimeError(f"generation {manifest.generation} has been written by another")


@dataclass(frozen=True)
class SegmentedIndex:
    spark: SparkSession
    place: str

    @property
    def manifest(self) -> Manifest:
        return read_manifest(self.spark, self.place)

    # ---- reading ----

    def _table(self, kind: str, tables: tuple[tuple[str, int, int, int], ...], schema: str) -> DataFrame:
        """The tables as one, with their generations."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.place}/{name}/{kind}").withColumn("generation", F.lit(g)) for name, g, *_ in tables]
        out = parts[0] if parts else self.spark.createDataFrame([], f"{schema}, generation int")
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _gone(self, manifest: Manifest) -> DataFrame:
        return self._table("ids", manifest.gone, "doc_id long").select(F.col("doc_id").alias("__gone"), F.col("generation").alias("__since"))

    def _live(self, rows: DataFrame, manifest: Manifest) -> DataFrame:
        """Rows (doc_id, generation) whose id isn't gone by a later generation."""
        if not manifest.gone:
            return rows
        return rows.join(self._gone(manifest), (F.col("doc_id") == F.col("__gone")) & (F.col("__since") > F.col("generation")), "left_anti")

    def _lengths(self, tables: tuple[tuple[str, int, int, int], ...]) -> DataFrame:
        """``doc_id, length, block, generation`` of all chunks of some segments, gone ones as well."""
        return self._table("rows", tables, ROWS).where("term is null").select("generation", "block", F.explode("chunks").alias("x")).select("x.doc_id", "x.length", "block", "generation")

    def _postings(self, tables: tuple[tuple[str, int, int, int], ...]) -> DataFrame:
        """``lexical.postings`` of them, with block and generation."""
        docs = self._table("rows", tables, ROWS).where("term is not null").select("term", "generation", "block", F.explode("docs").alias("x"))
        columns = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"x.{c}").alias("positions")) for c in ("title", "content")])
        each = docs.select("term", "generation", "block", F.col("x.doc_id").alias("doc_id"), F.explode(columns).alias("y")).where(F.size("y.positions") > 0)
        return each.select("doc_id", "y.column_name", "term", F.size("y.positions").cast("long").alias("tf"), "y.positions", "block", "generation")

    def index(self, manifest: Manifest | None = None) -> lexical.TextIndex:
        """Live postings and lengths."""
        m = manifest or self.manifest
        return lexical.TextIndex(self._live(self._postings(m.segments), m), self._live(self._lengths(m.segments), m))

    def bm25(self, query: str) -> DataFrame:
        """The same ranks as ``lexical.bm25`` over the live chunks; the statistics are those of the manifest."""
        m = self.manifest
        phrases = tx.query_phrases(query)
        own = self.index(m)
        if not phrases or m.chunks == 0:
            return own.lengths.select("doc_id", F.lit(0.0).alias("rank")).where(F.lit(False))
        return self._ranked(own, phrases, [self._having(own, m, p) for p in phrases], m)

    def _having(self, own: lexical.TextIndex, m: Manifest, phrase: list[str]) -> int:
        """Live chunks that hold a phrase: of one term by the sums, of several by their postings."""
        if len(phrase) > 1:
            return own.phrase(phrase).count()
        sums = [self._table(kind, t, "term string, n long") for kind, t in (("rows", m.segments), ("terms", m.gone)) if t]
        counts = [x.where(F.col("term") == phrase[0]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in sums]
        return counts[0] - sum(counts[1:])

    def _ranked(self, own: lexical.TextIndex, phrases: list[list[str]], having: list[int], m: Manifest) -> DataFrame:
        hits = own.lengths
        rank = F.lit(0.0)
        for k, phrase in enumerate(phrases):
            hits = hits.join(own.phrase(phrase).withColumnRenamed("f", f"f{k}"), "doc_id")
            rank = rank - self._weight(m, having[k]) * lexical.share(F.col(f"f{k}"), F.col("length"), F.lit(m.tokens / m.chunks))
        return hits.select("doc_id", rank.alias("rank"))

    @staticmethod
    def _weight(m: Manifest, having: int) -> Column:
        return lexical.weight(F.lit(m.chunks), F.lit(having))

    # ---- top-k ----

    def bounds(self, phrases: list[list[str]], having: list[int], m: Manifest) -> DataFrame:
        """``generation, block, bound``: what a chunk of the block can have at most, as a rank with the sign turned. Blocks without one of the terms are none."""
        rows = self._table("rows", m.segments, "term string, block long, most long, least long")
        out, bound = None, F.lit(0.0)
        for k, phrase in enumerate(phrases):
            own = None
            for t in set(phrase):
                # A merged block has a row of each of those it was made from.
                one = rows.where(F.col("term") == t).groupBy("generation", "block").agg(F.max("most").alias("most"), F.min("least").alias("least"))
                # A phrase stands as often as its rarest term at most.
                own = one if own is None else own.join(one.select("generation", "block", F.col("most").alias("m"), F.col("least").alias("l")), ["generation", "block"]).select(
                    "generation", "block", F.least("most", "m").alias("most"), F.greatest("least", "l").alias("least")
                )
            own = own.select("generation", "block", F.col("most").alias(f"most{k}"), F.col("least").alias(f"least{k}"))
            out = own if out is None else out.join(own, ["generation", "block"])
            bound = bound + self._weight(m, having[k]) * lexical.share(F.col(f"most{k}"), F.col(f"least{k}"), F.lit(m.tokens / m.chunks))
        return out.select("generation", "block", bound.alias("bound"))

    def top(self, query: str, k: int) -> DataFrame:
        """``doc_id, rank``: the k best chunks, as those of ``bm25``, from the blocks that can hold one."""
        m = self.manifest
        phrases = tx.query_phrases(query)
        if not phrases or m.chunks == 0:
            return self.bm25(query)
        own = self.index(m)
        having = [self._having(own, m, p) for p in phrases]
        bounds = self.bounds(phrases, having, m)
        first = [(r.generation, r.block, r.bound) for r in bounds.orderBy(F.desc("bound"), "generation", "block").limit(FIRST_BLOCKS).collect()]
        if not first:
            return self.bm25(query).limit(0)
        best = self._in_blocks(own, bounds.where(F.col("bound") >= first[-1][2]), phrases, having, m)
        ranks = [r["rank"] for r in best.orderBy("rank", "doc_id").limit(k).collect()]
        # Rounding may set a bound below its own chunk's rank in the last digit.
        least = -ranks[-1] * (1 - 1e-12) if len(ranks) == k else 0.0
        return self._in_blocks(own, bounds.where(F.col("bound") >= least), phrases, having, m).orderBy("rank", "doc_id").limit(k)

    def _in_blocks(self, own: lexical.TextIndex, blocks: DataFrame, phrases: list[list[str]], having: list[int], m: Manifest) -> DataFrame:
        """Ranks of the chunks of some blocks. A few are named, so that the scan of the sorted postings skips others; more are joined."""
        chosen = blocks.select("generation", "block")
        named = chosen.limit(NAMED_BLOCKS + 1).collect()
        if len(named) <= NAMED_BLOCKS:
            test = F.lit(False)
            for g in {r.generation for r in named}:
                test = test | ((F.col("generation") == g) & F.col("block").isin([r.block for r in named if r.generation == g]))
            return self._ranked(lexical.TextIndex(own.postings.where(test), own.lengths.where(test)), phrases, having, m)
        kept = lexical.TextIndex(own.postings.join(chosen, ["generation", "block"], "left_semi"), own.lengths.join(chosen, ["generation", "block"], "left_semi"))
        return self._ranked(kept, phrases, having, m)

    # ---- changing ----

    def applied(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> Manifest:
        """Adds chunks (id, title, content) and takes others (id) away; an added id that is live is rewritten."""
        old = self.manifest
        g = old.generation + 1
        segments, gone = list(old.segments), list(old.gone)
        ids = [] if removed is None else [removed.select(F.col("id").alias("doc_id"))]
        if added is not None:
            cut = added.select("id", tx.tokens("title").alias("title"), tx.tokens("content").alias("content"))
            made = self._segment(cut.mapInArrow(_block_rows(g), ROWS), g)
            segments.append(made)
            ids.append(self._lengths((made,)).select("doc_id"))
        if ids and old.segments:
            asked = (ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])).distinct()
            gone.append(self._taken(self._live(self._lengths(old.segments), old).join(asked, "doc_id", "left_semi"), old.segments, g))
        new = Manifest(g, tuple(segments), tuple(gone))
        write_manifest(self.spark, self.place, new)
        return new

    def _segment(self, rows: DataFrame, g: int) -> tuple[str, int, int, int]:
        """Writes a segment of ROWS. Each task sorts its own; blocks needn't meet, as no one is in two tasks unless it was merged."""
        name = f"segment-{g}-{uuid.uuid4()}"
        rows.select(*NAMES).sortWithinPartitions("term", "block").write.option("compression", "zstd").parquet(f"{self.place}/{name}/rows")
        n, tokens = self._lengths(((name, g, 0, 0),)).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return name, g, n, tokens

    def _taken(self, lost: DataFrame, segments: tuple[tuple[str, int, int, int], ...], g: int) -> tuple[str, int, int, int]:
        """Writes a table of what is gone: the ids of these rows of lengths, and how many of them hold each term of a block."""
        name = f"gone-{g}-{uuid.uuid4()}"
        lost.select("doc_id", "length", "block", "generation").write.parquet(f"{self.place}/{name}/ids")
        lost = self.spark.read.parquet(f"{self.place}/{name}/ids")
        n, tokens = lost.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        rows = self._table("rows", segments, ROWS).where("term is not null").select("term", "generation", "block", F.col("docs.doc_id").alias("ids"))
        # Most rows have one chunk. Rows of a term are summed by those who ask: a sum here would shuffle a row for each task and term.
        held = F.when(F.size("ids") == 1, F.array_contains("lost", F.get("ids", F.lit(0))).cast("int")).otherwise(F.size(F.array_intersect("ids", "lost"))).cast("long")
        found = rows.join(self._by_block(lost, n), ["generation", "block"]).select("term", held.alias("n")).where("n > 0")
        found.sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{self.place}/{name}/terms")
        return name, g, n, tokens

    @staticmethod
    def _by_block(lost: DataFrame, n: int) -> DataFrame:
        """``generation, block, lost``: the postings of a block are told what it has lost, so they stay where they are."""
        own = lost.groupBy("generation", "block").agg(F.collect_list("doc_id").alias("lost"))
        return F.broadcast(own) if n <= SENT_IDS else own

    def merged(self, fanout: int = FANOUT) -> Manifest:
        """Segments of a size class that has ``fanout`` of them become one; what no older segment holds is forgotten as gone."""
        old = self.manifest
        classes: dict[int, list[tuple[str, int, int, int]]] = {}
        for s in old.segments:
            classes.setdefault(int(log(max(1, s[2]), FANOUT)), []).append(s)
        full = tuple(s for own in classes.values() if len(own) >= fanout for s in own)
        if not full:
            return old
        g = old.generation + 1
        made = self._segment(self._without_gone(full, old, g), g)
        rest = tuple(s for s in old.segments if s not in full)
        new = Manifest(g, (*rest, made), self._still_gone(old, rest))
        write_manifest(self.spark, self.place, new)
        return new

    def _without_gone(self, segments: tuple[tuple[str, int, int, int], ...], m: Manifest, g: int) -> DataFrame:
        """ROWS of live chunks. Blocks stay what they are, and their bounds hold; those less than half full are dealt to new ones of their class."""
        rows, lengths = self._table("rows", segments, ROWS), self._lengths(segments)
        if m.gone:
            lost = lengths.join(self._gone(m), (F.col("doc_id") == F.col("__gone")) & (F.col("__since") > F.col("generation")), "left_semi")
            rows = rows.join(self._by_block(lost, sum(x[2] for x in m.gone)), ["generation", "block"], "left")
            for name in ("docs", "chunks"):
                left = F.filter(name, lambda x: ~F.array_contains("lost", x["doc_id"]))
                rows = rows.withColumn(name, F.when(F.col("lost").isNull(), F.col(name)).otherwise(left))
            rows = rows.withColumn("n", F.when(F.col("term").isNull(), F.size("chunks")).otherwise(F.size("docs")).cast("long")).where("n > 0")
        sizes = self._live(lengths, m).groupBy("generation", "block").agg(F.count("*").alias("n"), F.min("length").alias("least"))
        small = sizes.where(F.col("n") < BLOCK_ROWS // 2).withColumn("class", F.floor(F.log2(F.col("least") + 1) * CLASSES).cast("long"))
        # As many rows as there are classes of length: some hundreds at most.
        found = small.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()
        if not found:
            return rows
        slots = F.broadcast(self.spark.createDataFrame([(r["class"], -(-r.n // BLOCK_ROWS)) for r in found], "class long, slots long"))
        fresh = F.lit(g % 2**20 << 43) + F.shiftleft("class", 32) + F.pmod(F.xxhash64("generation", "block"), F.col("slots"))
        moved = small.join(slots, "class").select("generation", "block", fresh.alias("fresh"))
        moved = F.broadcast(moved) if sum(r.blocks for r in found) <= SENT_IDS else moved
        return rows.join(moved, ["generation", "block"], "left").withColumn("block", F.coalesce("fresh", "block"))

    def _still_gone(self, old: Manifest, rest: tuple[tuple[str, int, int, int], ...]) -> tuple[tuple[str, int, int, int], ...]:
        """Of what is gone, the ids that the segments which stay hold, as tables of their own."""
        out = []
        for name, g, *_ in old.gone:
            older = tuple(s for s in rest if s[1] < g)
            if not older:
                continue
            ids = self.spark.read.parquet(f"{self.place}/{name}/ids")
            # Not those that an earlier deletion took already.
            earlier = Manifest(old.generation, older, tuple(x for x in old.gone if x[1] < g))
            made = self._taken(self._live(self._lengths(older), earlier).join(ids.select("doc_id"), "doc_id", "left_semi"), older, g)
            if made[2]:
                out.append(made)
        return tuple(out)

    def vacuumed(self) -> list[str]:
        """Deletes tables and manifests that the latest state doesn't name; their names. For times when nobody reads an older state."""
        m = self.manifest
        named = {x[0] for x in (*m.segments, *m.gone)} | {"manifest"}
        path, files = _files(self.spark, self.place)
        old = [x.getPath() for x in files.listStatus(path) if x.getPath().getName() not in named]
        old += [x.getPath() for x in files.listStatus(_files(self.spark, f"{self.place}/manifest")[0]) if x.getPath().getName() != f"{m.generation:012d}.json"]
        for x in old:
            files.delete(x, True)
        return sorted(x.getName() for x in old)
