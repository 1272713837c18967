"""Near copies by SimHash fingerprints and by the Jaccard similarity of word shingles, the latter checked on the shingles.

Two texts are linked if their sets of five-word shingles (ASCII white space, A-Z lower-cased;
a shorter text is one shingle) have a Jaccard similarity of ``LEAST`` or more.

1. Texts of one shingle set are folded to a node, a hash of the set.
2. Candidates share one of ``BANDS`` keys, each a hash of ``ROWS`` least hashed shingles. At a similarity
   of 0.8 a pair shares none with a probability of (1 - 0.8 ** 5) ** 20 = 0.0004.
3. Of a key's nodes all are compared with one, the hub: that which has the most partners over all its keys,
   so that in a group of edited copies it is the text they come from. n nodes give n - 1 comparisons.
4. Two nodes that are not linked through their hub can be near copies only if they share shingles that the hub
   hasn't got, or if the share of the hub that each has is large enough for the other's size. The first are found by a join on
   (hub, such a shingle), for which each has only as many of its rarest as must hold a shared one; the second by a join on (hub, size).
5. Components are those of the links found.

With a ``radius``, texts are linked as well whose SimHash fingerprints (``simhash``: three-word shingles, repeats counted) differ in that many
bits at most; components are those of both kinds of links. Fingerprints alone would lose links of the first kind: at a similarity of 0.8 some 10 of
64 bits differ, for which the block index needs 11 blocks of 5 bits, so that each block value holds a thirtieth of all texts.

Defined results: texts without words are one group; rows with a null id keep their row and take part in no
link; rows that share an id and differ in text are judged each by its text; a very long text takes memory in proportion
to its shingles; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, compact, free_names, slices
from .line_dedup import maybe_in
from .simhash import components, fingerprint, near_edges

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
SHINGLES_AT_ONCE = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, each made of the hashes of its words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(own))
    out = np.full(len(own) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ own[k : len(own) - n + 1 + k]) * _BASE
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def band_keys(sets: list[np.ndarray]) -> list[np.ndarray | None]:
    """Of each set a key of each band over the least of its shingles' hashes under the band's functions; None for an empty set."""
    out: list[np.ndarray | None] = [None] * len(sets)
    held, n = [], 0
    for k, own in enumerate(sets):
        if len(own):
            held.append(k)
            n += len(own)
        if held and (n >= SHINGLES_AT_ONCE or k + 1 == len(sets)):
            for number, least in zip(held, _least([sets[i] for i in held]), strict=True):
                out[number] = np.array([xxhash.xxh3_64_intdigest(band.tobytes(), b) for b, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)
            held, n = [], 0
    return out


def _least(sets: list[np.ndarray]) -> np.ndarray:
    """Least hash of each set under each function, all sets at once; a larger one than SHINGLES_AT_ONCE goes in parts."""
    least = np.full((len(sets), BANDS * ROWS), ~np.uint64(0))
    whole = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])
    for low in range(0, len(whole), SHINGLES_AT_ONCE):
        part = whole[low : low + SHINGLES_AT_ONCE]
        first = np.searchsorted(starts, low, "right") - 1
        last = np.searchsorted(starts, low + len(part), "left")
        at = np.maximum(starts[first:last] - low, 0)
        for k in range(BANDS * ROWS):
            x = (part ^ _XOR[k]) * _TIMES[k]
            x ^= x >> np.uint64(32)
            x *= _TIMES[-1 - k]
            least[first:last, k] = np.minimum(least[first:last, k], np.minimum.reduceat(x, at))
    return least


KNOWN = "doc_id long, text_hash long, node long, size long, keys array<long>, fp long"


def _known(printed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is known of each text; its fingerprint if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch.column(1))
            sets = [shingles(t) for t in texts]
            keys = band_keys(sets)
            prints = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)) if printed else pa.nulls(len(texts), pa.int64())
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), prints]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], [f.split()[0] for f in KNOWN.split(", ")])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(t) for t in as_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "own"])


COMPARED = "node long, hub long, linked boolean, common long, size long, added array<long>"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a node is a near copy of its hub, how much they have in common, and what the hub hasn't got."""
    for batch in slices(batches):
        rows = []
        for own, other in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True):
            own, other = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
            added = np.setdiff1d(own, other, assume_unique=True)
            common = len(own) - len(added)
            rows.append((common >= LEAST * (len(other) + len(added)), common, len(own), added.view(np.int64)))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        types = (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [f.split()[0] for f in COMPARED.split(", ")])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("own").alias("other")), "hub")
    return both.select("node", "hub", "own", "other").mapInArrow(_compared, COMPARED)


def sets_of(docs: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, own``: the shingles of the nodes asked for, from one text each."""
    ids = named.join(small(nodes), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("key")).select("key")
    texts = maybe_in(docs.where("doc_id is not null"), ids, "doc_id").select("text")
    return texts.mapInArrow(_sets, "node long, own binary").join(small(nodes), "node", "left_semi").groupBy("node").agg(F.first("own").alias("own"))


def small(df: DataFrame) -> DataFrame:
    """Broadcast if one task holds it (see ``compact``): some hundred thousand narrow rows at most."""
    return F.broadcast(df) if df.rdd.getNumPartitions() == 1 else df


def stars(groups: DataFrame) -> DataFrame:
    """``node, hub`` of each group of ``groups`` (key, node)."""
    sized = groups.groupBy("key").agg(F.count("*").alias("n"))
    partners = groups.join(sized, "key").groupBy("node").agg(F.sum("n").alias("partners"))
    hubs = groups.join(partners, "node").groupBy("key").agg(F.max_by("node", F.struct("partners", "node")).alias("hub"))
    return groups.join(hubs, "key").where("node <> hub").select("node", "hub").distinct()


def alike(size: Column, other: Column) -> Column:
    """Whether sizes allow of a near copy."""
    return F.least(size, other) >= LEAST * F.greatest(size, other)


def needed(size: Column, other: Column) -> Column:
    """How many shingles near copies of these sizes have in common at least: ``LEAST / (1 + LEAST)`` of their sizes' sum."""
    return F.ceil(LEAST / (1 + LEAST) * (size + other) - 1e-6)


def pairs_within(groups: DataFrame) -> DataFrame:
    """``node, hub``: pairs of a group, whose components differ, of a node that looks for links and any other.

    At the first of their shared shingles, in the order of ``place``, both have as many more behind it as they have to share;
    a group in which one of them has fewer left isn't that of their first one, or they are no near copies.
    """
    a, b = groups.where("asks").alias("a"), groups.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") != F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    once = ~F.col("b.asks") | (F.col("a.node") < F.col("b.node"))
    besides = needed(F.col("a.size"), F.col("b.size")) - F.least("a.common", "b.common")
    enough = F.least(F.col("a.all") - F.col("a.place"), F.col("b.all") - F.col("b.place")) >= besides
    found = a.join(b, near & once & enough & alike(F.col("a.size"), F.col("b.size")))
    return found.select(F.least("a.node", "b.node").alias("node"), F.greatest("a.node", "b.node").alias("hub")).distinct()


def by_added(placed: DataFrame) -> DataFrame:
    """Groups (key, node, size, common, root, asks, all, place) of nodes that share a hub and a shingle that it hasn't got, if they may hold new links.

    What a near copy has in common with its hub can't give more of the ``needed`` shingles than itself, so that ``least`` at least have
    to be shared besides. The hub's nodes have their ``all`` shingles of this kind in one order, rarest first. If ``least`` of them are
    shared, the first shared one stands among the first ``all - least + 1`` of either node: only these are in a group.
    """
    smallest = placed.groupBy("hub").agg(F.min("size").alias("smallest"))
    least = needed(F.col("size"), F.greatest(F.col("smallest"), LEAST * F.col("size"))) - F.col("common")
    own = placed.join(smallest, "hub").withColumn("first", F.size("added") - F.greatest(least, F.lit(1)) + 1)
    spread = own.select("hub", "node", "size", "common", "root", "left", "first", F.size("added").alias("all"), F.explode("added").alias("d")).withColumn("key", F.xxhash64("hub", "d"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mine = Window.partitionBy("hub", "node")
    # What nobody shares is rarest of all.
    alone = F.col("all") - F.count("*").over(mine)
    shared = spread.join(sizes, "key").withColumn("place", alone + F.row_number().over(mine.orderBy("n", "key")) - 1)
    early = checkpointed(shared.where("place < first").select("key", "node", "size", "common", "root", F.col("left").alias("asks"), "all", "place"))
    kinds = early.groupBy("key").agg(F.max("asks").alias("any"), F.min("root").alias("low"), F.max("root").alias("high"))
    return early.join(kinds.where("any and low <> high").select("key"), "key", "left_semi")


def by_size(placed: DataFrame) -> DataFrame:
    """``node, hub``: pairs whose common parts of their hub alone may make them near copies."""
    alone = placed.where(F.col("common") >= LEAST * F.col("size")).select(F.col("hub").alias("of"), "node", "size", "common", "root", "left")
    most = F.floor((1 + 1 / LEAST) * F.col("common") - F.col("size")).cast("long")
    asking = alone.where("left").withColumn("fits", F.explode(F.sequence(F.ceil(LEAST * F.col("size")).cast("long"), F.greatest(most, F.ceil(LEAST * F.col("size")).cast("long"))))).where(F.col("fits") <= most)
    a, b = asking.alias("a"), alone.alias("b")
    fits = (F.col("a.of") == F.col("b.of")) & (F.col("a.fits") == F.col("b.size")) & (F.col("a.root") != F.col("b.root"))
    enough = F.least("a.common", "b.common") >= needed(F.col("a.size"), F.col("b.size"))
    return a.join(b, fits & enough).select(F.least("a.node", "b.node").alias("node"), F.greatest("a.node", "b.node").alias("hub")).distinct()


def links_within(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The near copies (u > v) of ``groups`` (key, node): enough links to join what the groups' pairs would join."""

    def linked(found: DataFrame) -> DataFrame:
        return found.where("linked").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"))

    star = compact(compared(stars(groups), sets))
    links = linked(star)
    roots = compact(components(links))
    own = star.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = own.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
    placed = placed.withColumn("left", F.col("root") != F.coalesce("hub_root", "hub"))
    placed = compact(placed.join(placed.where("left").select("hub").distinct(), "hub", "left_semi"))
    pairs = compact(pairs_within(compact(by_added(placed))).union(by_size(placed)).distinct())
    return links.union(linked(compact(compared(pairs, sets))))


def links_of_prints(named: DataFrame, radius: int) -> DataFrame:
    """Links (u > v) of nodes (node, fp) that join what have fingerprints within the radius; a node of several texts may have several."""
    own = compact(named.select("node", "fp").distinct())
    reps = own.groupBy("fp").agg(F.min("node").alias("least"))
    same = own.join(reps, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return same.union(near_edges(reps.withColumnRenamed("least", "node"), radius))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """For each row ``doc_id``, ``text_hash``, ``node`` (the hash of its shingles), ``component_id`` (the smallest id of its
    group) and ``stays``: whether it is the row of its group with the smallest (doc_id, text_hash)."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    known = checkpointed(picked.mapInArrow(_known(radius is not None), KNOWN))
    named = known.where("doc_id is not null")
    spread = named.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    groups = compact(spread.join(shared, "key"))
    nodes = compact(groups.select("node").distinct())
    sets = compact(sets_of(picked, named, nodes), 1 << 16)
    links = links_within(groups, sets)
    if radius is not None:
        links = links.union(links_of_prints(named, radius))
    roots = compact(components(links))

    rooted = known.join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A row without others in its group is its first one.
    first = rooted.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n"))
    first = compact(first.where("n > 1").select("root", "first"))
    stays = F.col("doc_id").isNull() | F.col("first").isNull() | (F.struct("doc_id", "text_hash") == F.col("first"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id")).alias("component_id")
    return rooted.join(small(first), "root", "left").select("doc_id", "text_hash", "node", component, stays.alias("stays"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay; of rows of equal id and text one."""
    found = checkpointed(near_copies(docs, id_col, text_col, radius))
    own_id, own_hash = free_names(docs, "id", "text_hash")
    gone = found.where(~F.col("stays")).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    gone = small(compact(gone))
    key, text_hash = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))
    kept = docs.join(gone, (key == F.col(own_id)) & (text_hash == F.col(own_hash)), "left_anti")
    repeated = found.where("stays and doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    if repeated.isEmpty():
        return kept
    same = (key == F.col(own_id)) & (text_hash == F.col(own_hash))
    once = kept.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, same, "left_anti").unionAll(once)
