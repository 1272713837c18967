"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

1. Words (ASCII white space, lower-cased A-Z) are hashed to ``SLOTS`` slots. Each slot has a sparse
   ternary index vector from a fixed seed. A slot's vector is the sum of the index
   vectors of the neighbours, within two words, of all its occurrences in the whole
   corpus. Sums are whole numbers, so the order in which tasks are added changes nothing. A
   task adds up its own table; the tables (``SLOTS`` x ``DIM``, 4 MB) are summed by blocks of slots.
2. A document's features pool its words' centred unit vectors: their mean, their
   spread and the products of neighbours, from the text alone.
3. Two layers in numpy are fitted on labelled rows of ``docs``, ``TRAIN_ROWS`` at most (a documented bound:
   rows with the smallest hashes of their ids), a fifth of which is set aside to fit
   the temperature that divides the logits.

Labels are learned only from rows for which crc32(id as text) mod 3 is not 1.

Defined results: null and empty texts are scored like any other text (all features zero); a very long text
is pooled part by part, so that its memory is bounded by its words;
without labelled rows of both kinds every score is the smoothed share of label 1; a null id counts as not held out;
repeated rows repeat their result; an empty table gives an empty result; columns besides
id and text are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fold_of, slices

SLOTS = 1 << 14
DIM = 64
NONZERO = 4
#: Features: mean, spread and neighbours' product of each dimension, and the sum of the products.
WIDTH = 3 * DIM + 1
WINDOW = 2
BLOCK = 256
TRAIN_ROWS = 12_000
HIDDEN = 32
SEED = 20240607


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each slot's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (SLOTS, NONZERO)), rng.choice([-1, 1], (SLOTS, NONZERO))


def slots_of(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (SLOTS - 1)


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sums of neighbours' index vectors, as blocks of slots."""
    place, sign = index_vectors()
    table = np.zeros(SLOTS * DIM)
    for batch in batches:
        held, n = [], 0
        texts = as_bytes(batch.column(0))
        for k, text in enumerate(texts):
            held += [slots_of(text), np.full(WINDOW, -1)]
            n += len(held[-2])
            if n < 500_000 and k + 1 < len(texts):
                continue
            slots = np.concatenate(held)
            held, n = [], 0
            for far in range(1, WINDOW + 1):
                a, b = slots[:-far], slots[far:]
                own = (a >= 0) & (b >= 0)
                a, b = a[own], b[own]
                for low in range(0, len(a), 1_000_000):
                    part = slice(low, low + 1_000_000)
                    for x, y in ((a[part], b[part]), (b[part], a[part])):
                        for z in range(NONZERO):
                            table += np.bincount(x * DIM + place[y, z], sign[y, z], SLOTS * DIM)
    whole = table.astype(np.int64).reshape(-1, BLOCK * DIM)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole))), pa.array([x.tobytes() for x in whole], pa.binary())], ["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sums of a block; one block is held at a time."""
    block, total = None, None
    out = ["block", "sums"]
    for batch in batches:
        for b, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            if b != block:
                if block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total.tobytes()], pa.binary())], out)
                block, total = b, np.zeros(BLOCK * DIM, np.int64)
            total += np.frombuffer(sums, np.int64)
    if block is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total.tobytes()], pa.binary())], out)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Centred unit vectors of all slots (float32). The table has a fixed size, so it may come to the driver."""
    parts = texts.mapInArrow(_table, "block long, sums binary").repartition("block").sortWithinPartitions("block")
    table = np.zeros((SLOTS // BLOCK, BLOCK * DIM))
    for row in parts.mapInArrow(_added, "block long, sums binary").collect():
        table[row.block] = np.frombuffer(row.sums, np.int64)
    table = table.reshape(SLOTS, DIM)
    return unit(unit(table) - unit(table.sum(axis=0)[None, :])).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x, float), where=norm > 0)


def features(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Of a text's word vectors: the mean, the spread, and the mean product of neighbours, which tells repetition from prose."""
    slots = slots_of(text)
    n = len(slots)
    if not n:
        return np.zeros(WIDTH, np.float32)
    # Summed part by part, so that the memory of a very long text is bounded by its words.
    mean, square, beside = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    for low in range(0, n, SLOTS):
        own = vectors[slots[low : low + SLOTS + 1]]
        mean += own[:SLOTS].sum(axis=0)
        square += np.einsum("ij,ij->j", own[:SLOTS], own[:SLOTS])
        beside += np.einsum("ij,ij->j", own[1:], own[:-1])
    mean, square, beside = mean / n, square / n, beside / max(1, n - 1)
    return np.r_[mean, np.sqrt(np.maximum(square - mean * mean, 0)), beside, beside.sum()]


class Network:
    """Two layers and a temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature: float):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> Network:
    """Adam on the log loss; the last fifth of the rows sets the temperature."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    width = WIDTH
    if not 0 < y.sum() < len(y):
        return Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(prior / (1 - prior)), 1.0)
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    cut = max(1, len(y) * 4 // 5)
    z, t = ((x - mean) / scale)[:cut], y[:cut]
    p = [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, HIDDEN), np.array(np.log(prior / (1 - prior)))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(cut), max(1, cut // 64)):
            a, b = z[rows], t[rows]
            h = np.maximum(a @ p[0] + p[1], 0)
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - b) / len(rows)
            back = np.outer(error, p[2]) * (h > 0)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], error.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, scale, *p, 1.0)
    aside = slice(cut, None) if cut < len(y) else slice(None)
    logits, t = network.logits(x[aside]), y[aside]
    grid = np.geomspace(0.5, 8, 41)
    loss = [np.logaddexp(0, np.where(t > 0, -1, 1) * logits / g).mean() for g in grid]
    network.temperature = float(grid[int(np.argmin(loss))])
    return network


class Classifier:
    """Word vectors and the network, as sent to the executors."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS):
        context = docs.sparkSession.sparkContext
        picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.vectors = vectors = context.broadcast(word_vectors(picked.select("text")))

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = [features(t, vectors.value).astype(np.float32).tobytes() for t in as_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], ["doc_id", "quality", "features"])

        # Ids that have a document, then rows: where ids repeat, the bound holds for rows.
        place = [F.xxhash64("doc_id"), F.col("doc_id")]
        marked = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
        marked = marked.where(~held_out_column("doc_id")).join(picked.select("doc_id"), "doc_id", "left_semi").orderBy(*place).limit(train_rows)
        rows = picked.join(F.broadcast(marked), "doc_id").mapInArrow(featured, "doc_id long, quality int, features binary")
        rows = rows.orderBy(*place, "features").limit(train_rows).collect()
        rows.sort(key=lambda r: (zlib.crc32(f"order {r.doc_id}".encode()), r.doc_id, r.features))
        self.fitted_rows = len(rows)
        x = np.frombuffer(b"".join(r.features for r in rows), np.float32).reshape(-1, WIDTH)
        self.network = context.broadcast(fitted(x, np.array([r.quality for r in rows])))

def scores_of(texts: list[bytes], vectors: np.ndarray, network: Network) -> np.ndarray:
    return network.scores(np.array([features(t, vectors) for t in texts]).reshape(-1, WIDTH))


def held_out_column(name: str) -> Column:
    return F.coalesce(fold_of(F.col(name), 3) == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    classifier = Classifier(docs, labels, id_col, text_col, train_rows)
    vectors, network = classifier.vectors, classifier.network

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_of(as_bytes(batch.column(1)), vectors.value, network.value), pa.float64())], ["doc_id", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scores = picked.mapInArrow(scored, "doc_id long, score double")
    return scores.select("doc_id", held_out_column("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose own text scores 0.5 or more."""
    classifier = Classifier(docs, labels, id_col, text_col, train_rows)
    vectors, network, place = classifier.vectors, classifier.network, docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scores_of(as_bytes(batch.column(place)), vectors.value, network.value) >= 0.5))

    return docs.mapInArrow(kept, docs.schema)
