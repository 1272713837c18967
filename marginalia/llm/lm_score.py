"""Language-model scoring: word counts, and logistic context mixing over bytes.

Base score. Words (ASCII white space, lower-cased A-Z) and one end per text are counted over
all training documents, exactly.

Model. The text's words, joined by single spaces and ended by a line feed, are predicted bit
by bit. Each of the last 1 to 4 bytes is a context; a predictor of each order holds, by its context's key
and the bits of the current byte so far, how often a zero and a one came next. Their log odds are
combined by weights that are chosen (gated) by the bit's place and by the longest context known and how
often it was seen, and the result is refined by an adaptive table of what such predictions came to.

Nothing of this has a fixed size: what is counted is a table of byte sequences (a context of four bytes and
the byte that follows) and words, which grows with the training text.

1. Where a task reads its rows it counts distinct words and byte sequences of a window of rows; the
   counts are summed over all tasks by a shuffle on the word or sequence.
2. Sequences are dealt by the three bytes before the last, so that all that orders 3 and 4 need of a context
   lies together; orders 1 and 2 have 2 ** 24 sequences at most and are broadcast.
3. Online learning: the training documents are dealt by a hash of their content to slices, an eighth, an eighth, a
   quarter and a half of them. Each slice but the first is predicted by the counts of those before it and the
   weights so far; then the weights move along its error (a Newton step for each gate), the table is
   refined, and its counts are added. A slice is one pass over the sequences, not over the texts, and its sums
   don't depend on how rows are dealt to tasks: the result is the same on any cluster.
4. Each sequence's probability is computed once, from the counts of all slices.
5. Documents are dealt to buckets by a hash; a bucket asks once for each of its distinct words and sequences,
   and the answers come back to it by joins. No vocabulary is held as a whole.

Scoring leaves the model as it is, so a score depends on the text and the training documents alone.

Learned from: documents for which crc32(id as text) mod 5 is not 1.

Defined results: null counts as the empty text, which has one token, the end; a null id
counts as a training document; repeated rows count and are scored each; a very long text is counted and scored in
pieces, with the bytes before a cut as context; without training documents all counts are 0 and the model gives each
bit a half; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_group, fold_of, shared_folder

ORDERS = (1, 2, 3, 4)
LONGEST = max(ORDERS)
#: Orders up to this one are broadcast: 256 ** 3 sequences at most.
BROADCAST_ORDER = 2
#: Of eight parts of the training documents, the slice of each.
SLICE_OF = (0, 1, 2, 2, 3, 3, 3, 3)
SLICES = 4
HELD_OUT = 7
MANY = 8
GATES = 1 + 2 * len(ORDERS)
STEPS = 33
REACH = 12.0
RIDGE = 2.0
PRIOR = 20
PIECE = 2 << 20
WINDOW = 12 << 20
CHUNK = 1 << 16
BUCKET_BYTES = 12 << 20
MOST_TASKS = 10_000
LEAST_BUCKETS = 8
PAD = b"\n" * LONGEST
ROWS = 100_000
COUNTS = [f"n{k}" for k in range(SLICES)]


def tokens_of(text: bytes) -> list[bytes]:
    """The words and the end (the empty word)."""
    return [*text.lower().split(), b""]


def token_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 and 31 bits of each word's hash; sequences have -1 in the place of the latter."""
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(digest[:, 0]), (digest[:, 1] & 0x7FFFFFFF).astype(np.int32)


# ---- byte sequences ----


def grams(texts: list[bytes]) -> np.ndarray:
    """For each byte of the texts, in order: the LONGEST bytes before it and itself in one number."""
    data = np.frombuffer(PAD + PAD.join(texts), np.uint8)
    n = len(data) - LONGEST
    key = np.zeros(n, np.uint64)
    for k in range(LONGEST + 1):
        key <<= np.uint64(8)
        key |= data[k : n + k]
    size = np.array([len(t) for t in texts])
    own = np.repeat(np.tile([True, False], len(size)), np.column_stack([size, np.full(len(size), LONGEST)]).ravel())[:n]
    return key[own]


def pieces(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Collects texts to pieces of about PIECE bytes; a longer text is cut, with its last bytes as lead.

    Gives the numbers of the texts, their bytes, and the length of each lead.
    """
    ids, held, leads, n = [], [], [], 0
    for number, text in texts:
        for low in range(0, len(text), PIECE):
            lead = min(low, LONGEST)
            ids.append(number)
            held.append(text[low - lead : low + PIECE])
            leads.append(lead)
            n += len(held[-1])
            if n >= PIECE or len(ids) > 60_000:
                yield ids, held, leads
                ids, held, leads, n = [], [], [], 0
    if ids:
        yield ids, held, leads


def owned_grams(held: list[bytes], leads: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of a piece without those of leads, and for each the place of its text in the piece."""
    key = grams(held)
    size = np.array([len(t) for t in held])
    owner = np.repeat(np.arange(len(held), dtype=np.uint16), size)
    if any(leads):
        place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
        inside = place >= np.array(leads)[owner]
        key, owner = key[inside], owner[inside]
    return key, owner


def runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands there (or the sum of its counts)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.r_[first, len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def model_text(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def class_of(text: bytes, held_out: bool) -> int:
    """Slice of a document by a hash of its content."""
    return HELD_OUT if held_out else SLICE_OF[xxhash.xxh3_64_intdigest(text, 9) & 7]


# ---- the model: features of sequences, weights, refined probabilities ----


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Order:
    """Zeros and ones of one order along the bits of each sequence asked for.

    ``keys`` are the order's distinct sequences (context and byte, sorted), ``counts`` how often each was seen.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, back: np.ndarray):
        self.keys, self.asked, self.back = keys, asked, back
        self.sums = np.r_[0, np.cumsum(counts)]
        context = asked & ~np.uint64(255)
        self.low, self.high = np.searchsorted(keys, context), np.searchsorted(keys, context + np.uint64(255), "right")

    def step(self, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """For the bits in turn: how often a zero and a one came at this place."""
        shift = np.uint64(7 - bit)
        middle = np.searchsorted(self.keys, ((self.asked >> (shift + np.uint64(1))) << np.uint64(1) | np.uint64(1)) << shift)
        zeros, ones = self.sums[middle] - self.sums[self.low], self.sums[self.high] - self.sums[middle]
        one = (self.asked >> shift & np.uint64(1)).astype(bool)
        self.low, self.high = np.where(one, middle, self.low), np.where(one, self.high, middle)
        return zeros[self.back], ones[self.back]


class Sequences:
    """Sequences of whole contexts of ``BROADCAST_ORDER + 1`` bytes, with what is known of shorter ones."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray]):
        self.keys = keys
        self.orders = []
        for o in ORDERS:
            asked, back = np.unique(keys & np.uint64((1 << 8 * (o + 1)) - 1), return_inverse=True)
            if o > BROADCAST_ORDER:
                known = asked, np.bincount(back, counts, len(asked)).astype(np.int64)
            else:
                known = runs(short[0] & np.uint64((1 << 8 * (o + 1)) - 1), short[1])
            self.orders.append(Order(*known, asked, back))

    def bits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit: whether it is one, the log odds of all orders, and the gate."""
        for bit in range(8):
            one = (self.keys >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
            x, gate = np.empty((len(ORDERS), len(self.keys))), np.zeros(len(self.keys), np.int64)
            for k, order in enumerate(self.orders):
                zeros, ones = order.step(bit)
                x[k] = np.log((ones + 0.4) / (zeros + 0.4))
                seen = zeros + ones
                gate = np.where(seen > 0, 1 + 2 * k + (seen >= MANY), gate)
            yield one, x, gate


class Model:
    """Weights by bit, gate and order, and what refined predictions came to: how often, and how often a one."""

    def __init__(self) -> None:
        self.weights = np.full((8, GATES, len(ORDERS)), 0.3)
        self.refined = np.zeros((2, 8, GATES, STEPS))

    def _combined(self, bit: int, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        own = self.weights[bit]
        z = own[gate, 0] * x[0]
        for k in range(1, len(ORDERS)):
            z += own[gate, k] * x[k]
        return np.clip(z, -REACH, REACH, out=z)

    @staticmethod
    def _step_of(z: np.ndarray) -> np.ndarray:
        return np.rint((z + REACH) * ((STEPS - 1) / (2 * REACH))).astype(np.int64)

    def errors(self, sequences: Sequences, often: np.ndarray) -> np.ndarray:
        """Sums over a slice's bits: gradients, second derivatives and what predictions came to. ``often``: of each sequence, in the slice."""
        n = len(ORDERS)
        gradient, second, refined = np.zeros((8, GATES, n)), np.zeros((8, GATES, n, n)), np.zeros_like(self.refined)
        for bit, (one, x, gate) in enumerate(sequences.bits()):
            z = self._combined(bit, x, gate)
            p = sigmoid(z)
            error, spread = often * (one - p), often * p * (1 - p)
            for i in range(n):
                gradient[bit, :, i] = np.bincount(gate, error * x[i], GATES)
                for j in range(i + 1):
                    second[bit, :, i, j] = second[bit, :, j, i] = np.bincount(gate, spread * x[i] * x[j], GATES)
            cell = gate * STEPS + self._step_of(z)
            refined[0, bit] = np.bincount(cell, often, GATES * STEPS).reshape(GATES, STEPS)
            refined[1, bit] = np.bincount(cell, often * one, GATES * STEPS).reshape(GATES, STEPS)
        return np.concatenate([gradient.ravel(), second.ravel(), refined.ravel()])

    def moved(self, sums: np.ndarray) -> None:
        """Learns from the sums of ``errors`` over a slice."""
        n = len(ORDERS)
        gradient, second, refined = np.split(sums, np.cumsum([8 * GATES * n, 8 * GATES * n * n]))
        step = np.linalg.solve(second.reshape(8, GATES, n, n) + RIDGE * np.eye(n), gradient.reshape(8, GATES, n, 1))[..., 0]
        self.weights += np.clip(step, -0.5, 0.5)
        self.refined += refined.reshape(self.refined.shape)

    def log10(self, sequences: Sequences) -> np.ndarray:
        """Of each sequence: log10 of the probability of its last byte after the others."""
        centre = sigmoid(np.linspace(-REACH, REACH, STEPS))
        refined = (self.refined[1] + PRIOR * centre) / (self.refined[0] + PRIOR)
        out = np.zeros(len(sequences.keys))
        for bit, (one, x, gate) in enumerate(sequences.bits()):
            z = self._combined(bit, x, gate)
            p = (sigmoid(z) + refined[bit, gate, self._step_of(z)]) / 2
            out += np.log10(np.where(one, p, 1 - p))
        # Single precision is plenty for one byte, and takes half the room in shuffles.
        return out.astype(np.float32).astype(np.float64)


# ---- counting ----


def _batch(h1: np.ndarray, h2: np.ndarray, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, *columns)], ["h1", "h2", *names])
    for low in range(0, whole.num_rows, ROWS):
        yield whole.slice(low, ROWS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training documents, and byte sequences of all, of a window of rows, with their counts by slice."""

    def flush(texts: list[bytes], held_out: list[bool]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        for text, out in zip(texts, held_out, strict=True):
            if not out:
                words.update(tokens_of(text))
        if words:
            counts = np.fromiter(words.values(), np.int64, len(words))
            yield from _batch(*token_keys(list(words)), [counts, *[np.zeros(len(words), np.int64)] * (SLICES - 1)], COUNTS)
        del words
        made = [model_text(t) for t in texts]
        classes = np.array([class_of(t, out) for t, out in zip(made, held_out, strict=True)], np.uint64)
        found = []
        for ids, held, leads in pieces(enumerate(made)):
            key, owner = owned_grams(held, leads)
            key <<= np.uint64(3)
            key |= classes[ids][owner]
            found.append(runs(key))
        key, n = runs(*(np.concatenate(x) for x in zip(*found, strict=True)))
        first = np.flatnonzero(np.r_[True, key[1:] >> np.uint64(3) != key[:-1] >> np.uint64(3)])
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        own = (key & np.uint64(7)).astype(np.int64)
        columns = [np.bincount(of[own == k], n[own == k], len(first)).astype(np.int64) for k in range(SLICES)]
        yield from _batch((key[first] >> np.uint64(3)).astype(np.int64), np.full(len(first), -1, np.int32), columns, COUNTS)

    texts, held_out, n = [], [], 0
    for batch in batches:
        for text, out in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            texts.append(text)
            held_out.append(out)
            n += len(text) + 64
            if n >= WINDOW:
                yield from flush(texts, held_out)
                texts, held_out, n = [], [], 0
    if texts:
        yield from flush(texts, held_out)


KEY = "h1 long, h2 int"


def counted(picked: DataFrame) -> DataFrame:
    """``h1, h2, n0 .. n3`` of each word (counts in n0) and sequence (h2 = -1) of ``picked`` (text, held_out), as a written table."""
    spark = picked.sparkSession
    rows = picked.select("text", "held_out").mapInArrow(_counted, f"{KEY}, " + ", ".join(f"{c} long" for c in COUNTS))
    place = f"{shared_folder(spark)}/counts"
    rows.groupBy("h1", "h2").agg(*[F.sum(c).alias(c) for c in COUNTS]).write.parquet(place)
    return spark.read.parquet(place)


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("h1").to_numpy().astype(np.uint64), np.array([table.column(c).to_numpy() for c in COUNTS])


class Learning:
    """Passes over the table of sequences; what comes to the driver has a fixed size but for the short sequences (2 ** 24 at most)."""

    def __init__(self, sequences: DataFrame):
        self.context = sequences.sparkSession.sparkContext
        width = 8 * (BROADCAST_ORDER + 1)
        short = sequences.groupBy(F.col("h1").bitwiseAND((1 << width) - 1).alias("h1")).agg(*[F.sum(c).alias(c) for c in COUNTS])
        keys, counts = _columns(short.where(" + ".join(COUNTS) + " > 0").toArrow())
        order = np.argsort(keys)
        self.short = self.context.broadcast((keys[order], counts[:, order]))
        group = F.shiftright("h1", 8).bitwiseAND((1 << width) - 1).alias("context")
        self.rows = sequences.select(group, "h1", *COUNTS).repartition("context").sortWithinPartitions("context")

    def parts(self, known: int):
        """Reads a task's sequences context by context, with the counts of the first ``known`` slices."""
        short = self.short

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Sequences, np.ndarray]]:
            below = short.value[0], short.value[1][:known].sum(axis=0)
            seen = below[1] > 0
            below = below[0][seen], below[1][seen]
            for table in by_group(batches, "context", CHUNK):
                keys, counts = _columns(table)
                yield Sequences(keys, counts[:known].sum(axis=0), below), counts

        return read

    def model(self) -> Model:
        model = Model()
        for k in range(1, SLICES):
            read, known = self.parts(k), self.context.broadcast(model)

            def errors(batches: Iterator[pa.RecordBatch], k=k, read=read, known=known) -> Iterator[pa.RecordBatch]:
                total = sum((known.value.errors(own, counts[k].astype(float)) for own, counts in read(batches)), np.zeros(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "part"])

            sums = self.rows.mapInArrow(errors, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).toArrow()
            total = np.zeros(8 * GATES * len(ORDERS) * (1 + len(ORDERS)) + model.refined.size)
            total[sums.column("place").to_numpy()] = sums.column("part").to_numpy()
            model.moved(total)
        return model

    def probabilities(self, model: Model) -> DataFrame:
        """``h1, h2, value``: log10 of the probability of each sequence's last byte."""
        read, known = self.parts(SLICES), self.context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own, _ in read(batches):
                yield from _batch(own.keys.astype(np.int64), np.full(len(own.keys), -1, np.int32), [known.value.log10(own)], ["value"])

        return self.rows.mapInArrow(run, f"{KEY}, value double")


# ---- buckets ask, answers come back ----


def _asked(table: pa.Table) -> pa.Table:
    """The distinct words and sequences of a bucket."""
    words: set[bytes] = set()
    texts = as_bytes(table.column("text"))
    for text in texts:
        words.update(tokens_of(text))
    h1, h2 = token_keys(list(words))
    found = [runs(owned_grams(held, leads)[0])[0] for _, held, leads in pieces((k, model_text(t)) for k, t in enumerate(texts))]
    own = np.unique(np.concatenate(found)).astype(np.int64)
    h1, h2 = np.r_[h1, own], np.r_[h2, np.full(len(own), -1, np.int32)]
    return pa.Table.from_arrays([pa.array(np.full(len(h1), table.column("bucket")[0].as_py(), np.int64)), pa.array(h1), pa.array(h2)], ["bucket", "h1", "h2"])


def piecewise(texts: Iterator[tuple[int, bytes]], n: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's sequences; ``keys`` is sorted and has them all."""
    out = np.zeros(n)
    for ids, held, leads in pieces(texts):
        key, owner = owned_grams(held, leads)
        # One array is sorted, with the text's place in its last bits; sums go by parts.
        key <<= np.uint64(16)
        key |= owner
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] >> np.uint64(16) != key[:-1] >> np.uint64(16)])
        each = np.repeat(values[np.searchsorted(keys, key[first] >> np.uint64(16))], np.diff(np.r_[first, len(key)]))
        sums = np.bincount((key & np.uint64(0xFFFF)).astype(np.int64), each, len(held))
        np.add.at(out, ids, sums)
    return out


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    own = as_bytes(docs.column("text"))
    is_word = answers.column("word").to_numpy(zero_copy_only=False)
    h1, value = answers.column("h1").to_numpy(), answers.column("value").to_numpy()
    known, count = h1[is_word], value[is_word]
    order = np.argsort(known)
    known, count = known[order], count[order]
    number: dict[bytes, int] = {}
    for text in own:
        for w in tokens_of(text):
            number.setdefault(w, len(number))
    asked = token_keys(list(number))[0]
    at = np.searchsorted(known, asked)
    at[at == len(known)] = 0
    c = np.where(known[at] == asked, count[at], 0) if len(known) else np.zeros(len(asked))
    logs = np.log10(c + 0.5)
    rows = []
    for text in own:
        tokens = tokens_of(text)
        at = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        rows.append((len(tokens), int((c[at] > 0).sum()), float(logs[at].sum())))
    n_tokens, n_known, sums = zip(*rows, strict=True) if rows else ([], [], [])
    del number
    keys, value = h1[~is_word].astype(np.uint64), value[~is_word]
    order = np.argsort(keys)
    sizes: list[int] = []

    def texts() -> Iterator[tuple[int, bytes]]:
        for k, t in enumerate(own):
            made = model_text(t)
            sizes.append(len(made))
            yield k, made

    scores = piecewise(texts(), len(own), keys[order], value[order])
    columns = [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), *[pa.array(x, pa.int64()) for x in (n_tokens, n_known, sizes)], pa.array(sums, pa.float64()), pa.array(scores, pa.float64())]
    return pa.Table.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, logs double, score double"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for each row."""
    held_out = F.coalesce(fold_of(F.col(id_col).cast("long"), 5) == 1, F.lit(False))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    total = picked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0

    counts = counted(picked)
    words, sequences = counts.where("h2 >= 0"), counts.where("h2 = -1")
    whole = words.agg(F.sum("n0").alias("n"), F.count("*").alias("v")).first()
    n, v = whole.n or 0, whole.v
    learning = Learning(sequences)
    table = words.select("h1", "h2", F.col("n0").cast("double").alias("value")).unionAll(learning.probabilities(learning.model()))

    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    # Beyond a bound of tasks, each holds more buckets and works on one after the other.
    dealt = picked.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("long")).repartition(min(buckets, most_tasks), "bucket")
    asked = dealt.groupBy("bucket").applyInArrow(_asked, "bucket long, h1 long, h2 int")
    answers = asked.join(table, ["h1", "h2"]).select("bucket", "h1", (F.col("h2") >= 0).alias("word"), "value")
    met = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_scored, RESULT)

    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")
    return met.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
