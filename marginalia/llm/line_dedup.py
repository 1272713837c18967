"""Line dedup by a deletion-neighbourhood join.

A line is a duplicate if an earlier one, by (doc_id, number in the document), is equal
or within the edit bound: one edit (a character inserted, deleted or replaced) where both lines have
``EDIT_CHARS`` characters or more, none where one is shorter, as an edit makes another word of so few
characters. Empty lines part paragraphs and are left alone.

1. Equal lines are folded first, by partial aggregation over a 128-bit hash, to the
   place at which they first stand. A line that a third of all documents share costs a row
   a task.
2. Of two lines within one edit one half is untouched, seen from one end or the
   other. Distinct lines that share no such half with another have no partner and drop out.
3. The others emit their deletion neighbourhood: the whole line (place -1) and the line
   without its i-th character (place i), each as a hashed key. Lines that share (key, i) differ
   by a replacement there at most; a whole line that meets a deleted one differs by that
   character. So of each key only the earliest line, of each (key, i) and of the whole
   ones, can matter, and no pairs are spread. A key gathers distinct lines that differ in one place:
   an alphabet for each place at most.
4. What remains is verified by edit distance on the texts.

Rows are known by their id and a hash of their text, so those without an id, or of one id, are
documents of their own unless their texts are equal.

Defined results: a null text stays null (0 lines); rows of one id come in the order of their texts' hashes;
a null id comes before all others; a line keeps its earliest place only, also
within its document; a document may end up empty, with an empty text; rows of equal id and text repeat their result; a very
long line is a line like any other, its variants are made in parts;
an empty table gives an empty result; other columns are kept by ``deduplicated`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_group, checkpointed, free_names, slices

EDIT_CHARS = 20
#: Characters of lines, and variants, that are made at once.
PART_CHARS = 1 << 20
#: Bits of the filters ahead of joins: 8 MB, whatever the input.
BITMAP = 1 << 26
BASE = 0xD1342543DE82EF95
LENGTH = 0xA24BAED4963EE407
INVERSE = pow(BASE, -1, 1 << 64)
NO_ID = -(1 << 63)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_hash(line: bytes) -> int:
    return signed(xxhash.xxh3_64_intdigest(line, 1))


def half_keys(line: str) -> list[int]:
    """Hashes of the halves of which two lines within one edit share one, at the same place of the list.

    If the longer of the two has m characters, the first or the last (m - 1) // 2
    are common; m is the length of this line or one more.
    """
    n = len(line)
    return [signed(xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), 2 * q + side)) for q in ((n - 1) // 2, n // 2) for side, part in enumerate((line[:q], line[n - q :]))]


def _lines(edit_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                seen = set()
                for number, raw in enumerate(text.split(b"\n")):
                    if not raw or raw in seen:
                        continue
                    seen.add(raw)
                    line = raw.decode("utf-8", "replace")
                    rows.append((doc, text_hash, number, line_hash(raw), signed(xxhash.xxh64_intdigest(raw, 3)), *(half_keys(line) if len(line) >= edit_chars else [None] * 4)))
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "text_hash", "number", "h1", "h2", "k0", "k1", "k2", "k3"])

    return run


def deletion_keys(line: str) -> np.ndarray:
    """Hash of the line, then of the line without its i-th character for each i."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    n = len(x)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), BASE, np.uint64)])[:n]
    sums = np.r_[np.uint64(0), np.cumsum(x * powers)]
    without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(INVERSE)
    out = np.r_[sums[-1], without]
    out[:1] += np.uint64(n * LENGTH % (1 << 64))
    out[1:] += np.uint64((n - 1) * LENGTH % (1 << 64))
    out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _parts(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Cuts lines to parts of about PART_CHARS characters."""
    low = n = 0
    for k, line in enumerate(lines):
        n += len(line) + 1
        if n >= PART_CHARS or k + 1 == len(lines):
            yield low, k + 1
            low, n = k + 1, 0


PLACE = ["doc", "text_hash", "number"]


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "place", *PLACE]
    for batch in batches:
        lines = batch.column("line").to_pylist()
        for low, high in _parts(lines):
            keys = [deletion_keys(t) for t in lines[low:high]]
            size = np.array([len(k) for k in keys])
            place = np.concatenate([np.arange(-1, n - 1) for n in size])
            own = (np.repeat(batch.column(c).to_numpy()[low:high], size) for c in PLACE)
            whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys), place, *own)], names)
            for at in range(0, whole.num_rows, 100_000):
                yield whole.slice(at, 100_000)


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (place of a line) <- (place of an earlier one): for each row the earliest that shares (key, place),
    the whole line of the key, and for a whole line the earliest that has the key with a character less."""
    names = [*PLACE, *(f"of_{c}" for c in PLACE)]
    for table in by_group(batches, "key", 500_000):
        key, place, *age = (table.column(c).to_numpy() for c in ("key", "place", *PLACE))
        order = np.lexsort((*age[::-1], place, key))
        key, place, age = key[order], place[order], [x[order] for x in age]
        at = np.arange(len(key))
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_place = new_key | np.r_[True, place[1:] != place[:-1]]
        same_place = np.maximum.accumulate(np.where(new_place, at, 0))
        first = np.maximum.accumulate(np.where(new_key, at, 0))
        # Of one key the order by age alone gives the earliest with a deletion.
        cut = np.flatnonzero(place >= 0)
        by_age = cut[np.lexsort((*(x[cut] for x in age[::-1]), key[cut]))]
        lead = by_age[np.r_[True, key[by_age][1:] != key[by_age][:-1]]] if len(by_age) else by_age
        whole = np.flatnonzero(place == -1)
        found = np.searchsorted(key[lead], key[whole])
        hit = (found < len(lead)) & (key[lead][np.minimum(found, len(lead) - 1)] == key[whole]) if len(lead) else np.zeros(len(whole), bool)
        own = np.concatenate([at, at, whole[hit]])
        of = np.concatenate([same_place, np.where(place[first] == -1, first, at), lead[found[hit]] if len(lead) else whole[hit]])
        (d, t, n), (of_d, of_t, of_n) = ([x[k] for x in age] for k in (own, of))
        earlier = (of_d < d) | ((of_d == d) & ((of_t < t) | ((of_t == t) & (of_n < n))))
        pairs = np.unique(np.column_stack([x[earlier] for x in (d, t, n, of_d, of_t, of_n)]), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(6)], names)


def known_rows(docs: DataFrame) -> DataFrame:
    """``doc, text_hash, text`` of ``docs`` (doc_id, text)."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")


def first_lines(rows: DataFrame, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """Each distinct line of ``rows`` (see ``known_rows``) with its earliest place, hashes and half keys (null for a short line)."""
    lines = rows.mapInArrow(_lines(edit_chars), "doc long, text_hash long, number long, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long")
    content = ["h1", "h2", "k0", "k1", "k2", "k3"]
    return lines.groupBy(*content).agg(F.min(F.struct(*PLACE)).alias("place")).select(*content, "place.*")


def _bitmap(keys: DataFrame):
    """Broadcasts a bitmap of fixed size over the hashes of ``keys`` (key long): what isn't in it isn't among the keys.

    It spares shuffles of rows that a join would drop; what it lets through wrongly, the join drops.
    """
    part, bit = (F.shiftrightunsigned(_spot(F.col("key")), 15), _spot(F.col("key")).bitwiseAND(32767))
    rows = keys.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect()
    bits = np.zeros((BITMAP >> 15, 4096), np.uint8)
    for row in rows:
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _spot(key):
    return F.xxhash64(key).bitwiseAND(BITMAP - 1)


def maybe_in(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``df`` of which one of the columns may be among ``keys``."""
    bitmap = _bitmap(keys)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hit = np.zeros(batch.num_rows, bool)
            for k in range(len(columns)):
                spot = batch.column(len(names) + k).to_numpy()
                hit |= (bitmap.value[spot >> 15, (spot & 32767) >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
            yield batch.filter(pa.array(hit)).select(names)

    return df.select("*", *[_spot(F.col(c)).alias(f"spot{k}") for k, c in enumerate(columns)]).mapInArrow(run, df.schema)


def near_lines(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Places of distinct lines that have an earlier one within one edit."""
    halves = F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("key")
    shared = checkpointed(first.select(halves).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    likely = maybe_in(first.select(*PLACE, "h1", "k0", "k1", "k2", "k3"), shared, "k0", "k1", "k2", "k3")
    partnered = checkpointed(likely.select(*PLACE, "h1", halves).join(shared, "key", "left_semi").select(*PLACE, "h1").distinct())
    wanted = partnered.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("number", "h1")).alias("wanted"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for doc, text_hash, text, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                own = text.split(b"\n")
                found += [(doc, text_hash, x["number"], own[x["number"]].decode("utf-8", "replace")) for x in some if x["number"] < len(own) and line_hash(own[x["number"]]) == x["h1"]]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*PLACE, "line"])

    named = maybe_in(rows, partnered.select(F.col("text_hash").alias("key")), "text_hash")
    lines = named.join(wanted, ["doc", "text_hash"]).select("doc", "text_hash", "text", "wanted").mapInArrow(pick, "doc long, text_hash long, number long, line string")
    lines = checkpointed(lines.dropDuplicates(PLACE))
    variants = lines.mapInArrow(_variants, "key long, place long, doc long, text_hash long, number long")
    earlier = [f"of_{c}" for c in PLACE]
    pairs = variants.repartition("key").sortWithinPartitions("key").mapInArrow(_earliest, ", ".join(f"{c} long" for c in [*PLACE, *earlier])).distinct()
    of = lines.select(*[F.col(c).alias(f"of_{c}") for c in PLACE], F.col("line").alias("of_line"))
    close = F.levenshtein("line", "of_line", 1).between(0, 1)
    return pairs.join(lines, PLACE).join(of, earlier).where(close).select(*PLACE).distinct()


def kept_lines(rows: DataFrame, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``doc, text_hash`` and ``kept``, the hashes of the lines that stay in that document."""
    first = checkpointed(first_lines(rows, edit_chars))
    keepers = first.join(near_lines(rows, first.where("k0 is not null")), PLACE, "left_anti")
    return keepers.groupBy("doc", "text_hash").agg(F.collect_list("h1").alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_chars: int = EDIT_CHARS, counts: bool = False) -> DataFrame:
    """``docs`` with the duplicate lines taken out of its text; ``counts`` adds n_lines and n_dropped."""
    rows = known_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    kept = kept_lines(rows, edit_chars)

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cleaned(texts: pd.Series, keeps: pd.Series) -> pd.DataFrame:
        found = []
        for text, keep in zip(texts, keeps, strict=True):
            if text is None:
                found.append((None, 0, 0))
                continue
            lines = text.split("\n")
            left = set() if keep is None else set(keep.tolist())
            out = []
            for line in lines:
                if line:
                    h = line_hash(line.encode("utf-8", "replace"))
                    if h not in left:
                        continue
                    left.discard(h)
                out.append(line)
            found.append(("\n".join(out), len(lines), len(lines) - len(out)))
        return pd.DataFrame(found, columns=["text", "n_lines", "n_dropped"])

    doc, text_hash, own, result = free_names(docs, "doc", "text_hash", "kept", "new")
    kept = kept.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("kept").alias(own))
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col(doc)) & (F.xxhash64(F.col(text_col)) == F.col(text_hash))
    joined = docs.join(kept, same, "left")
    new = joined.withColumn(result, cleaned(F.col(text_col), F.col(own)))
    columns = [F.col(f"{result}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return new.select(*columns, *([F.col(f"{result}.n_lines").alias("n_lines"), F.col(f"{result}.n_dropped").alias("n_dropped")] if counts else []))
