"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document is its token ids and one end id. Where a task has tokenised it, full
sequences of ``SIZE`` ids are cut from its front; its rest, if any, goes to a group that a hash of
its id, its ids and its place among equal rows of the task draws. The number of groups grows with the bytes of text, so that a
group's size doesn't. Within a group

1. rests are placed by falling length, each in the first open bin that holds it: a tournament
   tree over the bins' capacities finds it in as many steps as the tree is deep;
2. holes that first-fit leaves are filled with ids cut from the emptiest bins, until one bin at
   most is not full;
3. that last one is cut into sequences of a power of two, which need no padding.

So no sequence is padded, at the price of one cut for a hole. Only rests are shuffled, once; a group is
held by one task, group after group.

Token ids are those of the vocabulary file for the whole text. Its pre-tokenizer never reaches across
white space, so a text is parted there and each distinct word is looked up once for as long as
a worker remembers it (``MOST_WORDS``, a matter of memory, not of results). Words of ASCII and common Latin and Cyrillic
letters are cut by an expression equal to the pre-tokenizer's and handed to the vocabulary's model;
others, and texts that spell a special token, go through the whole tokenizer.

Defined results: null and empty texts are the end id alone; a very long text is tokenised in parts and leaves at most one rest; a null id
stays null; repeated rows are packed each for itself, in groups of their own choice; ties of length are placed by id and ids;
an empty table gives an empty result; columns besides id and text are never read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

SIZE = 4096
END_ID = 2
SEED = 77
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text whose rests make a group on average; bytes that are tokenised together; words that a worker remembers.
GROUP_BYTES = 4 << 20
SLICE = 2 << 20
MOST_WORDS = 1 << 20
#: Sequences of a group are numbered in these bits, full ones of a task in those, above ``FULL``.
GROUP_BITS = 24
TASK_BITS = 30
FULL = 1 << 62

# Letters beside ASCII that neither decompose nor change their kind: Latin-1 and basic Cyrillic, in UTF-8.
_LETTER = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xd0[\x90-\xbf]|\xd1[\x80-\x8f]"
#: A word with any other byte above ASCII is one match; others part as the vocabulary's pre-tokenizer parts them. Line feeds end words.
_PARTS = re.compile(
    rb"(?:[^\s\x80-\xff]|" + _LETTER + rb")*+[\x80-\xff]\S*|'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|" + _LETTER + rb")+|[0-9]|[^\sa-z0-9\x80-\xff]+|\n"
)
_SPACE = re.compile(rb"\s")
_PLAIN = re.compile(rb"[\x00-\x7f]+|(?:[a-z]|" + _LETTER + rb")+")
#: Byte-level vocabularies write a byte as a letter: itself where that can be printed, else the next beyond 255.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER_OF_BYTE = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file."""
    try:
        import public_tokenizers
    except ImportError:
        if "/opt/tokenizers" not in sys.path:
            sys.path.append("/opt/tokenizers")
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, words looked up once."""

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [str(x.content).encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.parts: dict[bytes, bytes] = {}
        #: Ids of all words met, where each word's begin, and where the last one's end.
        self.ids, self.start = array("I"), array("q", [0])

    def whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _part(self, part: bytes) -> bytes:
        """Ids of one pre-token, or of a word that only the whole tokenizer can part."""
        if _PLAIN.fullmatch(part):
            letters = part if part.isascii() else part.decode().lower().encode()
            ids = [x.id for x in self.model.tokenize(letters.decode("latin-1").translate(_LETTER_OF_BYTE))]
        else:
            ids = self.whole(part)
        self.parts[part] = raw = array("I", ids).tobytes()
        return raw

    def _meet(self, words: list[bytes]) -> None:
        """Learns new words."""
        known, one, ids = self.parts.get, self._part, self.ids
        for part in _PARTS.findall(b"\n".join([*words, b""])):
            if part == b"\n":
                self.start.append(len(ids))
            else:
                ids.frombytes(known(part) or one(part))
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, all of them looked up at once."""
        if len(self.place) > MOST_WORDS or len(self.parts) > MOST_WORDS:
            self.forget()
        odd = {k: np.array(self.whole(t), np.uint32) for k, t in enumerate(texts) if any(x in t for x in self.special)}
        words = pc.ascii_split_whitespace(pa.array([b"" if k in odd else t.lower() for k, t in enumerate(texts)], pa.binary()).view(pa.string()))
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.view(pa.binary()).to_pylist()
        self._meet([w for w in distinct if w not in self.place])
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[flat.indices.to_numpy(zero_copy_only=False)]
        # Views end with this call; the arrays grow again in the next.
        start = np.frombuffer(self.start, np.int64)
        low, length = start[at], start[at + 1] - start[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(low - ends[:-1], length) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, np.uint32)
        del start
        cuts = ends[words.offsets.to_numpy()]
        return [odd[k] if k in odd else ids[cuts[k] : cuts[k + 1]] for k in range(len(texts))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One to a worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: list[bytes], size: int = SLICE) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Numbers and parts of texts in lists of about ``size`` bytes, and whether a part ends its text. Parts end at white space."""
    held, n = [], 0
    for number, text in enumerate(texts):
        low = 0
        while True:
            cut = _SPACE.search(text, low + size) if len(text) - low > size else None
            high = cut.start() if cut else len(text)
            held.append((number, text[low:high], cut is None))
            n += high - low
            low = high
            if n >= size:
                yield held
                held, n = [], 0
            if cut is None:
                break
    if held:
        yield held


class Tournament:
    """Capacities of bins as leaves of a tree whose nodes hold the larger of two: the first bin with room is found from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, which is taken from it."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        most[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in ``sizes``; equal sizes in the order given."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    bins: list[list[int]] = []
    tree = Tournament(max(1, len(sizes)), capacity)
    for k in order:
        b = tree.place(sizes[k])
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def packed(sizes: list[int], capacity: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (place, start, length), full ones or a power of two long."""
    bins = [[(k, 0, sizes[k]) for k in own] for own in first_fit_decreasing(sizes, capacity)]
    fill = [sum(x[2] for x in own) for own in bins]
    holes = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: (-fill[b], b))
    full = [own for own, n in zip(bins, fill, strict=True) if n == capacity]
    low, high = 0, len(holes) - 1
    while low < high:
        own, donor = bins[holes[low]], bins[holes[high]]
        missing = capacity - fill[holes[low]]
        while missing and donor:
            k, start, length = donor.pop()
            taken = min(missing, length)
            # The end of a piece goes, so that what stays keeps its start.
            own.append((k, start + length - taken, taken))
            if taken < length:
                donor.append((k, start, length - taken))
            missing -= taken
            fill[holes[high]] -= taken
        fill[holes[low]] = capacity - missing
        if not donor:
            high -= 1
        if not missing:
            full.append(own)
            low += 1
    last = [x for x in (bins[holes[low]] if low < len(holes) else []) if x[2]]
    if last and fill[holes[low]] == capacity:
        full.append(last)
        last = []
    return full + _powers_of_two(last)


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces as sequences whose lengths are the binary digits of the whole."""
    left, out = sum(x[2] for x in pieces), []
    pieces = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        own = []
        while room:
            k, start, length = pieces.pop()
            taken = min(room, length)
            own.append((k, start, taken))
            if taken < length:
                pieces.append((k, start + taken, length - taken))
            room -= taken
        out.append(own)
    return out


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("group", pa.int64()), ("ids", pa.binary())])
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, `group` long, ids binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cut(path: str, groups: int, capacity: int, end_id: int):
    """Full sequences of each text as finished pieces, its rest with its ids and a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        task = TaskContext.get().partitionId()
        sequence = FULL + (task << TASK_BITS)
        twins: Counter[int] = Counter()
        for batch in batches:
            names = batch.column(0).to_pylist()
            # Of a text that is still read: ids that don't fill a sequence yet, how many came before them, and its full sequences.
            rest, before, full = np.zeros(0, np.uint32), 0, []
            for part in slices(as_bytes(batch.column(1))):
                rows: list[tuple] = []
                for (number, _, ends), ids in zip(part, own.encode([t for _, t, _ in part]), strict=True):
                    name = names[number]
                    ids = np.concatenate([rest, ids, np.array([end_id] if ends else [], np.uint32)])
                    whole = len(ids) - len(ids) % capacity
                    for low in range(0, whole, capacity):
                        full.append((before + low, zlib.crc32(ids[low : low + capacity].astype("<u4").tobytes()), sequence))
                        sequence += 1
                    rest, before = ids[whole:], before + whole
                    if not ends:
                        continue
                    tokens = before + len(rest)
                    rows += [(name, start, capacity, crc, tokens, s, 0, s % groups, None) for start, crc, s in full]
                    if len(rest):
                        raw = rest.astype("<u4").tobytes()
                        twin = xxhash.xxh64_intdigest(b"%d:%b" % (-1 if name is None else name, raw), SEED)
                        twins[twin] += 1
                        group = xxhash.xxh64_intdigest(f"{twin}:{task}:{twins[twin]}", SEED) % groups
                        rows.append((name, before, len(rest), None, tokens, None, None, group, raw))
                    rest, before, full = np.zeros(0, np.uint32), 0, []
                yield _batch(rows, PIECE)

    return run


def _group(rows: list[tuple], group: int, capacity: int) -> list[tuple]:
    """A group's rests as pieces of sequences."""
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
    out = []
    for number, own in enumerate(packed([r[2] for r in rows], capacity)):
        offset = 0
        for k, start, length in own:
            doc_id, before, _, raw, tokens = rows[k]
            out.append((doc_id, before + start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), tokens, (group << GROUP_BITS) + number, offset))
            offset += length
    return out


def _pack(capacity: int):
    """Reads group after group; finished pieces pass."""
    done = pa.schema(list(PIECE)[:7])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            finished = pc.is_null(batch.column("ids"))
            yield pa.RecordBatch.from_arrays(batch.filter(finished).columns[:7], schema=done)
            rests = batch.filter(pc.invert(finished))
            for g, *row in zip(*(rests.column(c).to_pylist() for c in ("group", "doc_id", "start", "length", "ids", "doc_tokens")), strict=True):
                if g != group:
                    yield _batch(_group(held, group or 0, capacity), done)
                    group, held = g, []
                held.append(tuple(row))
        yield _batch(_group(held, group or 0, capacity), done)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = picked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    pieces = picked.mapInArrow(_cut(vocabulary or vocabulary_path(), max(1, ceil(total / group_bytes)), size, end_id), PIECE_DDL)
    done = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.repartition("group").sortWithinPartitions("group").mapInArrow(_pack(size), done)
