"""Prefix trie of conversations: ternary search trees over range shards, merged at their boundaries.

1. A turn is the digest (128 bits of SHA-256) of its role and text. Conversations are
   rebuilt from their turns, sorted by family: of conversation c the first turns come from that of c - c % FAMILY.
2. Paths, the joined digests, are sorted by range, of equal paths by conversation. So a trie node's members
   stand in a row, and copies of one conversation spread over as many tasks as they need.
3. A task cuts its range to shards of ``SHARD_TURNS`` turns. Digests of a shard are encoded as
   places in its dictionary; its distinct paths are inserted in a ternary search tree, medians first, so that the trees
   of siblings are balanced. Nodes come after their parents, so one walk from the last to the first adds up members, leaves
   and words.
4. Only nodes that a neighbouring shard has too are merged: their members and words are added up, and what two neighbours
   both counted (nodes, children and the leaf on the path they share) is taken off once for each junction. Such nodes are as many as shards times
   their depth. Ids of conversations that end at one node are hashed in order, chunk after chunk.

A node's savings are the words of all turns below it less those of its distinct nodes.

Defined results: null roles and texts are empty; turns of equal number are ordered by digest; rows without conv_id
belong to no conversation and are left out; repeated rows are turns of their own; ``%`` has the sign of c, as in SQL; a very long
text is read by its digest and count of words alone; a conversation takes 24 bytes a turn in one task; an
empty table has no node, not even the root; further columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

FAMILY = 20
HEADS = 4
SHARD_TURNS = 1 << 16
#: Rows of shared nodes that are broadcast to their children; 40 bytes each.
BROADCAST_NODES = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16
NO_IDS = hashlib.sha256(b"").hexdigest()


def heads_of(conv_id: int, heads: int = HEADS) -> int:
    """Turns that a conversation takes over from the first of its family."""
    return zlib.crc32(str(conv_id).encode()) % heads


def turns(conversations: DataFrame, family: int = FAMILY) -> DataFrame:
    """``base, follows, conv_id, turn, digest, words``: a row for each turn, texts left behind."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("long")
    return conversations.where(conv.isNotNull()).select(
        (conv - conv % family).alias("base"), (conv % family != 0).alias("follows"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """``conv_id, path, words`` for each conversation: its turns' digests and counts of words, in a row. With ``heads`` of 1 conversations stay as they are."""
    own = ["base", "follows", "conv_id", F.asc_nulls_first("turn"), "digest"]
    rows = turns(conversations, family).repartition("base").sortWithinPartitions(*own).select("base", "follows", "conv_id", "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, opening = None, (b"", b"")
        conv, path, words = None, bytearray(), bytearray()
        out: list[tuple] = []

        def close() -> None:
            if conv is not None:
                h = heads_of(conv, heads)
                out.append((conv, opening[0][: h * DIGEST] + path[h * DIGEST :], opening[1][: h * 8] + words[h * 8 :]))

        for batch in batches:
            ids = batch.column(2).to_numpy()
            digests, counts = b"".join(batch.column(3).to_pylist()), batch.column(4).to_numpy().astype("<i8").tobytes()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if ids[low] != conv:
                    close()
                    if batch.column(0)[low].as_py() != base:
                        base, opening = batch.column(0)[low].as_py(), (b"", b"")
                    conv, path, words = int(ids[low]), bytearray(), bytearray()
                path += digests[low * DIGEST : high * DIGEST]
                words += counts[low * 8 : high * 8]
                if conv == base:
                    opening = bytes(path[: heads * DIGEST]), bytes(words[: heads * 8])
            yield _batch(out, PATH)
            out = []
        close()
        yield _batch(out, PATH)

    return rows.mapInArrow(run, "conv_id long, path binary, words binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


PATH = pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("words", pa.binary())])


class TernaryTree:
    """A trie whose siblings are the nodes of a binary search tree. Node 0 is the root; a node comes after its parent."""

    def __init__(self):
        self.code, self.low, self.down, self.high = [0], [0], [0], [0]
        self.parent, self.depth, self.words = [0], [0], [0]

    def insert(self, codes: list[int], words: list[int]) -> int:
        """The node that the codes lead to."""
        code, low, down, high = self.code, self.low, self.down, self.high
        at = 0
        for c, w in zip(codes, words, strict=True):
            k, links, link = down[at], down, at
            while k and c != code[k]:
                links, link = (low, k) if c < code[k] else (high, k)
                k = links[k]
            if not k:
                k = links[link] = len(code)
                code.append(c)
                low.append(0)
                down.append(0)
                high.append(0)
                self.parent.append(at)
                self.depth.append(self.depth[at] + 1)
                self.words.append(w)
            at = k
        return at

    def insert_sorted(self, paths: list[tuple[list[int], list[int]]]) -> list[int]:
        """End nodes of sorted paths, which are inserted median first."""
        ends = [0] * len(paths)
        waiting = [(0, len(paths))]
        while waiting:
            a, b = waiting.pop()
            if a < b:
                m = (a + b) // 2
                ends[m] = self.insert(*paths[m])
                waiting += [(m + 1, b), (a, m)]
        return ends


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with in common."""
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(p, f"S{DIGEST}", n) for p in (a, b))
    differ = x != y
    return int(differ.argmax()) if differ.any() else n


def prefix_keys(path: bytes, depth: int) -> list[bytes]:
    """Names of the nodes from the root down to ``depth``."""
    h = hashlib.blake2b(digest_size=DIGEST)
    out = [h.digest()]
    for d in range(depth):
        h.update(path[d * DIGEST : (d + 1) * DIGEST])
        out.append(h.copy().digest())
    return out


#: complete: final but for the parent, which is named by key; shared: a part of a node; junction: a task's first and last path.
ROW = pa.schema(
    [("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
     ("turn_words", pa.int64()), ("node_words", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.binary()), ("key", pa.binary()), ("parent_key", pa.binary()), ("task", pa.int32()), ("shard", pa.int64()),
     ("first", pa.binary()), ("first_words", pa.binary()), ("last", pa.binary())]
)
ROW_DDL = (
    "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, turn_words long, node_words long, "
    "ends_sha256 string, ends binary, key binary, parent_key binary, task int, shard long, first binary, first_words binary, last binary"
)


def corrections(last: bytes, first: bytes, words: list[int]) -> list[tuple[int, int, int]]:
    """Children, leaves and words that two neighbours both counted, for each node from the root down to the last they share."""
    common = shared_turns(last, first)
    leaf = int(len(last) == common * DIGEST)
    out, below = [], 0
    for d in range(common, -1, -1):
        below += words[d - 1] if d else 0
        out.append((int(d < common), leaf, below))
    return out[::-1]


def shard_rows(rows: list[tuple[int, bytes, bytes]], before: bytes | None, after: bytes | None, task: int, shard: int) -> list[tuple]:
    """Nodes of a shard of sorted (conv_id, path, words). ``before`` and ``after`` are the neighbours' paths, None where unknown."""
    paths: list[bytes] = []
    counts: list[bytes] = []
    members: list[list[int]] = []
    for conv, path, words in rows:
        if not paths or path != paths[-1]:
            paths.append(path)
            counts.append(words)
            members.append([])
        members[-1].append(conv)
    _, codes = np.unique(np.frombuffer(b"".join(paths), f"S{DIGEST}"), return_inverse=True)
    codes, at, sequences = codes.tolist(), 0, []
    for path, words in zip(paths, counts, strict=True):
        n = len(path) // DIGEST
        sequences.append((codes[at : at + n], np.frombuffer(words, "<i8").tolist()))
        at += n
    tree = TernaryTree()
    ends = tree.insert_sorted(sequences)
    n = len(tree.code)
    ended: dict[int, list[int]] = dict(zip(ends, members, strict=True))
    convs, least, children, leaves, turn_words, node_words = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n, list(tree.words)
    parent = tree.parent
    for k in range(n - 1, -1, -1):
        if own := ended.get(k):
            convs[k] += len(own)
            if least[k] is None or own[0] < least[k]:
                least[k] = own[0]
        leaves[k] += children[k] == 0
        turn_words[k] += convs[k] * tree.words[k]
        if k:
            p = parent[k]
            convs[p] += convs[k]
            if least[p] is None or least[k] < least[p]:
                least[p] = least[k]
            children[p] += 1
            leaves[p] += leaves[k]
            turn_words[p] += turn_words[k]
            node_words[p] += node_words[k]
    # Nodes that a neighbour may have too, with their names.
    keys: dict[int, bytes] = {}
    for end, path, other in ((ends[0], paths[0], before), (ends[-1], paths[-1], after)):
        depth = len(path) // DIGEST if other is None else shared_turns(path, other)
        names = prefix_keys(path, depth)
        while tree.depth[end] > depth:
            end = parent[end]
        for d in range(depth, -1, -1):
            keys[end] = names[d]
            end = parent[end]
    if before is not None:
        taken = corrections(before, paths[0], sequences[0][1])
        end = ends[0]
        while tree.depth[end] >= len(taken):
            end = parent[end]
        for child, leaf, words in taken[::-1]:
            children[end] -= child
            leaves[end] -= leaf
            node_words[end] -= words
            end = parent[end]
    out = []
    for k in range(n):
        ids = ",".join(map(str, ended[k])).encode() if k in ended else None
        numbers = (convs[k], children[k], leaves[k], turn_words[k], node_words[k])
        above = keys.get(parent[k]) if k else None
        if k in keys:
            out.append(("shared", least[k], tree.depth[k], None, *numbers, None, ids, keys[k], above, task, shard, None, None, None))
        else:
            sha = NO_IDS if ids is None else hashlib.sha256(ids).hexdigest()
            out.append(("complete", least[k], tree.depth[k], None if above else least[parent[k]], *numbers, sha, None, None, above, None, None, None, None, None))
    return out


def _nodes(shard_turns: int):
    """Nodes of a task's range, shard after shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[tuple[int, bytes, bytes]] = []
        n, shard, before, first = 0, 0, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n >= shard_turns:
                    yield _batch(shard_rows(held, before, row[1], task, shard), ROW)
                    before, held, n, shard = held[-1][1], [], 0, shard + 1
                if first is None:
                    first = row
                held.append(row)
                n += len(row[1]) // DIGEST + 1
        if held:
            rows = shard_rows(held, before, None, task, shard)
            rows.append(("junction", *[None] * 12, task, None, first[1], first[2], held[-1][1]))
            yield _batch(rows, ROW)

    return run


def _junctions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring tasks both counted, as parts of the nodes they share."""
    for batch in batches:
        for task, first, words, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            taken = corrections(last, first, np.frombuffer(words, "<i8").tolist())
            keys = prefix_keys(first, len(taken) - 1)
            yield _batch([("shared", None, d, None, 0, -child, -leaf, 0, -w, None, None, keys[d], keys[d - 1] if d else None, task, -1, None, None, None) for d, (child, leaf, w) in enumerate(taken)], ROW)


MERGED = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), *((x, pa.int64()) for x in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "turn_words", "node_words")), ("ends_sha256", pa.string())])
MERGED_DDL = "key binary, parent_key binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, turn_words long, node_words long, ends_sha256 string"
SUMS = ["n_convs", "n_children", "n_leaves", "turn_words", "node_words"]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each node, which come in the order of the ranges; ids are hashed chunk by chunk."""
    key, head, least, sums, ids, any_ids = None, None, None, [0] * 5, hashlib.sha256(), False
    for batch in batches:
        out = []
        for k, parent, depth, conv, chunk, *numbers in zip(*(batch.column(c).to_pylist() for c in ("key", "parent_key", "depth", "conv_id", "ends", *SUMS)), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, head[0], least, head[1], *sums, ids.hexdigest()))
                key, head, least, sums, ids, any_ids = k, (parent, depth), None, [0] * 5, hashlib.sha256(), False
            if conv is not None and (least is None or conv < least):
                least = conv
            sums = [a + b for a, b in zip(sums, numbers, strict=True)]
            if chunk is not None:
                ids.update(b"," + chunk if any_ids else chunk)
                any_ids = True
        yield _batch(out, MERGED)
    if key is not None:
        yield _batch([(key, head[0], least, head[1], *sums, ids.hexdigest())], MERGED)


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each node of the trie of ``conv_id, path, words``."""
    ranged = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "path", "words")
    rows = checkpointed(ranged.mapInArrow(_nodes(shard_turns), ROW_DDL))
    # A row for each task, in the order of their ranges.
    in_order = Window.orderBy("task")
    junctions = rows.where("kind = 'junction'").select("task", "first", "first_words", F.lag("last").over(in_order).alias("last")).where("last is not null")
    parts = rows.where("kind = 'shared'").unionByName(junctions.mapInArrow(_junctions, ROW_DDL))
    merged = checkpointed(parts.repartition("key").sortWithinPartitions("key", "task", "shard").mapInArrow(_merge, MERGED_DDL))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    if merged.count() <= BROADCAST_NODES:
        parents = F.broadcast(parents)
    waiting = rows.where("kind = 'complete' and parent_key is not null").drop("parent_conv_id").unionByName(merged, allowMissingColumns=True)
    found = waiting.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("above"))
    known = rows.where("kind = 'complete' and parent_key is null")
    saved = (F.col("turn_words") - F.col("node_words")).alias("saved_tokens")
    columns = [saved if c == "saved_tokens" else F.col(c) for c in RESULT]
    return known.select(columns).unionByName(found.select(columns))


def conversation_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations (see ``rebuilt``)."""
    return trie_nodes(rebuilt(conversations, family, heads), shard_turns)
