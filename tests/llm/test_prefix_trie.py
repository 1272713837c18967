"""The prefix trie against a trie of dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import prefix_trie



@pytest.fixture(autouse=True)
def several_tasks(spark):
    """Small tables are not put in one task."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


SCHEMA = "conv_id long, turn long, role string, text string, base string, path string, words string"


def table(spark, rows, tasks=3):
    return spark.createDataFrame([(*r, "b", "p", "w") for r in rows], SCHEMA).repartition(tasks)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain_sequences(rows, family=20, heads=4):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    by = {c: [x[3:] for x in sorted(own)] for c, own in by.items()}
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = abs(c) - abs(c) % family
        out[c] = by.get(base if c >= 0 else -base, [])[:h] + own[h:]
    return out


def plain_nodes(rows, **more):
    sequences = plain_sequences(rows, **more)
    members, ended = defaultdict(list), defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ended[tuple(s)].append(c)
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own) - 1) * words
            leaves[node[:d]] += children[node] == 0
    return sorted(
        (min(own), len(n), min(members[n[:-1]]) if n else None, len(own), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ended[n]))).encode()).hexdigest())
        for n, own in members.items()
    ) if sequences else []


def nodes(df):
    return sorted((tuple(r) for r in df.select(prefix_trie.RESULT).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def same(df, rows, **more):
    assert nodes(df) == sorted(plain_nodes(rows, **more), key=lambda r: tuple((x is not None, x) for x in r))


def random_rows(seed, convs=60, pool=3, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 200), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "dd  e\tf", "é"][:pool])))
    return rows


@pytest.mark.parametrize(("seed", "turns"), [(0, 1), (1, 5), (2, 17), (3, 64), (4, 1 << 16)])
def test_random_conversations(spark, seed, turns):
    rows = random_rows(seed)
    same(prefix_trie.conversation_trie(table(spark, rows), shard_turns=turns), rows)


def test_given_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    same(prefix_trie.conversation_trie(df, shard_turns=40), rows)


def test_copies_in_many_shards_and_tasks(spark):
    """A third of all conversations are equal, others are their beginnings and continuations."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    rows += [(c, t, "user", f"turn {t}") for c in range(300, 340) for t in range(5)]
    rows += [(c, t, "user", f"turn {t}") for c in range(340, 380) for t in range(2)]
    rows += [(c, t, "user", f"own {c} {t}") for c in range(400, 500) for t in range(3)]
    paths = prefix_trie.rebuilt(table(spark, rows), heads=1)
    same(prefix_trie.trie_nodes(paths, 9), rows, heads=1)
    spread = prefix_trie.rebuilt(table(spark, rows), heads=1).repartitionByRange("path", "conv_id").select(F.spark_partition_id().alias("p"), F.md5("path").alias("m")).distinct()
    assert max(r["count"] for r in spread.groupBy("m").count().collect()) > 1


def test_long_conversation_and_long_texts(spark):
    rows = [(20, t, "user", f"w{t % 7}") for t in range(3000)] + [(21, t, "user", f"w{t % 7}") for t in range(2990)] + [(22, 0, "user", "x" * 300_000), (23, 0, None, "y " * 100_000)]
    got = nodes(prefix_trie.conversation_trie(table(spark, rows), shard_turns=500))
    # Of such long chains the plain trie is too slow; its sums follow from the rules.
    top = next(r for r in got if r[1] == 0)
    assert top[3] == 4 and len(got) == len({tuple(s[:d]) for s in plain_sequences(rows).values() for d in (0, 1, 2, 3, 4)}) + sum(1 for r in got if r[1] > 4)
    assert max(r[1] for r in got) == 3000 and sum(r[4] for r in got) == len(got) - 1 and top[5] == sum(1 for r in got if r[4] == 0)


def test_no_conversations(spark):
    assert prefix_trie.conversation_trie(table(spark, [(None, 1, "user", "no id")])).count() == 0
    assert prefix_trie.conversation_trie(table(spark, [])).count() == 0


def test_turnless_conversations(spark):
    lone = next(c for c in range(1, 20) if prefix_trie.heads_of(c) == 3)
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    got = nodes(prefix_trie.conversation_trie(table(spark, rows)))
    assert got == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


@pytest.mark.parametrize("seed", range(10))
def test_ternary_tree(seed):
    rng = random.Random(seed)
    paths = sorted({tuple(rng.randint(0, 9) for _ in range(rng.randint(0, 5))) for _ in range(80)})
    tree = prefix_trie.TernaryTree()
    ends = tree.insert_sorted([(list(p), [1] * len(p)) for p in paths])
    assert len(tree.code) == len({p[:d] for p in paths for d in range(len(p) + 1)})
    for p, end in zip(paths, ends, strict=True):
        back = []
        while end:
            back.append(tree.code[end])
            assert tree.parent[end] < end
            end = tree.parent[end]
        assert tuple(back[::-1]) == p


def test_siblings_are_balanced():
    tree = prefix_trie.TernaryTree()
    tree.insert_sorted([([c], [1]) for c in range(1023)])

    def height(k):
        return 1 + max(height(tree.low[k]), height(tree.high[k])) if k else 0

    assert height(tree.down[0]) == 10


def test_shared_turns():
    a, b = (np.random.default_rng(k).bytes(48) for k in (1, 2))
    assert prefix_trie.shared_turns(a, a) == 3 and prefix_trie.shared_turns(a, b) == 0
    assert prefix_trie.shared_turns(a, a[:16]) == 1 and prefix_trie.shared_turns(b"", a) == 0
