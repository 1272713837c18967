"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import ranked_search as rs

from .fixtures import TEXTS, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, own in asked.items():
        hits = []
        for (doc, _), c, size in zip(docs, counts, sizes, strict=True):
            damp = 10 + 90 * size * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * damp)) for t in own if c[t])
            if score > 0:
                hits.append((-score, doc is None, doc or 0))
        out += [(i, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, score string").repartition(2)


ITEMS = [(1, "this very LINE stands in documents"), (1, "école mit license"), (2, None), (3, "..."), (None, "w1x1 w5x5 w12x12 end"), (5, "nothing-known zzz"), (6, "under the mit license"), (6, "under the mit license")]


@pytest.mark.parametrize(("shard_docs", "block_terms"), [(rs.SHARD_DOCS, rs.BLOCK_TERMS), (3, rs.BLOCK_TERMS), (1, 2)])
def test_documents(spark, shard_docs, block_terms):
    place = f"{rs.shared_folder(spark)}/index"
    rs.index(documents(spark), shard_docs=shard_docs).write.parquet(place)
    assert found(rs.search(spark.read.parquet(place), items_of(spark, ITEMS), block_terms=block_terms)) == plain(TEXTS, ITEMS)


def test_given_tables(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert found(rs.ranked(docs, items, shard_bytes=50_000)) == want


def test_copies_and_ties(spark):
    docs = [(i % 40, "the same words again") for i in range(400)] + [(None, "the same words again")] * 3 + [(i, f"other words {i}") for i in range(500, 530)]
    items = [(1, "same again"), (2, "words"), (3, "other words 510")]
    assert found(rs.ranked(documents(spark, docs), items_of(spark, items), shard_docs=64)) == plain(docs, items)


def test_empty_tables(spark):
    assert rs.ranked(documents(spark, []), items_of(spark, ITEMS)).count() == 0
    assert rs.ranked(documents(spark), items_of(spark, [])).count() == 0
    assert rs.ranked(documents(spark, [(1, None), (2, ""), (3, " . ")]), items_of(spark, ITEMS)).count() == 0


def test_one_long_word_and_repeats(spark):
    docs = [(1, "x" * 400_000), (2, "again " * 100_000), (3, "again x")]
    items = [(1, "again"), (2, "x" * 400_000)]
    assert found(rs.ranked(documents(spark, docs), items_of(spark, items))) == plain(docs, items)


@pytest.mark.parametrize("seed", range(20))
def test_treap(seed):
    """Every point is stored once; values fall downwards; children lie within their parent's quadrant."""
    rng = np.random.default_rng(seed)
    bits = int(rng.integers(1, 9))
    cells = rng.choice(1 << 2 * bits, min(1 << 2 * bits, int(rng.integers(1, 400))), replace=False)
    rows, columns, values = cells >> bits, cells & ((1 << bits) - 1), rng.integers(1, rng.choice([3, 10**6]), len(cells))
    treap = rs.Treap(rs.build_treap(rows, columns, values, bits))
    assert sorted(zip(treap.row.tolist(), treap.column.tolist(), treap.value.tolist(), strict=True)) == sorted(zip(rows.tolist(), columns.tolist(), values.tolist(), strict=True))
    waiting, seen = [(0, 0, 0, 0)], set()
    while waiting:
        k, level, row, column = waiting.pop()
        seen.add(k)
        assert treap.row[k] >> (bits - level) == row and treap.column[k] >> (bits - level) == column
        for q in range(4):
            child = int(treap.child(np.array([k]), np.array([q]))[0])
            if child >= 0:
                assert treap.value[child] <= treap.value[k]
                waiting.append((child, level + 1, 2 * row + (q >> 1), 2 * column + (q & 1)))
    assert len(seen) == len(cells)


@pytest.mark.parametrize("seed", range(30))
def test_descent(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.expovariate(0.1))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(rng.randint(1, 300))]
    texts = [t.encode() for _, t in docs]
    n, total = sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs)
    shard = rs.shard_of([i for i, _ in docs], texts, n, total)
    if shard is None:
        return
    ids, vocabulary, _, raw = shard
    place = {w.decode(): k for k, w in enumerate(vocabulary.to_pylist())}
    df = Counter(t for _, text in docs for t in set(terms(text)))
    own = sorted({rng.choice(words) for _ in range(8)} & place.keys())
    if own:
        best = rs.Best(10)
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in own])
        rs.descend(rs.Treap(raw), np.array([place[t] for t in own]), weights, ids, best, wave=rng.choice([1, 4, 128]))
        assert [(i, -s) for s, _, i in best.hits] == [(r[2], r[3]) for r in plain(docs, [(1, " ".join(own))])]


def test_descent_leaves_out_most_documents():
    """A document that holds all terms many times over lets the search skip nearly all ranges."""
    texts = [f"common{i % 7} filler{i} pad{i * 3} end".encode() for i in range(4000)]
    for i in range(10):
        texts[i * 300] = b"rare word rare word rare word"
    ids, vocabulary, _, raw = rs.shard_of(list(range(4000)), texts, 4000, 16_000)
    place = {w: k for k, w in enumerate(vocabulary.to_pylist())}
    best = rs.Best(10)
    looked = rs.descend(rs.Treap(raw), np.array([place[b"rare"], place[b"word"], place[b"common3"]]), np.array([9000, 9000, 100]), ids, best, wave=8)
    assert sorted(i for _, _, i in best.hits) == [i * 300 for i in range(10)] and looked < 1200
