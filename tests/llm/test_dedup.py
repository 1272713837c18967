"""Exact, near and line dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import exact_dedup, line_dedup, simhash

from .fixtures import SAME, TEXTS, documents
from .test_scans import lower


def test_exact(spark):
    texts = [*TEXTS, (90, "ecole"), (91, "ECOLE"), (90, "ecole"), (None, "Ecole"), (17, "")]
    groups = {}
    for i, t in texts:
        groups.setdefault(lower(t), []).append(i)
    for limit in (exact_dedup.BUCKET_BYTES, 64):
        rows = exact_dedup.exact_duplicates(documents(spark, texts), bucket_bytes=limit).collect()
        assert len(rows) == len(texts)
        seen = sorted((str(r.doc_id), r.text_sha256, str(r.keep_id), r.group_size, r.kept) for r in rows)
        want = []
        for i, t in texts:
            own = groups[lower(t)]
            keep = max((x for x in own if x is not None), default=None)
            want.append((str(i), hashlib.sha256(lower(t).encode()).hexdigest(), str(keep), len(own), i is not None and i == keep))
        assert seen == sorted(want)
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0


def test_buckets_are_split_until_they_fit(spark):
    rows = [(k << 50, 10) for k in range(64)] + [(5, 1000)] * 3
    keyed = spark.createDataFrame(rows, "h long, bytes long")
    split = exact_dedup.split_buckets(keyed, 4, 100)
    sizes = {}
    for h, n in rows:
        sizes.setdefault(exact_dedup.bucket_of(h, 4, split), []).append((h, n))
    assert len(split) > 1
    assert all(sum(n for _, n in own) <= 100 or len({h for h, _ in own}) == 1 or max(h for h, _ in own) >> 60 == 0 and len(own) <= 4 for own in sizes.values())


def test_equal_rows_without_ids_are_spread(spark):
    """Each task names its copy; the rows meet the answer in as many groups."""
    rows = [(None, "The same text.")] * 10_000 + [(3, "the SAME text."), (4, "another")]
    docs = documents(spark, rows).repartition(6)
    found = exact_dedup.exact_duplicates(docs, bucket_bytes=100, most_tasks=3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == {(None, 3, 10_001, False): 10_000, (3, 3, 10_001, True): 1, (4, 4, 1, True): 1}
    named = docs.select("doc_id", "text").mapInArrow(exact_dedup._collapse(8, frozenset(), 16), exact_dedup.RECORD_DDL)
    assert named.where("is_row and doc_id is null").select("copy_of").distinct().count() >= 5


def test_table_compares_contents():
    table = exact_dedup.ContentTable(4)
    assert [table.place(7, c) for c in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]
    for k in range(100):
        assert table.place(k, b"%d" % k) == 3 + k


def plain_fingerprint(text):
    words = [w for w in lower(text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(codes, radius=3):
    parent = {i: i for i in codes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(codes)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in codes}


def test_simhash(spark):
    texts = [*TEXTS, (20, TEXTS[0][1] + " x"), (21, "A b"), (22, "a B"), (23, LONGISH), (24, LONGISH + " tail")]
    found = simhash.near_duplicates(documents(spark, texts)).collect()
    assert len(found) == len(texts)
    codes = {i: plain_fingerprint(t) for i, t in texts if i is not None}
    want = plain_components(codes)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert int(r.fingerprint, 16) == codes[r.doc_id] and len(r.fingerprint) == 16 and r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


LONGISH = " ".join(f"word{i}" for i in range(400))


@pytest.mark.parametrize("seed", range(8))
def test_gray_index_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    codes = [int(b) for b in base]
    for b in base:
        for _ in range(rng.integers(0, 25)):
            flips = rng.integers(0, 64, rng.integers(1, 6))
            code = int(b)
            for f in flips:
                code ^= 1 << int(f)
            codes.append(code)
    codes = np.array(sorted(set(codes)), np.uint64)
    groups = rng.integers(0, 4, len(codes))
    order = np.lexsort((simhash.gray_rank(codes), groups))
    codes, groups = codes[order], groups[order]
    found = {(int(x), int(y)) for a, b in simhash.GrayIndex(codes, groups).links(3) for x, y in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if groups[i] == groups[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 3}
    assert found == want


def test_gray_rank_orders_the_gray_sequence():
    codes = np.arange(64, dtype=np.uint64)
    gray = codes ^ (codes >> np.uint64(1))
    assert (simhash.gray_rank(gray) == codes).all()


@pytest.mark.parametrize("at_once", [1 << 18, 20])
def test_edges_and_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "EDGES_AT_ONCE", at_once)
    rng = random.Random(5)
    codes = {}
    for k in range(40):
        code = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 12])):
            codes[len(codes)] = code
            code ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in codes.items()]
    reps = spark.createDataFrame(rows, "node long, fp long").dropDuplicates(["fp"])
    roots = {r.node: r.root for r in simhash.components(simhash.near_edges(reps)).collect()}
    kept = {r.node: codes[r.node] for r in reps.collect()}
    assert {i: roots.get(i, i) for i in kept} == plain_components(kept)


@pytest.mark.parametrize("at_once", [1 << 18, 50])
def test_long_chains(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "EDGES_AT_ONCE", at_once)
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_stars_within_a_task(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 300, 400), rng.integers(0, 300, 400)
    u, v = np.maximum(u, v), np.minimum(u, v)
    batches = [pa.RecordBatch.from_arrays([pa.array(u[k : k + 30]), pa.array(v[k : k + 30])], ["u", "v"]) for k in range(0, 400, 30)]

    def groups(edges):
        parent = {int(x): int(x) for x in np.r_[u, v]}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        return {i: root(i) for i in parent}

    want = groups(zip(u.tolist(), v.tolist(), strict=True))
    for at_once in (1 << 18, 25):
        monkeypatch.setattr(simhash, "EDGES_AT_ONCE", at_once)
        stars = [(r["u"], r["v"]) for b in simhash._forest(iter(batches)) for r in b.to_pylist()]
        assert groups(stars) == want
        assert at_once == 25 or {a: b for a, b in stars} == {i: r for i, r in want.items() if i != r}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_lines(texts, least=20):
    order = sorted({(-(1 << 63) if i is None else i, t) for i, t in texts if t is not None})
    first = {}
    for i, t in order:
        for n, line in enumerate(t.split("\n")):
            if line:
                first.setdefault(line, (i, n))
    ranked = sorted(first, key=first.get)
    dropped = {line for k, line in enumerate(ranked) if len(line) >= least and any(len(o) >= least and abs(len(o) - len(line)) <= 1 and distance(o, line) <= 1 for o in ranked[:k])}
    out = {}
    for i, t in order:
        seen, kept = set(), []
        for line in t.split("\n"):
            stays = not line or (first[line][0] == i and line not in dropped and line not in seen)
            seen.add(line)
            kept += [line] if stays else []
        out[i] = "\n".join(kept)
    return out


def random_lines(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé 𝔘") for _ in range(rng.randrange(18, 40))) for _ in range(12)]
    texts = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(line))
                line[k : k + rng.randrange(2)] = rng.choice(["", "z", "a"])
            lines.append("".join(line))
        texts.append((i, "\n".join(lines)))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_lines(spark, seed):
    texts = TEXTS if seed == 0 else random_lines(seed)
    want = plain_lines(texts)
    docs = documents(spark, texts)
    rows = line_dedup.deduplicated(docs).collect()
    assert len(rows) == len(texts) and rows[0].__fields__ == docs.columns
    for r in rows:
        assert r.text == (None if r.doc_id == 5 and seed == 0 else want[-(1 << 63) if r.doc_id is None else r.doc_id]), r.doc_id
        assert r["__kept"] == "k"
    assert line_dedup.deduplicated(documents(spark, [])).count() == 0


def test_stage_folds_repeats_of_short_lines(spark):
    texts = [(1, "Les.\n\nfirst\nLes."), (2, "Les.\nLas.\n\nsecond"), (3, f"first\n{SAME}"), (4, f"{SAME}X\nend"), (5, None)]
    out = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, documents(spark, texts), "").collect()}
    assert out == {1: "Les.\n\nfirst", 2: "Las.\n\nsecond", 3: SAME, 4: "end", 5: None}


def test_rows_without_an_id_are_documents_of_their_own(spark):
    texts = [(None, f"{SAME}\nshort dup\none"), (None, f"{SAME}Y\nshort dup\ntwo"), (None, "three"), (7, "short dup\nfour"), (8, "x" * 200_000), (9, "x" * 199_999 + "y")]
    out = [r.text for r in line_dedup.deduplicated(documents(spark, texts)).collect()]
    assert len(out) == len(texts)
    lines = [line for t in out for line in t.split("\n") if line]
    assert sorted(line for line in lines if len(line) < 100 and line[0] != "T") == ["four", "one", "short dup", "three", "two"]
    assert sum(line.startswith(SAME) for line in lines) == 1 and [len(t) for t in out].count(200_000) == 1


def test_variants_are_made_in_parts(monkeypatch):
    import pyarrow as pa

    lines = ["abc", "d" * 50, "", "efgh"]
    whole = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([5] * 4), pa.array(range(4)), pa.array(lines)], ["doc", "text_hash", "number", "line"])
    want = [r for b in line_dedup._variants(iter([whole])) for r in b.to_pylist()]
    monkeypatch.setattr(line_dedup, "PART_CHARS", 10)
    assert [r for b in line_dedup._variants(iter([whole])) for r in b.to_pylist()] == want and len(want) == sum(len(t) + 1 for t in lines)


def test_deletion_keys_are_those_of_shorter_lines():
    line = "abracadabra und 𝔘nicode é"
    keys = line_dedup.deletion_keys(line)
    assert all(keys[i + 1] == line_dedup.deletion_keys(line[:i] + line[i + 1 :])[0] for i in range(len(line)))


def test_counts(spark):
    docs = documents(spark).select("doc_id", "text")
    r = {x.doc_id: x for x in line_dedup.deduplicated(docs, counts=True).where(F.col("doc_id").isNotNull()).collect()}
    assert (r[2].n_lines, r[2].n_dropped) == (2, 1) and (r[5].n_lines, r[5].text) == (0, None) and r[3].n_dropped == 1
