"""Near copies against brute force over all pairs; the pipeline's stage."""

import random

import pytest

import corpus_pipeline
from marginalia.llm import near_copies, simhash
from marginalia.llm.common import compact

from .fixtures import TEXTS, documents


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets = [(i, plain_shingles(t)) for i, t in texts if i is not None]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x == y or len(x & y) >= 0.8 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, least[root(k)]) for k, (i, _) in enumerate(sets))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_near_copies(spark):
    rng = random.Random(4)
    texts = list(TEXTS)
    for group in range(25):
        words = [f"g{group}w{rng.randrange(300)}" for _ in range(200)]
        for _ in range(rng.randrange(1, 7)):
            texts.append((100 + len(texts), " ".join(words)))
            words = edited(rng, words, rng.choice([0, 1, 2, 3, 4, 5, 9]))
    found = near_copies.near_copies(documents(spark, texts)).collect()
    assert len(found) == len(texts)
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id is not None) == plain_groups(texts)
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert near_copies.near_copies(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [8, 9])
def test_one_large_group_of_edited_copies(spark, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    pool = [(rng.randrange(120), f"edit{k % 40}") for k in range(60)]
    texts = []
    for i in range(150):
        words = list(base)
        for place, word in rng.sample(pool, rng.randrange(0, 9)):
            words[place] = word
        texts.append((i, " ".join(words[: rng.choice([120, 120, 120, 110, 100])])))
    found = near_copies.near_copies(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == plain_groups(texts)


def test_one_row_of_each_group_stays(spark):
    words = " ".join(f"word{k}" for k in range(60))
    texts = [(1, words), (1, words), (1, "another text of id one, on its own"), (2, words + " tail"), (None, words), (None, words), (3, ""), (4, None), (5, " ")]
    out = sorted((str(r.doc_id), r.text or "") for r in near_copies.one_of_each(documents(spark, texts)).collect())
    assert out == sorted([("1", words), ("1", texts[2][1]), ("None", words), ("None", words), ("3", "")])


def test_stage_folds_copies_of_a_similarity_of_eight_tenths(spark, sf):
    words = [f"word{k}" for k in range(200)]
    copy = [*words]
    copy[30], copy[70], copy[110], copy[150] = "other", "words", "stand", "here"
    far = edited(random.Random(1), words, 40)
    texts = [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(far))]
    out = corpus_pipeline.near_duplicate_stage(spark, documents(spark, texts), sf)
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_stage_links_by_fingerprints_too(spark, sf):
    """Texts of one passage that repeats, each with an end of its own: one fingerprint or near ones, but few shingles in common."""
    rng = random.Random(7)
    texts = []
    for group in range(12):
        words = " ".join([f"g{group}w{k}" for k in range(11)] * 50)
        texts += [(100 * group + k, " ".join([words, *[f"own{rng.randrange(10**6)}" for _ in range(30)]])) for k in range(3)]
    texts.append((5000, " ".join(f"alone{k}" for k in range(50))))
    prints = {i: simhash.fingerprint(t.encode()) for i, t in texts}
    assert plain_groups(texts) == sorted((i, i) for i, _ in texts)
    want = sorted(i for i, _ in texts if not any((prints[i] ^ prints[j]).bit_count() <= 3 for j, _ in texts if j < i and j // 100 == i // 100))
    assert len(want) <= 20
    out = corpus_pipeline.near_duplicate_stage(spark, documents(spark, texts), sf)
    assert sorted(r.doc_id for r in out.collect()) == want


def test_links_of_both_kinds_join(spark):
    """The first and second text are linked by their fingerprints, the second and third by their shingles."""
    rng = random.Random(3)
    block = [f"w{k}" for k in range(11)]
    first = " ".join(block * 50)
    second = " ".join(block * 50 + [f"end{k}" for k in range(30)])
    third = " ".join(block * 3 + [f"end{k}" for k in range(30)])
    texts = [(1, first), (2, second), (3, third), (4, " ".join(f"other{rng.randrange(99)}" for _ in range(60)))]
    assert plain_groups(texts) == [(1, 1), (2, 2), (3, 2), (4, 4)]
    found = near_copies.near_copies(documents(spark, texts), radius=3).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_links_at_the_very_threshold(spark):
    """Fragments of one text: many pairs have a similarity of just 0.8, or a shingle less; which one is the hub doesn't matter."""
    rng = random.Random(5)
    texts = []
    for n in (40, 49, 94, 148, 184):
        words = [f"n{n}w{k}" for k in range(n + 40)]
        for _ in range(30):
            low = rng.randrange(20)
            high = low + n + rng.choice([-5, 0, 1, 4, 9])
            texts.append((len(texts), " ".join(words[low:high] + [f"own{rng.randrange(30)}" for _ in range(rng.randrange(6))])))
    found = near_copies.near_copies(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == plain_groups(texts)


def test_rows_are_counted_by_the_job_that_writes_them(spark):
    context = spark.sparkContext
    for rows, most, tasks in ((0, 10, 1), (100, 1000, 1), (100, 30, 4)):
        df = spark.range(0, 100, numPartitions=5).where(f"id < {rows}")
        group = f"compact {rows} {most}"
        context.setJobGroup(group, group)
        try:
            out = compact(df, most)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)
        assert len(context.statusTracker().getJobIdsForGroup(group)) <= 1
        assert out.rdd.getNumPartitions() == tasks
        assert sorted(r.id for r in out.collect()) == list(range(rows))
