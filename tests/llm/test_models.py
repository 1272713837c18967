"""Classifier, language model, token counts, decontamination, mixing, pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import decontaminate, lm_score, mixing, quality, token_count
from marginalia.llm.common import fold_of

from .fixtures import TEXTS, by_id, documents


def held_out(i, folds):
    return i is not None and zlib.crc32(str(i).encode()) % folds == 1


# ---- classifier ----


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.97
    assert sum(r.predicted == r.quality for r in found) / len(found) > 0.95
    assert sum(r.predicted for r in found if r.quality == 1) >= 0.98 * len(good)


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(documents(spark), labels).collect()
    assert len(found) == len(TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held_out(r.doc_id, 3) for r in found)
    assert quality.quality_scores(documents(spark, []), labels).count() == 0
    scores = {r.score for r in quality.quality_scores(documents(spark), labels.where("quality = 1")).collect()}
    assert len(scores) == 1


def test_rows_that_are_fitted_are_bounded(spark):
    docs = documents(spark, [(k % 5, f"word{k} other words {k % 3}") for k in range(300)] + [(90, "far"), (91, "away")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    assert quality.Classifier(docs, labels, train_rows=20).fitted_rows == 20
    ids = [k for k in [*range(5), 90, 91] if not held_out(k, 3)]
    assert quality.Classifier(docs, labels).fitted_rows == sum(60 if k < 5 else 1 for k in ids)


def test_word_vectors_are_sums_of_neighbours(spark):
    texts = ["a b c A", "c c", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    place, sign = quality.index_vectors()
    want = np.zeros((quality.SLOTS, quality.DIM))
    for t in texts:
        words = [zlib.crc32(w.encode()) % quality.SLOTS for w in (t or "").lower().split()]
        for i, w in enumerate(words):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    for p, s in zip(place[words[j]], sign[words[j]], strict=True):
                        want[w, p] += s
    want = quality.unit(quality.unit(want) - quality.unit(want.sum(axis=0)[None, :]))
    assert np.allclose(quality.word_vectors(df), want, atol=1e-6)


def plain_features(text, vectors):
    words = [vectors[zlib.crc32(w.encode()) % quality.SLOTS].astype(float) for w in (text or "").lower().split()]
    if not words:
        return np.zeros(quality.WIDTH)
    mean = sum(words) / len(words)
    spread = [math.sqrt(max(0, sum(w[d] ** 2 for w in words) / len(words) - mean[d] ** 2)) for d in range(quality.DIM)]
    beside = sum((a * b for a, b in zip(words, words[1:], strict=False)), np.zeros(quality.DIM)) / max(1, len(words) - 1)
    return np.array([*mean, *spread, *beside, sum(beside)])


def plain_network(x, y, rounds=40):
    """Weights row by row, as a function from features to a score."""
    rng = np.random.default_rng(quality.SEED)
    n = len(y) * 4 // 5
    mean, scale = sum(x) / len(x), np.sqrt(sum((r - sum(x) / len(x)) ** 2 for r in x) / len(x)) + 1e-3
    rows = [(r - mean) / scale for r in x]
    prior = (sum(y) + 1) / (len(y) + 2)
    w1 = rng.normal(0, math.sqrt(2 / quality.WIDTH), (quality.WIDTH, quality.HIDDEN))
    weights = [w1, np.zeros(quality.HIDDEN), rng.normal(0, math.sqrt(2 / quality.HIDDEN), quality.HIDDEN), math.log(prior / (1 - prior))]
    first, second, step = [0.0] * 4, [0.0] * 4, 0
    for _ in range(rounds):
        order = rng.permutation(n)
        for part in np.array_split(order, max(1, n // 64)):
            step += 1
            slopes = [1e-4 * weights[0], 0.0, 1e-4 * weights[2], 0.0]
            for k in part:
                hidden = np.maximum(rows[k] @ weights[0] + weights[1], 0)
                error = (1 / (1 + math.exp(-(hidden @ weights[2] + weights[3]))) - y[k]) / len(part)
                below = error * weights[2] * (hidden > 0)
                slopes = [a + b for a, b in zip(slopes, (np.outer(rows[k], below), below, error * hidden, error), strict=True)]
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                weights[k] = weights[k] - 0.003 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def logit(r):
        return float(np.maximum((r - mean) / scale @ weights[0] + weights[1], 0) @ weights[2] + weights[3])

    def loss(t):
        return sum(math.log1p(math.exp(-(1 if y[k] else -1) * logit(x[k]) / t)) for k in range(n, len(y)))

    heat = min(np.geomspace(0.5, 8, 41), key=loss)
    return lambda r: 1 / (1 + math.exp(-logit(r) / heat))


def test_scores_are_those_of_a_plain_network(spark):
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice(["good", "fine", "plain", "text"] if k % 2 else ["spam", "buy", "text", "now"]) + str(rng.randrange(4)) for _ in range(rng.randrange(1, 30)))) for k in range(120)]
    texts += [(200, ""), (201, None), (202, "x" * 50_000), (203, "word " * 40_000)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    vectors = quality.word_vectors(docs.select("text"))
    own = {k: plain_features(t, vectors).astype(np.float32).astype(float) for k, t in texts}
    fit = sorted((k for k in range(120) if not held_out(k, 3)), key=lambda k: zlib.crc32(f"order {k}".encode()))
    score = plain_network([own[k] for k in fit], [k % 2 for k in fit])
    found = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert found.keys() == own.keys() and all(abs(found[k] - score(plain_features(t, vectors))) < 1e-3 for k, t in texts)


# ---- language model ----


def plain_tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def plain_model(rows):
    """log10 of the probability of any text, by a model that reads byte after byte; rows: (text, held out)."""
    orders, n_orders = lm_score.ORDERS, len(lm_score.ORDERS)
    made = [(lm_score.model_text((t or "").encode()), out) for t, out in rows]
    counts = {}
    weights = np.full((8, lm_score.GATES, n_orders), 0.3)
    refined = np.zeros((2, 8, lm_score.GATES, lm_score.STEPS))

    def predicted(text):
        """Bit's place, bit, log odds, gate, and the counts' keys."""
        data = lm_score.PAD + text
        for i in range(len(lm_score.PAD), len(data)):
            bits = f"{data[i]:08b}"
            for k in range(8):
                x, gate, keys = [], 0, [(data[i - o : i], bits[:k]) for o in orders]
                for o, key in enumerate(keys):
                    zeros, ones = counts.get(key, (0, 0))
                    x.append(math.log((ones + 0.4) / (zeros + 0.4)))
                    if zeros + ones:
                        gate = 1 + 2 * o + (zeros + ones >= lm_score.MANY)
                yield k, int(bits[k]), np.array(x), gate, keys

    def cell(z):
        return int(np.rint((z + 12) * (lm_score.STEPS - 1) / 24))

    for k in range(lm_score.SLICES):
        own = [t for t, out in made if lm_score.class_of(t, out) == k]
        gradient, second, seen = np.zeros_like(weights), np.zeros((*weights.shape, n_orders)), np.zeros_like(refined)
        for text in own if k else []:
            for bit, one, x, gate, _ in predicted(text):
                z = np.clip(weights[bit, gate] @ x, -12, 12)
                p = 1 / (1 + math.exp(-z))
                gradient[bit, gate] += (one - p) * x
                second[bit, gate] += p * (1 - p) * np.outer(x, x)
                seen[:, bit, gate, cell(z)] += 1, one
        for bit in range(8):
            for gate in range(lm_score.GATES):
                weights[bit, gate] += np.clip(np.linalg.solve(second[bit, gate] + lm_score.RIDGE * np.eye(n_orders), gradient[bit, gate]), -0.5, 0.5)
        refined += seen
        for text in own:
            for _, one, _, _, keys in list(predicted(text)):
                for key in keys:
                    zeros, ones = counts.get(key, (0, 0))
                    counts[key] = zeros + 1 - one, ones + one

    def score(text):
        total = byte = 0.0
        for bit, one, x, gate, _ in predicted(lm_score.model_text((text or "").encode())):
            z = np.clip(weights[bit, gate] @ x, -12, 12)
            centre = 1 / (1 + math.exp(12 - 24 * cell(z) / (lm_score.STEPS - 1)))
            ones, n = refined[1, bit, gate, cell(z)], refined[0, bit, gate, cell(z)]
            p = (1 / (1 + math.exp(-z)) + (ones + lm_score.PRIOR * centre) / (n + lm_score.PRIOR)) / 2
            byte += math.log10(p if one else 1 - p)
            if bit == 7:
                total, byte = total + float(np.float32(byte)), 0.0
        return total

    return score


SHORT = [(i, t) for i, t in TEXTS if len(t or "") < 1_000]


def test_language_model(spark):
    found = lm_score.lm_scores(documents(spark, SHORT), bucket_bytes=500).collect()
    counts = Counter(w for i, t in SHORT if not held_out(i, 5) for w in plain_tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts, plain = dict(SHORT), plain_model([(t, held_out(i, 5)) for i, t in SHORT])
    assert len(found) == len(SHORT)
    for r in found:
        words = plain_tokens(texts[r.doc_id])
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(counts[w] > 0 for w in words), n, held_out(r.doc_id, 5))
        assert r.score == pytest.approx(plain(texts[r.doc_id]), rel=1e-9)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / len(lm_score.model_text((texts[r.doc_id] or "").encode())))
    assert lm_score.lm_scores(documents(spark, [])).count() == 0


def by_row(df):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in df.collect())


def test_scores_do_not_depend_on_the_split(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(documents(spark).select("doc_id", "text"))
    want = by_row(lm_score.lm_scores(docs.repartition(1)))
    for partitions in (3, 8):
        found = by_row(lm_score.lm_scores(docs.repartition(partitions), bucket_bytes=60_000))
        assert [x[:3] for x in found] == [x[:3] for x in want]
        assert np.allclose([x[3:] for x in found], [x[3:] for x in want], rtol=1e-9, atol=0)


def test_without_training_documents(spark):
    out = [k for k in range(60) if held_out(k, 5)][:3]
    texts = [(k, "ab cd" * k) for k in out]
    for r in lm_score.lm_scores(documents(spark, texts)).collect():
        assert r.score == pytest.approx(-8 * math.log10(2) * len(lm_score.model_text(dict(texts)[r.doc_id].encode())))
        assert (r.train_tokens, r.n_known) == (0, 0)


def trained(texts, known=lm_score.SLICES):
    """Model and the counted sequences of some training texts, without Spark."""
    held, n = [], []
    for text in map(lm_score.model_text, texts):
        own = lm_score.grams([text])
        held.append(own)
        n.append(np.eye(lm_score.SLICES)[np.full(len(own), lm_score.class_of(text, False))])
    keys, back = np.unique(np.concatenate(held), return_inverse=True)
    counts = np.array([np.bincount(back, c, len(keys)) for c in np.concatenate(n).T]).astype(np.int64)
    short = keys & np.uint64(0xFFFFFF)
    order = np.argsort(short, kind="stable")

    def below(k):
        own = lm_score.runs(short[order], counts[:k].sum(axis=0)[order])
        return own[0][own[1] > 0], own[1][own[1] > 0]

    model = lm_score.Model()
    for k in range(1, lm_score.SLICES):
        model.moved(model.errors(lm_score.Sequences(keys, counts[:k].sum(axis=0), below(k)), counts[k].astype(float)))
    return model, keys, counts.sum(axis=0), below(lm_score.SLICES)


def asked_of(trained_model, more):
    """log10 of each of some sequences under a trained model."""
    model, keys, counts, short = trained_model
    whole, back = np.unique(np.r_[keys, more], return_inverse=True)
    return model.log10(lm_score.Sequences(whole, np.bincount(back[: len(keys)], counts, len(whole)).astype(np.int64), short))[back[len(keys) :]]


def test_model_is_a_distribution_over_the_next_byte():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "abc", "bca", "é", "xyz"]) for _ in range(60)).encode() for _ in range(30)]
    model = trained(texts)
    for context in (0, 0x62632061, 0x61626361, 0xFFFFFFFF):
        keys = np.array([context << 8 | b for b in range(256)], np.uint64)
        assert (10 ** asked_of(model, keys)).sum() == pytest.approx(1, abs=1e-6)
    seen, odd = (asked_of(model, lm_score.grams([lm_score.model_text(t)])).mean() for t in (texts[0], b"qqq zzz www kkk"))
    assert seen > odd


def test_cut_texts_score_like_whole_ones(monkeypatch):
    texts = [lm_score.model_text(b" ".join(b"word%d" % (k % 50) for k in range(400))), b"x\n"]
    keys = np.unique(lm_score.grams(texts))
    values = -np.sqrt(np.arange(1.0, len(keys) + 1))
    whole = lm_score.piecewise(enumerate(texts), 2, keys, values)
    want = [values[np.searchsorted(keys, lm_score.grams([t]))].sum() for t in texts]
    assert np.allclose(whole, want, rtol=1e-12)
    monkeypatch.setattr(lm_score, "PIECE", 100)
    assert np.allclose(lm_score.piecewise(enumerate(texts), 2, keys, values), want, rtol=1e-12)


def test_learning_lowers_the_cost():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(200)).encode() for _ in range(40)]
    probe = lm_score.grams([lm_score.model_text(b"the cat sat on a mat on the mat")])
    assert asked_of(trained(texts), probe).sum() > asked_of(trained(texts[:2]), probe).sum()
    moved, keys, counts, short = trained(texts)
    assert asked_of((moved, keys, counts, short), probe).sum() > asked_of((lm_score.Model(), keys, counts, short), probe).sum()


# ---- token counts ----


def plain_count(model, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[b][0] + model.scores[word[b:end]], -best[b][1] - 1) for b in range(end) if word[b:end] in model.scores]
        n = len(word[end - 1].encode())
        if word[end - 1] not in model.scores:
            options.append((best[end - 1][0] + n * model.byte_score, -best[end - 1][1] - n))
        score, count = max(options)
        best.append((score, -count))
    return best[-1][1]


def test_token_counts(spark):
    model = token_count.load_model()
    found = by_id(token_count.token_counts(documents(spark)))
    for i, text in TEXTS:
        words = [token_count.MARK + w.decode() for w in (text or "").encode().split()]
        own = {w: plain_count(model, w) for w in set(words)}
        assert (found[i].n_tokens, found[i].n_pretokens, found[i].n_bytes) == (sum(own[w] for w in words), len(words), len((text or "").encode()))
    assert token_count.token_counts(documents(spark, [])).count() == 0


def test_trie_shares_prefixes_and_starts_anew(monkeypatch):
    model = token_count.UnigramModel(["a", "b", "ab", "aba", "c"])
    words = ["aba", "abab", "abc", "aé", "", "ababab"]
    want = [plain_count(model, w) for w in words]
    trie = token_count.Trie(model, words)
    assert trie.counts == want and trie.nodes == 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})
    monkeypatch.setattr(token_count, "MOST_CHARS", 1)
    monkeypatch.setattr(token_count, "ROWS", 2)
    counter = token_count.Counter(model)
    for part in (words, words[:2], words):
        counter.meet(set(part))
        assert [counter.known[w] for w in part] == [plain_count(model, w) for w in part]


@pytest.mark.parametrize("seed", range(20))
def test_trie_of_random_words(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(token_count, "DEPTH", rng.choice([1, 3, 8, 48]))
    letters = "abé𝔘\0"
    model = token_count.UnigramModel(["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(30)])
    words = list({"".join(rng.choice(letters + "x") for _ in range(rng.randrange(0, 70))) for _ in range(60)})
    assert token_count.Trie(model, words).counts == [plain_count(model, w) for w in words]


def test_one_very_long_word_and_sliced_texts(spark, monkeypatch):
    import tracemalloc

    model = token_count.load_model()
    word = token_count.MARK + "internationalisation" * 5_000
    assert token_count.Trie(model, [word[:3_000]]).counts == [plain_count(model, word[:3_000])]
    tracemalloc.start()
    token_count.Trie(model, [word])
    assert tracemalloc.get_traced_memory()[1] < 20 * len(word)
    tracemalloc.stop()
    whole = by_id(token_count.token_counts(documents(spark)))
    texts = [(t or "").encode() for _, t in TEXTS]
    monkeypatch.setattr(token_count, "SLICE", 1_000)
    counter, found = token_count.Counter(model), [0] * len(texts)
    for group in token_count.slices(texts):
        for number, text in group:
            own = token_count.pre_tokens(text)
            counter.meet(set(own))
            found[number] += counter.total(own)
    assert found == [whole[i].n_tokens for i, _ in TEXTS]


def test_trie_agrees_with_a_public_unigram_model():
    from tokenizers import Tokenizer, models

    model = token_count.load_model()
    other = Tokenizer(models.Unigram([("<unk>", -1e9), *model.scores.items()], 0, False))
    words = "▁hello ▁thntblere ▁counterrevolutionary ▁Straße ▁naïve ▁internationalisation ▁x".split()
    for word, n in zip(words, token_count.Trie(model, words).counts, strict=True):
        # Equal up to ties, which both break in their own way.
        own = other.encode(word).tokens
        assert n == len(own) or sum(model.scores[t] for t in own) == pytest.approx(plain_score(model, word), abs=1e-9)


def plain_score(model, word):
    best = [0.0]
    for end in range(1, len(word) + 1):
        best.append(max(best[b] + model.scores[word[b:end]] for b in range(end) if word[b:end] in model.scores))
    return best[-1]


# ---- decontamination ----


def plain_tiles(doc, item, least):
    """Greedy string tiling by comparing all places."""
    used_d, used_t, out = set(), set(), []
    while True:
        longest, found = least, []
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in used_d and b + n not in used_t:
                    n += 1
                if n > longest:
                    longest, found = n, []
                if n == longest:
                    found.append((a, b))
        if not found:
            return sorted(out)
        for a, b in sorted(found):
            if not used_d & set(range(a, a + longest)) and not used_t & set(range(b, b + longest)):
                used_d |= set(range(a, a + longest))
                used_t |= set(range(b, b + longest))
                out.append((a, b, longest))


@pytest.mark.parametrize("seed", range(60))
def test_tiling(seed):
    rng = random.Random(seed)
    item = [rng.choice("abcdefgh").encode() for _ in range(rng.randrange(2, 40))]
    doc = [rng.choice("abcdefghxy").encode() for _ in range(20)]
    for _ in range(3):
        a = rng.randrange(len(item))
        doc += item[a : a + rng.randrange(1, 20)] + [b"x"]
    block = decontaminate.Block([(7, item), (8, [])], 4)
    found = dict(block.matches(doc))
    want = plain_tiles(doc, item, min(4, len(item)))
    covered = sum(n for *_, n in want)
    assert sum(n for *_, n in found.get(0, [])) == covered
    assert found.get(0, []) == want or [n for *_, n in sorted(found[0], key=lambda t: -t[2])] == [n for *_, n in sorted(want, key=lambda t: -t[2])]


@pytest.mark.parametrize("seed", range(60))
def test_tiling_by_length_gives_the_same(seed, monkeypatch):
    rng = random.Random(seed)
    item = [rng.choice("ab" if seed % 2 else "abcd").encode() for _ in range(rng.randrange(2, 30))]
    doc = [rng.choice("abcx" if seed % 2 else "abcdx").encode() for _ in range(30)]
    for _ in range(2):
        a = rng.randrange(len(item))
        doc += item[a : a + rng.randrange(1, 20)] + [b"x"]
    block = decontaminate.Block([(7, item)], 4)
    want = list(block.matches(doc))
    monkeypatch.setattr(decontaminate, "MOST_PAIRS", 0)
    assert list(block.matches(doc)) == want


def test_repeating_texts_take_little_memory():
    import tracemalloc

    block = decontaminate.Block([(7, [b"a"] * 200)], 5)
    tracemalloc.start()
    found = list(block.matches([b"a"] * 100_000))
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert found == [(0, [(0, 0, 200)])]


def test_contaminated(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards brew strong potions quietly tonight"
    words = passage.split()
    texts = [
        (1, f"Before. {passage.upper()}! After."),
        (2, " ".join(words[8:]) + " and then " + " ".join(words[:8])),
        (3, "the quick brown fox jumps and nothing more"),
        (4, "tiny item stands here"),
        (5, None),
        (6, ""),
        (1, f"Before. {passage.upper()}! After."),
        (None, passage),
    ]
    benchmark = spark.createDataFrame([(10, passage), (11, "tiny item"), (12, None), (13, "..."), (10, passage)], "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 3):
        rows = decontaminate.contaminated(documents(spark, texts), benchmark, block_words=block).collect()
        assert Counter((r.doc_id, r.item_id) for r in rows) == {(1, 10): 4, (2, 10): 2, (None, 10): 2, (4, 11): 1}
        assert {r.tiles for r in rows if r.doc_id == 2} == {"0:8:9,11:0:8"}
    assert decontaminate.contaminated(documents(spark, []), benchmark).count() == 0
    assert decontaminate.contaminated(documents(spark, texts), benchmark.where("false")).count() == 0


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 60])
def test_the_search_finds_all_that_tiling_every_pair_finds(spark, block_words):
    rng = random.Random(block_words)
    items = [(k, [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))]) for k in range(25)]
    texts = []
    for k in range(60):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(20))]
        for _ in range(rng.randrange(4)):
            own = rng.choice(items)[1]
            a = rng.randrange(len(own))
            words += own[a : a + rng.randrange(1, 25)] + own[:a][: rng.randrange(10)]
        texts.append((k, words))
    texts += [(60, ["long" * 20_000]), (61, ["w1"] * 3000), (62, [w for _, own in items for w in own] * 10)]
    want = {}
    for i, doc in texts[:60]:
        for j, item in items:
            covered = sum(n for *_, n in plain_tiles(doc, item, min(5, len(item))))
            if covered >= 0.6 * len(item):
                want[i, j] = len(item), covered
    benchmark = spark.createDataFrame([(j, " ".join(item)) for j, item in items], "item_id long, text string")
    rows = decontaminate.contaminated(documents(spark, [(i, " ".join(doc)) for i, doc in texts]), benchmark, block_words=block_words).collect()
    found = {(r.doc_id, r.item_id): (r.item_words, r.covered_words) for r in rows}
    assert len(found) == len(rows) and {k: v for k, v in found.items() if k[0] < 60} == want and len(want) > 20
    # Endless repeats and one unbroken word find what they hold; a text of all items has each whole.
    assert not [k for k in found if k[0] == 60] and {j for i, j in found if i == 62} == {j for j, _ in items}
    assert {j for i, j in found if i == 61} == {j for j, item in items if set(item) == {"w1"}}


# ---- mixing ----


def test_mixing(spark):
    docs = documents(spark, [(i, f"t{i}", ) for i in range(400)])
    out = mixing.mixed(docs).collect()
    counts = Counter(r.doc_id for r in out)
    per_source = {r.source: r.n for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for r in docs.collect():
        rate = 400 / len(per_source) / per_source[r.source]
        u = int(__import__("hashlib").md5(f"{r.doc_id}:42".encode()).hexdigest()[:13], 16) / 16**13
        k, mass = 0, math.exp(-rate)
        below = mass
        while u >= below:
            k += 1
            mass *= rate / k
            below += mass
        assert counts[r.doc_id] == k
    assert all(sorted(r.copy_no for r in out if r.doc_id == i) == list(range(1, n + 1)) for i, n in list(counts.items())[:20])
    assert mixing.mixed(docs).columns == [c for c in docs.columns if c != "copy_no"] + ["copy_no"]
    weighed = mixing.mixed(docs, {"src0": 3.0, "src1": 1.0}).groupBy("source").count().collect()
    found = {r["source"]: r["count"] for r in weighed}
    assert None not in found and 240 < found["src0"] < 360 and 60 < found["src1"] < 140
    assert mixing.mixed(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark)).count() > 0


@pytest.mark.parametrize("rate", [0.5, 10.0, 150.0, 400.0, 700.0, 750.0, 1_000.0, 2_000.0, 100_000.0, 250_000.0])
def test_large_rates_are_drawn(spark, rate):
    n = 200
    us = [(k + 0.5) / n for k in range(n)]
    rows = spark.createDataFrame([(u, rate, math.ceil(rate + 12 * math.sqrt(rate) + 30)) for u in us], "u double, rate double, most int")
    found = {r.u: r.k for r in rows.select("u", mixing.poisson_quantile(F.col("u"), F.col("rate"), F.col("most")).alias("k")).collect()}
    below, k, want = 0.0, 0, {}
    for u in us:
        while u >= below:
            below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            k += 1
        want[u] = k - 1
    assert found == want
    assert sum(found.values()) / n == pytest.approx(rate, rel=0.02 if rate > 100 else 0.1, abs=0.02)


def test_copies_of_rows_without_an_id_are_spread(spark):
    docs = documents(spark, [(None, f"text {k}") for k in range(400)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = mixing.mixed(docs, {"src0": 1.0, None: 1.0}, epochs=4.0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)


def test_mixing_runs_no_python(spark):
    plan = mixing.mixed(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- pipeline ----


def test_pipeline_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "source mixing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        kept = spark.createDataFrame(after.collect(), docs.schema)
    assert 0.5 * docs.count() < kept.count() < docs.count()
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_rows_of_one_id_are_judged_each_by_its_own_text(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    texts = [(None, item), (None, "clean text of its own"), (1, item), (1, "another clean text"), (2, "x")]
    out = corpus_pipeline.decontamination_stage(spark, documents(spark, texts), sf)
    assert sorted(r.text for r in out.collect()) == ["another clean text", "clean text of its own", "x"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    own = {r.text: r.predicted for r in quality.quality_scores(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect()}
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    kept = quality.accepted(docs, labels).count()
    assert kept == sum(own[r.text] for r in docs.collect())
    assert 0 < quality.accepted(nameless, labels).where("doc_id is null").count() < nameless.where("doc_id is null").count()


def test_pipeline_stages_bear_odd_rows(spark, sf):
    for docs in (documents(spark), documents(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert set(docs.columns) <= set(out.columns), name
            n = out.count()
            assert n <= docs.count() or name == "source mixing"


def test_folds(spark):
    rows = spark.range(50).select("id", fold_of(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_mixing_is_the_same_with_any_number_of_sources(spark, monkeypatch):
    docs = documents(spark, [(i, f"t{i}") for i in range(100)])
    few = sorted((r.doc_id, r.copy_no) for r in mixing.mixed(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.copy_no) for r in mixing.mixed(docs).collect()) == few


@pytest.mark.parametrize("n", [32_000, 64_000, 256_000])
def test_vocabularies_of_any_size(n):
    pieces = [f"{token_count.MARK}{k:x}" if k % 2 else f"{k:x}z" for k in range(n)]
    model = token_count.UnigramModel(pieces)
    asked = [pieces[k] for k in range(0, n, max(1, n // 3000))]
    hashes = np.array([token_count.text_hash(p) for p in [*asked, "no piece", "zz"]], np.uint64)
    assert model.found(hashes).tolist() == [*(model.scores[p] for p in asked), -np.inf, -np.inf]
    assert sum(len(x) for _, _, x, _ in model.tables) < 20 * n + 2000


def test_language_model_with_few_tasks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    many = {r.doc_id: r for r in lm_score.lm_scores(docs, bucket_bytes=20_000).collect()}
    few = {r.doc_id: r for r in lm_score.lm_scores(docs, bucket_bytes=20_000, most_tasks=2).collect()}
    assert many.keys() == few.keys() and all(few[i].score == pytest.approx(r.score, rel=1e-9) and few[i].base_score == pytest.approx(r.base_score, rel=1e-9) for i, r in many.items())
