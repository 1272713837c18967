"""Packing against the whole tokenizer and a plain first-fit."""

import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import packing

from .fixtures import TEXTS, documents


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


ODD = [
    "it's we'll THEY'RE don't 'd a's'b x'veto 12 345 a1b2",
    "ÉCOLE Straße naïve Ünder ßß «été» œuvre ŒUVRE",
    "Привет, МИР! ёжик Ёлка мой Й",
    "école å 가 ΟΔΟΣ ΑΣ Σ ﬁ ǅ İstanbul ıI",
    "　full width space\u0085next ​ zero",
    "<|endoftext|> and x<|startoftext|>y <|endoftext|",
    "\x00\x01 \x1c\x1f a\x1cb \x7f tab\tnew\nline\r\n",
    "漢字かな交じり文 🙂🙃 👩‍👩‍👧 हिन्दी العربية",
    "!!! ??? ... a.b,c;d -- __x__ \\n",
    "", " ", "'",
]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    own = packing.Encoder(packing.vocabulary_path())
    for got, text in zip(own.encode([t.encode() for t in ODD]), ODD, strict=True):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAbs'tl é ÉйЙ1.\t́ ")), max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    from tokenizers import Tokenizer

    own, plain = packing.encoder(packing.vocabulary_path()), _PLAIN.setdefault(0, Tokenizer.from_file(packing.vocabulary_path()))
    for got, text in zip(own.encode([t.encode() for t in texts]), texts, strict=True):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids


_PLAIN = {}


def test_a_long_text_is_cut_at_white_space(tokenizer):
    own, text = packing.encoder(packing.vocabulary_path()), ("wörd Ïx end's\t42 " * 900 + "x" * 3000 + " й " * 50).encode()
    parts = [t for part in packing.slices([b"a", text, b""], 500) for n, t, _ in part if n == 1]
    assert len(parts) > 5 and b"".join(parts) == text
    assert np.concatenate(own.encode(parts)).tolist() == tokenizer.encode(text.decode(), add_special_tokens=False).ids


def test_a_worker_forgets_words_without_harm(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 3)
    own = packing.Encoder(packing.vocabulary_path())
    for _ in range(3):
        for got, text in zip(own.encode([t.encode() for t in ODD]), ODD, strict=True):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.place) < 100


def plain_first_fit(sizes, capacity):
    bins, left = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        for b in range(len(bins)):
            if left[b] >= sizes[k]:
                bins[b].append(k)
                left[b] -= sizes[k]
                break
        else:
            bins.append([k])
            left.append(capacity - sizes[k])
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_first_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([3, 30, 64])) for _ in range(rng.randint(0, 200))]
    assert packing.first_fit_decreasing(sizes, 64) == plain_first_fit(sizes, 64)


@pytest.mark.parametrize("seed", range(60))
def test_sequences_are_full_or_a_power_of_two(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([3, 30, 63])) for _ in range(rng.randint(0, 60))]
    seen = [set() for _ in sizes]
    short = 0
    for own in packing.packed(sizes, 64):
        n = sum(length for _, _, length in own)
        assert n == 64 or n & (n - 1) == 0
        short += n < 64
        for k, start, length in own:
            places = set(range(start, start + length))
            assert length > 0 and not places & seen[k]
            seen[k] |= places
    assert [len(s) for s in seen] == sizes and all(s == set(range(n)) for s, n in zip(seen, sizes, strict=True))
    assert short <= 6


def held(rows, texts, tokenizer, capacity):
    """Checks the contract and returns the padding."""
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in texts]
    expected = sorted(((-1 if i is None else i), len(x)) for (i, _), x in zip(texts, ids, strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    known = defaultdict(list)
    for (i, _), x in zip(texts, ids, strict=True):
        known[i].append(x)
    for r in rows:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in known[r.doc_id])
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for (i, n), own in by_doc.items():
        copies = expected.count(((-1 if i is None else i), n))
        covered = np.zeros(n, int)
        for r in own:
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies).all()
    assert sum(r.length for r in rows) == sum(map(len, ids))
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("group_bytes", [packing.GROUP_BYTES, 2000])
def test_documents(spark, tokenizer, group_bytes):
    docs = documents(spark).withColumn("length", docs_length()).withColumn("group", docs_length())
    rows = packing.pack(docs, group_bytes=group_bytes).collect()
    assert held(rows, TEXTS, tokenizer, 4096) == 0
    assert packing.pack(documents(spark, [])).count() == 0


def docs_length():
    from pyspark.sql import functions as F

    return F.lit("x")


def test_equal_rows_without_id_spread_over_groups(spark, tokenizer):
    texts = [(None, "the same text of a few words")] * 3000 + [(5, "one more")]
    rows = packing.pack(documents(spark, texts), group_bytes=4000).collect()
    assert held(rows, texts, tokenizer, 4096) == 0
    groups = {r.sequence_id >> packing.GROUP_BITS for r in rows}
    assert len(groups) > 15


def test_long_words_and_small_sequences(spark, tokenizer):
    texts = [(1, "x" * 50_000), (2, "ab " * 20_000), (3, "é" * 3000), (4, "'s" * 500), (5, None)]
    assert held(packing.pack(documents(spark, texts), size=64).collect(), texts, tokenizer, 64) == 0


def test_tokenizer_folder_is_found(monkeypatch):
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert packing.vocabulary_path().endswith("word_bpe_49k.json")
