"""Token counts under a unigram model, computed over a trie of distinct pre-tokens.

Pieces and their order come from a public SentencePiece vocabulary file (a parameter);
nothing is trained. A piece at place r of the file's order has the probability
proportional to 1 / (r + 1). A pre-token is a run of characters other than ASCII white
space, led by the word mark. Its segmentation is the most probable one (of equals, that of
fewer tokens); a character that no piece covers falls back to its UTF-8 bytes, one token each.

Distinct pre-tokens are sorted and inserted in a trie, which is laid out by depth: a row
opens new nodes below the prefix it shares with the row before. The forward score of a node,
the best log-probability of the characters up to it, depends on these alone, so it is
computed once for all pre-tokens that share the prefix, all nodes of a depth at a time;
the node that ends a pre-token holds its token count. Beyond ``DEPTH`` characters, where
prefixes are hardly shared, a pre-token goes on from its node with the scores of the last
few characters alone, so that one long word takes no more memory than its characters. A
document's count is the sum over its pre-tokens. Each task keeps the counts of the words it
has met, begun anew at a bound of characters (a matter of memory, not of results), so
nothing is shuffled.

Defined results: null and empty texts have no tokens; a very long text is read in slices that end at
white space; repeated rows repeat their result; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
DEPTH = 48
#: Words of a trie, bytes of text that are looked at together, and characters of known words that a task holds.
ROWS = 1 << 15
SLICE = 4 << 20
MOST_CHARS = 6 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = [np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)]
_SPACE = re.compile(rb"\s")


def mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * _SPREAD[1]
    return x ^ (x >> np.uint64(31))


def text_hash(piece: str) -> int:
    """Polynomial in the characters, modulo 2**64."""
    h = 0
    for x in mixed(np.array([ord(c) for c in piece], np.uint64)).tolist():
        h = (h * int(BASE) + x) & 0xFFFFFFFFFFFFFFFF
    return h


class UnigramModel:
    def __init__(self, pieces: list[str]):
        norm = log(sum(1 / (r + 1) for r in range(len(pieces))))
        self.scores = {p: -log(r + 1) - norm for r, p in reversed(list(enumerate(pieces)))}
        self.longest = max(map(len, pieces), default=1)
        #: Of a byte that stands for itself: less probable than any piece.
        self.byte_score = min(self.scores.values(), default=0.0) - 10.0
        self.lengths = sorted({len(p) for p in self.scores if p})
        # Tables of slots by hash; pieces whose slot is taken go to the next table, as many as it takes.
        self.tables = []
        hashes = np.fromiter(map(text_hash, self.scores), np.uint64, len(self.scores))
        scores = np.fromiter(self.scores.values(), float, len(self.scores))
        while len(hashes):
            bits = max(8, (8 * len(hashes)).bit_length())
            spread = _SPREAD[len(self.tables) % 2] + np.uint64(2 * len(self.tables))
            at = (hashes * spread) >> np.uint64(64 - bits)
            first = np.unique(at, return_index=True)[1]
            slots, found = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -np.inf)
            slots[at[first]], found[at[first]] = hashes[first], scores[first]
            self.tables.append((spread, np.uint64(64 - bits), slots, found))
            left = np.ones(len(hashes), bool)
            left[first] = False
            # Of pieces that share a hash the likeliest, which comes first, is found.
            left &= slots[at] != hashes
            hashes, scores = hashes[left], scores[left]

    def found(self, h: np.ndarray) -> np.ndarray:
        """Score of the piece of each hash; minus infinity where there is none."""
        out = np.full(len(h), -np.inf)
        for spread, shift, hashes, scores in self.tables:
            at = (h * spread) >> shift
            np.maximum(out, np.where(hashes[at] == h, scores[at], -np.inf), out=out)
        return out


def load_model(path: str = VOCABULARY) -> UnigramModel:
    """Read on the driver and broadcast: a vocabulary has a fixed size."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(vocabulary.get_piece_size()) if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i))]
    return UnigramModel([vocabulary.id_to_piece(i) for i in own])


class Trie:
    """Trie of some distinct words, level by level; ``counts`` has the tokens of each word, in the order given."""

    def __init__(self, model: UnigramModel, words: list[str]):
        self.model = model
        self.nodes = 1
        order = sorted(range(len(words)), key=words.__getitem__)
        size = np.array([min(len(words[k]), DEPTH) for k in order])
        width = int(size.max(initial=0))
        codes = np.array([words[k][:DEPTH].ljust(width, "\0") for k in order], f"U{max(width, 1)}").view(np.uint32).reshape(len(words), -1)
        shared = np.zeros(len(words), np.int64)
        if len(words) > 1:
            differ = codes[1:] != codes[:-1]
            shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
        # By depth: prefix hash, forward score and tokens of each row's node.
        hashes, scores, tokens = [np.zeros(len(words), np.uint64)], [np.zeros(len(words))], [np.zeros(len(words), np.int64)]
        for depth in range(1, width + 1):
            h, s, t = np.zeros(len(words), np.uint64), np.zeros(len(words)), np.zeros(len(words), np.int64)
            new = np.flatnonzero((shared < depth) & (size >= depth))
            self.nodes += len(new)
            h[new] = hashes[-1][new] * BASE + mixed(codes[new, depth - 1])
            s[new], t[new] = self._forward(depth, new, codes[new, depth - 1], h[new], hashes, scores, tokens)
            # Rows that share the node have it from the row that opened it.
            opened = np.zeros(len(words), np.int64)
            opened[new] = new
            opened = np.maximum.accumulate(opened)
            hashes.append(h[opened])
            scores.append(s[opened])
            tokens.append(t[opened])
        self.counts = [0] * len(words)
        for row, k in enumerate(order):
            if len(words[k]) <= DEPTH:
                self.counts[k] = int(tokens[size[row]][row])
            else:
                low = max(0, DEPTH - model.longest)
                self.counts[k] = self._onward(words[k], [(float(scores[d][row]), int(tokens[d][row])) for d in range(low, DEPTH + 1)])

    def _forward(self, depth, rows, last, own, hashes, scores, tokens):
        """Forward score and tokens of new nodes of one depth: the best piece that ends there."""
        model = self.model
        best, n = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
        for length in model.lengths:
            if length > depth:
                break
            power = np.uint64(pow(int(BASE), length, 1 << 64))
            piece = model.found(own - hashes[depth - length][rows] * power)
            if length == 1:
                bare = piece == -np.inf
            hit = np.flatnonzero(piece > -np.inf)
            at = rows[hit]
            score, count = piece[hit] + scores[depth - length][at], tokens[depth - length][at] + 1
            better = (score > best[hit]) | ((score == best[hit]) & (count < n[hit]))
            best[hit[better]], n[hit[better]] = score[better], count[better]
        if 1 not in model.lengths:
            bare = np.ones(len(rows), bool)
        size = 1 + (last >= 0x80) + (last >= 0x800) + (last >= 0x10000)
        score = np.where(bare, scores[depth - 1][rows] + size * model.byte_score, -np.inf)
        better = score > best
        return np.where(better, score, best), np.where(better, tokens[depth - 1][rows] + size, n)

    def _onward(self, word: str, last: list[tuple[float, int]]) -> int:
        """Tokens of a word whose first DEPTH characters have been scored; ``last`` has the scores up to there."""
        scores, longest = self.model.scores, self.model.longest
        for end in range(DEPTH + 1, len(word) + 1):
            best, tokens = -np.inf, 0
            for length in range(min(longest, len(last)), 0, -1):
                score = scores.get(word[end - length : end])
                if score is not None:
                    before = last[-length]
                    score += before[0]
                    if score > best or (score == best and before[1] + 1 < tokens):
                        best, tokens = score, before[1] + 1
            if word[end - 1] not in scores:
                n = len(word[end - 1].encode("utf-8", "replace"))
                if last[-1][0] + n * self.model.byte_score > best:
                    best, tokens = last[-1][0] + n * self.model.byte_score, last[-1][1] + n
            last.append((best, tokens))
            if len(last) > longest:
                del last[0]
        return last[-1][1]


class Counter:
    """Token counts of the words that a task has met."""

    def __init__(self, model: UnigramModel):
        self.model = model
        self.known: dict[str, int] = {}
        self.chars = 0

    def meet(self, words: set[str]) -> None:
        if self.chars > MOST_CHARS:
            self.known, self.chars = {}, 0
        new = sorted(words - self.known.keys())
        for low in range(0, len(new), ROWS):
            part = new[low : low + ROWS]
            self.known.update(zip(part, Trie(self.model, part).counts, strict=True))
        self.chars += sum(map(len, new))

    def total(self, words: list[str]) -> int:
        return sum(map(self.known.__getitem__, words))


def pre_tokens(text: bytes) -> list[str]:
    """bytes.split parts at ASCII white space alone; str.split would part at other spaces too."""
    return [MARK + w for w in b"\n".join(text.split()).decode("utf-8", "replace").split("\n") if w]


def slices(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Numbers and texts in groups of about SLICE bytes; a longer text is cut at white space."""
    held, n = [], 0
    for number, text in enumerate(texts):
        low = 0
        while low < len(text):
            cut = _SPACE.search(text, low + SLICE) if len(text) - low > SLICE else None
            high = cut.start() if cut else len(text)
            held.append((number, text[low:high]))
            n += high - low
            low = high
            if n >= SLICE:
                yield held
                held, n = [], 0
    if held:
        yield held


def token_counts(docs: DataFrame, model_path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_pretokens, n_bytes`` for each row."""
    spark: SparkSession = docs.sparkSession
    model = spark.sparkContext.broadcast(load_model(model_path))
    schema = "doc_id long, n_tokens long, n_pretokens long, n_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model.value)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            tokens, words = [0] * len(texts), [0] * len(texts)
            for group in slices(texts):
                own = [(number, pre_tokens(text)) for number, text in group]
                counter.meet(set().union(*(w for _, w in own)))
                for number, w in own:
                    tokens[number] += counter.total(w)
                    words[number] += len(w)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (tokens, words, [len(t) for t in texts])]], ["doc_id", "n_tokens", "n_pretokens", "n_bytes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
