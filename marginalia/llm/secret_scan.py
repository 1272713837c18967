"""Secret scan with one deterministic automaton for all rules.

A rule is a regular expression. A parser turns it into a tree, Thompson's construction into an NFA. The
reversed expressions of all rules are compiled together: made deterministic by subset construction over byte
classes, minimised by partition refinement, and laid out as one flat array of transitions in which the
accepting states come last. A text is read once, byte by byte from its end, for all rules: where the
automaton accepts, a match of the rules that it names begins. Of each rule the first start is taken, the rule's own
automaton, of the same make, runs from there to the match's end, and the search goes on behind it: leftmost,
longest, non-overlapping. Then matches whose last part (behind ``lead``) is shorter than ``least`` are dropped. All this is
linear in the text: each byte is read once backwards, and once more for each rule inside its matches.

Spans are in code points, the end exclusive. Defined results: a null text counts as
empty; a text without secrets has counts of 0, no spans (an empty string) and the digest
of the empty string; a very long text, or word, takes time in proportion to its length; repeated rows repeat their result; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

# ---- expressions: parsed to trees ----

#: A tree is ("set", bytes), ("seq", parts), ("alt", parts) or ("loop", part, least, most or None).
Tree = tuple
SPACE = frozenset(b" \t\n\r\x0b\x0c")
ALL = frozenset(range(256))


class Parser:
    """Literals, escapes, classes, groups, alternatives and the quantifiers ?, *, +, {n}, {n,} and {n,m}."""

    def __init__(self, expression: str, any_case: bool):
        self.rest, self.any_case = list(expression.encode().decode("latin-1")), any_case

    def tree(self) -> Tree:
        found = self.alternatives()
        if self.rest:
            raise ValueError(f"unbalanced at {''.join(self.rest)!r}")
        return found

    def alternatives(self) -> Tree:
        parts = [self.sequence()]
        while self.rest[:1] == ["|"]:
            self.rest.pop(0)
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> Tree:
        parts = []
        while self.rest and self.rest[0] not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("seq", parts)

    def atom(self) -> Tree:
        c = self.rest.pop(0)
        if c == "(":
            if self.rest[:2] == ["?", ":"]:
                del self.rest[:2]
            inner = self.alternatives()
            if self.rest[:1] != [")"]:
                raise ValueError("a group isn't closed")
            self.rest.pop(0)
            return inner
        if c == "[":
            return ("set", self.cased(self.members()))
        return ("set", self.cased(self.escaped() if c == "\\" else frozenset({ord(c)})))

    def escaped(self) -> frozenset[int]:
        c = self.rest.pop(0)
        if c == "x":
            code = "".join(self.rest[:2])
            del self.rest[:2]
            return frozenset({int(code, 16)})
        return SPACE if c == "s" else frozenset({ord(c)})

    def members(self) -> frozenset[int]:
        negated = self.rest[0] == "^"
        if negated:
            self.rest.pop(0)
        found: set[int] = set()
        while (c := self.rest.pop(0)) != "]":
            own = self.escaped() if c == "\\" else frozenset({ord(c)})
            if self.rest[0] == "-" and self.rest[1] != "]":
                self.rest.pop(0)
                own = frozenset(range(min(own), ord(self.rest.pop(0)) + 1))
            found |= own
        return ALL - found if negated else frozenset(found)

    def cased(self, own: frozenset[int]) -> frozenset[int]:
        if not self.any_case:
            return own
        return own | {c ^ 32 for c in own if chr(c).isascii() and chr(c).isalpha()}

    def repeated(self, part: Tree) -> Tree:
        c = self.rest[0] if self.rest else ""
        if c not in "?*+{" or not c:
            return part
        self.rest.pop(0)
        if c != "{":
            return ("loop", part, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        end = self.rest.index("}")
        low, _, high = "".join(self.rest[:end]).partition(",")
        exact = "," not in self.rest[:end]
        del self.rest[: end + 1]
        return ("loop", part, int(low), int(low) if exact else int(high) if high else None)


def reversed_tree(tree: Tree) -> Tree:
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "loop":
        return ("loop", reversed_tree(tree[1]), *tree[2:])
    parts = [reversed_tree(t) for t in tree[1]]
    return (kind, parts[::-1] if kind == "seq" else parts)


# ---- automata ----


class Nfa:
    """States have moves on sets of bytes and jumps on nothing; state 0 is the start."""

    def __init__(self, trees: list[Tree]):
        self.moves: list[list[tuple[frozenset[int], int]]] = [[]]
        self.jumps: list[list[int]] = [[]]
        self.final: dict[int, int] = {}
        for k, tree in enumerate(trees):
            at = self.state()
            self.jumps[0].append(at)
            self.final[self.build(tree, at)] = 1 << k

    def state(self) -> int:
        self.moves.append([])
        self.jumps.append([])
        return len(self.moves) - 1

    def build(self, tree: Tree, at: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[at].append((tree[1], end))
            return end
        if kind == "seq":
            for part in tree[1]:
                at = self.build(part, at)
            # A state of its own, so that what comes next doesn't share it with a loop.
            end = self.state()
            self.jumps[at].append(end)
            return end
        end = self.state()
        if kind == "alt":
            for part in tree[1]:
                own = self.state()
                self.jumps[at].append(own)
                self.jumps[self.build(part, own)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            at = self.build(part, at)
        if most is None:
            loop = self.state()
            self.jumps[at].append(loop)
            self.jumps[loop].append(end)
            self.jumps[self.build(part, loop)].append(loop)
            return end
        self.jumps[at].append(end)
        for _ in range(most - least):
            at = self.build(part, at)
            self.jumps[at].append(end)
        return end


class Automaton(NamedTuple):
    #: moves[state + byte] is the next state; a state is its row's offset.
    moves: list[int]
    start: int
    #: States from here on are accepting.
    accepting: int
    #: Rules of an accepting state, as bits.
    fired: dict[int, int]
    #: From this state nothing is accepted any more (-1: there is none).
    dead: int


def compiled(trees: list[Tree], anywhere: bool) -> Automaton:
    """Deterministic, minimal automaton of some expressions; ``anywhere``: a match may begin at any byte."""
    nfa = Nfa(trees)
    n = len(nfa.moves)

    def reached(state: int) -> int:
        seen, todo = 1 << state, [state]
        while todo:
            for t in nfa.jumps[todo.pop()]:
                if not seen >> t & 1:
                    seen |= 1 << t
                    todo.append(t)
        return seen

    closed = [reached(k) for k in range(n)]
    # Bytes that no rule tells apart share a class.
    sets = sorted({m[0] for moves in nfa.moves for m in moves}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    number = {s: k for k, s in enumerate(dict.fromkeys(signature))}
    byte_class = [number[s] for s in signature]
    example = [byte_class.index(k) for k in range(len(number))]
    # Of each state and class the closed set of states after it.
    after = [[0] * len(example) for _ in range(n)]
    for k, moves in enumerate(nfa.moves):
        for allowed, t in moves:
            for c, b in enumerate(example):
                if b in allowed:
                    after[k][c] |= closed[t]
    moving = sum(1 << k for k, moves in enumerate(nfa.moves) if moves)

    # Subset construction; sets of states are numbers' bits.
    start = closed[0]
    ids, order, table = {start: 0}, [start], []
    for subset in order:
        row = [start if anywhere else 0] * len(example)
        left = subset & moving
        while left:
            low = left & -left
            for c, to in enumerate(after[low.bit_length() - 1]):
                if to:
                    row[c] |= to
            left ^= low
        for to in row:
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
        table.append([ids[to] for to in row])
    fired = [sum({bits for s, bits in nfa.final.items() if subset >> s & 1}) for subset in order]

    # Minimisation: split blocks until states of a block move to the same blocks.
    moves = np.array(table)
    block = np.unique(np.array(fired, object).astype(str), return_inverse=True)[1].reshape(-1)
    while True:
        key = np.column_stack([block, block[moves]])
        finer = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    count = int(block.max()) + 1
    member = np.full(count, -1)
    member[block[::-1]] = np.arange(len(block))[::-1]
    place = sorted(range(count), key=lambda k: (fired[member[k]] > 0, k))
    offset = [0] * count
    for r, k in enumerate(place):
        offset[k] = r * 256
    rows = [[offset[t] for t in block[moves[member[k]]].tolist()] for k in place]
    flat = [row[c] for row in rows for c in byte_class]
    quiet = sum(not fired[member[k]] for k in place)
    dead = next((offset[k] for k, row in zip(place, rows, strict=True) if not fired[member[k]] and set(row) == {offset[k]}), -1)
    return Automaton(flat, offset[block[0]], quiet * 256, {offset[k]: fired[member[k]] for k in place if fired[member[k]]}, dead)


# ---- rules ----


class Rule(NamedTuple):
    kind: str
    #: The expression is lead + body; the body has ``least`` bytes at least.
    lead: str
    body: str
    least: int
    any_case: bool = False


NAME, WORD, BASE64 = "[A-Za-z0-9]+", "[A-Za-z0-9_-]+", "[A-Za-z0-9+/=]+"
# The first three rules and their lengths. The order is that of kinds with equal starts. Runs of less than 16 hex digits
# can't match, so the third rule says so itself.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", "", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "", "[0-9a-f]{16,}", 16),
    Rule("private_key", "", "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", 1),
    Rule("code_host", "", f"gh[opsru]_{NAME}", 24),
    Rule("code_host_fine", "", f"github_pat_{WORD}", 40),
    Rule("forge", "", f"gl(?:pat|dt|rt|cbt|ptt)-{WORD}", 26),
    Rule("chat", "", "xox[abeoprs]-[A-Za-z0-9-]+", 15),
    Rule("chat_app", "", "xapp-[0-9]-[A-Za-z0-9-]+", 30),
    Rule("chat_hook", "https://hooks\\.slack\\.com/(?:services|workflows)/", "[A-Za-z0-9/]+", 20),
    Rule("bot", "", f"[0-9]+:AA{WORD}", 43),
    Rule("room_hook", "https://(?:[a-z]+\\.)?discord(?:app)?\\.com/api/webhooks/[0-9]+/", WORD, 40),
    Rule("web_token", "", f"eyJ{WORD}\\.eyJ{WORD}\\.{WORD}", 30),
    Rule("bearer", "authorization:\\x20*bearer\\x20+", "[A-Za-z0-9._~+/=-]+", 12, True),
    Rule("basic", "authorization:\\x20*basic\\x20+", BASE64, 8, True),
    Rule("url_login", "", "[A-Za-z][A-Za-z0-9+.-]*://[^\\s:/@]+:[^\\s:/@]+@", 1),
    Rule("cloud_key", "", f"AIza{WORD}", 39),
    Rule("cloud_login", "", f"ya29\\.{WORD}", 30),
    Rule("cloud_secret", "", f"GOCSPX-{WORD}", 30),
    Rule("temporary_access", "", "A(?:SIA|ROA|IDA|NPA)[A-Z0-9]+", 20),
    Rule("storage", "AccountKey=", BASE64, 40),
    Rule("container", "", "do[opr]_v1_[0-9a-f]+", 60),
    Rule("payment", "", f"[rs]k_(?:live|test)_{NAME}", 20),
    Rule("payment_hook", "", f"whsec_{BASE64}", 30),
    Rule("till", "", f"sq0(?:atp|csp|idp)-{WORD}", 26),
    Rule("shop", "", "shp(?:at|ca|pa|ss)_[0-9a-fA-F]+", 38),
    Rule("mail", "", f"SG\\.{WORD}\\.{WORD}", 50),
    Rule("mail_route", "", "key-[0-9a-f]+", 36),
    Rule("mail_list", "", "[0-9a-f]+-us[0-9]+", 36),
    Rule("mail_block", "", f"xkeysib-{WORD}", 60),
    Rule("phone", "", "(?:AC|SK)[0-9a-f]+", 34),
    Rule("package", "", f"npm_{NAME}", 40),
    Rule("package_index", "", f"pypi-{WORD}", 50),
    Rule("gem", "", "rubygems_[0-9a-f]+", 57),
    Rule("image", "", f"dckr_pat_{WORD}", 36),
    Rule("models", "", f"hf_{NAME}", 37),
    Rule("service", "", f"sk-{WORD}", 40),
    Rule("lake", "", "dapi[0-9a-f]+", 36),
    Rule("vault", "", f"hv[bs]\\.{WORD}", 28),
    Rule("tracker", "", f"lin_api_{NAME}", 40),
    Rule("errors", "", f"sntrys_{BASE64}", 40),
    Rule("social", "", f"EAA{NAME}", 60),
    Rule("age_key", "", "AGE-SECRET-KEY-1[A-Z0-9]+", 74),
    Rule("terminal_key", "", "PuTTY-User-Key-File-[0-9]+", 21),
]
BASE_KINDS = 3


class Scanner:
    """The automata of some rules: one of all starts, and of each rule those of its lead and of itself."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        trees = [Parser(r.lead + r.body, r.any_case).tree() for r in rules]
        self.starts = compiled([reversed_tree(t) for t in trees], True)
        self.whole = [compiled([t], False) for t in trees]
        self.lead = [compiled([Parser(r.lead, r.any_case).tree()], False) if r.lead else None for r in rules]

    def places(self, data: bytes) -> list[tuple[int, int]]:
        """Where matches begin, from the end of the text on, with the rules as bits: one pass over its bytes."""
        moves, state, accepting, fired, _ = self.starts
        out = []
        for back, b in enumerate(data[::-1]):
            state = moves[state + b]
            if state >= accepting:
                out.append((back, state))
        return [(len(data) - 1 - back, fired[state]) for back, state in out]

    @staticmethod
    def end(automaton: Automaton, data: bytes, at: int) -> int:
        """End of the longest match that begins here."""
        moves, state, accepting, _, dead = automaton
        found = at
        for k in range(at, len(data)):
            state = moves[state + data[k]]
            if state >= accepting:
                found = k + 1
            elif state == dead:
                break
        return found

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) in bytes."""
        found, free = [], [0] * len(self.rules)
        for at, bits in reversed(self.places(data)):
            while bits:
                low = bits & -bits
                bits ^= low
                k = low.bit_length() - 1
                if at < free[k]:
                    continue
                end = free[k] = self.end(self.whole[k], data, at)
                body = at if self.lead[k] is None else self.end(self.lead[k], data, at)
                if end - body >= self.rules[k].least:
                    found.append((at, k, end))
        return found


@cache
def scanner() -> Scanner:
    return Scanner(RULES)


def spans(data: bytes, own: Scanner) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end) in code points, in order."""
    found = own.matches(data)
    if not found:
        return []
    point = {}
    at = n = 0
    for place in sorted({p for a, _, b in found for p in (a, b)}):
        n += len(data[at:place].decode("utf-8", "replace"))
        point[place] = n
        at = place
    return sorted((point[a], k, point[b]) for a, k, b in found)


def scan(data: bytes, own: Scanner | None = None) -> tuple[int, int, int, str, str]:
    found = spans(data, own or scanner())
    written = [(k, f"{RULES[k].kind}:{a}:{b}") for a, k, b in found]
    base = ",".join(w for k, w in written if k < BASE_KINDS)
    counts = [sum(k == kind for k, _ in written) for kind in range(BASE_KINDS)]
    return *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(w for _, w in written)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of their spans, and all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [f.split()[0] for f in schema.split(", ")]
    # Compiled once, and of a size that the rules fix.
    own = docs.sparkSession.sparkContext.broadcast(scanner())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t, own.value) for t in as_bytes(batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
