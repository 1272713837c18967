"""Column functions over text, metadata and vectors."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import metadata as md
from marginalia.functions import text as tx
from marginalia.functions import vectors as vf
from marginalia.operators import chunking


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_words(spark):
    assert one(spark, tx.words("t"), t=" a b\tc\n ") == ["a", "b", "c"]
    assert one(spark, tx.word_count("t"), t="   ") == 0


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 35, 36, 100])
def test_windows(spark, n):
    own = [f"w{i}" for i in range(n)]
    found = one(spark, tx.windows(F.col("t"), 20, 5), t="  ".join(own))
    assert found == chunking.window_texts("  ".join(own), 20, 5)
    # The windows give back the words.
    back = []
    for k, w in enumerate(found):
        back += w.split()[5 if k else 0 :]
    assert back == own
    if n > 20:
        assert len(found[0].split()) == 20 and found[1].split()[:5] == found[0].split()[-5:]


@pytest.mark.parametrize(("size", "overlap"), [(20, 15), (5, 4), (3, 2), (50, 90), (7, 4)])
def test_windows_that_share_most_words(spark, size, overlap):
    """The same windows, cut out of stretches of five windows' words at most."""
    texts = ["  ".join(f"w{i}" if i % 3 else f"é\u4e2d{i}\U0001f600" for i in range(n)) for n in (1, size, size + 1, 5 * size, 5 * size + 1, 333)]
    texts = ["", " \n\u3000", None, *texts, f"  {texts[4]}\u2003"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    kept, n = df.select("k", "text"), {"plain": tx.clamp_window(size, overlap), "code": (size, overlap if overlap < size else 0)}
    ways = {"plain": (chunking.chunk_plain, chunking.plain_chunks(F.col("text"), *n["plain"])), "code": (chunking.chunk_code_windows, tx.windows(F.col("text"), *n["code"]))}
    for way, (chunk, whole) in ways.items():
        found = chunk(kept, size=size, overlap=overlap)
        want = df.select("k", F.posexplode(whole).alias("chunk_index", "content"))
        assert found.dtypes == want.dtypes and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())), way
    # Not made side by side in one row, as many times the text as a window holds words.
    assert "substring(joined" in chunking.chunk_plain(kept, size=size, overlap=overlap)._jdf.queryExecution().toString()
    longest = df.select(F.explode(tx.window_blocks(F.col("text"), *n["plain"], 4 * size // (n["plain"][0] - n["plain"][1]))).alias("b")).select(F.max(F.size("b.words"))).first()[0]
    assert longest <= 5 * size


def test_word_starts(spark):
    for n in (0, 1, 7, 8, 9, 16, 17, 100):
        own = [("é" if i % 2 else "ab") * (i % 5 + 1) for i in range(n)]
        found = spark.range(1).select(tx.word_starts(F.array(*map(F.lit, own)) if own else F.array().cast("array<string>"))).first()[0]
        assert found == [len("".join(w + " " for w in own[:k]).encode()) for k in range(n + 1)]


def test_trimmed_is_white_space_of_words(spark):
    """All letters of the first plane: what is trimmed is what parts words, at the ends alone and without a look at each character between."""
    df = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    t = F.concat("c", F.lit("a "), "c", F.lit(" b"), "c", F.lit("\n"), "c")
    assert df.where(tx.trimmed(t) != F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).count() == 0
    assert df.where(tx.trimmed(t) == F.concat(F.lit("a "), "c", F.lit(" b"))).count() == 25
    assert "regexp" not in df.select(tx.trimmed(t))._jdf.queryExecution().toString()


def test_clamps():
    assert tx.clamp_window(0, 9) == (1, 0) and tx.clamp_window(10, 10) == (10, 9) and tx.clamp_window(10, -1) == (10, 0)
    assert tx.clamp_code_window(10, 10) == (10, 0) and tx.clamp_code_window(10, 9) == (10, 9)
    assert [tx.clamp(v, 20, 1, 200) for v in (0, -1, 5, 900)] == [20, 20, 5, 200]


def test_plain_chunks(spark):
    assert one(spark, chunking.plain_chunks(F.col("t")), t="  \n ") == [""]
    assert one(spark, chunking.plain_chunks(F.col("t")), t="  a  b ") == ["a  b"]


@pytest.mark.parametrize(("text", "needle", "hit"), [("ZÜRICH CAFÉ", "zürich café", True), ("K", "k", True), ("a.c", ".", True), ("abc", ".", False), ("Σσς", "σσσ", True), ("x\\Ey", "\\e", True), ("a-b~c d#e", "B~C D#", True)])
def test_contains_folded(spark, text, needle, hit):
    assert one(spark, tx.contains_folded("t", needle), t=text) is hit


def test_excerpts(spark):
    assert tuple(one(spark, tx.snippet("t", 5), t="abcd  efg")) == ("abcd…", True)
    assert tuple(one(spark, tx.snippet("t", 9), t="abcd  efg")) == ("abcd  efg", False)
    assert one(spark, tx.line_number(F.col("t"), F.lit(5)), t="a\nb\nc") == 3
    assert one(spark, tx.match_context(F.col("t"), F.lit(6), F.lit(2), 2), t="abcdefghijk") == "…defghi…"
    assert one(spark, tx.highlight("t", "Ab x cd"), t="xabyCDz") == "x<mark>ab</mark>y<mark>CD</mark>z"
    assert one(spark, tx.rewrite_prefix("t", "/a_b", "/c"), t="/a_b/x") == "/c/x"
    assert one(spark, tx.rewrite_prefix("t", "/a_b", "/c"), t="/axb/x") == "/axb/x"


def test_tokens(spark):
    assert one(spark, tx.tokens("t"), t="Crème_brûlée, ÜBER-42 naïve") == ["creme", "brulee", "uber", "42", "naive"]
    assert one(spark, tx.tokens("t"), t="e\u0301cole Re\u0301sume\u0301") == ["ecole", "resume"]
    assert one(spark, tx.tokens("t"), t="हिन्दी мой ΣΊΓΜΑΣ") == ["ह", "न", "द", "мой", "σίγμασ"]
    assert tx.query_phrases('foo "bar-baz" -- Été') == [["foo"], ["bar", "baz"], ["ete"]]
    assert [tx.escape_query(q) for q in ("", "quick fox", 'foo"bar', '"')] == ["", '"quick" "fox"', '"foo""bar"', '""""']


def test_lists_in_code(spark):
    sql = "CREATE TABLE IF NOT EXISTS a.b (x); select * from t1 join T2; insert into a.b values"
    assert one(spark, tx.sql_tables("t"), t=sql) == ["a.b", "t1", "T2"]
    assert one(spark, tx.shell_functions("t"), t="f() {\n}\n  g ()\nfunction h {\nf() x\nfunction  k ( )\nm( ) {") == ["f", "k", "m"]


def test_metadata(spark):
    held = '{"tags": ["a", "b"], "n": 42, "s": "x", "date": "", "author_date": "2024-05-06T00:00:00Z"}'
    assert sorted(one(spark, md.keys("m"), m=held)) == ["author_date", "date", "n", "s", "tags"]
    assert one(spark, md.keys("m"), m="") == []
    assert [one(spark, md.values("m", k), m=held) for k in ("tags", "n", "s", "none")] == [["a", "b"], ["42"], ["x"], []]
    assert one(spark, md.own_date("m"), m=held) == "2024-05-06T00:00:00Z"
    assert one(spark, md.described(F.col("m")), m='{"/a": "1", "/a:history": "2", "/b": "3"}') == "2 repositories"
    assert one(spark, md.described(F.col("m")), m="words") == "words"
    assert one(spark, md.watermarks(F.col("m")), m="git:/a/b:0abc") == {"/a/b": "0abc"}


@pytest.mark.parametrize(
    ("path", "kind", "meta", "uri"),
    [
        ("/a/b.txt", "plaintext", "", "file:///a/b.txt"),
        ("/a/b.go", "code", '{"start_line": 7}', "vscode://file/a/b.go:7"),
        ("/a/b.go", "code", "", "vscode://file/a/b.go:1"),
        ("/v/My Vault/x y.md", "markdown", "", "obsidian://open?vault=My+Vault&file=x+y.md"),
        ("git://r/1", "commit", "", None),
        ("calibre://1", "book", "", None),
        ("git://r/1", "commit", '{"url": "https://x"}', "https://x"),
    ],
)
def test_source_uri(spark, path, kind, meta, uri):
    assert one(spark, md.source_uri(F.col("p"), F.col("k"), F.col("m"), {"/v/My Vault": "My Vault"}), p=path, k=kind, m=meta) == uri


def test_vectors(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.0, 2.0] * 20, [0.5, 1.0, 0.0, -2.0] * 20, [1.0])], "a array<float>, b array<float>, c array<float>")
    r = df.select(vf.quantized(F.col("a"), 80).alias("q"), vf.hamming(vf.quantized(F.col("a"), 80), vf.quantized(F.col("b"), 80)).alias("h"), vf.squared_l2(F.col("a"), F.col("b")).alias("d"), vf.squared_l2(F.col("a"), F.col("c")).alias("inf")).first()
    assert r.q == vf.quantized_query([0.5, -1.0, 0.0, 2.0] * 20) and r.h == 40 and r.d == 400.0 and r.inf == float("inf")
    assert vf.from_blob(vf.to_blob([1.5, -2.0])) == [1.5, -2.0] and vf.from_blob(b"abc") is None


MARKDOWN = """intro

# A

text of a

```
# not a heading
```

## B

~~~~ python
# still not
~~~
~~~~
after

# C
"""


def test_markdown():
    found = chunking.markdown_chunks(MARKDOWN)
    assert [m.get("heading_path") for _, m in found] == [None, "A", "A > B"]
    assert found[1][0].startswith("[A] text of a") and "# not a heading" in found[1][0] and found[2][0].endswith("after")
    assert chunking.markdown_chunks("") == [("", {})]
    assert chunking.markdown_chunks("```\n# x\nnever closed") == [("```\n# x\nnever closed", {})]
    long = chunking.markdown_chunks("# T\n" + "w " * 50, size=20, overlap=5)
    assert all(t.startswith("[T] ") and len(t.split()) <= 20 for t, _ in long) and len(long) == 4


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="#`~ab \n", max_size=120))
def test_markdown_loses_no_words(text):
    if re.search(r"^#{1,6}\s*$", text, re.M):
        return  # white space after the hashes may run over the line's end
    kept = " ".join(t for t, _ in chunking.markdown_chunks(text))
    for line, fenced in zip(text.split("\n"), chunking.fence_lines(text.split("\n")), strict=True):
        if not fenced and not line.startswith("#"):
            assert all(w in kept for w in line.split())


def test_commit_chunks(spark):
    rows = [("r", "0123456789", "2024-05-06T07:08:09Z", "subject", "a.py", False, "w " * n, n) for n in (3, 700)] + [("r", "1", "2024", "s", "b.bin", True, "x", 0), ("r", "1", "2024", "s", "c", False, " ", 0)]
    df = spark.createDataFrame(rows, "repo string, sha string, author_date string, subject string, file_path string, is_binary boolean, diff string, n long")
    found = chunking.chunk_commits(df).orderBy("n", "chunk_index").collect()
    assert [(r.n, r.chunk_index) for r in found] == [(3, 0), (700, 0), (700, 1)]
    assert all(r.content.startswith("[r/a.py] [commit: 0123456] [2024-05-06]\n") and len(r.content.split()) <= 500 for r in found)


def test_queries_part_as_texts_do(spark):
    """Every letter, number and mark of Unicode between two others, in a text and in a query."""
    import unicodedata

    every = [c for c in range(1, 0x110000) if unicodedata.category(chr(c))[0] in "LNMPZS"]
    df = spark.createDataFrame([(c, f"x{chr(c)}Y") for c in every], "c long, t string")
    got = {r.c: r.k for r in df.select("c", tx.tokens("t").alias("k")).collect()}
    wrong = [hex(c) for c in every if got[c] != tx.tokens_of(f"x{chr(c)}Y")]
    # Signs newer than the JVM's Unicode are unknown to it.
    assert all(unicodedata.category(chr(int(c, 16)))[0] not in "LN" for c in wrong) and len(wrong) < 1200


def test_tokens_of_each_letter_are_sqlites(spark):
    """Of all letters and marks that both know."""
    import sqlite3
    import unicodedata

    old = unicodedata.ucd_3_2_0
    every = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and old.category(chr(c)) not in ("Cn", "Co")]
    connection = sqlite3.connect(":memory:")
    connection.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    connection.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    connection.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(c, f"x{chr(c)}y") for c in every])
    found = {}
    for term, doc, offset in connection.execute("SELECT term, doc, offset FROM v"):
        found.setdefault(doc, {})[offset] = term
    wrong = [c for c in every if [found[c][k] for k in sorted(found[c])] != tx.tokens_of(f"x{chr(c)}y")]
    # Letters that got another case after the tokenizer's tables were made.
    assert all(unicodedata.name(chr(c)).startswith(("CHEROKEE", "GEORGIAN")) or old.category(chr(c)) != unicodedata.category(chr(c)) for c in wrong) and len(wrong) < 300


SQL_TEXTS = [
    "SELECT * FROM a.b JOIN t1 ON x INTO T2", "create table if not exists s.t (a int)", "CREATE  TABLE if exists q;", "alter table z add", "drop table if exists n",
    "xfrom t from 9a from _b9.c.9 (from d)", "from if x", "from if exists y join", "from a;join b", "from from c", "join a,b from\nd", "éfrom g", "from a.b.", "insert into x.y(z)", "", "from", "create table", "from a.from t",
]


@pytest.mark.parametrize("text", SQL_TEXTS)
def test_sql_tables_against_a_scan(spark, text):
    assert one(spark, tx.sql_tables("t"), t=text) == scanned_tables(text)


def scanned_tables(text):
    """Character by character."""
    out, at = [], 0
    low = text.lower()
    ident = set("abcdefghijklmnopqrstuvwxyz0123456789_")

    def blank(k):
        n = k
        while n < len(text) and text[n] in " \t\n\r\f\v":
            n += 1
        return n if n > k else None

    def follow(k, words):
        for w in words:
            if k is None or not low.startswith(w, k):
                return None
            k = blank(k + len(w))
        return k

    def name(k):
        parts = []
        while k < len(text) and low[k] in ident and not low[k].isdigit():
            n = k
            while n < len(text) and low[n] in ident:
                n += 1
            parts.append(text[k:n])
            k = n + 1
            if n >= len(text) or text[n] != ".":
                break
        return ".".join(parts)

    while at < len(text):
        if at == 0 or low[at - 1] not in ident:
            for lead in (["create", "table"], ["alter", "table"], ["from"], ["join"], ["into"]):
                k = follow(at, lead)
                found = next((n for m in (follow(k, ["if", "not", "exists"]) if k else None, follow(k, ["if", "exists"]) if k else None, k) if m and (n := (m, name(m)))[1]), None)
                if found:
                    out.append(found[1])
                    at = found[0] + len(found[1]) - 1
                    break
        at += 1
    return list(dict.fromkeys(out))


def test_vfold(spark):
    """Letters that differ by case alone are one key, in Spark, in Python and in SQL."""
    from marginalia.plans import sql_functions

    for text, key in (("café", "CAFÉ"), ("Σσς", "ΣΣΣ"), ("Straße", "STRAßE"), ("kKK", "KKK"), ("sSſ", "SSS"), ("ǆǅǄ", "ǄǄǄ"), ("ẞß", "ßß"), ("plain", "PLAIN"), ("", ""), ("İı", "İı")):
        assert one(spark, tx.vfold("t"), t=text) == tx.vfold_of(text) == key
    rows = spark.createDataFrame([(1, "ſet", "c", "code", "/K/a", "md", "{}", "2024-01-01")], "id long, title string, collection string, collection_type string, source_path string, source_type string, metadata string, last_indexed_at string")
    sql_functions.register(spark, rows, rows.select("id", "source_path", "source_type", "last_indexed_at"))
    assert spark.sql("SELECT vfold('kſς\\'')").first()[0] == "KSΣ'"
    assert [r.id for r in spark.sql("SELECT * FROM library_sources_like('K/A', 0)").collect()] == [1]
    assert spark.sql("SELECT * FROM library_timeline('code', 'md', '2024-01-01', '', 0)").count() == 1
    assert spark.sql("SELECT * FROM library_timeline('other', '', '', '', 5)").count() == 0
    assert spark.sql("SELECT * FROM library_keys_of('c', 5)").count() == 0


def plain_shell_functions(text):
    """Line by line."""
    out = []
    for line in text.split("\n"):
        head, bracket, rest = line.partition("(")
        words = re.split("[ \t]+", head.rstrip(" \t"))
        word = words[0] if len(words) == 1 else words[1] if len(words) == 2 and words[0] == "function" else ""
        if bracket and rest.lstrip(" \t").startswith(")") and re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", word) and word not in out:
            out.append(word)
    return out


def test_shell_functions_against_lines(spark):
    rng = random.Random(12)
    parts = ["function", "function ", " ", "\t", "(", ")", "()", "( )", "\n", "\n", "\r", "\u2028", "f", "g1", "_h", "9", "é", "-"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000)]
    found = tx.shell_functions("t")
    assert "lambda" not in str(found)
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", found.alias("names")).collect()
    assert {r.k: r.names for r in rows} == {k: plain_shell_functions(t) for k, t in enumerate(texts)}
