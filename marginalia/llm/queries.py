"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, license_scan, line_dedup, lm_score, mixing, packing, prefix_trie, quality, ranked_search, secret_scan, simhash, token_count
from .common import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(read_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(read_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs, counts=True)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_source_mixing, op3_secret_scan, op4_quality_classifier, op5_exact_dedup,
        op6_decontamination, op7_token_counts, op8_simhash_near_dedup, op9_lm_scoring, op10_line_dedup, op11_packing,
        op12_ranked_search, op13_conversation_prefix_trie,
    )
}

ORACLES: dict[str, str] = {
    "op2_source_mixing": f"""
WITH rates AS (
  SELECT source, (1.0 / count(*) OVER ()) * sum(count(*)) OVER () / count(*) AS rate FROM documents GROUP BY source),
drawn AS (
  SELECT doc_id, d.source, text, rate, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT) AS most,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{mixing.SEED}'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
masses AS (
  SELECT rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below, source
  FROM (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT))) AS k FROM rates)),
counted AS (
  SELECT doc_id, d.source, text, (SELECT count(*) FROM masses m WHERE m.source IS NOT DISTINCT FROM d.source AND d.u >= m.below) AS copies
  FROM drawn d)
SELECT doc_id, source, text, CAST(unnest(range(1, copies + 1)) AS INT) AS copy_no FROM counted WHERE copies > 0
""",
    "op5_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(t) AS text_sha256 FROM g
""",
    "op10_line_dedup": f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(str_split(text, chr(10))) AS line, unnest(range(len(str_split(text, chr(10))))) AS number FROM documents WHERE text IS NOT NULL),
first AS (
  SELECT line, min(struct_pack(doc := doc_id, number := number)) AS place FROM lines WHERE line <> '' GROUP BY line),
halves AS (
  SELECT line, place, length(line) AS n, unnest([(length(line) - 1) // 2, length(line) // 2]) AS q FROM first WHERE length(line) >= {line_dedup.EDIT_CHARS}),
keys AS (
  SELECT DISTINCT line, place, n, unnest(['a' || q || left(line, CAST(q AS INT)), 'z' || q || right(line, CAST(q AS INT))]) AS half FROM halves),
near AS (
  SELECT DISTINCT a.line FROM keys a JOIN keys b ON a.half = b.half AND abs(a.n - b.n) <= 1 AND b.place < a.place
  WHERE levenshtein(a.line, b.line) <= 1),
judged AS (
  SELECT l.doc_id, l.number, l.line,
         l.line = '' OR (f.place = struct_pack(doc := l.doc_id, number := l.number) AND n.line IS NULL) AS stays
  FROM lines l LEFT JOIN first f ON l.line = f.line LEFT JOIN near n ON l.line = n.line),
joined AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY number) FILTER (WHERE stays) AS text, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
""",
    "op12_ranked_search": r"""
WITH words AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)),
lengths AS (SELECT row, count(*) AS n FROM words GROUP BY row),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
damped AS (SELECT row, 10 + (90 * n * docs) // terms AS m FROM lengths, totals),
counted AS (SELECT doc_id, row, term, count(*) AS tf FROM words GROUP BY doc_id, row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, c.row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked a JOIN weights v ON a.term = v.term JOIN counted c ON c.term = a.term JOIN damped d ON d.row = c.row GROUP BY item_id, doc_id, c.row),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM placed WHERE rank <= 10
""",
    "op13_conversation_prefix_trie": r"""
WITH RECURSIVE steps(n, k, v) AS (
  SELECT n, 0, n FROM range(256) r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE k = 8),
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 20 AS b,
         xor(list_reduce(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT)),
                         lambda s, x: xor(s >> 8, t[CAST(xor(s, x) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns), crc),
rebuilt AS (
  SELECT v.c, k, role, text FROM convs v JOIN turns o ON o.c = v.b AND k <= h
  UNION ALL SELECT v.c, k, role, text FROM convs v JOIN turns o ON o.c = v.c AND k > h),
whole AS (
  SELECT v.c, coalesce(list({'role': role, 'text': text} ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS s
  FROM convs v LEFT JOIN rebuilt r ON v.c = r.c GROUP BY v.c),
prefixes AS (SELECT c, len(s) AS n, d, s[1:d] AS p FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM whole)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d)), sha256('')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS w
  FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k ON n.p = k.p AND n.d = k.d),
below AS (
  SELECT p[1:a] AS p, a AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON n.p = b.p AND n.d = b.d LEFT JOIN nodes o ON n.d > 0 AND o.d = n.d - 1 AND o.p = n.p[1:n.d - 1]
""",
}
