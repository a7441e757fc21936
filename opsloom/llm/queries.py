"""The thin queries of the numbered operators over whole tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm import (
    curve, decontaminate, jaccard, licenses, lines, packing, paragraphs, periodic, prefixes, quality, secret_spans, tokencount, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("places")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokencount.read_pieces(_tokenizer("byte_bpe_50k.tiktoken"))
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), pieces)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_sequences(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.scan_secrets(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = prefixes.borrowed_starts(prefixes.numbered_turns(_table(spark, sf_dir, "conversations")))
    return prefixes.trie_report(turns, members).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("seed"))
    return periodic.periodic_runs(docs, seed="seed")


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.curve_sequences(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")).drop("hilbert_key")


def queries() -> dict[str, Query]:
    own = (
        op1_license_scan, op2_token_counts, op3_ngram_jaccard, op4_paragraph_minhash, op5_line_dedup,
        op6_best_fit_packing, op7_decontamination, op8_warc_normaliser, op9_secret_scan, op10_quality_rules,
        op11_prefix_trie, op12_periodic_runs, op13_curve_packing,
    )
    return {f.__name__: f for f in own}


# A-Z and a-z, and the two word rules, as the SQL texts write them.
_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

_OP3 = f"""
WITH RECURSIVE t AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_LOWER.format(c='text')}, {_SPACED}) AS w FROM documents),
sets AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS g
    FROM t, range(1, greatest(len(w) - 4, 1) + 1) r(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS MATERIALIZED (
    SELECT x.a, x.b FROM (
        SELECT s.doc_id AS a, u.doc_id AS b, count(*) AS both FROM sets s JOIN sets u ON s.g = u.g AND s.doc_id <> u.doc_id
        GROUP BY 1, 2) x
    JOIN sizes p ON p.doc_id = x.a JOIN sizes q ON q.doc_id = x.b
    WHERE 100 * x.both >= 75 * (p.n + q.n - x.both)),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS MATERIALIZED (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id, count(*) OVER (PARTITION BY r.component_id)::BIGINT AS n_texts
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN roots r USING (doc_id)
"""

_OP7 = f"""
WITH d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_LOWER.format(c='text')}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format(c='text')}, {_ALNUM}) AS w FROM benchmark),
p AS MATERIALIZED (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
    FROM b, range(1, greatest(len(w) - 12, 1) + 1) r(i) WHERE len(w) > 0),
windows AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM d, (SELECT DISTINCT n FROM p) l, range(1, len(w) - n + 2) r(i)),
hits AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM windows JOIN p USING (n, phrase)),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, range(i, i + n) r(j) GROUP BY 1),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages),
bits AS (
    SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('0000' || bin(('0x' || digest[i])::INT), 4)), '') AS b,
        max(page_id) OVER (PARTITION BY body) AS largest FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        (b[5 * k + 1]::INT * 16 + b[5 * k + 2]::INT * 8 + b[5 * k + 3]::INT * 4 + b[5 * k + 4]::INT * 2 + b[5 * k + 5]::INT) + 1]), '')
        AS payload_digest,
    CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM bits
"""

_OP10 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, source, t, regexp_extract_all(t, {_SPACED}) AS w FROM d),
grams AS MATERIALIZED (
    SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM w, range(1, len(w) - 1) r(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM again, range(i, i + 3) r(j) GROUP BY 1),
lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS MATERIALIZED (
    SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
f AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM f WHERE source IS NOT NULL GROUP BY 1),
a AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS s, sum(n) / count(*) AS size FROM hosts),
v AS (SELECT m, s - m * m - m * (1 - m) / size AS v FROM a),
prior AS (SELECT m, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 0) ELSE 1e12 END AS k FROM v),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (source IS NOT NULL AND source IN (SELECT source FROM bad)) AS kept
FROM f
"""

# CRC-32 of a decimal number's text: fixed values of the polynomial and the start, a bit at a time.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({c}::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
    lambda c, s: list_reduce(list_prepend(xor(c, s), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

_OP11 = f"""
WITH t AS MATERIALIZED (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (
    SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format(c='conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
m AS MATERIALIZED (
    SELECT c.conv_id, base, h, least(h, count(t.place)) AS taken FROM c LEFT JOIN t ON t.conv_id = c.base GROUP BY 1, 2, 3),
r AS MATERIALIZED (
    SELECT m.conv_id, place, role, text FROM m JOIN t ON t.conv_id = m.base WHERE place < taken
    UNION ALL SELECT m.conv_id, place - h + taken, role, text FROM m JOIN t USING (conv_id) WHERE place >= h),
path AS MATERIALIZED (
    SELECT conv_id, place + 1 AS depth, strlen(text) AS bytes,
        sha256(to_json(list([role, text]) OVER (PARTITION BY conv_id ORDER BY place))::VARCHAR) AS node FROM r
    UNION ALL SELECT conv_id, 0, 0, 'top' FROM c),
n AS MATERIALIZED (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM path GROUP BY 1, 2),
up AS MATERIALIZED (SELECT n.node, p.node AS above FROM n JOIN path p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT above AS node, count(*) AS n_children FROM up GROUP BY 1),
below AS (
    SELECT p.node, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
    FROM n JOIN path p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY 1),
last AS (SELECT conv_id, max(depth) AS depth FROM path GROUP BY 1),
ends AS (
    SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM path JOIN last USING (conv_id, depth) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
    coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
    coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)
LEFT JOIN up USING (node) LEFT JOIN n p ON p.node = up.above
"""

_OP12 = f"""
WITH t AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w, {_CRC.format(c='doc_id')} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM t),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
words AS MATERIALIZED (
    SELECT doc_id, n, i, w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END)::BIGINT + 1] AS word FROM p, range(n) r(i)),
same AS (
    SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (
    SELECT doc_id, q, min(i) AS a, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
long AS MATERIALIZED (SELECT * FROM islands WHERE length >= greatest(6, 4 * q)),
runs AS MATERIALIZED (
    SELECT * FROM long x WHERE NOT EXISTS (
        FROM long y WHERE y.doc_id = x.doc_id AND y.a = x.a AND y.length = x.length AND y.q < x.q)),
told AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(concat(a, ',', length, ',', q, chr(10)), '' ORDER BY a, q) AS listed,
        first(struct_pack(a, length, q) ORDER BY length DESC, a, q) AS best FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i FROM runs, range(a + q, a + length) r(i)),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.a::BIGINT AS start, best.length::BIGINT AS length, best.q::BIGINT AS period,
    (1000 * best.length // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
    sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard": _OP3,
        "op7_decontamination": _OP7,
        "op8_warc_normaliser": _OP8,
        "op10_quality_rules": _OP10,
        "op11_prefix_trie": _OP11,
        "op12_periodic_runs": _OP12,
    }
