"""Text operators over documents, conversations, pages and benchmark passages (whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions import pii, scalar, text as tx
from opsloom.plans.catalog import query
from opsloom.plans.mappings import Star
from opsloom.sources import corpus
from opsloom.sources.tables import read_table


def sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def tokens_sql(text: str, dialect: tx.Dialect = tx.CORPUS) -> str:
    words = f"regexp_extract_all(lower({text}), '{dialect.pattern}')"
    stop = sql_list(dialect.stopwords)
    keep = lambda ws: f"list_filter({ws}, lambda w: NOT list_contains({stop}, w))"
    if dialect.stem == "none":
        return keep(words)
    if dialect.stem == "corpus":
        stem = (
            "CASE WHEN regexp_matches(w, '(ss|us|is)$') OR length(w) <= 4 THEN w "
            "WHEN ends_with(w, 'ies') THEN substr(w, 1, length(w) - 3) || 'y' "
            "WHEN ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END"
        )
        return keep(f"list_transform({words}, lambda w: {stem})")
    stem = (
        "CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y' "
        "WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END"
    )
    return f"list_transform({keep(words)}, lambda w: {stem})"


SENTENCES_SQL = (
    "list_filter(list_transform(string_split(regexp_replace(replace({0}, chr(10), ' '), "
    r"'([.!?])\s+([A-Z0-9\"''(\[])', '\1' || chr(30) || '\2', 'g'), chr(30)), "
    r"lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
).replace('\\"', '"')


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _three_dialects():
    cols = []
    for name, dialect in (("corpus", tx.CORPUS), ("question", tx.QUESTION), ("note", tx.NOTE)):
        tokens = tokens_sql("text", dialect)
        cols.append(f"len({tokens}) AS {name}_n, md5(array_to_string({tokens}, ' ')) AS {name}_md5")
    return ", ".join(cols)


@query("tokenize", f"SELECT doc_id, {_three_dialects()} FROM documents")
def tokenize(spark, sf_dir):
    cols = []
    for name, dialect in (("corpus", tx.CORPUS), ("question", tx.QUESTION), ("note", tx.NOTE)):
        tokens = tx.tokenize(F.col("text"), dialect)
        cols += [
            F.size(tokens).cast("bigint").alias(f"{name}_n"),
            F.md5(F.array_join(tokens, " ")).alias(f"{name}_md5"),
        ]
    return _documents(spark, sf_dir).select("doc_id", *cols)


@query(
    "split_sentences",
    f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENTENCES_SQL.format('text')} AS s FROM documents)",
)
def split_sentences(spark, sf_dir):
    parts = tx.split_sentences(F.col("text"))
    return _documents(spark, sf_dir).select(
        "doc_id", F.size(parts).cast("bigint").alias("n"), F.md5(F.array_join(parts, "|")).alias("digest")
    )


USER_TURNS = "conversations c JOIN conversations a ON c.conv_id = a.conv_id AND a.turn = c.turn + 1"


def _turn_pairs(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(answers, ["conv_id", "turn"])


@query(
    "overlap_score",
    f"""SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS score
    FROM (SELECT c.conv_id, c.turn, list_distinct({tokens_sql('c.text')}) AS q, list_distinct({tokens_sql('a.text')}) AS a FROM {USER_TURNS})""",
)
def overlap_score(spark, sf_dir):
    score = tx.overlap_score(tx.tokenize(F.col("text")), tx.tokenize(F.col("answer")))
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(score, 6).alias("score"))


@query(
    "jaccard",
    f"""SELECT conv_id, turn, round(CASE WHEN u = 0 THEN 0 ELSE i / u END, 6) AS score FROM (
    SELECT conv_id, turn, len(list_intersect(q, a)) AS i, len(list_distinct(list_concat(q, a))) AS u FROM (
    SELECT c.conv_id, c.turn, {tokens_sql('c.text', tx.QUESTION)} AS q, {tokens_sql('a.text', tx.QUESTION)} AS a FROM {USER_TURNS}))""",
)
def jaccard(spark, sf_dir):
    score = tx.jaccard(tx.tokenize(F.col("text"), tx.QUESTION), tx.tokenize(F.col("answer"), tx.QUESTION))
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(score, 6).alias("score"))


@query(
    "extract_tag",
    r"""SELECT page_id, regexp_extract(html, '<title>\s*(.*?)\s*</title>', 1, 's') AS title,
    length(regexp_extract(html, '<article>\s*(.*?)\s*</article>', 1, 's')) AS article_chars FROM pages""",
)
def extract_tag(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select(
        "page_id",
        tx.extract_tag(F.col("html"), "title").alias("title"),
        F.length(tx.extract_tag(F.col("html"), "article")).cast("bigint").alias("article_chars"),
    )


@query(
    "extract_fenced_citations",
    r"""SELECT event_id, event_type AS body, array_to_string(list_sort(list_distinct([CAST(user_id AS VARCHAR), CAST(user_id % 7 AS VARCHAR)])), ',') AS cited
    FROM events""",
)
def extract_fenced_citations(spark, sf_dir):
    c = F.col
    answer = F.concat(
        F.lit("Query:\n```sql\n"), c("event_type"), F.lit("\n```\nsee ["), c("user_id").cast("string"), F.lit("] and ["),
        (c("user_id") % 7).cast("string"), F.lit("], also ["), c("user_id").cast("string"), F.lit("]"),
    )
    cited = F.transform(tx.citations(answer), lambda x: x.cast("string"))
    return read_table(spark, sf_dir, "events").select(
        "event_id", tx.extract_fenced(answer).alias("body"), F.array_join(F.array_sort(cited), ",").alias("cited")
    )


@query(
    "normalize_entity_name",
    r"""SELECT DISTINCT n AS name, trim(regexp_replace(regexp_replace(lower(n), '[^\w\s-]', '', 'g'), '\s+', ' ', 'g')) AS key FROM (
    SELECT p_brand || '  (' || p_name || '), ' || upper(p_type) AS n FROM part)""",
)
def normalize_entity_name(spark, sf_dir):
    name = F.concat(
        F.col("p_brand"), F.lit("  ("), F.col("p_name"), F.lit("), "), F.upper("p_type")
    )
    named = read_table(spark, sf_dir, "part").select(name.alias("name")).distinct()
    return named.select("name", tx.normalize_entity_name(F.col("name")).alias("key"))


@query(
    "stable_id",
    "SELECT doc_id, substr(sha256(source || chr(31) || lang || chr(31) || text), 1, 16) AS id, sha256(text) AS checksum FROM documents",
)
def stable_id(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id",
        scalar.stable_id(F.col("source"), F.col("lang"), F.col("text")).alias("id"),
        scalar.checksum(F.col("text")).alias("checksum"),
    )


@query(
    "verbatim_quote",
    rf"""SELECT conv_id, turn, own_q <> '' AND contains(t, own_q) AS own, user_q <> '' AND contains(t, user_q) AS repeated FROM (
    SELECT c.conv_id, c.turn, lower(trim(regexp_replace(a.text, '\s+', ' ', 'g'))) AS t,
      lower(trim(regexp_replace(split_part(a.text, '.', 1), '\s+', ' ', 'g'))) AS own_q,
      lower(trim(regexp_replace(split_part(c.text, '.', 1), '\s+', ' ', 'g'))) AS user_q FROM {USER_TURNS})""",
)
def verbatim_quote(spark, sf_dir):
    """Whether an answer holds its own first sentence and the first sentence of the question."""
    asked = F.split("text", r"\.", 2)[0]
    return _turn_pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        tx.verbatim_quote(F.col("answer"), F.split("answer", r"\.", 2)[0]).alias("own"),
        tx.verbatim_quote(F.col("answer"), asked).alias("repeated"),
    )


@query(
    "embedding_text",
    """SELECT p_partkey, CASE WHEN starts_with(p_brand || ' x', p_brand) THEN p_brand || ' x' END || chr(10) || chr(10) || p_name AS text,
    p_brand || ' -[MADE_AS]-> ' || p_type || ' (' || p_name || ')' AS fact FROM part""",
)
def embedding_text(spark, sf_dir):
    c = F.col
    section = F.concat(c("p_brand"), F.lit(" x"))
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        tx.embedding_text(c("p_brand"), section, c("p_name")).alias("text"),
        tx.as_fact(c("p_brand"), F.lit("MADE_AS"), c("p_type"), c("p_name")).alias("fact"),
    )


@query("estimate_tokens", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", scalar.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "abstained",
    """SELECT conv_id, turn, regexp_matches(text, '(?i)(does not contain|doesn''t contain|not (?:enough|sufficient) information|no information|cannot (?:find|determine|answer)|not (?:mentioned|specified|provided|available))') AS abstained
    FROM conversations""",
)
def abstained(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.abstained(F.col("text")).alias("abstained")
    )


def _any(column, hints):
    return "(" + " OR ".join(f"contains({column}, '{h}')" for h in hints) + ")"


@query(
    "route_question",
    f"""SELECT conv_id, turn, CASE WHEN {_any('t', tx.DIRECT_HINTS)} AND len({tokens_sql('text')}) <= 3 THEN 'direct'
    WHEN {_any('t', tx.WEB_HINTS)} THEN 'web' WHEN {_any('t', tx.GLOBAL_HINTS)} THEN 'global' ELSE 'local' END AS route
    FROM (SELECT *, ' ' || lower(text) || ' ' AS t FROM conversations)""",
)
def route_question(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.route_question(F.col("text")).alias("route"))


@query(
    "sub_questions",
    rf"""WITH p AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\?\s+|\band how\b|\band what\b|;'),
      lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS raw FROM conversations),
    u AS (SELECT *, list_filter(list_transform(raw, lambda x: regexp_replace(x, '^[ ?,.]+|[ ?,.]+$', '', 'g')),
      lambda x: len({tokens_sql('x')}) >= 2) AS usable FROM p)
    SELECT conv_id, turn, CASE WHEN len(raw) > 1 AND len(usable) > 1 THEN array_to_string(list_slice(usable, 1, 3), '|') ELSE '' END AS parts
    FROM u""",
)
def sub_questions(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(tx.sub_questions(F.col("text")), "|").alias("parts")
    )


@query(
    "grounding",
    f"""SELECT conv_id, turn, len(list_filter({SENTENCES_SQL.format(r"regexp_replace(answer, '\[[^\]]{1,6}\]', '', 'g')")},
      lambda s: len({tokens_sql('s')}) > 0 AND len(list_filter({tokens_sql('s')}, lambda t: list_contains(e, t))) < len({tokens_sql('s')}) * 0.6)) AS unsupported,
      round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, list_distinct(e))) / len(q) END, 3) AS judged
    FROM (SELECT c.conv_id, c.turn, a.text AS answer, {tokens_sql('c.text')} AS e, list_distinct({tokens_sql('a.text')}) AS q FROM {USER_TURNS})""".replace(
        "{1,6}", "{1,6}"
    ),
)
def grounding(spark, sf_dir):
    """Answer sentences without support in the previous turn, and the share of answer terms found there."""
    evidence = tx.tokenize(F.col("text"))
    rows = _turn_pairs(spark, sf_dir).withColumn("evidence", evidence)
    weak = tx.unsupported_sentences(F.col("answer"), F.col("evidence"))
    judged = tx.overlap_score(tx.tokenize(F.col("answer")), F.col("evidence"))
    return rows.select(
        "conv_id", "turn", F.size(weak).cast("bigint").alias("unsupported"), F.round(judged, 3).alias("judged")
    )


@query("chunk_documents")
def chunk_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumn("title", F.col("source"))
    return corpus.chunk_documents(docs)


@query(
    "fixed_chunks",
    """SELECT doc_id, CAST(i // 1050 AS INTEGER) AS position, substr(text, i + 1, 1200) AS text FROM (
    SELECT doc_id, text, CAST(unnest(range(0, greatest(length(text) - 150, 1), 1050)) AS BIGINT) AS i FROM documents)""",
)
def fixed_chunks(spark, sf_dir):
    return corpus.fixed_chunks(_documents(spark, sf_dir))


@query("heading_sections")
def heading_sections(spark, sf_dir):
    """Sections of the web pages once their h1/h2 tags are written as Markdown headings."""
    html = F.col("html")
    for level in (1, 2, 3):
        html = F.regexp_replace(html, rf"(?s)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    docs = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), html.alias("text"))
    return corpus.heading_sections(docs)


@query(
    "load_text",
    r"""SELECT substr(sha256(url), 1, 16) AS doc_id, url AS source, length(html) AS n FROM pages""",
)
def load_text(spark, sf_dir):
    docs = corpus.load_text(read_table(spark, sf_dir, "pages"), "html", "url")
    return docs.select("doc_id", "source", F.length("text").cast("bigint").alias("n"))


@query(
    "chunk_position",
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations""",
)
def chunk_position(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    return read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.row_number().over(order) - 1).cast("bigint").alias("position")
    )


@query(
    "pii_scan_email",
    r"""SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS emails
    FROM documents WHERE regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')""",
)
def pii_scan_email(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", pii.pii_scan(F.col("text")).alias("hits"))
    counted = rows.select("doc_id", pii.count_hits(F.col("hits"))["EMAIL"].cast("bigint").alias("emails"))
    return counted.filter("emails > 0")


@query("redact")
def redact(spark, sf_dir):
    rows = _documents(spark, sf_dir).withColumn("hits", pii.pii_scan(F.col("text")))
    return rows.select(
        "doc_id",
        F.md5(pii.redact_hits(F.col("text"), F.col("hits"))).alias("digest"),
        F.size("hits").alias("hit_count"),
        F.to_json(pii.count_hits(F.col("hits"))).alias("counts"),
    )


@query(
    "luhn_ok",
    """SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN d[17 - i]
      ELSE CASE WHEN d[17 - i] * 2 > 9 THEN d[17 - i] * 2 - 9 ELSE d[17 - i] * 2 END END)) % 10 = 0 AS luhn_ok
    FROM (SELECT o_orderkey, list_transform(string_split('4242' || lpad(CAST(o_orderkey * 7919 + o_custkey AS VARCHAR), 12, '0'), ''),
      lambda c: CAST(c AS INTEGER)) AS d FROM orders)""",
)
def luhn_ok(spark, sf_dir):
    number = F.concat(
        F.lit("4242"), F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 12, "0")
    )
    return read_table(spark, sf_dir, "orders").select("o_orderkey", pii.luhn_ok(number).alias("luhn_ok"))


@query(
    "ssn_ok",
    r"""SELECT o_orderkey, regexp_matches(s, '^\d{3}-\d{2}-\d{4}$') AND split_part(s, '-', 1) NOT IN ('000', '666')
      AND NOT starts_with(s, '9') AND split_part(s, '-', 2) <> '00' AND split_part(s, '-', 3) <> '0000' AS ssn_ok
    FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0')
      || '-' || lpad(CAST(o_custkey * 3 % 10000 AS VARCHAR), 4, '0') AS s FROM orders)""",
)
def ssn_ok(spark, sf_dir):
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    ssn = F.concat_ws(
        "-", pad(F.col("o_orderkey") % 1000, 3), pad(F.col("o_custkey") % 100, 2), pad(F.col("o_custkey") * 3 % 10000, 4)
    )
    return read_table(spark, sf_dir, "orders").select("o_orderkey", pii.ssn_ok(ssn).alias("ssn_ok"))


@query(
    "valid_npi",
    """SELECT o_orderkey, (24 + list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN d[11 - i]
      ELSE CASE WHEN d[11 - i] * 2 > 9 THEN d[11 - i] * 2 - 9 ELSE d[11 - i] * 2 END END))) % 10 = 0 AS valid
    FROM (SELECT o_orderkey, list_transform(string_split(CAST(1000000000 + o_orderkey * 104729 % 1000000000 AS VARCHAR), ''),
      lambda c: CAST(c AS INTEGER)) AS d FROM orders)""",
)
def valid_npi(spark, sf_dir):
    npi = (F.lit(1000000000) + F.col("o_orderkey") * 104729 % 1000000000).cast("string")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", scalar.valid_npi(npi).alias("valid"))


@query("extract_names")
def extract_names(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return corpus.entity_mentions(corpus.extract_names(docs))


@query(
    "json_ops",
    """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""",
)
def json_ops(spark, sf_dir):
    props = F.from_json("props", "map<string,bigint>")
    return read_table(spark, sf_dir, "events").groupBy(props["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "args_hash",
    """SELECT event_id, substr(sha256('[{"key":"a","value":"' || event_type || '"},{"key":"b","value":"' || user_id || '"}]'), 1, 16) AS h FROM events""",
)
def args_hash(spark, sf_dir):
    args = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return read_table(spark, sf_dir, "events").select("event_id", scalar.args_hash(args).alias("h"))


@query(
    "criterion_match",
    f"""WITH crit AS (SELECT item_id, list_distinct({tokens_sql('text', tx.NOTE)}) AS c FROM (
        SELECT b.item_id || ':' || n AS item_id, string_split(text, '.')[n + 1] AS text
        FROM benchmark b, range(len(string_split(text, '.'))) r(n))),
    sent AS (SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS pos, s FROM (
        SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)),
        lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM conversations)),
    st AS (SELECT conv_id, turn, pos, list_distinct({tokens_sql('s[pos]', tx.NOTE)}) AS w FROM sent)
    SELECT item_id, conv_id, turn, min(pos) - 1 AS pos FROM st JOIN crit ON len(c) > 0 AND len(list_intersect(c, w)) / len(c) >= 0.6
    GROUP BY ALL""",
)
def criterion_match(spark, sf_dir):
    from opsloom.operators.retrieve import criterion_match as match

    # Every sentence of an item is a criterion of its own.
    sentences = read_table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("n", "criterion"))
    criteria = sentences.select(F.concat_ws(":", "item_id", "n").alias("item_id"), "criterion")
    notes = read_table(spark, sf_dir, "conversations")
    return match(notes, ["conv_id", "turn"], "text", criteria, "item_id", "criterion").select(
        "item_id", "conv_id", "turn", "pos"
    )
