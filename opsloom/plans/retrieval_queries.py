"""Retrieval queries: benchmark passages as questions over all documents, label centroids over all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.scalar import checksum
from opsloom.functions.text import QUESTION
from opsloom.operators import graph as gr
from opsloom.operators import retrieve as rt
from opsloom.plans.catalog import query
from opsloom.plans.text_queries import tokens_sql
from opsloom.session import cut_lineage
from opsloom.sources import corpus
from opsloom.sources.sinks import replace_document
from opsloom.sources.tables import read_table


def _centroids(vectors):
    """One query vector per label: the mean of its embeddings."""
    return (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(F.col("label").cast("bigint").alias("query_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("embedding"))
    )


CENTROIDS_SQL = """
cent AS (SELECT label AS query_id, list(x ORDER BY i) AS c FROM (
  SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  GROUP BY ALL) GROUP BY 1),
sims AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS score FROM embeddings, cent)"""


@query(
    "vector_top_k",
    f"""WITH {CENTROIDS_SQL} SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sims
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
)
def vector_top_k(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    out = rt.vector_top_k(vectors, _centroids(vectors), 10, "vec_id")
    return out.withColumn("score", F.round("score", 6))


@query(
    "dense_search",
    f"""WITH {CENTROIDS_SQL} SELECT CAST(query_id AS BIGINT) AS query_id, id, e.label AS label, s.score >= 0.35 AS linked FROM (
    SELECT query_id, id, round(score, 9) AS score FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20) s
    JOIN embeddings e ON e.vec_id = s.id""",
)
def dense_search(spark, sf_dir):
    """Vector search with payload: the label of each hit and whether it passes the linking threshold."""
    vectors = read_table(spark, sf_dir, "embeddings")
    hits = rt.vector_top_k(vectors, _centroids(vectors), 20, "vec_id")
    payload = vectors.select(F.col("vec_id").alias("id"), "label")
    return hits.join(payload, "id").select("query_id", "id", "label", (F.round("score", 9) >= 0.35).alias("linked"))


BM25_SQL = f"""
toks AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT doc_id, len({tokens_sql('text')}) AS dl FROM documents),
sz AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, sz),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
qf AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, tf.doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qf JOIN idf ON qf.term = idf.term JOIN tf ON tf.term = qf.term JOIN dl ON dl.doc_id = tf.doc_id, sz GROUP BY ALL HAVING score > 0)"""


def _questions(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25_score", f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 5) AS score FROM bm")
def bm25_score(spark, sf_dir):
    scores = rt.bm25_scores(read_table(spark, sf_dir, "documents"), _questions(spark, sf_dir), "doc_id", "text", "text")
    return scores.withColumn("score", F.round("score", 5))


@query(
    "bm25_top_k",
    f"""WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 5) AS score FROM bm
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20""",
)
def bm25_top_k(spark, sf_dir):
    scores = rt.bm25_scores(read_table(spark, sf_dir, "documents"), _questions(spark, sf_dir), "doc_id", "text", "text")
    ranked = rt.top_per_query(scores.withColumn("score", F.round("score", 9)), 20, F.desc("score"), "doc_id")
    return ranked.select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query(
    "overlap_rerank",
    f"""WITH {BM25_SQL}, cand AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS pos FROM bm
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20),
    t AS (SELECT query_id, c.doc_id, pos, list_distinct({tokens_sql('b.text')}) AS q, {tokens_sql('d.text')} AS t
      FROM cand c JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = c.doc_id),
    s AS (SELECT query_id, doc_id, pos, round(len(list_intersect(q, list_distinct(t))) / len(q)
      + len(list_filter(t, lambda w: list_contains(q, w))) / (len(t) + 10), 4) AS rerank_score FROM t)
    SELECT query_id, doc_id, rerank_score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pos) <= 6""",
)
def overlap_rerank(spark, sf_dir):
    docs, asked = read_table(spark, sf_dir, "documents"), _questions(spark, sf_dir)
    scores = rt.bm25_scores(docs, asked, "doc_id", "text", "text").withColumn("score", F.round("score", 9))
    candidates = rt.top_per_query(scores, 20, F.desc("score"), "doc_id").withColumnRenamed("rank", "pos")
    joined = candidates.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").join(
        asked.withColumnRenamed("text", "question"), "query_id"
    )
    return rt.overlap_rerank(joined, "question", "body", 6, "pos").select("query_id", "doc_id", "rerank_score")


@query(
    "jaccard_top_k",
    f"""WITH q AS (SELECT item_id, list_distinct({tokens_sql('text', QUESTION)}) AS t FROM benchmark),
    e AS (SELECT doc_id, list_distinct({tokens_sql('text', QUESTION)}) AS t FROM documents),
    s AS (SELECT item_id AS query_id, doc_id AS example_id, CASE WHEN len(q.t) + len(e.t) = 0 THEN 0 ELSE
      len(list_intersect(q.t, e.t)) / (len(q.t) + len(e.t) - len(list_intersect(q.t, e.t))) END AS score FROM q, e)
    SELECT query_id, example_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) <= 5""",
)
def jaccard_top_k(spark, sf_dir):
    examples = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), "text")
    out = rt.jaccard_top_k(_questions(spark, sf_dir), examples, 5)
    return out.withColumn("score", F.round("score", 6))


@query(
    "few_shot_records",
    f"""WITH tr AS (SELECT conv_id * 1000 + turn AS id, text AS question, role AS sql, list_distinct({tokens_sql('text', QUESTION)}) AS t FROM conversations),
    s AS (SELECT q.id, e.question, e.sql, e.id AS eid, len(list_intersect(q.t, e.t)) / (len(q.t) + len(e.t) - len(list_intersect(q.t, e.t))) AS score
      FROM tr q JOIN tr e ON q.sql <> e.sql WHERE len(list_intersect(q.t, e.t)) > 0),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, eid) <= 3)
    SELECT id, coalesce(c, 0) AS shots, d AS digest FROM tr LEFT JOIN (
      SELECT id, count(*) AS c, md5(string_agg(eid || ':' || sql, ',' ORDER BY score DESC, eid)) AS d FROM k GROUP BY 1) USING (id)""",
)
def few_shot_records(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    train = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), F.col("role").alias("sql")
    )
    records = rt.few_shot_records(train, 3)
    # The JSON carries the texts; ids and roles of the shots are read back for a compact comparison.
    shots = F.from_json("shots", "array<struct<question:string,sql:string>>")
    ids = train.select(F.col("id").alias("eid"), F.md5("question").alias("h"), "sql")
    spread = records.select("id", F.posexplode_outer(shots).alias("p", "s")).select(
        "id", "p", F.md5("s.question").alias("h"), F.col("s.sql").alias("sql")
    )
    first = ids.groupBy("h", "sql").agg(F.min("eid").alias("eid"))
    named = spread.join(first, ["h", "sql"], "left").groupBy("id").agg(
        F.count("p").alias("shots"),
        F.array_sort(F.collect_list(F.struct("p", F.concat_ws(":", "eid", "sql").alias("x")))).alias("l"),
    )
    digest = F.md5(F.array_join(F.transform("l", lambda e: e["x"]), ","))
    return named.select("id", "shots", F.when(F.col("shots") > 0, digest).alias("digest"))


RANKINGS_SQL = f"""{BM25_SQL},
a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank FROM bm JOIN documents USING (doc_id)),
lists AS (SELECT 'bm25' AS list, * FROM a WHERE rank <= 20 UNION ALL SELECT 'long', * FROM b WHERE rank <= 20)"""


def _two_rankings(spark, sf_dir):
    """Two rankings of the matching documents of each question: by BM25 and by length, 20 each."""
    docs = read_table(spark, sf_dir, "documents")
    scores = rt.bm25_scores(docs, _questions(spark, sf_dir), "doc_id", "text", "text").withColumn("score", F.round("score", 9))
    a = rt.rank_lists(scores, ["query_id"], "score", "doc_id").filter("rank <= 20")
    # Scores lie by document already: the documents' lengths come to them.
    sized = scores.join(docs.select("doc_id", "n_chars").hint("shuffle_hash"), "doc_id")
    b = rt.rank_lists(sized, ["query_id"], "n_chars", "doc_id").filter("rank <= 20")
    pick = lambda df, name: df.select(F.lit(name).alias("list"), "query_id", "doc_id", "rank")
    return pick(a, "bm25").unionByName(pick(b, "long"))


@query("rank_lists", f"WITH {RANKINGS_SQL} SELECT list, query_id, doc_id, rank FROM lists")
def rank_lists(spark, sf_dir):
    return _two_rankings(spark, sf_dir)


@query(
    "reciprocal_rank_fusion",
    f"WITH {RANKINGS_SQL} SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY ALL",
)
def reciprocal_rank_fusion(spark, sf_dir):
    fused = rt.reciprocal_rank_fusion(_two_rankings(spark, sf_dir), ["query_id"], "doc_id")
    return fused.withColumn("score", F.round("score", 9))


@query(
    "keep_best_score",
    f"""WITH {RANKINGS_SQL}, s AS (SELECT doc_id, query_id, 1.0 / rank AS score, query_id * 100 + rank * 2 + (list = 'long')::INT AS seq FROM lists)
    SELECT doc_id, round(max(score), 6) AS score, min(seq) AS first_seen FROM s GROUP BY 1""",
)
def keep_best_score(spark, sf_dir):
    """Candidate lists of all questions merged: the best score of each document stays."""
    seq = F.col("query_id") * 100 + F.col("rank") * 2 + (F.col("list") == "long").cast("bigint")
    rows = _two_rankings(spark, sf_dir).select("doc_id", (F.lit(1.0) / F.col("rank")).alias("score"), seq.alias("seq"))
    best = rt.keep_best_score(rows, ["doc_id"], "score", "seq")
    return best.select("doc_id", F.round("score", 6).alias("score"), "first_seen")


@query(
    "lookup_by_rank",
    f"WITH {RANKINGS_SQL} SELECT query_id, rank, doc_id, lang, source FROM a JOIN documents USING (doc_id) WHERE rank <= 20",
)
def lookup_by_rank(spark, sf_dir):
    ranked = _two_rankings(spark, sf_dir).filter("list = 'bm25'").select("query_id", "rank", "doc_id")
    return rt.lookup_by_rank(ranked, read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


@query(
    "multi_query_merge",
    f"""WITH {RANKINGS_SQL}, s AS (SELECT query_id // 4 AS topic, doc_id, 1.0 / rank AS score, query_id * 100 + rank AS seq FROM a WHERE rank <= 20)
    SELECT topic, doc_id, round(max(score), 6) AS score, min(seq) AS first_seen FROM s GROUP BY ALL""",
)
def multi_query_merge(spark, sf_dir):
    """Four neighbouring passages act as the sub-questions of one topic."""
    ranked = _two_rankings(spark, sf_dir).filter("list = 'bm25'")
    rows = ranked.select(
        F.floor(F.col("query_id") / 4).alias("topic"), "doc_id", (F.lit(1.0) / F.col("rank")).alias("score"),
        (F.col("query_id") * 100 + F.col("rank")).alias("seq"),
    )
    best = rt.keep_best_score(rows, ["topic", "doc_id"], "score", "seq")
    return best.select("topic", "doc_id", F.round("score", 6).alias("score"), "first_seen")


@query(
    "hash_embed",
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {tokens_sql('text')} AS t FROM conversations),
    f AS (SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) AS f FROM t),
    v AS (SELECT id, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % 512 AS idx,
      sum(CASE WHEN CAST('0x' || substr(md5(f), 9, 2) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM f GROUP BY ALL HAVING v <> 0)
    SELECT id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM v""",
)
def hash_embed(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rt.hash_embed_entries(turns, "id", "text").withColumn("value", F.round("value", 6))


def _stored_documents(spark, sf_dir):
    """The state before this ingest: documents in English were stored, those from src1 in an older form."""
    docs = read_table(spark, sf_dir, "documents")
    old = F.when(F.col("source") == "src1", F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    return docs.filter("lang = 'en'").select("doc_id", checksum(old).alias("checksum"))


@query(
    "incremental_ingest",
    """SELECT CASE WHEN lang <> 'en' THEN 'new' WHEN source = 'src1' THEN 'changed' ELSE 'unchanged' END AS action, count(*) AS documents
    FROM documents GROUP BY 1""",
)
def incremental_ingest(spark, sf_dir):
    incoming = read_table(spark, sf_dir, "documents").select("doc_id", checksum(F.col("text")).alias("checksum"))
    plan = rt.incremental_plan(incoming, _stored_documents(spark, sf_dir))
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "replace_document",
    """WITH c AS (SELECT doc_id, lang, source, text, unnest(range(0, greatest(length(text) - 150, 1), 1050)) // 1050 AS position FROM documents),
    new AS (SELECT doc_id, unnest(range(0, greatest(length(text) - 50, 1), 350)) // 350 AS position FROM documents WHERE source = 'src1')
    SELECT doc_id, CAST(position AS INTEGER) AS position FROM c WHERE source <> 'src1' UNION ALL SELECT doc_id, CAST(position AS INTEGER) FROM new""",
)
def replace_document_query(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    stored = corpus.fixed_chunks(docs).select("doc_id", "position")
    again = docs.filter("source = 'src1'")
    fresh = corpus.fixed_chunks(again, 400, 50).select("doc_id", "position")
    return replace_document(stored, fresh, again)


@query(
    "left_join_count",
    """SELECT source, count(i) AS chunks FROM (SELECT source, CASE WHEN lang = 'en' THEN
      unnest(range(0, greatest(length(text) - 150, 1), 1050)) END AS i FROM documents) GROUP BY 1""",
)
def left_join_count(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    chunks = corpus.fixed_chunks(docs.filter("lang = 'en'")).select("doc_id", "position")
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(per_doc, "doc_id", "left").groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


@query(
    "score_catalog",
    f"""WITH cat AS (SELECT DISTINCT p_brand AS table_name, 'name' AS kind, lower(p_type) AS item FROM part
      UNION SELECT DISTINCT p_brand, 'description', p_name FROM part),
    q AS (SELECT p_partkey AS question_id, list_distinct({tokens_sql("'show me the ' || p_name || ' in ' || p_type || ' per brand'", QUESTION)}) AS qt FROM part),
    qw AS (SELECT question_id, unnest(qt) AS w FROM q),
    cw AS (SELECT table_name, kind, item, unnest(list_distinct({tokens_sql('item', QUESTION)})) AS w FROM cat),
    h AS (SELECT question_id, table_name, kind, item, count(*) AS c FROM qw JOIN cw USING (w) GROUP BY ALL),
    s AS (SELECT question_id, table_name, sum(CASE WHEN kind = 'name' THEN 3.0 ELSE 0.5 * c END) AS score FROM h GROUP BY ALL)
    SELECT question_id, table_name, CAST(score AS DOUBLE) AS score FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, table_name) <= 5""",
)
def score_catalog(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    catalog = part.select(
        F.col("p_brand").alias("table_name"), F.lit("name").alias("kind"), F.lower("p_type").alias("text")
    ).union(part.select("p_brand", F.lit("description"), "p_name")).distinct()
    question = F.concat(F.lit("show me the "), "p_name", F.lit(" in "), "p_type", F.lit(" per brand"))
    questions = part.select(F.col("p_partkey").alias("question_id"), question.alias("text"))
    return rt.score_catalog(questions, catalog).drop("rank")


def _chunk_graph(spark, sf_dir):
    """Chunks of all documents with the name graph extracted from them."""
    docs = read_table(spark, sf_dir, "documents").withColumn("title", F.col("source"))
    chunks = cut_lineage(corpus.chunk_documents(docs))
    extracted = cut_lineage(corpus.extract_names(chunks.select("chunk_id", "text")))
    seq = F.xxhash64("chunk_id")
    names = corpus.entity_mentions(extracted).select(
        "name", F.lit("CONCEPT").alias("type"),
        F.concat(F.lit("Mentioned "), F.col("mentions").cast("string"), F.lit("x in source.")).alias("description"),
        "chunk_id", seq.alias("seq"),
    )
    pairs = corpus.relation_mentions(extracted).withColumn("seq", seq)
    nodes, _ = gr.resolve_entities(names)
    edges, provenance = gr.resolve_relations(pairs)
    return chunks, cut_lineage(nodes), cut_lineage(edges), cut_lineage(provenance)


def _hybrid(spark, sf_dir):
    chunks, nodes, edges, provenance = _chunk_graph(spark, sf_dir)
    asked = _questions(spark, sf_dir)
    body = F.concat_ws(" ", "title", "section", "text")
    sparse = rt.bm25_top_k(chunks.withColumn("body", body), asked, "chunk_id", "body", "text", 20)
    vectors = rt.hash_embed(chunks, "chunk_id", "text")
    questions = rt.hash_embed(asked, "query_id", "text")
    dense = rt.vector_top_k(vectors, questions, 20, "chunk_id").withColumnRenamed("id", "chunk_id")
    linked = cut_lineage(gr.link_entities(asked, nodes))
    context, facts = gr.graph_context(linked, nodes, edges)
    cited = rt.provenance_chunks(facts, provenance, gr.EDGE_KEY)
    local = rt.hybrid_local(asked, chunks, dense, sparse, cited)
    return asked, chunks, edges, context, local


@query("hybrid_local")
def hybrid_local(spark, sf_dir):
    return _hybrid(spark, sf_dir)[4]


@query("graph_context")
def graph_context(spark, sf_dir):
    return _hybrid(spark, sf_dir)[3]


@query("global_search")
def global_search(spark, sf_dir):
    """Communities of the name graph as documents: best four per question, then three local chunks."""
    asked, _, edges, _, local = _hybrid(spark, sf_dir)
    members = gr.communities(edges, min_size=2)
    texts = members.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("node")), " ").alias("text"))
    vectors = rt.hash_embed(texts, "community", "text")
    hits = rt.vector_top_k(vectors, rt.hash_embed(asked, "query_id", "text"), 4, "community")
    return rt.union_contexts(hits, local)


@query(
    "union_contexts",
    f"""WITH {CENTROIDS_SQL}, {BM25_SQL}, c AS (SELECT query_id, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank,
      'community:' || id AS context_id, 'community' AS kind FROM sims),
    l AS (SELECT query_id, 1 AS part, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank,
      CAST(doc_id AS VARCHAR) AS context_id, 'chunk' AS kind FROM bm)
    SELECT CAST(query_id AS BIGINT) AS query_id, part, rank, context_id, kind FROM c WHERE rank <= 4
    UNION ALL SELECT query_id, part, rank, context_id, kind FROM l WHERE rank <= 3""",
)
def union_contexts(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    hits = rt.vector_top_k(vectors, _centroids(vectors), 4, "vec_id")
    scores = rt.bm25_scores(read_table(spark, sf_dir, "documents"), _questions(spark, sf_dir), "doc_id", "text", "text")
    local = rt.top_per_query(scores.withColumn("score", F.round("score", 9)), 6, F.desc("score"), "doc_id")
    local = local.select("query_id", F.col("doc_id").alias("chunk_id"), "rank", F.col("score").alias("rerank_score"))
    return rt.union_contexts(hits, local).drop("score")


@query("relevant_sections")
def relevant_sections(spark, sf_dir):
    """Documents as policy sections, conversations as claims whose notes are all assistant turns."""
    docs = read_table(spark, sf_dir, "documents")
    sections = docs.select(F.col("doc_id").cast("string").alias("section_id"), F.col("source").alias("title"), "text")
    turns = read_table(spark, sf_dir, "conversations")
    findings = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("claim_id"), F.lit("coding").alias("reviewer"),
        F.col("conv_id").cast("string").alias("policy_section"), F.col("turn").alias("seq"), F.col("text").alias("message"),
    )
    notes = turns.filter("role = 'assistant'").groupBy(F.col("conv_id").alias("claim_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " ").alias("clinical_note")
    )
    return rt.relevant_sections(findings, notes, sections, head=None)
