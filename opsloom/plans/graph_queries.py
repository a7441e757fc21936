"""Graph queries over the supply graph: nations sell brands, brands come in types, types carry names."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import graph as gr
from opsloom.operators.modularity import _weighted_links, modular_communities, modularity
from opsloom.plans.catalog import query
from opsloom.session import cut_lineage
from opsloom.sources.tables import read_table


def _mentions(spark, sf_dir):
    """One relation mention per order line and link; the line's order is the chunk."""
    read = lambda name: read_table(spark, sf_dir, name)
    rows = (
        read("lineitem")
        .join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    link = lambda a, kind, b: F.struct(F.col(a).alias("source"), F.lit(kind).alias("type"), F.col(b).alias("target"))
    links = F.array(link("n_name", "sells", "p_brand"), link("p_brand", "made as", "p_type"), link("p_type", "named", "p_name"))
    return rows.select(
        F.col("l_orderkey").alias("chunk_id"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"),
        F.explode(links).alias("l"),
    ).select("l.*", "chunk_id", "seq", F.lit("").alias("description"))


MENTIONS_SQL = r"""
ment AS (SELECT l_orderkey AS chunk_id, l_orderkey * 16 + l_linenumber AS seq, unnest([
    {'s': n_name, 't': 'SELLS', 'g': p_brand}, {'s': p_brand, 't': 'MADE_AS', 'g': p_type}, {'s': p_type, 't': 'NAMED', 'g': p_name}]) AS l
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
rel AS (SELECT regexp_replace(lower(l.s), '[^\w\s-]', '', 'g') AS src, regexp_replace(lower(l.g), '[^\w\s-]', '', 'g') AS tgt, l.t AS type, chunk_id, seq FROM ment),
edges AS (SELECT src, tgt, type, CAST(count(*) AS DOUBLE) AS weight FROM rel WHERE src <> tgt AND src <> '' AND tgt <> '' GROUP BY ALL),
und AS (SELECT least(src, tgt) AS u, greatest(src, tgt) AS v, sum(weight) AS weight FROM edges GROUP BY ALL),
nb AS (SELECT u AS node, v AS nbr FROM und UNION SELECT v, u FROM und)"""


def _edges(spark, sf_dir):
    return gr.resolve_relations(_mentions(spark, sf_dir))


@query(
    "resolve_relations",
    "WITH " + MENTIONS_SQL + " SELECT src, tgt, type, weight FROM edges",
)
def resolve_relations(spark, sf_dir):
    return _edges(spark, sf_dir)[0].select("src", "tgt", "type", "weight")


def _name_mentions(spark, sf_dir):
    rows = _mentions(spark, sf_dir)
    note = lambda c: F.concat(F.col(c), F.lit(" #"), (F.col("seq") % 97).cast("string"))
    return rows.select(
        F.col("source").alias("name"), F.lit("concept").alias("type"), note("source").alias("description"), "chunk_id",
        (F.col("seq") * 4).alias("seq"),
    ).unionByName(
        rows.select(
            F.col("target").alias("name"), F.lit("concept").alias("type"), note("target").alias("description"), "chunk_id",
            (F.col("seq") * 4 + 1).alias("seq"),
        )
    )


@query(
    "resolve_entities",
    "WITH "
    + MENTIONS_SQL
    + r""", nm AS (SELECT l.s AS name, seq * 4 AS seq, chunk_id, l.s || ' #' || (seq % 97) AS d FROM ment
      UNION ALL SELECT l.g, seq * 4 + 1, chunk_id, l.g || ' #' || (seq % 97) FROM ment),
    k AS (SELECT regexp_replace(lower(name), '[^\w\s-]', '', 'g') AS key, * FROM nm)
    SELECT key, arg_min(name, seq) AS name, max(length(d)) AS longest, count(DISTINCT chunk_id) AS chunks FROM k WHERE key <> '' GROUP BY 1""",
)
def resolve_entities(spark, sf_dir):
    nodes, provenance = gr.resolve_entities(_name_mentions(spark, sf_dir))
    counts = provenance.groupBy("key").agg(F.count(F.lit(1)).alias("chunks"))
    return nodes.join(counts, "key").select(
        "key", "name", F.length("description").cast("bigint").alias("longest"), "chunks"
    )


@query(
    "upsert_graph",
    "WITH "
    + MENTIONS_SQL
    + """ SELECT src, tgt, type, sum(weight) AS weight FROM (SELECT * FROM edges UNION ALL
    SELECT tgt, src, type, weight FROM edges WHERE type = 'SELLS' UNION ALL SELECT src, tgt, type, weight FROM edges WHERE type = 'NAMED') GROUP BY ALL""",
)
def upsert_graph(spark, sf_dir):
    edges = _edges(spark, sf_dir)[0].select(*gr.EDGE_KEY, "weight", "description")
    back = edges.filter("type = 'SELLS'").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "type", "weight", "description")
    more = back.unionByName(edges.filter("type = 'NAMED'"))
    return gr.upsert_edges(edges, more).drop("description")


@query("collapse_edges", "WITH " + MENTIONS_SQL + " SELECT u, v, weight FROM und")
def collapse_edges(spark, sf_dir):
    return gr.collapse_edges(_edges(spark, sf_dir)[0])


@query(
    "weighted_degree",
    "WITH "
    + MENTIONS_SQL
    + """, deg AS (SELECT node, sum(weight) AS degree FROM (SELECT src AS node, weight FROM edges UNION ALL SELECT tgt, weight FROM edges) GROUP BY 1),
    top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 12)
    SELECT src, tgt, type, weight FROM edges WHERE src IN (SELECT node FROM top) AND tgt IN (SELECT node FROM top)""",
)
def weighted_degree(spark, sf_dir):
    return gr.top_subgraph(_edges(spark, sf_dir)[0], 12)[1].select("src", "tgt", "type", "weight")


def _region_seeds(spark, sf_dir):
    nations = read_table(spark, sf_dir, "nation").join(
        read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return nations.select(F.col("r_name").alias("query_id"), F.lower("n_name").alias("node"))


@query(
    "k_hop_neighborhood",
    "WITH "
    + MENTIONS_SQL
    + """, d0 AS (SELECT DISTINCT r_name AS q, lower(n_name) AS node, 0 AS d FROM nation JOIN region ON n_regionkey = r_regionkey
      WHERE lower(n_name) IN (SELECT node FROM nb)),
    d1 AS (SELECT q, node, min(d) AS d FROM (SELECT * FROM d0 UNION ALL SELECT q, nbr, 1 FROM d0 JOIN nb USING (node)) GROUP BY ALL),
    d2 AS (SELECT q, node, min(d) AS d FROM (SELECT * FROM d1 UNION ALL SELECT q, nbr, d + 1 FROM d1 JOIN nb USING (node)) GROUP BY ALL),
    s AS (SELECT a.q AS query_id, src, tgt, type, weight / (1 + least(a.d, b.d)) AS score FROM edges JOIN d2 a ON a.node = src
      JOIN d2 b ON b.node = tgt AND b.q = a.q)
    SELECT query_id, src, tgt, type, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, tgt, type) <= 25""",
)
def k_hop_neighborhood(spark, sf_dir):
    edges = cut_lineage(_edges(spark, sf_dir)[0].select(*gr.EDGE_KEY, "weight"))
    out = gr.k_hop_neighborhood(_region_seeds(spark, sf_dir), edges, 2, 25)
    return out.select("query_id", "src", "tgt", "type", F.round("score", 4).alias("score"))


def _weighted(spark, sf_dir):
    return cut_lineage(_edges(spark, sf_dir)[0].select(*gr.EDGE_KEY, "weight"))


@query("communities")
def communities(spark, sf_dir):
    return modular_communities(_weighted(spark, sf_dir))


# The modularity of the partition into kinds of nodes: fixed by the edges, so SQL can say it.
@query(
    "modularity",
    "WITH " + MENTIONS_SQL + """, ends AS (SELECT u AS node, v AS nbr, weight FROM und UNION ALL SELECT v, u, weight FROM und),
    lab AS (SELECT node, substr(node, 1, 1) AS label FROM (SELECT DISTINCT node FROM ends)),
    per AS (SELECT a.label, sum(weight) AS degree, sum(CASE WHEN a.label = b.label THEN weight ELSE 0 END) AS inside
      FROM ends JOIN lab a ON a.node = ends.node JOIN lab b ON b.node = ends.nbr GROUP BY 1)
    SELECT count(*) AS communities, round(sum(inside) / sum(degree) - sum(degree * degree) / (sum(degree) * sum(degree)), 9) AS modularity FROM per""",
)
def modularity_query(spark, sf_dir):
    links = _weighted_links(_weighted(spark, sf_dir))
    labels = cut_lineage(links.select("node").distinct().withColumn("label", F.substring("node", 1, 1)))
    value = modularity(links, labels)
    return labels.agg(F.countDistinct("label").alias("communities")).withColumn("modularity", F.round(F.lit(value), 9))


@query("community_inputs")
def community_inputs(spark, sf_dir):
    nodes, provenance = gr.resolve_entities(_name_mentions(spark, sf_dir))
    edges = _weighted(spark, sf_dir)
    members = gr.community_members(modular_communities(edges), provenance, nodes, top=20)
    return gr.community_facts(cut_lineage(members), edges).select("community", "src", "tgt", "type", "rank")


@query("save_communities")
def save_communities(spark, sf_dir):
    return gr.membership_edges(modular_communities(_weighted(spark, sf_dir)))


# A nation sells brands and a brand comes in types, so every such path has two links.
@query(
    "shortest_paths",
    "WITH " + MENTIONS_SQL + """, d AS (SELECT DISTINCT lower(n_name) AS start, lower(p_type) AS goal FROM lineitem JOIN part ON l_partkey = p_partkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
    SELECT start, goal, min(start || '>' || a.nbr || '>' || goal) AS path FROM d JOIN nb a ON a.node = start
    JOIN nb b ON b.node = a.nbr AND b.nbr = goal GROUP BY ALL""",
)
def shortest_paths(spark, sf_dir):
    """How the nations reach the part types their suppliers deliver."""
    read = lambda name: read_table(spark, sf_dir, name)
    delivered = (
        read("lineitem")
        .join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.lower("n_name").alias("start"), F.lower("p_type").alias("goal"))
        .distinct()
    )
    paths = gr.shortest_paths(_weighted(spark, sf_dir), delivered)
    return paths.select("start", "goal", F.array_join("path", ">").alias("path"))


@query(
    "cooccurrence_edges",
    """WITH n AS (SELECT DISTINCT l_orderkey AS g, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT a.b AS u, c.b AS v, count(*) AS weight FROM n a JOIN n c ON a.g = c.g AND a.b < c.b GROUP BY ALL""",
)
def cooccurrence_edges(spark, sf_dir):
    """Brands bought in the same order; an order holds at most the 25 brands there are."""
    rows = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return gr.cooccurrence_edges(rows.select(F.col("l_orderkey").alias("group_id"), F.col("p_brand").alias("name")))


@query(
    "link_entities",
    r"""WITH k AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^\w\s-]', '', 'g') AS key FROM part UNION SELECT DISTINCT lower(p_type) FROM part),
    q AS (SELECT p_partkey AS query_id, string_split(trim(lower('the ' || p_name || ' of ' || p_type)), ' ') AS w FROM part),
    g AS (SELECT query_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key FROM (
      SELECT query_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM q, (VALUES (1), (2), (3), (4)) t(n) WHERE len(w) >= n)),
    f AS (SELECT query_id, key, min((4 - n) * CAST(1000000000 AS BIGINT) + i) AS pos FROM g JOIN k USING (key) WHERE length(key) >= 3 GROUP BY ALL)
    SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY pos, key) AS rank FROM f
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, key) <= 6""",
)
def link_entities(spark, sf_dir):
    from opsloom.functions.text import normalize_entity_name

    part = read_table(spark, sf_dir, "part")
    keys = part.select(normalize_entity_name(F.col("p_name")).alias("key")).union(part.select(F.lower("p_type"))).distinct()
    text = F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_type")
    return gr.link_entities(part.select(F.col("p_partkey").alias("query_id"), text.alias("text")), keys)


@query(
    "explore_entity",
    r"""SELECT 'suggestion' AS kind, key AS src FROM (SELECT DISTINCT regexp_replace(lower(p_brand), '[^\w\s-]', '', 'g') AS key FROM part)
    WHERE contains(key, 'brand') ORDER BY key LIMIT 10""",
)
def explore_entity(spark, sf_dir):
    """No node is called 'brand', so the brands themselves are suggested."""
    nodes, _ = gr.resolve_entities(_name_mentions(spark, sf_dir))
    edges = _edges(spark, sf_dir)[0].select(*gr.EDGE_KEY, "weight")
    return gr.explore_entity("Brand", nodes, edges).select("kind", "src")


@query(
    "provenance_join",
    "WITH "
    + MENTIONS_SQL
    + """, f AS (SELECT src, tgt, type, weight, row_number() OVER (PARTITION BY type ORDER BY weight DESC, src, tgt) AS r FROM edges
      QUALIFY row_number() OVER (PARTITION BY type ORDER BY weight DESC, src, tgt) <= 5),
    c AS (SELECT f.type AS query_id, chunk_id, min(r * 1000000000000000 + p) AS place FROM f JOIN (
      SELECT src, tgt, type, chunk_id, min(seq) AS p FROM rel GROUP BY ALL) USING (src, tgt, type) GROUP BY ALL)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id) AS rank FROM c""",
)
def provenance_join(spark, sf_dir):
    """Orders behind the five heaviest links of each kind."""
    from opsloom.operators.retrieve import provenance_chunks, top_per_query

    edges, provenance = _edges(spark, sf_dir)
    facts = top_per_query(
        edges.select(*gr.EDGE_KEY, "weight").withColumn("query_id", F.col("type")), 5, F.desc("weight"), "src", "tgt"
    )
    return provenance_chunks(facts, provenance, gr.EDGE_KEY)


@query(
    "graph_stats",
    "WITH "
    + MENTIONS_SQL
    + """ SELECT 'relations' AS "table", count(*) AS rows FROM edges UNION ALL SELECT 'entities', count(DISTINCT node) FROM nb
    UNION ALL SELECT 'documents', count(*) FROM documents""",
)
def graph_stats(spark, sf_dir):
    edges = _edges(spark, sf_dir)[0]
    nodes = edges.select("src").union(edges.select("tgt")).distinct()
    return gr.graph_stats({"relations": edges, "entities": nodes, "documents": read_table(spark, sf_dir, "documents")})


@query(
    "topics",
    "SELECT string_agg(source, '; ' ORDER BY source) AS topics FROM (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 12)",
)
def topics(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("source").alias("title"))
    none = docs.filter("false").withColumn("position", F.lit(1))
    return gr.topics(none, docs)


@query(
    "ordered_distinct_union",
    """SELECT o_orderkey, CASE WHEN a = b THEN a ELSE a || ',' || b END AS merged FROM (
    SELECT o_orderkey, o_orderstatus AS a, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS b FROM orders)""",
)
def ordered_distinct_union(spark, sf_dir):
    b = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))
    merged = gr.ordered_distinct_union(F.array("o_orderstatus"), F.array(b))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(merged, ",").alias("merged"))
