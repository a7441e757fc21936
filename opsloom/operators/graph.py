"""Property graphs as node and edge tables.

Provenance is kept as rows (key, chunk) rather than as one array per node, so a node mentioned by a
third of all chunks is just a frequent value, not an unbounded cell.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.text import normalize_entity_name
from opsloom.session import cut_lineage, stored

EDGE_KEY = ["src", "tgt", "type"]


def _longest(text: str, seq: str) -> Column:
    """Longest value, the first one among equals."""
    return F.max_by(text, F.struct(F.length(text), -F.col(seq)))


def resolve_entities(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, provenance) from mentions (name, type, description, chunk_id, seq)."""
    # Spellings are merged on the map side first (by hash: the buffer holds one number); names are
    # normalised once per spelling.
    spelled = mentions.groupBy("name", "type", "description").agg(F.min("seq").alias("seq")).filter("seq IS NOT NULL")
    # The conditions name the aggregate, so that they stay above it and no name is normalised twice.
    named = F.when(F.col("seq").isNotNull(), F.col("key") != "")
    nodes = spelled.withColumn("key", normalize_entity_name(F.col("name"))).groupBy("key").agg(
        F.min_by(F.trim("name"), "seq").alias("name"),
        F.min_by(F.upper("type"), "seq").alias("type"),
        _longest("description", "seq").alias("description"),
        F.min("seq").alias("seq"),
    ).filter(named)
    # Places are looked for where the chunk lies, which bounds them.
    seen = mentions.select("name", "chunk_id", "seq").repartition("chunk_id").groupBy("name", "chunk_id").agg(F.min("seq").alias("pos"))
    provenance = (
        seen.filter("pos IS NOT NULL")
        .withColumn("key", normalize_entity_name(F.col("name")))
        .groupBy("key", "chunk_id")
        .agg(F.min("pos").alias("pos"))
        .filter(F.when(F.col("pos").isNotNull(), F.col("key") != ""))
    )
    return nodes, provenance


def resolve_relations(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, provenance) from mentions (source, target, type, description, chunk_id, seq).

    Weight counts the mentions; self-loops and empty keys are dropped after normalising.
    """
    spelling = ["source", "target", "type"]

    def keyed(rows: DataFrame) -> DataFrame:
        names = {
            "src": normalize_entity_name(F.col("source")),
            "tgt": normalize_entity_name(F.col("target")),
            "type": F.replace(F.upper("type"), F.lit(" "), F.lit("_")),
        }
        return rows.withColumns(names)

    def proper(aggregate: str) -> Column:
        # The condition names the aggregate, so that it stays above it and no name is normalised twice.
        names = (F.col("src") != "") & (F.col("tgt") != "") & (F.col("src") != F.col("tgt"))
        return F.when(F.col(aggregate).isNotNull(), names)

    spelled = mentions.groupBy(*spelling, "description").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq")
    )
    edges = (
        keyed(spelled.filter("seq IS NOT NULL"))
        .groupBy(*EDGE_KEY)
        .agg(
            F.sum("n").cast("double").alias("weight"),
            F.min_by("description", "seq").alias("description"),
            F.min_by(F.trim("source"), "seq").alias("source"),
            F.min_by(F.trim("target"), "seq").alias("target"),
            F.min("seq").alias("seq"),
        )
        .filter(proper("seq"))
    )
    # Places are looked for where the chunk lies, which bounds them.
    cited = mentions.select(*spelling, "chunk_id", "seq").repartition("chunk_id").groupBy(*spelling, "chunk_id").agg(F.min("seq").alias("pos"))
    provenance = keyed(cited.filter("pos IS NOT NULL")).groupBy(*EDGE_KEY, "chunk_id").agg(F.min("pos").alias("pos")).filter(proper("pos"))
    return edges, provenance


def upsert_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by key: first name, longest description, CONCEPT upgraded to the first better type."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    order = F.struct("_side", "seq")
    typed = F.when(F.col("type") != "CONCEPT", order)
    return both.groupBy("key").agg(
        F.min_by("name", order).alias("name"),
        F.coalesce(F.min_by("type", typed), F.lit("CONCEPT")).alias("type"),
        F.max_by("description", F.struct(F.length("description"), -F.col("_side"), -F.col("seq"))).alias("description"),
        F.min_by("seq", order).alias("seq"),
    )


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by (src, tgt, type): weights add up, the longest description stays."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    both = both.filter("src <> '' AND tgt <> '' AND src <> tgt")
    return both.groupBy(*EDGE_KEY).agg(
        F.sum("weight").alias("weight"),
        F.max_by("description", F.struct(F.length("description"), -F.col("_side"))).alias("description"),
    )


def endpoint_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that edges name but the node table lacks, as plain concepts."""
    ends = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("tgt").alias("key"))).distinct()
    return ends.join(nodes.select("key"), "key", "left_anti").select(
        "key",
        F.col("key").alias("name"),
        F.lit("CONCEPT").alias("type"),
        F.lit("").alias("description"),
        F.lit(0).cast("bigint").alias("seq"),
    )


def merge_provenance(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two provenance tables that keeps each chunk at its first place (stored ones first)."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    first = both.groupBy(*keys, "chunk_id").agg(F.min(F.struct("_side", "pos")).alias("_f"))
    late = F.lit(2**40)  # places every incoming chunk behind the stored ones
    return first.select(*keys, "chunk_id", (F.col("_f.pos") + F.col("_f._side") * late).alias("pos"))


def ordered_distinct_union(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def collapse_edges(edges: DataFrame) -> DataFrame:
    """Directed multi-edges to undirected weighted edges (u < v)."""
    return (
        edges.filter("src <> tgt")
        .groupBy(F.least("src", "tgt").alias("u"), F.greatest("src", "tgt").alias("v"))
        .agg(F.sum("weight").alias("weight"))
    )


def _both_ways(undirected: DataFrame) -> DataFrame:
    return undirected.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "weight").unionByName(
        undirected.select(F.col("v").alias("node"), F.col("u").alias("nbr"), "weight")
    )


def weighted_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("tgt").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("degree"))


def top_subgraph(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) induced by the n nodes of largest weighted degree."""
    top = weighted_degree(edges).orderBy(F.desc("degree"), "node").limit(n)
    inner = edges.join(top.select(F.col("node").alias("src")), "src", "left_semi").join(
        top.select(F.col("node").alias("tgt")), "tgt", "left_semi"
    )
    return top, inner


def reach(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(query_id, node, depth): undirected breadth-first search from the seeds of every query."""
    links = _both_ways(collapse_edges(edges.withColumn("weight", F.lit(1.0)))).select("node", "nbr")
    known_nodes = links.select("node").distinct()
    seen = seeds.select("query_id", "node").distinct().join(known_nodes, "node", "left_semi").select(
        "query_id", "node", F.lit(0).alias("depth")
    )
    frontier = seen
    for depth in range(1, hops + 1):
        fresh = (
            frontier.join(links, "node")
            .select("query_id", F.col("nbr").alias("node"))
            .distinct()
            .join(seen, ["query_id", "node"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        if depth % 2 == 0:
            fresh = cut_lineage(fresh)
        seen, frontier = seen.unionByName(fresh), fresh
    return seen


def k_hop_neighborhood(seeds: DataFrame, edges: DataFrame, hops: int, limit: int) -> DataFrame:
    """Edges with both ends within `hops` of a query's seeds, nearest and heaviest first."""
    depths = reach(seeds, edges, hops)
    u = depths.select("query_id", F.col("node").alias("src"), F.col("depth").alias("du"))
    v = depths.select("query_id", F.col("node").alias("tgt"), F.col("depth").alias("dv"))
    inside = edges.join(u, "src").join(v, ["query_id", "tgt"])
    scored = inside.withColumn("score", F.col("weight") / (1 + F.least("du", "dv"))).drop("du", "dv")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "src", "tgt", "type")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= limit)


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(start, goal, path) over undirected (src, tgt) edges; unreachable pairs give no row.

    All pairs with the same start share one search; of equally short paths the least one is kept.
    """
    plain = edges.select("src", "tgt").withColumn("weight", F.lit(1.0)).withColumn("type", F.lit(""))
    links = _both_ways(collapse_edges(plain)).select("node", "nbr")
    frontier = pairs.select("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    reached, found, open_pairs = frontier, None, pairs.select("start", "goal").distinct()
    while True:
        hit = open_pairs.join(frontier.withColumnRenamed("node", "goal"), ["start", "goal"])
        found = hit if found is None else found.unionByName(hit)
        open_pairs = cut_lineage(open_pairs.join(hit.select("start", "goal"), ["start", "goal"], "left_anti"))
        if open_pairs.isEmpty():
            return found
        fresh = (
            frontier.join(open_pairs.select("start").distinct(), "start", "left_semi")
            .join(links, "node")
            .select("start", F.col("nbr").alias("node"), F.array_append("path", F.col("nbr")).alias("path"))
            .join(reached.select("start", "node"), ["start", "node"], "left_anti")
            .groupBy("start", "node")
            .agg(F.min("path").alias("path"))
        )
        frontier = cut_lineage(fresh)
        if frontier.isEmpty():
            return found
        reached = reached.unionByName(frontier)


def communities(edges: DataFrame, min_size: int = 1, top: int | None = None, max_rounds: int = 200) -> DataFrame:
    """(community, node, size) by weighted label propagation, largest communities first.

    Every round each node takes the label with the largest total weight among its neighbours (its
    own label counts as the tie breaker, then the smaller one). Half of the nodes move at a time, then
    the other half, and every pair of rounds draws the halves anew by hash, so that neighbours do not
    swap labels forever. Rounds end when a whole pair moved nothing; labels that have not settled after
    max_rounds are reported by a warning. Label weights are summed on the map side first, so a hub
    costs one row per neighbouring label. `min_size` and `top` drop nothing unless set.
    """
    links = stored(_both_ways(collapse_edges(edges)))
    labels = links.select("node").distinct().withColumn("label", F.col("node"))
    quiet = 0
    for step in range(max_rounds):
        votes = (
            links.join(labels.select(F.col("node").alias("nbr"), "label"), "nbr")
            .groupBy("node", "label")
            .agg(F.sum("weight").alias("w"))
        )
        current = labels.withColumnRenamed("label", "own")
        best = (
            votes.join(current, "node")
            .groupBy("node", "own")
            .agg(F.min_by("label", F.struct(-F.col("w"), F.col("label") != F.col("own"), "label")).alias("best"))
        )
        mover = F.pmod(F.xxhash64("node", F.lit(step // 2)), F.lit(2)) == step % 2
        moved = stored(best.select("node", F.when(mover, F.col("best")).otherwise(F.col("own")).alias("label"), "own"))
        changed = not moved.filter("label <> own").isEmpty()
        labels = moved.select("node", "label")
        quiet = 0 if changed else quiet + 1
        if quiet >= 2 and step % 2:
            break
    else:
        warnings.warn(f"labels still moved after {max_rounds} rounds", stacklevel=2)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    kept = sizes.filter(F.col("size") >= min_size)
    if top is not None:
        kept = kept.orderBy(F.desc("size"), "first").limit(top)
    return labels.join(kept, "label").select(F.col("first").alias("community"), "node", "size")


def community_members(members: DataFrame, provenance: DataFrame, nodes: DataFrame, top: int | None = None) -> DataFrame:
    """Members of each community, those with the most provenance chunks first; `top` keeps that many."""
    counts = provenance.groupBy(F.col("key").alias("node")).agg(F.count(F.lit(1)).alias("chunks"))
    named = members.join(nodes.select(F.col("key").alias("node"), "name", "type", "description"), "node")
    ranked = named.join(counts, "node", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("bigint")))
    order = Window.partitionBy("community").orderBy(F.desc("chunks"), "node")
    placed = ranked.withColumn("position", F.row_number().over(order).cast("bigint"))
    return placed if top is None else placed.filter(F.col("position") <= top)


def community_facts(top_members: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """The strongest facts one hop around the leading members of each community."""
    seeds = top_members.select(F.col("community").alias("query_id"), "node")
    return k_hop_neighborhood(seeds, edges, 1, limit).withColumnRenamed("query_id", "community")


def membership_edges(members: DataFrame) -> DataFrame:
    return members.select(F.col("node").alias("entity"), F.lit("IN_COMMUNITY").alias("type"), "community")


def cooccurrence_edges(groups: DataFrame) -> DataFrame:
    """Undirected pairs of distinct names within a group (a sentence), with the number of groups.

    Names are made distinct first; the length of a sentence bounds the pairs of a group.
    """
    names = groups.select("group_id", "name").distinct()
    other = names.withColumnRenamed("name", "other")
    return (
        names.join(other, "group_id")
        .filter(F.col("name") < F.col("other"))
        .groupBy(F.col("name").alias("u"), F.col("other").alias("v"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def graph_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def link_entities(
    queries: DataFrame, nodes: DataFrame, vector_hits: DataFrame | None = None, minimum: float = 0.35, top: int = 6
) -> DataFrame:
    """(query_id, key, rank): exact 4- to 1-word mentions first, then vector hits above the minimum.

    `vector_hits` has query_id, id, score, rank.
    """
    words = F.split(normalize_entity_name(F.col("text")), " ")
    rows = queries.select("query_id", words.alias("w"))
    grams = None
    for n in (4, 3, 2, 1):
        spots = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))).otherwise(
            F.array().cast("array<int>")
        )
        part = rows.select(
            "query_id",
            "w",
            F.lit((4 - n) * 10**9).alias("_base"),
            F.explode(spots).alias("_at"),
            F.lit(n).alias("_n"),
        ).select("query_id", (F.col("_base") + F.col("_at")).alias("pos"), F.array_join(F.slice("w", F.col("_at"), F.col("_n")), " ").alias("key"))
        grams = part if grams is None else grams.unionByName(part)
    mentioned = grams.filter(F.length("key") >= 3).join(nodes.select("key"), "key", "left_semi").select("query_id", "key", "pos")
    if vector_hits is not None:
        near = vector_hits.filter(F.col("score") >= minimum).select(
            "query_id", F.col("id").alias("key"), (F.col("rank") + 10**11).alias("pos")
        )
        mentioned = mentioned.unionByName(near)
    first = mentioned.groupBy("query_id", "key").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("query_id").orderBy("pos", "key")
    return first.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).drop("pos")


def suggest_entities(nodes: DataFrame, text: str, top: int = 10) -> DataFrame:
    """Keys that contain a text, for when no key equals it."""
    return nodes.filter(F.contains("key", F.lit(text))).orderBy("key").limit(top)


def explore_entity(name: str, nodes: DataFrame, edges: DataFrame, hops: int = 2, limit: int = 40) -> DataFrame:
    """Facts around an entity (1 to 3 hops); without an exact key, up to ten suggestions."""
    # The tables are read for every hop and once more for suggestions, but made once.
    nodes, edges = cut_lineage(nodes.select("key")), cut_lineage(edges)
    key = normalize_entity_name(F.lit(name))
    exact = nodes.filter(F.col("key") == key)
    seeds = exact.select(F.lit("entity").alias("query_id"), F.col("key").alias("node"))
    facts = k_hop_neighborhood(seeds, edges, min(max(hops, 1), 3), limit).select(
        F.lit("fact").alias("kind"), "src", "type", "tgt", "score"
    )
    missing = exact.agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    near = (
        nodes.filter(F.contains("key", key) & missing)
        .orderBy("key")
        .limit(10)
        .select(
            F.lit("suggestion").alias("kind"), F.col("key").alias("src"), F.lit(None).cast("string").alias("type"),
            F.lit(None).cast("string").alias("tgt"), F.lit(None).cast("double").alias("score"),
        )
    )
    return facts.unionByName(near)


def graph_context(
    linked: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2, max_facts: int = 25
) -> tuple[DataFrame, DataFrame]:
    """(context text per query, ranked facts per query) around the linked entities."""
    from opsloom.functions.text import as_fact

    seeds = linked.select("query_id", F.col("key").alias("node"))
    facts = k_hop_neighborhood(seeds, edges, hops, max_facts)
    fact_lines = facts.select(
        "query_id", (F.col("rank") + 10**6).alias("ord"),
        F.concat(F.lit("- "), as_fact(F.col("src"), F.col("type"), F.col("tgt"), F.col("description"))).alias("line"),
    )
    described = linked.join(nodes.filter("description <> ''"), "key").select(
        "query_id", F.col("rank").alias("ord"),
        F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit("): "), "description").alias("line"),
    )
    # At most the linked entities plus max_facts lines per query.
    text = described.unionByName(fact_lines).groupBy("query_id").agg(
        F.concat(
            F.lit("Knowledge-graph facts:\n"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n"),
        ).alias("text")
    )
    return text, facts


def topics(community_titles: DataFrame, documents: DataFrame, limit: int = 12) -> DataFrame:
    """One line about the corpus: the first community titles, else the first document titles."""
    titles = community_titles.orderBy("position").limit(limit).select(F.col("position").cast("string").alias("o"), "title")
    fallback = documents.select("title").distinct().orderBy("title").limit(limit).select(F.col("title").alias("o"), "title")
    line = lambda df: df.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "title"))), lambda x: x["title"]), "; ").alias("topics")
    )
    first = titles.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col("o").cast("int"), "title"))), lambda x: x["title"]), "; "
        ).alias("topics")
    )
    return first.select(F.when(F.col("topics") != "", F.col("topics")).otherwise(line(fallback).scalar()).alias("topics"))
