"""Communities by modularity: local moves until none helps, then each community becomes one node, and so on.

Every round is a few joins and sums over the links; a hub costs one row for each neighbouring community. Half of the nodes
may move at a time; a round that does not raise the modularity is taken back and repeated with fewer movers, so the
modularity only rises and the rounds end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.operators.graph import collapse_edges
from opsloom.session import stored

_FEWEST = 16  # a sixteenth of the nodes moves at least


def _weighted_links(edges: DataFrame) -> DataFrame:
    """Links (node, nbr, weight) both ways."""
    flat = collapse_edges(edges).filter("weight > 0")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "weight").unionByName(
        flat.select(F.col("v").alias("node"), F.col("u").alias("nbr"), "weight")
    )


def modularity(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of labels (node, label): the share of weight inside communities less what chance would give."""
    ends = links.join(labels, "node").join(labels.select(F.col("node").alias("nbr"), F.col("label").alias("other")), "nbr")
    per = ends.groupBy("label").agg(
        F.sum("weight").alias("degree"), F.sum(F.when(F.col("label") == F.col("other"), F.col("weight")).otherwise(0.0)).alias("inside")
    )
    total, inside, squares = per.agg(F.sum("degree"), F.sum("inside"), F.sum(F.col("degree") * F.col("degree"))).first()
    return 0.0 if not total else inside / total - resolution * squares / total**2


def _wishes(links: DataFrame, state: DataFrame, total: float, resolution: float) -> DataFrame:
    """(node, degree, label, best): the neighbouring community that raises the modularity most, or the own one.

    state (node, label, degree). Ties stay, then go to the smaller label.
    """
    weight = (
        links.filter("node <> nbr").join(state.select(F.col("node").alias("nbr"), F.col("label").alias("to")), "nbr")
        .groupBy("node", "to").agg(F.sum("weight").alias("w"))
    )
    # The own community is an option for a node without neighbours in it, too.
    options = weight.unionByName(state.select("node", F.col("label").alias("to"), F.lit(0.0).alias("w")))
    options = options.groupBy("node", "to").agg(F.sum("w").alias("w"))
    size = state.groupBy(F.col("label").alias("to")).agg(F.sum("degree").alias("size"))
    scored = options.join(size, "to").join(state, "node")
    others = F.col("size") - F.when(F.col("to") == F.col("label"), F.col("degree")).otherwise(0.0)
    gain = F.round(F.col("w") - F.lit(resolution) * F.col("degree") * others / F.lit(total), 9)
    return scored.groupBy("node", "degree", "label").agg(
        F.min_by("to", F.struct(-gain, F.col("to") != F.col("label"), "to")).alias("best")
    )


def _one_level(links: DataFrame, resolution: float, rise: float) -> tuple[DataFrame, bool]:
    """(node, label) when no move helps any more, and whether any node moved."""
    degree = links.groupBy("node").agg(F.sum("weight").alias("degree"))
    state = stored(degree.select("node", F.col("node").alias("label"), "degree"))
    total = state.agg(F.sum("degree")).first()[0]
    score, parts, step, any_moved = modularity(links, state, resolution), 2, 0, False
    while parts <= _FEWEST:
        wishes = stored(_wishes(links, state, total, resolution))
        if wishes.filter("best <> label").isEmpty():
            break
        while parts <= _FEWEST:
            mover = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(parts)) == 0
            step += 1
            moved = stored(wishes.select("node", F.when(mover, F.col("best")).otherwise(F.col("label")).alias("label"), "degree"))
            new = modularity(links, moved, resolution)
            if new > score + rise:
                state, score, any_moved = moved, new, True
                break
            parts *= 2
    return state.select("node", "label"), any_moved


def modular_communities(
    edges: DataFrame, min_size: int = 1, top: int | None = None, resolution: float = 1.0,
    rise: float = 1e-4,
) -> DataFrame:
    """(community, node, size) of the partition that local moves and contraction find, largest communities first.

    edges (src, tgt, weight, ...) are taken as undirected, parallel ones added up, loops left out. A community is named
    by its smallest node. A round that raises the modularity by `rise` or less ends its level. `min_size` and `top` drop nothing unless set. No edges: no rows.
    """
    links = stored(_weighted_links(edges))
    members = links.select("node").distinct().withColumn("label", F.col("node"))
    while not links.isEmpty():
        labels, moved = _one_level(links, resolution, rise)
        if not moved:
            break
        members = stored(
            members.join(labels.select(F.col("node").alias("label"), F.col("label").alias("to")), "label").select("node", F.col("to").alias("label"))
        )
        # Each community becomes a node; the weight inside it, both ways, becomes its link with itself.
        inner = links.join(labels, "node").join(labels.select(F.col("node").alias("nbr"), F.col("label").alias("other")), "nbr")
        links = stored(inner.groupBy(F.col("label").alias("node"), F.col("other").alias("nbr")).agg(F.sum("weight").alias("weight")))
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("community"))
    kept = sizes.filter(F.col("size") >= min_size)
    if top is not None:
        kept = kept.orderBy(F.desc("size"), "community").limit(top)
    return members.join(kept, "label").select("community", "node", "size")
