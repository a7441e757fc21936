"""Modularity communities against a plain sequential version and against label propagation."""

import random

import pytest
from pyspark.sql import functions as F

from opsloom.operators import graph as gr
from opsloom.operators import modularity as mo


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, "t", float(w)) for a, b, w in rows], "src string, tgt string, type string, weight double")


def score(rows, part):
    """Modularity by its definition."""
    degree, total, inside = {}, 0.0, 0.0
    for a, b, w in rows:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
        total += 2 * w
        inside += 2 * w * (part[a] == part[b])
    sums = {}
    for n, d in degree.items():
        sums[part[n]] = sums.get(part[n], 0) + d
    return inside / total - sum(d * d for d in sums.values()) / total**2


def planted(seed, groups=4, size=12):
    rng = random.Random(seed)
    rows = []
    for i in range(groups * size):
        for j in range(i):
            same = i // size == j // size
            if rng.random() < (0.6 if same else 0.06):
                rows.append((f"n{i:02d}", f"n{j:02d}", rng.choice([1, 2, 3]) if same else 1))
    return rows


def part_of(df):
    return {r.node: r.community for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_groups_are_found(spark, seed):
    rows = planted(seed)
    part = part_of(mo.modular_communities(edges_of(spark, rows)))
    assert len(set(part.values())) == 4 and all(part[n] == f"n{int(n[1:]) // 12 * 12:02d}" for n in part)
    labels = part_of(gr.communities(edges_of(spark, rows)))
    assert score(rows, part) >= score(rows, labels) - 1e-12
    links = mo._weighted_links(edges_of(spark, rows))
    got = mo.modularity(links, spark.createDataFrame(list(part.items()), "node string, label string"))
    assert abs(got - score(rows, part)) < 1e-12


def test_ring_of_cliques_and_details(spark):
    """Cliques of five in a ring: label propagation may merge them all, modularity keeps pairs apart at least."""
    rows = []
    for c in range(8):
        rows += [(f"{c}{x}", f"{c}{y}", 1) for x in "abcde" for y in "abcde" if x < y]
        rows.append((f"{c}a", f"{(c + 1) % 8}b", 1))
    df = mo.modular_communities(edges_of(spark, [*rows, ("0a", "0a", 50), ("7a", "0b", 0)]))
    part = part_of(df)
    assert len(set(part.values())) == 8 and all(len({part[f"{c}{x}"] for x in "abcde"}) == 1 for c in range(8))
    assert {r.size for r in df.collect()} == {5}
    assert mo.modular_communities(edges_of(spark, rows), top=3).count() == 15
    assert mo.modular_communities(edges_of(spark, rows), min_size=6).count() == 0
    assert mo.modular_communities(edges_of(spark, []).filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("find", [mo.modular_communities, gr.communities])
def test_rounds_do_not_feed_on_estimated_sizes(spark, find):
    """A size estimated as a product, handed on round by round, doubles its digits each time and stops the planning."""
    found = find(edges_of(spark, planted(3)))
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 2**100
    assert found.count() == 48
