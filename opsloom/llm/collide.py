"""Candidate links from shared keys, and exact verification inside candidate components.

Entries (key, id, value) of a slice of rows travel packed, one binary cell per bucket of the key space, so that the
shuffle carries 24 bytes an entry and no row overhead. Entries that agree in key and value are combined on the map
side: they are tied to one of them, and that one goes on alone. A key that a third of all rows share thus costs one
entry for each slice and value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.components import connected_components
from opsloom.session import cut_lineage

ENTRY = np.dtype([("k", "<u8"), ("i", "<u8"), ("v", "<u8")])
LINK = np.dtype([("a", "<u8"), ("b", "<u8")])
ENTRIES = "bucket int, entries binary, links binary"
CELL_WEIGHT = 4 << 20


def bucket_count(docs: DataFrame) -> int:
    """Four buckets for each shuffle partition, which grow with the data."""
    return 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def distinct_links(links: np.ndarray) -> np.ndarray:
    """Each link once, in order; sorting the fields one by one is several times faster than sorting whole records."""
    links = links[np.lexsort((links["b"], links["a"]))]
    new = np.ones(len(links), bool)
    new[1:] = (links["a"][1:] != links["a"][:-1]) | (links["b"][1:] != links["b"][:-1])
    return links[new]


def packed(entries: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Entries as (bucket, entries, links); equal (key, id) entries are told by a link of the id with itself."""
    if not len(entries):
        return
    entries = entries[np.lexsort((entries["i"], entries["v"], entries["k"]))]
    same = np.zeros(len(entries), bool)
    same[1:] = (entries["k"][1:] == entries["k"][:-1]) & (entries["v"][1:] == entries["v"][:-1])
    if len(entries.dtype) > len(ENTRY):
        # Further fields are told by the id, so only entries of one id are alike.
        same[1:] &= entries["i"][1:] == entries["i"][:-1]
    links = np.empty(int(same.sum()), LINK)
    links["a"], links["b"] = entries["i"][:-1][same[1:]], entries["i"][same]
    links = distinct_links(links)
    entries = entries[~same]
    bucket = (entries["k"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    entries = entries[order]
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), entries[edges[b] : edges[b + 1]].tobytes(), links.tobytes()
        links = links[:0]


def packed_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    cells = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["bucket", "entries", "links"])


def by_ratio(percent: int) -> Callable[[np.ndarray], np.ndarray]:
    """Ties neighbours of a key's entries in order of size, where the smaller is `percent` of the larger or more.

    Two entries whose sizes allow a link have only such neighbours between them, so they end in one component.
    """

    def join(entries: np.ndarray) -> np.ndarray:
        small, large = entries[:-1], entries[1:]
        near = (small["k"] == large["k"]) & (small["v"] * np.uint64(100) >= large["v"] * np.uint64(percent))
        out = np.empty(int(near.sum()), LINK)
        out["a"], out["b"] = small["i"][near], large["i"][near]
        return out

    return join


def everyone(entries: np.ndarray) -> np.ndarray:
    """Ties all entries of a key in a row."""
    near = entries["k"][1:] == entries["k"][:-1]
    out = np.empty(int(near.sum()), LINK)
    out["a"], out["b"] = entries["i"][:-1][near], entries["i"][1:][near]
    return out


def candidate_links(entries: DataFrame, join: Callable[[np.ndarray], np.ndarray], kind: np.dtype = ENTRY) -> DataFrame:
    """Distinct (a, b) with a <= b from packed entries; a = b tells that an id occurs in two slices or twice in one.

    Entries of another `kind` carry more fields than ENTRY, told by the id."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def done() -> pa.RecordBatch:
            found = np.frombuffer(b"".join(parts), kind)
            found = found[np.lexsort((found["i"], found["v"], found["k"]))]
            again = np.zeros(len(found), bool)
            again[1:] = np.logical_and.reduce([found[c][1:] == found[c][:-1] for c in ("k", "i", "v")])
            twice = np.unique(found["i"][again])
            links = join(found[~again])
            own = np.empty(len(twice), LINK)
            own["a"] = own["b"] = twice
            return rows(np.concatenate([links, own]))

        def rows(links: np.ndarray) -> pa.RecordBatch:
            a, b = links["a"].astype(np.int64), links["b"].astype(np.int64)
            pair = np.empty(len(links), [("a", np.int64), ("b", np.int64)])
            pair["a"], pair["b"] = np.minimum(a, b), np.maximum(a, b)
            pair = distinct_links(pair)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[c])) for c in "ab"], names=["a", "b"])

        for batch in batches:
            for bucket, cell, links in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if links:
                    yield rows(np.frombuffer(links, LINK))
                if bucket != current and parts:
                    yield done()
                    parts = []
                current = bucket
                parts.append(cell)
        if parts:
            yield done()

    dealt = entries.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(reduce, "a bigint, b bigint").distinct()


Matcher = Callable[[list[bytes], np.ndarray], list[tuple[int, int]]]


def _verify(cells: DataFrame, match: Matcher) -> DataFrame:
    """(a, b) of the links that `match` finds in each cell; rows (cell, id, label, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, labels, payloads = None, [], [], []

        def done() -> pa.RecordBatch:
            a, b = [], []
            if len(ids) > 1:
                own = {i: k for k, i in reversed(list(enumerate(ids)))}
                keep = sorted(own.values())
                unit = np.unique(np.array([labels[k] for k in keep]), return_inverse=True)[1]
                for x, y in match([payloads[k] for k in keep], unit) if len(keep) > 1 else ():
                    a.append(ids[keep[x]])
                    b.append(ids[keep[y]])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for cell, i, label, payload in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if cell != current and ids:
                    yield done()
                    ids, labels, payloads = [], [], []
                current = cell
                ids.append(i)
                labels.append(label)
                payloads.append(payload)
        if ids:
            yield done()

    dealt = cells.select("cell", "id", "label", "payload").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def verified_components(
    candidates: DataFrame, payloads: Callable[[DataFrame], DataFrame], weights: DataFrame, match: Matcher,
    weight: int = CELL_WEIGHT,
) -> DataFrame:
    """(node, root) of the exact links among candidates (node, root), for nodes that have a link.

    payloads(nodes) gives (id, payload) of the nodes (id, ...); weights has (id, weight, band). Links never reach
    beyond the next band. A candidate component of at most `weight` in all is one cell, matched in one task. A
    heavier one is cut into units of that weight by band and hash. Each unit is matched alone first; then units meet
    in pairs, with what is known to be connected marked, so that a pair of connected parts costs nothing more.
    """
    members = cut_lineage(
        candidates.select(F.col("node").alias("id"), "root").join(weights.select("id", "weight", "band"), "id")
    )
    total = members.groupBy("root").agg(F.sum("weight").alias("total"))
    heavy = cut_lineage(total.filter(F.col("total") > weight).select("root"))
    loaded = payloads(members)
    if heavy.isEmpty():
        cells = members.join(loaded, "id").select(F.col("root").cast("string").alias("cell"), "id", F.col("id").alias("label"), "payload")
        return connected_components(_verify(cells, match))
    units = members.join(heavy, "root").groupBy("root", "band").agg(
        F.ceil(F.sum("weight") / weight).cast("int").alias("units")
    )
    placed = members.join(units, ["root", "band"], "left").withColumn(
        "unit", F.when(F.col("units").isNotNull(), F.pmod(F.xxhash64("id"), F.col("units")).cast("int"))
    )
    placed = cut_lineage(placed)
    name = F.concat_ws(":", "root", F.when(F.col("units").isNotNull(), F.col("band")), "unit")
    alone = placed.join(loaded, "id").select(name.alias("cell"), "id", F.col("id").alias("label"), "payload")
    first = cut_lineage(_verify(alone, match))
    labels = connected_components(first).select(F.col("node").alias("id"), F.col("root").alias("label"))
    big = placed.filter("units is not null").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # Partner units: the later ones of the same band, and all of the next band; each pair of units is one cell.
    here = big.select(
        "id", "root", "label", "band", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("other"), "unit"
    ).filter("other <> unit").select(
        "id", "label",
        F.concat_ws(":", "root", "band", F.least("unit", "other"), "band", F.greatest("unit", "other")).alias("cell"),
    )
    above = units.select("root", (F.col("band") - 1).alias("band"), F.col("units").alias("theirs"))
    below = units.select("root", (F.col("band") + 1).alias("band"), F.col("units").alias("theirs"))
    up = big.join(above, ["root", "band"]).select(
        "id", "label", "root", "band", "unit", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)).alias("other")
    ).select("id", "label", F.concat_ws(":", "root", "band", "unit", F.col("band") + 1, "other").alias("cell"))
    down = big.join(below, ["root", "band"]).select(
        "id", "label", "root", "band", "unit", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)).alias("other")
    ).select("id", "label", F.concat_ws(":", "root", F.col("band") - 1, "other", "band", "unit").alias("cell"))
    met = here.unionByName(up).unionByName(down)
    # A cell whose members are all connected already has nothing to find.
    open_cells = met.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("cell")
    cells = met.join(open_cells, "cell").join(loaded, "id").select("cell", "id", "label", "payload")
    second = _verify(cells, match)
    return connected_components(first.unionByName(second))
