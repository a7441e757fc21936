"""Connected components of a link table whose nodes are longs, and small helpers of the near-duplicate joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut_lineage, ensure_checkpoint_dir, shuffles_dropped

BITMAP_BITS = 1 << 26
_LINKS_A_TASK = 100_000
_LINKS_A_BLOCK = 1_000_000


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the roots, and the smallest node of its component among them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    tied = label != np.arange(len(nodes))
    return nodes[tied], nodes[label[tied]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task, block by block, as stars: at most one link for each node of a block."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        a, b = _stars(table["a"].to_numpy(), table["b"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= _LINKS_A_BLOCK:
            yield done()
            held.clear()
    if held:
        yield done()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node of the links (a, b).

    Each task turns its own links into stars, in as many tasks as there are links for; links that fit one task are
    done with that. Otherwise a large-star and a small-star step follow, and so on until all links are stars. Each
    round is checkpointed. Rows stay at or below the number of links, and a hub's
    links are only ever reduced with a partial minimum. Null ends and self links are ignored; an empty table gives
    an empty one.
    """
    # Stored first: a task that also makes the links in Python would need a second worker beside the first.
    edges = cut_lineage(links.filter("a <> b").select("a", "b"))
    while True:
        before = edges.count()
        tasks = 1 + before // _LINKS_A_TASK
        edges = cut_lineage(edges.coalesce(tasks).mapInArrow(_contract, "a bigint, b bigint"))
        if tasks == 1:
            break
        if 2 * edges.count() <= before:
            # Half as many links need half as many tasks, and a task then sees more of them together.
            continue
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: every smaller neighbour of a node, and the node, are tied to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        n, nodes = edges.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
        if n == nodes and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def bitmap_place(key: Column, bits: int = BITMAP_BITS) -> Column:
    return key.bitwiseAND(F.lit(bits - 1))


def member_bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap with the bit of every key set: at most bits / 8 bytes come to the driver, whatever the table's size.

    It only spares work: what passes is joined with the keys afterwards.
    """
    place = bitmap_place(F.col(column), bits)
    with shuffles_dropped(keys.sparkSession):
        words = keys.filter(F.col(column).isNotNull()).groupBy(F.shiftright(place, 6).alias("word")).agg(
            F.bit_or(
                F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
            ).alias("bits")
        )
        found = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = np.asarray(keys).astype(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def shared_folder(df: DataFrame, name: str) -> str:
    """A new folder's address under the one that the cluster shares (spark.checkpoint.dir)."""
    session = df.sparkSession
    ensure_checkpoint_dir(session)
    return f"{session.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet in the shared folder and read again."""
    folder = shared_folder(df, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
