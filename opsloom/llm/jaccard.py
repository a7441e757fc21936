"""N-gram Jaccard join: group counts of shingles as points of an R-tree, bounded by summed coordinate minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.collide import (
    ENTRIES, ENTRY, by_ratio, bucket_count, candidate_links, packed, packed_batch, verified_components,
)
from opsloom.llm.components import connected_components, in_bitmap, member_bitmap
from opsloom.llm.texts import LOWER, SPACED, Hasher, set_keys, shingle_sets, slices, words
from opsloom.session import cut_lineage

GROUPS = 128
_FAN = 16


class CountTree:
    """An R-tree over count vectors, level by level: a node keeps the largest count of each group below it, and the
    range of the sizes. Points are ordered by halving on the group that varies most, then taken `fan` at a time."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, fan: int = _FAN) -> None:
        self.fan = fan
        order = np.arange(len(sizes))
        todo = [(0, len(sizes))]
        while todo:
            low, high = todo.pop()
            if high - low <= fan:
                continue
            part = vectors[order[low:high]]
            by = part[:, int(np.argmax(part.max(0) - part.min(0)))]
            order[low:high] = order[low:high][np.argsort(by, kind="stable")]
            half = low + -(-(high - low) // (2 * fan)) * fan
            todo += [(low, half), (half, high)]
        self.order = order
        self.levels = [(vectors[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > fan:
            most, least, largest = self.levels[-1]
            at = np.arange(0, len(most), fan)
            self.levels.append((np.maximum.reduceat(most, at), np.minimum.reduceat(least, at), np.maximum.reduceat(largest, at)))

    def near(self, point: np.ndarray, size: int, after: int, percent: int) -> np.ndarray:
        """Places of the points past `after` whose bound allows a link with the point."""
        top = len(self.levels) - 1
        nodes = np.arange(len(self.levels[top][0]))
        for level in range(top, -1, -1):
            most, least, largest = self.levels[level]
            nodes = nodes[(nodes + 1) * self.fan**level > after]
            low = least[nodes]
            nodes = nodes[(100 * largest[nodes] >= percent * size) & (100 * size >= percent * low)]
            bound = np.minimum(most[nodes], point).sum(1, dtype=np.int64)
            nodes = nodes[bound * (100 + percent) >= percent * (size + least[nodes])]
            if level:
                nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        return nodes[nodes >= after]


def link_sets(percent: int, groups: int = GROUPS):
    """A matcher of sorted shingle sets: links that connect what any pair with `percent` Jaccard connects.

    The overlap of two sets is at most the sum over groups of the smaller count; of a set and all sets under a node,
    at most that sum with the node's largest counts. Sizes a and b allow a link only if the overlap is
    percent * (a + b) / (100 + percent) or more. Nodes and points under that bound are left out, and so are those
    already connected with the asking set; the others are verified on the sets themselves.
    """
    shift = np.uint64(64 - groups.bit_length() + 1)

    def match(payloads: list[bytes], label: np.ndarray) -> list[tuple[int, int]]:
        sets = [np.frombuffer(p, "<u8") for p in payloads]
        sizes = np.array([len(x) for x in sets], np.int64)
        kind = np.uint16 if sizes.max() < 1 << 16 else np.uint32
        vectors = np.stack([np.bincount((x >> shift).astype(np.int64), minlength=groups).astype(kind) for x in sets])
        tree = CountTree(vectors, sizes)
        order, links = tree.order, []
        label = label[order].copy()
        for p in range(len(sets) - 1):
            if (label[p + 1 :] == label[p]).all():
                continue
            able = tree.near(tree.levels[0][0][p], int(tree.levels[0][1][p]), p + 1, percent)
            for q in able[label[able] != label[p]].tolist():
                if label[q] == label[p]:
                    continue
                a, b = sets[order[p]], sets[order[q]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    links.append((int(order[p]), int(order[q])))
                    label[label == label[q]] = label[p]
        return links

    return match


def _sets(batch_column: pa.Array, hasher: Hasher, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for lo, _, data, bounds in slices(batch_column):
        low = LOWER[data]
        starts, ends, first = words(low, bounds, SPACED)
        yield lo, list(shingle_sets(hasher(low, starts, ends), first, size))


def _keys(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, set_key, n) of every text; set_key is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for _, found in _sets(batch.column(1), hasher, size):
                keys = np.concatenate([keys, set_keys(found)])
                n = np.concatenate([n, np.array([len(x) for x in found], np.int64)])
            own = pa.array(keys.view(np.int64), pa.int64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), own, pa.array(n)], names=[key, "set_key", "n"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, set_key bigint, n bigint")


def shared_shingles(docs: DataFrame, text: str, size: int, times: tuple[int, ...]) -> list[DataFrame]:
    """For each of `times` (ascending), the shingles (id) that at least so many different sets have, counted over all
    texts; equal sets of one slice count once. Shingles go packed, 8 bytes each, to the task of their bucket."""
    buckets = bucket_count(docs)
    most = times[-1]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for _, found in _sets(batch.column(0), hasher, size):
                distinct = {k: x for k, x in zip(set_keys(found).tolist(), found, strict=True) if len(x)}
                if not distinct:
                    continue
                value, n = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                value = np.repeat(value, np.minimum(n, most))
                bucket = (value % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                value = value[order]
                rows = [(int(b), value[edges[b] : edges[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(edges))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())],
                    names=["bucket", "cell"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def done() -> pa.RecordBatch:
            value, n = np.unique(np.frombuffer(b"".join(parts), np.uint64), return_counts=True)
            keep = n >= times[0]
            return pa.RecordBatch.from_arrays(
                [pa.array(value[keep].view(np.int64)), pa.array(np.minimum(n[keep], most).astype(np.int32))], names=["id", "n"]
            )

        for batch in batches:
            for bucket, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != current and parts:
                    yield done()
                    parts = []
                current = bucket
                parts.append(cell)
        if parts:
            yield done()

    dealt = docs.select(text).mapInArrow(spread, "bucket int, cell binary").repartition("bucket").sortWithinPartitions("bucket")
    counted = cut_lineage(dealt.mapInArrow(count, "id bigint, n int"))
    return [counted.filter(F.col("n") >= t) for t in times]


def jaccard_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 75,
    size: int = 5,
    shared_by: tuple[int, ...] = (3, 30),
) -> tuple[DataFrame, DataFrame]:
    """(texts, classes): texts (key, set_key, n) has a row for each row; classes (set_key, n, first_key, root) a row for
    each distinct non-empty shingle set, root being the smallest set_key of its component.

    Tiles: two sets with the Jaccard similarity share one of their n - ceil(percent n / 100) + 1 first shingles in any
    common order. The order is by how many sets have a shingle, in steps of `shared_by`, then by hash: what many
    texts share comes last. Each step is a bitmap of a bounded size; a bit set by chance moves a shingle in the order
    for all texts alike, so it changes the work but never the result. Sets that share such a first shingle and whose
    sizes allow a link are tied; each component of these ties is a tile, and in it the R-tree join is exact.
    """
    texts = cut_lineage(_keys(docs, key, text, size))
    context = docs.sparkSession.sparkContext
    steps = [member_bitmap(x, "id") for x in shared_shingles(docs, text, size, shared_by)]
    ranks = context.broadcast(steps)
    classes = texts.filter("set_key is not null").groupBy("set_key").agg(
        F.min(key).alias("first_key"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")
    )
    buckets = bucket_count(docs)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, late = Hasher(), ranks.value
        for batch in batches:
            for _, found in _sets(batch.column(0), hasher, size):
                # Copies in a slice are one set.
                distinct = {k: x for k, x in zip(set_keys(found).tolist(), found, strict=True) if len(x)}
                if distinct:
                    flat = np.concatenate(list(distinct.values()))
                    steps_of = sum(in_bitmap(bits, flat).astype(np.int8) for bits in late)
                    keys, at = [], 0
                    sizes = [len(x) for x in distinct.values()]
                    lengths = [n - -(-percent * n // 100) + 1 for n in sizes]
                    for own, n, take in zip(distinct.values(), sizes, lengths, strict=True):
                        rank = steps_of[at : at + n]
                        keys.append(own[np.argsort(rank, kind="stable")[:take]])
                        at += n
                    ids = list(distinct)
                    entries = np.empty(int(sum(lengths)), ENTRY)
                    entries["k"] = np.concatenate(keys)
                    entries["i"] = np.repeat(np.array(ids, np.uint64), lengths)
                    entries["v"] = np.repeat(np.array(sizes, np.uint64), lengths)
                    yield packed_batch(list(packed(entries, buckets)))

    ties = candidate_links(docs.select(text).mapInArrow(prefixes, ENTRIES), by_ratio(percent)).filter("a <> b")
    tiles = connected_components(ties)
    weights = classes.select(
        F.col("set_key").alias("id"),
        F.col("n").alias("weight"),
        F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int").alias("band"),
        "first_key",
    )

    def payloads(members: DataFrame) -> DataFrame:
        chosen = members.select("id").join(weights.select("id", "first_key"), "id")
        place = F.col("id").bitwiseXOR(F.xxhash64("first_key"))
        bitmap = context.broadcast(member_bitmap(chosen.select(place.alias("place")), "place"))

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, bits = Hasher(), bitmap.value
            for batch in batches:
                own = batch.column(0).to_numpy().view(np.uint64)
                for lo, found in _sets(batch.column(1), hasher, size):
                    keys = set_keys(found)
                    here = in_bitmap(bits, keys ^ own[lo : lo + len(found)]) & np.array([len(x) > 0 for x in found])
                    at = np.flatnonzero(here)
                    at = at[np.unique(keys[at], return_index=True)[1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at].view(np.int64)), pa.array([found[x].tobytes() for x in at], pa.binary())],
                        names=["id", "payload"],
                    )

        return docs.select(F.xxhash64(key), text).mapInArrow(load, "id bigint, payload binary")

    linked = verified_components(tiles, payloads, weights, link_sets(percent))
    joined = classes.join(linked.withColumnRenamed("node", "set_key"), "set_key", "left")
    return texts, joined.withColumn("root", F.coalesce("root", "set_key"))


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, size: int = 5) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable by links), n_texts of its component.

    A text's set: its distinct shingles of `size` words (runs without white space, A-Z lower-cased); with fewer words,
    the whole sequence as one. Two texts link when their Jaccard similarity is `percent` or more. A null or empty text
    has no set and no links: it is its own component. Rows that repeat a text are one set, linked through it; null
    keys are never the smallest unless a component has no other. An empty table gives an empty one.
    """
    texts, classes = jaccard_components(docs, key, text, percent, size)
    classes = cut_lineage(classes)
    roots = classes.groupBy("root").agg(
        F.min("first_key").alias("component_id"), F.sum("copies").alias("n_texts")
    )
    of = classes.select("set_key", "root").join(roots, "root").select("set_key", "component_id", "n_texts")
    out = texts.join(of, "set_key", "left")
    return out.select(
        key,
        F.col("n").alias("n_shingles"),
        F.when(F.col("set_key").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_texts", F.lit(1).cast("bigint")).alias("n_texts"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, size: int = 5) -> DataFrame:
    """The rows and columns of one row of each group, that with the smallest key; rows without a set all stay.

    Rows that repeat key and text count as copies: one stays.
    """
    _, classes = jaccard_components(docs, key, text, percent, size)
    classes = cut_lineage(classes)
    best = classes.groupBy("root").agg(
        F.min(F.struct(F.col("first_key").isNull(), "first_key", "set_key")).alias("best"), F.sum("copies").alias("texts")
    ).filter("texts > 1")
    best = cut_lineage(best)
    chosen = best.select(F.col("best.set_key").alias("_set"), F.col("best.first_key").alias("_first"))
    busy = member_bitmap(classes.join(best.select("root"), "root", "left_semi"), "set_key")
    columns = docs.columns
    # Only rows that may have others beside them are shuffled; a set that is alone passes through.
    keyed = _with_set_key(docs, text, size, busy)
    alone = classes.join(best.select("root"), "root", "left_anti").select(F.col("set_key").alias("_set"), F.col("first_key").alias("_first"))
    alone = alone.filter(F.col("_set").isNotNull())
    kept = keyed.join(chosen.unionByName(alone), "_set").filter(F.col(key).eqNullSafe(F.col("_first"))).drop("_first")
    one = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_set").orderBy(F.lit(0)))).filter("_n = 1")
    return one.select(*columns).unionByName(keyed.filter("_set is null").select(*columns))


def _with_set_key(docs: DataFrame, text: str, size: int, busy: np.ndarray) -> DataFrame:
    """All columns and _set, the key of the row's shingle set; null without a set, or if the bitmap has not got it."""
    bits = docs.sparkSession.sparkContext.broadcast(busy)
    columns = docs.columns
    place = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            keys, empty = np.zeros(0, np.uint64), np.zeros(0, bool)
            for _, found in _sets(batch.column(place), hasher, size):
                keys = np.concatenate([keys, set_keys(found)])
                empty = np.concatenate([empty, np.array([len(x) == 0 for x in found], bool)])
            own = pa.array(keys.view(np.int64), pa.int64(), mask=empty | ~in_bitmap(bits.value, keys))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*columns, "_set"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, _set bigint")
