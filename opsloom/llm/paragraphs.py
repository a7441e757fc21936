"""Substring dedup: MinHash banding of paragraphs, exact Jaccard inside candidate groups, removals by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.collide import ENTRIES, ENTRY, bucket_count, candidate_links, everyone, packed, packed_batch, verified_components
from opsloom.llm.components import connected_components, in_bitmap, member_bitmap
from opsloom.llm.jaccard import link_sets
from opsloom.llm.texts import LOWER, SPACED, Hasher, mix, range_keys, runs, slices, window_hashes, words
from opsloom.session import cut_lineage

_HEAD = (np.arange(256) & 0xC0) != 0x80


def tune_bands(similarity: float, recall: float, most_hashes: int = 48) -> tuple[int, int]:
    """(bands, rows): the most rows a band may have so that a pair at the similarity collides with the wanted recall."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        bands = next((b for b in range(1, most_hashes // rows + 1) if 1 - (1 - similarity**rows) ** b >= recall), None)
        if bands is not None:
            best = (bands, rows)
    return best


class Cuts:
    """The paragraphs of a slice of texts: lines, and pieces that are cut alike wherever the words stand.

    A piece begins where the hash of three words is the least of its surroundings (`reach` words to either side), so
    a passage inside other text, or with other line ends, has the same pieces but for its first and last words.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, hasher: Hasher, size: int, least: int, reach: int) -> None:
        low = LOWER[data]
        starts, ends, first = words(low, bounds, SPACED)
        self.hashes = hashes = hasher(low, starts, ends)
        self.size = size
        line_starts, line_ends = runs(data != 10, bounds)
        a, b = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
        keep = b - a >= least
        self.lines = (a[keep], b[keep])
        value = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
        if len(hashes) >= 3:
            value[: len(hashes) - 2] = window_hashes(hashes, 3)
        least_near = value.copy()
        for step in range(1, reach + 1):
            np.minimum(least_near[step:], value[:-step], out=least_near[step:])
            np.minimum(least_near[:-step], value[step:], out=least_near[:-step])
        edge = np.zeros(len(hashes) + 1, bool)
        edge[:-1] = value == least_near
        edge[first] = True
        at = np.flatnonzero(edge)
        a, b = at[:-1], at[1:]
        keep = b - a >= size
        self.pieces = a, b = a[keep], b[keep]
        self.piece_keys = range_keys(hashes, a, b)
        self.line_keys = range_keys(hashes, *self.lines)
        self.starts, self.ends, self.first, self.bounds, self.data = starts, ends, first, bounds, data

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All shingles of the slice, and the first and end one of each line."""
        begin, end = self.lines
        return window_hashes(self.hashes, self.size), begin, end - self.size + 1

    def told(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, number in its text, start, end in code points, words) of word ranges in order."""
        doc = np.searchsorted(self.first, begin, "right") - 1
        heads = np.concatenate([[0], np.cumsum(_HEAD[self.data], dtype=np.int64)])
        origin = heads[self.bounds[doc]]
        number = np.arange(len(begin)) - np.searchsorted(doc, doc, "left")
        return doc, number, heads[self.starts[begin]] - origin, heads[self.ends[end - 1]] - origin, end - begin


def repeated_paragraphs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 75,
    size: int = 5,
    least_words: int = 20,
    least_run: int = 16,
    reach: int = 6,
    recall: float = 0.995,
) -> DataFrame:
    """A row for each occurrence of a paragraph that repeats across documents: key, kind, paragraph (number among those
    of its kind in the text), start and end (code points, end excluded), n_words, cluster_id, removed.

    Kind line: lines of `least_words` words or more. Two are near when their sets of `size`-word shingles have a Jaccard
    similarity of `percent` or more. MinHash bands, tuned to bring such a pair together with probability `recall`, give
    candidates; inside a candidate group all pairs are verified exactly (those already connected are skipped), and
    clusters are the components. Kind piece: content-cut pieces of the running text (see Cuts), compared word by word
    through their key; they find passages inside longer lines or with other line ends, and are reported where
    neighbours that repeat make up `least_run` words or more.

    A cluster counts if it has two different keys. Its first occurrence by (key, kind, paragraph) is kept, the others
    are removed. A line and a piece that are the same words at the same place are one occurrence, told by two rows. Null and empty texts have no paragraphs. Rows that repeat a key and its text are the same occurrence.
    Rows with a null key sort first and do not make a cluster repeat. An empty table gives an empty one.
    """
    bands, rows = tune_bands(percent / 100, recall)
    buckets = bucket_count(docs)
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    least = max(least_words, size)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for _, _, data, bounds in slices(batch.column(0)):
                cuts = Cuts(data, bounds, hasher, size, least, reach)
                pieces = np.zeros(len(cuts.piece_keys), ENTRY)
                pieces["k"] = pieces["i"] = cuts.piece_keys
                every = [pieces]
                flat, begin, end = cuts.shingles()
                if len(begin):
                    # A range each for a line and for what lies between it and the next one.
                    edges = np.stack([begin, end], 1).ravel()
                    edges = edges[:-1] if edges[-1] == len(flat) else edges
                    for band in range(bands):
                        total = np.full(len(begin), band + 1, np.uint64)
                        for row in range(rows):
                            spread = flat * seeds[band * rows + row]
                            spread ^= spread >> np.uint64(31)
                            total = mix(total + np.minimum.reduceat(spread, edges)[::2])
                        entries = np.zeros(len(begin), ENTRY)
                        entries["k"], entries["i"] = total, cuts.line_keys
                        every.append(entries)
                yield packed_batch(list(packed(np.concatenate(every), buckets)))

    ties = cut_lineage(candidate_links(docs.select(text).mapInArrow(banded, ENTRIES), everyone))
    groups = connected_components(ties)
    context = docs.sparkSession.sparkContext
    nodes = ties.select(F.col("a").alias("id")).unionByName(ties.filter("a <> b").select(F.col("b").alias("id")))
    repeated = context.broadcast(member_bitmap(nodes, "id"))
    kind = dict(docs.dtypes)[key]

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(), repeated.value
        for batch in batches:
            for lo, _, data, bounds in slices(batch.column(1)):
                cuts = Cuts(data, bounds, hasher, size, least, reach)
                for name, ids, (begin, end) in (("line", cuts.line_keys, cuts.lines), ("piece", cuts.piece_keys, cuts.pieces)):
                    at = np.flatnonzero(in_bitmap(bits, ids)) if len(ids) else np.zeros(0, np.int64)
                    if not len(at):
                        continue
                    doc, number, start, stop, n = (x[at] for x in cuts.told(begin, end))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[at].view(np.int64)), batch.column(0).take(pa.array(lo + doc)),
                            pa.array([name] * len(at)), pa.array(number), pa.array(start), pa.array(stop), pa.array(n),
                        ],
                        names=["id", key, "kind", "paragraph", "start", "end", "n_words"],
                    )

    fields = f"id bigint, `{key}` {kind}, kind string, paragraph bigint, start bigint, end bigint, n_words bigint"
    found = cut_lineage(docs.select(key, text).mapInArrow(occurrences, fields).distinct())

    def payloads(members: DataFrame) -> DataFrame:
        wanted = context.broadcast(member_bitmap(members, "id"))

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, bits = Hasher(), wanted.value
            for batch in batches:
                for _, _, data, bounds in slices(batch.column(0)):
                    cuts = Cuts(data, bounds, hasher, size, least, reach)
                    (flat, begin, end), ids = cuts.shingles(), cuts.line_keys
                    at = np.flatnonzero(in_bitmap(bits, ids)) if len(ids) else np.zeros(0, np.int64)
                    at = at[np.unique(ids[at], return_index=True)[1]]
                    cells = [np.unique(flat[begin[x] : end[x]]).tobytes() for x in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at].view(np.int64)), pa.array(cells, pa.binary())], names=["id", "payload"]
                    )

        # Copies of a line in other slices are dropped where a cell is matched.
        return docs.select(text).mapInArrow(load, "id bigint, payload binary")

    size_of = found.filter("kind = 'line'").groupBy("id").agg(F.max("n_words").alias("weight")).select(
        "id", "weight", F.lit(0).alias("band")
    )
    linked = verified_components(groups, payloads, size_of, link_sets(percent))
    # Per paragraph first, then per cluster: a paragraph that a third of all rows hold is reduced early.
    order = F.struct(F.col(key).alias("key"), "kind", "paragraph", "id", "start", "end")
    of_id = found.groupBy("id").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.min(order).alias("first"))
    of_id = cut_lineage(
        of_id.join(linked.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("cluster_id", F.coalesce("root", "id"))
    )
    clusters = of_id.groupBy("cluster_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("_first")
    ).filter("low <> high")
    decided = of_id.select("id", "cluster_id").join(clusters.select("cluster_id", "_first"), "cluster_id")
    place = F.struct(F.col(key).alias("key"), "id", "start", "end")
    kept = F.struct("_first.key", "_first.id", "_first.start", "_first.end")
    joined = found.join(decided, "id").withColumn("removed", ~place.eqNullSafe(kept))
    # Neighbouring pieces that repeat, counted per text: at most one text's pieces meet in a window.
    own = Window.partitionBy(key, "kind")
    run = F.col("paragraph") - F.row_number().over(own.orderBy("paragraph"))
    runs_of = joined.withColumn("_run", run).withColumn(
        "_words", F.sum("n_words").over(Window.partitionBy(key, "kind", "_run"))
    )
    return runs_of.filter((F.col("kind") == "line") | (F.col("_words") >= least_run)).select(
        key, "kind", "paragraph", "start", "end", "n_words", "cluster_id", "removed"
    )
