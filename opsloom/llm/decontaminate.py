"""Benchmark decontamination: an FM-index per training shard, searched backward for the test phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.texts import ALNUM, LOWER, Hasher, share, shared, slices, words

WINDOW = 13
_SHARD_BYTES = 8 << 20
_SAMPLE = 8
_BLOCK_BYTES = 8 << 20


class WaveletRanks:
    """A wavelet matrix: occurrences of a symbol before a place, for arrays of symbols and places."""

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        self.levels = []
        rest = symbols
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            before = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(rest) - int(before[-1])
            self.levels.append((bit, before, zeros))
            rest = np.concatenate([rest[ones == 0], rest[ones == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        low = np.zeros(len(place), np.int64)
        high = np.asarray(place, np.int64)
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low1, high1 = before[low], before[high]
            low = np.where(one, zeros + low1, low - low1)
            high = np.where(one, zeros + high1, high - high1)
        return high - low


class FMIndex:
    """Backward search over runs of symbols 1..largest; a match never crosses from one run into the next."""

    def __init__(self, symbols: np.ndarray, run_starts: np.ndarray, largest: int, sample: int = _SAMPLE) -> None:
        n = len(symbols)
        run_of = np.cumsum(np.bincount(run_starts, minlength=n)[:n]) if n else np.zeros(0, np.int64)
        place = np.arange(n) + (run_of if n else 0)  # one separator goes before each run
        size = n + len(run_starts) + 1
        text = np.zeros(size, np.int64)
        text[place] = symbols
        # Suffix order by prefix doubling; each separator (and the end) is a symbol of its own, so runs end the doubling.
        order_key = text.copy()
        marks = np.flatnonzero(text == 0)
        order_key[marks] = np.arange(len(marks))
        order_key[place] = symbols + len(marks)
        rank = np.unique(order_key, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            second = np.zeros(size, np.int64)
            second[:-step or None] = rank[step:] + 1 if step < size else 0
            key = rank * (size + 1) + second
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            fresh = np.empty(size, np.int64)
            fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = fresh
            if rank[order[-1]] == size - 1:
                break
            step *= 2
        suffixes = order
        self.bwt = text[suffixes - 1]
        counts = np.bincount(text, minlength=largest + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.ranks = WaveletRanks(self.bwt, largest)
        # Sampled suffix places: every few, and each run's first, where the walk back would meet a separator.
        keep = (suffixes % sample == 0) | (self.bwt == 0)
        self.sampled = np.where(keep, suffixes, -1)
        self.size = size
        back = np.full(size, -1, np.int64)
        back[place] = np.arange(n)
        self.symbol_at = back  # from the indexed text to the symbols given

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (one a line, ends at the right end of the line)."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(1, width + 1):
            active = np.flatnonzero((lengths >= k) & (low < high))
            if not len(active):
                break
            c = phrases[active, width - k]
            low[active] = self.before[c] + self.ranks.rank(c, low[active])
            high[active] = self.before[c] + self.ranks.rank(c, high[active])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows: step back until a sampled row, then add the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = self.sampled[rows].copy()
        open_ = np.flatnonzero(out < 0)
        while len(open_):
            c = self.bwt[rows[open_]]
            rows[open_] = self.before[c] + self.ranks.rank(c, rows[open_])
            steps[open_] += 1
            out[open_] = self.sampled[rows[open_]]
            open_ = open_[out[open_] < 0]
        return self.symbol_at[out + steps]


class Phrases:
    """The test phrases of a block of benchmark items: distinct windows over a vocabulary numbered from 1."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        column = pa.array([t for _, t in items], pa.large_string())
        rows: list[np.ndarray] = []
        for _, _, data, bounds in slices(column):
            low = LOWER[data]
            starts, ends, first = words(low, bounds, ALNUM)
            hashes = Hasher()(low, starts, ends)
            rows += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.known = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        self.window = window
        of: dict[bytes, int] = {}
        lines, owners = [], []
        for (item, _), own in zip(items, rows, strict=True):
            number = (np.searchsorted(self.known, own) + 1).astype(np.int64)
            for i in range(max(1, len(own) - window + 1) if len(own) else 0):
                line = number[i : i + window]
                at = of.setdefault(line.tobytes(), len(lines))
                if at == len(lines):
                    lines.append(line)
                    owners.append(set())
                if item is not None:
                    owners[at].add(item)
        self.lengths = np.array([len(x) for x in lines], np.int64)
        self.table = np.zeros((len(lines), window), np.int64)
        for i, x in enumerate(lines):
            self.table[i, window - len(x) :] = x
        self.owners = owners
        self.least = int(self.lengths.min()) if lines else 0

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)


def _find(phrases: Phrases, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit flag of each word, and pairs text, phrase of all occurrences) of one shard.

    A phrase can only lie in a run of the phrases' own words that is as long as the shortest phrase, so the shard's
    index holds those runs and nothing else.
    """
    hit = np.zeros(len(hashes), bool)
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(hashes):
        return hit, none, none
    number = phrases.numbers(hashes)
    inside = number > 0
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    cut = first[(first > 0) & (first < len(hashes))]
    begin[cut] |= inside[cut]
    stop[cut - 1] |= inside[cut - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = b - a >= phrases.least
    a, b = a[long], b[long]
    if not len(a):
        return hit, none, none
    sizes = b - a
    run_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    where = np.repeat(a - run_starts, sizes) + np.arange(int(sizes.sum()))
    index = FMIndex(number[where], run_starts, len(phrases.known))
    low, high = index.search(phrases.table, phrases.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = where[index.locate(rows)]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + phrases.lengths[which], -1)
    return np.cumsum(edge[:-1]) > 0, np.searchsorted(first, place, "right") - 1, which


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _item_blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of about `limit` bytes; one block at a time is on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator(prefetchPartitions=True):
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    percent: int = 5,
    keep_text: bool = False,
    block_bytes: int = _BLOCK_BYTES,
) -> DataFrame:
    """Per row: the carried columns, n_words, n_hit, n_items, items (sorted), spans (merged, in words), contaminated.

    A phrase is `window` consecutive words of an item; an item of fewer words, but not none, is one phrase. A word
    inside any occurrence is hit; a text is contaminated if it has hits and they are `percent` of its words or more.
    Shards are the slices of a task's rows. The benchmark is the query set: it goes to the tasks in blocks of about
    `block_bytes` of its text, each a pass over the rows in the same job; hits of all blocks are merged.

    A null or empty text has no words and no hits; null or empty items have no phrases; an item without an id hits but
    is not listed; an id that occurs more than once counts once. Repeated rows are searched each.
    """
    kinds = dict(docs.dtypes)
    out = docs.select(
        *carry,
        F.col(text).alias("_text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    own = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    blocks = _item_blocks(benchmark, item, item_text, block_bytes)
    block = next(blocks, [])
    while block is not None:
        following = next(blocks, None)
        keeps = following is not None or keep_text
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *([f"_text {kinds[text]}"] if keeps else []), own])
        phrases = share(docs.sparkSession.sparkContext, Phrases(block, window))
        out = out.mapInArrow(_searcher(phrases, len(carry), keeps), schema)
        block = following
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    out = out.withColumns({"n_hit": hit, "n_items": F.size("items").cast("bigint")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    )
    return out.withColumnRenamed("_text", text) if keep_text else out


def _searcher(phrases, width: int, keeps: bool):
    """One pass of a block of phrases: adds its hits to those of the blocks before."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(), shared(Phrases, phrases)
        for batch in batches:
            n_words: list[int] = []
            spans: list[list[dict]] = []
            items: list[list[str]] = []
            old_spans, old_items = batch.column(width + 2), batch.column(width + 3)
            for lo, hi, data, bounds in slices(batch.column(width), _SHARD_BYTES):
                low = LOWER[data]
                starts, ends, first = words(low, bounds, ALNUM)
                hit, doc, which = _find(known, hasher(low, starts, ends), first)
                n_words += np.diff(first).tolist()
                found: dict[int, set[str]] = {}
                for d, p in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                    found.setdefault(d, set()).update(known.owners[p])
                touched = set(np.unique(doc).tolist())
                for d in range(hi - lo):
                    before = old_spans[lo + d].as_py() if len(old_spans[lo + d]) else []
                    if d not in touched:
                        spans.append(before)
                        items.append(old_items[lo + d].as_py())
                        continue
                    flags = hit[first[d] : first[d + 1]].copy()
                    for s in before:
                        flags[s["start"] : s["end"]] = True
                    step = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in step.reshape(-1, 2)])
                    items.append(sorted({*old_items[lo + d].as_py(), *found.get(d, ())}))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(width + keeps)),
                    pa.array(n_words, pa.int64()),
                    pa.array(spans, _SPANS),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[*batch.schema.names[: width + keeps], "n_words", "spans", "items"],
            )

    return search
