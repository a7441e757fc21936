"""Best-fit packing: bounded-space online best fit over a bitset of open bins keyed by their free space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.texts import SPACE, Hasher, kept_in_worker, runs, slices
from opsloom.session import cut_lineage

_KEEP = 1_000_000
_KIND = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 digit, 3 punctuation; only plain ASCII and Latin letters count
_KIND[33:127] = 3
for _a, _b in ((65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_KIND[48:58] = 2
_KIND[[39, 60]] = 0  # an apostrophe may begin a contraction, and < a special token


class WordEncoder:
    """Token ids of whole texts by a `tokenizers` file whose pre-tokens never span white space.

    Runs of letters, single digits and runs of punctuation are pre-tokens of their own in stretches of plain ASCII
    and Latin-1 letters, so each distinct one is encoded once and its ids are reused; any other stretch between white
    space is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.hasher = Hasher()
        # Sorted keys of known stretches and, beside them, their places in the arrays below: 35 bytes each in all.
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.known = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, keys: np.ndarray, texts: list[str], plain: list[bool]) -> np.ndarray:
        """Encodes new stretches. Plain ones are one pre-token each, so many go as one text and their ids part after
        each word-ending token; should the numbers differ, they are encoded one by one. Returns their places."""
        slots = np.empty(len(texts), np.int64)
        alone = [i for i, p in enumerate(plain) if not p]
        joined = [i for i, p in enumerate(plain) if p]
        for at in range(0, len(joined), 512):
            own = joined[at : at + 512]
            ids = np.array(self._encode(" ".join([texts[i] for i in own])), np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(own) or last[-1] != len(ids) - 1:
                alone += own
            else:
                slots[own] = self._add(ids, np.diff(last, prepend=-1))
        for i in alone:
            ids = np.array(self._encode(texts[i]), np.uint32)
            slots[i] = self._add(ids, np.array([len(ids)]))[0]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        return slots

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, to = self.known, self.known + len(sizes)
        while to > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.size[n:to] = sizes
        self.start[n:to] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known = to
        return np.arange(n, to)

    def _units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the stretches that are encoded on their own, and which of them are plain."""
        chunk_starts, chunk_ends = runs(~SPACE[data], bounds)
        kind = _KIND[data]
        after = np.concatenate([data[1:], [0]]) if len(data) else data
        lead = (data == 0xC3) & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        kind[lead] = 1
        kind[1:][lead[:-1]] = 1
        odd = np.concatenate([[0], np.cumsum((kind == 0) & ~SPACE[data])])
        plain = odd[chunk_ends] == odd[chunk_starts]
        begin = np.zeros(len(data), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        # Inside a stretch that is not plain nothing is cut.
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, chunk_starts[~plain], 1)
        np.add.at(inside, chunk_ends[~plain], -1)
        begin &= np.cumsum(inside[:-1], dtype=np.int32) == 0
        begin &= ~SPACE[data]
        begin[chunk_starts] = True
        starts = np.flatnonzero(begin)
        if not len(starts):
            return starts, starts, np.zeros(0, bool)
        chunk = np.searchsorted(chunk_starts, starts, "right") - 1
        return starts, np.minimum(np.append(starts[1:], len(data)), chunk_ends[chunk]), plain[chunk]

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin (and the end of the last)."""
        starts, ends, plain = self._units(data, bounds)
        keys, where, which = np.unique(self.hasher(data, starts, ends), return_index=True, return_inverse=True)
        if self.known > _KEEP:
            self.keys, self.slots, self.used, self.known = self.keys[:0], self.slots[:0], 0, 0
        at = np.searchsorted(self.keys, keys)
        old = at < len(self.keys)
        old[old] = self.keys[at[old]] == keys[old]
        slot = np.empty(len(keys), np.int64)
        slot[old] = self.slots[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            raw, part = data.tobytes(), where[new]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            slot[new] = self._learn(keys[new], texts, plain[part].tolist())
        slot = slot[which]
        size = self.size[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[slot] - total[:-1], size) + np.arange(int(total[-1]))]
        return ids, total[np.searchsorted(starts, bounds)]


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    carry: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of each row's ids (its tokens, then end_id): longer ones are cut every `capacity` ids.

    Columns: the carried ones, piece, start, length, ids_crc32 and, if asked for, ids. Null text is empty and gives
    one piece of one id. The tokenizer's path must exist on every executor, as an installed package's file does.
    """
    extra = ", ids array<int>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(f"encoder {tokenizer}", lambda: WordEncoder(tokenizer))
        for batch in batches:
            owner, rows, kept_ids = [], [], []
            for lo, _, data, bounds in slices(batch.column(batch.num_columns - 1)):
                ids, first = encode(data, bounds)
                for d in range(len(bounds) - 1):
                    own = np.append(ids[first[d] : first[d + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        owner.append(lo + d)
                        rows.append((piece, start, len(part), zlib.crc32(part.tobytes())))
                        if with_ids:
                            kept_ids.append(part.astype(np.int32))
            take = pa.array(owner, pa.int64())
            cells = list(zip(*rows, strict=True)) or [[], [], [], []]
            arrays = [batch.column(i).take(take) for i in range(batch.num_columns - 1)]
            arrays += [pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = [*carry, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(kept_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kinds = dict(docs.dtypes)
    return docs.select(*carry, text).mapInArrow(cut, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), PIECES + extra]))


class OpenBins:
    """At most `limit` open bins: a bit per amount of free space that some bin has, and the bins of each amount.

    The best fit of a piece is the lowest set bit at or above its length. When a bin more would be open, the
    fullest, the lowest set bit, closes first. A full bin closes at once.
    """

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if length < self.capacity and self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


def pack(
    pieces: DataFrame,
    length: str = "length",
    order: tuple[str, ...] = (),
    capacity: int = 2048,
    open_bins: int | None = None,
    per_task: int = 32 << 20,
) -> DataFrame:
    """The pieces with sequence_id and offset, no sequence over `capacity`, its pieces gapless from 0.

    Pieces are dealt evenly over the tasks by a hash, about `per_task` tokens to each, so a hot source is spread; each
    task packs its pieces, longest first, with its own bins. Twice as many may be open as a task's tokens fill, so that
    none closes before the short pieces come, unless `open_bins` says less. `order` breaks ties of length, so a lost task is packed again in the same way; rows
    that tie in everything are alike. Lengths must lie in 1..capacity. An empty table gives an empty one.
    """
    total = pieces.agg(F.sum(length)).first()[0] or 0
    tasks = max(1, -(-total // per_task))
    if open_bins is None:
        open_bins = max(1, 2 * per_task // capacity)
    columns = [*order, length] if length not in order else list(order)
    dealt = pieces.repartition(tasks, F.xxhash64(*columns)) if tasks > 1 else pieces.coalesce(1)
    ordered = dealt.sortWithinPartitions(F.desc(length), *order)
    place = pieces.columns.index(length)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            got = [bins.put(n) for n in batch.column(place).to_pylist()]
            own = [pa.array([base + b for b, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ordered.mapInArrow(fill, f"{fields}, sequence_id bigint, offset bigint")


def best_fit_sequences(
    docs: DataFrame, tokenizer: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text", capacity: int = 2048
) -> DataFrame:
    """Pieces of all rows, packed. The narrow pieces table is checkpointed, so texts are encoded once."""
    pieces = cut_lineage(cut_pieces(docs, tokenizer, carry, text, capacity))
    return pack(pieces, "length", (*carry, "start", "ids_crc32"), capacity)
