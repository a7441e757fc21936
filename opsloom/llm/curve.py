"""Packing along a space-filling curve: hashed word vectors, few projected dimensions, a Hilbert key, neighbours packed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.components import stored
from opsloom.llm.packing import WordEncoder
from opsloom.llm.texts import ALNUM, LOWER, SPACE, Hasher, kept_in_worker, mix, runs, slices, words

#: Hashed vectors have this many places; the projection has as many rows, fixed by its seed.
PLACES = 1 << 14
_SEED = 13
_KIND = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 digit, 3 punctuation of plain ASCII
_KIND[33:127] = 3
for _a, _b in ((65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_KIND[48:58] = 2
_KIND[[39, 60]] = 0  # an apostrophe may begin a contraction, and < a special token


class ByteEncoder(WordEncoder):
    """Token ids of whole texts by a byte-level `tokenizers` file whose words take the one space before them.

    A text is cut where the tokenizer's own word rule must cut: before a stretch without white space (with its space),
    and inside plain stretches between letters, digits and punctuation. Each distinct part is encoded once. Texts with
    white space outside ASCII, or with a special token's text, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        feed = self._encode("\n")
        self.feed = feed[0] if len(feed) == 1 else None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, keys: np.ndarray, texts: list[str], plain: list[bool]) -> np.ndarray:
        """Encodes new parts, plain ones many at a time with line ends between them, at which their ids part again;
        should the numbers differ, they are encoded one by one. Returns their places."""
        slots = np.empty(len(texts), np.int64)
        alone = [i for i, p in enumerate(plain) if not p]
        joined = [i for i, p in enumerate(plain) if p]
        for at in range(0, len(joined), 1024):
            own = joined[at : at + 1024]
            ids = np.array(self._encode("\n".join([texts[i] for i in own]) + "\n"), np.uint32)
            feeds = np.flatnonzero(ids == self.feed)
            if self.feed is None or len(feeds) != len(own):
                alone += own
            else:
                slots[own] = self._add(np.delete(ids, feeds), np.diff(feeds, prepend=-1) - 1)
        for at in range(0, len(alone), 4096):
            ids = [e.ids for e in self.tokenizer.encode_batch([texts[i] for i in alone[at : at + 4096]], add_special_tokens=False)]
            slots[alone[at : at + 4096]] = self._add(np.concatenate([np.array(x, np.uint32) for x in ids]), np.array([len(x) for x in ids]))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        return slots

    def _whole(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts hold white space outside ASCII or the text of a special token."""
        after = np.concatenate([data[1:], np.zeros(2, np.uint8)])
        one, two = after[: len(data)], after[1 : len(data) + 1]
        odd = (data == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (data == 0xE1) & (one == 0x9A) & (two == 0x80)
        odd |= (data == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
        odd |= (data == 0xE2) & (one == 0x81) & (two == 0x9F) | (data == 0xE3) & (one == 0x80) & (two == 0x80)
        whole = np.zeros(len(bounds) - 1, bool)
        whole[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = True
        raw = data.tobytes()
        for text in self.special:
            at = raw.find(text)
            while at >= 0:
                whole[np.searchsorted(bounds, at, "right") - 1] = True
                at = raw.find(text, at + 1)
        return whole

    def _units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the parts that are encoded on their own; together they are all bytes."""
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, bool)
        space = SPACE[data]
        chunk_starts, chunk_ends = runs(~space, bounds)
        kind = _KIND[data]
        after = np.concatenate([data[1:], [0]])
        lead = (data == 0xC3) & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        kind[lead] = 1
        kind[1:][lead[:-1]] = 1
        odd = np.concatenate([[0], np.cumsum((kind == 0) & ~space)])
        plain = odd[chunk_ends] == odd[chunk_starts]
        begin = np.zeros(n, bool)
        begin[1:] = kind[1:] != kind[:-1]
        inside = np.zeros(n + 1, np.int8)
        np.add.at(inside, chunk_starts[~plain], 1)
        np.add.at(inside, chunk_ends[~plain], -1)
        begin &= np.cumsum(inside[:-1], dtype=np.int32) == 0
        begin &= ~space
        text_start = np.zeros(n + 1, bool)
        text_start[bounds[:-1]] = True
        # A stretch begins with the one space before it; other white space before it ends in a part of its own.
        before = chunk_starts[~text_start[chunk_starts]] - 1
        begin[chunk_starts] = True
        with_space = before[data[before] == 32]
        begin[with_space + 1] = False
        begin[before] = True
        # White space begins where a stretch ends, and at a text's start.
        ends = chunk_ends[chunk_ends < n]
        begin[ends] = True
        begin[bounds[:-1][bounds[:-1] < n]] = True
        whole = self._whole(data, bounds)
        if whole.any():
            inside = np.repeat(whole, np.diff(bounds))
            begin[inside] = text_start[:n][inside]
        starts = np.flatnonzero(begin)
        # A part is plain if it is in a plain stretch, the space before it included; white space alone is not.
        first = starts + (data[starts] == 32)
        at = np.maximum(np.searchsorted(chunk_starts, first, "right") - 1, 0)
        alone = plain[at] & (first >= chunk_starts[at]) & (first < chunk_ends[at]) if len(chunk_starts) else np.zeros(len(starts), bool)
        if whole.any():
            alone &= ~whole[np.searchsorted(bounds, starts, "right") - 1]
        return starts, np.append(starts[1:], n), alone


def projection(dims: int) -> np.ndarray:
    """The fixed random matrix that takes hashed vectors to `dims` numbers."""
    return np.random.default_rng(_SEED).standard_normal((PLACES, dims)).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of `cells`, whose numbers have `bits` bits each (63 in all at most)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    # From the coarsest bit down: undo the turns and mirrors that the curve makes in each cell, then take the Gray code.
    bit = top
    while bit > 1:
        low = bit - 1
        for d in range(dims):
            mirrored = (x[d] & bit) > 0
            swap = np.where(mirrored, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(mirrored, x[0] ^ low, x[0]) ^ swap
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip, bit = np.zeros_like(x[0]), top
    while bit > 1:
        flip = np.where((x[-1] & bit) > 0, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> b & 1)
    return key


def curve_keys(data: np.ndarray, bounds: np.ndarray, hasher: Hasher, matrix: np.ndarray, bits: int) -> np.ndarray:
    """The curve place of each text: words (A-Z lower-cased) hashed into places, the damped counts of a unit vector
    projected, and each number spread evenly over its cells."""
    low = LOWER[data]
    starts, ends, first = words(low, bounds, ALNUM)
    place = (hasher(low, starts, ends) >> np.uint64(20)).astype(np.int64) % PLACES
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    code, count = np.unique(text * PLACES + place, return_counts=True)
    text, place = code // PLACES, code % PLACES
    weight = np.sqrt(count).astype(np.float32)
    total = np.bincount(text, weight * weight, len(bounds) - 1)
    out = np.empty((len(bounds) - 1, matrix.shape[1]))
    for d in range(matrix.shape[1]):
        out[:, d] = np.bincount(text, weight * matrix[place, d], len(bounds) - 1)
    out /= np.sqrt(np.maximum(total, 1))[:, None]
    # A logistic curve is near enough to the normal distribution's to use all cells.
    even = 1 / (1 + np.exp(-1.702 * out))
    return hilbert_keys(np.minimum((even * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def encoded(
    docs: DataFrame, tokenizer: str, carry: tuple[str, ...], text: str, end_id: int, dims: int, bits: int
) -> DataFrame:
    """The carried columns, _key (place on the curve), _seat (number in its task, tells like rows apart), _n (ids) and
    _ids (the ids, 2 bytes each if the vocabulary allows, else 4)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(f"bytes {tokenizer}", lambda: ByteEncoder(tokenizer))
        matrix = kept_in_worker(f"projection {dims}", lambda: projection(dims))
        kind = "<u2" if len(encoder.ends) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        seat = 0
        for batch in batches:
            keys, sizes, cells = [], [], []
            for _, _, data, bounds in slices(batch.column(batch.num_columns - 1)):
                ids, first = encoder(data, bounds)
                keys.append(curve_keys(data, bounds, encoder.hasher, matrix, bits))
                sizes.append(np.diff(first) + 1)
                flat = np.insert(ids, first[1:], end_id).astype(kind).tobytes()
                edges = (first + np.arange(len(first))) * int(kind[-1])
                cells += [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            n = batch.num_rows
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            own = [
                pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(np.arange(seat, seat + n), pa.int64()),
                pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(cells, pa.binary()),
            ]
            seat += n
            yield pa.RecordBatch.from_arrays([*kept, *own], names=[*carry, "_key", "_seat", "_n", "_ids"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "_key bigint, _seat bigint, _n bigint, _ids binary"])
    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(encode, schema)


class Chopper:
    """Cuts the ids that come in a row into sequences of `capacity`; what is left at the end goes into sequences whose
    lengths are powers of two, which need no padding."""

    def __init__(self, capacity: int, base: int) -> None:
        self.capacity, self.base, self.made, self.fill = capacity, base, 0, 0
        self.open: list[tuple[int, int, int]] = []  # (row, start, length) of the sequence that is not full yet

    def put(self, row: int, n: int) -> list[tuple[int, int, int, int, int]]:
        """(row, start, length, sequence, offset) of the sequences that are full with these ids."""
        out, start = [], 0
        while start < n:
            length = min(n - start, self.capacity - self.fill)
            self.open.append((row, start, length))
            self.fill += length
            start += length
            if self.fill == self.capacity:
                out += self._close(self.open)
                self.open, self.fill = [], 0
        return out

    def _close(self, parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        out, offset = [], 0
        for row, start, length in parts:
            out.append((row, start, length, self.base + self.made, offset))
            offset += length
        self.made += 1
        return out

    def end(self) -> list[tuple[int, int, int, int, int]]:
        out, rest = [], self.open
        while rest:
            left = sum(length for _, _, length in rest)
            size = 1 << (left.bit_length() - 1)
            own, later = [], []
            for row, start, length in rest:
                now = min(length, size)
                size -= now
                if now:
                    own.append((row, start, now))
                if length > now:
                    later.append((row, start + now, length - now))
            out += self._close(own)
            rest = later
        self.open, self.fill = [], 0
        return out


def curve_sequences(
    docs: DataFrame,
    tokenizer: str,
    carry: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    dims: int = 4,
    bits: int = 15,
    per_task: int = 4 << 20,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows in sequences of `capacity` ids: the carried columns, hilbert_key, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, if asked for, ids.

    Rows (a text's ids, then end_id) are sorted by their place on the curve over as many tasks as there are `per_task`
    ids, then by the carried columns and a number, so a group of copies, which has one place, is spread too. Each task
    cuts its rows, one after the other, wherever a sequence is full; only its end makes shorter sequences, of lengths
    that are powers of two. So nothing is padded. The encoded rows are stored, so texts are encoded once and a lost task
    cuts the same rows again. Null text is empty: one piece of the one id. Texts without words share one place. An empty
    table gives an empty one; columns that are not carried play no part, and a carried one may not have a result's name.
    """
    names = ["hilbert_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    taken = sorted(set(carry) & {*names, "_key", "_seat", "_n", "_ids"})
    if taken:
        raise ValueError(f"rename the carried columns {taken}: results have these names")
    if dims * bits > 63:
        raise ValueError("a key has 63 bits at most")
    rows = stored(encoded(docs, tokenizer, carry, text, end_id, dims, bits), "encoded")
    total = rows.agg(F.sum("_n")).first()[0] or 0
    tasks = max(1, -(-total // per_task))
    order = ["_key", *carry, "_seat"]
    dealt = rows.repartitionByRange(tasks, *order) if tasks > 1 else rows.coalesce(1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chop = Chopper(capacity, TaskContext.get().partitionId() << 40)
        held: dict[int, tuple[pa.RecordBatch, int, np.ndarray]] = {}  # rows of the open sequence
        number = 0

        def told(pieces: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            parts = [held[p[0]] for p in pieces]
            columns, at = [], 0
            n = len(carry)
            while at < len(parts):
                to = at
                while to < len(parts) and parts[to][0] is parts[at][0]:
                    to += 1
                take = pa.array([p[1] for p in parts[at:to]], pa.int64())
                columns.append([parts[at][0].column(i).take(take) for i in (*range(n + 1), n + 2)])
                at = to
            joined = [pa.concat_arrays([c[i] for c in columns]) for i in range(n + 2)]
            ids = [p[2][start : start + length].astype("<u4") for p, (_, start, length, _, _) in zip(parts, pieces, strict=True)]
            cells = list(zip(*pieces, strict=True))
            arrays = [
                *joined[:n], joined[n], pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), joined[n + 1],
                pa.array(cells[3], pa.int64()), pa.array(cells[4], pa.int64()),
            ]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=[*carry, *names])

        for batch in batches:
            n = len(carry)
            pieces = []
            for i, (size, cell) in enumerate(zip(batch.column(n + 2).to_pylist(), batch.column(n + 3).to_pylist(), strict=True)):
                held[number] = (batch, i, np.frombuffer(cell, "<u2" if len(cell) == 2 * size else "<u4"))
                pieces += chop.put(number, size)
                number += 1
            if pieces:
                yield told(pieces)
            held = {p[0]: held[p[0]] for p in chop.open}
        if chop.open:
            yield told(chop.end())

    kinds = dict(docs.dtypes)
    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "hilbert_key bigint, start bigint, length bigint, ids_crc32 bigint"])
    fields += ", doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return dealt.sortWithinPartitions(*order).mapInArrow(cut, fields)
