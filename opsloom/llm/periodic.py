"""Periodic runs of words: synchronising sets at dyadic scales propose periods, periodic regions give the small ones.

A run is a stretch of words with smallest period q and at least max(least, times * q) words that no neighbouring word
extends keeping the period. `times` is 4 or more, which the choice of scales below rests on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.texts import SPACED, Hasher, mix, slices, words

#: Periods below this are found as periodic regions, the others at the scales 8, 16, 32 and so on.
SMALL = 8
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _long_stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches of at least `least` true values."""
    core, have = equal, 1
    while have < least and len(core):
        step = min(have, least - have)
        core = core[: max(len(core) - step, 0)] & core[step:]
        have += step
    if not core.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(core.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + least - 1


def _window_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbouring values, by running minima inside blocks from both sides."""
    n = len(values)
    if n < size:
        return values[:0]
    full = np.full(-(-n // size) * size, _MOST)
    full[:n] = values
    blocks = full.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - size + 1], ahead[size - 1 : n])


def synchronising(hashes: np.ndarray, excluded: np.ndarray | None, scale: int) -> np.ndarray:
    """Positions i for which the least hash of the windows i..i+scale is that of window i or of window i + scale.

    Windows of `scale` words are told by `hashes`. Whether i is chosen follows from the 2 * scale words from i on, so
    equal contexts agree; of any `scale` neighbouring positions one is chosen, unless all windows there are excluded.
    """
    own = hashes if excluded is None or not excluded.any() else np.where(excluded, _MOST, hashes)
    low = _window_minimum(own, scale + 1)
    first, last = own[: len(low)], own[scale : scale + len(low)]
    return np.flatnonzero(((low == first) | (low == last)) & (low != _MOST))


def _stretch(word: np.ndarray, i: int, period: int, lo: int, hi: int) -> tuple[int, int]:
    """The maximal stretch around words i and i + period in lo..hi that keeps the period; compared word by word."""
    end, step = i, 64
    while end + period < hi:
        to = min(end + step, hi - period)
        differ = np.flatnonzero(word[end:to] != word[end + period : to + period])
        if len(differ):
            end += int(differ[0])
            break
        end, step = to, 2 * step
    begin, step = i, 64
    while begin > lo:
        to = max(begin - step, lo)
        differ = np.flatnonzero(word[to:begin] != word[to + period : begin + period])
        if len(differ):
            begin = to + int(differ[-1]) + 1
            break
        begin, step = to, 2 * step
    return begin, end + period


def _primitive(word: np.ndarray, begin: int, period: int) -> bool:
    """Whether no shorter period holds; in a stretch of 2 periods or more such a one divides the period."""
    rest, factor, primes = period, 2, []
    while factor * factor <= rest:
        if rest % factor == 0:
            primes.append(factor)
            while rest % factor == 0:
                rest //= factor
        factor += 1
    if rest > 1:
        primes.append(rest)
    own = word[begin : begin + 2 * period]
    return not any(np.array_equal(own[: 2 * period - period // p], own[period // p :]) for p in primes)


def runs_of(word: np.ndarray, bounds: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of texts, in that order; `word` are the words' hashes in a row.

    Periods below SMALL come from regions where words repeat at that distance. A run with a period from `scale` to
    2 * scale - 1 and 4 periods has a synchronising position in its first `scale` words and the same one a period
    later, both with 2 * scale words of context inside the run; equal contexts inside a run are whole periods apart,
    so the next position with the same context proposes the period. Windows with a small period are left out of the
    choice; they cannot lie all over a run with a large one. Every proposal is compared word by word.
    """
    if times < 4:
        raise ValueError("times must be 4 or more")
    found: list[tuple[int, int, int, int]] = []
    length = np.diff(bounds)

    def keep(text: int, begin: int, end: int, period: int) -> None:
        if end - begin >= max(least, times * period) and _primitive(word, begin, period):
            found.append((text, begin - int(bounds[text]), end - begin, period))

    text_of = np.repeat(np.arange(len(length)), length)
    regions: list[tuple[int, np.ndarray, np.ndarray]] = []
    for period in range(1, SMALL):
        if len(word) <= period:
            break
        equal = word[period:] == word[:-period]
        # Words of two texts are not compared.
        equal &= text_of[period:] == text_of[:-period]
        begin, end = _long_stretches(equal, 2 * period)
        regions.append((period, begin, end + period))
        for a, b in zip(begin.tolist(), (end + period).tolist(), strict=True):
            keep(int(text_of[a]), a, b, period)

    scale = SMALL
    at = np.flatnonzero(length >= times * scale)
    if not len(at):
        return _rows(found)
    # The texts that are long enough, each followed by a word of its own, so that no context reaches over an end.
    place = [np.r_[bounds[t] : bounds[t + 1], -1 - t] for t in at]
    origin = np.concatenate(place)
    own = np.where(origin >= 0, word[np.maximum(origin, 0)], mix(np.uint64(0x5EED) + (origin + 0).astype(np.uint64)))
    windows, size = own, 1
    periodic = np.zeros(len(word) + 1, np.int64)
    while True:
        while size < scale:
            windows = mix(windows[: len(windows) - size] * np.uint64(0x9E3779B97F4A7C15) + windows[size:]) if len(windows) > size else windows[:0]
            size *= 2
        if len(windows) <= scale:
            break
        # Windows whose words have a small period, at most a third of the window.
        periodic[:] = 0
        for period, begin, end in regions:
            wide = end - begin >= scale
            if 3 * period <= scale and wide.any():
                np.add.at(periodic, begin[wide], 1)
                np.add.at(periodic, end[wide] - scale + 1, -1)
        excluded = None
        if periodic.any():
            inside = np.cumsum(periodic[:-1]) > 0
            excluded = (origin[: len(windows)] >= 0) & inside[np.maximum(origin[: len(windows)], 0)]
        chosen = synchronising(windows, excluded, scale)
        chosen = chosen[chosen + scale < len(windows)]
        context = windows[chosen] * np.uint64(0xD6E8FEB86659FD93) + windows[chosen + scale]
        order = np.argsort(context, kind="stable")
        spot, context = chosen[order], context[order]
        gap = np.diff(spot)
        pair = np.flatnonzero((context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale))
        told: dict[int, tuple[int, int]] = {}
        for x in pair[np.argsort(spot[pair], kind="stable")].tolist():
            i, period = int(origin[spot[x]]), int(gap[x])
            if i < 0 or told.get(period, (0, -1))[1] > i + period:
                continue  # inside the stretch of this period that was told last
            t = int(text_of[i])
            begin, end = _stretch(word, i, period, int(bounds[t]), int(bounds[t + 1]))
            told[period] = (begin, end)
            keep(t, begin, end, period)
        scale *= 2
        wanted = length >= times * scale
        if not wanted.any():
            break
        # Texts too short for the next scale go; a window of a text that stays never begins in one that goes.
        stays = wanted[np.where(origin >= 0, text_of[np.maximum(origin, 0)] if len(text_of) else 0, -1 - origin)]
        windows = windows[stays[: len(windows)]] if stays.all() else _shortened(origin, stays, word, size)
        origin = origin[stays]
    return _rows(found)


def _shortened(origin: np.ndarray, stays: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """The window hashes of the texts that stay, made anew from their words."""
    kept = origin[stays]
    windows = np.where(kept >= 0, word[np.maximum(kept, 0)], mix(np.uint64(0x5EED) + (kept + 0).astype(np.uint64)))
    have = 1
    while have < size:
        windows = mix(windows[: len(windows) - have] * np.uint64(0x9E3779B97F4A7C15) + windows[have:]) if len(windows) > have else windows[:0]
        have *= 2
    return windows


def _rows(found: list[tuple[int, int, int, int]]) -> np.ndarray:
    return np.array(sorted(set(found)), np.int64).reshape(-1, 4)


def repeated_tail(n: int, seed: int) -> np.ndarray:
    """Which original word each of n words becomes: from word a on they repeat with a period, both told by the seed."""
    g = seed // 10
    order = np.arange(n)
    if n and seed % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[a:] = a + (order[a:] - a) % p
    return order


def periodic_runs(
    docs: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    seed: str | None = None,
    least: int = 6,
    times: int = 4,
    with_text: bool = False,
) -> DataFrame:
    """Per row: the carried columns, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256,
    collapsed_sha256 and, if asked for, runs (an array of start, length, period) and collapsed (the kept words).

    Words are what white space parts. With `seed`, a column of longs, the words are rearranged by repeated_tail first;
    a null seed leaves them as they are. A word is dropped if a run has it after the run's first period. Ties of the
    longest go to the smallest start, then period. Null or empty text has no words: no runs, four nulls and the digests
    of the empty string. Repeated rows are told each, an empty table gives an empty one, and columns that are not
    carried play no part; a carried one may not have the name of a result. Memory follows the longest text.
    """
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    fields = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    if with_text:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        names, kinds = [*names, "runs", "collapsed"], [*kinds, pa.list_(run), pa.string()]
        fields += ", runs array<struct<start bigint, length bigint, period bigint>>, collapsed string"
    _free_names(carry, names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rows: list[tuple] = []
            seeds = batch.column(batch.num_columns - 2).to_pylist()
            for lo, hi, data, ends in slices(batch.column(batch.num_columns - 1)):
                starts, stops, first = words(data, ends, SPACED)
                own = hasher(data, starts, stops)
                order = [
                    None if seeds[d] is None or seeds[d] % 10 else repeated_tail(int(first[d - lo + 1] - first[d - lo]), seeds[d])
                    for d in range(lo, hi)
                ]
                for d, changed in enumerate(order):
                    if changed is not None:
                        own[first[d] : first[d + 1]] = own[first[d] : first[d + 1]][changed]
                runs = runs_of(own, first, least, times)
                edge = np.searchsorted(runs[:, 0], np.arange(hi - lo + 1))
                raw = data.tobytes()
                for d in range(hi - lo):
                    parts = raw[ends[d] : ends[d + 1]].split()
                    if order[d] is not None:
                        parts = [parts[i] for i in order[d].tolist()]
                    rows.append(_told(runs[edge[d] : edge[d + 1], 1:], parts, with_text))
            cells = list(zip(*rows, strict=True)) or [[] for _ in names]
            kept = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True))], names=[*carry, *names])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carry), fields])
    number = F.lit(None).cast("bigint") if seed is None else F.col(seed).cast("bigint")
    return docs.select(*carry, number.alias("_seed"), F.col(text).alias("_text")).mapInArrow(find, schema)


def _free_names(carry: tuple[str, ...], names: list[str]) -> None:
    taken = sorted(set(carry) & set(names))
    if taken:
        raise ValueError(f"rename the carried columns {taken}: results have these names")


def _told(runs: np.ndarray, parts: list[bytes], with_text: bool) -> tuple:
    if not len(runs):
        whole = b" ".join(parts)
        out = (0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(whole).hexdigest())
        return (*out, [], whole.decode("utf-8", "replace")) if with_text else out
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
    gone = np.zeros(len(parts) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    whole = b" ".join([parts[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])
    out = (
        len(runs), *best, 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(whole).hexdigest(),
    )
    if not with_text:
        return out
    return *out, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], whole.decode("utf-8", "replace")
