"""Quality rules by host: rule failures per domain, rates shrunk with an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.texts import SPACED, Hasher, byte_table, mix, runs, slices, window_hashes, words
from opsloom.session import cut_lineage

_SYMBOL = byte_table("#*$%&|<>")
_HEAD = (np.arange(256) & 0xC0) != 0x80
_FEW_HOSTS = 100_000
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _within(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Values made different between texts; first has the number of each text's first value."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    return mix(values + mix(doc + np.uint64(1)))


def _measure(data: np.ndarray, bounds: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
    starts, ends, first = words(data, bounds, SPACED)
    n_words = np.diff(first)

    def per_text(flags: np.ndarray, at: np.ndarray = bounds) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    chars = per_text(SPACED[data] & _HEAD[data])
    symbols = per_text(_SYMBOL[data])
    # Lines: a later one that equals an earlier one of the same text and holds a word.
    line_starts, line_ends = runs(data != 10, bounds)
    holds = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[holds], line_ends[holds]
    line_first = np.searchsorted(line_starts, bounds)
    keys = _within(hasher(data, line_starts, line_ends), line_first)
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    dup_lines = per_text(later, line_first)
    # Three-word windows inside one text, by a hash of their words.
    hashes = hasher(data, starts, ends)
    covered = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        windows = _within(np.concatenate([window_hashes(hashes, 3), np.zeros(2, np.uint64)]), first)
        inside = np.ones(len(hashes), bool)
        for k in (1, 2):
            short = first[1:][n_words >= k] - k
            inside[short] = False
        at = np.flatnonzero(inside)
        order = at[np.argsort(windows[at], kind="stable")]
        same = windows[order[1:]] == windows[order[:-1]]
        again = np.concatenate([order[1:][same], order[:-1][same]])
        for k in range(3):
            covered[again + k] = True
    return [n_words, chars, symbols, dup_lines, per_text(covered, first)]


def measure(docs: DataFrame, carry: tuple[str, ...], text: str = "text", keep_text: bool = False) -> DataFrame:
    """The carried columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text."""
    columns = [*carry, text] if keep_text else list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            parts = [_measure(data, bounds, hasher) for _, _, data, bounds in slices(batch.column(batch.num_columns - 1))]
            found = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(_MEASURES))]
            own = [pa.array(x.astype(np.int64)) for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *own], names=[*columns, *_MEASURES])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"{m} bigint" for m in _MEASURES)])
    return docs.select(*carry, text).mapInArrow(run, schema)


def base_failed(least_words: int = 50, repeat_percent: int = 50):
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def host_verdicts(failures: DataFrame, reject_above: float = 0.5) -> DataFrame:
    """(host, n_docs, n_failed, rate, bad) from rows (host, failed).

    The prior Beta(a, b) comes from the hosts themselves by the method of moments: mean m of all documents, variance
    v of the host rates beyond what their sizes explain. A host's rate is (failed + a) / (n + a + b); hosts that do
    not differ (v is 0) all get m. A host is bad if its rate is above `reject_above`. Rows without a host are left out.
    """
    hosts = cut_lineage(
        failures.filter("host is not null").groupBy("host").agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("bigint")).alias("n_failed")
        )
    )
    size, rate = F.col("n_docs"), F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("k"),
        F.sum(size * rate * rate).alias("s"),
    ).select(
        (F.col("f") / F.col("n")).alias("m"),
        (F.col("s") / F.col("n") - F.pow(F.col("f") / F.col("n"), 2)).alias("between"),
        (F.col("n") / F.col("k")).alias("mean_size"),
    )
    variance = F.col("between") - F.col("m") * (1 - F.col("m")) / F.col("mean_size")
    strength = F.when(variance > 1e-12, F.greatest(F.col("m") * (1 - F.col("m")) / variance - 1, F.lit(0.0))).otherwise(1e12)
    prior = moments.select("m", F.coalesce(strength, F.lit(1e12)).alias("strength"))
    # One row, so its two values enter as scalar subqueries.
    m, weight = prior.select("m").scalar(), prior.select("strength").scalar()
    shrunk = (F.col("n_failed") + m * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("rate", shrunk).withColumn("bad", F.col("rate") > reject_above)


def apply_rules(
    docs: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    host: str = "source",
    keep_text: bool = False,
    reject_above: float = 0.5,
) -> DataFrame:
    """Every row with its measures, base_failed, host_rate and kept: neither failed itself nor of a bad host.

    Texts are measured twice, once for the hosts' counts and once for the rows, so that nothing but one row per
    host is stored in between. A null or empty text has 0 words and fails; a null host has no verdict (host_rate
    is null); repeated rows count each; an empty table gives an empty one.
    """
    failures = measure(docs.select(F.col(host).alias("host"), F.col(text).alias("text")), ("host",), "text")
    verdicts = host_verdicts(failures.select("host", base_failed().alias("failed")), reject_above)
    measured = measure(docs.withColumn("_host", F.col(host)), (*carry, "_host"), text, keep_text)
    verdicts = verdicts.select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "bad")
    # One row per host: handed to all tasks if they are few, so that texts need no shuffle; else an ordinary join.
    few = verdicts.limit(_FEW_HOSTS + 1).count() <= _FEW_HOSTS
    joined = measured.join(F.broadcast(verdicts) if few else verdicts, "_host", "left")
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce("bad", F.lit(False))
    ).drop("_host", "bad")
