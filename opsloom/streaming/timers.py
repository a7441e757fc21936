"""Stateful operators on event-time timers: windows that close on time, late rows kept apart, series that expire.

The clock is the largest event time seen less the allowed delay. A stream's rows carry that clock shifted by `grace` into
the future, so Spark's own late filter leaves every row within `grace` to the operator, which tells late rows from others.
A row without a key is a beat: it moves the clock and opens nothing, so a source that pauses can still close its windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from opsloom.operators.detect import SERIES_KEY, DetectorConfig, judge_window

#: Rows later than this many days are left to Spark's late filter.
GRACE_DAYS = 36_500
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_timer_store(spark: SparkSession, start):
    """start() with the state store that timers need; a query keeps the setting it was started with."""
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(_ROCKS[0])
        else:
            spark.conf.set(_ROCKS[0], before)


def clocked(stream: DataFrame, micros: str, delay_us: int) -> DataFrame:
    """The stream with a watermark of the largest `micros` less the delay, and a late filter that is `grace` away."""
    shifted = F.timestamp_micros(F.col(micros) + F.lit(GRACE_DAYS * 86_400 * 10**6))
    return stream.withColumn("event_clock", shifted).withWatermark("event_clock", f"{delay_us // 1000 + GRACE_DAYS * 86_400 * 1000} milliseconds")


class _ClosingWindows(StatefulProcessor):
    """Sums per window of one key; a timer at a window's end emits it and forgets it."""

    def __init__(self, n_keys: int, width_us: int, columns: list[str]) -> None:
        self.n_keys, self.width, self.columns = n_keys, width_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start_us bigint", "n bigint, total double")

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        late, sums = [], {}
        for frame in rows:
            if frame.empty:
                continue
            for us, value in zip(frame["event_micros"], frame["measure"], strict=True):
                start = int(us) - int(us) % self.width
                if any(k is None for k in key):
                    continue
                if start + self.width <= now:
                    late.append(("late", start, *key, 1, float(value)))
                    continue
                n, total = sums.get(start, (0, 0.0))
                sums[start] = (n + 1, total + float(value))
        for start, (n, total) in sorted(sums.items()):
            if self.open.containsKey((start,)):
                old = self.open.getValue((start,))
                n, total = n + old[0], total + old[1]
            else:
                self.handle.registerTimer((start + self.width) // 1000)
            self.open.updateValue((start,), (n, total))
        yield self._rows(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.width
        n, total = self.open.getValue((start,))
        self.open.removeKey((start,))
        yield self._rows([("closed", start, *key, n, total)])

    def close(self) -> None:
        pass


def closing_windows(stream: DataFrame, keys: Sequence[str], value: str, micros: str, width_us: int, delay_us: int = 0) -> DataFrame:
    """(kind, window_start_us, keys, n, total): a `closed` row for each window once the clock has passed its end, and a
    `late` row for each row that came after that. Windows never reopen; closed and late rows together are all rows.

    Width and delay are whole milliseconds. Null values count as zero. Start it within with_timer_store.
    """
    if width_us % 1000 or delay_us % 1000:
        raise ValueError("width and delay must be whole milliseconds")
    kinds = dict(stream.dtypes)
    rows = stream.select(*keys, F.col(micros).alias("event_micros"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("measure"))
    schema = ", ".join(["kind string, window_start_us bigint", *(f"`{k}` {kinds[k]}" for k in keys), "n bigint, total double"])
    columns = ["kind", "window_start_us", *keys, "n", "total"]
    processor = _ClosingWindows(len(keys), width_us, columns)
    return clocked(rows, "event_micros", delay_us).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


VERDICTS = (
    "kind string, project_id string, detector string, group_key string, metric string, window_start_ns bigint, observed double, "
    "baseline double, score double, is_anomaly boolean"
)


class _TimedBaseline(StatefulProcessor):
    """Holds one series' rows until the clock has passed their window, then judges them in order of time."""

    def __init__(self, cfg: DetectorConfig, keep_ms: int) -> None:
        self.cfg, self.keep = cfg, keep_ms
        self.columns = [part.split()[0] for part in VERDICTS.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "window_start_ns bigint", "method string, x double, n double, min_abs double")
        self.history = handle.getValueState("history", "xs array<double>, ns array<double>, last_ns bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.history.get()[2] if self.history.exists() else None
        late = []
        for frame in rows:
            if frame.empty or key[0] is None:
                continue
            for w, method, x, n, floor in zip(frame["window_start_ns"], frame["method"], frame["x"], frame["n"], frame["min_abs"], strict=True):
                w, n = int(w), float(n) if pd.notna(n) else None
                if last is not None and w <= last:
                    late.append(("late", *key, w, None, None, None, None))
                    continue
                self.waiting.updateValue((w,), (method, float(x), n, float(floor)))
                self.handle.registerTimer(w // 10**6)
        yield pd.DataFrame(late, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(w for (w,) in self.waiting.keys() if w // 10**6 <= at)
        xs, ns, last = self.history.get() if self.history.exists() else ([], [], None)
        if not due:
            if last is not None and last // 10**6 + self.keep <= at:
                self.history.clear()
            yield pd.DataFrame([], columns=self.columns)
            return
        kept: deque = deque(zip(xs, ns, strict=True), maxlen=self.cfg.baseline_windows)
        out = []
        for w in due:
            method, x, n, floor = self.waiting.getValue((w,))
            self.waiting.removeKey((w,))
            observed, center, score, flagged = judge_window(method, x, n, floor, kept, self.cfg)
            if not flagged:
                kept.append((x, n))
            out.append(("judged", *key, w, observed, center, score, bool(flagged)))
        self.history.update(([h[0] for h in kept], [h[1] for h in kept], due[-1]))
        self.handle.registerTimer(due[-1] // 10**6 + self.keep)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def timed_baseline(metrics: DataFrame, delay_us: int, keep_us: int, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Verdicts of a stream of metric rows, in order of time whatever order they come in within the delay.

    A row is judged when the clock passes its window's start; one that comes after a later one was judged is `late`. A
    series without a row for `keep_us` is forgotten. Start it within with_timer_store.
    """
    rows = clocked(metrics.withColumn("event_micros", F.expr("window_start_ns div 1000")), "event_micros", delay_us)
    rows = rows.select(*SERIES_KEY, "window_start_ns", "method", F.col("x").cast("double").alias("x"), F.col("n").cast("double").alias("n"), "min_abs", "event_clock")
    processor = _TimedBaseline(cfg, keep_us // 1000)
    return rows.groupBy(*SERIES_KEY).transformWithStateInPandas(processor, VERDICTS, "Append", "EventTime")
