"""Range joins as equi joins on time bins; each match is produced exactly once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column, width: int) -> Column:
    w = F.lit(width).cast("bigint")
    return ((value - F.pmod(value, w)) / w).cast("bigint")


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int
) -> DataFrame:
    """Pairs with start <= at < end on equal keys. Column names of both sides must differ but for keys."""
    spread = intervals.filter(F.col(start) < F.col(end)).withColumn(
        "_bin", F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end) - 1, width)))
    )
    binned = points.withColumn("_bin", _bin(F.col(at), width))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return binned.join(spread, [*keys, "_bin"]).filter(inside).drop("_bin")


def overlapping_intervals(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    width: int,
) -> DataFrame:
    """Pairs whose half-open ranges overlap, on equal keys; joined in the first bin both cover."""
    (ls, le), (rs, re) = left_range, right_range
    a = left.filter(F.col(ls) < F.col(le)).withColumn(
        "_bin", F.explode(F.sequence(_bin(F.col(ls), width), _bin(F.col(le) - 1, width)))
    )
    b = right.filter(F.col(rs) < F.col(re)).withColumn(
        "_bin", F.explode(F.sequence(_bin(F.col(rs), width), _bin(F.col(re) - 1, width)))
    )
    first_shared = F.col("_bin") == F.greatest(_bin(F.col(ls), width), _bin(F.col(rs), width))
    overlap = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    return a.join(b, [*keys, "_bin"]).filter(first_shared & overlap).drop("_bin")
