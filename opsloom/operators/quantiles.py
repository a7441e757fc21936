"""Exact quantiles per group that stay cheap when one group holds most of the rows.

The built-in exact `percentile` keeps every distinct value of a group in one buffer. Here a
mergeable sketch first brackets each wanted rank; rows outside the brackets collapse into counters
on the map side, and only the few values inside a bracket are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 10000  # rank error of the sketch is 1/_ACCURACY of the group
_MARGIN = 0.0005  # bracket half-width in ranks/n: several times the sketch error
_SMALL = 20000  # groups up to this many values are ranked whole; beyond it a bracket spans many ranks


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    method: str = "linear",
) -> DataFrame:
    """One row per group with a column per requested quantile.

    method "linear" interpolates between the two neighbouring ranks; "index" takes the value at
    position int(q * n) of the sorted group (last one at most). Null values are ignored and groups
    without any value give no row.
    """
    keys = list(keys)
    names = list(quantiles)
    edges = [
        p
        for q in quantiles.values()
        for p in (max(0.0, q - _MARGIN), min(1.0, q + _MARGIN))
    ]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", edges, _ACCURACY).alias("_e"),
    )
    small = F.col("_n") <= F.lit(_SMALL)
    joined = _join_keys(rows, sketch, keys)
    cell = None
    inside = small
    for i in range(len(names)):
        lo, hi = F.element_at("_e", 2 * i + 1), F.element_at("_e", 2 * i + 2)
        step = (F.col("_v") >= lo).cast("int") + (F.col("_v") > hi).cast("int")
        cell = step if cell is None else cell + step
        inside = inside | ((F.col("_v") >= lo) & (F.col("_v") <= hi))
    hist = (
        joined.withColumn("_c", F.when(small, F.lit(0)).otherwise(cell))
        .withColumn("_b", F.when(inside, F.col("_v")))
        .groupBy(*keys, "_n", "_c", "_b")
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    order = Window.partitionBy(*keys).orderBy("_c", "_b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("_cum", F.sum("_k").over(order))
    picks: list[Column] = []
    for i, q in enumerate(quantiles.values()):
        for side, rank in _ranks(q, method).items():
            hit = (rank >= F.col("_cum") - F.col("_k")) & (rank < F.col("_cum"))
            picks.append(F.max(F.when(hit, F.col("_b"))).alias(f"_{side}{i}"))
    found = ranked.groupBy(*keys, "_n").agg(*picks)
    out = []
    for i, (name, q) in enumerate(quantiles.items()):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        if method == "linear":
            pos = (F.col("_n") - 1) * F.lit(float(q))
            result = lo + (hi - lo) * (pos - F.floor(pos))
        else:
            result = lo
        missed = F.raise_error(F.lit("quantile rank fell outside its bracket")).cast("double")
        out.append(F.when(lo.isNull() | hi.isNull(), missed).otherwise(result).alias(name))
    return found.select(*keys, *out)


def _ranks(q: float, method: str) -> dict[str, Column]:
    n = F.col("_n")
    if method == "linear":
        pos = (n - 1) * F.lit(float(q))
        return {"lo": F.floor(pos), "hi": F.ceil(pos)}
    index = F.least(n - 1, F.floor(n * F.lit(float(q))))
    return {"lo": index, "hi": index}


def _join_keys(rows: DataFrame, sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the per-group sketch; AQE broadcasts it when small and splits hot keys otherwise."""
    if not keys:
        one = sketch.agg(F.struct(F.max("_n").alias("n"), F.max("_e").alias("e")).alias("s"))
        return rows.withColumn("_s", one.scalar()).select(
            "_v", F.col("_s.n").alias("_n"), F.col("_s.e").alias("_e")
        )
    renamed = sketch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", "_e")
    condition = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(renamed, condition).select(*keys, "_v", "_n", "_e")


def or_zero(name: str) -> Column:
    """Quantile of an empty set counts as 0.0 in metric reports."""
    return F.coalesce(F.col(name), F.lit(0.0)).alias(name)
