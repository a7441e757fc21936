"""Window functions over metric series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_baseline(
    series: DataFrame, keys: Sequence[str], time: str, value: str, width: int = 18, minimum: int = 6
) -> DataFrame:
    """Median of the previous `width` values; null until `minimum` of them exist."""
    previous = Window.partitionBy(*keys).orderBy(time).rowsBetween(-width, -1)
    enough = F.count(value).over(previous) >= minimum
    return series.withColumn("center", F.when(enough, F.percentile(value, 0.5).over(previous)))


def as_of_state(
    points: DataFrame, changes: DataFrame, keys: Sequence[str], time: str, state: Sequence[str],
    bucket_width: int = 86_400 * 10**6,
) -> DataFrame:
    """State in force at each point: the last non-null value of every state column at or before it.

    A change at the same time as a point counts. Both sides are bucketed by time so that a hot key
    spreads over many tasks: inside a bucket a window carries the running value, across buckets the
    last value of the earlier buckets does. The default bucket is a day of microseconds.
    """
    keys = list(keys)
    bucket = F.floor(F.col(time) / F.lit(bucket_width)).alias("_bucket")
    tagged_changes = changes.select(
        *keys, F.col(time), *state, F.lit(0).alias("_point"), F.lit(None).cast(_struct(points, keys, time)).alias("_row"), bucket
    )
    rest = [c for c in points.columns if c not in (*keys, time)]
    tagged_points = points.select(
        *keys,
        F.col(time),
        *[F.lit(None).cast(changes.schema[s].dataType).alias(s) for s in state],
        F.lit(1).alias("_point"),
        F.struct(*rest).alias("_row"),
        bucket,
    )
    both = tagged_changes.unionByName(tagged_points)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(time, "_point").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumns({f"_in_{s}": F.last(s, ignorenulls=True).over(inside) for s in state}).filter("_point = 1")
    # One row per (key, bucket) that holds a change or a point: bounded by elapsed time.
    closing = both.groupBy(*keys, "_bucket").agg(
        *[F.max_by(s, F.when(F.col(s).isNotNull(), F.col(time))).alias(s) for s in state]
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = closing.select(
        *keys, "_bucket", *[F.last(s, ignorenulls=True).over(before).alias(f"_carry_{s}") for s in state]
    )
    joined = local.join(carried, [*keys, "_bucket"])
    return joined.select(
        *keys, time, "_row.*", *[F.coalesce(f"_in_{s}", f"_carry_{s}").alias(s) for s in state]
    )


def _struct(points: DataFrame, keys: list[str], time: str):
    from pyspark.sql.types import StructType

    return StructType([f for f in points.schema.fields if f.name not in (*keys, time)])
