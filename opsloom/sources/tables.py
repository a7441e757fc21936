"""Columnar table scans and zone-free time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WAREHOUSE_TABLES = (
    "plans", "members", "providers", "diagnoses", "procedures", "claims", "claim_lines", "audit_flags",
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a folder; filters and column pruning reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def scan_warehouse(
    spark: SparkSession, root: str, names: tuple[str, ...] = WAREHOUSE_TABLES, prefix: str = ""
) -> dict[str, DataFrame]:
    """The star-schema tables as DataFrames, registered as temporary views for SQL users."""
    tables = {}
    for name in names:
        tables[name] = read_table(spark, root, name)
        tables[name].createOrReplaceTempView(prefix + name)
    return tables


def capped_rows(df: DataFrame, max_rows: int, order_by: list) -> DataFrame:
    """At most max_rows rows, each with a flag that tells whether rows were left out."""
    probe = df.orderBy(*order_by).limit(max_rows + 1)
    more = probe.agg((F.count(F.lit(1)) > max_rows).alias("more"))
    return probe.orderBy(*order_by).limit(max_rows).withColumn("truncated", more.scalar())


def epoch_days(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("bigint")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 read off the wall clock, whatever the session time zone is."""
    second = F.expr("0").cast("bigint") + (F.extract(F.lit("SECOND"), ts) * F.lit(1000000)).cast("bigint")
    return (
        epoch_days(ts) * F.lit(86400000000)
        + F.hour(ts).cast("bigint") * F.lit(3600000000)
        + F.minute(ts).cast("bigint") * F.lit(60000000)
        + second
    )
