"""Keyed table updates expressed as joins: insert-ignore, replace, unique append, retention feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(
    incoming: DataFrame, keys: Sequence[str], order: Sequence[str], stored: DataFrame | None = None
) -> DataFrame:
    """New rows by key: the first in `order` wins, keys already stored are ignored.

    Built as a minimum per key, so repeated deliveries of one key shrink before the shuffle.
    """
    rest = [c for c in incoming.columns if c not in keys]
    sortable = [c for c in order if c not in keys]
    first = (
        incoming.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*sortable)).alias("_r"))
        .select(*keys, "_r.*")
        .select(*incoming.columns)
    )
    return first if stored is None else first.join(stored.select(*keys), list(keys), "left_anti")


def insert_counts(
    incoming: DataFrame, keys: Sequence[str], valid: Column, stored: DataFrame | None = None
) -> DataFrame:
    """One row: accepted, duplicates and rejected of a delivery."""
    good = incoming.filter(valid)
    fresh = good if stored is None else good.join(stored.select(*keys), list(keys), "left_anti")
    accepted = fresh.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n"))
    return incoming.agg(
        F.count_if(valid).alias("_valid"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("rejected")
    ).select(
        accepted.scalar().alias("accepted"),
        (F.col("_valid") - accepted.scalar()).alias("duplicates"),
        "rejected",
    )


def upsert_replace(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace stored rows that have the same key."""
    kept = stored.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming)


def replace_document(
    stored_chunks: DataFrame, new_chunks: DataFrame, documents: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """Drop all chunks of the re-ingested documents (even those that yield none now), then add the new."""
    kept = stored_chunks.join(documents.select(key), key, "left_anti")
    return kept.unionByName(new_chunks)


def insert_unique(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Append rows whose key is new; null key parts count as the empty string."""
    stored, incoming = (
        df.withColumns({f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)})
        for df in (stored, incoming)
    )
    temp = [f"_k{i}" for i in range(len(keys))]
    fresh = insert_ignore(incoming, temp, order, stored)
    return stored.unionByName(fresh).drop(*temp)


def changes_between(changes: DataFrame, project_id: str, start_ns: int, end_ns: int) -> DataFrame:
    """Deploy and configuration events of a project in [start, end), oldest first."""
    inside = (F.col("project_id") == project_id) & (F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns)
    return changes.filter(inside).orderBy("ts_ns")


def append_approved(
    proposed: DataFrame, approved: DataFrame, key: str, target: str, write_tables: Sequence[str]
) -> DataFrame:
    """Rows to append to a write-enabled table: only the ones that were approved."""
    if target not in write_tables:
        raise PermissionError(f"role may not write to {target}")
    return proposed.join(approved.select(key), key, "left_semi")


def write_append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_splits(examples: DataFrame, path: str) -> DataFrame:
    """One JSON-lines folder per split; returns the row count of each split."""
    examples.write.mode("overwrite").partitionBy("split").json(path)
    return examples.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Metric tables as JSON lines, one folder each."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def access_log_rows(reads: DataFrame, key_name: Column, purpose: Column, ts_ns: Column) -> DataFrame:
    """Audit rows for content reads, ready to append."""
    return reads.select(
        ts_ns.alias("ts_ns"), "project_id", key_name.alias("key_name"), "trace_id", purpose.alias("purpose")
    )


def newest_access(log: DataFrame, n: int = 500) -> DataFrame:
    return log.orderBy(F.desc("ts_ns"), "project_id", "trace_id").limit(n)


def project_id(org: Column, name: Column) -> Column:
    return F.concat(F.lit("prj_"), F.substring(F.sha2(F.concat_ws("/", org, name), 256), 1, 12))


def assign_ids(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Running number inside each group of an already aggregated table."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))


def link_anomalies(anomalies: DataFrame, membership: DataFrame) -> DataFrame:
    """Set the incident of each anomaly; anomalies without one stay unlinked."""
    return anomalies.join(membership.select("project_id", "anomaly_id", "incident_id"), ["project_id", "anomaly_id"], "left")
