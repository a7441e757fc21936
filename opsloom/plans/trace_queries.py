"""Trace and span queries over the order/line mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.scalar import exception_name, safe_int, severity_for
from opsloom.operators import spans as sp
from opsloom.operators.quantiles import exact_quantiles
from opsloom.plans.catalog import query
from opsloom.plans.mappings import PERIOD_NS, SPANS_SQL, TRACES_SQL, UNIQUE_SPANS_SQL, spans
from opsloom.sources.sinks import insert_ignore
from opsloom.session import cut_lineage
from opsloom.sources.tables import read_table

ARRIVAL = ["arrival", "arrival_tie", "duration_ms", "cost_usd", "status"]
SPAN_KEY = ["project_id", "span_id"]


def unique_spans(spark, sf_dir):
    """The span table after ingest, written once as a span store holds it."""
    return cut_lineage(insert_ignore(spans(spark, sf_dir), SPAN_KEY, ARRIVAL))


def order_traces(spark, sf_dir):
    """Trace measures straight from delivered spans."""
    return sp.trace_measures(spans(spark, sf_dir))


def stored_traces(spark, sf_dir):
    """The trace table written once, as a trace store holds it, for queries that read it repeatedly."""
    return cut_lineage(order_traces(spark, sf_dir))


DEPTH_SQL = (
    UNIQUE_SPANS_SQL.replace("\nspans AS", "\nRECURSIVE_MARK spans AS", 1)
    + """,
climb AS (
  SELECT project_id, trace_id, span_id, parent_span_id AS at, [span_id] AS path, 1 AS depth FROM uspans
  UNION ALL
  SELECT c.project_id, c.trace_id, c.span_id, p.parent_span_id, list_append(c.path, p.span_id), c.depth + 1
  FROM climb c JOIN uspans p ON c.project_id = p.project_id AND c.trace_id = p.trace_id AND c.at = p.span_id
  WHERE NOT list_contains(c.path, c.at)
),
depths AS (SELECT project_id, trace_id, span_id, max(depth) AS depth FROM climb GROUP BY ALL)"""
).replace("RECURSIVE_MARK ", "")


@query(
    "trace_rollup",
    "WITH RECURSIVE "
    + DEPTH_SQL
    + """,
roots AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY o, start_ns, span_id) AS rn FROM (
    SELECT u.*, CASE WHEN u.parent_span_id IS NULL THEN 0 ELSE 1 END AS o FROM uspans u
    LEFT JOIN uspans p ON u.project_id = p.project_id AND u.trace_id = p.trace_id AND u.parent_span_id = p.span_id
    WHERE p.span_id IS NULL)
),
rep AS (SELECT project_id, trace_id, max(n) AS m FROM (
  SELECT project_id, trace_id, tool_name, tool_args_hash, count(*) AS n FROM uspans WHERE kind = 'tool' GROUP BY ALL)
  GROUP BY ALL),
dep AS (SELECT project_id, trace_id, max(depth) AS d FROM depths GROUP BY ALL)
SELECT u.project_id, u.trace_id, any_value(r.name) AS root_name, any_value(r.service) AS service,
  min(u.start_ns) AS start_ns, max(u.end_ns) AS end_ns, (max(u.end_ns) - min(u.start_ns)) / 1e6 AS duration_ms,
  count(*) AS span_count, count(*) FILTER (u.kind = 'llm') AS llm_calls, count(*) FILTER (u.kind = 'tool') AS tool_calls,
  CAST(sum(u.input_tokens) AS BIGINT) AS input_tokens, CAST(sum(u.output_tokens) AS BIGINT) AS output_tokens,
  round(sum(u.cost_usd), 6) AS cost_usd, count(*) FILTER (u.status = 'error') AS error_count,
  CAST(any_value(dep.d) AS BIGINT) AS max_depth, coalesce(any_value(rep.m), 0) AS max_tool_repeat,
  count(*) FILTER (u.has_pii) AS pii_spans, bool_or(u.parent_span_id IS NULL) AS has_root,
  coalesce(string_agg(DISTINCT u.model, ',' ORDER BY u.model), '') AS models,
  coalesce(string_agg(DISTINCT u.tool_name, ',' ORDER BY u.tool_name), '') AS tools
FROM uspans u JOIN roots r ON r.rn = 1 AND u.project_id = r.project_id AND u.trace_id = r.trace_id
JOIN dep ON u.project_id = dep.project_id AND u.trace_id = dep.trace_id
LEFT JOIN rep ON u.project_id = rep.project_id AND u.trace_id = rep.trace_id
GROUP BY u.project_id, u.trace_id""",
)
def trace_rollup(spark, sf_dir):
    return (
        sp.trace_rollup(unique_spans(spark, sf_dir))
        .withColumn("cost_usd", F.round("cost_usd", 6))
        .withColumn("models", F.array_join("models", ","))
        .withColumn("tools", F.array_join("tools", ","))
        .withColumn("max_depth", F.col("max_depth").cast("bigint"))
    )


@query(
    "max_tool_repeat",
    "WITH " + TRACES_SQL + " SELECT project_id, trace_id, max_tool_repeat FROM repeats",
)
def max_tool_repeat(spark, sf_dir):
    return sp.max_tool_repeat(spans(spark, sf_dir))


@query(
    "metric_series",
    "WITH "
    + TRACES_SQL
    + f""",
b AS (SELECT *, start_ns - start_ns % {PERIOD_NS} AS bucket_ns FROM traces WHERE has_root),
a AS (SELECT project_id, bucket_ns, count(*) AS traces, avg(CASE WHEN error_count > 0 THEN 1.0 ELSE 0 END) AS e,
  quantile_cont(duration_ms, 0.95) AS p, sum(cost_usd) AS c, sum(input_tokens + output_tokens) AS t
  FROM b GROUP BY GROUPING SETS ((project_id, bucket_ns), (project_id)))
SELECT project_id, bucket_ns, traces, round(e, 6) AS error_rate, round(p, 3) AS p95_ms, round(c, 6) AS cost_usd,
  CAST(t AS BIGINT) AS tokens FROM a""",
)
def metric_series(spark, sf_dir):
    return sp.metric_series(order_traces(spark, sf_dir), PERIOD_NS).select(
        "project_id",
        "bucket_ns",
        "traces",
        F.round("error_rate", 6).alias("error_rate"),
        F.round("p95_ms", 3).alias("p95_ms"),
        F.round("cost_usd", 6).alias("cost_usd"),
        "tokens",
    )


@query(
    "daily_spend",
    "WITH "
    + SPANS_SQL
    + """ SELECT project_id, DATE '1970-01-01' + CAST(start_ns // 86400000000000 AS INTEGER) AS day,
    round(sum(cost_usd), 6) AS spent FROM spans GROUP BY ALL""",
)
def daily_spend(spark, sf_dir):
    return sp.daily_spend(spans(spark, sf_dir)).withColumn("spent", F.round("spent", 6))


RANGE = (852_076_800 * 10**9, 883_612_800 * 10**9)  # the year 1997


@query(
    "traces_in_range",
    "WITH "
    + TRACES_SQL
    + f""" SELECT project_id, trace_id, start_ns, span_count FROM traces
    WHERE has_root AND start_ns >= {RANGE[0]} AND start_ns < {RANGE[1]}""",
)
def traces_in_range(spark, sf_dir):
    return sp.traces_in_range(order_traces(spark, sf_dir), *RANGE).select(
        "project_id", "trace_id", "start_ns", "span_count"
    )


@query(
    "spans_of_traces",
    "WITH "
    + TRACES_SQL
    + f""" SELECT project_id, trace_id, span_id, kind, status, arrival FROM spans WHERE trace_id IN (
    SELECT trace_id FROM traces WHERE has_root AND start_ns >= {RANGE[0]} AND start_ns < {RANGE[1]})""",
)
def spans_of_traces(spark, sf_dir):
    chosen = sp.traces_in_range(order_traces(spark, sf_dir), *RANGE)
    return sp.spans_of_traces(spans(spark, sf_dir), chosen).select(
        "project_id", "trace_id", "span_id", "kind", "status", "arrival"
    )


@query(
    "parent_span_self_join",
    "WITH "
    + UNIQUE_SPANS_SQL
    + """ SELECT u.project_id, u.trace_id, u.span_id, p.name AS parent_name,
    u.parent_span_id IS NOT NULL AND p.span_id IS NULL AS is_orphan FROM uspans u LEFT JOIN uspans p
    ON u.project_id = p.project_id AND u.trace_id = p.trace_id AND u.parent_span_id = p.span_id""",
)
def parent_span_self_join(spark, sf_dir):
    return sp.parent_links(unique_spans(spark, sf_dir)).select(
        "project_id", "trace_id", "span_id", "parent_name", "is_orphan"
    )


@query(
    "true_root",
    "WITH "
    + UNIQUE_SPANS_SQL
    + """ SELECT project_id, trace_id, span_id, name FROM (
    SELECT u.*, row_number() OVER (PARTITION BY u.project_id, u.trace_id
      ORDER BY u.parent_span_id IS NOT NULL, u.start_ns, u.span_id) AS rn
    FROM uspans u LEFT JOIN uspans p
    ON u.project_id = p.project_id AND u.trace_id = p.trace_id AND u.parent_span_id = p.span_id
    WHERE p.span_id IS NULL) WHERE rn = 1""",
)
def true_root(spark, sf_dir):
    return sp.true_root(unique_spans(spark, sf_dir)).select("project_id", "trace_id", "span_id", "name")


@query(
    "span_depth",
    "WITH RECURSIVE " + DEPTH_SQL + " SELECT project_id, trace_id, span_id, CAST(depth AS BIGINT) AS depth FROM depths",
)
def span_depth(spark, sf_dir):
    return sp.span_depth(unique_spans(spark, sf_dir)).withColumn("depth", F.col("depth").cast("bigint"))


@query(
    "trace_waterfall",
    "WITH RECURSIVE "
    + DEPTH_SQL
    + """ SELECT u.project_id, u.trace_id, u.span_id, CAST(least(d.depth, 20) AS BIGINT) AS depth,
    (u.start_ns - min(u.start_ns) OVER (PARTITION BY u.project_id, u.trace_id)) / 1e6 AS offset_ms,
    row_number() OVER (PARTITION BY u.project_id, u.trace_id ORDER BY u.start_ns, u.span_id) AS position
    FROM uspans u JOIN depths d ON u.project_id = d.project_id AND u.trace_id = d.trace_id AND u.span_id = d.span_id""",
)
def trace_waterfall(spark, sf_dir):
    return sp.trace_waterfall(unique_spans(spark, sf_dir))


@query(
    "time_range",
    "WITH " + TRACES_SQL + " SELECT project_id, min(start_ns) AS first_ns, max(end_ns) AS last_ns FROM traces GROUP BY 1",
)
def time_range(spark, sf_dir):
    return sp.time_range(spans(spark, sf_dir))


@query(
    "first_seen",
    "WITH "
    + UNIQUE_SPANS_SQL
    + """ SELECT project_id, value, start_ns, trace_id, span_id FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id, label, value ORDER BY start_ns, trace_id, span_id) AS rn FROM (
      SELECT project_id, 'model' AS label, model AS value, start_ns, trace_id, span_id FROM uspans WHERE model IS NOT NULL
      UNION ALL SELECT project_id, 'tool', tool_name, start_ns, trace_id, span_id FROM uspans
      WHERE tool_name IS NOT NULL)) WHERE rn = 1""",
)
def first_seen(spark, sf_dir):
    rows = unique_spans(spark, sf_dir)
    return sp.first_seen(rows, "model").unionByName(sp.first_seen(rows, "tool_name"))


@query(
    "recent_n",
    "WITH "
    + TRACES_SQL
    + " SELECT project_id, trace_id, start_ns FROM traces ORDER BY start_ns DESC, trace_id LIMIT 50",
)
def recent_n(spark, sf_dir):
    return sp.recent_n(order_traces(spark, sf_dir), "start_ns", 50, "trace_id").select(
        "project_id", "trace_id", "start_ns"
    )


@query(
    "span_cost",
    "WITH "
    + SPANS_SQL
    + """, rates AS (SELECT 'model_' || (p_partkey % 4) AS model, min(p_retailprice) / 1000 AS ri,
      max(p_retailprice) / 500 AS ro FROM part GROUP BY 1),
    d AS (SELECT avg(p_size) AS di, max(p_size) AS dz FROM part)
    SELECT project_id, coalesce(s.model, '-') AS model, count(*) AS spans, round(sum(CASE WHEN s.model IS NULL
      OR (input_tokens = 0 AND output_tokens = 0) THEN 0.0
      ELSE (input_tokens * coalesce(ri, di) + output_tokens * coalesce(ro, dz)) / 1e6 END), 4) AS cost_usd
    FROM spans s LEFT JOIN rates r ON s.model = r.model CROSS JOIN d GROUP BY ALL""",
)
def span_cost(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    rates = part.groupBy(F.concat(F.lit("model_"), (F.col("p_partkey") % 4).cast("string")).alias("model")).agg(
        (F.min("p_retailprice") / 1000).alias("rate_in"), (F.max("p_retailprice") / 500).alias("rate_out")
    )
    default = part.agg(F.avg("p_size").alias("rate_in"), F.max("p_size").cast("double").alias("rate_out")).select(
        F.lit(None).cast("string").alias("model"), "rate_in", "rate_out"
    )
    priced = sp.price_spans(spans(spark, sf_dir).drop("cost_usd"), rates.unionByName(default))
    return priced.groupBy("project_id", F.coalesce("model", F.lit("-")).alias("model")).agg(
        F.count(F.lit(1)).alias("spans"), F.round(F.sum("cost_usd"), 4).alias("cost_usd")
    )


@query(
    "safe_int",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k,
    coalesce(TRY_CAST(event_type AS BIGINT), 0) AS bad FROM events""",
)
def safe_int_query(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        safe_int(F.get_json_object("props", "$.k")).alias("k"),
        safe_int(F.col("event_type")).alias("bad"),
    )


@query(
    "exception_name",
    r"""SELECT event_id, nullif(regexp_extract(m, '^([A-Za-z_][\w.]*)\s*:', 1), '') AS error_type FROM (
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'Timeout_' || (user_id % 7) || ': ' || props
      ELSE event_type || ' done: ok' END AS m FROM events)""",
)
def exception_name_query(spark, sf_dir):
    message = F.when(
        F.col("event_type") == "error",
        F.concat(F.lit("Timeout_"), (F.col("user_id") % 7).cast("string"), F.lit(": "), F.col("props")),
    ).otherwise(F.concat("event_type", F.lit(" done: ok")))
    return read_table(spark, sf_dir, "events").select("event_id", exception_name(message).alias("error_type"))


@query(
    "severity_for",
    """SELECT CASE WHEN value / 20 >= 12 THEN 'critical' WHEN value / 20 >= 7 THEN 'high' ELSE 'medium' END AS severity,
    count(*) AS n FROM events GROUP BY 1""",
)
def severity_query(spark, sf_dir):
    return (
        read_table(spark, sf_dir, "events")
        .groupBy(severity_for(F.col("value") / 20).alias("severity"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "quantiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
    FROM events GROUP BY 1""",
)
def quantiles_query(spark, sf_dir):
    out = exact_quantiles(read_table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
