"""Keyed stores, feeds and payload round trips over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import series
from opsloom.operators import spans as sp
from opsloom.plans.catalog import query
from opsloom.plans.mappings import SPANS_SQL, TRACES_SQL, UNIQUE_SPANS_SQL, spans
from opsloom.plans.trace_queries import ARRIVAL, SPAN_KEY, order_traces
from opsloom.sources import payload, sinks
from opsloom.sources.tables import capped_rows, epoch_micros, read_table


@query(
    "insert_ignore",
    "WITH " + UNIQUE_SPANS_SQL + " SELECT project_id, span_id, arrival, status FROM uspans WHERE start_ns >= 900000000000000000",
)
def insert_ignore(spark, sf_dir):
    """Spans of 1998-07 on arrive after the older ones were stored."""
    rows = spans(spark, sf_dir)
    stored = sinks.insert_ignore(rows.filter("start_ns < 900000000000000000"), SPAN_KEY, ARRIVAL)
    return sinks.insert_ignore(rows, SPAN_KEY, ARRIVAL, stored).select("project_id", "span_id", "arrival", "status")


@query(
    "insert_counts",
    "WITH "
    + SPANS_SQL
    + """ SELECT count(DISTINCT span_id) FILTER (kind <> 'agent') AS accepted, count(*) FILTER (kind <> 'agent') - count(DISTINCT span_id) FILTER (kind <> 'agent') AS duplicates,
    count(*) FILTER (kind = 'agent') AS rejected FROM spans""",
)
def insert_counts(spark, sf_dir):
    """Agent spans are taken as unidentified here, so that all three counters move."""
    return sinks.insert_counts(spans(spark, sf_dir), SPAN_KEY, F.col("kind") != "agent")


@query(
    "drop_unidentified",
    "WITH " + SPANS_SQL + " SELECT count(*) FILTER (tool_name IS NOT NULL) AS identified, count(*) FILTER (tool_name IS NULL) AS rejected FROM spans",
)
def drop_unidentified(spark, sf_dir):
    return sp.rejected_count(spans(spark, sf_dir).withColumn("span_id", F.col("tool_name")))


@query(
    "upsert_replace",
    "WITH "
    + TRACES_SQL
    + """ SELECT trace_id, span_count, CASE WHEN start_ns >= 900000000000000000 THEN 'new' ELSE 'old' END AS version FROM traces""",
)
def upsert_replace(spark, sf_dir):
    """Every trace was stored once; the ones from 1998-07 on are recomputed and replace their old row."""
    traces = order_traces(spark, sf_dir).select("project_id", "trace_id", "span_count", "start_ns")
    stored = traces.withColumn("version", F.lit("old")).withColumn(
        "span_count", F.when(F.col("start_ns") >= 900000000000000000, 0).otherwise(F.col("span_count"))
    )
    fresh = traces.filter("start_ns >= 900000000000000000").withColumn("version", F.lit("new"))
    return sinks.upsert_replace(stored, fresh, sp.TRACE_KEY).select("trace_id", "span_count", "version")


@query(
    "change_feed",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-07-01'""",
)
def change_feed(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    changes = orders.select(
        F.col("o_orderpriority").alias("project_id"), (F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * F.lit(86_400 * 10**9)).alias("ts_ns"),
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"),
    )
    feed = sinks.changes_between(changes, "3-MEDIUM", 852_076_800 * 10**9, 867_715_200 * 10**9)
    return feed.select("o_orderkey", "day")


@query(
    "scan_warehouse",
    "SELECT o_orderkey, o_totalprice, true AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def scan_warehouse(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return capped_rows(orders, 100, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query(
    "append_approved",
    """SELECT o_orderkey AS claim_id, 'check ' || o_orderpriority AS reason FROM orders WHERE o_totalprice > 300000 AND o_custkey % 2 = 0""",
)
def append_approved(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    proposed = orders.filter("o_totalprice > 300000").select(
        F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("check "), "o_orderpriority").alias("reason")
    )
    approved = orders.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("claim_id"))
    return sinks.append_approved(proposed, approved, "claim_id", "audit_flags", ("audit_flags",))


@query(
    "content_access_log",
    """SELECT epoch_us(ts) * 1000 AS ts_ns, event_type AS project_id, CAST(event_id AS VARCHAR) AS trace_id FROM events ORDER BY ts DESC, event_type, CAST(event_id AS VARCHAR) LIMIT 500""",
)
def content_access_log(spark, sf_dir):
    """Views of the event log as content reads; the newest 500 are what an auditor sees."""
    reads = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("project_id"), F.col("event_id").cast("string").alias("trace_id"), "user_id", "ts"
    )
    log = sinks.access_log_rows(
        reads, F.concat(F.lit("key_"), F.col("user_id").cast("string")), F.lit("debug"), epoch_micros(F.col("ts")) * 1000
    )
    return sinks.newest_access(log).select("ts_ns", "project_id", "trace_id")


@query(
    "incident_store",
    """SELECT 'prj_' || substr(sha256(r_name || '/' || n_name), 1, 12) AS project_id, n_name, count(c_custkey) AS members FROM nation JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def incident_store(spark, sf_dir):
    """Project ids of nations within regions, and members linked to them."""
    read = lambda name: read_table(spark, sf_dir, name)
    nations = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    projects = nations.select(sinks.project_id(F.col("r_name"), F.col("n_name")).alias("project_id"), "n_name", "n_nationkey")
    members = read("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("members"))
    return projects.join(members, "n_nationkey", "left").select("project_id", "n_name", F.coalesce("members", F.lit(0)).alias("members"))


@query(
    "link_anomalies",
    """SELECT o_orderpriority AS project_id, o_orderkey AS anomaly_id, CASE WHEN o_custkey % 3 = 0 THEN 'i' || (o_custkey % 9) END AS incident_id FROM orders""",
)
def link_anomalies(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("project_id"), F.col("o_orderkey").alias("anomaly_id"), "o_custkey")
    membership = orders.filter("o_custkey % 3 = 0").withColumn("incident_id", F.concat(F.lit("i"), (F.col("o_custkey") % 9).cast("string")))
    return sinks.link_anomalies(orders, membership).select("project_id", "anomaly_id", "incident_id")


# Every statement an ingest makes about spans survives the wire format.
PAYLOAD_ATTRIBUTES = {
    "gen_ai.request.model": "model",
    "gen_ai.system": "provider",
    "gen_ai.tool.name": "tool_name",
    "error.type": "error_type",
    "gen_ai.usage.input_tokens": "input_tokens",
    "gen_ai.usage.output_tokens": "output_tokens",
    "ext.span.kind": "kind",
    "ext.agent.version": "agent_version",
}


@query(
    "span_payload_round_trip",
    "WITH "
    + SPANS_SQL
    + """ SELECT service, kind, coalesce(model, '-') AS model, coalesce(error_type, '-') AS error_type, agent_version, count(*) AS n,
    CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(end_ns - start_ns) // 1000000 AS BIGINT) AS ms
    FROM spans GROUP BY ALL""",
)
def span_payload_round_trip(spark, sf_dir):
    rows = spans(spark, sf_dir).withColumn("status_message", F.lit(""))
    texts = payload.encode_payloads(rows, PAYLOAD_ATTRIBUTES)
    back = sp.normalize_spans(payload.flatten_payloads(texts), "p")
    return back.groupBy(
        "service", "kind", F.coalesce("model", F.lit("-")).alias("model"), F.coalesce("error_type", F.lit("-")).alias("error_type"), "agent_version"
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.expr("sum(end_ns - start_ns) div 1000000").alias("ms"),
    )


@query(
    "set_difference",
    """SELECT DISTINCT p_brand AS value FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49 AND l_discount < 0.01)""",
)
def set_difference(spark, sf_dir):
    part, line = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "lineitem")
    big = line.filter("l_quantity > 49 AND l_discount < 0.01").join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand")
    return part.select("p_brand").distinct().join(big, "p_brand", "left_anti").select(F.col("p_brand").alias("value"))


@query("sql_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT o_orderpriority FROM orders")
def sql_union(spark, sf_dir):
    read = lambda name: read_table(spark, sf_dir, name)
    names = read("nation").select(F.col("n_name").alias("name")).union(read("region").select("r_name"))
    return names.union(read("orders").select("o_orderpriority")).distinct()


@query(
    "as_of_state",
    """WITH ch AS (SELECT user_id, ts, CASE WHEN event_type = 'signup' THEN value END AS plan, CASE WHEN event_type = 'error' THEN value END AS fault
      FROM events WHERE event_type IN ('signup', 'error'))
    SELECT e.event_id, (SELECT arg_max(plan, ts) FROM ch WHERE ch.user_id = e.user_id AND ch.ts <= e.ts AND plan IS NOT NULL) AS plan,
      (SELECT arg_max(fault, ts) FROM ch WHERE ch.user_id = e.user_id AND ch.ts <= e.ts AND fault IS NOT NULL) AS fault
    FROM events e WHERE event_type = 'click'""",
)
def as_of_state(spark, sf_dir):
    """The last signup and error values of the user at the time of every click."""
    events = read_table(spark, sf_dir, "events").withColumn("us", epoch_micros(F.col("ts")))
    changes = events.filter("event_type IN ('signup', 'error')").select(
        "user_id", "us", F.when(F.col("event_type") == "signup", F.col("value")).alias("plan"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("fault"),
    )
    clicks = events.filter("event_type = 'click'").select("user_id", "us", "event_id")
    return series.as_of_state(clicks, changes, ["user_id"], "us", ["plan", "fault"]).select("event_id", "plan", "fault")


@query(
    "report_tables",
    """WITH s AS (SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS price FROM orders GROUP BY 1)
    SELECT o_orderpriority AS system, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT o_orderpriority, 'price', price FROM s""",
)
def report_tables(spark, sf_dir):
    """A metric table in the long form that reports are written in."""
    wide = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("system")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("price")
    )
    return wide.unpivot("system", ["n", "price"], "metric", "value")
