"""How the driver's tables play the roles of the domain tables, in Spark and as SQL text.

Spans are order lines (an order is a trace, its priority the project); every eleventh 30-day period
carries an injected slowdown and extra errors, so that detectors have something to find.
Claims are orders with their lines; members, providers and codes come from customer, supplier, part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.sources.tables import epoch_days, read_table

DAY_NS = 86_400 * 10**9
PERIOD_NS = 30 * DAY_NS


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, order = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    c = F.col
    days = epoch_days(c("o_orderdate"))
    hot = F.floor(days / 30) % 11 == 5
    kind = (
        F.when(c("l_linestatus") == "O", "llm").when(c("l_linenumber") == 1, "agent").otherwise("tool")
    )
    error = (c("l_returnflag") == "R") & ((c("l_discount") >= 0.09) | hot)
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    start = (days * 86400 + c("l_linenumber") * 60) * F.lit(10**9)
    base = joined.select(
        c("o_orderpriority").alias("project_id"),
        c("l_orderkey").cast("string").alias("trace_id"),
        F.concat_ws("-", c("l_orderkey"), c("l_linenumber")).alias("span_id"),
        F.when(c("l_linenumber") > 1, F.concat_ws("-", c("l_orderkey"), F.expr("l_linenumber div 2"))).alias(
            "parent_span_id"
        ),
        text("step_", c("l_linenumber")).alias("name"),
        kind.alias("kind"),
        text("svc_", c("o_custkey") % 3).alias("service"),
        start.cast("bigint").alias("start_ns"),
        ((c("l_quantity") * 100 + c("l_linenumber")) * F.when(hot, 4).otherwise(1)).alias("duration_ms"),
        F.when(error, "error").otherwise("ok").alias("status"),
        F.when(error, text("E", c("l_partkey") % 4)).alias("error_type"),
        F.when(kind == "llm", text("model_", c("l_suppkey") % 5)).alias("model"),
        F.when(kind == "llm", text("prov_", c("l_suppkey") % 2)).alias("provider"),
        F.when(kind == "tool", text("tool_", c("l_suppkey") % 3)).alias("tool_name"),
        F.when(kind == "tool", (c("l_partkey") % 2).cast("string")).alias("tool_args_hash"),
        text("a", F.year("o_orderdate")).alias("agent_version"),
        text("p", F.floor(days / 360)).alias("prompt_version"),
        (c("l_quantity") * 20).cast("bigint").alias("input_tokens"),
        (c("l_quantity") + c("l_linenumber")).cast("bigint").alias("output_tokens"),
        (F.floor("l_extendedprice") / 1e6).alias("cost_usd"),
        F.when(c("l_tax") >= 0.08, F.create_map(F.lit("EMAIL"), F.lit(1))).alias("pii_found"),
        c("l_partkey").alias("arrival"),
        c("l_suppkey").alias("arrival_tie"),
    )
    return base.withColumn("end_ns", c("start_ns") + (c("duration_ms") * 1e6).cast("bigint"))


SPANS_SQL = """
spans AS (
  SELECT o_orderpriority AS project_id, CAST(l_orderkey AS VARCHAR) AS trace_id,
    l_orderkey || '-' || l_linenumber AS span_id,
    CASE WHEN l_linenumber > 1 THEN l_orderkey || '-' || (l_linenumber // 2) END AS parent_span_id,
    'step_' || l_linenumber AS name,
    CASE WHEN l_linestatus = 'O' THEN 'llm' WHEN l_linenumber = 1 THEN 'agent' ELSE 'tool' END AS kind,
    'svc_' || (o_custkey % 3) AS service,
    (days * 86400 + l_linenumber * 60) * 1000000000 AS start_ns,
    (l_quantity * 100 + l_linenumber) * (CASE WHEN hot THEN 4 ELSE 1 END) AS duration_ms,
    CASE WHEN l_returnflag = 'R' AND (l_discount >= 0.09 OR hot) THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN l_returnflag = 'R' AND (l_discount >= 0.09 OR hot) THEN 'E' || (l_partkey % 4) END AS error_type,
    CASE WHEN l_linestatus = 'O' THEN 'model_' || (l_suppkey % 5) END AS model,
    CASE WHEN l_linestatus = 'O' THEN 'prov_' || (l_suppkey % 2) END AS provider,
    CASE WHEN l_linestatus <> 'O' AND l_linenumber <> 1 THEN 'tool_' || (l_suppkey % 3) END AS tool_name,
    CASE WHEN l_linestatus <> 'O' AND l_linenumber <> 1 THEN CAST(l_partkey % 2 AS VARCHAR) END AS tool_args_hash,
    'a' || year(o_orderdate) AS agent_version, 'p' || (days // 360) AS prompt_version,
    CAST(l_quantity * 20 AS BIGINT) AS input_tokens, CAST(l_quantity + l_linenumber AS BIGINT) AS output_tokens,
    floor(l_extendedprice) / 1e6 AS cost_usd, l_tax >= 0.08 AS has_pii,
    l_partkey AS arrival, l_suppkey AS arrival_tie,
    (days * 86400 + l_linenumber * 60) * 1000000000
      + CAST((l_quantity * 100 + l_linenumber) * (CASE WHEN hot THEN 4 ELSE 1 END) * 1e6 AS BIGINT) AS end_ns
  FROM (SELECT *, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS days,
               ((CAST(o_orderdate AS DATE) - DATE '1970-01-01') // 30) % 11 = 5 AS hot
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
)"""

# First delivery of each span wins; ties are settled by the whole row.
UNIQUE_SPANS_SQL = (
    SPANS_SQL
    + """,
uspans AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id, span_id
      ORDER BY arrival, arrival_tie, duration_ms, cost_usd, status) AS rn FROM spans) WHERE rn = 1
)"""
)

# Trace measures over delivered spans (the root is the order itself: its status names the agent).
TRACES_SQL = (
    SPANS_SQL
    + """,
repeats AS (
  SELECT project_id, trace_id, max(n) AS max_tool_repeat FROM (
    SELECT project_id, trace_id, tool_name, tool_args_hash, count(*) AS n FROM spans
    WHERE kind = 'tool' GROUP BY ALL) GROUP BY ALL
),
traces AS (
  SELECT s.project_id, s.trace_id, min(s.name) AS root_name, min(s.start_ns) AS start_ns, max(s.end_ns) AS end_ns,
    (max(s.end_ns) - min(s.start_ns)) / 1e6 AS duration_ms, count(*) AS span_count,
    count(*) FILTER (kind = 'llm') AS llm_calls, count(*) FILTER (kind = 'tool') AS tool_calls,
    CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    round(sum(cost_usd), 8) AS cost_usd, count(*) FILTER (status = 'error') AS error_count,
    coalesce(max(max_tool_repeat), 0) AS max_tool_repeat, count(*) FILTER (has_pii) AS pii_spans,
    bool_or(parent_span_id IS NULL) AS has_root
  FROM spans s LEFT JOIN repeats r ON s.project_id = r.project_id AND s.trace_id = r.trace_id
  GROUP BY s.project_id, s.trace_id
)"""
)


class Star:
    """The claims star schema over the driver's tables; each table is built when first asked for.

    claims are orders and claim lines are order lines. line_claims is the same claims model at line
    grain, for questions that need a provider or a diagnosis, which an order alone does not have.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._read = lambda name: read_table(spark, sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def claims(self) -> DataFrame:
        c = F.col
        service = c("o_orderdate").cast("date")
        status = F.when(c("o_orderstatus") == "F", "paid").when(c("o_orderstatus") == "P", "denied").otherwise("pending")
        reason = F.concat(F.lit("reason_"), (c("o_custkey") % 6).cast("string"))
        return self._read("orders").select(
            c("o_orderkey").alias("claim_id"),
            c("o_custkey").alias("member_id"),
            c("o_orderpriority").alias("claim_type"),
            service.alias("service_date"),
            F.date_add(service, (c("o_orderkey") % 120).cast("int")).alias("submitted_date"),
            status.alias("status"),
            F.when(c("o_orderstatus") == "P", reason).alias("denial_reason"),
            c("o_totalprice").alias("billed_amount"),
            F.when(c("o_orderstatus") == "F", c("o_totalprice") * 0.8).otherwise(0.0).alias("paid_amount"),
        )

    def line_claims(self) -> DataFrame:
        c = F.col
        status = F.when(c("l_returnflag") == "A", "paid").when(c("l_returnflag") == "R", "denied").otherwise("pending")
        net = c("l_extendedprice") * (1 - c("l_discount"))
        return self._read("lineitem").select(
            c("l_orderkey").alias("claim_id"),
            c("l_suppkey").alias("provider_id"),
            c("l_partkey").alias("primary_diagnosis_code"),
            c("l_linestatus").alias("claim_type"),
            c("l_shipdate").cast("date").alias("service_date"),
            status.alias("status"),
            c("l_extendedprice").alias("billed_amount"),
            F.when(c("l_returnflag") == "A", net).otherwise(0.0).alias("paid_amount"),
        )

    def claim_lines(self) -> DataFrame:
        c = F.col
        return self._read("lineitem").select(
            c("l_orderkey").alias("claim_id"),
            c("l_partkey").alias("procedure_code"),
            c("l_quantity").cast("bigint").alias("units"),
            c("l_extendedprice").alias("line_billed"),
        )

    def members(self) -> DataFrame:
        c = F.col
        return self._read("customer").join(self._read("nation"), c("c_nationkey") == c("n_nationkey")).select(
            c("c_custkey").alias("member_id"),
            c("c_name").alias("member_name"),
            c("n_name").alias("state"),
            (c("c_custkey") % 200).alias("plan_id"),
            c("c_mktsegment").alias("segment"),
            c("c_acctbal").alias("balance"),
        )

    def plans(self) -> DataFrame:
        c = F.col
        return self._read("part").select(
            c("p_partkey").alias("plan_id"),
            c("p_brand").alias("plan_type"),
            c("p_type").alias("metal_tier"),
            c("p_retailprice").alias("monthly_premium"),
        )

    def providers(self) -> DataFrame:
        c = F.col
        return self._read("supplier").join(self._read("nation"), c("s_nationkey") == c("n_nationkey")).select(
            c("s_suppkey").alias("provider_id"),
            c("s_name").alias("provider_name"),
            F.concat(F.lit("NPI"), c("s_suppkey").cast("string")).alias("npi"),
            F.concat(F.lit("spec_"), (c("s_suppkey") % 7).cast("string")).alias("specialty"),
            c("n_name").alias("state"),
            F.when(c("s_acctbal") < 2000, "out_of_network").otherwise("in_network").alias("network_status"),
        )

    def _codes(self, category: str) -> DataFrame:
        return self._read("part").select(
            F.col("p_partkey").alias("code"), F.col("p_name").alias("description"), F.col(category).alias("category")
        )

    def diagnoses(self) -> DataFrame:
        return self._codes("p_type")

    def procedures(self) -> DataFrame:
        return self._codes("p_brand")


star = Star


STAR_SQL = """
claims AS (SELECT o_orderkey AS claim_id, o_custkey AS member_id, o_orderpriority AS claim_type,
  CAST(o_orderdate AS DATE) AS service_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) AS submitted_date,
  CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'denied' ELSE 'pending' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 'reason_' || (o_custkey % 6) END AS denial_reason, o_totalprice AS billed_amount,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice * CAST(0.8 AS DOUBLE) ELSE 0 END AS paid_amount FROM orders),
line_claims AS (SELECT l_orderkey AS claim_id, l_suppkey AS provider_id, l_partkey AS primary_diagnosis_code,
  l_linestatus AS claim_type, CAST(l_shipdate AS DATE) AS service_date,
  CASE l_returnflag WHEN 'A' THEN 'paid' WHEN 'R' THEN 'denied' ELSE 'pending' END AS status, l_extendedprice AS billed_amount,
  CASE WHEN l_returnflag = 'A' THEN l_extendedprice * (1 - l_discount) ELSE 0 END AS paid_amount FROM lineitem),
claim_lines AS (SELECT l_orderkey AS claim_id, l_partkey AS procedure_code, CAST(l_quantity AS BIGINT) AS units,
  l_extendedprice AS line_billed FROM lineitem),
members AS (SELECT c_custkey AS member_id, c_name AS member_name, n_name AS state, c_custkey % 200 AS plan_id,
  c_mktsegment AS segment, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey),
plans AS (SELECT p_partkey AS plan_id, p_brand AS plan_type, p_type AS metal_tier, p_retailprice AS monthly_premium FROM part),
providers AS (SELECT s_suppkey AS provider_id, s_name AS provider_name, 'NPI' || s_suppkey AS npi,
  'spec_' || (s_suppkey % 7) AS specialty, n_name AS state,
  CASE WHEN s_acctbal < 2000 THEN 'out_of_network' ELSE 'in_network' END AS network_status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
diagnoses AS (SELECT p_partkey AS code, p_name AS description, p_type AS category FROM part),
procedures AS (SELECT p_partkey AS code, p_name AS description, p_brand AS category FROM part)"""
