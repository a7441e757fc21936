"""Governance over spans (order lines), documents and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import govern as gv
from opsloom.plans.catalog import query
from opsloom.plans.mappings import SPANS_SQL, STAR_SQL, TRACES_SQL, Star, spans
from opsloom.plans.trace_queries import order_traces
from opsloom.session import cut_lineage
from opsloom.sources.sinks import insert_unique
from opsloom.sources.tables import read_table

NOW_NS = 978_307_200 * 10**9  # 2001-01-01


def _policies(spark, sf_dir):
    """One policy per project: urgent work has its own limits, the rest follows the defaults."""
    projects = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("project_id")).distinct()
    own = F.col("project_id") == "1-URGENT"
    models = F.array(F.lit("model_0"), F.lit("model_1"), F.lit("model_2"), F.lit("model_3"))
    overrides = projects.select(
        "project_id",
        F.lit(None).cast("boolean").alias("capture_content"),
        F.when(F.col("project_id") == "2-HIGH", "block").alias("pii"),
        F.when(own, models).alias("allowed_models"),
        F.when(own, F.array(F.lit("tool_2"))).alias("forbidden_tools"),
        F.when(own, 900).cast("bigint").alias("max_tokens_per_call"),
        F.when(own, 0.3).alias("max_cost_per_trace_usd"),
        F.when(F.col("project_id") == "5-LOW", 6).cast("bigint").alias("max_steps_per_trace"),
        F.when(own, 0.5).otherwise(0.8).alias("daily_budget_usd"),
        F.lit(None).cast("int").alias("retention_days"),
        F.when(own, 3).alias("content_retention_days"),
    )
    return gv.resolve_policy(projects, overrides)


POLICY_SQL = """
pol AS (SELECT DISTINCT o_orderpriority AS project_id, CASE WHEN o_orderpriority = '2-HIGH' THEN 'block' ELSE 'redact' END AS pii,
  CASE WHEN o_orderpriority = '1-URGENT' THEN ['model_0', 'model_1', 'model_2', 'model_3'] ELSE [] END AS models,
  CASE WHEN o_orderpriority = '1-URGENT' THEN ['tool_2'] ELSE [] END AS tools,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 900 ELSE 32000 END AS max_tokens,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(0.3 AS DOUBLE) ELSE 0.5 END AS max_cost,
  CASE WHEN o_orderpriority = '5-LOW' THEN 6 ELSE 60 END AS max_steps,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(0.5 AS DOUBLE) ELSE 0.8 END AS budget FROM orders)"""


@query(
    "resolve_policy",
    f"WITH {POLICY_SQL} SELECT project_id, pii, len(models) AS models, len(tools) AS tools, CAST(max_tokens AS BIGINT) AS max_tokens, CAST(max_steps AS BIGINT) AS max_steps, CAST(budget AS DOUBLE) AS budget FROM pol",
)
def resolve_policy(spark, sf_dir):
    return _policies(spark, sf_dir).select(
        "project_id", "pii", F.size("allowed_models").cast("bigint").alias("models"),
        F.size("forbidden_tools").cast("bigint").alias("tools"), F.col("max_tokens_per_call").alias("max_tokens"),
        F.col("max_steps_per_trace").alias("max_steps"), F.col("daily_budget_usd").alias("budget"),
    )


SPAN_VIOLATIONS_SQL = (
    SPANS_SQL
    + ","
    + POLICY_SQL
    + """, sv AS (SELECT s.project_id, trace_id, span_id, unnest(list_filter([
    CASE WHEN kind = 'llm' AND len(models) > 0 AND NOT list_contains(models, model) THEN 'unapproved_model|high' END,
    CASE WHEN kind = 'tool' AND list_contains(tools, tool_name) THEN 'forbidden_tool|critical' END,
    CASE WHEN input_tokens + output_tokens > max_tokens THEN 'token_limit|medium' END,
    CASE WHEN has_pii THEN 'sensitive_data|high' END], lambda x: x IS NOT NULL)) AS v FROM spans s JOIN pol ON s.project_id = pol.project_id)"""
)


@query(
    "span_violations",
    f"WITH {SPAN_VIOLATIONS_SQL} SELECT project_id, split_part(v, '|', 1) AS policy, split_part(v, '|', 2) AS severity, count(*) AS n FROM sv GROUP BY ALL",
)
def span_violations(spark, sf_dir):
    found = gv.span_violations(spans(spark, sf_dir), _policies(spark, sf_dir))
    return found.groupBy("project_id", "policy", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "violations_by_policy",
    f"WITH {SPAN_VIOLATIONS_SQL} SELECT split_part(v, '|', 1) AS policy, split_part(v, '|', 2) AS severity, count(*) AS n FROM sv GROUP BY ALL",
)
def violations_by_policy(spark, sf_dir):
    return gv.violations_by_policy(gv.span_violations(spans(spark, sf_dir), _policies(spark, sf_dir)))


@query(
    "trace_violations",
    "WITH "
    + TRACES_SQL
    + ","
    + POLICY_SQL
    + """ SELECT t.project_id, trace_id, 'trace_cost_limit' AS policy, 'medium' AS severity FROM traces t JOIN pol USING (project_id) WHERE has_root AND cost_usd > max_cost
    UNION ALL SELECT t.project_id, trace_id, 'step_limit', 'high' FROM traces t JOIN pol USING (project_id) WHERE has_root AND span_count > max_steps""",
)
def trace_violations(spark, sf_dir):
    found = gv.trace_violations(order_traces(spark, sf_dir), _policies(spark, sf_dir))
    return found.select("project_id", "trace_id", "policy", "severity")


@query(
    "budget_violations",
    "WITH "
    + SPANS_SQL
    + ","
    + POLICY_SQL
    + """, d AS (SELECT project_id, DATE '1970-01-01' + CAST(start_ns // 86400000000000 AS INTEGER) AS day, round(sum(cost_usd), 8) AS spent FROM spans GROUP BY ALL)
    SELECT project_id, 'budget:' || day AS trace_id, 'high' AS severity FROM d JOIN pol USING (project_id) WHERE spent > budget""",
)
def budget_violations(spark, sf_dir):
    found = gv.budget_violations(spans(spark, sf_dir), _policies(spark, sf_dir))
    return found.select("project_id", "trace_id", "severity")


@query(
    "insert_unique",
    f"WITH {SPAN_VIOLATIONS_SQL} SELECT project_id, split_part(v, '|', 1) AS policy, count(DISTINCT span_id) AS n FROM sv GROUP BY ALL",
)
def insert_unique_query(spark, sf_dir):
    """Violations of a first delivery, then of a second delivery that repeats all of them."""
    found = cut_lineage(gv.span_violations(spans(spark, sf_dir), _policies(spark, sf_dir)))
    key = ["project_id", "trace_id", "span_id", "policy"]
    empty = found.filter("false")
    stored = insert_unique(empty, found, key, ["ts_ns", "message"])
    again = insert_unique(stored, found, key, ["ts_ns", "message"])
    return again.groupBy("project_id", "policy").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tenant_governance_counts",
    "WITH "
    + TRACES_SQL
    + ","
    + POLICY_SQL
    + """, v AS (SELECT project_id, 'trace_cost_limit' AS policy FROM traces JOIN pol USING (project_id) WHERE has_root AND cost_usd > max_cost
      UNION ALL SELECT project_id, 'step_limit' FROM traces JOIN pol USING (project_id) WHERE has_root AND span_count > max_steps),
    t AS (SELECT project_id, count(*) AS traces, CAST(sum(span_count) AS BIGINT) AS spans, CAST(sum(pii_spans) AS BIGINT) AS pii_spans FROM traces GROUP BY 1)
    SELECT t.project_id, traces, spans, pii_spans, policy, violations FROM t LEFT JOIN (
      SELECT project_id, policy, count(*) AS violations FROM v GROUP BY ALL) x ON t.project_id = x.project_id""",
)
def tenant_governance_counts(spark, sf_dir):
    traces = order_traces(spark, sf_dir)
    return gv.tenant_counts(traces, gv.trace_violations(traces, _policies(spark, sf_dir)))


def _content_spans(spark, sf_dir):
    """Spans with texts: the order priority and status as prompt and answer."""
    return spans(spark, sf_dir).withColumns({"input_text": F.col("name"), "output_text": F.col("kind")})


@query(
    "apply_retention",
    "WITH "
    + SPANS_SQL
    + f""" SELECT count(*) FILTER (start_ns < {NOW_NS} - 700 * 86400000000000) AS content_scrubbed,
    count(*) FILTER (start_ns < {NOW_NS} - 1400 * 86400000000000) AS spans_deleted, count(*) FILTER (start_ns >= {NOW_NS} - 1400 * 86400000000000) AS kept,
    count(*) FILTER (start_ns >= {NOW_NS} - 700 * 86400000000000) AS with_text FROM spans""",
)
def apply_retention(spark, sf_dir):
    rows = _content_spans(spark, sf_dir)
    kept, _, counts = gv.apply_retention(rows, rows.select("project_id", "trace_id", "start_ns"), NOW_NS, 1400, 700)
    left = kept.agg(F.count(F.lit(1)).alias("kept"), F.count("input_text").alias("with_text"))
    pair = left.select(F.struct("kept", "with_text").alias("s")).scalar()
    return counts.select("content_scrubbed", "spans_deleted", pair["kept"].alias("kept"), pair["with_text"].alias("with_text"))


@query("apply_content_policy")
def apply_content_policy(spark, sf_dir):
    """Conversation turns as span contents: each language of the policy table redacts, blocks or allows."""
    turns = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("project_id"), F.col("doc_id").cast("string").alias("span_id"), F.col("text").alias("input_text"),
        F.reverse("source").alias("output_text"), F.create_map(F.lit("source"), F.col("source"), F.lit("head"), F.col("text")).alias("attributes"),
    )
    projects = turns.select("project_id").distinct()
    mode = F.when(F.col("project_id") == "en", "redact").when(F.col("project_id") == "fr", "block").otherwise("allow")
    policies = projects.select("project_id", mode.alias("pii"), F.lit(True).alias("capture_content"))
    out = gv.apply_content_policy(turns, policies)
    return out.select(
        "project_id", "span_id", F.md5("input_text").alias("input_md5"), F.md5(F.col("attributes")["head"]).alias("head_md5"),
        F.to_json("pii_found").alias("pii_found"),
    )


@query("rescan_stored")
def rescan_stored(spark, sf_dir):
    """Every stored text of documents, conversations and pages."""
    read = lambda name: read_table(spark, sf_dir, name)
    return gv.rescan_stored(
        {
            "documents": (read("documents"), ["text"]),
            "conversations": (read("conversations"), ["text"]),
            "pages": (read("pages"), ["html"]),
        }
    )


@query(
    "redacted_read",
    "WITH " + SPANS_SQL + " SELECT project_id, span_id, status, arrival FROM spans WHERE project_id = '3-MEDIUM'",
)
def redacted_read(spark, sf_dir):
    rows = gv.tenant_scope(_content_spans(spark, sf_dir), "3-MEDIUM")
    shown = gv.redacted_read(rows, ["read:metrics"])
    return shown.select(*[c for c in shown.columns if c in ("project_id", "span_id", "status", "arrival", "input_text", "output_text")])


@query(
    "tenant_scope",
    "WITH " + TRACES_SQL + " SELECT trace_id, span_count FROM traces WHERE project_id = '2-HIGH'",
)
def tenant_scope(spark, sf_dir):
    return gv.tenant_scope(order_traces(spark, sf_dir), "2-HIGH").select("trace_id", "span_count")


def load_star(sf_dir):
    def load(session):
        star = Star(session, sf_dir)
        tables = {n: star[n] for n in ("members", "plans", "diagnoses", "procedures", "providers", "claim_lines")}
        return {**tables, "claims": star["line_claims"]}

    return load


ANALYST = gv.RolePolicy(
    "analyst", ("plans", "members", "providers", "diagnoses", "procedures", "claims", "claim_lines"),
    ("members.member_name", "members.balance"),
)
AUDITOR = gv.RolePolicy(
    "claims_auditor", ("plans", "members", "providers", "diagnoses", "procedures", "claims", "claim_lines"), ("members.balance",),
    write_tables=("audit_flags",), max_rows=500,
)
PORTAL = gv.ROLES["provider_portal"]


@query(
    "governed_view",
    f"WITH {STAR_SQL} SELECT status, count(*) AS n, round(sum(paid_amount), 2) AS paid FROM line_claims WHERE provider_id = 7 GROUP BY 1",
)
def governed_view(spark, sf_dir):
    sql = "WITH own AS (SELECT * FROM claims) SELECT status, count(*) AS n, round(sum(paid_amount), 2) AS paid FROM own GROUP BY status"
    return gv.governed_sql(spark, load_star(sf_dir), PORTAL, sql, {"provider_id": 7})


@query(
    "semi_join_row_filter",
    f"""WITH {STAR_SQL} SELECT procedure_code, CAST(sum(units) AS BIGINT) AS units FROM claim_lines
    WHERE claim_id IN (SELECT claim_id FROM line_claims WHERE provider_id = 7) GROUP BY 1 ORDER BY units DESC, procedure_code LIMIT 200""",
)
def semi_join_row_filter(spark, sf_dir):
    """A portal user's lines, capped at the role's 200 rows."""
    sql = "SELECT procedure_code, sum(units) AS units FROM claim_lines GROUP BY procedure_code ORDER BY units DESC, procedure_code"
    return gv.governed_sql(spark, load_star(sf_dir), PORTAL, sql, {"provider_id": 7})


@query(
    "truncated_read",
    f"""WITH {STAR_SQL}, own AS (SELECT claim_id, procedure_code, CAST(units AS BIGINT) AS units FROM claim_lines
      WHERE claim_id IN (SELECT claim_id FROM line_claims WHERE provider_id = 7))
    SELECT *, (SELECT count(*) FROM own) > 200 AS truncated FROM own ORDER BY claim_id, procedure_code, units LIMIT 200""",
)
def truncated_read(spark, sf_dir):
    """A portal user's first lines, with a flag that tells whether the role's 200 rows left some out."""
    sql = "SELECT claim_id, procedure_code, CAST(units AS BIGINT) AS units FROM claim_lines ORDER BY claim_id, procedure_code, units"
    return gv.governed_sql(spark, load_star(sf_dir), PORTAL, sql, {"provider_id": 7}, flag="truncated")


@query(
    "row_level_security",
    f"WITH {STAR_SQL} SELECT claim_id, primary_diagnosis_code, status FROM line_claims WHERE provider_id = 3",
)
def row_level_security(spark, sf_dir):
    views = gv.governed_views(load_star(sf_dir)(spark), PORTAL, {"provider_id": 3})
    return views["claims"].select("claim_id", "primary_diagnosis_code", "status")


@query("visible_columns", f"WITH {STAR_SQL} SELECT state, plan_id, count(*) AS n FROM members GROUP BY ALL")
def visible_columns(spark, sf_dir):
    members = gv.governed_views(load_star(sf_dir)(spark), ANALYST)["members"]
    return members.groupBy(*[c for c in members.columns if c in ("state", "plan_id", "member_name", "balance")]).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "row_cap",
    f"WITH {STAR_SQL} SELECT claim_id, billed_amount FROM claims ORDER BY billed_amount DESC, claim_id LIMIT 500",
)
def row_cap(spark, sf_dir):
    claims = Star(spark, sf_dir)["claims"].select("claim_id", "billed_amount")
    return gv.row_cap(claims.orderBy(F.desc("billed_amount"), "claim_id"), AUDITOR, own_limit=5000)


@query(
    "leak_semi_join",
    f"""WITH {STAR_SQL}, res AS (SELECT state, max(member_name) AS who, CAST(count(*) AS VARCHAR) AS n FROM members GROUP BY 1)
    SELECT 'who' AS "column", count(*) AS cells FROM res WHERE who IN (SELECT member_name FROM members)""",
)
def leak_semi_join(spark, sf_dir):
    """A result that slipped a denied column through is caught by its values."""
    members = Star(spark, sf_dir)["members"]
    result = members.groupBy("state").agg(F.max("member_name").alias("who"), F.count(F.lit(1)).cast("string").alias("n"))
    leaks = gv.leaked_cells(result, [members.select("member_name")])
    return leaks.groupBy("column").agg(F.count(F.lit(1)).alias("cells"))


# Attempts that must never show restricted data.
ATTEMPTS = (
    ("names", ANALYST, "SELECT member_name FROM members WHERE state = 'NATION_3'", {}),
    ("star", ANALYST, "SELECT * FROM members", {}),
    ("where", ANALYST, "SELECT count(*) AS n FROM members WHERE balance > 5000", {}),
    ("subquery", ANALYST, "SELECT state FROM members m WHERE EXISTS (SELECT 1 FROM members x WHERE x.balance < m.plan_id)", {}),
    ("drop", ANALYST, "DROP TABLE claims", {}),
    ("delete", ANALYST, "DELETE FROM claims WHERE status = 'denied'", {}),
    ("insert", ANALYST, "INSERT INTO audit_flags VALUES (1, 'x')", {}),
    ("auditor", AUDITOR, "SELECT member_name, balance FROM members", {}),
    ("auditor_ok", AUDITOR, "SELECT member_name, state FROM members ORDER BY member_name", {}),
    ("other_tenant", PORTAL, "SELECT sum(paid_amount) AS p FROM claims WHERE provider_id = 8", {"provider_id": 7}),
    ("foreign_table", PORTAL, "SELECT * FROM members", {"provider_id": 7}),
    ("no_context", PORTAL, "SELECT * FROM claims", {}),
    ("show", ANALYST, "SHOW TABLES", {}),
    ("reflect", ANALYST, "SELECT reflect('java.lang.System', 'getenv', 'HOME') AS x", {}),
)


@query("redteam_matrix")
def redteam_matrix(spark, sf_dir):
    return gv.redteam_matrix(spark, load_star(sf_dir), ATTEMPTS)
