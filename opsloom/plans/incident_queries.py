"""Incident investigation over the order/line mapping.

Incidents here are the periods with an injected slowdown, one per project and period; the detector
that leads each of them rotates with the period, so that every outlier rule is exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import detect as dt
from opsloom.operators import rca
from opsloom.plans.catalog import query
from opsloom.plans.detection_queries import order_incidents
from opsloom.plans.mappings import PERIOD_NS, SPANS_SQL, TRACES_SQL, spans
from opsloom.plans.trace_queries import stored_traces
from opsloom.session import cut_lineage
from opsloom.sources.tables import read_table

LEADS = ("error_rate", "latency", "tool_loop", "sensitive_data", "cost", "throughput")
RULES = ("errors", "slow", "loops", "sensitive", "expensive", "all")


def period_incidents(traces):
    """One incident per project and injected period that has traces."""
    period = (F.col("start_ns") - F.pmod("start_ns", F.lit(PERIOD_NS))) / F.lit(PERIOD_NS)
    lead = F.element_at(
        F.array(*[F.lit(d) for d in LEADS]), (F.pmod(F.floor(F.col("period") / 11), F.lit(6)) + 1).cast("int")
    )
    return (
        traces.filter("has_root")
        .select("project_id", period.cast("bigint").alias("period"))
        .filter(F.col("period") % 11 == 5)
        .distinct()
        .select(
            "project_id",
            F.concat_ws("|", "project_id", F.col("period").cast("string")).alias("incident_id"),
            (F.col("period") * F.lit(PERIOD_NS)).alias("start_ns"),
            ((F.col("period") + 1) * F.lit(PERIOD_NS)).alias("end_ns"),
            F.array(lead).alias("detectors"),
            F.concat(F.lit("Period "), F.col("period").cast("string")).alias("title"),
        )
    )


def release_changes(span_rows):
    """Deploy events: the first span of each agent version in a project."""
    return (
        span_rows.groupBy("project_id", "agent_version")
        .agg(F.min("start_ns").alias("ts_ns"))
        .select(
            "project_id",
            F.concat_ws("|", "project_id", "agent_version").alias("change_id"),
            "ts_ns",
            F.lit("deploy").alias("kind"),
            F.concat(F.lit("release "), F.col("agent_version")).alias("description"),
            F.create_map(F.lit("agent_version"), F.col("agent_version")).alias("attributes"),
        )
    )


def _slices(spark, sf_dir):
    traces = stored_traces(spark, sf_dir)
    incidents = period_incidents(traces)
    base = rca.baseline_ranges(incidents, lookback_ns=3 * PERIOD_NS, touch_ns=0)
    rules = incidents.select("incident_id", rca.lead_outlier(F.col("detectors")).alias("rule"))
    return incidents, cut_lineage(rca.incident_slices(traces, incidents, base, PERIOD_NS)), rules


SLICES_SQL = (
    TRACES_SQL
    + f""",
inc AS (SELECT DISTINCT project_id, start_ns // {PERIOD_NS} AS period FROM traces
  WHERE has_root AND (start_ns // {PERIOD_NS}) % 11 = 5),
incidents AS (SELECT project_id, project_id || '|' || period AS incident_id, period * {PERIOD_NS} AS s,
  (period + 1) * {PERIOD_NS} AS e, ['errors', 'slow', 'loops', 'sensitive', 'expensive', 'all'][period // 11 % 6 + 1] AS rule
  FROM inc),
slices AS (
  SELECT t.*, i.incident_id, i.rule, 'incident' AS slice, i.e - i.s AS span FROM traces t JOIN incidents i
  ON t.project_id = i.project_id AND t.start_ns >= i.s AND t.start_ns < i.e WHERE has_root
  UNION ALL
  SELECT t.*, i.incident_id, i.rule, 'baseline', 3 * {PERIOD_NS} FROM traces t JOIN incidents i
  ON t.project_id = i.project_id AND t.start_ns >= i.s - 3 * {PERIOD_NS} AND t.start_ns < i.s WHERE has_root),
bars AS (SELECT incident_id, quantile_cont(duration_ms, 0.95) AS slow, quantile_cont(cost_usd, 0.95) AS dear
  FROM slices WHERE slice = 'baseline' GROUP BY 1),
marked AS (SELECT s.*, CASE rule WHEN 'errors' THEN error_count > 0 WHEN 'slow' THEN duration_ms > coalesce(slow, 0)
  WHEN 'loops' THEN max_tool_repeat >= 4 WHEN 'sensitive' THEN pii_spans > 0
  WHEN 'expensive' THEN cost_usd > coalesce(dear, 0) ELSE true END AS is_outlier
  FROM slices s LEFT JOIN bars b ON s.incident_id = b.incident_id WHERE slice = 'incident')"""
)


@query(
    "compare_windows",
    "WITH "
    + SLICES_SQL
    + """ SELECT incident_id, slice, count(*) AS traces, round(count(*) / greatest(max(span) / 60000000000, 1.0), 6) AS traces_per_min,
    round(quantile_cont(duration_ms, 0.5), 1) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 1) AS p95_ms,
    round(avg(CASE WHEN error_count > 0 THEN 1.0 ELSE 0 END), 4) AS error_rate, round(avg(cost_usd), 6) AS cost_per_trace,
    round(avg(span_count), 2) AS spans_per_trace, round(avg(CASE WHEN max_tool_repeat >= 4 THEN 1.0 ELSE 0 END), 4) AS looping_rate,
    round(avg(CASE WHEN pii_spans > 0 THEN 1.0 ELSE 0 END), 4) AS sensitive_rate FROM slices GROUP BY ALL""",
)
def compare_windows(spark, sf_dir):
    return rca.compare_windows(_slices(spark, sf_dir)[1])


@query(
    "component_breakdown",
    "WITH "
    + SLICES_SQL
    + """, calls AS (SELECT l.incident_id, l.slice, CASE WHEN kind = 'llm' THEN 'llm:' || model ELSE 'tool:' || tool_name END AS component,
      s.duration_ms AS ms, s.status, s.input_tokens AS t FROM spans s JOIN slices l
      ON s.project_id = l.project_id AND s.trace_id = l.trace_id WHERE kind IN ('llm', 'tool')),
    st AS (SELECT incident_id, component, slice, count(*) AS n, round(quantile_cont(ms, 0.5), 1) AS p,
      round(avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0 END), 4) AS e, round(avg(t), 1) AS tok FROM calls GROUP BY ALL),
    pr AS (SELECT c.incident_id, c.component, c.n AS now_calls, coalesce(b.n, 0) AS base_calls, c.p AS cp, coalesce(b.p, 0) AS bp,
      c.e AS ce, coalesce(b.e, 0) AS be, c.tok AS ct, coalesce(b.tok, 0) AS bt FROM (SELECT * FROM st WHERE slice = 'incident') c
      LEFT JOIN (SELECT * FROM st WHERE slice = 'baseline') b ON c.incident_id = b.incident_id AND c.component = b.component),
    sc AS (SELECT *, round(greatest(CASE WHEN bp <> 0 THEN abs(cp / bp - 1) ELSE 1.0 END, abs(ce - be) * 10,
      CASE WHEN bt <> 0 THEN abs(ct / bt - 1) ELSE 0.0 END), 3) AS change_score FROM pr)
    SELECT incident_id, component, now_calls, base_calls, base_calls = 0 AS new_in_incident, change_score,
      CASE WHEN bp <> 0 THEN round(cp / bp, 2) END AS latency_ratio FROM sc
    QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY change_score DESC, component) <= 8""",
)
def component_breakdown(spark, sf_dir):
    out = rca.component_breakdown(_slices(spark, sf_dir)[1], spans(spark, sf_dir))
    return out.select(
        "incident_id", "component", "now_calls", "base_calls", "new_in_incident", "change_score", "latency_ratio"
    )


@query(
    "outlier_traces",
    "WITH " + SLICES_SQL + " SELECT incident_id, rule, trace_id, is_outlier FROM marked",
)
def outlier_traces(spark, sf_dir):
    _, slices, rules = _slices(spark, sf_dir)
    return rca.mark_outliers(slices, rules).select("incident_id", "rule", "trace_id", "is_outlier")


@query(
    "attribute_contrast",
    "WITH "
    + SLICES_SQL
    + """, sides AS (SELECT incident_id, rule, project_id, trace_id, 'out' AS side FROM marked WHERE is_outlier
      UNION ALL SELECT incident_id, rule, project_id, trace_id, 'base' FROM slices WHERE slice = 'baseline'),
    tot AS (SELECT incident_id, count(*) FILTER (side = 'out') AS no, count(*) FILTER (side = 'base') AS nb FROM sides GROUP BY 1),
    attrs AS (SELECT DISTINCT d.incident_id, d.side, d.trace_id, unnest(list_filter(['model=' || model, 'tool_name=' || tool_name,
      'error_type=' || error_type, 'agent_version=' || agent_version, 'prompt_version=' || prompt_version,
      'provider=' || provider], lambda x: x IS NOT NULL)) AS attribute
      FROM spans s JOIN sides d ON s.project_id = d.project_id AND s.trace_id = d.trace_id
      WHERE CASE rule WHEN 'errors' THEN status = 'error' AND kind <> 'agent' WHEN 'sensitive' THEN has_pii ELSE true END),
    c AS (SELECT incident_id, attribute, count(DISTINCT trace_id) FILTER (side = 'out') AS o,
      count(DISTINCT trace_id) FILTER (side = 'base') AS b FROM attrs GROUP BY ALL HAVING o > 0),
    r AS (SELECT c.incident_id, attribute, no AS outlier_traces, nb AS baseline_traces, round(o / greatest(1, no), 3) AS outlier_share,
      round(b / greatest(1, nb), 3) AS baseline_share, round(o / greatest(1, no) - b / greatest(1, nb), 3) AS lift
      FROM c JOIN tot ON c.incident_id = tot.incident_id)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY lift DESC, outlier_share DESC, attribute) <= 8""",
)
def attribute_contrast(spark, sf_dir):
    _, slices, rules = _slices(spark, sf_dir)
    return rca.attribute_contrast(slices, spans(spark, sf_dir), rules).drop("position")


@query(
    "sample_traces",
    "WITH "
    + SLICES_SQL
    + """ SELECT incident_id, trace_id, span_count, error_count FROM marked QUALIFY row_number() OVER (PARTITION BY incident_id
    ORDER BY CASE rule WHEN 'slow' THEN duration_ms WHEN 'errors' THEN error_count WHEN 'loops' THEN max_tool_repeat
      WHEN 'sensitive' THEN pii_spans WHEN 'expensive' THEN cost_usd ELSE 0 END DESC, trace_id) <= 3""",
)
def sample_traces(spark, sf_dir):
    _, slices, rules = _slices(spark, sf_dir)
    return rca.sample_traces(slices, rules).select("incident_id", "trace_id", "span_count", "error_count")


@query(
    "lookback_range_join",
    "WITH "
    + SLICES_SQL
    + f""", ch AS (SELECT project_id, project_id || '|' || agent_version AS change_id, min(start_ns) AS ts FROM spans GROUP BY project_id, agent_version)
    SELECT incident_id, change_id, round((s - ts) / 60000000000, 1) AS minutes_before FROM incidents i JOIN ch
    ON i.project_id = ch.project_id AND ts >= s - 6 * {PERIOD_NS} AND ts < e""",
)
def lookback_range_join(spark, sf_dir):
    incidents = period_incidents(stored_traces(spark, sf_dir))
    changes = release_changes(spans(spark, sf_dir))
    return rca.recent_changes(incidents, changes, 6 * PERIOD_NS, PERIOD_NS).select(
        "incident_id", "change_id", "minutes_before"
    )


# Busy days of each event type as incidents of one organisation: overlap across projects.
@query(
    "overlap_join",
    """WITH d AS (SELECT event_type, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY ALL),
    m AS (SELECT event_type, avg(n) AS m FROM d GROUP BY 1),
    i AS (SELECT d.event_type AS project_id, d.event_type || '|' || day AS incident_id, day AS s, day + 2 AS e,
      CASE day % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'spend' ELSE 'performance' END AS fam
      FROM d JOIN m ON d.event_type = m.event_type WHERE n > m)
    SELECT a.project_id, a.incident_id, b.project_id AS other_project_id, b.incident_id AS other_incident_id FROM i a JOIN i b
    ON a.project_id <> b.project_id AND a.s < b.e AND b.s < a.e AND a.fam = b.fam""",
)
def overlap_join(spark, sf_dir):
    from opsloom.sources.tables import epoch_days

    days = (
        read_table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("project_id"), epoch_days(F.col("ts")).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    mean = days.groupBy("project_id").agg(F.avg("n").alias("m"))
    incidents = days.join(mean, "project_id").filter("n > m").select(
        "project_id",
        F.concat_ws("|", "project_id", F.col("day").cast("string")).alias("incident_id"),
        F.lit("busy").alias("title"),
        F.col("day").alias("start_ns"),
        (F.col("day") + 2).alias("end_ns"),
        F.array(F.when(F.col("day") % 3 == 1, "cost").otherwise("latency")).alias("detectors"),
    )
    projects = mean.select("project_id", F.lit("org").alias("org"))
    return rca.other_projects_affected(incidents, projects, bin_ns=4).drop("other_title")


@query("baseline_range")
def baseline_range(spark, sf_dir):
    return rca.baseline_ranges(order_incidents(spark, sf_dir)[3], 3 * PERIOD_NS, PERIOD_NS)


@query("incident_overview")
def incident_overview(spark, sf_dir):
    _, _, anomalies, incidents, membership = order_incidents(spark, sf_dir)
    out = rca.incident_overview(incidents, anomalies, membership)
    return out.withColumns({c: F.round(c, 4) for c in ("observed", "baseline", "score")})


def _reports(spark, sf_dir):
    traces, rows = stored_traces(spark, sf_dir), spans(spark, sf_dir)
    incidents = period_incidents(traces)
    base = rca.baseline_ranges(incidents, 3 * PERIOD_NS, 0)
    slices = cut_lineage(rca.incident_slices(traces, incidents, base, PERIOD_NS))
    rules = incidents.select("incident_id", rca.lead_outlier(F.col("detectors")).alias("rule"))
    anomalies = cut_lineage(dt.detect_anomalies(traces, rows, PERIOD_NS))
    members = anomalies.join(
        incidents.select("project_id", F.col("start_ns").alias("window_start_ns"), "incident_id"),
        ["project_id", "window_start_ns"],
    ).select("project_id", "anomaly_id", "incident_id")
    overview = cut_lineage(rca.incident_overview(incidents, anomalies, members))
    changes = rca.recent_changes(incidents, release_changes(rows), 6 * PERIOD_NS, PERIOD_NS)
    projects = incidents.select("project_id", F.lit("org").alias("org")).distinct()
    reports = rca.root_cause(
        incidents,
        cut_lineage(rca.attribute_contrast(slices, rows, rules)),
        cut_lineage(rca.component_breakdown(slices, rows)),
        rca.sample_traces(slices, rules),
        changes,
        overview,
        rca.other_projects_affected(incidents, projects, PERIOD_NS),
    )
    return reports, traces, changes, overview, slices, rules


@query("root_cause")
def root_cause(spark, sf_dir):
    return _reports(spark, sf_dir)[0].select(
        "project_id",
        "incident_id",
        "category",
        "cause_dimension",
        "cause_value",
        "confidence",
        "summary",
        F.size("evidence").alias("evidence_count"),
    )


@query("validate_evidence")
def validate_evidence(spark, sf_dir):
    reports, traces, changes, overview, slices, rules = _reports(spark, sf_dir)
    rows, everything = spans(spark, sf_dir), rules.withColumn("rule", F.lit("all"))
    return rca.validate_evidence(
        cut_lineage(reports),
        traces,
        changes,
        overview,
        cut_lineage(rca.attribute_contrast(slices, rows, everything, top=None)),
        cut_lineage(rca.component_breakdown(slices, rows, top=None)),
    )
