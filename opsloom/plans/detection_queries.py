"""Windowed detection over the order/line mapping (windows of 30 days instead of 10 minutes)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from opsloom.functions.stats import binom_sf, poisson_sf
from opsloom.operators import detect as dt
from opsloom.operators import spans as sp
from opsloom.operators.incremental import IncrementalDetector
from opsloom.plans.catalog import query
from opsloom.plans.mappings import DAY_NS, PERIOD_NS, SPANS_SQL, TRACES_SQL, spans
from opsloom.plans.trace_queries import stored_traces
from opsloom.session import cut_lineage, stored
from opsloom.sources.tables import read_table
from opsloom.streaming.streams import work_folder


def windowed_verdicts(spark, sf_dir, window_days=30):
    """Every metric row of every series with its verdict."""
    traces, rows, width = stored_traces(spark, sf_dir), spans(spark, sf_dir), window_days * DAY_NS
    metrics = dt.metric_rows(
        dt.agent_window_metrics(traces, rows, width), dt.component_window_metrics(traces, rows, width)
    )
    return dt.detect_series(metrics).select(
        "project_id",
        "detector",
        "group_key",
        "metric",
        "window_start_ns",
        F.round("observed", 5).alias("observed"),
        F.round("baseline", 5).alias("baseline"),
        F.round("score", 3).alias("score"),
        "severity",
        "is_anomaly",
    )


AGENT_SQL = (
    TRACES_SQL
    + f""",
w AS (SELECT *, start_ns - start_ns % {PERIOD_NS} AS window_start_ns FROM traces WHERE has_root),
tok AS (SELECT w.project_id, w.window_start_ns, w.root_name, avg(s.input_tokens) AS t FROM spans s
  JOIN w ON s.project_id = w.project_id AND s.trace_id = w.trace_id WHERE s.kind = 'llm' GROUP BY ALL),
agent AS (
  SELECT w.project_id, w.window_start_ns, w.root_name, count(*) AS traces, quantile_cont(duration_ms, 0.95) AS lat,
    avg(cost_usd) AS cost, quantile_cont(CAST(span_count AS DOUBLE), 0.95) AS steps,
    count(*) FILTER (error_count > 0) AS err, count(*) FILTER (max_tool_repeat >= 4) AS loops,
    count(*) FILTER (pii_spans > 0) AS pii
  FROM w GROUP BY ALL)"""
)


@query(
    "agent_window_metrics",
    "WITH "
    + AGENT_SQL
    + """ SELECT a.project_id, a.window_start_ns, a.root_name, traces,
    CASE WHEN traces >= 8 THEN round(lat, 4) END AS latency_p95_ms, CASE WHEN traces >= 8 THEN round(cost, 12) END AS cost_per_trace,
    CASE WHEN traces >= 8 THEN round(steps, 4) END AS spans_p95, CASE WHEN traces >= 8 THEN err END AS error_traces,
    CASE WHEN traces >= 8 THEN loops END AS loop_traces, CASE WHEN traces >= 8 THEN pii END AS pii_traces,
    CASE WHEN traces >= 8 THEN round(t, 4) END AS tokens_per_llm_call
    FROM agent a LEFT JOIN tok ON a.project_id = tok.project_id AND a.window_start_ns = tok.window_start_ns
      AND a.root_name = tok.root_name""",
)
def agent_window_metrics(spark, sf_dir):
    out = dt.agent_window_metrics(stored_traces(spark, sf_dir), spans(spark, sf_dir), PERIOD_NS)
    return out.withColumns(
        {
            "latency_p95_ms": F.round("latency_p95_ms", 4),
            "cost_per_trace": F.round("cost_per_trace", 12),
            "spans_p95": F.round("spans_p95", 4),
            "tokens_per_llm_call": F.round("tokens_per_llm_call", 4),
        }
    )


@query(
    "component_window_metrics",
    "WITH "
    + AGENT_SQL
    + """, busy AS (SELECT project_id, window_start_ns FROM w GROUP BY ALL HAVING count(*) >= 8),
    calls AS (SELECT w.project_id, w.window_start_ns, s.kind, s.status,
        CASE WHEN s.kind = 'llm' THEN 'model:' || s.model ELSE 'tool:' || s.tool_name END AS component,
        s.duration_ms / greatest(1, s.output_tokens) AS mpt
      FROM spans s JOIN w ON s.project_id = w.project_id AND s.trace_id = w.trace_id
      JOIN busy b ON b.project_id = w.project_id AND b.window_start_ns = w.window_start_ns
      WHERE s.kind IN ('llm', 'tool'))
    SELECT project_id, window_start_ns, component, count(*) AS calls, count(*) FILTER (status = 'error') AS errors,
      round(CASE WHEN any_value(kind) = 'llm' THEN quantile_cont(mpt, 0.5) END, 5) AS ms_per_token_p50
    FROM calls GROUP BY ALL HAVING count(*) >= 8""",
)
def component_window_metrics(spark, sf_dir):
    out = dt.component_window_metrics(stored_traces(spark, sf_dir), spans(spark, sf_dir), PERIOD_NS)
    return out.withColumn("ms_per_token_p50", F.round("ms_per_token_p50", 5))


def fold_sql(series: str, center: str, judged: str, score: str, flag: str) -> str:
    """Recursive walk over one numbered series per (project, group); flagged windows skip the history."""
    return f"""
series AS ({series}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id, grp ORDER BY w) AS rn FROM series),
walk AS (
  SELECT project_id, grp, rn, w, x, n, CAST(NULL AS DOUBLE) AS baseline, CAST(NULL AS DOUBLE) AS score, false AS flag,
    [x] AS hx, [n] AS hn FROM numbered WHERE rn = 1
  UNION ALL
  SELECT project_id, grp, rn, w, x, n, baseline, score, flag,
    CASE WHEN flag THEN hx ELSE list_slice(list_append(hx, x), -18, -1) END,
    CASE WHEN flag THEN hn ELSE list_slice(list_append(hn, n), -18, -1) END
  FROM (
    SELECT *, CASE WHEN len(hx) >= 6 THEN {score} END AS score, coalesce(len(hx) >= 6 AND {flag}, false) AS flag FROM (
      SELECT *, {judged} AS judged FROM (
        SELECT k.project_id, k.grp, k.rn, k.w, k.x, k.n, v.hx, v.hn,
          CASE WHEN len(v.hx) >= 6 THEN {center} END AS baseline
        FROM walk v JOIN numbered k ON k.project_id = v.project_id AND k.grp = v.grp AND k.rn = v.rn + 1)))
)"""


LATENCY_FOLD = fold_sql(
    "SELECT project_id, root_name AS grp, window_start_ns AS w, lat AS x, CAST(NULL AS BIGINT) AS n FROM agent WHERE traces >= 8",
    "list_median(v.hx)",
    """(x - baseline) / greatest(1.4826 * list_median(list_transform(hx, lambda v: abs(v - baseline))),
      0.05 * abs(baseline), 1e-9)""",
    "judged",
    "judged >= 4 AND baseline <> 0 AND (x - baseline) / baseline >= 0.5 AND x - baseline >= 100",
)
RATE_FOLD = fold_sql(
    "SELECT project_id, root_name AS grp, window_start_ns AS w, CAST(err AS DOUBLE) AS x, traces AS n FROM agent WHERE traces >= 8",
    "greatest((list_sum(v.hx) + 0.5) / (list_sum(v.hn) + 1), 0.002)",
    """CASE WHEN x <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(CAST(x AS BIGINT), n + 1),
      lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(baseline) + (n - i) * ln(1 - baseline))))) END""",
    "least(30.0, -log10(greatest(judged, 1e-300)))",
    "judged < 1e-4 AND x >= 3 AND x / n >= 2 * baseline",
)
COUNT_RULE = (
    "greatest(list_avg(v.hx), 1.0)",
    """CASE WHEN x <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform(range(0, CAST(x AS BIGINT)),
      lambda i: exp(i * ln(baseline) - baseline - lgamma(i + 1))))) END""",
    "least(30.0, -log10(greatest(judged, 1e-300)))",
    "judged < 1e-4 AND x >= 2 * baseline",
)
COUNT_FOLD = fold_sql(
    "SELECT project_id, root_name AS grp, window_start_ns AS w, CAST(traces AS DOUBLE) AS x, CAST(NULL AS BIGINT) AS n FROM agent", *COUNT_RULE
)


def _verdict_sql(fold: str, observed: str, score_digits: int) -> str:
    score = f"round(score, {score_digits})"
    return (
        "WITH RECURSIVE "
        + AGENT_SQL
        + ","
        + fold
        + f""" SELECT project_id, 'agent:' || grp AS group_key, w AS window_start_ns, round({observed}, 5) AS observed,
        round(baseline, 5) AS baseline, {score} AS score, flag AS is_anomaly FROM walk"""
    )


def _verdicts(spark, sf_dir, detector, digits):
    traces, rows = stored_traces(spark, sf_dir), spans(spark, sf_dir)
    agent = dt.agent_window_metrics(traces, rows, PERIOD_NS)
    none = dt.component_window_metrics(traces, rows, PERIOD_NS).filter("false")
    metrics = dt.metric_rows(agent, none).filter(F.col("detector") == detector)
    return dt.detect_series(metrics).select(
        "project_id",
        "group_key",
        "window_start_ns",
        F.round("observed", 5).alias("observed"),
        F.round("baseline", 5).alias("baseline"),
        F.round("score", digits).alias("score"),
        "is_anomaly",
    )


@query("detect_continuous", _verdict_sql(LATENCY_FOLD, "x", 3))
def detect_continuous(spark, sf_dir):
    return _verdicts(spark, sf_dir, "latency", 3)


@query("detect_rate", _verdict_sql(RATE_FOLD, "x / n", 3))
def detect_rate(spark, sf_dir):
    return _verdicts(spark, sf_dir, "error_rate", 3)


@query("detect_throughput", _verdict_sql(COUNT_FOLD, "x", 3))
def detect_throughput(spark, sf_dir):
    return _verdicts(spark, sf_dir, "throughput", 3)


@query("detect_all_series")
def detect_all_series(spark, sf_dir):
    return windowed_verdicts(spark, sf_dir)


@query(
    "rolling_baseline",
    """SELECT event_type, day, n, CASE WHEN count(*) OVER w >= 6 THEN round(quantile_cont(n, 0.5) OVER w, 4) END AS center
    FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
    WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING)""",
)
def rolling_baseline(spark, sf_dir):
    from opsloom.operators.series import rolling_baseline as rolling

    days = (
        read_table(spark, sf_dir, "events")
        .groupBy("event_type", F.col("ts").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return rolling(days, ["event_type"], "day", "n").withColumn("center", F.round("center", 4))


@query(
    "detect_novelty",
    "WITH "
    + TRACES_SQL
    + f""", w AS (SELECT *, start_ns - start_ns % {PERIOD_NS} AS window_start_ns FROM traces WHERE has_root),
    t0 AS (SELECT project_id, min(start_ns - start_ns % {PERIOD_NS}) AS t0 FROM traces GROUP BY 1),
    v AS (SELECT w.project_id, 'new_model' AS detector, 'model:' || model AS group_key, window_start_ns FROM spans s JOIN w
        ON s.project_id = w.project_id AND s.trace_id = w.trace_id WHERE model IS NOT NULL
      UNION ALL SELECT w.project_id, 'new_tool', 'tool_name:' || tool_name, window_start_ns FROM spans s JOIN w
        ON s.project_id = w.project_id AND s.trace_id = w.trace_id WHERE tool_name IS NOT NULL)
    SELECT v.project_id, detector, group_key, min(window_start_ns) AS window_start_ns FROM v
    JOIN t0 ON v.project_id = t0.project_id GROUP BY ALL HAVING (min(window_start_ns) - any_value(t0)) // {PERIOD_NS} + 1 > 0""",
)
def detect_novelty(spark, sf_dir):
    # Every model is in use from the first months on, so the warm-up is set to zero windows here.
    cfg = dt.DetectorConfig(warmup_windows=0)
    out = dt.detect_novelty(stored_traces(spark, sf_dir), spans(spark, sf_dir), PERIOD_NS, cfg)
    return out.select("project_id", "detector", "group_key", "window_start_ns")


@query(
    "binom_sf",
    """SELECT user_id, k, n, round(CASE WHEN k <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(k, n + 1),
      lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.2) + (n - i) * ln(0.8))))) END, 9) AS p
    FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS k, count(*) AS n FROM events GROUP BY 1)""",
)
def binom_sf_query(spark, sf_dir):
    counts = (
        read_table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count(F.lit(1)).alias("n"))
    )
    return counts.select("user_id", "k", "n", F.round(binom_sf(F.col("k"), F.col("n"), F.lit(0.2)), 9).alias("p"))


@query(
    "poisson_sf",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS k FROM events GROUP BY ALL),
    m AS (SELECT event_type, avg(k) AS lam FROM d GROUP BY 1)
    SELECT d.event_type, day, k, round(greatest(0.0, 1.0 - list_sum(list_transform(range(0, k),
      lambda i: exp(i * ln(lam) - lam - lgamma(i + 1))))), 9) AS p FROM d JOIN m ON d.event_type = m.event_type""",
)
def poisson_sf_query(spark, sf_dir):
    days = (
        read_table(spark, sf_dir, "events")
        .groupBy("event_type", F.col("ts").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("k"))
    )
    mean = days.groupBy("event_type").agg(F.avg("k").alias("lam"))
    return days.join(mean, "event_type").select(
        "event_type", "day", "k", F.round(poisson_sf(F.col("k"), F.col("lam")), 9).alias("p")
    )


@query(
    "tumbling_window",
    """SELECT event_type, epoch_us(ts) // 21600000000 * 21600 AS window_start_s, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY ALL""",
)
def tumbling_window(spark, sf_dir):
    from opsloom.sources.tables import epoch_micros

    events = read_table(spark, sf_dir, "events").withColumn("us", epoch_micros(F.col("ts")))
    start = (F.col("us") - F.pmod("us", F.lit(21600000000))) / F.lit(1000000)
    return events.groupBy("event_type", start.cast("bigint").alias("window_start_s")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


def order_incidents(spark, sf_dir):
    """(traces, spans, anomalies, incidents, membership) of the mapping."""
    traces, rows = stored_traces(spark, sf_dir), spans(spark, sf_dir)
    anomalies = cut_lineage(dt.detect_anomalies(traces, rows, PERIOD_NS))
    incidents, membership = dt.group_incidents(anomalies, PERIOD_NS, PERIOD_NS)
    return traces, rows, anomalies, incidents, membership


@query("detect_anomalies")
def detect_anomalies(spark, sf_dir):
    return dt.detect_anomalies(stored_traces(spark, sf_dir), spans(spark, sf_dir), PERIOD_NS).withColumns(
        {"score": F.round("score", 2), "observed": F.round("observed", 5), "baseline": F.round("baseline", 5)}
    )


@query("group_incidents")
def group_incidents(spark, sf_dir):
    return order_incidents(spark, sf_dir)[3].withColumn("detectors", F.array_join("detectors", ","))


# Time-only grouping: islands of the days on which an event type ran above its own mean.
@query(
    "incident_islands",
    """WITH d AS (SELECT event_type AS project_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY ALL),
    m AS (SELECT project_id, avg(n) AS m FROM d GROUP BY 1),
    a AS (SELECT d.project_id, day, day + 1 AS e FROM d JOIN m ON d.project_id = m.project_id WHERE n > m),
    f AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY project_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      >= day THEN 0 ELSE 1 END AS fresh FROM a)
    SELECT project_id, day * 86400000000000 AS window_start_ns,
      CAST(sum(fresh) OVER (PARTITION BY project_id ORDER BY day) AS BIGINT) AS island FROM f""",
)
def incident_islands(spark, sf_dir):
    from opsloom.sources.tables import epoch_days

    days = (
        read_table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("project_id"), epoch_days(F.col("ts")).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    mean = days.groupBy("project_id").agg(F.avg("n").alias("m"))
    busy = days.join(mean, "project_id").filter("n > m")
    marked = busy.select(
        "project_id",
        (F.col("day") * F.lit(DAY_NS)).alias("window_start_ns"),
        ((F.col("day") + 1) * F.lit(DAY_NS)).alias("window_end_ns"),
    )
    return dt.incident_islands(marked, gap_ns=0)


def incremental_sql(lag_ns: int = 0, unique: bool = False) -> str:
    """The three folds over all complete windows at once; the queries do them in several runs. `unique`: of each span the
    first delivery only."""
    agent = AGENT_SQL
    if unique:
        once = """, spans AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, span_id
          ORDER BY arrival, arrival_tie, duration_ms, cost_usd, status) AS rn FROM delivered) WHERE rn = 1)"""
        agent = agent.replace(SPANS_SQL, SPANS_SQL.replace("spans AS (", "delivered AS (", 1) + once)
    folds, parts = "", []
    for name, fold, observed in (("latency", LATENCY_FOLD, "x"), ("error_rate", RATE_FOLD, "x / n"), ("throughput", COUNT_FOLD, "x")):
        for table in ("series", "numbered", "walk"):
            fold = re.sub(rf"\b{table}\b", f"{table}_{name}", fold)
        folds += "," + fold
        parts.append(
            f"SELECT '{name}' AS detector, project_id, 'agent:' || grp AS group_key, w AS window_start_ns, round({observed}, 5) AS observed, "
            f"round(baseline, 5) AS baseline, round(score, 3) AS score FROM walk_{name} WHERE flag"
        )
    closed = f"""closed AS (SELECT project_id, (max(end_ns) - {lag_ns}) // {PERIOD_NS} * {PERIOD_NS} AS cursor_ns FROM traces GROUP BY 1)"""
    return (
        "WITH RECURSIVE " + agent + ", " + closed + folds + " SELECT f.*, c.cursor_ns FROM (" + " UNION ALL ".join(parts)
        + f") f JOIN closed c ON c.project_id = f.project_id WHERE window_start_ns + {PERIOD_NS} <= cursor_ns"
    )


@query("detect_incremental", incremental_sql())
def detect_incremental(spark, sf_dir):
    """Two runs, the second from the state that the first one committed; the cursor is the one of the last run."""
    return agent_anomalies(two_runs(spark, sf_dir))


def agent_anomalies(detector):
    """The anomalies of three detectors that SQL can say, with the projects' cursors."""
    found = detector.anomalies().filter(F.col("detector").isin("latency", "error_rate", "throughput") & F.col("group_key").startswith("agent:"))
    return found.join(detector.cursors().select("project_id", "cursor_ns"), "project_id").select(
        "detector", "project_id", "group_key", "window_start_ns", F.round("observed", 5).alias("observed"),
        F.round("baseline", 5).alias("baseline"), F.round("score", 3).alias("score"), "cursor_ns",
    )


def two_runs(spark, sf_dir):
    """A detector after a run up to the middle of the tables' time and one up to its end.

    Both tables are written once, as a store holds them: runs read them by column, and spans are not joined anew each time.
    """
    rows = stored(spans(spark, sf_dir))
    traces = stored(sp.trace_measures(rows))
    detector = IncrementalDetector(spark, work_folder(spark, "detection"), PERIOD_NS)
    middle = traces.groupBy("project_id").agg(
        ((F.min("start_ns") + F.max("end_ns")) / 2).cast("bigint").alias("until_ns")
    )
    detector.run(traces, rows, middle)
    detector.run(traces, rows)
    return detector


@query("incidents_incremental")
def incidents_incremental(spark, sf_dir):
    """The incidents of the two runs, as group_incidents gives them over all anomalies at once."""
    return two_runs(spark, sf_dir).incidents().withColumn("detectors", F.array_join("detectors", ","))
