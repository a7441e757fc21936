"""Evaluation metrics over labels, documents, order lines and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsloom.operators import evaluate as ev
from opsloom.operators import retrieve as rt
from opsloom.plans.catalog import query
from opsloom.plans.retrieval_queries import BM25_SQL
from opsloom.sources.tables import epoch_days, read_table

DAY = 86_400 * 10**9


@query(
    "results_match",
    """WITH a AS (SELECT o_orderstatus AS s, count(*) AS n, round(avg(o_totalprice), 4) AS p FROM orders GROUP BY 1),
    b AS (SELECT o_orderstatus AS s, count(*) AS n, round(avg(o_totalprice), 4) AS p FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
    SELECT 'same' AS pair, NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM a) AS matches
    UNION ALL SELECT 'other', NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
)
def results_match(spark, sf_dir):
    """The same answer with its columns swapped, and an answer over half of the customers."""
    orders = read_table(spark, sf_dir, "orders")
    measures = [F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("p")]
    gold = orders.groupBy("o_orderstatus").agg(*measures)
    swapped = gold.select("p", "n", F.col("o_orderstatus").alias("s"))
    half = orders.filter("o_custkey % 2 = 0").groupBy("o_orderstatus").agg(*measures)
    same = ev.results_match(swapped, gold).select(F.lit("same").alias("pair"), "matches")
    return same.unionByName(ev.results_match(half, gold).select(F.lit("other").alias("pair"), "matches"))


ANSWERS_SQL = """
g0 AS (SELECT c_nationkey AS q, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL),
p0 AS (SELECT c_nationkey AS q, c_mktsegment AS s, count(*) AS n FROM customer WHERE c_nationkey % 3 <> 0 OR c_acctbal > 0 GROUP BY ALL),
gold AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s) AS pos FROM g0),
pred AS (SELECT *, CASE WHEN q % 5 = 0 THEN row_number() OVER (PARTITION BY q ORDER BY s DESC) ELSE row_number() OVER (PARTITION BY q ORDER BY s) END AS pos FROM p0)"""


@query(
    "execution_accuracy",
    f"""WITH {ANSWERS_SQL} SELECT n_nationkey AS question_id, n_nationkey % 7 <> 0 AND NOT EXISTS (
      SELECT 1 FROM (SELECT * FROM gold WHERE q = n_nationkey) g FULL JOIN (SELECT * FROM pred WHERE q = n_nationkey) p
      ON g.s = p.s AND g.n = p.n AND (n_nationkey % 2 = 1 OR g.pos = p.pos) WHERE g.s IS NULL OR p.s IS NULL) AS correct FROM nation""",
)
def execution_accuracy(spark, sf_dir):
    """One question per nation; even ones ask for an order, every third answer drops debtors."""
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("question_id"), "c_mktsegment", "c_acctbal")

    def answer(rows, flip):
        counts = rows.groupBy("question_id", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
        up = F.row_number().over(Window.partitionBy("question_id").orderBy("c_mktsegment"))
        down = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("c_mktsegment")))
        pos = F.when((F.col("question_id") % 5 == 0) & F.lit(flip), down).otherwise(up)
        placed = counts.withColumn("pos", pos)
        return placed.select("question_id", ev.row_key(placed, ["c_mktsegment", "n"]).alias("key"), "pos")

    k = F.col("n_nationkey")
    questions = read_table(spark, sf_dir, "nation").select(
        k.alias("question_id"), (k % 2 == 0).alias("ordered"), F.when(k % 7 == 0, "rejected").otherwise("ok").alias("status")
    )
    pred = answer(customers.filter("question_id % 3 <> 0 OR c_acctbal > 0"), True)
    return ev.execution_accuracy(pred, answer(customers, False), questions)


def _labelled(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.join(read_table(spark, sf_dir, "labels"), "doc_id", "left")


@query(
    "eval_summary",
    """WITH d AS (SELECT lang AS system, quality, toxic, n_chars / 1000 AS seconds FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT system, list_sort(list(seconds)) AS l, round(avg(quality), 3) AS quality, round(avg(toxic), 3) AS toxic FROM d GROUP BY 1)
    SELECT system, quality, toxic, l[len(l) // 2 + 1] AS p50, l[least(len(l), CAST(floor(len(l) * 0.95) AS BIGINT) + 1)] AS p95 FROM s""",
)
def eval_summary(spark, sf_dir):
    rows = _labelled(spark, sf_dir).select(F.col("lang").alias("system"), "quality", "toxic", (F.col("n_chars") / 1000).alias("seconds"))
    return ev.eval_summary(rows, ["quality", "toxic"])


@query(
    "accuracy_slices",
    """WITH d AS (SELECT quality = (n_chars > 1500)::INT AS correct, source IN ('src1', 'src2') AS held, lang, toxic = 1 AS repaired, n_chars AS ms
      FROM documents JOIN labels USING (doc_id)),
    x AS (SELECT 'overall' AS slice, * FROM d UNION ALL SELECT CASE WHEN held THEN 'held_out' ELSE 'seen' END, * FROM d
      UNION ALL SELECT 'difficulty:' || lang, * FROM d UNION ALL SELECT 'repaired', * FROM d WHERE repaired),
    s AS (SELECT slice, count(*) AS n, round(avg(CASE WHEN correct THEN 1.0 ELSE 0 END), 6) AS accuracy, list_sort(list(CAST(ms AS DOUBLE))) AS l FROM x GROUP BY 1)
    SELECT slice, n, accuracy, l[n // 2 + 1] AS p50, l[least(n, CAST(floor(n * 0.95) AS BIGINT) + 1)] AS p95 FROM s""",
)
def accuracy_slices(spark, sf_dir):
    rows = _labelled(spark, sf_dir).filter("quality IS NOT NULL").select(
        (F.col("quality") == (F.col("n_chars") > 1500).cast("int")).alias("correct"),
        F.col("source").isin("src1", "src2").alias("held_out"),
        F.col("lang").alias("difficulty"),
        (F.col("toxic") + 1).alias("attempts"),
        F.col("n_chars").alias("latency_ms"),
    )
    return ev.accuracy_slices(rows)


SCORED_SQL = """
ln AS (SELECT l_orderkey AS claim_id, l_linenumber AS line_no, min(l_returnflag || l_linestatus) AS f, min(l_discount) AS d, min(l_tax) AS t,
    min(l_extendedprice) AS charge FROM lineitem GROUP BY ALL),
ex AS (SELECT *, CASE substr(f, 1, 1) WHEN 'R' THEN 'deny' WHEN 'A' THEN 'pay' ELSE 'adjust' END AS expected FROM ln),
got AS (SELECT 'rules' AS system, claim_id, line_no, CASE WHEN d >= 0.1 THEN 'review' WHEN t > 0.05 THEN 'deny' ELSE 'pay' END AS outcome FROM ln
  UNION ALL SELECT 'agent', claim_id, line_no, CASE WHEN line_no = 3 THEN 'deny' ELSE expected END FROM ex)"""


@query(
    "decision_scorecard",
    f"""WITH {SCORED_SQL}, j AS (SELECT g.system, g.claim_id, g.outcome, e.expected, e.charge, o_custkey % 4 = 0 AS judgment,
      bool_or(g.outcome = 'review') OVER (PARTITION BY g.system, g.claim_id) AS esc FROM got g JOIN ex e ON g.claim_id = e.claim_id AND g.line_no = e.line_no
      JOIN orders ON o_orderkey = g.claim_id),
    c AS (SELECT system, claim_id, any_value(esc) AS esc, any_value(judgment) AS judgment, bool_and(outcome = expected) AS ok, count(*) AS n,
      count(*) FILTER (outcome = expected) AS hits, coalesce(sum(charge) FILTER (NOT esc AND expected = 'deny' AND outcome IN ('pay', 'adjust')), 0) AS o,
      coalesce(sum(charge) FILTER (NOT esc AND expected IN ('pay', 'adjust') AND outcome = 'deny'), 0) AS u FROM j GROUP BY ALL)
    SELECT system, count(*) AS claims, count(*) FILTER (NOT esc) AS decided, count(*) FILTER (NOT esc AND ok) AS correct_claims,
      CAST(coalesce(sum(n) FILTER (NOT esc), 0) AS BIGINT) AS decided_lines, CAST(coalesce(sum(hits) FILTER (NOT esc), 0) AS BIGINT) AS correct_lines,
      count(*) FILTER (judgment) AS judgment_total, count(*) FILTER (judgment AND esc) AS judgment_escalated,
      count(*) FILTER (judgment AND NOT esc AND ok) AS judgment_correct, round(sum(o), 2) AS overpaid, round(sum(u), 2) AS underpaid FROM c GROUP BY 1""",
)
def decision_scorecard(spark, sf_dir):
    c = F.col
    lines = read_table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("claim_id"), c("l_linenumber").alias("line_no")).agg(
        F.min(F.concat("l_returnflag", "l_linestatus")).alias("f"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"),
        F.min("l_extendedprice").alias("charge"),
    )
    flag = F.substring("f", 1, 1)
    expected = lines.withColumn("expected", F.when(flag == "R", "deny").when(flag == "A", "pay").otherwise("adjust"))
    rules = lines.select(
        F.lit("rules").alias("system"), "claim_id", "line_no",
        F.when(c("d") >= 0.1, "review").when(c("t") > 0.05, "deny").otherwise("pay").alias("outcome"),
    )
    agent = expected.select(
        F.lit("agent").alias("system"), "claim_id", "line_no",
        F.when(c("line_no") == 3, "deny").otherwise(c("expected")).alias("outcome"),
    )
    claims = read_table(spark, sf_dir, "orders").select(c("o_orderkey").alias("claim_id"), (c("o_custkey") % 4 == 0).alias("judgment"))
    return ev.decision_scorecard(expected.select("claim_id", "line_no", "expected", "charge"), rules.unionByName(agent), claims)


@query(
    "set_precision_recall",
    """WITH f AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE n_chars > 1500), e AS (SELECT doc_id FROM labels WHERE quality = 1),
    j AS (SELECT f.doc_id AS f, e.doc_id AS e FROM f FULL JOIN e ON f.doc_id = e.doc_id),
    c AS (SELECT count(*) FILTER (f IS NOT NULL AND e IS NOT NULL) AS tp, count(*) FILTER (e IS NULL) AS fp, count(*) FILTER (f IS NULL) AS fn FROM j)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""",
)
def set_precision_recall(spark, sf_dir):
    rows = _labelled(spark, sf_dir).filter("quality IS NOT NULL")
    out = ev.set_precision_recall(rows.filter("n_chars > 1500"), rows.filter("quality = 1"), ["doc_id"])
    return out.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


# Busy days of an event type are incidents; the first day of every week is an injected fault.
EPISODES_SQL = f"""
d AS (SELECT event_type AS project_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT project_id, avg(n) AS m FROM d GROUP BY 1),
inc AS (SELECT d.project_id, d.project_id || '|' || day AS incident_id, day, CASE WHEN day % 2 = 0 THEN 'latency' ELSE 'cost' END AS det
  FROM d JOIN m ON d.project_id = m.project_id WHERE n > m),
lab AS (SELECT DISTINCT project_id, project_id || '|w' || (day // 7) AS label_id, day // 7 * 7 AS day, (day // 7) % 2 AS intensity FROM d),
pairs AS (SELECT l.label_id, l.project_id, l.day AS ld, l.intensity, i.incident_id, i.day, i.det FROM lab l JOIN inc i ON l.project_id = i.project_id
  AND l.day - 1 < i.day + 1 AND i.day < l.day + 3 AND i.det = 'latency'),
best AS (SELECT label_id, arg_min(incident_id, day) AS incident_id, min(day) AS day, any_value(ld) AS ld FROM pairs GROUP BY 1),
matched AS (SELECT l.project_id, l.label_id, l.intensity, b.incident_id, greatest(0.0, (b.day + 1 - l.day) * 1440.0) AS delay_min FROM lab l LEFT JOIN best b ON l.label_id = b.label_id)"""


def _episodes(spark, sf_dir):
    days = (
        read_table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("project_id"), epoch_days(F.col("ts")).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    mean = days.groupBy("project_id").agg(F.avg("n").alias("m"))
    busy = days.join(mean, "project_id").filter("n > m")
    start = (F.col("day") * F.lit(DAY)).alias("start_ns")
    key = F.concat_ws("|", "project_id", F.col("day").cast("string"))
    detector = F.when(F.col("day") % 2 == 0, "latency").otherwise("cost")
    incidents = busy.select(
        "project_id", key.alias("incident_id"), start, ((F.col("day") + 1) * F.lit(DAY)).alias("end_ns"), F.array(detector).alias("detectors"),
        F.lit(0).alias("intensity"),
    )
    anomalies = busy.select(
        "project_id", key.alias("anomaly_id"), detector.alias("detector"), ((F.col("day") + 1) * F.lit(DAY)).alias("window_end_ns")
    )
    membership = busy.select("project_id", key.alias("incident_id"), key.alias("anomaly_id"))
    week = F.floor(F.col("day") / 7)
    labels = days.select("project_id", week.alias("week")).distinct().select(
        "project_id",
        F.concat(F.col("project_id"), F.lit("|w"), F.col("week").cast("string")).alias("label_id"),
        (F.col("week") * F.lit(7 * DAY)).alias("start_ns"),
        ((F.col("week") * 7 + 1) * F.lit(DAY)).alias("end_ns"),
        F.array(F.lit("latency")).alias("expected_detectors"),
        (F.col("week") % 2).alias("intensity"),
    )
    return labels, incidents, anomalies, membership


@query(
    "match_labelled_intervals",
    f"WITH {EPISODES_SQL} SELECT project_id, label_id, incident_id, CASE WHEN incident_id IS NOT NULL THEN CAST(delay_min AS DOUBLE) END AS delay_min FROM matched",
)
def match_labelled_intervals(spark, sf_dir):
    labels, incidents, anomalies, membership = _episodes(spark, sf_dir)
    out = ev.match_labelled_intervals(labels, incidents, anomalies, membership, DAY, 2 * DAY, 4 * DAY)
    return out.withColumn("delay_min", F.when(F.col("incident_id").isNotNull(), F.col("delay_min")))


@query(
    "detection_scorecard",
    f"""WITH {EPISODES_SQL} SELECT intensity, count(*) AS expected, count(incident_id) AS detected, round(count(incident_id) / count(*), 6) AS recall,
    round(quantile_cont(CASE WHEN incident_id IS NOT NULL THEN CAST(delay_min AS DOUBLE) END, 0.5), 4) AS median_delay_min FROM matched GROUP BY 1""",
)
def detection_scorecard(spark, sf_dir):
    labels, incidents, anomalies, membership = _episodes(spark, sf_dir)
    matches = ev.match_labelled_intervals(labels, incidents, anomalies, membership, DAY, 2 * DAY, 4 * DAY)
    matches = matches.withColumn("delay_min", F.when(F.col("incident_id").isNotNull(), F.col("delay_min")))
    out = ev.detection_scorecard(matches, labels, incidents)
    return out.select(
        "intensity", "expected", "detected", F.round("recall", 6).alias("recall"), F.round("median_delay_min", 4).alias("median_delay_min")
    )


FAULTS_SQL = (
    EPISODES_SQL
    + """, fp AS (SELECT l.label_id, i.incident_id, i.day, l.day AS ld, i.det, l.intensity FROM lab l JOIN inc i ON l.project_id = i.project_id
  AND l.day < i.day + 1 AND i.day < l.day + 2),
fs AS (SELECT l.label_id, count(incident_id) > 0 AS detected, coalesce(bool_or(det = 'latency' AND p.intensity = 0), false) AS rca_correct,
  round(min(p.day + 1 - p.ld) * 1440.0, 1) AS delay_min FROM lab l LEFT JOIN fp p ON l.label_id = p.label_id GROUP BY 1)"""
)


@query("fault_scores", f"WITH {FAULTS_SQL} SELECT label_id, detected, rca_correct, CAST(delay_min AS DOUBLE) AS delay_min FROM fs")
def fault_scores(spark, sf_dir):
    scores, _ = _fault_scores(spark, sf_dir)
    return scores.drop("project_id")


@query(
    "false_alarms",
    f"WITH {FAULTS_SQL} SELECT incident_id FROM inc WHERE incident_id NOT IN (SELECT incident_id FROM fp)",
)
def false_alarms(spark, sf_dir):
    return _fault_scores(spark, sf_dir)[1].select("incident_id")


def _fault_scores(spark, sf_dir):
    labels, incidents, anomalies, membership = _episodes(spark, sf_dir)
    faults = labels.select(
        "project_id", "label_id", "start_ns", "end_ns", F.lit("slow").alias("expected_category"),
        F.when(F.col("intensity") == 0, "db").otherwise("cache").alias("cause_value"),
    )
    reports = incidents.select(
        "incident_id", F.when(F.array_contains("detectors", "latency"), "slow").otherwise("dear").alias("category"),
        F.lit("db").alias("cause_value"),
    )
    return ev.fault_scores(faults, incidents, anomalies, membership, reports, DAY, 4 * DAY)


@query(
    "before_during_kpis",
    """WITH f AS (SELECT event_type, 'F_' || event_type AS label_id, count(DISTINCT user_id) * 200 AS a, count(DISTINCT user_id) * 250 AS b FROM events GROUP BY 1),
    r AS (SELECT e.event_type, epoch_us(ts) // 60000000 - 28401120 AS minute, value, user_id FROM events e),
    p AS (SELECT label_id, CASE WHEN minute < a THEN 'before' WHEN minute < b THEN 'during' END AS phase, value, user_id FROM r JOIN f USING (event_type))
    SELECT label_id, phase, count(*) AS requests, round(quantile_cont(value, 0.5), 1) AS p50_latency_ms, round(avg(1 + user_id % 3), 2) AS avg_attempts,
    round(avg(CASE WHEN user_id % 5 = 0 THEN 1.0 ELSE 0 END), 3) AS escalated_share FROM p WHERE phase IS NOT NULL GROUP BY ALL""",
)
def before_during_kpis(spark, sf_dir):
    from opsloom.sources.tables import epoch_micros

    events = read_table(spark, sf_dir, "events")
    us = epoch_micros(F.col("ts"))
    requests = events.select(
        F.col("event_type").alias("project_id"),
        ((us - F.pmod(us, F.lit(60000000))) / 60000000 - 28401120).cast("bigint").alias("minute"),
        F.col("value").alias("latency_ms"), (1 + F.col("user_id") % 3).alias("attempts"), (F.col("user_id") % 5 == 0).alias("escalated"),
    )
    faults = events.groupBy(F.col("event_type").alias("project_id")).agg(
        F.concat(F.lit("F_"), F.first("event_type")).alias("label_id"),
        (F.count_distinct("user_id") * 200).alias("start_min"), (F.count_distinct("user_id") * 250).alias("end_min"),
    )
    return ev.before_during_kpis(requests, faults)


RETRIEVED_SQL = f"""{BM25_SQL}, r AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM bm JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20),
x AS (SELECT DISTINCT query_id, source FROM (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source FROM benchmark
  UNION ALL SELECT item_id, 'src' || (item_id * 7 % 20) FROM benchmark))"""


def _retrieved(spark, sf_dir):
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), "text")
    scores = rt.bm25_scores(docs, asked, "doc_id", "text", "text").withColumn("score", F.round("score", 9))
    ranked = rt.top_per_query(scores, 20, F.desc("score"), "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    source = lambda k: F.concat(F.lit("src"), (k % 20).cast("string"))
    expected = items.select(
        F.col("item_id").alias("query_id"), F.explode(F.array(source(F.col("item_id")), source(F.col("item_id") * 7))).alias("source")
    )
    return ranked, expected


@query(
    "source_recall",
    f"WITH {RETRIEVED_SQL} SELECT x.query_id, round(count(r.source) / count(*), 6) AS recall FROM x LEFT JOIN (SELECT DISTINCT query_id, source FROM r) r ON x.query_id = r.query_id AND x.source = r.source GROUP BY 1",
)
def source_recall(spark, sf_dir):
    ranked, expected = _retrieved(spark, sf_dir)
    return ev.source_recall(ranked, expected).withColumn("recall", F.round("recall", 6))


@query(
    "reciprocal_rank",
    f"WITH {RETRIEVED_SQL} SELECT x.query_id, round(coalesce(1.0 / min(rank), 0), 6) AS rr FROM x LEFT JOIN r ON x.query_id = r.query_id AND x.source = r.source GROUP BY 1",
)
def reciprocal_rank(spark, sf_dir):
    ranked, expected = _retrieved(spark, sf_dir)
    return ev.reciprocal_rank(ranked, expected).withColumn("rr", F.round("rr", 6))


SPLIT_SQL = """ex AS (SELECT o_orderkey, o_orderpriority AS template, o_custkey AS binding_id FROM orders),
sp AS (SELECT *, CASE WHEN template IN ('2-HIGH') THEN 'test' WHEN CAST('0x' || substr(md5(CAST(binding_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 THEN 'train'
  WHEN CAST('0x' || substr(md5(CAST(binding_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 90 THEN 'dev' ELSE 'test' END AS split FROM ex)"""


def examples(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("template"), F.col("o_custkey").alias("binding_id")
    )
    return ev.split_examples(rows, ["2-HIGH"])


@query("split_holdout", f"WITH {SPLIT_SQL} SELECT o_orderkey, template, binding_id, split FROM sp")
def split_holdout(spark, sf_dir):
    return examples(spark, sf_dir)


@query("split_counts", f"WITH {SPLIT_SQL} SELECT split, template, count(*) AS rows FROM sp GROUP BY ALL")
def split_counts(spark, sf_dir):
    return examples(spark, sf_dir).groupBy("split", "template").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "template_instances",
    """WITH b AS (SELECT DISTINCT o_orderpriority AS template, o_orderstatus AS s, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders),
    c AS (SELECT *, md5(template || '|[{"key":"status","value":"' || s || '"},{"key":"year","value":"' || y || '"}]') AS binding_id FROM b),
    k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY template ORDER BY binding_id) <= 12),
    v AS (SELECT *, unnest([0, 1]) AS variant FROM k)
    SELECT template, binding_id, CAST(variant AS BIGINT) AS variant, CASE variant WHEN 0 THEN 'How many ' || s || ' orders in ' || y || '?'
      ELSE 'Count ' || y || ' orders that are ' || s END AS question,
      'SELECT count(*) FROM orders WHERE status = ''' || s || ''' AND year = ' || y AS sql FROM v""",
)
def template_instances(spark, sf_dir):
    """Paraphrases per priority, filled with the statuses and years that occur with it."""
    orders = read_table(spark, sf_dir, "orders")
    bindings = orders.select(
        F.col("o_orderpriority").alias("template"), "o_orderstatus", F.year("o_orderdate").cast("string").alias("y")
    ).distinct().select("template", F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("year"), F.col("y")).alias("values"))
    texts = F.array(F.lit("How many {status} orders in {year}?"), F.lit("Count {year} orders that are {status}"))
    sql = F.lit("SELECT count(*) FROM orders WHERE status = '{status}' AND year = {year}")
    templates = orders.select(F.col("o_orderpriority").alias("template")).distinct().select(
        "template", texts.alias("paraphrases"), sql.alias("sql")
    )
    return ev.template_instances(templates, bindings, 12)


@query(
    "abstention_accuracy",
    """SELECT count(*) AS n, round(avg(CASE WHEN (turn % 3 = 0) <> answerable THEN 1.0 ELSE 0 END), 6) AS accuracy FROM (
    SELECT turn, conv_id % 2 = 0 AS answerable FROM conversations WHERE role = 'assistant')""",
)
def abstention_accuracy(spark, sf_dir):
    """Every third turn gets a refusal appended; conversations with odd ids cannot be answered."""
    turns = read_table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    answer = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" This is not mentioned."))).otherwise(F.col("text"))
    rows = turns.select(answer.alias("answer"), (F.col("conv_id") % 2 == 0).alias("answerable"))
    return ev.abstention_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))
