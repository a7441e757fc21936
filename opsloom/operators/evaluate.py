"""Set-based evaluation metrics for retrieval, SQL answers, claim decisions and detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.quantiles import exact_quantiles
from opsloom.operators.ranges import overlapping_intervals


def row_key(df: DataFrame, columns: Sequence[str], digits: int = 4) -> Column:
    """Comparable text of a row: values sorted by type and text, floats rounded."""
    cells = []
    types = dict(df.dtypes)
    for c in columns:
        kind = types[c]
        value = F.col(c)
        if kind in ("double", "float") or kind.startswith("decimal"):
            tag, text = "float", F.round(value.cast("double"), digits).cast("string")
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            tag, text = "int", value.cast("double").cast("string")
        else:
            tag, text = "str", value.cast("string")
        cells.append(
            F.struct(
                F.when(value.isNull(), "NoneType").otherwise(tag).alias("k"), F.coalesce(text, F.lit("None")).alias("v")
            )
        )
    ordered = F.array_sort(F.array(*cells))
    return F.array_join(F.transform(ordered, lambda x: x["v"]), "\x1f")


def results_match(pred: DataFrame, gold: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row `matches`: equal multisets of rows, or equal row by row along `order_by`.

    `order_by` names a running position that both sides carry; it is not compared itself.
    """
    extra = [order_by] if order_by else []
    sides = []
    for df, weight in ((pred, 1), (gold, -1)):
        columns = [c for c in df.columns if c not in extra]
        sides.append(df.select(row_key(df, columns).alias("key"), *extra, F.lit(weight).alias("w")))
    both = sides[0].unionByName(sides[1])
    off = both.groupBy("key", *extra).agg(F.sum("w").alias("w")).filter("w <> 0")
    return off.agg((F.count(F.lit(1)) == 0).alias("matches"))


def execution_accuracy(pred: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, correct) for tables of result rows (question_id, key, and pos for ordered ones).

    `questions` has question_id, ordered and status; anything but status ok counts as wrong.
    """
    keep = questions.select("question_id", "ordered")

    def side(df: DataFrame, weight: int) -> DataFrame:
        pos = F.when(F.col("ordered"), F.col("pos")).otherwise(F.lit(0)).cast("bigint")
        return df.join(keep, "question_id").select("question_id", "key", pos.alias("pos"), F.lit(weight).alias("w"))

    both = side(pred, 1).unionByName(side(gold, -1))
    wrong = both.groupBy("question_id", "key", "pos").agg(F.sum("w").alias("w")).filter("w <> 0").select("question_id").distinct()
    marked = questions.join(wrong.withColumn("_bad", F.lit(True)), "question_id", "left")
    return marked.select(
        "question_id", ((F.col("status") == "ok") & F.col("_bad").isNull()).alias("correct")
    )


def eval_summary(results: DataFrame, metrics: Sequence[str], latency: str = "seconds", system: str = "system") -> DataFrame:
    """Mean of the non-null values of each metric and nearest-rank latencies per system."""
    means = results.groupBy(system).agg(*[F.round(F.avg(m), 3).alias(m) for m in metrics])
    lat = exact_quantiles(results, [system], latency, {"p50": 0.5, "p95": 0.95}, method="index")
    return means.join(lat, system, "left")


def accuracy_slices(rows: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Accuracy and latency overall, for seen and held-out templates, by difficulty and for repaired answers.

    `rows` has correct, held_out, difficulty, attempts and a latency.
    """
    slices = F.array_compact(
        F.array(
            F.lit("overall"),
            F.when(F.col("held_out"), "held_out").otherwise("seen"),
            F.concat(F.lit("difficulty:"), "difficulty"),
            F.when(F.col("attempts") > 1, "repaired"),
        )
    )
    spread = rows.withColumn("slice", F.explode(slices))
    shares = spread.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy")
    )
    lat = exact_quantiles(spread, ["slice"], latency, {"p50": 0.5, "p95": 0.95}, method="index")
    return shares.join(lat, "slice", "left")


def decision_scorecard(expected: DataFrame, decided: DataFrame, claims: DataFrame) -> DataFrame:
    """Scores per system from line decisions.

    `expected` has claim_id, line_no, expected, charge; `decided` system, claim_id, line_no, outcome;
    `claims` claim_id, judgment. A claim with a line in review counts as escalated.
    """
    systems = decided.groupBy("system", "claim_id").agg(F.max(F.col("outcome") == "review").alias("escalated"))
    lines = (
        systems.join(expected, "claim_id")
        .join(decided, ["system", "claim_id", "line_no"], "left")
        .withColumn("hit", F.coalesce(F.col("outcome") == F.col("expected"), F.lit(False)))
    )
    auto = ~F.col("escalated")
    over = auto & (F.col("expected") == "deny") & F.col("outcome").isin("pay", "adjust")
    under = auto & F.col("expected").isin("pay", "adjust") & (F.col("outcome") == "deny")
    per_claim = lines.groupBy("system", "claim_id", "escalated").agg(
        F.min("hit").alias("all_ok"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("hit").alias("ok"),
        F.sum(F.when(over, F.col("charge")).otherwise(0.0)).alias("over"),
        F.sum(F.when(under, F.col("charge")).otherwise(0.0)).alias("under"),
    )
    rows = per_claim.join(claims, "claim_id")
    return rows.groupBy("system").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(auto).alias("decided"),
        F.count_if(auto & F.col("all_ok")).alias("correct_claims"),
        F.coalesce(F.sum(F.when(auto, F.col("n"))), F.lit(0)).alias("decided_lines"),
        F.coalesce(F.sum(F.when(auto, F.col("ok"))), F.lit(0)).alias("correct_lines"),
        F.count_if("judgment").alias("judgment_total"),
        F.count_if(F.col("judgment") & F.col("escalated")).alias("judgment_escalated"),
        F.count_if(F.col("judgment") & auto & F.col("all_ok")).alias("judgment_correct"),
        F.round(F.sum("over"), 2).alias("overpaid"),
        F.round(F.sum("under"), 2).alias("underpaid"),
    )


def set_precision_recall(fired: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, fn with precision and recall of two sets of keys."""
    tagged = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(1))
    both = tagged(fired, "f").join(tagged(expected, "e"), list(keys), "full")
    out = both.agg(
        F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("tp"),
        F.count_if(F.col("e").isNull()).alias("fp"),
        F.count_if(F.col("f").isNull()).alias("fn"),
    )
    rate = lambda a, b: F.when(a + b > 0, a / (a + b))
    return out.select(
        "*", rate(F.col("tp"), F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("fn")).alias("recall")
    )


def match_labelled_intervals(
    labels: DataFrame,
    incidents: DataFrame,
    anomalies: DataFrame,
    membership: DataFrame,
    before_ns: int,
    after_ns: int,
    bin_ns: int,
    by_detector: bool = True,
) -> DataFrame:
    """Each injected interval with the earliest incident that overlaps it (padded) and its delay.

    `labels` has label_id, project_id, start_ns, end_ns, expected_detectors; labels without a match
    keep a null incident. The delay runs from the true start to the end of the first anomalous
    window of an expected detector, never below zero, in minutes.
    """
    padded = labels.select(
        "project_id",
        "label_id",
        "expected_detectors",
        F.col("start_ns").alias("true_start"),
        (F.col("start_ns") - F.lit(before_ns)).alias("_from"),
        (F.col("end_ns") + F.lit(after_ns)).alias("_to"),
    )
    found = incidents.select("project_id", "incident_id", "start_ns", "end_ns", "detectors")
    pairs = overlapping_intervals(padded, found, ["project_id"], ("_from", "_to"), ("start_ns", "end_ns"), bin_ns)
    if by_detector:
        pairs = pairs.filter(F.arrays_overlap("expected_detectors", "detectors"))
    best = pairs.groupBy("label_id").agg(
        F.min_by("incident_id", F.struct("start_ns", "incident_id")).alias("incident_id")
    )
    first = (
        best.join(labels, "label_id")
        .join(membership.select("incident_id", "anomaly_id"), "incident_id")
        .join(anomalies.select("anomaly_id", "detector", "window_end_ns"), "anomaly_id")
        .filter(F.array_contains("expected_detectors", F.col("detector")) if by_detector else F.lit(True))
        .groupBy("label_id")
        .agg(F.min(F.col("window_end_ns") - F.col("start_ns")).alias("_d"))
    )
    delay = F.greatest(F.lit(0.0), F.col("_d") / F.lit(60 * 10**9))
    return (
        labels.select("project_id", "label_id")
        .join(best, "label_id", "left")
        .join(first, "label_id", "left")
        .select("project_id", "label_id", "incident_id", delay.alias("delay_min"))
    )


def detection_scorecard(matches: DataFrame, labels: DataFrame, incidents: DataFrame, by: str = "intensity") -> DataFrame:
    """Recall, precision and median delay per group of labels; `incidents` carries the group too."""
    rows = matches.join(labels.select("label_id", by), "label_id")
    recall = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("expected"), F.count("incident_id").alias("detected"), F.count_distinct("incident_id").alias("_m")
    )
    found = incidents.groupBy(by).agg(F.count(F.lit(1)).alias("incidents"))
    delay = exact_quantiles(rows, [by], "delay_min", {"median_delay_min": 0.5})
    joined = recall.join(found, by, "left").join(delay, by, "left")
    return joined.select(
        by,
        "expected",
        "detected",
        F.coalesce("incidents", F.lit(0)).alias("incidents"),
        (F.col("detected") / F.col("expected")).alias("recall"),
        F.when(F.col("incidents") > 0, F.col("_m") / F.col("incidents")).alias("precision"),
        "median_delay_min",
    )


def fault_scores(
    faults: DataFrame, incidents: DataFrame, anomalies: DataFrame, membership: DataFrame, reports: DataFrame, after_ns: int, bin_ns: int
) -> tuple[DataFrame, DataFrame]:
    """(scores per fault, false alarms).

    `faults` has label_id, project_id, start_ns, end_ns, expected_category, cause_value; `reports`
    incident_id, category, cause_value. Incidents that touch no fault are false alarms.
    """
    padded = faults.select(
        "project_id", "label_id", "expected_category", F.col("cause_value").alias("_cause"), F.col("start_ns").alias("_from"),
        (F.col("end_ns") + F.lit(after_ns)).alias("_to"),
    )
    spans = incidents.select("project_id", "incident_id", "start_ns", "end_ns")
    pairs = overlapping_intervals(padded, spans, ["project_id"], ("_from", "_to"), ("start_ns", "end_ns"), bin_ns)
    right = (
        pairs.join(reports.select("incident_id", "category", "cause_value"), "incident_id", "left")
        .withColumn("_ok", F.coalesce((F.col("category") == F.col("expected_category")) & (F.col("cause_value") == F.col("_cause")), F.lit(False)))
    )
    late = (
        pairs.join(membership.select("incident_id", "anomaly_id"), "incident_id")
        .join(anomalies.select("anomaly_id", "window_end_ns"), "anomaly_id")
        .filter(F.col("window_end_ns") >= F.col("_from"))
        .groupBy("label_id")
        .agg(F.round(F.min(F.col("window_end_ns") - F.col("_from")) / F.lit(60 * 10**9), 1).alias("delay_min"))
    )
    verdict = right.groupBy("label_id").agg(F.max("_ok").alias("rca_correct"), F.count(F.lit(1)).alias("incidents"))
    scores = (
        faults.select("label_id", "project_id")
        .join(verdict, "label_id", "left")
        .join(late, "label_id", "left")
        .select(
            "label_id", "project_id", F.col("incidents").isNotNull().alias("detected"),
            F.coalesce("rca_correct", F.lit(False)).alias("rca_correct"), "delay_min",
        )
    )
    return scores, incidents.join(pairs.select("incident_id"), "incident_id", "left_anti")


def before_during_kpis(requests: DataFrame, faults: DataFrame) -> DataFrame:
    """Health of each fault's project before and during it.

    `requests` has project_id, minute, latency_ms, attempts, escalated; `faults` label_id,
    project_id, start_min, end_min. Requests after the fault belong to neither phase.
    """
    rows = requests.join(faults, "project_id")
    phase = F.when(F.col("minute") < F.col("start_min"), "before").when(F.col("minute") < F.col("end_min"), "during")
    phased = rows.withColumn("phase", phase).filter("phase IS NOT NULL")
    keys = ["label_id", "phase"]
    means = phased.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.round(F.avg("attempts"), 2).alias("avg_attempts"),
        F.round(F.avg(F.col("escalated").cast("double")), 3).alias("escalated_share"),
    )
    p50 = exact_quantiles(phased, keys, "latency_ms", {"p50_latency_ms": 0.5})
    return means.join(p50.withColumn("p50_latency_ms", F.round("p50_latency_ms", 1)), keys)


def source_recall(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, recall): share of expected sources among the retrieved ones."""
    want = expected.select("query_id", "source").distinct()
    hit = want.join(retrieved.select("query_id", "source"), ["query_id", "source"], "left_semi")
    counts = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("h"))
    return counts.join(hits, "query_id", "left").select(
        "query_id", (F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall")
    )


def reciprocal_rank(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rr): one over the first rank with an expected source, 0 when there is none."""
    want = expected.select("query_id", "source").distinct()
    first = (
        retrieved.join(want, ["query_id", "source"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    )
    return want.select("query_id").distinct().join(first, "query_id", "left").select(
        "query_id", F.coalesce(F.lit(1.0) / F.col("r"), F.lit(0.0)).alias("rr")
    )


def split_examples(examples: DataFrame, held_out: Sequence[str], train: int = 80, dev: int = 10) -> DataFrame:
    """Held-out templates go to test as a whole; the rest splits by a hash of the binding id."""
    bucket = F.conv(F.substring(F.md5(F.col("binding_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    split = (
        F.when(F.col("template").isin(*held_out), "test")
        .when(bucket < train, "train")
        .when(bucket < train + dev, "dev")
        .otherwise("test")
    )
    return examples.withColumn("split", split)


def template_instances(templates: DataFrame, bindings: DataFrame, per_template: int = 30) -> DataFrame:
    """Every paraphrase of a template filled with sampled bindings.

    `templates` has template, paraphrases (array) and sql; `bindings` template and values (map of
    placeholder to text). Sampling orders the bindings of a template by hash.
    """
    identity = F.md5(F.concat_ws("|", "template", F.to_json(F.array_sort(F.map_entries("values")))))
    order = Window.partitionBy("template").orderBy("binding_id")
    chosen = (
        bindings.withColumn("binding_id", identity)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= per_template)
    )

    def fill(text: Column) -> Column:
        return F.aggregate(
            F.map_entries("values"), text, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"])
        )

    rows = chosen.join(templates, "template").select("*", F.posexplode("paraphrases").alias("variant", "paraphrase"))
    return rows.select(
        "template", "binding_id", F.col("variant").cast("bigint").alias("variant"),
        fill(F.col("paraphrase")).alias("question"), fill(F.col("sql")).alias("sql"),
    )


def abstention_accuracy(answers: DataFrame) -> DataFrame:
    """Share of answers that abstain exactly when the question cannot be answered."""
    from opsloom.functions.text import abstained

    right = abstained(F.col("answer")) == ~F.col("answerable")
    return answers.agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))
