import json
import random

from opsloom.operators import detect as dt
from opsloom.sources import reference, sinks
from opsloom.streaming import streams as st
from tests.conftest import rows


def test_labelled_lines(spark, tmp_path):
    item = {
        "scenario": "dup", "claim": {"claim_id": "c", "service_date": "2024-03-01", "lines": [{"line_no": 1, "cpt": "99213", "units": 1, "charge": 9.5, "modifiers": []}]},
        "expected_lines": {"1": "deny"}, "expected_rules": ["R003"], "needs_judgment": False,
    }
    path = tmp_path / "claims.jsonl"
    path.write_text(json.dumps(item) + "\n")
    row = reference.read_labelled_jsonl(spark, str(path), reference.LABELLED_CLAIMS).first()
    assert row.expected_lines == {"1": "deny"} and row.claim.lines[0].charge == 9.5 and str(row.claim.service_date) == "2024-03-01"


def test_splits_reports_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "id int, split string")
    assert rows(sinks.write_splits(df, str(tmp_path / "s"))) == [("test", 1), ("train", 2)]
    assert spark.read.json(str(tmp_path / "s")).count() == 3
    sinks.write_report({"m": df}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "m")).count() == 3
    for _ in range(2):
        sinks.write_append(df, str(tmp_path / "a"), ["split"])
    assert spark.read.parquet(str(tmp_path / "a")).count() == 6


def test_insert_ignore_first_delivery_wins(spark):
    s = "k string, v int, arrival int"
    stored = spark.createDataFrame([("a", 0, 0)], s)
    new = spark.createDataFrame([("a", 1, 1), ("b", 3, 3), ("b", 2, 2), ("c", 4, 4)], s)
    assert rows(sinks.insert_ignore(new, ["k"], ["arrival"], stored).select("k", "v")) == [("b", 2), ("c", 4)]


METRIC = "project_id string, detector string, group_key string, metric string, method string, window_start_ns bigint, x double, n bigint, min_abs double"


def test_streamed_baseline_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    data = []
    for w in range(40):
        spike = 4 if w in (25, 26, 33) else 1
        data.append(("p", "latency", "g", "p95", "level", w, (500 + rng.gauss(0, 10)) * spike, None, 100.0))
        data.append(("p", "error_rate", "g", "rate", "rate", w, 1.0 + 9 * (spike > 1), 20, 0.0))
    df = spark.createDataFrame(data, METRIC)
    for lo in (0, 15, 28):
        hi = {0: 15, 15: 28, 28: 40}[lo]
        df.filter(f"window_start_ns >= {lo} AND window_start_ns < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{lo:02d}"))
    verdict = lambda d: {(r.detector, r.window_start_ns, round(r.observed, 6), r.is_anomaly) for r in d.collect()}
    stream = spark.readStream.schema(METRIC).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    st.run_to_files(st.stateful_baseline(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = verdict(spark.read.parquet(str(tmp_path / "out")))
    assert got == verdict(dt.detect_series(df))
    assert {(d, w) for d, w, _, flag in got if flag} == {(d, w) for d in ("latency", "error_rate") for w in (25, 26, 33)}


def test_replayed_batches_change_nothing(spark, tmp_path):
    s = (
        "project_id string, trace_id string, span_id string, parent_span_id string, name string, kind string, service string, start_ns bigint, "
        "end_ns bigint, status string, model string, tool_name string, tool_args_hash string, input_tokens bigint, output_tokens bigint, "
        "cost_usd double, pii_found map<string,int>"
    )
    row = lambda t, i, parent, at: ("p", t, i, parent, "n", "llm", "s", at, at + 1, "ok", "m", None, None, 1, 1, 0.1, None)
    store = st.SpanStore(spark, str(tmp_path / "store"), ["start_ns"], buckets=4)
    child = spark.createDataFrame([row("t1", "b", "a", 5), row("t2", "x", None, 1)], s)
    store.add(child, 0)
    assert rows(store.traces().select("trace_id", "span_count", "has_root")) == [("t1", 1, False), ("t2", 1, True)]
    root = spark.createDataFrame([row("t1", "a", None, 3)], s)
    for _ in range(2):
        store.add(root, 1)
        store.add(child, 2)
    assert store.spans().count() == 3
    assert rows(store.traces().select("trace_id", "span_count", "has_root", "start_ns")) == [("t1", 2, True, 3), ("t2", 1, True, 1)]
