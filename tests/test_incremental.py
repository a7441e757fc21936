"""Runs that go on from kept state give what one run over everything gives."""

import random

import pytest
from pyspark.sql import functions as F

from opsloom.operators import detect as dt
from opsloom.operators.incremental import IncrementalDetector
from opsloom.plans import detection_queries
from opsloom.sources.versions import VersionedTables

W = dt.WINDOW_NS


@pytest.fixture(scope="module")
def telemetry(spark):
    rng = random.Random(11)
    traces, spans = [], []
    for project, first in (("p", 0), ("q", 7), ("quiet", 0)):
        for w in range(first, 46):
            if project == "quiet" and w % 9:
                continue
            spike = w in (20, 21, 24, 33) or (project == "q" and w == 40)
            for i in range(rng.randrange(9, 13) * (3 if w == 28 else 1)):
                t, start = f"{project}{w}-{i}", w * W + rng.randrange(W // 2)
                ms = rng.gauss(1000, 20) * (5 if spike else 1)
                errors = int(w in (21, 22) and i % 2)
                traces.append((project, t, "main", True, start, start + int(ms * 1e6), ms, 2, 0.01 * (9 if w == 34 else 1), errors, 1, 0))
                model = "late" if w >= 30 and project == "p" else "usual"
                spans.append((project, t, f"{t}a", "llm", model, None, "ok", ms / 2, 50, 10, start))
                spans.append((project, t, f"{t}b", "tool", None, "hammer", "error" if errors else "ok", 5.0, 0, 0, start))
    t = "project_id string, trace_id string, root_name string, has_root boolean, start_ns bigint, end_ns bigint, duration_ms double, span_count bigint, cost_usd double, error_count bigint, max_tool_repeat bigint, pii_spans bigint"
    s = "project_id string, trace_id string, span_id string, kind string, model string, tool_name string, status string, duration_ms double, input_tokens bigint, output_tokens bigint, start_ns bigint"
    return spark.createDataFrame(traces, t).cache(), spark.createDataFrame(spans, s).cache()


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def bound(traces, ns):
    return traces.select("project_id").distinct().withColumn("until_ns", F.lit(ns))


def test_runs_in_parts_equal_one_run(spark, telemetry, tmp_path):
    traces, spans = telemetry
    want = dt.detect_anomalies(traces, spans)
    parts = IncrementalDetector(spark, f"{tmp_path}/parts")
    # Between a burst's windows, inside a window, and a project that has no data yet.
    for until in (5 * W, 21 * W + 17, 34 * W):
        early = traces.filter(F.col("start_ns") < until)
        parts.run(early, spans, bound(early, until))
    parts.run(traces, spans)
    assert rows_of(parts.anomalies().drop("version")) == rows_of(want) and want.count() > 20
    cursors = parts.cursors().select("project_id", "cursor_ns")
    incidents, members = dt.group_incidents(want, cursor=cursors)
    assert rows_of(parts.incidents()) == rows_of(incidents)
    assert rows_of(parts.members()) == rows_of(members)
    assert parts.incidents("open").count() == incidents.filter("status = 'open'").count()
    # Running again over the same tables finds nothing new; a named run that has committed is not done again.
    before = parts.anomalies().count()
    version = parts.run(traces, spans, writer="batch 7")
    assert parts.run(traces, spans, writer="batch 7") == version and parts.anomalies().count() == before
    assert rows_of(parts.incidents()) == rows_of(incidents)


def test_a_run_that_dies_changes_nothing(spark, telemetry, tmp_path, monkeypatch):
    traces, spans = telemetry
    detector = IncrementalDetector(spark, f"{tmp_path}/dies")
    early = traces.filter(F.col("start_ns") < 25 * W)
    detector.run(early, spans, bound(early, 25 * W))
    before = rows_of(detector.anomalies())
    create = spark.createDataFrame
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda self, rows, schema=None: (_ for _ in ()).throw(RuntimeError("gone")) if "writer" in str(schema) else create(rows, schema))
        with pytest.raises(RuntimeError):
            detector.run(traces, spans)
    assert rows_of(detector.anomalies()) == before and detector.store.version() == 1
    detector.run(traces, spans)
    assert rows_of(detector.anomalies().drop("version")) == rows_of(dt.detect_anomalies(traces, spans))


def test_versioned_tables(spark, tmp_path):
    store = VersionedTables(spark, f"{tmp_path}/v")
    assert store.version() == 0 and store.table("t", "x int").count() == 0 and store.all_versions("t", "x int").count() == 0
    for v in (1, 2):
        store.commit({"t": spark.createDataFrame([(v,)], "x int")}, v, f"w{v}")
    assert [r.x for r in store.table("t", "x int").collect()] == [2] and [r.x for r in store.table("t", "x int", 1).collect()] == [1]
    assert sorted(map(tuple, store.all_versions("t", "x int").collect())) == [(1, 1), (2, 2)]
    assert store.has_writer("w1") and not store.has_writer("w3") and store.writer_of(2) == "w2"
    with pytest.raises(Exception):
        store.commit({"t": spark.createDataFrame([(9,)], "x int")}, 2)
    assert [r.x for r in store.table("t", "x int").collect()] == [2]


def test_two_runs_read_stored_spans(spark, tmp_path, monkeypatch):
    """Both runs get the same tables, written once: no order line is joined to its order again."""
    line = [(1, 1, 10, 20, 5.0, 1000.5, 0.09, 0.08, "R", "F"), (1, 2, 11, 21, 6.0, 1001.5, 0.01, 0.0, "N", "O"), (2, 1, 12, 21, 6.0, 1.0, 0.01, 0.0, "N", "O")]
    names = "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, "
    spark.createDataFrame(line, names + "l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, "1-URGENT"), (2, 8, "2-HIGH")], "o_orderkey bigint, o_custkey bigint, o_orderpriority string").selectExpr(
        "*", "timestamp'1995-03-01' AS o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    given = []

    class Detector:
        def __init__(self, *_):
            pass

        def run(self, traces, spans, until=None):
            given.append((traces, spans, until))

    monkeypatch.setattr(detection_queries, "IncrementalDetector", Detector)
    detection_queries.two_runs(spark, str(tmp_path))
    assert len(given) == 2 and given[0][2] is not None and given[1][2] is None
    assert sorted(r.span_id for r in given[1][1].collect()) == ["1-1", "1-2", "2-1"] and given[1][0].count() == 2
    for traces, spans, _ in given:
        for table in (traces, spans):
            assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString() and str(tmp_path) not in "".join(table.inputFiles())
            assert table.inputFiles()
