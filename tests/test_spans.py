import json
import random

from pyspark.sql import functions as F

from opsloom.operators import rca
from opsloom.operators import spans as sp
from opsloom.operators.series import as_of_state
from opsloom.sources import payload
from tests.conftest import rows

SPAN = (
    "project_id string, trace_id string, span_id string, parent_span_id string, name string, kind string, service string, start_ns bigint, "
    "end_ns bigint, duration_ms double, status string, model string, tool_name string, tool_args_hash string, input_tokens bigint, "
    "output_tokens bigint, cost_usd double, pii_found map<string,int>"
)


def _span(trace, span, parent, start, name="n", kind="chain", tool=None, args=None, status="ok"):
    return ("p", trace, span, parent, name, kind, "svc", start, start + 10, 1e-5, status, None, tool, args, 1, 2, 0.5, None)


def test_rollup_depth_roots_and_cycles(spark):
    data = [
        _span("t", "a", None, 5, "root"),
        _span("t", "b", "a", 6, kind="tool", tool="x", args="1"),
        _span("t", "c", "b", 7, kind="tool", tool="x", args="1", status="error"),
        _span("o", "d", "missing", 9, "late"),
        _span("o", "e", "gone", 3, "early"),
        _span("cyc", "f", "g", 1, "f"),
        _span("cyc", "g", "f", 2, "g"),
        _span("cyc", "h", "g", 2, "h"),
        _span("cyc", "i", None, 0, "i"),
    ]
    df = spark.createDataFrame(data, SPAN)
    depth = {r.span_id: r.depth for r in sp.span_depth(df).collect()}
    assert depth == {"a": 1, "b": 2, "c": 3, "d": 1, "e": 1, "f": 3, "g": 3, "h": 4, "i": 1}
    got = {r.trace_id: r for r in sp.trace_rollup(df).collect()}
    assert got["t"].max_tool_repeat == 2 and got["t"].error_count == 1 and got["t"].max_depth == 3 and got["t"].has_root
    assert got["o"].root_name == "early" and not got["o"].has_root
    assert {r.trace_id: r.name for r in sp.true_root(df).collect()} == {"t": "root", "o": "early", "cyc": "i"}


def _attr(key, **value):
    return {"key": key, "value": value}


def test_payload_decoding(spark):
    body = {
        "resourceSpans": [
            {
                "resource": {"attributes": [_attr("service.name", stringValue="svc")]},
                "instrumentationLibrarySpans": [
                    {
                        "spans": [
                            {
                                "traceId": "A" * 32, "spanId": "AQIDBAUGBwg=", "name": "call", "startTimeUnixNano": "5",
                                "attributes": [
                                    _attr("gen_ai.operation.name", stringValue="chat"), _attr("gen_ai.request.model", stringValue="m1"),
                                    _attr("gen_ai.usage.input_tokens", intValue="7"), _attr("gen_ai.usage.output_tokens", stringValue="many"),
                                    _attr("dup", stringValue="one"), _attr("dup", stringValue="two"),
                                    _attr("gen_ai.prompt", stringValue="hi"),
                                    _attr("list", arrayValue={"values": [{"intValue": "1"}, {"kvlistValue": {"values": [_attr("k", boolValue=True)]}}]}),
                                ],
                                "status": {"code": 2, "message": "TimeoutError: upstream"},
                            },
                            {"traceId": "", "spanId": "x", "name": "lost", "startTimeUnixNano": "1"},
                        ]
                    }
                ],
            }
        ]
    }
    raw = payload.flatten_payloads(spark.createDataFrame([(json.dumps(body),)], "payload string"))
    assert raw.count() == 2
    nested = raw.filter("name = 'call'").select(payload.decode_nested(raw.attributes["list"]).alias("v")).first().v
    assert json.loads(nested) == [1, {"k": True}]
    span = sp.normalize_spans(raw, "p").collect()
    assert len(span) == 1
    s = span[0]
    assert (s.trace_id, s.span_id, s.kind, s.model, s.status, s.error_type) == ("a" * 32, "0102030405060708", "llm", "m1", "error", "TimeoutError")
    assert (s.input_tokens, s.output_tokens, s.input_text, s.end_ns, s.service) == (7, 0, "hi", 5, "svc")
    assert s.attributes["dup"] == "two" and "gen_ai.prompt" not in s.attributes


def test_baseline_range_steps_back_over_neighbours(spark):
    m = rca.MINUTE_NS
    data = [("p", "a", 100 * m, 110 * m), ("p", "b", 115 * m, 200 * m), ("p", "c", 30 * m, 40 * m), ("p", "d", 150 * m, 155 * m)]
    df = spark.createDataFrame(data, "project_id string, incident_id string, start_ns bigint, end_ns bigint")
    got = {r.incident_id: r.base_end_ns // m for r in rca.baseline_ranges(df).collect()}
    # b touches a (5 minutes apart); d lies inside b, so it steps over b and then over a.
    assert got == {"a": 100, "b": 100, "c": 30, "d": 100}


def test_baseline_ranges_equal_a_walk(spark):
    rnd = random.Random(5)
    data = []
    for n in range(300):
        start = rnd.randint(0, 400)
        data.append((f"p{n % 12}", f"i{n}", start, start + rnd.choice((0, 1, 5, 20))))
    df = spark.createDataFrame(data, "project_id string, incident_id string, start_ns bigint, end_ns bigint")
    got = {r.incident_id: (r.base_start_ns, r.base_end_ns) for r in rca.baseline_ranges(df, 50, 3).collect()}

    def walk(project, own, end):
        covers = [s for p, i, s, e in data if p == project and i != own and s < end <= e + 3]
        return walk(project, own, min(covers)) if covers else end

    assert got == {i: (walk(p, i, s) - 50, walk(p, i, s)) for p, i, s, _ in data}


def test_as_of_state_carries_across_buckets(spark):
    day = 86_400 * 10**6
    changes = spark.createDataFrame([("a", 10, "v1", None), ("a", 3 * day, None, "m2"), ("a", 3 * day + 5, "v2", None)], "k string, us bigint, ver string, model string")
    points = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("a", 2 * day, 3), ("a", 3 * day + 5, 4), ("a", 9 * day, 5)], "k string, us bigint, id int")
    got = {r.id: (r.ver, r.model) for r in as_of_state(points, changes, ["k"], "us", ["ver", "model"]).collect()}
    assert got == {1: (None, None), 2: ("v1", None), 3: ("v1", None), 4: ("v2", "m2"), 5: ("v2", "m2")}


def test_pricing(spark):
    spans = spark.createDataFrame([("m", 1000, 1000), ("other", 1000, 0), (None, 9, 9), ("m", 0, 0)], "model string, input_tokens bigint, output_tokens bigint")
    prices = spark.createDataFrame([("m", 2.0, 4.0), (None, 1.0, 3.0)], "model string, rate_in double, rate_out double")
    assert rows(sp.price_spans(spans, prices).selectExpr("coalesce(model, '-') AS m", "input_tokens", "cost_usd")) == [
        ("-", 9, 0.0), ("m", 0, 0.0), ("m", 1000, 0.006), ("other", 1000, 0.001)
    ]


def test_attribute_lists_are_searched_only_where_keys_repeat(spark):
    """The last of equal keys counts and entries without a key are left out; a list of different keys is taken as it is."""
    lists = [[("a", "1"), ("b", "2"), ("a", "3")], [("a", "1"), (None, "2")], [(None, "1"), (None, "2"), ("a", "4")], [("b", None), ("a", "1")], [], None]
    data = [(i, None if x is None else [(k, (v, None, None, None, None, None, None)) for k, v in x]) for i, x in enumerate(lists)]
    df = spark.createDataFrame(data, f"i int, items {payload._ATTRS}")
    made = payload.attribute_map(F.col("items"))
    got = {r.i: r.m for r in df.select("i", made.alias("m")).collect()}
    assert got == {0: {"b": "2", "a": "3"}, 1: {"a": "1"}, 2: {"a": "4"}, 3: {"b": None, "a": "1"}, 4: {}, 5: {}}
    assert "array_distinct" in str(made)
