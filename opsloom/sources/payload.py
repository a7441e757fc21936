"""Span payloads in the OTLP/JSON shape: decoding to flat rows and encoding in batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nested arrays and key/value lists arrive as raw JSON text inside the union.
_VALUE = (
    "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string,"
    "arrayValue:string,kvlistValue:string>"
)
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_SPANS = (
    "array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:string,message:string>>>"
)
_SCOPES = f"array<struct<spans:{_SPANS}>>"
PAYLOAD_SCHEMA = (
    f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:{_SCOPES},"
    f"instrumentationLibrarySpans:{_SCOPES}>>>"
)


def _plain(value: dict):
    """Plain JSON value of one nested union."""
    for key, kind in (("stringValue", str), ("intValue", int), ("doubleValue", float), ("boolValue", bool)):
        if key in value:
            return kind(value[key])
    if "arrayValue" in value:
        return [_plain(v) for v in value["arrayValue"].get("values", [])]
    if "kvlistValue" in value:
        return {e["key"]: _plain(e["value"]) for e in value["kvlistValue"].get("values", [])}
    return value.get("bytesValue")


def scalar_value(v: Column) -> Column:
    """Text of a scalar union value, null for nested ones."""
    return F.coalesce(
        v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), v["bytesValue"]
    )


def attribute_map(items: Column) -> Column:
    """Key/value list to map; of duplicate keys the last one counts. Nested values stay as raw JSON."""
    # No lambda is nested in another one here: a Python UDF over such an expression cannot be planned.
    items = F.coalesce(items, F.array().cast(_ATTRS))
    backwards = F.reverse(items["key"])
    last = F.filter(items, lambda x, i: F.array_position(backwards, x["key"]) == F.size(items) - i)
    # Each key is looked for among all others only in lists that do repeat one, or have one without a key.
    plain = F.size(F.array_compact(F.array_distinct(items["key"]))) == F.size(items)
    last = F.when(plain, items).otherwise(last)
    raw = lambda v: F.coalesce(scalar_value(v), v["arrayValue"], v["kvlistValue"])
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"].alias("key"), raw(x["value"]).alias("value"))))


def normalize_hex_id(raw: Column, nbytes: int) -> Column:
    """Hex ids in lower case; base64 ids of the right length become hex; anything else stays."""
    is_hex = (F.length(raw) == 2 * nbytes) & raw.rlike("^[0-9a-fA-F]+$")
    decoded = F.try_to_binary(raw, F.lit("base64"))
    return (
        F.when(F.coalesce(F.length(raw), F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(is_hex, F.lower(raw))
        .when(F.length(decoded) == nbytes, F.lower(F.hex(decoded)))
        .otherwise(raw)
    )


def flatten_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per span of each payload (a struct or JSON text column), works on batches and streams."""
    body = F.col(column)
    if dict(payloads.dtypes)[column] == "string":
        body = F.from_json(body, PAYLOAD_SCHEMA)
    carried = [c for c in payloads.columns if c != column]
    resources = payloads.select(*carried, F.explode(body["resourceSpans"]).alias("r"))
    usable = F.when(F.size("r.scopeSpans") > 0, F.col("r.scopeSpans")).otherwise(F.col("r.instrumentationLibrarySpans"))
    scopes = resources.select(*carried, attribute_map(F.col("r.resource.attributes")).alias("resource"), F.explode(usable).alias("s"))
    rows = scopes.select(*carried, "resource", F.explode("s.spans").alias("x"))
    start = F.coalesce(F.col("x.startTimeUnixNano").try_cast("bigint"), F.lit(0).cast("bigint"))
    end = F.col("x.endTimeUnixNano").try_cast("bigint")
    failed = F.coalesce(F.col("x.status.code").isin("2", "STATUS_CODE_ERROR"), F.lit(False))
    return rows.select(
        *carried,
        normalize_hex_id(F.col("x.traceId"), 16).alias("trace_id"),
        normalize_hex_id(F.col("x.spanId"), 8).alias("span_id"),
        normalize_hex_id(F.col("x.parentSpanId"), 8).alias("parent_span_id"),
        F.coalesce("x.name", F.lit("")).alias("name"),
        start.alias("start_ns"),
        F.coalesce(F.nullif(end, F.lit(0).cast("bigint")), start).alias("end_ns"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.coalesce("x.status.message", F.lit("")).alias("status_message"),
        attribute_map(F.col("x.attributes")).alias("attributes"),
        "resource",
    )


def decode_nested(values: Column) -> Column:
    """Raw nested union text (an arrayValue or kvlistValue body) as plain JSON text."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            body = json.loads(text)
            entries = body.get("values", [])
            kind = "kvlistValue" if entries and "key" in entries[0] else "arrayValue"
            return json.dumps(_plain({kind: body}))

        return texts.map(one)

    return plain(values)


def encode_payloads(spans: DataFrame, attributes: dict[str, str], service: str = "service", batch: int = 512) -> DataFrame:
    """Payload JSON texts: spans grouped by resource inside batches of bounded size.

    `attributes` maps attribute names to span columns; longs are written as strings, as the format
    asks. A batch is a run of rows of one task, so no resource is ever gathered as a whole.
    """
    types = dict(spans.dtypes)
    entries = []
    for name, column in attributes.items():
        kind = {"bigint": "intValue", "int": "intValue", "double": "doubleValue"}.get(types[column], "stringValue")
        shell = F.struct(
            *[
                (F.col(column) if k == "doubleValue" else F.col(column).cast("string")).alias(k)
                if k == kind
                else F.lit(None).cast("double" if k == "doubleValue" else "string").alias(k)
                for k in ("stringValue", "intValue", "doubleValue")
            ]
        )
        entries.append(F.when(F.col(column).isNotNull(), F.struct(F.lit(name).alias("key"), shell.alias("value"))))
    span = F.struct(
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        F.col("parent_span_id").alias("parentSpanId"),
        "name",
        F.col("start_ns").cast("string").alias("startTimeUnixNano"),
        F.col("end_ns").cast("string").alias("endTimeUnixNano"),
        F.array_compact(F.array(*entries)).alias("attributes"),
        F.struct(
            F.when(F.col("status") == "error", 2).otherwise(1).alias("code"), F.coalesce("status_message", F.lit("")).alias("message")
        ).alias("status"),
    )
    run = F.floor(F.monotonically_increasing_id() / batch)
    grouped = spans.select(run.alias("_run"), F.col(service).alias("_service"), span.alias("_s")).groupBy("_run", "_service").agg(
        F.collect_list("_s").alias("_spans")
    )
    resource = F.struct(
        F.array(
            F.struct(F.lit("service.name").alias("key"), F.struct(F.col("_service").alias("stringValue")).alias("value"))
        ).alias("attributes")
    )
    scope = F.array(F.struct(F.col("_spans").alias("spans")))
    body = F.struct(F.array(F.struct(resource.alias("resource"), scope.alias("scopeSpans"))).alias("resourceSpans"))
    return grouped.select(F.to_json(body).alias("payload"))
