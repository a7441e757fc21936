"""Span and trace operators: normalising, pricing, rollups, series and trace structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.scalar import exception_name, safe_int, utc_day
from opsloom.operators.quantiles import exact_quantiles
from opsloom.session import cut_lineage

TRACE_KEY = ["project_id", "trace_id"]

# Attribute names of the public GenAI span conventions and the kinds they map to.
ATTR = {
    "operation": "gen_ai.operation.name",
    "provider": "gen_ai.system",
    "request_model": "gen_ai.request.model",
    "response_model": "gen_ai.response.model",
    "input_tokens": "gen_ai.usage.input_tokens",
    "output_tokens": "gen_ai.usage.output_tokens",
    "tool_name": "gen_ai.tool.name",
    "agent_name": "gen_ai.agent.name",
    "error_type": "error.type",
    "service": "service.name",
}
KINDS = ("agent", "llm", "tool", "retrieval", "chain")
KIND_OF_OPERATION = {
    "chat": "llm",
    "text_completion": "llm",
    "generate_content": "llm",
    "embeddings": "llm",
    "execute_tool": "tool",
    "invoke_agent": "agent",
    "create_agent": "agent",
    "retrieval": "retrieval",
}
CONTENT_KEYS = {
    "input_text": ("{ext}.input", "gen_ai.prompt", "input.value"),
    "output_text": ("{ext}.output", "gen_ai.completion", "output.value"),
}


def _attr(name: str) -> Column:
    """Attribute value; an empty string counts as missing."""
    return F.nullif(F.col("attributes")[name], F.lit(""))


def drop_unidentified(raw: DataFrame) -> DataFrame:
    return raw.filter((F.length("trace_id") > 0) & (F.length("span_id") > 0))


def rejected_count(raw: DataFrame) -> DataFrame:
    known = (F.length("trace_id") > 0) & (F.length("span_id") > 0)
    return raw.agg(
        F.count_if(known).alias("identified"), F.count_if(~F.coalesce(known, F.lit(False))).alias("rejected")
    )


def pop_content(df: DataFrame, ext: str = "ext") -> DataFrame:
    """Move prompt and completion out of the attribute map: first present key wins and leaves the map."""
    for column, patterns in CONTENT_KEYS.items():
        keys = [p.format(ext=ext) for p in patterns]
        winner = F.coalesce(*[F.when(F.col("attributes")[k].isNotNull(), F.lit(k)) for k in keys])
        df = (
            df.withColumn("_w", winner)
            .withColumn(column, F.when(F.col("_w").isNotNull(), F.col("attributes")[F.col("_w")]))
            .withColumn(
                "attributes",
                F.map_filter("attributes", lambda k, _: F.col("_w").isNull() | (k != F.col("_w"))),
            )
            .drop("_w")
        )
    return df


def normalize_spans(raw: DataFrame, project_id: Column | str, ext: str = "ext") -> DataFrame:
    """Decoded payload rows to span rows; rows without both ids are dropped.

    `ext` is the attribute prefix under which the sender stores its own fields.
    """
    project = F.lit(project_id) if isinstance(project_id, str) else project_id
    mapping = F.create_map(*[F.lit(x) for pair in KIND_OF_OPERATION.items() for x in pair])
    kind = F.coalesce(_attr(f"{ext}.span.kind"), mapping[_attr(ATTR["operation"])], F.lit("chain"))
    message = F.coalesce("status_message", F.lit(""))
    error_type = F.coalesce(
        _attr(ATTR["error_type"]), F.when(F.col("status") == "error", exception_name(message))
    )
    rows = pop_content(drop_unidentified(raw).withColumn("_attrs", F.col("attributes")), ext)
    attr = lambda name: F.nullif(F.col("_attrs")[name], F.lit(""))
    end = F.greatest("start_ns", F.coalesce("end_ns", "start_ns"))
    return rows.select(
        project.alias("project_id"),
        "trace_id",
        "span_id",
        F.nullif("parent_span_id", F.lit("")).alias("parent_span_id"),
        F.coalesce(F.nullif("name", F.lit("")), F.lit("span")).alias("name"),
        F.when(kind.isin(*KINDS), kind).otherwise("chain").alias("kind"),
        F.coalesce(F.col("resource")[ATTR["service"]], F.lit("")).alias("service"),
        "start_ns",
        end.alias("end_ns"),
        ((end - F.col("start_ns")) / 1e6).alias("duration_ms"),
        "status",
        F.left(message, F.lit(500)).alias("status_message"),
        error_type.alias("error_type"),
        F.coalesce(attr(ATTR["response_model"]), attr(ATTR["request_model"])).alias("model"),
        attr(ATTR["provider"]).alias("provider"),
        attr(ATTR["tool_name"]).alias("tool_name"),
        attr(f"{ext}.tool.args_hash").alias("tool_args_hash"),
        attr(ATTR["agent_name"]).alias("agent_name"),
        attr(f"{ext}.agent.version").alias("agent_version"),
        attr(f"{ext}.prompt.version").alias("prompt_version"),
        safe_int(F.col("_attrs")[ATTR["input_tokens"]]).alias("input_tokens"),
        safe_int(F.col("_attrs")[ATTR["output_tokens"]]).alias("output_tokens"),
        "input_text",
        "output_text",
        "attributes",
    )


def price_spans(spans: DataFrame, pricing: DataFrame) -> DataFrame:
    """cost = (in * rate_in + out * rate_out) / 1e6; the row whose model is null holds default rates.

    Without a model or without tokens the cost is 0.
    """
    rates = pricing.filter("model IS NOT NULL").select(
        F.col("model").alias("_m"), F.col("rate_in").alias("_ri"), F.col("rate_out").alias("_ro")
    )
    default = pricing.filter("model IS NULL").agg(F.struct(F.max("rate_in").alias("i"), F.max("rate_out").alias("o")))
    fallback = default.scalar()
    free = F.col("model").isNull() | ((F.col("input_tokens") == 0) & (F.col("output_tokens") == 0))
    cost = (
        F.col("input_tokens") * F.coalesce("_ri", fallback["i"])
        + F.col("output_tokens") * F.coalesce("_ro", fallback["o"])
    ) / 1e6
    return (
        spans.join(rates, F.col("model") == F.col("_m"), "left")
        .withColumn("cost_usd", F.when(free, F.lit(0.0)).otherwise(cost))
        .drop("_m", "_ri", "_ro")
    )


def max_tool_repeat(spans: DataFrame) -> DataFrame:
    """Largest number of identical (tool, arguments) calls in each trace."""
    return (
        spans.filter("kind = 'tool'")
        .groupBy(*TRACE_KEY, "tool_name", "tool_args_hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*TRACE_KEY)
        .agg(F.max("n").alias("max_tool_repeat"))
    )


def trace_measures(spans: DataFrame, with_sets: bool = False) -> DataFrame:
    """Trace measures with the name and service of the earliest parentless span.

    The numeric measures keep to fixed-width buffers, so that they aggregate by hash on the map
    side; names and the optional sets of models and tools come from small side aggregates that end
    up partitioned by the same key.
    """
    rooted = F.col("parent_span_id").isNull()
    measures = spans.groupBy(*TRACE_KEY).agg(
        F.min("start_ns").alias("start_ns"),
        F.max("end_ns").alias("end_ns"),
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(F.col("kind") == "llm").alias("llm_calls"),
        F.count_if(F.col("kind") == "tool").alias("tool_calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 8).alias("cost_usd"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.count_if(F.coalesce(F.size("pii_found"), F.lit(0)) > 0).alias("pii_spans"),
        F.max(rooted).alias("has_root"),
    )
    order = F.struct("start_ns", "span_id")
    roots = (
        spans.filter(rooted)
        .groupBy(*TRACE_KEY)
        .agg(F.min_by("name", order).alias("root_name"), F.min_by("service", order).alias("service"))
    )
    out = (
        measures.join(roots, TRACE_KEY, "left")
        .join(max_tool_repeat(spans), TRACE_KEY, "left")
        .withColumn("max_tool_repeat", F.coalesce("max_tool_repeat", F.lit(0).cast("bigint")))
        .withColumn("duration_ms", (F.col("end_ns") - F.col("start_ns")) / 1e6)
    )
    if with_sets:
        used = spans.select(*TRACE_KEY, "model", "tool_name").distinct().groupBy(*TRACE_KEY)
        sets = used.agg(
            F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("tool_name")).alias("tools")
        )
        out = out.join(sets, TRACE_KEY, "left")
    return out


def orphans(spans: DataFrame) -> DataFrame:
    """Spans that name a parent which is absent from their trace."""
    ids = spans.select(*TRACE_KEY, F.col("span_id").alias("parent_span_id"))
    return spans.filter("parent_span_id IS NOT NULL").join(ids, [*TRACE_KEY, "parent_span_id"], "left_anti")


def parent_links(spans: DataFrame) -> DataFrame:
    """Each span with its parent row inside the trace; is_orphan when the named parent is missing."""
    parents = spans.select(
        *TRACE_KEY,
        F.col("span_id").alias("parent_span_id"),
        F.col("name").alias("parent_name"),
        F.col("start_ns").alias("parent_start_ns"),
    )
    return spans.join(parents, [*TRACE_KEY, "parent_span_id"], "left").withColumn(
        "is_orphan", F.col("parent_span_id").isNotNull() & F.col("parent_name").isNull()
    )


def true_root(spans: DataFrame) -> DataFrame:
    """The root span of every trace: earliest parentless span, else earliest orphan."""
    roots = spans.filter("parent_span_id IS NULL").withColumn("_o", F.lit(0))
    rest = orphans(spans).withColumn("_o", F.lit(1)).select(*roots.columns)
    keep = [c for c in spans.columns if c not in TRACE_KEY]
    return (
        roots.unionByName(rest)
        .groupBy(*TRACE_KEY)
        .agg(F.min_by(F.struct(*keep), F.struct("_o", "start_ns", "span_id")).alias("_s"))
        .select(*TRACE_KEY, "_s.*")
    )


def span_depth(spans: DataFrame) -> DataFrame:
    """Length of the parent chain of every span (1 at a root), safe against parent cycles.

    Each round doubles the distance every span has climbed, so a chain of length n takes log2(n)
    self joins. Spans still climbing once the distance exceeds the largest trace sit on or below a
    cycle; only those are walked hop by hop.
    """
    links = spans.select(*TRACE_KEY, "span_id", "parent_span_id")
    ids = links.select(*TRACE_KEY, F.col("span_id").alias("parent_span_id"), F.col("span_id").alias("up"))
    state = links.join(ids, [*TRACE_KEY, "parent_span_id"], "left").select(
        *TRACE_KEY, "span_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("steps")
    )
    state, reach, largest = state.persist(), 1, None
    while not state.filter("up IS NOT NULL").isEmpty():
        if largest is None:
            largest = links.groupBy(*TRACE_KEY).count().agg(F.max("count")).first()[0]
        if reach > largest:
            break
        above = state.select(
            *TRACE_KEY, F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps")
        )
        climbed = state.join(above, [*TRACE_KEY, "up"], "left").select(
            *TRACE_KEY, "span_id", F.col("_up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")
        )
        reach *= 2
        state = cut_lineage(climbed) if reach in (16, 256, 4096, 65536) else climbed.persist()
    depth = state.filter("up IS NULL").select(*TRACE_KEY, "span_id", (F.col("steps") + 1).alias("depth"))
    if largest is None or reach <= largest:
        return depth
    return depth.unionByName(_cycle_depth(state.filter("up IS NOT NULL").select(*TRACE_KEY, "span_id"), links))


def _cycle_depth(stuck: DataFrame, links: DataFrame) -> DataFrame:
    """Depth of spans whose chain runs into a cycle: distinct spans on the chain plus one."""
    up = links.select(*TRACE_KEY, F.col("span_id").alias("_at"), F.col("parent_span_id").alias("_next"))
    walk = stuck.withColumn("_at", F.col("span_id")).withColumn("_path", F.array().cast("array<string>"))
    done = None
    while True:
        closed = F.array_contains("_path", F.col("_at"))
        part = walk.filter(closed).select(*TRACE_KEY, "span_id", (F.size("_path") + 1).alias("depth"))
        done = part if done is None else done.unionByName(part)
        walk = (
            walk.filter(~closed)
            .join(up, [*TRACE_KEY, "_at"])
            .select(
                *TRACE_KEY,
                "span_id",
                F.col("_next").alias("_at"),
                F.array_append("_path", F.col("_at")).alias("_path"),
            )
        )
        walk = cut_lineage(walk)
        if walk.isEmpty():
            return done


def trace_rollup(spans: DataFrame) -> DataFrame:
    """Full trace summary. Rootless traces take the name of their earliest orphan.

    The orphan search runs only over traces without a parentless span.
    """
    base = trace_measures(spans, with_sets=True)
    rootless = spans.join(base.filter(~F.col("has_root")).select(*TRACE_KEY), TRACE_KEY, "left_semi")
    order = F.struct("start_ns", "span_id")
    adopted = (
        orphans(rootless)
        .groupBy(*TRACE_KEY)
        .agg(F.min_by("name", order).alias("_n"), F.min_by("service", order).alias("_s"))
    )
    depth = span_depth(spans).groupBy(*TRACE_KEY).agg(F.max("depth").alias("max_depth"))
    return (
        base.join(adopted, TRACE_KEY, "left")
        .join(depth, TRACE_KEY, "left")
        .withColumn("root_name", F.coalesce("root_name", "_n"))
        .withColumn("service", F.coalesce("service", "_s"))
        .drop("_n", "_s")
    )


def traces_in_range(
    traces: DataFrame, start_ns: int, end_ns: int, root_name: str | None = None, limit: int | None = None
) -> DataFrame:
    """Rooted traces that start in [start, end), newest first when a limit is given."""
    out = traces.filter(F.col("has_root") & (F.col("start_ns") >= start_ns) & (F.col("start_ns") < end_ns))
    if root_name is not None:
        out = out.filter(F.col("root_name") == root_name)
    return out if limit is None else out.orderBy(F.desc("start_ns"), "trace_id").limit(limit)


def spans_of_traces(spans: DataFrame, traces: DataFrame) -> DataFrame:
    return spans.join(traces.select(*TRACE_KEY), TRACE_KEY, "left_semi")


def window_start(column: str, window_ns: int) -> Column:
    return (F.col(column) - F.pmod(F.col(column), F.lit(window_ns).cast("bigint"))).alias("window_start_ns")


def metric_series(traces: DataFrame, bucket_ns: int) -> DataFrame:
    """Per project and time bucket: traces, error rate, p95, cost, tokens; a null bucket is the total."""
    rooted = traces.filter("has_root").withColumn("bucket_ns", window_start("start_ns", bucket_ns))
    both = rooted.withColumn("bucket_ns", F.explode(F.array("bucket_ns", F.lit(None).cast("bigint"))))
    keys = ["project_id", "bucket_ns"]
    sums = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("traces"),
        F.avg((F.col("error_count") > 0).cast("double")).alias("error_rate"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
    )
    p95 = exact_quantiles(both, keys, "duration_ms", {"p95_ms": 0.95})
    match = sums["project_id"].eqNullSafe(p95["project_id"]) & sums["bucket_ns"].eqNullSafe(p95["bucket_ns"])
    return sums.join(p95, match, "left").select(sums["*"], F.coalesce(p95["p95_ms"], F.lit(0.0)).alias("p95_ms"))


def daily_spend(spans: DataFrame) -> DataFrame:
    """Cost per project and UTC day."""
    return spans.groupBy("project_id", utc_day(F.col("start_ns")).alias("day")).agg(F.sum("cost_usd").alias("spent"))


def time_range(traces: DataFrame) -> DataFrame:
    """First start and last end per project, rootless traces included."""
    return traces.groupBy("project_id").agg(F.min("start_ns").alias("first_ns"), F.max("end_ns").alias("last_ns"))


def first_seen(spans: DataFrame, value: str) -> DataFrame:
    """The first span that carries each value of a column, per project."""
    return (
        spans.filter(F.col(value).isNotNull())
        .groupBy("project_id", F.col(value).alias("value"))
        .agg(F.min(F.struct("start_ns", "trace_id", "span_id")).alias("s"))
        .select("project_id", "value", "s.start_ns", "s.trace_id", "s.span_id")
    )


def trace_waterfall(spans: DataFrame, max_depth: int = 20) -> DataFrame:
    """Order of spans in their trace, offset from the trace start and nesting depth."""
    start = spans.groupBy(*TRACE_KEY).agg(F.min("start_ns").alias("_t0"))
    depth = span_depth(spans).withColumn("depth", F.least("depth", F.lit(max_depth)))
    rows = spans.join(start, TRACE_KEY).join(depth, [*TRACE_KEY, "span_id"])
    order = Window.partitionBy(*TRACE_KEY).orderBy("start_ns", "span_id")
    return rows.select(
        *TRACE_KEY,
        "span_id",
        ((F.col("start_ns") - F.col("_t0")) / 1e6).alias("offset_ms"),
        F.col("depth").cast("bigint").alias("depth"),
        F.row_number().over(order).cast("bigint").alias("position"),
    )


def recent_n(df: DataFrame, ts: str, n: int, *ties: str) -> DataFrame:
    """Newest n rows first."""
    return df.orderBy(F.desc(ts), *ties).limit(n)
