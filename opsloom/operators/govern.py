"""Governance: content policy, violations, budgets, retention, role views, leak checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import pii
from opsloom.operators.spans import daily_spend
from opsloom.sources.reference import DEFAULT_POLICY, POLICY_SCHEMA


def resolve_policy(projects: DataFrame, overrides: DataFrame, default: Mapping = DEFAULT_POLICY) -> DataFrame:
    """One full policy row per project: its own settings over the defaults."""
    types = dict(part.split(" ", 1) for part in POLICY_SCHEMA.split(", "))
    joined = projects.select("project_id").join(overrides, "project_id", "left")

    def value(name: str) -> Column:
        base = default[name]
        literal = F.array(*[F.lit(x) for x in base]) if isinstance(base, list) else F.lit(base)
        return F.coalesce(F.col(name), literal.cast(types[name])).alias(name)

    return joined.select("project_id", *[value(n) for n in types])


def _to_every_task(policies: DataFrame) -> DataFrame:
    """One row per project, so small beside its spans; dealing out spans by project would give a large one to one task."""
    return F.broadcast(policies)


def apply_content_policy(spans: DataFrame, policies: DataFrame) -> DataFrame:
    """Redact texts and string attributes before storage and count what was found.

    `redact` masks texts and attributes, `block` masks attributes and drops the texts of spans with
    findings, `allow` keeps everything; without content capture the texts are always dropped.
    """
    wanted = policies.select("project_id", F.col("pii").alias("_mode"), F.col("capture_content").alias("_keep"))
    rows = spans.join(_to_every_task(wanted), "project_id")
    rows = rows.withColumns({f"_h_{c}": pii.pii_scan(F.col(c)) for c in ("input_text", "output_text")})
    # All attribute values of a row are scanned in one call.
    rows = rows.withColumn("_keys", F.map_keys("attributes")).withColumn("_values", F.map_values("attributes"))
    rows = rows.withColumn("_h_attrs", _scan_texts("_values"))
    counts = pii.add_counts(pii.count_hits(F.col("_h_input_text")), pii.count_hits(F.col("_h_output_text")))
    counts = pii.add_counts(counts, pii.count_hits(F.flatten("_h_attrs")))
    masked_values = F.zip_with("_values", "_h_attrs", lambda v, h: pii.redact_hits(v, h))
    found = rows.withColumn("pii_found", counts).withColumn(
        "attributes",
        F.when(F.col("_mode") != "allow", F.map_from_arrays("_keys", masked_values)).otherwise(F.col("attributes")),
    )
    drop = ~F.col("_keep") | ((F.col("_mode") == "block") & (F.size("pii_found") > 0))
    for c in ("input_text", "output_text"):
        masked = F.when(F.col("_mode") == "redact", pii.redact_hits(F.col(c), F.col(f"_h_{c}"))).otherwise(F.col(c))
        found = found.withColumn(c, F.when(~drop, masked))
    return found.select(*spans.columns, *(["pii_found"] if "pii_found" not in spans.columns else []))


def _scan_texts(texts: str) -> Column:
    """Hits of every text of an array column."""

    @F.pandas_udf(f"array<{pii.HITS}>")
    def scan(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: [pii.find_hits(t) if t is not None else [] for t in a] if a is not None else [])

    return scan(texts)


def _check(condition: Column, name: str, severity: Column | str, message: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(condition, F.struct(F.lit(name).alias("policy"), level.alias("severity"), message.alias("message")))


def span_violations(spans: DataFrame, policies: DataFrame) -> DataFrame:
    """Unapproved models, forbidden tools, token limits and sensitive data, one row each."""
    c = F.col
    limits = policies.select("project_id", "pii", "allowed_models", "forbidden_tools", "max_tokens_per_call")
    rows = spans.join(_to_every_task(limits), "project_id")
    tokens = c("input_tokens") + c("output_tokens")
    kinds = F.array_sort(F.map_keys("pii_found"))
    detail = F.array_join(
        F.transform(kinds, lambda k: F.concat(k, F.lit("x"), c("pii_found")[k].cast("string"))), ", "
    )
    secret = F.arrays_overlap(F.map_keys("pii_found"), F.array(*[F.lit(s) for s in pii.SECRETS]))
    action = F.when(c("pii") == "redact", "redacted").when(c("pii") == "block", "content dropped").otherwise("stored as-is")
    checks = [
        _check(
            (c("kind") == "llm") & (F.length("model") > 0) & (F.size("allowed_models") > 0) & ~F.array_contains("allowed_models", c("model")),
            "unapproved_model", "high", F.concat(F.lit("model "), "model", F.lit(" is not on the approved list")),
        ),
        _check(
            (c("kind") == "tool") & F.array_contains("forbidden_tools", c("tool_name")),
            "forbidden_tool", "critical", F.concat(F.lit("forbidden tool "), "tool_name", F.lit(" was executed")),
        ),
        _check(
            tokens > c("max_tokens_per_call"),
            "token_limit", "medium",
            F.concat(tokens.cast("string"), F.lit(" tokens exceed the per-call limit of "), c("max_tokens_per_call").cast("string")),
        ),
        _check(
            F.coalesce(F.size("pii_found"), F.lit(0)) > 0,
            "sensitive_data", F.when(secret, "critical").otherwise("high"),
            F.concat(F.lit("sensitive data in span content ("), detail, F.lit("); "), action),
        ),
    ]
    found = rows.select(
        "project_id", "trace_id", "span_id", c("start_ns").alias("ts_ns"), F.explode(F.array_compact(F.array(*checks))).alias("v")
    )
    return found.select("project_id", "trace_id", "span_id", "ts_ns", "v.*")


def trace_violations(traces: DataFrame, policies: DataFrame) -> DataFrame:
    """Cost and step limits of rooted traces."""
    c = F.col
    limits = policies.select("project_id", "max_cost_per_trace_usd", "max_steps_per_trace")
    money = lambda x, d: F.format_string(f"%.{d}f", x)
    checks = [
        _check(
            c("cost_usd") > c("max_cost_per_trace_usd"), "trace_cost_limit", "medium",
            F.concat(F.lit("trace cost $"), money(c("cost_usd"), 4), F.lit(" exceeds $"), money(c("max_cost_per_trace_usd"), 2)),
        ),
        _check(
            c("span_count") > c("max_steps_per_trace"), "step_limit", "high",
            F.concat(c("span_count").cast("string"), F.lit(" steps exceed the limit of "), c("max_steps_per_trace").cast("string")),
        ),
    ]
    found = traces.filter("has_root").join(_to_every_task(limits), "project_id").select(
        "project_id", "trace_id", F.lit(None).cast("string").alias("span_id"), c("start_ns").alias("ts_ns"),
        F.explode(F.array_compact(F.array(*checks))).alias("v"),
    )
    return found.select("project_id", "trace_id", "span_id", "ts_ns", "v.*")


def budget_violations(spans: DataFrame, policies: DataFrame) -> DataFrame:
    """Days on which a project spent more than its budget."""
    spent = daily_spend(spans).join(policies.select("project_id", "daily_budget_usd"), "project_id")
    day = F.col("day").cast("string")
    message = F.concat(
        F.lit("spend $"), F.format_string("%.2f", F.col("spent")), F.lit(" on "), day, F.lit(" exceeds budget $"),
        F.format_string("%.2f", F.col("daily_budget_usd")),
    )
    return spent.filter("spent > daily_budget_usd").select(
        "project_id",
        F.concat(F.lit("budget:"), day).alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        (F.unix_date("day").cast("bigint") * F.lit(86_400 * 10**9)).alias("ts_ns"),
        F.lit("daily_budget").alias("policy"),
        F.lit("high").alias("severity"),
        message.alias("message"),
    )


def violations_by_policy(violations: DataFrame) -> DataFrame:
    return violations.groupBy("policy", "severity").agg(F.count(F.lit(1)).alias("n"))


def tenant_counts(traces: DataFrame, violations: DataFrame) -> DataFrame:
    """Traffic and violations per project and policy."""
    totals = traces.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("traces"), F.sum("span_count").alias("spans"), F.sum("pii_spans").alias("pii_spans")
    )
    found = violations.groupBy("project_id", "policy").agg(F.count(F.lit(1)).alias("violations"))
    return totals.join(found, "project_id", "left")


def apply_retention(
    spans: DataFrame, traces: DataFrame, now_ns: int, retention_days: int = 30, content_days: int = 7
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, traces, counts): old spans and traces go, the texts of ageing spans go first."""
    day = 86_400 * 10**9
    keep, fresh = now_ns - retention_days * day, now_ns - content_days * day
    start = F.col("start_ns")
    has_text = F.col("input_text").isNotNull() | F.col("output_text").isNotNull()
    kept = spans.filter(start >= keep).withColumns(
        {c: F.when(start >= fresh, F.col(c)) for c in ("input_text", "output_text")}
    )
    counts = spans.agg(
        F.count_if((start < fresh) & has_text).alias("content_scrubbed"), F.count_if(start < keep).alias("spans_deleted")
    )
    return kept, traces.filter(start >= keep), counts


def rescan_stored(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Hits per table and kind in everything persisted; addresses of hosts are not counted."""
    out = None
    for name, (df, columns) in tables.items():
        texts = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("t"))
        hits = texts.select(F.explode(pii.pii_scan(F.col("t"))).alias("h")).filter("h.kind <> 'IP_ADDRESS'")
        part = hits.groupBy(F.lit(name).alias("table"), F.col("h.kind").alias("kind")).agg(F.count(F.lit(1)).alias("hits"))
        out = part if out is None else out.unionByName(part)
    return out


def redacted_read(df: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """Span rows without their texts unless a scope allows reading content."""
    allowed = bool({"read:content", "admin"} & set(scopes))
    return df if allowed else df.drop("input_text", "output_text")


def tenant_scope(df: DataFrame, project_id: str) -> DataFrame:
    return df.filter(F.col("project_id") == project_id)


@dataclass(frozen=True)
class RowFilter:
    """Rows whose column equals a context value, directly or through a parent table's key."""

    column: str
    context_key: str
    parent: str | None = None  # table that holds the column
    key: str | None = None  # key shared with the parent


@dataclass(frozen=True)
class RolePolicy:
    name: str
    tables: tuple[str, ...]
    deny_columns: tuple[str, ...] = ()  # table.column
    write_tables: tuple[str, ...] = ()
    row_filters: Mapping[str, RowFilter] = field(default_factory=dict)
    required_context: tuple[str, ...] = ()
    max_rows: int = 1000


# The three built-in roles.
ROLES = {
    "analyst": RolePolicy(
        "analyst",
        ("plans", "members", "providers", "diagnoses", "procedures", "claims", "claim_lines"),
        ("members.first_name", "members.last_name", "members.date_of_birth", "members.ssn_last4"),
    ),
    "claims_auditor": RolePolicy(
        "claims_auditor",
        ("plans", "members", "providers", "diagnoses", "procedures", "claims", "claim_lines", "audit_flags"),
        ("members.ssn_last4",),
        write_tables=("audit_flags",),
        max_rows=500,
    ),
    "provider_portal": RolePolicy(
        "provider_portal",
        ("claims", "claim_lines", "procedures", "diagnoses"),
        row_filters={
            "claims": RowFilter("provider_id", "provider_id"),
            "claim_lines": RowFilter("provider_id", "provider_id", "claims", "claim_id"),
        },
        required_context=("provider_id",),
        max_rows=200,
    ),
}


class PolicyViolation(PermissionError):
    """A request that the role does not allow."""


def governed_views(tables: Mapping[str, DataFrame], policy: RolePolicy, context: Mapping | None = None) -> dict[str, DataFrame]:
    """What a role may see of each table: allowed tables, without denied columns, own rows only.

    Context values are bound as literals. A missing context value is refused, not read as empty.
    """
    context = context or {}
    missing = [k for k in policy.required_context if context.get(k) is None]
    if missing:
        raise PolicyViolation(f"missing context: {', '.join(missing)}")
    views = {}
    for name in policy.tables:
        if name not in tables:
            continue
        df = tables[name]
        rule = policy.row_filters.get(name)
        if rule is not None:
            value = F.lit(context[rule.context_key])
            if rule.parent is None:
                df = df.filter(F.col(rule.column) == value)
            else:
                own = tables[rule.parent].filter(F.col(rule.column) == value).select(rule.key)
                df = df.join(own, rule.key, "left_semi")
        denied = [ref.split(".", 1)[1] for ref in policy.deny_columns if ref.split(".", 1)[0] == name]
        views[name] = df.drop(*denied)
    return views


def _flag_more(capped: DataFrame, whole: DataFrame, limit: int, flag: str | None) -> DataFrame:
    """Adds the flag column: whether `whole` has more rows than the limit. Reads at most one row beyond it."""
    if flag is None:
        return capped
    more = whole.limit(limit + 1).agg((F.count(F.lit(1)) > limit).alias("more"))
    return capped.withColumn(flag, more.scalar())


def row_cap(df: DataFrame, policy: RolePolicy, own_limit: int | None = None, flag: str | None = None) -> DataFrame:
    """At most the role's rows; a column named `flag` tells whether rows were left out."""
    limit = policy.max_rows if own_limit is None else min(own_limit, policy.max_rows)
    return _flag_more(df.limit(limit), df, limit, flag)


# Functions that reach outside the tables.
_UNSAFE_CALL = re.compile(r"\b(?:java_method|reflect|try_reflect|input_file_name|current_user|session_user)\s*\(", re.I)


def governed_sql(
    spark: SparkSession,
    load: Callable[[SparkSession], Mapping[str, DataFrame]],
    policy: RolePolicy,
    sql: str,
    context: Mapping | None = None,
    flag: str | None = None,
) -> DataFrame:
    """Run a SELECT of a user against the role's views only.

    The views live in a session of their own, so other tables do not resolve. The text is used as a
    subquery, which admits nothing but one query; the outer limit caps its rows, and a column named
    `flag` tells whether rows were left out. Whatever the plan reads must come from files behind the views.
    """
    if _UNSAFE_CALL.search(sql):
        raise PolicyViolation("function not allowed")
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    views = governed_views(load(session), policy, context)
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    body = sql.strip().rstrip(";")
    try:
        result = session.sql(f"SELECT * FROM (\n{body}\n) AS governed LIMIT {policy.max_rows}")
    except Exception as exc:
        raise PolicyViolation(str(exc).split("\n")[0]) from exc
    allowed = {f for view in views.values() for f in view.inputFiles()}
    if not set(result.inputFiles()) <= allowed:
        raise PolicyViolation("query reads data outside the role's tables")
    return _flag_more(result, session.sql(body), policy.max_rows, flag)


def check_write(policy: RolePolicy, table: str) -> None:
    if table not in policy.write_tables:
        raise PolicyViolation(f"role {policy.name} may not write to {table}")


def leaked_cells(result: DataFrame, restricted: Sequence[DataFrame]) -> DataFrame:
    """Result cells whose text equals a value of a denied column (each given as a one-column table)."""
    values = None
    for df in restricted:
        part = df.select(F.col(df.columns[0]).cast("string").alias("cell"))
        values = part if values is None else values.unionByName(part)
    cells = result.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in result.columns])
        ).alias("c")
    ).select("c.*")
    return cells.join(values.distinct(), "cell", "left_semi")


def redteam_matrix(
    spark: SparkSession,
    load: Callable[[SparkSession], Mapping[str, DataFrame]],
    cases: Sequence[tuple[str, RolePolicy, str, Mapping]],
) -> DataFrame:
    """Status and leaked cell count of every (case, role, SQL, context); refused cases leak nothing."""
    out = None
    for name, policy, sql, context in cases:
        try:
            result = governed_sql(spark, load, policy, sql, context)
            tables = load(result.sparkSession)
            denied = [tables[t].select(c) for t, c in (ref.split(".", 1) for ref in policy.deny_columns) if t in tables]
            if denied:
                row = leaked_cells(result, denied).agg(F.count(F.lit(1)).alias("leaked"))
            else:
                row = result.agg(F.lit(0).cast("bigint").alias("leaked"))
            rows = row.select(F.lit(name).alias("case"), F.lit(policy.name).alias("role"), F.lit("ok").alias("status"), "leaked")
            rows = spark.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)  # one counter row
        except PolicyViolation:
            rows = spark.createDataFrame(
                [(name, policy.name, "refused", 0)], "case string, role string, status string, leaked bigint"
            )
        out = rows if out is None else out.unionByName(rows)
    return out

