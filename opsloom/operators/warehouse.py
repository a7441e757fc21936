"""The 24 analytic questions over the claims star schema, as DataFrame functions.

Tables follow the warehouse model: claims, claim_lines, members, plans, providers, diagnoses,
procedures. Dimensions join on their keys; the optimizer broadcasts those it knows to be small.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named metric expressions, usable in any aggregate over claims.
METRICS = {
    "denial_rate": "avg(CASE WHEN status = 'denied' THEN 1.0D ELSE 0.0D END)",
    "total_paid": "sum(paid_amount)",
    "paid_to_billed_ratio": "sum(paid_amount) / sum(billed_amount)",
    "avg_days_to_submit": "avg(datediff(submitted_date, service_date))",
}


def metric(name: str) -> Column:
    return F.expr(METRICS[name])


def certified_metrics(claims: DataFrame, by: list[str]) -> DataFrame:
    return claims.groupBy(*by).agg(*[metric(m).alias(m) for m in METRICS])


def year_range(column: str, year: int) -> Column:
    """Half-open date range of a year: unlike year(col) = y it reaches the parquet row-group filter."""
    return (F.col(column) >= F.lit(dt.date(year, 1, 1))) & (F.col(column) < F.lit(dt.date(year + 1, 1, 1)))


def _count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by_status(claims: DataFrame, status: str) -> DataFrame:
    return _count(claims.filter(F.col("status") == status))


def members_in_state(members: DataFrame, state: str) -> DataFrame:
    return _count(members.filter(F.col("state") == state))


def providers_by_specialty_state(providers: DataFrame, specialty: str, state: str) -> DataFrame:
    chosen = providers.filter((F.col("specialty") == specialty) & (F.col("state") == state))
    return chosen.select("provider_name", "npi").orderBy("provider_name")


def total_paid_year(claims: DataFrame, year: int) -> DataFrame:
    return claims.filter(year_range("service_date", year)).agg(metric("total_paid").alias("total_paid"))


def avg_premium_tier(plans: DataFrame, tier: str) -> DataFrame:
    return plans.filter(F.col("metal_tier") == tier).agg(F.avg("monthly_premium").alias("avg_premium"))


def claim_type_submitted_year(claims: DataFrame, claim_type: str, year: int) -> DataFrame:
    return _count(claims.filter((F.col("claim_type") == claim_type) & year_range("submitted_date", year)))


def denial_rate_by_network(claims: DataFrame, providers: DataFrame) -> DataFrame:
    joined = claims.join(providers, "provider_id")
    return joined.groupBy("network_status").agg(metric("denial_rate").alias("denial_rate"))


def top_denial_reasons(claims: DataFrame, n: int) -> DataFrame:
    counts = claims.filter("status = 'denied'").groupBy("denial_reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "denial_reason").limit(n)


def paid_by_specialty_year(claims: DataFrame, providers: DataFrame, year: int) -> DataFrame:
    joined = claims.filter(year_range("service_date", year)).join(providers, "provider_id")
    return joined.groupBy("specialty").agg(metric("total_paid").alias("total_paid")).orderBy(F.desc("total_paid"))


def _with_dx(claims: DataFrame, diagnoses: DataFrame) -> DataFrame:
    return claims.join(diagnoses, F.col("primary_diagnosis_code") == F.col("code"))


def claims_by_dx_category(claims: DataFrame, diagnoses: DataFrame) -> DataFrame:
    counts = _with_dx(claims, diagnoses).groupBy("category").agg(F.count(F.lit(1)).alias("claims"))
    return counts.orderBy(F.desc("claims"))


def avg_billed_plan_type(claims: DataFrame, members: DataFrame, plans: DataFrame, plan_type: str) -> DataFrame:
    chosen = plans.filter(F.col("plan_type") == plan_type).select("plan_id")
    joined = claims.join(members.join(chosen, "plan_id"), "member_id")
    return joined.agg(F.avg("billed_amount").alias("avg_billed"))


def monthly_claims_year(claims: DataFrame, year: int) -> DataFrame:
    inside = claims.filter(year_range("service_date", year))
    month = F.date_format("service_date", "yyyy-MM").alias("month")
    return inside.groupBy(month).agg(F.count(F.lit(1)).alias("claims")).orderBy("month")


def top_providers_paid(claims: DataFrame, providers: DataFrame, n: int) -> DataFrame:
    """Payments are summed before the names join in, so the join sees one row per provider."""
    paid = claims.groupBy("provider_id").agg(metric("total_paid").alias("total_paid"))
    joined = paid.join(providers, "provider_id").select("provider_id", "provider_name", "total_paid")
    return joined.orderBy(F.desc("total_paid"), "provider_id").limit(n)


def units_by_proc_category(claim_lines: DataFrame, procedures: DataFrame, category: str) -> DataFrame:
    chosen = procedures.filter(F.col("category") == category)
    joined = claim_lines.join(chosen, F.col("procedure_code") == F.col("code"), "left_semi")
    return joined.agg(F.sum("units").alias("units"))


def submit_lag_by_type(claims: DataFrame) -> DataFrame:
    return claims.groupBy("claim_type").agg(metric("avg_days_to_submit").alias("avg_days"))


def denial_rate_state_tier(claims: DataFrame, members: DataFrame, plans: DataFrame, tier: str) -> DataFrame:
    chosen = members.join(plans.filter(F.col("metal_tier") == tier).select("plan_id"), "plan_id")
    joined = claims.join(chosen, "member_id")
    return joined.groupBy("state").agg(metric("denial_rate").alias("denial_rate")).orderBy(F.desc("denial_rate"))


def specialties_high_denial(claims: DataFrame, providers: DataFrame, percent: float) -> DataFrame:
    rates = claims.join(providers, "provider_id").groupBy("specialty").agg(metric("denial_rate").alias("denial_rate"))
    return rates.filter(F.col("denial_rate") > percent / 100.0).orderBy(F.desc("denial_rate"))


def members_many_claims(claims: DataFrame, k: int, year: int) -> DataFrame:
    per_member = claims.filter(year_range("service_date", year)).groupBy("member_id").agg(F.count(F.lit(1)).alias("c"))
    return _count(per_member.filter(F.col("c") > k))


def share_of_total(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Group total over the grand total of the same table."""
    total = df.agg(F.sum(value).alias("t"))
    return df.groupBy(*by).agg(F.sum(value).alias("_s")).select(*by, (F.col("_s") / total.scalar()).alias("share"))


def paid_share_dx_category(claims: DataFrame, diagnoses: DataFrame) -> DataFrame:
    total = claims.agg(F.sum("paid_amount").alias("t"))
    sums = _with_dx(claims, diagnoses).groupBy("category").agg(F.sum("paid_amount").alias("_s"))
    return sums.select("category", (F.col("_s") / total.scalar()).alias("share")).orderBy(F.desc("share"))


def top_procs_out_of_network(
    claim_lines: DataFrame, claims: DataFrame, providers: DataFrame, procedures: DataFrame, n: int
) -> DataFrame:
    outside = claims.join(
        providers.filter("network_status = 'out_of_network'").select("provider_id"), "provider_id", "left_semi"
    )
    billed = (
        claim_lines.join(outside.select("claim_id"), "claim_id", "left_semi")
        .groupBy(F.col("procedure_code").alias("code"))
        .agg(F.sum("line_billed").alias("billed"))
    )
    named = billed.join(procedures, "code").select("code", "description", "billed")
    return named.orderBy(F.desc("billed"), "code").limit(n)


def yoy_paid_plan_type(claims: DataFrame, members: DataFrame, plans: DataFrame, first: int, second: int) -> DataFrame:
    """Paid in two years side by side; sums per member come first, the plan joins in afterwards."""
    per_year = [
        F.sum(F.when(year_range("service_date", y), F.col("paid_amount")).otherwise(0.0)).alias(f"paid_{y}")
        for y in (first, second)
    ]
    per_member = claims.groupBy("member_id").agg(*per_year)
    joined = per_member.join(members, "member_id").join(plans, "plan_id")
    return joined.groupBy("plan_type").agg(*[F.sum(f"paid_{y}").alias(f"paid_{y}") for y in (first, second)])


def paid_ratio_type_network(claims: DataFrame, providers: DataFrame) -> DataFrame:
    joined = claims.join(providers, "provider_id")
    return joined.groupBy("claim_type", "network_status").agg(metric("paid_to_billed_ratio").alias("ratio"))


def stale_pending(claims: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    cut = as_of - dt.timedelta(days=days)
    return _count(claims.filter((F.col("status") == "pending") & (F.col("submitted_date") < F.lit(cut))))


def top_dx_paid_state(claims: DataFrame, members: DataFrame, diagnoses: DataFrame, state: str) -> DataFrame:
    local = members.filter(F.col("state") == state).select("member_id")
    paid = (
        claims.join(local, "member_id", "left_semi")
        .groupBy(F.col("primary_diagnosis_code").alias("code"))
        .agg(F.avg("paid_amount").alias("avg_paid"))
    )
    named = paid.join(diagnoses, "code").select("code", "description", "avg_paid")
    return named.orderBy(F.desc("avg_paid"), "code").limit(1)
