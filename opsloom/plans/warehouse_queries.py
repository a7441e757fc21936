"""The analytic questions over the star mapping, each with its SQL text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsloom.operators import warehouse as wh
from opsloom.plans.catalog import query
from opsloom.plans.mappings import STAR_SQL, star

TIER, PLAN, PROC, STATE, SPEC = "ECONOMY", "Brand#3", "Brand#7", "NATION_3", "spec_2"
DENIED = "avg(CASE WHEN status = 'denied' THEN 1.0 ELSE 0 END)"
AS_OF = dt.date(2002, 1, 1)


def _round(df, **digits):
    return df.withColumns({name: F.round(name, d) for name, d in digits.items()})


def _ask(name, sql, run):
    query(name, f"WITH {STAR_SQL} {sql}")(lambda spark, sf_dir: run(star(spark, sf_dir)))


_ask("count_by_status", "SELECT count(*) AS n FROM claims WHERE status = 'denied'", lambda t: wh.count_by_status(t["claims"], "denied"))
_ask("members_in_state", f"SELECT count(*) AS n FROM members WHERE state = '{STATE}'", lambda t: wh.members_in_state(t["members"], STATE))
_ask(
    "providers_by_specialty_state",
    f"SELECT provider_name, npi FROM providers WHERE specialty = '{SPEC}' AND state = '{STATE}' ORDER BY provider_name",
    lambda t: wh.providers_by_specialty_state(t["providers"], SPEC, STATE),
)
_ask(
    "total_paid_year",
    "SELECT round(sum(paid_amount), 2) AS total_paid FROM claims WHERE year(service_date) = 1997",
    lambda t: _round(wh.total_paid_year(t["claims"], 1997), total_paid=2),
)
_ask(
    "avg_premium_tier",
    f"SELECT round(avg(monthly_premium), 4) AS avg_premium FROM plans WHERE metal_tier = '{TIER}'",
    lambda t: _round(wh.avg_premium_tier(t["plans"], TIER), avg_premium=4),
)
_ask(
    "claim_type_submitted_year",
    "SELECT count(*) AS n FROM claims WHERE claim_type = '1-URGENT' AND year(submitted_date) = 1998",
    lambda t: wh.claim_type_submitted_year(t["claims"], "1-URGENT", 1998),
)
_ask(
    "denial_rate_by_network",
    f"SELECT network_status, round({DENIED}, 6) AS denial_rate FROM line_claims JOIN providers USING (provider_id) GROUP BY 1",
    lambda t: _round(wh.denial_rate_by_network(t["line_claims"], t["providers"]), denial_rate=6),
)
_ask(
    "top_denial_reasons",
    "SELECT denial_reason, count(*) AS n FROM claims WHERE status = 'denied' GROUP BY 1 ORDER BY n DESC, denial_reason LIMIT 3",
    lambda t: wh.top_denial_reasons(t["claims"], 3),
)
_ask(
    "paid_by_specialty_year",
    """SELECT specialty, round(sum(paid_amount), 2) AS total_paid FROM line_claims JOIN providers USING (provider_id)
    WHERE year(service_date) = 1999 GROUP BY 1""",
    lambda t: _round(wh.paid_by_specialty_year(t["line_claims"], t["providers"], 1999), total_paid=2),
)
_ask(
    "claims_by_dx_category",
    "SELECT category, count(*) AS claims FROM line_claims JOIN diagnoses ON code = primary_diagnosis_code GROUP BY 1",
    lambda t: wh.claims_by_dx_category(t["line_claims"], t["diagnoses"]),
)
_ask(
    "avg_billed_plan_type",
    f"""SELECT round(avg(billed_amount), 4) AS avg_billed FROM claims JOIN members USING (member_id) JOIN plans USING (plan_id)
    WHERE plan_type = '{PLAN}'""",
    lambda t: _round(wh.avg_billed_plan_type(t["claims"], t["members"], t["plans"], PLAN), avg_billed=4),
)
_ask(
    "monthly_claims_year",
    "SELECT strftime(service_date, '%Y-%m') AS month, count(*) AS claims FROM claims WHERE year(service_date) = 1997 GROUP BY 1",
    lambda t: wh.monthly_claims_year(t["claims"], 1997),
)
_ask(
    "top_providers_paid",
    """SELECT provider_id, provider_name, round(sum(paid_amount), 2) AS total_paid FROM line_claims JOIN providers USING (provider_id)
    GROUP BY ALL ORDER BY sum(paid_amount) DESC, provider_id LIMIT 10""",
    lambda t: _round(wh.top_providers_paid(t["line_claims"], t["providers"], 10), total_paid=2),
)
_ask(
    "units_by_proc_category",
    f"SELECT CAST(sum(units) AS BIGINT) AS units FROM claim_lines JOIN procedures ON code = procedure_code WHERE category = '{PROC}'",
    lambda t: wh.units_by_proc_category(t["claim_lines"], t["procedures"], PROC),
)
_ask(
    "submit_lag_by_type",
    "SELECT claim_type, round(avg(submitted_date - service_date), 6) AS avg_days FROM claims GROUP BY 1",
    lambda t: _round(wh.submit_lag_by_type(t["claims"]), avg_days=6),
)
_ask(
    "denial_rate_state_tier",
    f"""SELECT state, round({DENIED}, 6) AS denial_rate FROM claims JOIN members USING (member_id) JOIN plans USING (plan_id)
    WHERE metal_tier = '{TIER}' GROUP BY 1""",
    lambda t: _round(wh.denial_rate_state_tier(t["claims"], t["members"], t["plans"], TIER), denial_rate=6),
)
_ask(
    "specialties_high_denial",
    f"""SELECT specialty, round({DENIED}, 6) AS denial_rate FROM line_claims JOIN providers USING (provider_id)
    GROUP BY 1 HAVING {DENIED} > 33.4 / 100.0""",
    lambda t: _round(wh.specialties_high_denial(t["line_claims"], t["providers"], 33.4), denial_rate=6),
)
_ask(
    "members_many_claims",
    """SELECT count(*) AS n FROM (SELECT member_id FROM claims WHERE year(service_date) = 1997 GROUP BY 1 HAVING count(*) > 2)""",
    lambda t: wh.members_many_claims(t["claims"], 2, 1997),
)
_ask(
    "paid_share_dx_category",
    """SELECT category, round(sum(paid_amount) / (SELECT sum(paid_amount) FROM line_claims), 8) AS share FROM line_claims
    JOIN diagnoses ON code = primary_diagnosis_code GROUP BY 1""",
    lambda t: _round(wh.paid_share_dx_category(t["line_claims"], t["diagnoses"]), share=8),
)
_ask(
    "scalar_subquery_share",
    """SELECT claim_type, round(sum(billed_amount) / (SELECT sum(billed_amount) FROM claims), 8) AS share FROM claims GROUP BY 1""",
    lambda t: _round(wh.share_of_total(t["claims"], ["claim_type"], "billed_amount"), share=8),
)
_ask(
    "top_procs_out_of_network",
    """SELECT code, any_value(description) AS description, round(sum(line_billed), 2) AS billed FROM claim_lines
    JOIN procedures ON code = procedure_code WHERE claim_id IN (SELECT claim_id FROM line_claims JOIN providers USING (provider_id)
      WHERE network_status = 'out_of_network') GROUP BY code ORDER BY sum(line_billed) DESC, code LIMIT 10""",
    lambda t: _round(
        wh.top_procs_out_of_network(t["claim_lines"], t["line_claims"], t["providers"], t["procedures"], 10), billed=2
    ),
)
_ask(
    "yoy_paid_plan_type",
    """SELECT plan_type, round(sum(CASE WHEN year(service_date) = 1997 THEN paid_amount ELSE 0 END), 2) AS paid_1997,
    round(sum(CASE WHEN year(service_date) = 1998 THEN paid_amount ELSE 0 END), 2) AS paid_1998
    FROM claims JOIN members USING (member_id) JOIN plans USING (plan_id) GROUP BY 1""",
    lambda t: _round(
        wh.yoy_paid_plan_type(t["claims"], t["members"], t["plans"], 1997, 1998), paid_1997=2, paid_1998=2
    ),
)
_ask(
    "paid_ratio_type_network",
    """SELECT claim_type, network_status, round(sum(paid_amount) / sum(billed_amount), 8) AS ratio
    FROM line_claims JOIN providers USING (provider_id) GROUP BY ALL""",
    lambda t: _round(wh.paid_ratio_type_network(t["line_claims"], t["providers"]), ratio=8),
)
_ask(
    "stale_pending",
    "SELECT count(*) AS n FROM claims WHERE status = 'pending' AND DATE '2002-01-01' - submitted_date > 900",
    lambda t: wh.stale_pending(t["claims"], AS_OF, 900),
)
_ask(
    "top_dx_paid_state",
    f"""SELECT code, description, round(avg_paid, 4) AS avg_paid FROM (SELECT code, any_value(description) AS description,
      avg(l.paid_amount) AS avg_paid FROM line_claims l JOIN claims c USING (claim_id) JOIN members m ON m.member_id = c.member_id
      JOIN diagnoses ON code = primary_diagnosis_code WHERE m.state = '{STATE}' GROUP BY code) ORDER BY avg_paid DESC, code LIMIT 1""",
    lambda t: _round(
        wh.top_dx_paid_state(
            t["line_claims"].join(t["claims"].select("claim_id", "member_id"), "claim_id"), t["members"], t["diagnoses"], STATE
        ),
        avg_paid=4,
    ),
)
_ask(
    "star_join",
    """SELECT network_status, category, count(*) AS n, CAST(sum(units) AS BIGINT) AS units FROM claim_lines
    JOIN (SELECT DISTINCT claim_id, provider_id FROM line_claims) USING (claim_id) JOIN providers USING (provider_id)
    JOIN procedures ON code = procedure_code GROUP BY ALL""",
    lambda t: t["claim_lines"]
    .join(t["line_claims"].select("claim_id", "provider_id").distinct(), "claim_id")
    .join(t["providers"], "provider_id")
    .join(t["procedures"], F.col("code") == F.col("procedure_code"))
    .groupBy("network_status", "category")
    .agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units")),
)
_ask(
    "certified_metrics",
    f"""SELECT claim_type, round({DENIED}, 6) AS denial_rate, round(sum(paid_amount), 2) AS total_paid,
    round(sum(paid_amount) / sum(billed_amount), 8) AS paid_to_billed_ratio, round(avg(submitted_date - service_date), 6) AS avg_days_to_submit
    FROM claims GROUP BY 1""",
    lambda t: _round(
        wh.certified_metrics(t["claims"], ["claim_type"]),
        denial_rate=6, total_paid=2, paid_to_billed_ratio=8, avg_days_to_submit=6,
    ),
)
_ask(
    "date_ops",
    """SELECT claim_id, year(service_date) AS y, strftime(service_date, '%Y-%m') AS ym, CAST(submitted_date - service_date AS INTEGER) AS lag,
    CAST(year(submitted_date) - 1960 - CASE WHEN month(submitted_date) * 100 + day(submitted_date) < 229 THEN 1 ELSE 0 END AS INTEGER) AS age
    FROM claims""",
    lambda t: t["claims"].select(
        "claim_id",
        F.year("service_date").cast("bigint").alias("y"),
        F.date_format("service_date", "yyyy-MM").alias("ym"),
        F.datediff("submitted_date", "service_date").alias("lag"),
        wh_age(F.col("submitted_date")).alias("age"),
    ),
)


def wh_age(day):
    from opsloom.functions.scalar import age_on

    return age_on(F.lit(dt.date(1960, 2, 29)), day)
