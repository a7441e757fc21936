"""Claim audit queries: orders are claims, their lines claim lines, parts the code table."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.scalar import active_on, valid_npi
from opsloom.operators import claims as cl
from opsloom.operators import ledger as lg
from opsloom.plans.catalog import query
from opsloom.session import cut_lineage, never_broadcast
from opsloom.sources.tables import read_table


def _npi(number):
    """Ten digits with a valid check digit for a provider number."""
    base = F.concat(F.lit("1"), F.lpad(number.cast("string"), 8, "0"))
    digits = F.array(*[F.lit(str(d)) for d in range(10)])
    tail = F.filter(digits, lambda d: F.call_function("luhn_check", F.concat(F.lit("80840"), base, d)))[0]
    return F.concat(base, tail)


class Claims:
    """The claim tables of the mapping, built on demand."""

    def __init__(self, spark, sf_dir):
        self._read = lambda name: read_table(spark, sf_dir, name)

    def claims(self):
        c = F.col
        k = c("o_orderkey")
        good = _npi(c("o_custkey") % 150)
        last = F.pmod(F.substring(good, 10, 1).cast("int") + 1, F.lit(10)).cast("string")
        wrong = F.concat(F.substring(good, 1, 9), last)
        day = c("o_orderdate").cast("date")
        tag = lambda p, x: F.concat(F.lit(p), x.cast("string"))
        return self._read("orders").select(
            k.alias("claim_id"),
            c("o_custkey").alias("member_id"),
            F.when(c("o_custkey") % 37 == 0, wrong).otherwise(good).alias("provider_npi"),
            day.alias("service_date"),
            F.date_add(day, (k % 95).cast("int")).alias("submitted_date"),
            F.when(k % 11 == 0, "23").otherwise("11").alias("place_of_service"),
            F.array(tag("D", c("o_custkey") % 9), tag("D", k % 9)).alias("diagnosis_codes"),
            F.when(k % 2 == 0, tag("A", c("o_custkey"))).alias("prior_auth_number"),
            F.when(k % 5 == 0, tag("R", c("o_custkey"))).alias("referral_number"),
            F.when(k % 7 != 0, "Patient has stable   symptoms\non exam.").alias("clinical_note"),
            c("o_totalprice").alias("total_charge"),
        )

    def lines(self):
        """The first submission of each line number of an order.

        Dealt out by the order alone, so that what follows by claim, or by claim and line, finds its lines where they lie.
        """
        c = F.col
        picked = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
        submitted = self._read("lineitem").repartition("l_orderkey")
        first = submitted.groupBy("l_orderkey", "l_linenumber").agg(F.min(picked).alias("s"))
        return first.select(
            c("l_orderkey").alias("claim_id"),
            c("l_linenumber").alias("line_no"),
            F.concat(F.lit("P"), (c("s.l_partkey") % 200).cast("string")).alias("cpt"),
            c("s.l_quantity").cast("bigint").alias("units"),
            c("s.l_extendedprice").alias("charge"),
            F.when(c("s.l_tax") >= 0.07, F.array(F.lit("59"))).otherwise(F.array().cast("array<string>")).alias("modifiers"),
        )

    def codes(self):
        k = F.col("k")
        rows = (
            self._read("part")
            .groupBy((F.col("p_partkey") % 200).alias("k"))
            .agg(F.max("p_retailprice").alias("price"), F.max("p_size").alias("size"))
        )
        prefix = lambda x: F.concat(F.lit("D"), (x % 9).cast("string"))
        return rows.select(
            F.concat(F.lit("P"), k.cast("string")).alias("code"),
            (F.col("price") * 10).alias("ref_cost"),
            (F.col("size") % 40 + 5).cast("bigint").alias("mue"),
            (k % 10 == 0).alias("requires_auth"),
            F.when(k % 3 == 0, F.array(prefix(k), prefix(k + 1))).alias("necessity"),
            F.when(k % 6 == 0, "AEG-4.5").alias("policy"),
            F.when(k % 20 == 1, 40).alias("age_min"),
            F.when(k % 20 == 2, 30).alias("age_max"),
            (k % 25 == 3).alias("review_level"),
        )

    def members(self):
        k = F.col("c_custkey")
        date = lambda d, shift: F.date_add(F.lit(d).cast("date"), shift.cast("int"))
        return self._read("customer").filter("c_acctbal > -900").select(
            k.alias("member_id"),
            date("1940-01-01", k * 37 % 25000).alias("date_of_birth"),
            F.when(F.col("c_mktsegment") == "BUILDING", "HMO").otherwise("PPO").alias("plan_type"),
            date("1995-06-01", k % 300).alias("coverage_start"),
            F.when(k % 4 == 0, F.lit("1999-12-31").cast("date")).alias("coverage_end"),
        )

    def providers(self):
        return self._read("supplier").select(
            _npi(F.col("s_suppkey")).alias("npi"),
            F.col("s_name").alias("name"),
            F.when(F.col("s_acctbal") < 5000, "out_of_network").otherwise("in_network").alias("network"),
        )

    def auths(self):
        codes = F.sequence(F.lit(0), F.lit(190), F.lit(10))
        return self._read("customer").select(F.col("c_custkey").alias("member_id"), F.explode(codes).alias("k")).select(
            F.concat(F.lit("A"), F.col("member_id").cast("string")).alias("auth_number"),
            "member_id",
            F.concat(F.lit("P"), F.col("k").cast("string")).alias("cpt"),
            F.lit("1996-01-01").cast("date").alias("valid_from"),
            F.lit("1999-12-31").cast("date").alias("valid_to"),
        )

    def referrals(self):
        k = F.col("c_custkey")
        return self._read("customer").filter("c_custkey % 2 = 0").select(
            F.concat(F.lit("R"), k.cast("string")).alias("referral_number"), k.alias("member_id"), _npi(k % 150).alias("provider_npi")
        )

    def history(self):
        """Every line under its own claim, and once more under a resubmitted claim number for some."""
        c = F.col
        own = self.lines().select("claim_id", "cpt").join(
            never_broadcast(self.claims().select("claim_id", "member_id", "provider_npi", "service_date")), "claim_id"
        )
        again = own.filter("claim_id % 17 = 0").withColumn("claim_id", c("claim_id") + 100_000_000)
        return own.unionByName(again).withColumn("seq", c("claim_id"))

    def edits(self):
        k = F.col("k")
        return self._read("part").select((F.col("p_partkey") % 200).alias("k")).distinct().filter("k % 5 = 0").select(
            F.concat(F.lit("P"), k.cast("string")).alias("column1"),
            F.concat(F.lit("P"), (k + 1).cast("string")).alias("column2"),
            (k % 2 == 0).alias("modifier_allowed"),
        )

    def tables(self) -> cl.ClaimTables:
        return cl.ClaimTables(
            self.claims(), self.lines(), self.codes(), self.members(), self.providers(), self.auths(), self.referrals(),
            self.history(), self.edits(),
        )


def _npi_sql(number: str) -> str:
    base = f"'1' || lpad(CAST({number} AS VARCHAR), 8, '0')"
    digit = f"CAST(substr({base}, i, 1) AS INTEGER)"
    doubled = f"CASE WHEN i % 2 = 1 THEN CASE WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END ELSE {digit} END"
    return f"({base} || CAST((10 - (24 + list_sum(list_transform(range(1, 10), lambda i: {doubled}))) % 10) % 10 AS VARCHAR))"


CLAIMS_SQL = f"""
claims AS (SELECT o_orderkey AS claim_id, o_custkey AS member_id, CASE WHEN o_custkey % 37 = 0 THEN
    substr(n, 1, 9) || CAST((CAST(substr(n, 10, 1) AS INTEGER) + 1) % 10 AS VARCHAR) ELSE n END AS provider_npi,
    CAST(o_orderdate AS DATE) AS service_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 95 AS INTEGER) AS submitted_date,
    CASE WHEN o_orderkey % 11 = 0 THEN '23' ELSE '11' END AS place_of_service,
    ['D' || (o_custkey % 9), 'D' || (o_orderkey % 9)] AS diagnosis_codes,
    CASE WHEN o_orderkey % 2 = 0 THEN 'A' || o_custkey END AS prior_auth_number,
    CASE WHEN o_orderkey % 5 = 0 THEN 'R' || o_custkey END AS referral_number,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'patient has stable symptoms on exam.' END AS note, o_totalprice AS total_charge
  FROM (SELECT *, {_npi_sql('o_custkey % 150')} AS n FROM orders)),
lines AS (SELECT l_orderkey AS claim_id, l_linenumber AS line_no, 'P' || (l_partkey % 200) AS cpt, CAST(l_quantity AS BIGINT) AS units,
    l_extendedprice AS charge, l_tax >= 0.07 AS has_mod FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax) = 1),
codes AS (SELECT 'P' || k AS code, price * 10 AS ref_cost, size % 40 + 5 AS mue, k % 10 = 0 AS requires_auth,
    CASE WHEN k % 3 = 0 THEN ['D' || (k % 9), 'D' || ((k + 1) % 9)] END AS necessity, CASE WHEN k % 6 = 0 THEN 'AEG-4.5' END AS policy,
    CASE WHEN k % 20 = 1 THEN 40 END AS age_min, CASE WHEN k % 20 = 2 THEN 30 END AS age_max, k % 25 = 3 AS review_level
  FROM (SELECT p_partkey % 200 AS k, max(p_retailprice) AS price, max(p_size) AS size FROM part GROUP BY 1)),
members AS (SELECT c_custkey AS member_id, DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER) AS dob,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'HMO' ELSE 'PPO' END AS plan_type,
    DATE '1995-06-01' + CAST(c_custkey % 300 AS INTEGER) AS cs, CASE WHEN c_custkey % 4 = 0 THEN DATE '1999-12-31' END AS ce
  FROM customer WHERE c_acctbal > -900),
providers AS (SELECT {_npi_sql('s_suppkey')} AS npi, s_name AS name,
    CASE WHEN s_acctbal < 5000 THEN 'out_of_network' ELSE 'in_network' END AS network FROM supplier),
auths AS (SELECT 'A' || c_custkey AS auth_number, c_custkey AS member_id, 'P' || k AS cpt, DATE '1996-01-01' AS f, DATE '1999-12-31' AS t
  FROM (SELECT c_custkey, unnest(range(0, 200, 10)) AS k FROM customer)),
referrals AS (SELECT 'R' || c_custkey AS rn, c_custkey AS member_id, {_npi_sql('c_custkey % 150')} AS npi FROM customer WHERE c_custkey % 2 = 0),
own AS (SELECT l.claim_id, cpt, member_id, provider_npi, service_date FROM lines l JOIN claims c ON l.claim_id = c.claim_id),
history AS (SELECT * FROM own UNION ALL SELECT claim_id + 100000000, cpt, member_id, provider_npi, service_date FROM own WHERE claim_id % 17 = 0),
edits AS (SELECT DISTINCT 'P' || (p_partkey % 200) AS c1, 'P' || (p_partkey % 200 + 1) AS c2, p_partkey % 200 % 2 = 0 AS ok FROM part
  WHERE p_partkey % 200 % 5 = 0),
lf AS (SELECT l.*, c.member_id, c.provider_npi, service_date, place_of_service = '23' AS er, diagnosis_codes, prior_auth_number, k.*, m.dob
  FROM lines l JOIN claims c ON l.claim_id = c.claim_id LEFT JOIN codes k ON k.code = l.cpt LEFT JOIN members m ON m.member_id = c.member_id)"""

_AGE = """(year(service_date) - year(dob) - CASE WHEN month(service_date) * 100 + day(service_date) < month(dob) * 100 + day(dob)
  THEN 1 ELSE 0 END)"""
_NO_INT, _NO_TEXT = "CAST(NULL AS INTEGER)", "CAST(NULL AS VARCHAR)"


def _row(rule, severity, message, section, line=_NO_INT, reviewer=_NO_TEXT, units="CAST(NULL AS BIGINT)"):
    return (
        f"SELECT claim_id, {line} AS line_no, '{rule}' AS rule_id, {severity} AS severity, {message} AS message, "
        f"{section} AS policy_section, {reviewer} AS reviewer, {units} AS adjusted_units"
    )


RULE_SQL = {
    "R001": _row(
        "R001", "'hard'",
        """CASE WHEN m.member_id IS NULL THEN 'Member ' || c.member_id || ' not found.' ELSE 'Coverage not active on ' || service_date
        || ' (coverage ' || cs || ' to ' || coalesce(CAST(ce AS VARCHAR), 'open') || ').' END""", "'AEG-1.2'",
    )
    + " FROM claims c LEFT JOIN members m ON c.member_id = m.member_id WHERE m.member_id IS NULL OR service_date < cs OR service_date > ce",
    "R002": _row(
        "R002", "'hard'", "'Submitted ' || (submitted_date - service_date) || ' days after service; limit is 90.'", "'AEG-1.1'"
    )
    + " FROM claims WHERE submitted_date - service_date > 90",
    "R003": _row("R003", "'hard'", "cpt || ' duplicates line on claim ' || other || '.'", "'AEG-1.3'", "line_no")
    + """ FROM (SELECT f.claim_id, f.line_no, f.cpt, min(h.claim_id) AS other FROM lf f JOIN history h ON f.member_id = h.member_id
      AND f.provider_npi = h.provider_npi AND f.service_date = h.service_date AND f.cpt = h.cpt AND h.claim_id <> f.claim_id GROUP BY ALL)""",
    "R004": _row(
        "R004", "CASE WHEN er THEN 'soft' ELSE 'hard' END",
        """CASE WHEN er THEN cpt || ' performed in the ER without prior authorization; payable if an emergency condition is documented.'
        ELSE cpt || ' requires prior authorization; none valid for this member, code and date.' END""",
        "CASE WHEN er THEN 'AEG-3.2' ELSE 'AEG-3.1' END", "line_no", "CASE WHEN er THEN 'clinical' END",
    )
    + """ FROM lf WHERE requires_auth AND NOT EXISTS (SELECT 1 FROM auths a WHERE a.auth_number = lf.prior_auth_number
      AND a.member_id = lf.member_id AND a.cpt = lf.cpt AND lf.service_date BETWEEN a.f AND a.t)""",
    "R005": _row(
        "R005", "'soft'",
        """'No diagnosis on the claim (' || array_to_string(diagnosis_codes, ', ') || ') supports ' || cpt
        || '; payable only if documentation meets procedure-specific criteria.'""", "coalesce(policy, 'AEG-4.1')", "line_no", "'clinical'",
    )
    + """ FROM lf WHERE necessity IS NOT NULL AND len(list_filter(diagnosis_codes, lambda d:
      len(list_filter(necessity, lambda p: starts_with(d, p))) > 0)) = 0""",
    "R006": _row(
        "R006", "CASE WHEN ok AND has_mod THEN 'soft' ELSE 'hard' END",
        """CASE WHEN ok AND has_mod THEN cpt || ' billed with ' || c1 || ' using modifier 59/XS; payable only if a distinct procedural service is documented.'
        ELSE cpt || ' is a component of ' || c1 || ' at the same encounter (' || CASE WHEN NOT ok THEN 'edit does not allow a modifier'
        ELSE 'no 59/XS modifier' END || ').' END""", "'AEG-5.1'", "line_no", "CASE WHEN ok AND has_mod THEN 'coding' END",
    )
    + " FROM lines l JOIN edits ON cpt = c2 WHERE EXISTS (SELECT 1 FROM lines o WHERE o.claim_id = l.claim_id AND o.cpt = c1)",
    "R007": _row(
        "R007", "'hard'", "units || ' units of ' || cpt || ' exceed the daily maximum of ' || mue || '.'", "'AEG-5.2'", "line_no",
        units="CAST(mue AS BIGINT)",
    )
    + " FROM lf WHERE units > mue",
    "R008": _row(
        "R008", "'hard'",
        f"""cpt || ' is defined for ages ' || coalesce(age_min, 0) || '-' || coalesce(CAST(age_max AS VARCHAR), 'any')
        || '; member is ' || {_AGE} || '.'""", "'AEG-6.1'", "line_no",
    )
    + f" FROM lf WHERE {_AGE} < age_min OR {_AGE} > age_max",
    "R009": _row(
        "R009", "'hard'", "'HMO member seen by out-of-network provider ' || p.name || ' without a referral.'", "'AEG-2.1'"
    )
    + """ FROM claims c JOIN members m ON c.member_id = m.member_id JOIN providers p ON p.npi = c.provider_npi
      WHERE plan_type = 'HMO' AND network <> 'in_network' AND place_of_service <> '23' AND NOT EXISTS (SELECT 1 FROM referrals r
      WHERE r.rn = c.referral_number AND r.member_id = c.member_id AND r.npi = c.provider_npi)""",
    "R010": _row(
        "R010", "'soft'",
        "cpt || ' billed at $' || format('{:,.2f}', charge / units) || '/unit, more than 3x the $' || format('{:,.2f}', ref_cost) || ' reference.'",
        "'AEG-5.4'", "line_no", "'coding'",
    )
    + " FROM lf WHERE charge / units > 3.0 * ref_cost",
    "R011": _row("R011", "'soft'", "cpt || ' requires high-complexity medical decision making.'", "'AEG-5.3'", "line_no", "'coding'")
    + " FROM lf WHERE review_level",
    "R012": _row(
        "R012", "'hard'",
        """CASE WHEN member_id % 37 = 0 THEN 'NPI ' || provider_npi || ' fails check-digit validation.'
        ELSE 'NPI ' || provider_npi || ' is not an enrolled provider.' END""", "'AEG-1.4'",
    )
    + " FROM claims WHERE member_id % 37 = 0 OR provider_npi NOT IN (SELECT npi FROM providers)",
}
RULE_NAMES = {
    "R001": "r001_eligibility", "R002": "r002_timely_filing", "R003": "r003_duplicate_line", "R004": "r004_prior_auth",
    "R005": "r005_necessity", "R006": "r006_bundling", "R007": "r007_units", "R008": "r008_age", "R009": "r009_network",
    "R010": "r010_outlier", "R011": "r011_level", "R012": "r012_npi",
}


def _register_rule(rule_id: str) -> None:
    # Two prices of a message may differ in the last printed digit between engines, so R010 leaves it out.
    hide = " EXCLUDE (message)" if rule_id == "R010" else ""

    def run(spark, sf_dir):
        out = cl.evaluate_rules(Claims(spark, sf_dir).tables(), {rule_id})
        return out.drop("message") if hide else out

    query(RULE_NAMES[rule_id], f"WITH {CLAIMS_SQL} SELECT *{hide} FROM ({RULE_SQL[rule_id]})")(run)


for _rule_id in RULE_NAMES:
    _register_rule(_rule_id)

FINDINGS_SQL = CLAIMS_SQL + ", findings AS (" + " UNION ALL ".join(RULE_SQL.values()) + ")"


@query(
    "evaluate_rules",
    f"WITH {FINDINGS_SQL} SELECT rule_id, severity, policy_section, coalesce(reviewer, '-') AS reviewer, count(*) AS n, CAST(sum(adjusted_units) AS BIGINT) AS units FROM findings GROUP BY ALL",
)
def evaluate_rules(spark, sf_dir):
    found = cl.evaluate_rules(Claims(spark, sf_dir).tables())
    return found.groupBy("rule_id", "severity", "policy_section", F.coalesce("reviewer", F.lit("-")).alias("reviewer")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("adjusted_units").alias("units")
    )


ROUTED_SQL = (
    FINDINGS_SQL
    + """, routed AS (SELECT * FROM findings f WHERE severity = 'soft'
  AND NOT EXISTS (SELECT 1 FROM findings h WHERE h.claim_id = f.claim_id AND h.line_no IS NULL AND h.severity = 'hard')
  AND NOT EXISTS (SELECT 1 FROM findings h WHERE h.claim_id = f.claim_id AND h.line_no = f.line_no AND h.severity = 'hard' AND h.adjusted_units IS NULL))"""
)


@query(
    "review_routing",
    f"WITH {ROUTED_SQL} SELECT claim_id, line_no, rule_id, reviewer FROM routed",
)
def review_routing(spark, sf_dir):
    routed = cl.review_routing(cut_lineage(cl.evaluate_rules(Claims(spark, sf_dir).tables())))
    return routed.select("claim_id", "line_no", "rule_id", "reviewer")


def proposals(routed):
    """What a reviewer might answer, spread over all shapes by the claim number."""
    k = F.col("claim_id")
    resolution = F.element_at(F.array(F.lit("override"), F.lit("uphold"), F.lit("escalate")), (k % 3 + 1).cast("int"))
    base = routed.filter(k % 13 != 0).select(
        "claim_id",
        "rule_id",
        "line_no",
        resolution.alias("resolution"),
        (0.6 + k % 5 * 0.1).alias("confidence"),
        F.lit("checked").alias("rationale"),
        F.array(F.when(k % 4 == 0, F.lit("AEG-0.0")).otherwise(F.col("policy_section"))).alias("policy_citations"),
        F.array(F.when(k % 5 == 0, F.lit("not in the note")).otherwise(F.lit("Stable symptoms"))).alias("evidence_quotes"),
        F.when(k % 19 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"),
    )
    return base.withColumn("seq", F.explode("copies")).drop("copies")


REVIEWS_SQL = (
    ROUTED_SQL
    + """, reviews AS (SELECT r.claim_id, rule_id, line_no, r.reviewer, CASE WHEN r.claim_id % 13 = 0 THEN 0.0 ELSE 0.6 + r.claim_id % 5 * 0.1 END AS confidence,
    CASE WHEN r.claim_id % 13 = 0 THEN 1 ELSE (r.claim_id % 5 = 0 OR note IS NULL)::INT + (r.claim_id % 4 = 0)::INT + (r.claim_id % 19 = 0)::INT
      + (r.claim_id % 3 = 0 AND note IS NULL)::INT + (r.claim_id % 3 = 0 AND (note IS NULL OR r.claim_id % 5 = 0))::INT
      + (r.claim_id % 3 = 0 AND r.claim_id % 4 = 0)::INT END AS errors
  FROM routed r JOIN claims c ON r.claim_id = c.claim_id),
rv AS (SELECT *, CASE WHEN claim_id % 13 = 0 THEN 'escalate' WHEN claim_id % 3 = 0 THEN CASE WHEN errors > 0 THEN 'escalate' ELSE 'override' END
  WHEN claim_id % 3 = 1 THEN 'uphold' ELSE 'escalate' END AS resolution FROM reviews)"""
)


def _sections(routed):
    return routed.select(F.col("policy_section").alias("section_id")).distinct()


def _reviewed(spark, sf_dir):
    t = Claims(spark, sf_dir)
    findings = cut_lineage(cl.evaluate_rules(t.tables()))
    routed = cut_lineage(cl.review_routing(findings))
    return t, findings, cl.validate_reviews(routed, proposals(routed), t.claims(), _sections(findings))


@query(
    "validate_reviews",
    f"WITH {REVIEWS_SQL} SELECT claim_id, rule_id, line_no, resolution, round(CAST(confidence AS DOUBLE), 2) AS confidence, errors FROM rv",
)
def validate_reviews(spark, sf_dir):
    return _reviewed(spark, sf_dir)[2].select(
        "claim_id", "rule_id", "line_no", "resolution", F.round("confidence", 2).alias("confidence"),
        F.size("validation_errors").alias("errors"),
    )


DECISIONS_SQL = (
    REVIEWS_SQL
    + """, vd AS (SELECT claim_id, line_no, CASE WHEN resolution = 'escalate' THEN 'review' WHEN resolution = 'override' THEN
    CASE WHEN round(CAST(confidence AS DOUBLE), 6) >= 0.8 AND errors = 0 THEN 'pay' ELSE 'review' END
    ELSE CASE WHEN round(CAST(confidence AS DOUBLE), 6) >= 0.7 THEN 'deny' ELSE 'review' END END AS v FROM rv),
ch AS (SELECT DISTINCT claim_id FROM findings WHERE line_no IS NULL AND severity = 'hard'),
ld AS (SELECT l.claim_id, l.line_no, l.cpt, l.units, l.charge, l.claim_id IN (SELECT claim_id FROM ch) AS whole,
    coalesce((SELECT bool_or(severity = 'hard' AND adjusted_units IS NULL) FROM findings f WHERE f.claim_id = l.claim_id AND f.line_no = l.line_no), false) AS hd,
    (SELECT min(adjusted_units) FROM findings f WHERE f.claim_id = l.claim_id AND f.line_no = l.line_no AND severity = 'hard') AS cap,
    coalesce((SELECT bool_or(v = 'deny') FROM vd WHERE vd.claim_id = l.claim_id AND vd.line_no = l.line_no), false) AS sd,
    coalesce((SELECT bool_or(v = 'review') FROM vd WHERE vd.claim_id = l.claim_id AND vd.line_no = l.line_no), false) AS sr FROM lines l),
decisions AS (SELECT claim_id, line_no, cpt, charge, CASE WHEN whole OR hd OR sd THEN 'deny' WHEN sr THEN 'review'
    WHEN cap < units THEN 'adjust' ELSE 'pay' END AS outcome,
    CAST(CASE WHEN whole OR hd OR sd THEN 0 ELSE least(units, coalesce(cap, units)) END AS BIGINT) AS allowed_units FROM ld),
outcomes AS (SELECT claim_id, CASE WHEN bool_or(outcome = 'review') THEN 'pended_for_review' WHEN bool_and(outcome = 'deny') THEN 'denied'
    WHEN bool_and(outcome = 'pay') THEN 'approved' ELSE 'partially_approved' END AS outcome FROM decisions GROUP BY 1)"""
)


def decided(spark, sf_dir):
    t, findings, reviews = _reviewed(spark, sf_dir)
    return cl.adjudicate(t.lines(), findings, reviews)


@query("adjudicate", f"WITH {DECISIONS_SQL} SELECT claim_id, line_no, cpt, outcome, allowed_units FROM decisions")
def adjudicate(spark, sf_dir):
    return decided(spark, sf_dir).select("claim_id", "line_no", "cpt", "outcome", "allowed_units")


@query("claim_outcome", f"WITH {DECISIONS_SQL} SELECT claim_id, outcome FROM outcomes")
def claim_outcome(spark, sf_dir):
    return cl.claim_outcome(decided(spark, sf_dir))


def human_decisions(decisions):
    """Humans settle the pending lines of two claims in three; every fifth claim is left incomplete."""
    pending = decisions.filter("outcome = 'review' AND claim_id % 3 <> 2")
    answer = F.when(F.col("line_no") % 2 == 0, "pay").otherwise("deny")
    return pending.filter("NOT (claim_id % 5 = 0 AND line_no % 2 = 0)").select(
        "claim_id", "line_no", answer.alias("outcome"), F.lit("kim").alias("reviewer"), F.lit("seen").alias("note")
    )


@query(
    "apply_human_decisions",
    f"""WITH {DECISIONS_SQL}, h AS (SELECT claim_id, line_no, CASE WHEN line_no % 2 = 0 THEN 'pay' ELSE 'deny' END AS o FROM decisions
      WHERE outcome = 'review' AND claim_id % 3 <> 2 AND NOT (claim_id % 5 = 0 AND line_no % 2 = 0)),
    bad AS (SELECT DISTINCT d.claim_id FROM decisions d WHERE outcome = 'review' AND d.claim_id IN (SELECT claim_id FROM h)
      AND NOT EXISTS (SELECT 1 FROM h WHERE h.claim_id = d.claim_id AND h.line_no = d.line_no)),
    v AS (SELECT * FROM h WHERE claim_id NOT IN (SELECT claim_id FROM bad))
    SELECT d.claim_id, d.line_no, coalesce(v.o, outcome) AS outcome, CAST(CASE WHEN v.o = 'deny' THEN 0 ELSE allowed_units END AS BIGINT) AS allowed_units,
    d.claim_id IN (SELECT claim_id FROM bad) AS rejected FROM decisions d LEFT JOIN v ON v.claim_id = d.claim_id AND v.line_no = d.line_no""",
)
def apply_human_decisions(spark, sf_dir):
    decisions = cut_lineage(decided(spark, sf_dir))
    final, problems = cl.apply_human_decisions(decisions, human_decisions(decisions))
    flagged = problems.select("claim_id").distinct().withColumn("rejected", F.lit(True))
    return final.join(never_broadcast(flagged), "claim_id", "left").select(
        "claim_id", "line_no", "outcome", "allowed_units", F.coalesce("rejected", F.lit(False)).alias("rejected")
    )


@query(
    "decision_summary",
    f"""WITH {DECISIONS_SQL} SELECT claim_id, 'Claim ' || claim_id || ': ' || replace(any_value(o.outcome), '_', ' ') || '. ' ||
    string_agg('line ' || line_no || ' ' || cpt || ': ' || d.outcome || CASE WHEN d.outcome = 'adjust' THEN ', ' || allowed_units || ' unit(s) allowed' ELSE '' END,
      '; ' ORDER BY line_no) AS summary FROM decisions d JOIN outcomes o USING (claim_id) GROUP BY claim_id""",
)
def decision_summary(spark, sf_dir):
    """Without the reasons, whose wording the rule queries compare."""
    bare = decided(spark, sf_dir).withColumn("reasons", F.array().cast("array<string>"))
    return cl.decision_summary(bare)


@query(
    "intake_checks",
    f"""WITH {CLAIMS_SQL}, s AS (SELECT claim_id, round(sum(charge), 2) AS total, count(*) FILTER (cpt NOT IN (SELECT code FROM codes WHERE ref_cost > 9500)) AS bad FROM lines GROUP BY 1)
    SELECT c.claim_id, CAST((abs(coalesce(total, 0) - total_charge) > 0.01)::INT + (member_id % 37 = 0)::INT
      + (member_id NOT IN (SELECT member_id FROM members))::INT + (coalesce(bad, 0) > 0)::INT
      + (list_contains(diagnosis_codes, 'D8'))::INT AS INTEGER) AS issues FROM claims c LEFT JOIN s ON s.claim_id = c.claim_id""",
)
def intake_checks(spark, sf_dir):
    t = Claims(spark, sf_dir)
    known = t.codes().filter("ref_cost > 9500")
    diagnoses = t.claims().select(F.explode("diagnosis_codes").alias("code")).distinct().filter("code <> 'D8'")
    out = cl.intake_checks(t.claims(), t.lines(), t.members(), known, diagnoses)
    return out.select("claim_id", F.size("issues").alias("issues"))


@query(
    "active_on",
    f"WITH {CLAIMS_SQL} SELECT claim_id, service_date >= cs AND (ce IS NULL OR service_date <= ce) AS active FROM claims JOIN members USING (member_id)",
)
def active_on_query(spark, sf_dir):
    t = Claims(spark, sf_dir)
    joined = t.claims().join(t.members(), "member_id")
    active = active_on(F.col("service_date"), F.col("coverage_start"), F.col("coverage_end"))
    return joined.select("claim_id", active.alias("active"))


@query(
    "interval_lookup_join",
    f"""WITH {CLAIMS_SQL} SELECT claim_id, line_no, EXISTS (SELECT 1 FROM auths a WHERE a.auth_number = lf.prior_auth_number
    AND a.member_id = lf.member_id AND a.cpt = lf.cpt AND lf.service_date BETWEEN a.f AND a.t) AS authorized FROM lf WHERE requires_auth""",
)
def interval_lookup_join(spark, sf_dir):
    tables = Claims(spark, sf_dir).tables()
    missing = cl.prior_auth(tables).select("claim_id", "line_no", F.lit(False).alias("ok"))
    needed = cl.line_facts(tables).filter("requires_auth").select("claim_id", "line_no")
    return needed.join(never_broadcast(missing), ["claim_id", "line_no"], "left").select(
        "claim_id", "line_no", F.coalesce("ok", F.lit(True)).alias("authorized")
    )


@query(
    "exists_join",
    f"""WITH {CLAIMS_SQL} SELECT claim_id FROM claims c WHERE EXISTS (SELECT 1 FROM referrals r WHERE r.rn = c.referral_number
    AND r.member_id = c.member_id AND r.npi = c.provider_npi)""",
)
def exists_join(spark, sf_dir):
    t = Claims(spark, sf_dir)
    keys = ["referral_number", "member_id", "provider_npi"]
    return t.claims().join(t.referrals(), keys, "left_semi").select("claim_id")


def _events(decisions):
    """Two ledger events per claim: the decision, and a human one where the claim was pended and is odd."""
    outcome = cut_lineage(cl.claim_outcome(decisions))
    body = lambda *kv: F.to_json(F.create_map(*kv))
    ts = F.concat(F.lit("1999-01-01T00:00:"), F.lpad((F.col("claim_id") % 60).cast("string"), 2, "0"))
    first = outcome.select(
        F.lit(1).alias("seq_in"), ts.alias("ts"), F.col("claim_id").cast("string").alias("claim_id"), F.lit("rules").alias("actor"),
        F.lit("adjudicated").alias("event"), body(F.lit("outcome"), F.col("outcome")).alias("payload"),
    )
    human = outcome.filter("outcome = 'pended_for_review' AND claim_id % 2 = 1").select(
        F.lit(2).alias("seq_in"), ts.alias("ts"), F.col("claim_id").cast("string").alias("claim_id"), F.lit("kim").alias("actor"),
        F.lit("human_decision").alias("event"), body(F.lit("line"), F.lit("1")).alias("payload"),
    )
    return first.unionByName(human)


LEDGER_SQL = (
    DECISIONS_SQL
    + f""", ev AS (SELECT claim_id, '1999-01-01T00:00:' || lpad(CAST(claim_id % 60 AS VARCHAR), 2, '0') AS ts, outcome FROM outcomes),
e1 AS (SELECT 1 AS seq, *, sha256('64:{lg.GENESIS}' || strlen(ts) || ':' || ts || length(CAST(claim_id AS VARCHAR)) || ':' || claim_id || '5:rules'
  || '11:adjudicated' || (strlen(outcome) + 14) || ':{{"outcome":"' || outcome || '"}}') AS hash FROM ev),
e2 AS (SELECT 2 AS seq, claim_id, ts, outcome, sha256('64:' || hash || strlen(ts) || ':' || ts || length(CAST(claim_id AS VARCHAR)) || ':' || claim_id
  || '3:kim' || '14:human_decision' || '12:{{"line":"1"}}') AS hash FROM e1 WHERE outcome = 'pended_for_review' AND claim_id % 2 = 1),
ledger AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2)"""
)


def _ledger(spark, sf_dir):
    return lg.append_events(_events(decided(spark, sf_dir)))


@query(
    "ledger_append",
    f"WITH {LEDGER_SQL} SELECT CAST(claim_id AS VARCHAR) AS claim_id, CAST(seq AS BIGINT) AS seq, hash FROM ledger",
)
def ledger_append(spark, sf_dir):
    return _ledger(spark, sf_dir).select("claim_id", "seq", "hash")


@query(
    "chain_verify",
    f"""WITH {LEDGER_SQL} SELECT CAST(claim_id AS VARCHAR) AS claim_id, claim_id % 23 <> 0 AS ok,
    CASE WHEN claim_id % 23 = 0 THEN CAST(1 AS BIGINT) END AS first_bad_seq FROM e1""",
)
def chain_verify(spark, sf_dir):
    """Verification after the first event of every 23rd claim was tampered with."""
    tampered = F.when(
        (F.col("claim_id").cast("bigint") % 23 == 0) & (F.col("seq") == 1), F.lit('{"outcome":"forged"}')
    ).otherwise(F.col("payload"))
    return lg.verify_chains(_ledger(spark, sf_dir).withColumn("payload", tampered))


SEAL_SQL = (
    LEDGER_SQL
    + """, tails AS (SELECT claim_id, max(seq) AS seq, max_by(hash, seq) AS hash FROM ledger GROUP BY 1),
leaves AS (SELECT sha256(CAST(claim_id AS VARCHAR)) AS name,
  sha256(length(CAST(claim_id AS VARCHAR)) || ':' || claim_id || '1:' || seq || '64:' || hash) AS hash FROM tails),
n2 AS (SELECT left(name, 2) AS name, sha256(string_agg('64:' || name || '64:' || hash, '' ORDER BY name)) AS hash FROM leaves GROUP BY 1),
n1 AS (SELECT left(name, 1) AS name, sha256(string_agg('2:' || name || '64:' || hash, '' ORDER BY name)) AS hash FROM n2 GROUP BY 1),
n0 AS (SELECT '' AS name, sha256(string_agg('1:' || name || '64:' || hash, '' ORDER BY name)) AS hash FROM n1)"""
)


@query("ledger_seal", f"WITH {SEAL_SQL} SELECT 2 AS level, name AS prefix, hash FROM n2 UNION ALL SELECT 1, name, hash FROM n1 UNION ALL SELECT 0, name, hash FROM n0")
def ledger_seal(spark, sf_dir):
    """The Merkle tree over all chains, two hex digits deep."""
    return lg.seal(cut_lineage(lg.chain_tails(_ledger(spark, sf_dir))), 2)


@query(
    "ledger_removed",
    f"""WITH {LEDGER_SQL} SELECT CAST(claim_id AS VARCHAR) AS chain, CASE WHEN claim_id % 17 = 0 THEN 'missing' ELSE 'cut' END AS state FROM ledger
    WHERE claim_id % 17 = 0 OR (seq = 2 AND claim_id % 13 = 0) GROUP BY claim_id""",
)
def ledger_removed(spark, sf_dir):
    """A ledger is sealed; then every 17th claim and the second event of every 13th are taken away."""
    rows = cut_lineage(_ledger(spark, sf_dir))
    sealed = cut_lineage(lg.chain_tails(rows))
    number = F.col("claim_id").cast("bigint")
    left = rows.filter((number % 17 != 0) & ~((F.col("seq") == 2) & (number % 13 == 0)))
    return lg.check_against_seal(left, sealed)


@query(
    "pending_review_queue",
    f"""WITH {DECISIONS_SQL} SELECT CAST(claim_id AS VARCHAR) AS claim_id FROM outcomes WHERE outcome = 'pended_for_review' AND claim_id % 2 = 0""",
)
def pending_review_queue(spark, sf_dir):
    return lg.pending_claims(_events(decided(spark, sf_dir)))


@query(
    "audit_trail",
    f"""WITH {LEDGER_SQL} SELECT CAST(claim_id AS VARCHAR) AS claim_id, CAST(seq AS BIGINT) AS seq, true AS ok FROM ledger
    WHERE outcome = 'pended_for_review'""",
)
def audit_trail(spark, sf_dir):
    rows = cut_lineage(_ledger(spark, sf_dir))
    wanted = rows.filter(F.get_json_object("payload", "$.outcome") == "pended_for_review").select("claim_id")
    return lg.audit_trail(rows, wanted).select("claim_id", "seq", "ok")
