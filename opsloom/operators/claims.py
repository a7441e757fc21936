"""Claim rules, adjudication and review handling.

Rules come in three shapes: a column over the claim facts, a column over the line facts, or a whole
DataFrame for the rules that need a join of their own. All column rules of one shape run in a
single pass; register more with `claim_rule`, `line_rule` or `table_rule`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.scalar import active_on, age_on, valid_npi
from opsloom.functions.text import normalize_space, verbatim_quote
from opsloom.session import never_broadcast

# Limits of the claim rules.
TIMELY_FILING_DAYS = 90
OUTLIER_MULTIPLE = 3.0
EMERGENCY_PLACES = ("23",)
DISTINCT_MODIFIERS = ("59", "XS")
OVERRIDE_CONFIDENCE = 0.80
UPHOLD_CONFIDENCE = 0.70


@dataclass(frozen=True)
class ClaimTables:
    claims: DataFrame  # claim_id, member_id, provider_npi, service_date, submitted_date, place_of_service, ...
    lines: DataFrame  # claim_id, line_no, cpt, units, charge, modifiers
    codes: DataFrame  # code, ref_cost, mue, requires_auth, necessity, policy, age_min, age_max, review_level
    members: DataFrame  # member_id, date_of_birth, plan_type, coverage_start, coverage_end
    providers: DataFrame  # npi, name, network
    auths: DataFrame  # auth_number, member_id, cpt, valid_from, valid_to
    referrals: DataFrame  # referral_number, member_id, provider_npi
    history: DataFrame  # member_id, provider_npi, service_date, cpt, claim_id, seq
    edits: DataFrame  # column1, column2, modifier_allowed


FINDING = (
    "struct<rule_id:string,severity:string,message:string,policy_section:string,reviewer:string,adjusted_units:bigint>"
)
FINDING_COLUMNS = [
    "claim_id", "line_no", "rule_id", "severity", "message", "policy_section", "reviewer", "adjusted_units",
]


def finding(
    rule_id: str, severity: str, message: Column, section: Column | str, reviewer: str | None = None, units: Column | None = None
) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        (F.lit(section) if isinstance(section, str) else section).alias("policy_section"),
        F.lit(reviewer).cast("string").alias("reviewer"),
        (units if units is not None else F.lit(None)).cast("bigint").alias("adjusted_units"),
    )


def say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@dataclass
class Rules:
    """The registry: rule id to title and the function that finds violations."""

    titles: dict[str, str] = field(default_factory=dict)
    claim: dict[str, Callable[[], Column]] = field(default_factory=dict)
    line: dict[str, Callable[[], Column]] = field(default_factory=dict)
    table: dict[str, Callable[[ClaimTables], DataFrame]] = field(default_factory=dict)

    def add(self, kind: str, rule_id: str, title: str):
        def register(fn):
            self.titles[rule_id] = title
            getattr(self, kind)[rule_id] = fn
            return fn

        return register


RULES = Rules()


def claim_rule(rule_id: str, title: str):
    return RULES.add("claim", rule_id, title)


def line_rule(rule_id: str, title: str):
    return RULES.add("line", rule_id, title)


def table_rule(rule_id: str, title: str):
    return RULES.add("table", rule_id, title)


def claim_facts(t: ClaimTables) -> DataFrame:
    """Claims with what the member and provider tables say about them."""
    members = t.members.select(
        "member_id",
        F.lit(True).alias("member_known"),
        "date_of_birth",
        "plan_type",
        "coverage_start",
        "coverage_end",
    )
    providers = t.providers.select(
        F.col("npi").alias("provider_npi"), F.lit(True).alias("provider_known"), F.col("name").alias("provider_name"), "network"
    )
    return (
        t.claims.join(never_broadcast(members), "member_id", "left")
        .join(never_broadcast(providers), "provider_npi", "left")
        .withColumn("is_emergency", F.coalesce(F.col("place_of_service").isin(*EMERGENCY_PLACES), F.lit(False)))
    )


def line_facts(t: ClaimTables) -> DataFrame:
    """Lines with their claim, code and member facts."""
    codes = t.codes.withColumn("code_known", F.lit(True)).withColumnRenamed("code", "cpt")
    wanted = ["claim_id", "member_id", "provider_npi", "service_date", "place_of_service", "diagnosis_codes"]
    claims = t.claims.select(*wanted, "prior_auth_number")
    births = t.members.select("member_id", F.lit(True).alias("member_known"), "date_of_birth")
    # Members meet claims, which are fewer than lines; the codes first, so that a filter on them comes before the claims.
    claims = claims.join(never_broadcast(births), "member_id", "left")
    return (
        t.lines.join(codes, "cpt", "left")
        .join(never_broadcast(claims), "claim_id")
        .withColumn("is_emergency", F.coalesce(F.col("place_of_service").isin(*EMERGENCY_PLACES), F.lit(False)))
    )


@claim_rule("R001", "Member eligibility")
def eligibility() -> Column:
    c = F.col
    unknown = finding("R001", "hard", say("Member ", c("member_id"), " not found."), "AEG-1.2")
    period = say(
        "Coverage not active on ", c("service_date"), " (coverage ", c("coverage_start"), " to ",
        F.coalesce(c("coverage_end").cast("string"), F.lit("open")), ").",
    )
    covered = active_on(c("service_date"), c("coverage_start"), c("coverage_end"))
    return F.when(c("member_known").isNull(), unknown).when(~covered, finding("R001", "hard", period, "AEG-1.2"))


@claim_rule("R002", "Timely filing")
def timely_filing() -> Column:
    days = F.datediff("submitted_date", "service_date")
    text = say("Submitted ", days, f" days after service; limit is {TIMELY_FILING_DAYS}.")
    return F.when(days > TIMELY_FILING_DAYS, finding("R002", "hard", text, "AEG-1.1"))


@table_rule("R003", "Duplicate claim line")
def duplicates(t: ClaimTables) -> DataFrame:
    """One finding per line with an earlier-known line of another claim on the same key.

    Only the first two claims of each key are kept: the first one that is not the line's own is
    among them.
    """
    keys = ["member_id", "provider_npi", "service_date", "cpt"]
    # All that follows goes by the key, so the history is dealt out once; a key with nulls meets no line.
    per_claim = t.history.select(*keys, "claim_id", "seq").dropna(subset=keys).repartition(*keys).groupBy(*keys, F.col("claim_id").alias("other")).agg(
        F.min("seq").alias("seq")
    )
    order = Window.partitionBy(*keys).orderBy("seq", "other")
    known = (
        per_claim.withColumn("_n", F.row_number().over(order))
        .filter("_n <= 2")
        .groupBy(*keys)
        .agg(F.min_by("other", "_n").alias("_first"), F.max(F.when(F.col("_n") == 2, F.col("other"))).alias("_second"))
    )
    lines = t.lines.select("claim_id", "line_no", "cpt").join(
        never_broadcast(t.claims.select("claim_id", "member_id", "provider_npi", "service_date")), "claim_id"
    )
    # A key whose first claim has no number tells no other claim.
    other = F.when(F.col("_first") != F.col("claim_id"), F.col("_first")).when(F.col("_first").isNotNull(), F.col("_second"))
    hit = lines.join(never_broadcast(known), keys).withColumn("other", other).filter("other IS NOT NULL")
    text = say(F.col("cpt"), " duplicates line on claim ", F.col("other"), ".")
    return _rows(hit, "line_no", finding("R003", "hard", text, "AEG-1.3"))


@table_rule("R004", "Prior authorization")
def prior_auth(t: ClaimTables) -> DataFrame:
    needed = line_facts(t).filter("requires_auth")
    # Authorizations grow with the members, several each.
    auths = never_broadcast(
        t.auths.select(F.col("auth_number").alias("prior_auth_number"), "member_id", "cpt", "valid_from", "valid_to")
    ).alias("a")
    lines = needed.alias("l")
    match = [F.col(f"l.{k}") == F.col(f"a.{k}") for k in ("prior_auth_number", "member_id", "cpt")]
    match.append(F.col("l.service_date").between(F.col("a.valid_from"), F.col("a.valid_to")))
    missing = lines.join(auths, match, "left_anti")
    urgent = say(
        F.col("cpt"), " performed in the ER without prior authorization; payable if an emergency condition is documented."
    )
    plain = say(F.col("cpt"), " requires prior authorization; none valid for this member, code and date.")
    found = F.when(F.col("is_emergency"), finding("R004", "soft", urgent, "AEG-3.2", "clinical")).otherwise(
        finding("R004", "hard", plain, "AEG-3.1")
    )
    return _rows(missing, "line_no", found)


@line_rule("R005", "Medical necessity (diagnosis support)")
def medical_necessity() -> Column:
    supported = F.exists(
        "diagnosis_codes", lambda dx: F.exists("necessity", lambda prefix: F.startswith(dx, prefix))
    )
    text = say(
        "No diagnosis on the claim (", F.array_join("diagnosis_codes", ", "), ") supports ", F.col("cpt"),
        "; payable only if documentation meets procedure-specific criteria.",
    )
    needs = F.coalesce(F.size("necessity"), F.lit(0)) > 0
    section = F.coalesce("policy", F.lit("AEG-4.1"))
    return F.when(needs & ~F.coalesce(supported, F.lit(False)), finding("R005", "soft", text, section, "clinical"))


@table_rule("R006", "Procedure-to-procedure (bundling) edit")
def bundling(t: ClaimTables) -> DataFrame:
    """A component line whose comprehensive code is anywhere on the claim.

    The comprehensive side is only tested for existence: a claim's codes are one set, and lines are never paired.
    """
    candidates = t.lines.join(t.edits, F.col("cpt") == F.col("column2"))
    present = t.lines.groupBy("claim_id").agg(F.collect_set("cpt").alias("_present"))
    hit = candidates.join(never_broadcast(present), "claim_id").filter(F.array_contains("_present", F.col("column1")))
    distinct = F.arrays_overlap("modifiers", F.array(*[F.lit(m) for m in DISTINCT_MODIFIERS]))
    soft = say(
        F.col("cpt"), " billed with ", F.col("column1"),
        " using modifier 59/XS; payable only if a distinct procedural service is documented.",
    )
    reason = F.when(~F.col("modifier_allowed"), "edit does not allow a modifier").otherwise("no 59/XS modifier")
    hard = say(F.col("cpt"), " is a component of ", F.col("column1"), " at the same encounter (", reason, ").")
    allowed = F.col("modifier_allowed") & F.coalesce(distinct, F.lit(False))
    found = F.when(allowed, finding("R006", "soft", soft, "AEG-5.1", "coding")).otherwise(
        finding("R006", "hard", hard, "AEG-5.1")
    )
    return _rows(hit, "line_no", found)


@line_rule("R007", "Medically unlikely units")
def unlikely_units() -> Column:
    text = say(F.col("units"), " units of ", F.col("cpt"), " exceed the daily maximum of ", F.col("mue"), ".")
    return F.when(F.col("units") > F.col("mue"), finding("R007", "hard", text, "AEG-5.2", units=F.col("mue")))


@line_rule("R008", "Age-specific service")
def age_limits() -> Column:
    """Silent for unknown members: R001 already denies those claims."""
    age = age_on(F.col("date_of_birth"), F.col("service_date"))
    shown_max = F.when(F.coalesce("age_max", F.lit(0)) == 0, "any").otherwise(F.col("age_max").cast("string"))
    text = say(
        F.col("cpt"), " is defined for ages ", F.coalesce("age_min", F.lit(0)), "-", shown_max, "; member is ", age, "."
    )
    low = F.coalesce(age < F.col("age_min"), F.lit(False))
    high = F.coalesce(age > F.col("age_max"), F.lit(False))
    return F.when(F.col("member_known") & (low | high), finding("R008", "hard", text, "AEG-6.1"))


@table_rule("R009", "HMO out-of-network without referral")
def hmo_network(t: ClaimTables) -> DataFrame:
    """Silent for unknown members and providers: R001 and R012 already deny those claims."""
    suspects = claim_facts(t).filter(
        "member_known AND provider_known AND plan_type = 'HMO' AND network <> 'in_network' AND NOT is_emergency"
    )
    missing = suspects.join(never_broadcast(t.referrals), ["referral_number", "member_id", "provider_npi"], "left_anti")
    text = say("HMO member seen by out-of-network provider ", F.col("provider_name"), " without a referral.")
    return _rows(missing, None, finding("R009", "hard", text, "AEG-2.1"))


@line_rule("R010", "Charge outlier")
def charge_outlier() -> Column:
    unit = F.col("charge") / F.col("units")
    money = lambda x: F.format_number(x.cast("double"), 2)
    text = say(
        F.col("cpt"), " billed at $", money(unit), f"/unit, more than {OUTLIER_MULTIPLE:g}x the $", money(F.col("ref_cost")),
        " reference.",
    )
    return F.when(unit > F.col("ref_cost") * OUTLIER_MULTIPLE, finding("R010", "soft", text, "AEG-5.4", "coding"))


@line_rule("R011", "High-level E/M documentation")
def review_level() -> Column:
    text = say(F.col("cpt"), " requires high-complexity medical decision making.")
    return F.when(F.col("review_level"), finding("R011", "soft", text, "AEG-5.3", "coding"))


@claim_rule("R012", "Provider NPI")
def provider_npi() -> Column:
    npi = F.col("provider_npi")
    bad = finding("R012", "hard", say("NPI ", npi, " fails check-digit validation."), "AEG-1.4")
    unknown = finding("R012", "hard", say("NPI ", npi, " is not an enrolled provider."), "AEG-1.4")
    return F.when(~valid_npi(npi), bad).when(F.col("provider_known").isNull(), unknown)


def _rows(df: DataFrame, line_no: str | None, found: Column) -> DataFrame:
    number = F.col(line_no) if line_no else F.lit(None)
    return df.select("claim_id", number.cast("int").alias("line_no"), found.cast(FINDING).alias("f")).select(
        "claim_id", "line_no", "f.*"
    )


def evaluate_rules(t: ClaimTables, only: set[str] | None = None, rules: Rules = RULES) -> DataFrame:
    """All findings: one pass over claims, one over lines, and one small job per table rule."""
    want = lambda group: {k: v for k, v in group.items() if only is None or k in only}
    parts = []
    if want(rules.claim):
        found = F.array_compact(F.array(*[fn().cast(FINDING) for fn in want(rules.claim).values()]))
        rows = claim_facts(t).select("claim_id", F.lit(None).cast("int").alias("line_no"), F.explode(found).alias("f"))
        parts.append(rows.select("claim_id", "line_no", "f.*"))
    if want(rules.line):
        found = F.array_compact(F.array(*[fn().cast(FINDING) for fn in want(rules.line).values()]))
        rows = line_facts(t).select("claim_id", F.col("line_no").cast("int").alias("line_no"), F.explode(found).alias("f"))
        parts.append(rows.select("claim_id", "line_no", "f.*"))
    parts += [fn(t) for fn in want(rules.table).values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def review_routing(findings: DataFrame) -> DataFrame:
    """Soft findings that still need a reviewer, with the reviewer they go to.

    Nothing is routed when the claim or the line is denied by a hard rule anyway.
    """
    denied_claims = findings.filter("line_no IS NULL AND severity = 'hard'").select("claim_id")
    denied_lines = findings.filter("severity = 'hard' AND line_no IS NOT NULL AND adjusted_units IS NULL").select(
        "claim_id", "line_no"
    )
    return (
        findings.filter("severity = 'soft'")
        .join(never_broadcast(denied_claims), "claim_id", "left_anti")
        .join(never_broadcast(denied_lines), ["claim_id", "line_no"], "left_anti")
    )


def _verdict(resolution: Column, confidence: Column, errors: Column, override: float, uphold: float) -> Column:
    return (
        F.when(resolution.isNull() | (resolution == "escalate"), "review")
        .when(
            resolution == "override", F.when((confidence >= override) & (F.size(errors) == 0), "pay").otherwise("review")
        )
        .otherwise(F.when(confidence >= uphold, "deny").otherwise("review"))
    )


def adjudicate(
    lines: DataFrame,
    findings: DataFrame,
    reviews: DataFrame,
    override: float = OVERRIDE_CONFIDENCE,
    uphold: float = UPHOLD_CONFIDENCE,
) -> DataFrame:
    """One decision per line: deny beats review beats adjust or pay, in whatever order findings come.

    Findings of a line number at most one per rule and edit, so they meet their reviews and are gathered where their line
    lies. Lines take what holds for the whole claim first, while they are still narrow.
    """
    told = F.concat("rule_id", F.lit(": "), "message")
    claim_hard = (
        findings.filter("line_no IS NULL AND severity = 'hard'")
        .groupBy("claim_id")
        .agg(F.array_sort(F.collect_list(told)).alias("claim_reasons"))
    )
    r = reviews.select(
        F.col("claim_id").alias("_c"), F.col("rule_id").alias("_r"), F.col("line_no").alias("_l"),
        F.col("reviewer").alias("r_reviewer"), "resolution", "confidence", "rationale", "validation_errors",
    )
    own = findings.filter("line_no IS NOT NULL")
    # Rules are equal, told as a range: an equation would be a key of the join, and rows would be dealt out by it too.
    match = (F.col("claim_id") == F.col("_c")) & (F.col("line_no") == F.col("_l")) & F.col("rule_id").between(F.col("_r"), F.col("_r"))
    verdict = _verdict(F.col("resolution"), F.col("confidence"), F.col("validation_errors"), override, uphold)
    failed = F.when(
        F.size("validation_errors") > 0,
        F.concat(F.lit(" [validation: "), F.array_join("validation_errors", "; "), F.lit("]")),
    ).otherwise("")
    explained = F.when(F.col("_c").isNull(), "no agent review available; sent to human review").otherwise(
        F.concat(
            "r_reviewer", F.lit(" reviewer "), "resolution", F.lit(" ("), F.format_string("%.2f", "confidence"), F.lit("): "),
            "rationale", failed, F.lit(" -> "), F.col("verdict"),
        )
    )
    soft = F.col("severity") == "soft"
    judged = own.join(never_broadcast(r), match, "left").withColumn("verdict", F.when(soft, verdict))
    reason = F.struct(
        F.when(soft, 1).otherwise(0).alias("o"),
        F.col("rule_id").alias("r"),
        F.when(soft, F.concat("rule_id", F.lit(": "), explained)).otherwise(told).alias("text"),
    )
    denying = (F.col("severity") == "hard") & F.col("adjusted_units").isNull()
    by_line = judged.groupBy("claim_id", "line_no").agg(
        F.max(denying).alias("hard_deny"),
        F.min(F.when(F.col("severity") == "hard", F.col("adjusted_units"))).alias("cap"),
        F.max(F.coalesce(F.col("verdict") == "deny", F.lit(False))).alias("soft_deny"),
        F.max(F.coalesce(F.col("verdict") == "review", F.lit(False))).alias("soft_review"),
        F.array_sort(F.collect_list(F.when(denying, told))).alias("deny_reasons"),
        F.array_sort(F.collect_list(reason)).alias("all_reasons"),
        F.max_by("r_reviewer", F.when(soft & F.col("_c").isNotNull(), F.col("rule_id"))).alias("last_reviewer"),
    )
    no = F.lit(False)
    joined = lines.select("claim_id", F.col("line_no").cast("int").alias("line_no"), "cpt", "units").join(
        never_broadcast(claim_hard), "claim_id", "left"
    ).join(never_broadcast(by_line), ["claim_id", "line_no"], "left")
    units = F.least("units", F.coalesce("cap", "units"))
    whole = F.col("claim_reasons").isNotNull()
    hard_deny = F.coalesce("hard_deny", no)
    outcome = (
        F.when(whole | hard_deny | F.coalesce("soft_deny", no), "deny")
        .when(F.coalesce("soft_review", no), "review")
        .when(units < F.col("units"), "adjust")
        .otherwise("pay")
    )
    reasons = (
        F.when(whole, F.col("claim_reasons"))
        .when(hard_deny, F.col("deny_reasons"))
        .otherwise(F.coalesce(F.transform("all_reasons", lambda x: x["text"]), F.array().cast("array<string>")))
    )
    by_agent = ~whole & ~hard_deny & F.col("last_reviewer").isNotNull()
    return joined.select(
        "claim_id",
        "line_no",
        "cpt",
        outcome.alias("outcome"),
        F.when(outcome == "deny", F.lit(0)).otherwise(units).cast("bigint").alias("allowed_units"),
        reasons.alias("reasons"),
        F.when(by_agent, F.concat(F.lit("agent:"), "last_reviewer")).otherwise("rules").alias("decided_by"),
    )


def _claim_flags() -> list[Column]:
    is_ = lambda o: F.col("outcome") == o
    return [F.max(is_("review")).alias("_r"), F.min(is_("deny")).alias("_d"), F.min(is_("pay")).alias("_p")]


def _outcome_of_flags() -> Column:
    return (
        F.when(F.col("_r"), "pended_for_review")
        .when(F.col("_d"), "denied")
        .when(F.col("_p"), "approved")
        .otherwise("partially_approved")
    )


def claim_outcome(decisions: DataFrame) -> DataFrame:
    """pended_for_review, denied, approved or partially_approved per claim."""
    return decisions.groupBy("claim_id").agg(*_claim_flags()).select("claim_id", _outcome_of_flags().alias("outcome"))


def validate_reviews(
    routed: DataFrame, proposals: DataFrame, claims: DataFrame, sections: DataFrame, needs_quote: bool = True
) -> DataFrame:
    """Check every proposed review; an override that fails any check is escalated.

    `proposals` has claim_id, rule_id, line_no, seq, resolution, confidence, rationale,
    policy_citations, evidence_quotes. Findings without a proposal are escalated with confidence 0.
    """
    keys = ["claim_id", "rule_id", "_line"]
    line = F.coalesce(F.col("line_no"), F.lit(-1)).alias("_line")
    answer = F.struct("resolution", "confidence", "rationale", "policy_citations", "evidence_quotes")
    first = proposals.withColumn("_line", line).groupBy(*keys).agg(
        F.min_by(answer, "seq").alias("p"), F.count(F.lit(1)).alias("answers")
    )
    cited = first.select(*keys, F.explode("p.policy_citations").alias("section_id"))
    unknown = (
        cited.join(sections.select("section_id"), "section_id", "left_anti")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("section_id")).alias("unknown"))
    )
    note = F.coalesce("clinical_note", F.lit(""))
    rows = (
        routed.withColumn("_line", line)
        .join(never_broadcast(first), keys, "left")
        .join(never_broadcast(unknown), keys, "left")
        .join(never_broadcast(claims.select("claim_id", "clinical_note")), "claim_id", "left")
        .withColumn("valid_quotes", F.filter("p.evidence_quotes", lambda q: verbatim_quote(note, q)))
    )
    lost = F.size("p.evidence_quotes") - F.size("valid_quotes")
    override = F.col("p.resolution") == "override"
    no_note = normalize_space(note) == ""
    errors = F.array_compact(
        F.array(
            F.when(lost > 0, say(lost, " quote(s) not found verbatim in the note")),
            F.when(F.col("unknown").isNotNull(), say("unknown policy citation(s): ", F.array_join("unknown", ", "))),
            F.when(F.col("answers") > 1, F.lit("finding reviewed more than once")),
            F.when(override & no_note, F.lit("override without a clinical note")),
            F.when(
                override & F.lit(needs_quote) & (F.size("valid_quotes") == 0),
                F.lit("override without verbatim supporting evidence"),
            ),
            F.when(
                override & ~F.array_contains("p.policy_citations", F.col("policy_section")),
                say("override does not cite ", F.col("policy_section")),
            ),
        )
    )
    missing = F.col("p").isNull()
    checked = rows.withColumn(
        "validation_errors", F.when(missing, F.array(F.lit("finding not addressed by reviewer"))).otherwise(errors)
    )
    resolution = (
        F.when(missing | (override & (F.size("validation_errors") > 0)), "escalate").otherwise(F.col("p.resolution"))
    )
    none = F.array().cast("array<string>")
    return checked.select(
        "claim_id",
        "rule_id",
        "line_no",
        "reviewer",
        resolution.alias("resolution"),
        F.coalesce("p.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("p.rationale", F.lit("No review produced.")).alias("rationale"),
        F.coalesce("p.policy_citations", none).alias("policy_citations"),
        F.coalesce("valid_quotes", none).alias("evidence_quotes"),
        "validation_errors",
    )


def apply_human_decisions(decisions: DataFrame, human: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final decisions, problems). `human` has claim_id, line_no, outcome (pay or deny), reviewer, note.

    Claims whose human decisions do not cover exactly their pending lines, or use another outcome,
    are reported and keep their pending state.
    """
    pending = decisions.filter("outcome = 'review'").select("claim_id", "line_no")
    touched = human.select("claim_id").distinct()
    both = ["claim_id", "line_no"]
    left_out = pending.join(never_broadcast(touched), "claim_id", "left_semi").join(never_broadcast(human), both, "left_anti")
    extra = human.select(*both).join(never_broadcast(pending), both, "left_anti")
    odd = human.filter("outcome NOT IN ('pay', 'deny')").select("claim_id", "line_no")
    tag = lambda df, text: df.select("claim_id", "line_no", F.lit(text).alias("problem"))
    problems = (
        tag(left_out, "pending line not decided")
        .unionByName(tag(extra, "line is not pending"))
        .unionByName(tag(odd, "outcome must be pay or deny"))
    )
    valid = human.join(never_broadcast(problems.select("claim_id").distinct()), "claim_id", "left_anti").select(
        "claim_id", "line_no", F.col("outcome").alias("_o"), F.col("reviewer").alias("_by"), "note"
    )
    told = F.trim(F.concat(F.lit("human ("), "_by", F.lit("): "), F.coalesce("note", F.lit(""))))
    joined = decisions.join(never_broadcast(valid), both, "left")
    final = joined.withColumns(
        {
            "outcome": F.coalesce("_o", "outcome"),
            "allowed_units": F.when(F.col("_o") == "deny", F.lit(0).cast("bigint"))
            .when(F.col("_o") == "pay", F.greatest("allowed_units", F.lit(1)))
            .otherwise(F.col("allowed_units")),
            "reasons": F.when(F.col("_o").isNotNull(), F.array_append("reasons", told)).otherwise(F.col("reasons")),
            "decided_by": F.when(F.col("_o").isNotNull(), F.concat(F.lit("human:"), "_by")).otherwise(F.col("decided_by")),
        }
    )
    return final.drop("_o", "_by", "note"), problems


def decision_summary(decisions: DataFrame) -> DataFrame:
    """One sentence per claim that names every line; a claim has as many parts as lines."""
    reason = F.try_element_at("reasons", F.lit(1))
    why = F.when((F.col("outcome") != "pay") & reason.isNotNull(), F.concat(F.lit(" ("), reason, F.lit(")"))).otherwise("")
    units = F.when(F.col("outcome") == "adjust", say(", ", F.col("allowed_units"), " unit(s) allowed")).otherwise("")
    part = say("line ", F.col("line_no"), " ", F.col("cpt"), ": ", F.col("outcome"), units, why)
    # Outcome and parts come from one pass; lines without a claim belong to no summary.
    lines = F.array_sort(F.collect_list(F.struct("line_no", part.alias("t"))))
    parts = decisions.filter("claim_id IS NOT NULL").groupBy("claim_id").agg(lines.alias("p"), *_claim_flags())
    text = F.array_join(F.transform("p", lambda x: x["t"]), "; ")
    head = say("Claim ", F.col("claim_id"), ": ", F.replace("outcome", F.lit("_"), F.lit(" ")), ". ")
    return parts.withColumn("outcome", _outcome_of_flags()).select("claim_id", F.concat(head, text).alias("summary"))


def intake_checks(forms: DataFrame, form_lines: DataFrame, members: DataFrame, codes: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Issues of submitted forms (claim_id, member_id, provider_npi, total_charge, diagnosis_codes)."""
    lines = form_lines.join(codes.select(F.col("code").alias("cpt"), F.lit(True).alias("_known")), "cpt", "left")
    sums = lines.groupBy("claim_id").agg(
        F.round(F.sum("charge"), 2).alias("line_total"),
        F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), F.col("cpt")))).alias("bad_cpt"),
    )
    dx = forms.select("claim_id", F.explode("diagnosis_codes").alias("dx")).distinct()
    bad_dx = (
        dx.join(diagnoses.select(F.col("code").alias("dx")), "dx", "left_anti")
        .groupBy("claim_id")
        .agg(F.array_sort(F.collect_set("dx")).alias("bad_dx"))
    )
    rows = (
        forms.join(sums, "claim_id", "left")
        .join(bad_dx, "claim_id", "left")
        .join(members.select("member_id", F.lit(True).alias("_m")), "member_id", "left")
    )
    total = F.coalesce("line_total", F.lit(0.0))
    money = lambda x: F.format_number(x, 2)
    issues = F.array_compact(
        F.array(
            F.when(
                F.abs(total - F.col("total_charge")) > 0.01,
                say("line charges sum to ", money(total), " but total charge is ", money(F.col("total_charge"))),
            ),
            F.when(
                ~valid_npi(F.col("provider_npi")),
                say("NPI ", F.col("provider_npi"), " fails check digit (possible transcription error)"),
            ),
            F.when(F.col("_m").isNull(), say("member ", F.col("member_id"), " not found")),
            F.when(F.size("bad_cpt") > 0, say("unknown CPT code(s): ", F.array_join("bad_cpt", ", "))),
            F.when(F.size("bad_dx") > 0, say("unknown ICD-10 code(s): ", F.array_join("bad_dx", ", "))),
        )
    )
    return rows.select("claim_id", issues.alias("issues"))
