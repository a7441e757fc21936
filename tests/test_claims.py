import dataclasses
import datetime as dt

from pyspark.sql import functions as F

from opsloom.operators import claims as cl
from opsloom.operators import ledger as lg
from tests.conftest import rows

D = dt.date
CLAIM = (
    "claim_id string, member_id string, provider_npi string, service_date date, submitted_date date, place_of_service string, "
    "diagnosis_codes array<string>, prior_auth_number string, referral_number string, clinical_note string"
)
LINE = "claim_id string, line_no int, cpt string, units bigint, charge double, modifiers array<string>"
CODE = (
    "code string, ref_cost double, mue bigint, requires_auth boolean, necessity array<string>, policy string, age_min int, age_max int, "
    "review_level boolean"
)


def _tables(spark, claims, lines):
    make = spark.createDataFrame
    return cl.ClaimTables(
        claims=make(claims, CLAIM),
        lines=make(lines, LINE),
        codes=make(
            [
                ("99213", 110.0, 1, False, None, None, None, None, False),
                ("99215", 230.0, 1, False, None, None, None, None, True),
                ("70553", 1400.0, 1, True, ["G40", "G35"], "AEG-4.2", None, None, False),
                ("97530", 40.0, 4, False, None, None, None, None, False),
                ("97140", 33.0, 4, False, None, None, None, None, False),
                ("99391", 150.0, 1, False, None, None, None, 0, False),
                ("G0439", 175.0, 1, False, None, None, 65, None, False),
            ],
            CODE,
        ),
        members=make(
            [("M1", D(1960, 2, 29), "HMO", D(2024, 1, 1), None), ("M2", D(1990, 1, 1), "PPO", D(2024, 1, 1), D(2024, 6, 30))],
            "member_id string, date_of_birth date, plan_type string, coverage_start date, coverage_end date",
        ),
        providers=make([("1234567893", "Dr A", "out_of_network")], "npi string, name string, network string"),
        auths=make([("A1", "M1", "70553", D(2024, 1, 1), D(2024, 12, 31))], "auth_number string, member_id string, cpt string, valid_from date, valid_to date"),
        referrals=make([("R1", "M1", "1234567893")], "referral_number string, member_id string, provider_npi string"),
        history=make([("M1", "1234567893", D(2024, 3, 1), "99213", "OLD", 1)], "member_id string, provider_npi string, service_date date, cpt string, claim_id string, seq bigint"),
        edits=make([("97530", "97140", True), ("99215", "99213", False)], "column1 string, column2 string, modifier_allowed boolean"),
    )


def _claim(cid, member="M1", npi="1234567893", service=D(2024, 3, 1), submitted=D(2024, 3, 10), pos="11", dx=("I10",), auth=None, ref="R1", note=None):
    return (cid, member, npi, service, submitted, pos, list(dx), auth, ref, note)


def _fired(t):
    return {(r.claim_id, r.line_no, r.rule_id, r.severity) for r in cl.evaluate_rules(t).collect()}


def test_rules_fire_where_injected(spark):
    claims = [
        _claim("ok"),
        _claim("unknown", member="M9"),
        _claim("lapsed", member="M2", service=D(2024, 7, 1), submitted=D(2024, 11, 1)),
        _claim("npi", npi="1234567890"),
        _claim("stranger", npi="1000000004"),
        _claim("hmo", ref=None),
        _claim("er", pos="23", ref=None),
        _claim("mri", dx=("I10",), auth="A1"),
        _claim("mri_ok", dx=("G40.909",), auth="A1"),
    ]
    lines = [
        ("ok", 1, "97140", 1, 30.0, []),
        ("unknown", 1, "G0439", 1, 100.0, []),
        ("lapsed", 1, "97140", 5, 30.0, []),
        ("npi", 1, "97530", 1, 400.0, []),
        ("npi", 2, "97140", 1, 30.0, ["59"]),
        ("npi", 3, "97140", 1, 30.0, []),
        ("stranger", 1, "G0439", 1, 10.0, []),
        ("hmo", 1, "99213", 1, 50.0, []),
        ("hmo", 2, "99215", 1, 50.0, []),
        ("er", 1, "70553", 1, 900.0, []),
        ("mri", 1, "70553", 1, 900.0, []),
        ("mri_ok", 1, "70553", 1, 900.0, []),
        ("ok", 2, "99391", 1, 100.0, []),
    ]
    assert _fired(_tables(spark, claims, lines)) == {
        ("unknown", None, "R001", "hard"),
        ("lapsed", None, "R001", "hard"),
        ("lapsed", None, "R002", "hard"),
        ("lapsed", 1, "R007", "hard"),
        ("npi", None, "R012", "hard"),
        ("npi", 1, "R010", "soft"),
        ("npi", 2, "R006", "soft"),
        ("npi", 3, "R006", "hard"),
        ("stranger", None, "R012", "hard"),
        ("stranger", 1, "R008", "hard"),
        ("hmo", None, "R009", "hard"),
        ("hmo", 1, "R003", "hard"),
        ("hmo", 1, "R006", "hard"),
        ("hmo", 2, "R011", "soft"),
        ("er", 1, "R004", "soft"),
        ("er", 1, "R005", "soft"),
        ("mri", 1, "R005", "soft"),
        ("ok", 2, "R008", "hard"),
    }


FINDING = (
    "claim_id string, line_no int, rule_id string, severity string, message string, policy_section string, reviewer string, adjusted_units bigint"
)
REVIEW = (
    "claim_id string, rule_id string, line_no int, reviewer string, resolution string, confidence double, rationale string, "
    "validation_errors array<string>"
)


def _f(line, rule, severity, units=None):
    return ("c", line, rule, severity, "m", "AEG-1", None, units)


def _r(line, rule, resolution, confidence, errors=()):
    return ("c", rule, line, "coding", resolution, confidence, "why", list(errors))


def test_adjudication_precedence_is_order_free(spark):
    findings = [
        _f(1, "R010", "soft"), _f(1, "R011", "soft"),
        _f(2, "R007", "hard", 2), _f(2, "R010", "soft"),
        _f(3, "R010", "soft"), _f(3, "R011", "soft"),
        _f(4, "R003", "hard"), _f(4, "R010", "soft"),
        _f(5, "R010", "soft"),
        _f(7, "R010", "soft"),
    ]
    reviews = [
        _r(1, "R010", "override", 0.9), _r(1, "R011", "uphold", 0.6),  # pay, then review: review
        _r(2, "R010", "override", 0.8),  # units stay cut
        _r(3, "R010", "uphold", 0.7), _r(3, "R011", "escalate", 1.0),  # deny beats review
        _r(5, "R010", "override", 0.95, ["bad quote"]),
    ]
    lines = [("c", n, "X", 4, 1.0, []) for n in range(1, 8)]
    for order in (1, -1):
        out = cl.adjudicate(
            spark.createDataFrame(lines, LINE), spark.createDataFrame(findings[::order], FINDING), spark.createDataFrame(reviews[::order], REVIEW)
        ).collect()
        got = {r.line_no: (r.outcome, r.allowed_units, r.decided_by) for r in out}
        assert got == {
            1: ("review", 4, "agent:coding"), 2: ("adjust", 2, "agent:coding"), 3: ("deny", 0, "agent:coding"), 4: ("deny", 0, "rules"),
            5: ("review", 4, "agent:coding"), 6: ("pay", 4, "rules"), 7: ("review", 4, "rules"),
        }
    df = spark.createDataFrame(findings + [("c", None, "R001", "hard", "gone", "AEG-1", None, None)], FINDING)
    out = cl.adjudicate(spark.createDataFrame(lines, LINE), df, spark.createDataFrame(reviews, REVIEW))
    assert {(r.outcome, r.reasons[0]) for r in out.collect()} == {("deny", "R001: gone")}
    assert cl.claim_outcome(out).first().outcome == "denied"


def test_review_validation(spark):
    routed = spark.createDataFrame([("c", n, "R010", "soft", "m", "AEG-5.4", "coding", None) for n in range(1, 6)], FINDING)
    schema = (
        "claim_id string, rule_id string, line_no int, seq int, resolution string, confidence double, rationale string, "
        "policy_citations array<string>, evidence_quotes array<string>"
    )
    ok = ["AEG-5.4"]
    proposals = spark.createDataFrame(
        [
            ("c", "R010", 1, 1, "override", 0.9, "r", ok, ["both  KNEES"]),
            ("c", "R010", 2, 1, "override", 0.9, "r", ok, ["not there"]),
            ("c", "R010", 3, 1, "override", 0.9, "r", ["AEG-9.9"], ["both knees"]),
            ("c", "R010", 4, 1, "uphold", 0.8, "r", ok, []),
            ("c", "R010", 4, 2, "override", 0.8, "r", ok, []),
        ],
        schema,
    )
    claims = spark.createDataFrame([("c", "Pain in\nboth knees today.")], "claim_id string, clinical_note string")
    sections = spark.createDataFrame([("AEG-5.4",)], "section_id string")
    got = {r.line_no: (r.resolution, r.validation_errors) for r in cl.validate_reviews(routed, proposals, claims, sections).collect()}
    assert got[1] == ("override", [])
    assert got[2] == ("escalate", ["1 quote(s) not found verbatim in the note", "override without verbatim supporting evidence"])
    assert got[3] == ("escalate", ["unknown policy citation(s): AEG-9.9", "override does not cite AEG-5.4"])
    assert got[4] == ("uphold", ["finding reviewed more than once"])
    assert got[5] == ("escalate", ["finding not addressed by reviewer"])


def test_ledger_chains_and_tampering(spark):
    schema = "seq_in int, ts string, claim_id string, actor string, event string, payload string"
    pend = '{"outcome": "pended_for_review"}'
    first = spark.createDataFrame([(1, "t1", "a", "rules", "adjudicated", pend), (2, "t2", "a", "x", "note", "{}"), (1, "t1", "b", "rules", "adjudicated", pend)], schema)
    ledger = lg.append_events(first)
    more = lg.append_events(spark.createDataFrame([(1, "t3", "a", "kim", "human_decision", "{}")], schema), ledger)
    whole = ledger.unionByName(more)
    assert {(r.claim_id, r.ok, r.first_bad_seq) for r in lg.verify_chains(whole).collect()} == {("a", True, None), ("b", True, None)}
    assert [r.claim_id for r in lg.pending_claims(whole).collect()] == ["b"]
    bad = whole.selectExpr("seq", "ts", "claim_id", "actor", "event", "CASE WHEN claim_id = 'a' AND seq = 2 THEN '{ }' ELSE payload END AS payload", "prev_hash", "hash")
    assert {(r.claim_id, r.ok, r.first_bad_seq) for r in lg.verify_chains(bad).collect()} == {("a", False, 2), ("b", True, None)}
    gone = whole.filter("NOT (claim_id = 'a' AND seq = 2)")
    assert {(r.claim_id, r.first_bad_seq) for r in lg.verify_chains(gone).collect()} == {("a", 3), ("b", None)}


def test_ledger_with_null_fields_verifies(spark):
    from opsloom.operators import ledger

    events = [(1, "t1", "c1", "a", "x", None), (2, "t2", "c1", None, "y", "{}"), (1, "t1", "c2", "a", "x", "None")]
    rows = spark.createDataFrame(events, "seq_in bigint, ts string, claim_id string, actor string, event string, payload string")
    chained = ledger.append_events(rows)
    assert {tuple(r) for r in ledger.verify_chains(chained).collect()} == {("c1", True, None), ("c2", True, None)}
    assert chained.select("hash").distinct().count() == 3


def test_no_two_events_share_a_digest(spark):
    """Texts with separators, digits and colons at the fields' borders, and nulls, never look alike."""
    parts = ["a", "b", "", None, "a\x1fb", "1:a", "~", "é", "\x00"]
    rows = [(1, "t", f"c{i}", x, y, "p") for i, (x, y) in enumerate((x, y) for x in parts for y in parts)]
    df = spark.createDataFrame(rows, "seq_in int, ts string, claim_id string, actor string, event string, payload string")
    one = df.withColumn("claim_id", F.lit("same"))
    digests = [r.h for r in one.select(lg.event_digest(F.lit(lg.GENESIS)).alias("h")).collect()]
    assert len(set(digests)) == len(rows)
    assert lg.verify_chains(lg.append_events(df)).filter("not ok").count() == 0


def test_seal_proofs_and_what_is_missing(spark):
    rows = [(i, "t", f"c{i % 40}", "a", "e", str(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "seq_in int, ts string, claim_id string, actor string, event string, payload string")
    ledger = lg.append_events(df).cache()
    tails = lg.chain_tails(ledger).cache()
    for levels in (0, 1, 3):
        nodes = lg.seal(tails, levels).cache()
        root = nodes.filter("level = 0").first().hash
        proofs = lg.inclusion_proofs(tails, nodes, tails.filter("chain in ('c1', 'c7')"))
        assert {(r.chain, r.holds) for r in lg.proofs_hold(proofs, tails, root).collect()} == {("c1", True), ("c7", True)}
        forged = tails.withColumn("hash", F.when(F.col("chain") == "c7", F.lit("0" * 64)).otherwise(F.col("hash")))
        assert {(r.chain, r.holds) for r in lg.proofs_hold(proofs, forged, root).collect()} == {("c1", True), ("c7", False)}
        assert not any(r.holds for r in lg.proofs_hold(proofs, tails, "1" * 64).collect())
        assert lg.seal(tails.filter("chain <> 'c3'"), levels).filter("level = 0").first().hash != root
    assert lg.seal(tails.filter("false"), 2).collect()[0].hash == lg.seal(tails.filter("false"), 1).filter("level = 0").first().hash
    bad = ledger.filter("claim_id <> 'c3' and not (claim_id = 'c5' and seq = 3)").withColumn(
        "hash", F.when((F.col("claim_id") == "c9") & (F.col("seq") == 3), "x").otherwise(F.col("hash")))
    assert {tuple(r) for r in lg.check_against_seal(bad, tails).collect()} == {("c3", "missing"), ("c5", "cut"), ("c9", "changed")}
    assert lg.check_against_seal(ledger, tails).count() == 0


def test_authorizations_are_never_broadcast(spark):
    """Exploded rows are told as few; a broadcast of them would pass through the driver."""
    t = _tables(spark, [_claim("mri", auth="A1"), _claim("late", auth="A1", service=D(2025, 1, 1)), _claim("none")], [
        ("mri", 1, "70553", 1, 900.0, []), ("late", 1, "70553", 1, 900.0, []), ("none", 1, "70553", 1, 900.0, []),
    ])
    missing = cl.prior_auth(t)
    plan = missing._jdf.queryExecution().executedPlan().toString()
    anti = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert anti and not any("Broadcast" in line for line in anti)
    assert {r.claim_id for r in missing.collect()} == {"late", "none"}


def _broadcast_joins(df):
    """Join lines of the plan that broadcast a side, without those on a code, whose table does not grow with the claims."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x for x in lines if "Broadcast" in x and "Join" in x and "[cpt#" not in x]


def test_claim_joins_never_broadcast_what_grows(spark):
    t = _tables(spark, [_claim("a", auth="A1"), _claim("b")], [
        ("a", 1, "70553", 1, 900.0, []), ("a", 2, "99213", 1, 90.0, []), ("b", 1, "70553", 1, 900.0, []),
    ])
    found = cl.evaluate_rules(t)
    routed = cl.review_routing(found)
    reviews = spark.createDataFrame(
        [("a", "R011", 1, "coding", "uphold", 0.9, "seen", [])],
        "claim_id string, rule_id string, line_no int, reviewer string, resolution string, confidence double, rationale string, validation_errors array<string>",
    )
    decisions = cl.adjudicate(t.lines, found, reviews)
    human = spark.createDataFrame([("a", 1, "pay", "kim", "ok")], "claim_id string, line_no int, outcome string, reviewer string, note string")
    final, problems = cl.apply_human_decisions(decisions, human)
    for made in (found, routed, decisions, final, problems, cl.decision_summary(decisions)):
        assert _broadcast_joins(made) == []
    assert len(rows(cl.claim_outcome(decisions))) == 2


def test_ledger_joins_never_broadcast(spark):
    event = lambda c, n, kind, body: (n, "t", c, "rules", kind, body)
    new = spark.createDataFrame(
        [event("c1", 1, "adjudicated", '{"outcome":"pended_for_review"}'), event("c2", 1, "adjudicated", '{"outcome":"denied"}'),
         event(None, 1, "adjudicated", '{"outcome":"denied"}')],
        "seq_in int, ts string, claim_id string, actor string, event string, payload string",
    )
    ledger = lg.append_events(new)
    assert "Join" not in ledger._jdf.queryExecution().executedPlan().toString()
    assert {(r.claim_id, r.seq, r.prev_hash) for r in ledger.collect()} == {(c, 1, lg.GENESIS) for c in ("c1", "c2", None)}
    ids = ledger.select("claim_id")
    made = [lg.pending_claims(ledger), lg.audit_trail(ledger, ids), lg.check_against_seal(ledger, lg.chain_tails(ledger)),
            lg.append_events(new, ledger)]
    assert [_broadcast_joins(m) for m in made] == [[]] * 4
    assert rows(made[0]) == [("c1",)]


def test_summaries_leave_out_lines_without_a_claim(spark):
    made = spark.createDataFrame(
        [("a", 2, "P2", "deny", 0, ["x"]), ("a", 1, "P1", "pay", 1, []), (None, 1, "P1", "pay", 1, [])],
        "claim_id string, line_no int, cpt string, outcome string, allowed_units bigint, reasons array<string>",
    )
    assert rows(cl.decision_summary(made)) == [("a", "Claim a: partially approved. line 1 P1: pay; line 2 P2: deny (x)")]


def test_first_two_claims_of_a_key_tell_duplicates(spark):
    lines = [(c, 1, "99213", 1, 50.0, []) for c in ("A", "B", "C")]
    t = _tables(spark, [_claim(c) for c in ("A", "B", "C")] + [_claim("D", member=None)], [*lines, ("D", 1, "99213", 1, 50.0, [])])
    key = ("M1", "1234567893", D(2024, 3, 1), "99213")
    kind = "member_id string, provider_npi string, service_date date, cpt string, claim_id string, seq bigint"

    def told(*history):
        found = cl.duplicates(dataclasses.replace(t, history=spark.createDataFrame(list(history), kind)))
        return {r.claim_id: r.message.split()[-1].rstrip(".") for r in found.collect()}

    history = [(*key, "B", 2), (*key, "B", 1), (*key, "A", 3), (*key, "C", 9), (None, *key[1:], "X", 0)]
    assert told(*history) == {"A": "B", "B": "A", "C": "B"}
    # A first claim without a number hides the others.
    assert told((*key, None, 0), *history) == {}
    assert told((*key, "A", 1)) == {"B": "A", "C": "A"}


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_findings_lines_and_reviews_are_dealt_out_once(spark):
    t = _tables(spark, [_claim("A"), _claim("B", npi="1000000004")], [("A", 1, "99215", 1, 50.0, []), ("A", 2, "99213", 1, 50.0, []), ("B", 1, "99215", 1, 50.0, [])])
    # The history by its key, lines and claims by claim, and the lines by the key.
    assert _exchanges(cl.duplicates(t)) <= 4
    evaluated = cl.evaluate_rules(t)
    findings = spark.createDataFrame(evaluated.collect(), evaluated.schema)
    reviews = spark.createDataFrame(
        [("A", 1, "R011", "coding", "uphold", 0.9, "seen", []), ("A", 1, "R010", "coding", "override", 0.9, "other rule", [])],
        "claim_id string, line_no int, rule_id string, reviewer string, resolution string, confidence double, rationale string, validation_errors array<string>",
    )
    decisions = cl.adjudicate(t.lines, findings, reviews)
    # Findings and reviews by line, claim findings by claim, lines by claim and then by line.
    assert _exchanges(decisions) <= 5
    got = {(r.claim_id, r.line_no): (r.outcome, r.decided_by) for r in decisions.collect()}
    assert got == {("A", 1): ("deny", "agent:coding"), ("A", 2): ("deny", "rules"), ("B", 1): ("deny", "rules")}
