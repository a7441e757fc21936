import pytest
from pyspark.sql import functions as F

from opsloom.functions.text import normalize_entity_name
from opsloom.operators import evaluate as ev
from opsloom.operators import govern as gv
from opsloom.operators import graph as gr
from opsloom.sources import reference, sinks
from tests.conftest import rows

EDGE = "src string, tgt string, type string, weight double, description string"


def test_neighborhood_and_upsert(spark):
    e = spark.createDataFrame(
        [("a", "b", "DEPENDS_ON", 1.0, ""), ("b", "c", "DEPENDS_ON", 1.0, ""), ("c", "d", "OWNED_BY", 1.0, "")], EDGE
    )
    seeds = spark.createDataFrame([("q", "a")], "query_id string, node string")
    pairs = lambda hops: {(r.src, r.tgt) for r in gr.k_hop_neighborhood(seeds, e, hops, 25).collect()}
    assert pairs(1) == {("a", "b")} and pairs(2) == {("a", "b"), ("b", "c")}
    merged = gr.upsert_edges(e, spark.createDataFrame([("a", "b", "DEPENDS_ON", 1.0, "longer"), ("x", "x", "SELF", 1.0, "")], EDGE))
    got = {(r.src, r.tgt): (r.weight, r.description) for r in merged.collect()}
    assert got[("a", "b")] == (2.0, "longer") and ("x", "x") not in got
    prov = gr.merge_provenance(
        spark.createDataFrame([("k", "c1", 0)], "key string, chunk_id string, pos bigint"),
        spark.createDataFrame([("k", "c1", 0), ("k", "c9", 1)], "key string, chunk_id string, pos bigint"),
        ["key"],
    )
    assert [r.chunk_id for r in prov.orderBy("pos").collect()] == ["c1", "c9"]


def test_two_triangles_are_two_communities(spark):
    tri = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]
    e = spark.createDataFrame([(u, v, "T", 1.0, "") for u, v in tri] + [("c", "x", "T", 0.1, "")], EDGE)
    got = {}
    for r in gr.communities(e).collect():
        got.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["x", "y", "z"]]


def test_entity_resolution_keeps_first_name_and_longest_text(spark):
    m = spark.createDataFrame(
        [("Kube Cluster ", "tech", "short", "c1", 1), ("kube cluster!", "CONCEPT", "a longer text", "c2", 2), ("!!", "X", "", "c3", 3)],
        "name string, type string, description string, chunk_id string, seq bigint",
    )
    nodes, prov = gr.resolve_entities(m)
    assert [(r.key, r.name, r.type, r.description) for r in nodes.collect()] == [("kube cluster", "Kube Cluster", "TECH", "a longer text")]
    assert {r.chunk_id for r in prov.collect()} == {"c1", "c2"}


def test_shortest_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("z", "y")], "src string, tgt string")
    pairs = spark.createDataFrame([("a", "c"), ("b", "b"), ("a", "z")], "start string, goal string")
    got = {(r.start, r.goal): r.path for r in gr.shortest_paths(e, pairs).collect()}
    assert got == {("a", "c"): ["a", "b", "c"], ("b", "b"): ["b"]}


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("wh")
    spark.createDataFrame([(1, "Ann", "TX"), (2, "Bob", "CA")], "member_id int, name string, state string").write.parquet(f"{root}/members")
    spark.createDataFrame([(10, 1, 7, 5.0), (11, 2, 8, 9.0), (12, 2, 7, 1.0)], "claim_id int, member_id int, provider_id int, paid double").write.parquet(f"{root}/claims")
    spark.createDataFrame([(10, "x"), (11, "y")], "claim_id int, code string").write.parquet(f"{root}/claim_lines")
    spark.createDataFrame([("s3cret",)], "v string").write.parquet(f"{root}/other")
    load = lambda s: {n: s.read.parquet(f"{root}/{n}") for n in ("members", "claims", "claim_lines")}
    return str(root), load


ANALYST = gv.RolePolicy("analyst", ("members", "claims", "claim_lines"), ("members.name",), max_rows=2)
PORTAL = gv.ROLES["provider_portal"]

ALLOWED = (
    "SELECT state, count(*) AS n FROM members GROUP BY state",
    "WITH c AS (SELECT * FROM claims) SELECT sum(paid) AS p FROM c",
    "SELECT state FROM members UNION SELECT code FROM claim_lines",
    "SELECT * FROM members;",
    "SELECT m.state FROM members m JOIN claims c ON m.member_id = c.member_id -- note",
)
BLOCKED = (
    "SELECT name FROM members",
    "SELECT count(*) FROM members WHERE name = 'Ann'",
    "SELECT state FROM members ORDER BY (SELECT max(m.name) FROM members m)",
    "WITH x AS (SELECT name AS n FROM members) SELECT * FROM x",
    "SELECT * FROM audit_flags",
    "DROP TABLE claims",
    "DELETE FROM claims",
    "UPDATE claims SET paid = 0",
    "INSERT INTO claims VALUES (1, 1, 1, 1)",
    "SELECT 1; SELECT 2",
    "SHOW TABLES",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x",
    "SET spark.sql.ansi.enabled = false",
)


def test_governed_sql(spark, warehouse):
    root, load = warehouse
    for sql in ALLOWED:
        result = gv.governed_sql(spark, load, ANALYST, sql)
        assert "name" not in result.columns and len(result.collect()) <= 2
    for sql in (*BLOCKED, f"SELECT * FROM parquet.`{root}/other`"):
        with pytest.raises(gv.PolicyViolation):
            gv.governed_sql(spark, load, ANALYST, sql).collect()


def test_governed_sql_rejects_other_catalog_data(spark, warehouse):
    root, load = warehouse
    spark.read.parquet(f"{root}/other").createOrReplaceGlobalTempView("outside")
    with pytest.raises(gv.PolicyViolation):
        gv.governed_sql(spark, load, ANALYST, "SELECT * FROM global_temp.outside")
    spark.catalog.dropGlobalTempView("outside")


def test_row_filters_and_context(spark, warehouse):
    _, load = warehouse
    got = gv.governed_sql(spark, load, PORTAL, "SELECT claim_id FROM claims", {"provider_id": 7})
    assert rows(got) == [(10,), (12,)]
    assert rows(gv.governed_sql(spark, load, PORTAL, "SELECT code FROM claim_lines", {"provider_id": 7})) == [("x",)]
    with pytest.raises(gv.PolicyViolation):
        gv.governed_sql(spark, load, PORTAL, "SELECT * FROM claims")
    # A context value is data, never SQL.
    assert gv.governed_views(load(spark), PORTAL, {"provider_id": "7 OR 1=1"})["claims"].schema
    with pytest.raises(gv.PolicyViolation):
        gv.check_write(ANALYST, "audit_flags")
    with pytest.raises(PermissionError):
        sinks.append_approved(None, None, "k", "claims", ("audit_flags",))


def test_leaks_are_found(spark, warehouse):
    _, load = warehouse
    t = load(spark)
    clean = t["members"].select("state")
    assert gv.leaked_cells(clean, [t["members"].select("name")]).count() == 0
    assert gv.leaked_cells(t["members"], [t["members"].select("name")]).count() == 2


def test_policy_resolution_and_content(spark):
    over = reference.policy_overrides(spark, {"b": {"pii": "block"}, "c": {"pii": "allow", "max_steps_per_trace": 5}})
    projects = spark.createDataFrame([("a",), ("b",), ("c",)], "project_id string")
    policies = gv.resolve_policy(projects, over)
    got = {r.project_id: (r.pii, r.max_steps_per_trace, r.allowed_models) for r in policies.collect()}
    assert got == {"a": ("redact", 60, []), "b": ("block", 60, []), "c": ("allow", 5, [])}
    spans = spark.createDataFrame(
        [(p, "mail x@y.io", "fine", {"k": "call (212) 555-0147"}) for p in "abc"] + [("b", "clean", "text", {})],
        "project_id string, input_text string, output_text string, attributes map<string,string>",
    )
    out = {(r.project_id, r.input_text, r.output_text, r.attributes.get("k")) for r in gv.apply_content_policy(spans, policies).collect()}
    assert out == {
        ("a", "mail [REDACTED:EMAIL]", "fine", "call [REDACTED:PHONE]"),
        ("b", None, None, "call [REDACTED:PHONE]"),
        ("b", "clean", "text", None),
        ("c", "mail x@y.io", "fine", "call (212) 555-0147"),
    }


def test_retention(spark):
    day = 86_400 * 10**9
    spans = spark.createDataFrame([(i, i * day, "t", None) for i in (1, 20, 35, 40)], "id int, start_ns bigint, input_text string, output_text string")
    kept, traces, counts = gv.apply_retention(spans, spans, 40 * day)
    assert rows(kept.select("id", "input_text")) == [(20, None), (35, "t"), (40, "t")] and traces.count() == 3
    assert tuple(counts.first()) == (2, 1)


def test_results_match(spark):
    gold = spark.createDataFrame([("a", 1, 0.33333333), ("b", 2, None)], "s string, n int, x double")
    same = gold.selectExpr("n", "x + 0.0000000001 AS x", "s AS t")
    assert ev.results_match(same, gold).first().matches
    assert not ev.results_match(gold.unionByName(gold), gold).first().matches
    a = spark.createDataFrame([(1, "x"), (2, "y")], "pos int, v string")
    b = spark.createDataFrame([(2, "x"), (1, "y")], "pos int, v string")
    assert not ev.results_match(a, b, "pos").first().matches and ev.results_match(a.drop("pos"), b.drop("pos")).first().matches


def test_registry(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text(
        '{"members": [{"member_id": "M1", "date_of_birth": "1960-01-01", "plan_type": "HMO", "coverage_start": "2024-01-01"}], "providers": [],'
        ' "authorizations": [], "referrals": [], "history": [{"member_id": "M1", "claim_id": "a"}, {"member_id": "M1", "claim_id": "b"}]}'
    )
    t = reference.load_registry(spark, str(path))
    assert t["members"].first().coverage_end is None and rows(t["history"].select("seq", "claim_id")) == [(0, "a"), (1, "b")]
    codes = reference.code_table(spark, {"99215": {"ref_cost": 230, "mue": 1, "review_level": True}})
    assert codes.filter("review_level AND NOT requires_auth").count() == 1
    assert F.col  # column functions stay importable for users of this module


def test_unique_append(spark):
    s = "project_id string, trace_id string, span_id string, policy string, message string"
    stored = spark.createDataFrame([("p", "t", None, "cost", "old")], s)
    new = spark.createDataFrame([("p", "t", None, "cost", "new"), ("p", "t", "s", "cost", "b"), ("p", "t", "s", "cost", "a")], s)
    out = sinks.insert_unique(stored, new, ["project_id", "trace_id", "span_id", "policy"], ["message"])
    assert {(r.span_id, r.message) for r in out.collect()} == {(None, "old"), ("s", "a")}


def test_explore_entity_makes_its_tables_once(spark):
    seen = {name: spark.sparkContext.accumulator(0) for name in ("nodes", "edges")}

    def counted(df, name):
        def go(batches):
            for batch in batches:
                seen[name].add(batch.num_rows)
                yield batch

        return df.mapInArrow(go, df.schema)

    nodes = counted(spark.createDataFrame([("acme",), ("acme labs",), ("bolt",)], "key string"), "nodes")
    edges = counted(
        spark.createDataFrame([("acme", "bolt", "MAKES", 2.0), ("bolt", "acme labs", "IN", 1.0)], "src string, tgt string, type string, weight double"),
        "edges",
    )
    facts = {(r.src, r.tgt, r.score) for r in gr.explore_entity("Acme", nodes, edges).collect()}
    assert facts == {("acme", "bolt", 2.0), ("bolt", "acme labs", 0.5)}
    assert (seen["nodes"].value, seen["edges"].value) == (3, 2)


def test_policies_come_to_the_spans(spark):
    """Spans dealt out by project would put a large project into one task."""
    spans = spark.range(4).select(
        F.lit("a").alias("project_id"), F.col("id").cast("string").alias("span_id"), F.lit("t").alias("trace_id"), F.lit("x").alias("input_text"),
        F.lit("y").alias("output_text"), F.create_map(F.lit("k"), F.lit("v")).alias("attributes"), F.lit("llm").alias("kind"), F.lit("m").alias("model"),
        F.lit("t").alias("tool_name"), F.col("id").alias("start_ns"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"),
        F.create_map(F.lit("EMAIL"), F.lit(1)).alias("pii_found"), F.lit(True).alias("has_root"), F.lit(1.0).alias("cost_usd"), F.lit(9).alias("span_count"),
    )
    policies = spark.createDataFrame(
        [("a", "redact", True, ["m"], ["z"], 100, 5.0, 3)],
        "project_id string, pii string, capture_content boolean, allowed_models array<string>, forbidden_tools array<string>, "
        "max_tokens_per_call bigint, max_cost_per_trace_usd double, max_steps_per_trace bigint",
    )
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = [gv.apply_content_policy(spans, policies), gv.span_violations(spans, policies), gv.trace_violations(spans, policies)]
        assert not any("Exchange hashpartitioning" in m._jdf.queryExecution().executedPlan().toString() for m in made)
        assert [m.count() for m in made] == [4, 4, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_names_are_normalised_once_where_their_chunk_lies(spark):
    names = [
        "  Straße-7,  (Nord) ", "large ring", "Brand#7", "a  b", "tab\tname", "line\n", "x y", " x", "-", "_", "#", "", " ", "É a", None,
        "A-b_C 9", "(  a", "a  )", "one two ", "zero​width", "x\n",
    ]
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    by_steps = strip(F.regexp_replace(F.regexp_replace(F.lower(strip(F.col("n"))), r"(?U)[^\w\s-]", ""), r"\s+", " "))
    made = spark.createDataFrame([(n,) for n in names], "n string").select("n", normalize_entity_name(F.col("n")).alias("got"), by_steps.alias("want"))
    assert [r for r in made.collect() if r.got != r.want] == []

    kind = "source string, type string, target string, chunk_id int, seq bigint, description string"
    mentions = spark.createDataFrame(
        [("A", "is a", "B#", 1, 5, ""), ("a", "is a", "b", 1, 3, ""), ("A ", "is a", "b", 2, 7, ""), ("#", "is a", "b", 1, 1, ""), ("a", "is a", "A", 1, 2, ""), ("a", "is a", "b", 3, None, "")],
        kind,
    )
    edges, provenance = gr.resolve_relations(mentions)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(provenance) == 1
    assert [(r.src, r.tgt, r.type, r.weight) for r in edges.collect()] == [("a", "b", "IS_A", 4.0)]
    assert sorted((r.chunk_id, r.pos) for r in provenance.collect()) == [(1, 3), (2, 7)]
    nodes, places = gr.resolve_entities(mentions.select(F.col("target").alias("name"), "type", "description", "chunk_id", "seq"))
    assert exchanges(places) == 1
    assert sorted((r.key, r.seq) for r in nodes.collect()) == [("a", 2), ("b", 1)]
    assert sorted((r.key, r.chunk_id, r.pos) for r in places.collect()) == [("a", 1, 2), ("b", 1, 1), ("b", 2, 7)]
