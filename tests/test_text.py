import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from opsloom.functions import pii, scalar, text as tx
from opsloom.operators import retrieve as rt
from opsloom.sources import corpus


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tokenize_and_sentences(spark):
    assert _one(spark, tx.tokenize(F.lit("The robots are dispatching missions across sites"))) == ["robot", "dispatching", "mission", "across", "site"]
    assert _one(spark, tx.split_sentences(F.lit("One is here. Two\nfollows! 3 ends. but not this"))) == ["One is here.", "Two follows!", "3 ends. but not this"]
    assert _one(spark, tx.extract_tag(F.lit("x <a> hi\nyou </a>"), "a")) == "hi\nyou"
    assert _one(spark, tx.extract_fenced(F.lit("see\n```sql\nSELECT 1\n```"))) == "SELECT 1"
    assert _one(spark, tx.normalize_entity_name(F.lit("  Straße-7,  (Nord) "))) == "straße-7 nord"


def _scan(spark, text):
    out = spark.createDataFrame([(text,)], "t string").select("t", pii.pii_scan(F.col("t")).alias("h"))
    return out.select(pii.redact_hits(F.col("t"), F.col("h")).alias("r"), F.transform("h", lambda x: x["kind"]).alias("k")).first()


def test_pii_hits(spark):
    hits = {
        "mail bob@corp.io now": "EMAIL",
        "ssn 219-09-9999": "SSN",
        "cc 4242 4242 4242 4242": "CREDIT_CARD",
        "call (212) 555-0147": "PHONE",
        "host 192.168.1.20": "IP_ADDRESS",
        "key sk-proj-" + "a" * 24: "API_KEY",
        "Authorization: Bearer " + "x" * 24: "BEARER_TOKEN",
        "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----": "PRIVATE_KEY",
    }
    for text, kind in hits.items():
        got = _scan(spark, text)
        assert got.k == [kind], text
        assert f"[REDACTED:{kind}]" in got.r


def test_pii_look_alikes(spark):
    for text in ("order 1234567890123", "ssn 000-12-3456", "version 1.2.3.4.5", "999-99-9999"):
        got = _scan(spark, text)
        assert got.k == [] and got.r == text


def test_redaction_keeps_the_rest_and_non_latin_offsets(spark):
    got = _scan(spark, "Ünïcode 😀 a@b.io and c@d.io!")
    assert got.r == "Ünïcode 😀 [REDACTED:EMAIL] and [REDACTED:EMAIL]!"


def test_check_digits(spark):
    assert _one(spark, scalar.valid_npi(F.lit("1234567893")))
    assert not _one(spark, scalar.valid_npi(F.lit("1234567890"))) and not _one(spark, scalar.valid_npi(F.lit("123456789")))


def test_sections_and_chunks():
    text = "intro\n# A\none\n## B\ntwo\n# C\n\n## D\nthree"
    assert corpus.markdown_sections(text) == [("", "intro"), ("A", "one"), ("A > B", "two"), ("C > D", "three")]
    long = " ".join(f"word{i}" for i in range(400))
    chunks = corpus.split_recursively(long, 200, 40)
    assert all(len(c) <= 200 for c in chunks) and chunks[0].startswith("word0") and chunks[-1].endswith("word399")
    assert all(chunks[i].split()[-1] in chunks[i + 1] for i in range(len(chunks) - 1))
    assert corpus.split_recursively("x" * 450, 200, 50) == ["x" * 200, "x" * 200, "x" * 150]


def test_names_and_pairs(spark):
    text = "After lunch the Orion Team met INC-2041 owners. Service was slow. We saw Orion Team again with Beta Corp."
    many = " ".join(f"We met Acme{i} and Zeta{i} Labs." for i in range(40))
    df = spark.createDataFrame([("a", text), ("b", many), ("c", None), ("d", ""), ("e", "no names here")], "chunk_id string, text string")
    found = corpus.extract_names(df)
    mentions = {(r.chunk_id, r.name): r.mentions for r in corpus.entity_mentions(found).collect()}
    pairs = {(r.chunk_id, r.source, r.target) for r in corpus.relation_mentions(found).collect()}
    names = {n: m for (k, n), m in mentions.items() if k == "a"}
    assert names["Orion Team"] == 2 and "Service" not in names and "After" not in names and "INC-2041" in names
    assert ("a", "Orion Team", "Beta Corp") in pairs
    # No name and no pair of a text is dropped unless asked for.
    assert all(("b", f"Acme{i}") in mentions and ("b", f"Acme{i}", f"Zeta{i} Labs") in pairs for i in range(40))
    assert {k for k, _ in mentions} == {"a", "b"}
    top = corpus.extract_names(df, top=1)
    assert [(r.chunk_id, r.name) for r in corpus.entity_mentions(top).orderBy("chunk_id").collect()] == [("a", "Orion Team"), ("b", "Acme0")]
    assert corpus.relation_mentions(found, max_pairs=2).filter("chunk_id = 'b'").count() == 2


def test_scan_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "run_book.md").write_text("# Run book\nbody")
    (tmp_path / "my-notes.txt").write_bytes(b"plain \xff text")
    (tmp_path / "skip.bin").write_bytes(b"x")
    got = {r.source: (r.title, r.text) for r in corpus.scan_corpus(spark, str(tmp_path)).collect()}
    assert got == {"run_book.md": ("Run book", "# Run book\nbody"), "my-notes.txt": ("My Notes", "plain � text")}


def test_manual_sections(spark):
    text = "# M\n### AEG-1.1 Filing\nWithin 90 days.\n- quick\n- complete\n### AEG-1.2 Members\nActive.\n## Next\nother"
    df = corpus.split_manual_sections(spark.createDataFrame([(text,)], "text string"))
    got = {r.section_id: (r.title, r.text) for r in df.collect()}
    assert got == {"AEG-1.1": ("Filing", "Within 90 days.\n- quick\n- complete"), "AEG-1.2": ("Members", "Active.")}
    assert df.filter("section_id = 'AEG-1.1'").select(corpus.criteria_of(F.col("text")).alias("c")).first().c == ["quick", "complete"]


def test_rank_fusion(spark):
    lists = [["a", "b", "c"], ["b", "a"], ["b"]]
    df = spark.createDataFrame([(1, i, x) for ranking in lists for i, x in enumerate(ranking, 1)], "q int, rank int, item string")
    got = rt.reciprocal_rank_fusion(df, ["q"], "item").orderBy(F.desc("score")).collect()
    assert [r.item for r in got] == ["b", "a", "c"]


def test_vector_blocks_agree(spark):
    vectors = spark.range(40).select("id", F.array(*[F.sin(F.col("id") * (k + 1)).alias(f"x{k}") for k in range(4)]).alias("embedding"))
    queries = vectors.filter("id % 5 = 0").select(F.col("id").alias("query_id"), "embedding")
    whole = {tuple(r) for r in rt.vector_top_k(vectors, queries, 3).select("query_id", "id", "rank").collect()}
    split = {tuple(r) for r in rt.vector_top_k(vectors, queries, 3, block=3).select("query_id", "id", "rank").collect()}
    assert whole == split and len(whole) == 24
    assert {(q, i) for q, i, r in whole if r == 1} == {(q, q) for q in range(0, 40, 5)}


def test_bm25_against_brute_force(spark):
    import math

    docs = {1: "red apple pie", 2: "green apple", 3: "red red wine", 4: "old stone bridge over river", 5: "blue river boat"}
    queries = {10: "red apple apple", 11: "river bridge"}
    d = spark.createDataFrame(list(docs.items()), "id int, text string")
    q = spark.createDataFrame(list(queries.items()), "query_id int, text string")
    got = {(r.query_id, r.id): r.score for r in rt.bm25_scores(d, q, "id", "text", "text").collect()}
    stop = set(tx.CORPUS_STOPWORDS)
    toks = {k: [w for w in v.split() if w not in stop] for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    want = {}
    for qid, text in queries.items():
        for k, t in toks.items():
            s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split())
            if s > 0:
                want[(qid, k)] = s
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_pii_prefilter_loses_nothing(spark):
    import random

    from pyspark.sql import functions as F

    from opsloom.functions import pii

    rng = random.Random(7)
    parts = ["42 42 42 42 42 42 42 42", "4-2-4-2-4-2-4-2-4-2-4-2-4-2-4-2", "a@b.co", "123-45-6789", "１２３-４５-６７８９", "Bearer " + "x" * 20,
             "10.1.2.3", "AKIA" + "A" * 16, "sk-" + "a" * 20, "no", "1 2", "(555) 123-4567", "-----BEGIN PRIVATE KEY-----x-----END PRIVATE KEY-----"]
    texts = [*parts, *(rng.choice(" .,x").join(rng.sample(parts, 3)) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("hits", pii.pii_scan(F.col("t")))
    for row in df.collect():
        assert [h.asDict() for h in row.hits] == pii.find_hits(row.t)
    assert [h["kind"] for h in pii.find_hits(parts[0])] == ["CREDIT_CARD"]


def test_the_prefilter_loses_nothing(spark):
    """Every character that the patterns take for white space or a digit passes the filter before them."""
    from opsloom.functions import pii

    odd = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or chr(c).isdecimal())]
    texts = [f"bearer{c}{'x1' * 13}" for c in odd] + [f"{c}23-45-6789" for c in odd] + ["bearer " + "x1" * 13]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.withColumn("h", pii.pii_scan(F.col("t"))).collect():
        assert [tuple(h) for h in r.h] == [(h["kind"], h["start"], h["end"]) for h in pii.find_hits(r.t)], repr(r.t)


def test_exploded_terms_are_the_tokens(spark):
    texts = ["The bus stops: cities, glass, analysis as studies gas his a-b.c-ds", "", None, "is this Us ties dies toes SES ies ss s list"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for dialect in (tx.CORPUS, tx.QUESTION, tx.NOTE):
        want = df.select("id", F.explode(tx.tokenize(F.col("text"), dialect)).alias("term"))
        got = tx.explode_terms(df, "text", dialect)
        assert got.columns == ["id", "term"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    words = "bus stops cities glass analysis studies gas ties toes".split()
    stems = F.transform(F.array(*[F.lit(w) for w in words]), lambda w: tx.stem(w, "corpus"))
    assert _one(spark, stems) == ["bus", "stop", "city", "glass", "analysis", "study", "gas", "ties", "toes"]
    assert _one(spark, tx.stem(F.lit("buses"), "question")) == "buse" and _one(spark, tx.stem(F.lit("ies"), "question")) == "ies"


def test_bm25_blocks_agree_and_pairs_stay_with_their_document(spark):
    """Rows of one key are one document; rows without a key count in the idf but have no score."""
    d = spark.createDataFrame(
        [(1, "red apple"), (1, "red pie"), (2, "green apple"), (None, "red stone"), (3, "stone bridge"), (4, None), (5, "blue boat")],
        "id int, text string",
    )
    q = spark.createDataFrame([(10, "red apple"), (11, "bridge apple apple"), (12, "boat"), (None, "stone")], "query_id int, text string")
    whole = rt.bm25_scores(d, q, "id", "text", "text")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning(query_id" in line for line in plan.splitlines())
    rows = lambda df: {(r.query_id, r.id, round(r.score, 9)) for r in df.collect()}
    assert rows(whole) == rows(rt.bm25_scores(d, q, "id", "text", "text", block=2))
    assert {x[:2] for x in rows(whole)} == {(10, 1), (10, 2), (11, 1), (11, 2), (11, 3), (12, 5), (None, 3)}


def test_equal_documents_rank_by_key(spark):
    """The words of a text in another order sum to a score that may differ in its last digit."""
    words = "river bridge stone harbor cable lantern meadow copper violet engine saddle anchor".split()
    texts = [" ".join(words[i:] + words[:i]) + f" {words[0]}" for i in range(12)]
    d = spark.createDataFrame([(f"k{i:02d}", t) for i, t in enumerate(texts)] + [(f"z{i}", f"other{i} word") for i in range(40)], "id string, text string")
    q = spark.createDataFrame([(i, " ".join(words[i:])) for i in range(6)], "query_id int, text string")
    best = rt.bm25_top_k(d, q, "id", "text", "text", 3).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in best) == [(i, n, f"k{n - 1:02d}") for i in range(6) for n in (1, 2, 3)]


def test_few_shot_pairs_meet_in_tiles(spark, monkeypatch):
    import itertools
    import random

    monkeypatch.setattr(rt, "TILE_TOKENS", 120)
    monkeypatch.setattr(rt, "TILE_WIDE", 3)
    monkeypatch.setattr(rt, "TILE_WORDS", 2)
    draw = random.Random(3)
    words = [f"w{i}x" for i in range(25)]
    data = [(i, " ".join(draw.choices(words, k=draw.randint(1, 9))), draw.choice(["a", "b", "c"])) for i in range(60)]
    data += [(60, None, "a"), (61, "", "b"), (62, "w1x w2x", None), (None, "w3x w4x", "a")]
    train = spark.createDataFrame(data, "id long, text string, sql string")
    q, e = train.withColumnRenamed("id", "query_id"), train.withColumnRenamed("id", "example_id")
    made = rt.jaccard_top_k(q, e, 3, exclude_same="sql")
    # No row is made for each word that two texts share.
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    sets = [(i, set((t or "").split()), s) for i, t, s in data]
    want = []
    for i, t, s in sets:
        near = [(-len(t & u) / len(t | u), (j is not None, j or 0), j) for j, u, z in sets if t & u and s and z and s != z]
        want += [(i, j, -score, rank) for rank, (score, _, j) in enumerate(sorted(near)[:3], 1)]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = [(r.query_id, r.example_id, r.score, r["rank"]) for r in made.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    # Without the column every query has its full number, the first ids filling up.
    full = {i: [r[1] for r in g] for i, g in itertools.groupby(
        sorted(((r.query_id, r.example_id) for r in rt.jaccard_top_k(q, e, 3).collect()), key=key), lambda r: r[0])}
    assert {len(x) for x in full.values()} == {3}


def test_terms_are_counted_in_one_pass_over_the_texts(spark):
    """A row holds its document's length; rows of one key, or without one, are one document; words are those of tokenize."""
    texts = ["The studies and buses, bus. a-1.2 classes gas", None, "", "Ünder caries STUDIES \u212aeys İs s ss 12s.x", "studies ies uses"]
    data = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (1, texts[3]), (None, texts[4]), (None, texts[0]), (4, "the of and")]
    data += [(5 + i % 300, f"words{i} tokens the {'buses ' * (i % 5)}") for i in range(900)]
    df = spark.createDataFrame(data, "id bigint, text string")
    for dialect in (tx.CORPUS, tx.QUESTION, tx.NOTE):
        got = rt.term_counts(df, "id", "text", dialect)
        assert "Window" not in got._jdf.queryExecution().toString()
        counts = df.select("id", F.explode(tx.tokenize(F.col("text"), dialect)).alias("term")).groupBy("id", "term").count()
        want = [(*r, sum(x[2] for x in counts_rows if x[0] == r[0])) for counts_rows in [counts.collect()] for r in counts_rows]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_score_catalog_deals_questions_out_once(spark):
    asked = [(1, "Show unit prices of red parts"), (1, "unit prices"), (2, "the net_sales of ACME stores"), (None, "prices"), (3, None), (4, "zz")]
    catalog = [
        ("a", "name", "unit_price"), ("a", "name", "unit_price"), ("a", "description", "price of a unit"), ("a", "description", "price of a unit"),
        ("b", "column", "price unit"), ("b", "column", "part"), ("b", "synonym", "red part"), ("b", "synonym", "ed"), ("b", "value", "acme"),
        ("c", "value", "CME sto"), ("c", "name", "sale store"), ("c", "synonym", "cme"), (None, "name", "price"), ("d", None, "price"), ("d", "name", None),
    ]
    questions = spark.createDataFrame(asked, "question_id int, text string")
    tables = spark.createDataFrame(catalog, "table_name string, kind string, text string")
    tokens = lambda text: {w[:-1] if w.endswith("s") and len(w) > 3 else w for w in re.findall("[a-z0-9]+", text.lower())} - {"of", "the", "show", "a"}
    want, once = Counter(), set()
    for question, text in asked:
        for table, kind, item in catalog:
            if not text or not item or not kind:
                continue
            met, low = len(tokens(text) & tokens(item.replace("_", " "))), f" {text.lower()} "
            if kind == "description":
                want[question, table] += 0.5 * met
            elif kind in ("name", "column") and met:
                once.add((question, table, kind, item))
            elif len(item) >= 3 and (kind == "synonym" and f" {item.lower()}" in low or kind == "value" and item.lower() in low):
                want[question, table] += 2.5 if kind == "synonym" else 1.5
    for question, table, kind, _ in once:
        want[question, table] += 3.0 if kind == "name" else 1.0
    want = {k: v for k, v in want.items() if v}
    for block in (rt.TERM_BLOCK, 2):
        out = rt.score_catalog(questions, tables, top=9, block=block)
        got = {(r.question_id, r.table_name): r.score for r in out.collect()}
        assert got == want and out.count() == len(want)
    best = {r.question_id: r.table_name for r in rt.score_catalog(questions, tables, top=1, block=2).collect()}
    assert best == {q: min((t for p, t in want if p == q), key=lambda t: (-want[q, t], t is not None, t or "")) for q in {q for q, _ in want}}
    # Hits are never shuffled: only the questions are dealt out.
    plan = rt.score_catalog(questions, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bm25_top_k_meets_in_tiles(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(n, " ".join(word() for _ in range(rng.randrange(0, 40)))) for n in range(150)]
    docs += [(n + 200, t) for n, t in docs[:40]] + [(3, "w1 w2 w2 and more"), (None, "w1 w3"), (500, None)]
    asked = [((n % 17, "x"), " ".join(word() for _ in range(12))) for n in range(20)] + [((99, None), "unheard of"), ((98, "y"), None)]
    d = spark.createDataFrame(docs, "doc int, body string")
    q = spark.createDataFrame(asked, "query_id struct<a:int,b:string>, q string")
    scores = rt.bm25_scores(d, q, "doc", "body", "q")
    want = rt.top_per_query(scores, 4, F.desc(F.round("score", 9)), "doc")
    found = rt.bm25_top_k(d, q, "doc", "body", "q", 4)
    plain = lambda df: sorted((tuple(r.query_id), r.rank, r.doc, round(r.score, 8)) for r in df.collect())
    assert plain(found) == plain(want) and found.schema["doc"].dataType == d.schema["doc"].dataType
    # No row is made for a pair of a query and a document.
    assert "CoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()

    # Any share of the words may go by matrices, and any number of queries at a time.
    table = lambda n, name: pa.table({
        name: list(range(n)), "t": [sorted(rng.sample(range(60), rng.randrange(0, 9))) for _ in range(n)],
    })
    weighed = lambda t: t.append_column("x", pa.array([[rng.choice([0.5, 1.0, -0.25]) for _ in w] for w in t["t"].to_pylist()], pa.list_(pa.float64())))
    left, right = weighed(table(30, "query_id")), weighed(table(50, "example_id"))
    by_hand = set()
    for a in left.to_pylist():
        own = dict(zip(a["t"], a["x"], strict=True))
        sums = [(-sum(own.get(w, 0) * x for w, x in zip(b["t"], b["x"], strict=True)), b["example_id"]) for b in right.to_pylist()]
        by_hand |= {(a["query_id"], doc, -score) for score, doc in sorted(x for x in sums if x[0] < 0)[:3]}
    for wide, cells in ((1024, 16_000_000), (0, 16_000_000), (5, 400)):
        monkeypatch.setattr(rt, "TILE_WIDE", wide)
        monkeypatch.setattr(rt, "TILE_CELLS", cells)
        assert {tuple(r.values()) for r in rt._tile_sums(left, right, 3).to_pylist()} == by_hand
    assert rt._tile_sums(left, right.slice(0, 0), 3).num_rows == 0


def test_hashed_features_do_not_travel(spark):
    texts = spark.createDataFrame([(1, "a red ring"), (1, "red"), (2, ""), (None, "ring ring")], "k int, t string")
    plan = rt.hash_embed_entries(texts, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    norms = {r.k: r.n for r in rt.hash_embed_entries(texts, "k", "t").groupBy("k").agg(F.round(F.sum(F.col("value") ** 2), 9).alias("n")).collect()}
    assert norms == {1: 1.0, None: 1.0}
