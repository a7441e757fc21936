"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import (
    components, decontaminate, jaccard, licenses, lines, packing, paragraphs, quality, secret_spans, tokencount, warc,
)

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def made(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Großer", "ñandú", "data", "x1", "règle", "and", "mit", "zwölf"] + [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.3:
            w = rng.choice(texts).split(" ")
            if len(w) > 8:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            parts = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 30, 80]))]
            texts.append("".join(p + ("\n" if rng.random() < 0.1 else " ") for p in parts))
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "  \n\t", "one", "Four words are here", "word " * 40000, *made()]
    out = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    return [*out, out[8], (None, "a text without an id " * 5, None), (900, out[20][1], "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns whose names clash with those the operators make.
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return table.withColumns({"n_words": F.lit("x"), "id": F.lit(1), "label": F.lit(None).cast("string"), "root": F.lit(2)}).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_license_scan(spark, nothing):
    texts = {
        1: "CC BY here, cc-by there", 2: "GNU General Public License v3", 3: None, 4: "All rights\nreserved. all rights reserved",
        5: " ".join(licenses.NOTICES[0].text.split()).title(), 6: "ccby cc x by", 7: "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for k, t in texts.items():
        w = re.findall(ALNUM, low(t))
        starts = [i for p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.text.split())] == p.text.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert 0 <= r.score <= 1
    assert (got[1].base_labels, got[2].base_labels, got[4].base_labels, got[5].labels) == ("cc-by", "gpl", "reserved", "mit")
    assert licenses.scan_licenses(nothing).count() == 0


def test_token_counts(docs, rows, nothing):
    pieces = [b" the", b" w", b"w1", b"th", b" gro", b"23", b" da", b"ta", b"abcd", b"bc", "é".encode()]
    held = {*pieces, *(bytes([b]) for b in range(256))}
    got = pairs(tokencount.count_tokens(docs, pieces), "doc_id", "n_tokens", "n_words")

    def greedy(word):
        n = 0
        while word:
            cut = next(k for k in range(len(word), 0, -1) if word[:k] in held)
            word, n = word[cut:], n + 1
        return n

    want = []
    for k, t, _ in rows:
        w = re.findall(SPACED, t or "")
        want.append((k, sum(greedy(b" " + x.encode()) for x in w), len(w)))
    assert got == sorted(want, key=repr)
    automaton = tokencount.LongestMatch([b"abcd", b"bcdx", b"a"])
    assert [automaton.count(x) for x in (b"abcd", b"abcx", b"bcdx", b"", b"abcdabc")] == [1, 4, 1, 0, 4]
    assert tokencount.count_tokens(nothing, pieces).count() == 0


def groups_of(keyed_sets, percent=75):
    parent = list(range(len(keyed_sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(keyed_sets):
        for j, (_, b) in enumerate(keyed_sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(keyed_sets))]


def shingles(text):
    w = re.findall(SPACED, low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("weight", [1 << 22, 60])
def test_jaccard(docs, rows, nothing, monkeypatch, weight):
    monkeypatch.setattr(jaccard.verified_components, "__defaults__", (weight,))
    sets = [(k, shingles(t)) for k, t, _ in rows]
    group = groups_of(sets)
    least = {}
    for (k, _), g in zip(sets, group, strict=True):
        least[g] = min((x for x in (least.get(g), k) if x is not None), default=None)
    want = sorted(((k, len(s), k if not s else least[g]) for (k, s), g in zip(sets, group, strict=True)), key=repr)
    assert pairs(jaccard.near_duplicate_groups(docs), "doc_id", "n_shingles", "component_id") == want
    assert jaccard.near_duplicate_groups(nothing).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    empty = sum(not s for _, s in sets)
    assert kept.count() == empty + len({g for (_, s), g in zip(sets, group, strict=True) if s})


def test_tree_leaves_out_nothing():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64)) for _ in range(40)]
    sets = [np.unique(np.concatenate([b[: len(b) - c], rng.integers(0, 1 << 63, c, dtype=np.uint64)])) for b in base for c in (0, 4, 12)]
    got = jaccard.link_sets(75)([s.tobytes() for s in sets], np.arange(len(sets)))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[find(a)] = find(b)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            linked = 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)
            assert not linked or find(i) == find(j)


def test_paragraphs(spark, nothing):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {i: " ".join(f"u{rng.randrange(10**6)}" for _ in range(120)) for i in range(8)}
    texts[10] = texts[0] + "\n" + passage
    texts[11] = passage + "\n" + texts[1]
    cut = texts[2].split()
    texts[12] = " ".join(cut[:50] + passage.split() + cut[50:])
    texts[13] = None
    texts[14] = passage.replace("p30", "q30")
    df = spark.createDataFrame([*texts.items(), (14, texts[14])], "doc_id bigint, text string")
    found = paragraphs.repeated_paragraphs(df).collect()
    assert {10, 11, 12, 14} <= {r.doc_id for r in found} <= {0, 1, 2, 10, 11, 12, 14}
    for r in found:
        assert len(texts[r.doc_id][r.start : r.end].split()) == r.n_words
    by = {}
    for r in found:
        by.setdefault(r.cluster_id, []).append(r)
    assert all(sum(not r.removed for r in v) == 1 for v in by.values())
    assert {r.cluster_id for r in found if r.kind == "line" and r.doc_id == 14} == {r.cluster_id for r in found if r.kind == "line" and r.doc_id == 11 and r.n_words == 60}
    assert paragraphs.repeated_paragraphs(nothing).count() == 0
    bands, rows_ = paragraphs.tune_bands(0.75, 0.995)
    assert 1 - (1 - 0.75**rows_) ** bands >= 0.995


def test_line_that_is_a_piece(spark):
    from opsloom.llm.texts import Hasher

    hasher = Hasher()
    for seed in range(10000):
        text = " ".join(f"v{seed}x{i}" for i in range(21))
        data = np.frombuffer(text.encode(), np.uint8)
        a, b = paragraphs.Cuts(data, np.array([0, len(data)]), hasher, 5, 20, 6).pieces
        if len(a) == 1 and b[0] - a[0] == 21:
            break
    found = paragraphs.repeated_paragraphs(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.kind, r.removed) for r in found) == [
        (1, "line", False), (1, "piece", False), (2, "line", True), (2, "piece", True)
    ]


def test_word_distance():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(70))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert lines.word_distance(np.array(a, np.uint64), np.array(b, np.uint64)) == row[-1]


def test_line_dedup(spark, nothing):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    near = long.replace("wordca", "other")
    texts = [
        (1, f"{long}\nOf.\nonly here are five words"), (2, f"Of.\n{long.upper()}!\nThe total is 12 in all of it"), (3, None), (4, ""),
        (5, f"{near}\nsome words that no other has"), (6, "the total is 99 in all of it\n"), (6, "the total is 99 in all of it\n"), (None, "five of the words here now"),
    ]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    for name in ("line", "row_key", "gone", "doc", "id", "payload", "own_key", "own_text", "n_lines", "_gone", "_row"):
        df = df.withColumn(name, F.lit(0))
    got = {(r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(df).collect()}
    want = {
        (1, texts[0][1], 0), (2, "Of.\nThe total is 12 in all of it", 1), (3, None, 0), (4, "", 0), (6, "", 1), (None, texts[7][1], 0),
        (5, "some words that no other has", 1),
    }
    assert got == want
    assert lines.dedup_lines(nothing).count() == 0


def brute_lines(texts, least=5, percent=80):
    """(doc_id, line) of the repeats that go: all pairs of lines by their words' edit distance; keys differ."""
    found = []
    for key, text in sorted(texts):
        for number, line in enumerate(text.split("\n")):
            w = re.findall(ALNUM, re.sub("[0-9]", "0", low(line)))
            if len(w) >= least:
                found.append((key, number, w))
    code = {}
    coded = [np.array([code.setdefault(x, len(code)) for x in w], np.uint64) for _, _, w in found]
    root = list(range(len(found)))
    for j in range(len(found)):
        for i in range(j):
            n = max(len(coded[i]), len(coded[j]))
            if root[i] != root[j] and 100 * min(len(coded[i]), len(coded[j])) >= percent * n:
                if 100 * (n - lines.word_distance(coded[i], coded[j])) >= percent * n:
                    x, y = sorted((root[i], root[j]))
                    root = [x if r == y else r for r in root]
    return {found[j][:2] for j in range(len(found)) if root[j] != j}


@pytest.mark.parametrize("vocabulary", [100000, 40, 4])
def test_lines_edited(spark, vocabulary):
    rng = random.Random(vocabulary)
    word = lambda: f"w{chr(97 + rng.randrange(26))}x" + "".join(chr(97 + int(c)) for c in str(rng.randrange(vocabulary)))
    if vocabulary == 4:
        word = lambda: rng.choice(["the", "of", "a", "and"])
    texts = []
    for i in range(150):
        n = rng.choice([5, 6, 7, 8, 9, 10, 10, 11, 15, 16, 20, 24, 30, 50, 120])
        line = [word() for _ in range(n)]
        texts.append((10 * i, " ".join(line)))
        # One word replaced; and as many edits as the similarity allows, or one more, spread evenly.
        one = [*line]
        one[rng.randrange(n)] = word()
        texts.append((10 * i + 1, "other\n" + " ".join(one)))
        many, count = [*line], n // 5 + rng.choice([0, 0, 1])
        for k in range(count):
            at = (2 * k + 1) * len(many) // (2 * count)
            many[at : at + 1] = rng.choice([[], [word()], [word()], [many[at], word()]])
        texts.append((10 * i + 2, " ".join(many)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    names = df.select(F.col("doc_id").alias("key"), F.xxhash64("doc_id", "text").alias("row_key"))
    want = brute_lines(texts)
    assert len(want) >= 150
    words_of = {(i, n): len(x.split()) for i, t in texts for n, x in enumerate(t.split("\n"))}
    for missed, least in ((0, 0.9), (0.02, 0.9)):
        got = {(r.key, r.line) for r in lines.repeated_lines(df, missed=missed).join(names, "row_key").filter("not keep").collect()}
        if vocabulary == 4:
            # Lines of four words only: their SimHashes are not those of bags of many words.
            assert len(got & want) >= 0.9 * len(want)
            continue
        assert got <= want
        for lo, hi in ((5, 9), (10, 20), (21, 50), (51, 999)):
            own = {x for x in want if lo <= words_of[x] <= hi}
            assert len(got & own) >= least * len(own), (missed, lo, len(got & own), len(own))


def test_forest():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (2, 1), (30, 40), (200, 900)):
        x, y, weight = rng.integers(0, n, m), rng.integers(0, n, m), rng.permutation(m).astype(np.uint64)
        taken, component = lines.forest(x, y, weight, n)
        # Lightest first, a link that joins two parts is taken.
        part = list(range(n))
        for k in np.argsort(weight).tolist():
            a, b = part[x[k]], part[y[k]]
            assert taken[k] == (a != b)
            part = [a if p == b else p for p in part]
        assert len({*zip(part, component.tolist())}) == len(set(part)) == len(set(component.tolist()))


def test_simhashes():
    rng = np.random.default_rng(3)
    length = np.array([5, 0, 9, 300, 255, 256, 17, 1, 64])
    end = np.cumsum(length)
    hashes = rng.integers(0, 1 << 63, int(end[-1])).astype(np.uint64)
    got = lines.simhashes(hashes, end - length, end)
    for i, n in enumerate(length.tolist()):
        for w in range(lines.SIGNATURE):
            own = lines.mix(hashes[end[i] - n : end[i]] ^ lines._SALT[w])
            bits = [sum(int(x) >> b & 1 for x in own) for b in range(64)]
            assert int(got[i, w]) == sum((2 * c > n) << b for b, c in enumerate(bits))


def test_packing(docs, rows, nothing):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["It's <|endoftext|> don't", "é x y　z", "ÀÖ×÷ straße—“ab”", "a.b,c!!! 123 4\x00\x1c5", "日本 語", "'s't <b>"]
    table = docs.select("doc_id", "text").unionByName(
        docs.sparkSession.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    )
    got = packing.best_fit_sequences(table, path, capacity=256).collect()
    texts = [(k, t) for k, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(odd)]
    want = []
    for k, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[start : start + 256], "<u4")
            want.append((k, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 256 + 1
    assert packing.best_fit_sequences(nothing, path).count() == 0


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (7, 6, 5, 4)] == [(0, 0), (1, 0), (2, 0), (1, 6)]


def test_bins_stay_open_for_short_pieces(spark):
    # 5000 pieces of over half a bin come first, then what fills each of them.
    df = spark.range(5000).selectExpr("1 + id % 1000 AS short").selectExpr("explode(array(2048 - short, short)) AS length")
    assert packing.pack(df).select("sequence_id").distinct().count() == 5000


def test_decontamination(spark, nothing):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([20, 13, 5, 1, 0, 15])] + [(6, None), (None, "v1 v2 v3")]
    texts = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(20)]
    texts += [(30, "X " * 50 + items[0][1].upper() + ". y"), (31, None), (32, ""), (33, items[1][1]), (34, items[5][1] * 2), (33, items[1][1])]
    df, benchmark = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block_bytes in (1 << 20, 30):
        got = decontaminate.find_contamination(df, benchmark, block_bytes=block_bytes).collect()
        phrases = {}
        for k, t in items:
            w = re.findall(ALNUM, low(t))
            for i in range(max(1, len(w) - 12) if w else 0):
                phrases.setdefault(tuple(w[i : i + 13]), set()).update([] if k is None else [str(k)])
        want = []
        for k, t in texts:
            w, hit, owners = re.findall(ALNUM, low(t)), set(), set()
            for p, own in phrases.items():
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i : i + len(p)]) == p:
                        hit |= set(range(i, i + len(p)))
                        owners |= own
            want.append((k, len(w), len(hit), sorted(owners), bool(hit) and 20 * len(hit) >= len(w)))
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got], key=repr) == sorted(want, key=repr)
    assert decontaminate.find_contamination(nothing, benchmark).count() == 0
    assert decontaminate.find_contamination(df, benchmark.filter("false")).filter("n_hit > 0").count() == 0


def test_warc(spark):
    pages = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "ü" * 500_000), (7, "u", "own"), (7, "u", "own"), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("offset", F.lit(1))
    got = sorted((tuple(r) for r in warc.archive_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    want = []
    for k, _, t in pages:
        data = (t or "").encode()
        top = max((p for p, _, x in pages if (x or "") == (t or "") and p is not None), default=None)
        want.append((k, len(data), warc.payload_digest(data), "response" if k == top else "revisit", None if k == top else top))
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(df.filter("false")).count() == 0


def test_secrets(spark, nothing):
    number = lambda n: b"\x02" + bytes([n]) + b"\x01" * n
    body = b"\x02\x01\x00" + number(32) + number(32) + number(32)
    der = b"\x30" + (bytes([len(body)]) if len(body) < 128 else b"\x81" + bytes([len(body)])) + body
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".c2ln"
    texts = [
        'PassWord = "hunter22" and token:abc', "ü AKIA" + "A1" * 9, "f" * 24 + " " + "e" * 23, None, "", token, "not.a.token " + "eyJhbGciOiJ9.e30.x",
        base64.b64encode(der).decode(), der.hex(), base64.b64encode(der[:-1]).decode(), "A" * 64, "ſecret=abcdefgh api_key: x.y-z_1",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in secret_spans.scan_secrets(df).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(12)] == [
        (1, 0, 0), (0, 1, 0), (0, 0, 1), *[(0, 0, 0)] * 5, (0, 0, 1), *[(0, 0, 0)] * 2, (1, 0, 0)
    ]
    assert [got[i].n_structural for i in range(12)] == [0, 0, 0, 0, 0, 1, 0, 1, 1, 0, 0, 0]
    assert got[0].spans == "assign:0:20" and got[1].spans == "access:2:24"
    assert secret_spans.scan_secrets(nothing).count() == 0


def test_secret_shapes():
    def tlv(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2)) + body

    key = tlv(0x30, b"\x02\x01\x00" + b"".join(tlv(2, bytes([1 + i]) * 64) for i in range(4)))
    sealed = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(0x30, b"")) + tlv(4, b"\x07" * 160))
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".c2ln"
    b64 = base64.b64encode(key).decode()
    pem = lambda name, body, end: f"-----BEGIN {name}-----{end}{body}{end}-----END {name}-----"
    wrap = lambda n, end: end.join(b64[i : i + n] for i in range(0, len(b64), n))
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"
    found = [
        (f"it is {token}.", 3, token), (f"it is {token}. And", 3, token), (token, 3, token),
        *[(pem("PRIVATE KEY", wrap(64, e), e), 5, None) for e in ("\n", "\r\n", "\\n", "\\r\\n")],
        (pem("RSA PRIVATE KEY", headers + base64.b64encode(b"\x99" * 96).decode(), "\n"), 5, None),
        (pem("ENCRYPTED PRIVATE KEY", base64.b64encode(sealed).decode(), "\n"), 5, None),
        *[(wrap(n, e), 4, None) for n in (64, 76) for e in ("\n", "\r\n", "\\n")],
        (base64.b64encode(sealed).decode(), 4, None), (sealed.hex(), 4, None),
    ]
    for text, kind, part in found:
        at = text.index(part or text)
        assert secret_spans.structural_spans(text) == [(at, kind, at + len(part or text))], text
    for text in (f"{token}.more", pem("PRIVATE KEY", base64.b64encode(key[:-1]).decode(), "\n"), "A" * 64 + "\n" + "B" * 64):
        assert secret_spans.structural_spans(text) == [], text


def test_quality(docs, rows, nothing):
    got = pairs(quality.apply_rules(docs), "doc_id", "n_repeat_words", "n_dup_lines", "base_failed", "kept")
    want = []
    for k, t, _ in rows:
        w = re.findall(SPACED, t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        held = [x for x in (t or "").split("\n") if re.search(SPACED, x)]
        want.append((k, len(covered), len(held) - len(set(held)), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert [x[:4] for x in got] == [x for x in sorted(want, key=repr)]
    assert not any(failed and kept for *_, failed, kept in got)
    assert quality.apply_rules(nothing).count() == 0


@pytest.mark.parametrize("links_a_task", [100_000, 7])
def test_components(spark, monkeypatch, links_a_task):
    monkeypatch.setattr(components, "_LINKS_A_TASK", links_a_task)
    monkeypatch.setattr(components, "_LINKS_A_BLOCK", 10 * links_a_task)
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (100, 1), (1, 2), *((i, i + 1) for i in range(200, 260))]
    links += [(1000 + i * 37 % 50, 1000 + (i + 1) * 37 % 50) for i in range(49)] + [(5000, i) for i in range(4000, 4060)]
    links += [(-7, 7)]
    table = spark.createDataFrame(links, "a bigint, b bigint")
    got = dict(tuple(r) for r in components.connected_components(table.repartition(6)).collect())
    want = {k: k for a, b in links if a is not None and a != b for k in (a, b)}
    for _ in links:
        for a, b in links:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert components.connected_components(table.limit(0)).count() == 0


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = components.stored(stage(spark, docs, folder), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == docs.count()


def test_pipeline_stages_with_clashing_columns_and_without_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs
    names = "n_words _host bad host_rate items spans _text _gone _row row_key gone doc n_lines n_removed _set _first _n set_key first_key kept base_failed contaminated"
    for name in names.split():
        odd = odd.withColumn(name, F.lit(7))
    odd = components.stored(odd, "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = stage(spark, docs, folder), stage(spark, odd, folder)
        assert more.columns == odd.columns
        assert pairs(more, *docs.columns) == pairs(plain, *docs.columns)
        assert more.filter("n_words <> 7 or n_lines <> 7 or _set <> 7 or kept <> 7").count() == 0
        none = stage(spark, docs.filter("false"), folder)
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("false"), folder).count() == 0


def test_near_lines_at_the_limit_are_all_found(spark):
    """Edits spread evenly leave single blocks whole; a word that repeats moves a SimHash by more than as many others."""
    rows = []
    for i in range(300):
        tag = "".join(chr(97 + i // 26**k % 26) for k in range(3))
        pair = [" ".join(f"{tag}{chr(97 + j)}" + (side if j % 5 == 4 else "") for j in range(24)) for side in ("", "z")]
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
    for i in range(300, 312):
        tag = "".join(chr(97 + i // 26**k % 26) for k in range(3))
        pair = [" ".join(side if j % 5 == 4 else f"{tag}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(100)) for side in (tag + "x", tag + "y")]
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone = {r.doc_id for r in lines.dedup_lines(df).collect() if r.n_removed}
    assert gone == {2 * i + 1 for i in range(312)}
