"""Prefix trie, periodic runs and curve packing against brute force on small tables."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import curve, lines, periodic, prefixes

SPACES = " \t\n\v\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- prefix trie


def conversations(seed, n):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-7, 60), n):
        if out and rng.random() < 0.5:
            turns = list(rng.choice(out)[1])[: rng.randrange(0, 9)]
        else:
            turns = []
        turns += [(rng.choice(["user", "bot", None]), rng.choice(["hi", "é", "", None, "yes yes"])) for _ in range(rng.randrange(1, 14))]
        out.append((c, turns))
    return out


def trie_by_hand(rows):
    """rows: conv_id -> list of (role, text) in order."""
    built = {}
    for c, own in rows.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(rows.get(base, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in kids[node])
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else -99, len(m), len(kids[node]), leaves[node], saved[node],
            sha(",".join(map(str, sorted(ends[node])))),
        )
        for node, m in members.items()
    )


def trie_of(df, **sizes):
    turns, members = prefixes.borrowed_starts(prefixes.numbered_turns(df))
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    got = prefixes.trie_report(turns, members, **sizes).select(*columns).collect()
    return sorted((r[0], r[1], -99 if r[2] is None else r[2], *r[3:]) for r in got)


@pytest.mark.parametrize("sizes", [{}, {"shard_ids": 4, "block": 3}])
def test_prefix_trie(spark, sizes):
    made = conversations(3, 45)
    rows = [(c, None if i == 0 else i, role, text, "x", i) for c, turns in made for i, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 0, "user", "lost", "x", 0)], "conv_id bigint, turn bigint, role string, text string, place string, a int")
    want = trie_by_hand({c: [(r or "", t or "") for r, t in turns] for c, turns in made})
    assert trie_of(df.repartition(5), **sizes) == want


def test_prefix_trie_long_and_alike(spark):
    """One conversation of many turns, many of the same turns, and repeated rows: over several blocks and shards."""
    long = {0: [("u", f"t{i % 7}") for i in range(200)], 5: [("u", f"t{i % 7}") for i in range(150)]}
    alike = {c: [("u", "a"), ("b", "b")] for c in range(10, 60)}
    rows = [(c, i, r, t) for c, turns in {**long, **alike}.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert trie_of(df, shard_ids=8, block=16) == trie_by_hand({**long, **alike})
    # The same turn number, role and text again is a turn of its own.
    again = spark.createDataFrame([(1, 0, "u", "a")] * 12, df.schema)
    assert trie_of(again) == trie_by_hand({1: [("u", "a")] * 12})


def test_prefix_trie_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert trie_of(df) == []


def test_trie_without_turns(spark):
    members = spark.createDataFrame([(4,), (9,)], "conv_id bigint")
    turns = spark.createDataFrame([], "conv_id bigint, place bigint, a bigint, b bigint, n_bytes bigint")
    got = prefixes.trie_report(turns, members).drop("node_a", "node_b").collect()
    assert [tuple(r) for r in got] == [(0, 4, None, 2, 0, 1, 0, sha("4,9"))]


# ---- periodic runs


def runs_by_hand(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            own = w[i : i + size]
            if size >= max(6, 4 * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


def told_by_hand(text, seed=None):
    w = (text or "").split() if not text or text.isascii() else [x for x in "".join(" " if c in SPACES else c for c in text).split(" ") if x]
    n, g = len(w), 0 if seed is None else seed // 10
    if seed is not None and seed % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (
        len(runs), *four, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
        " ".join(x for i, x in enumerate(w) if i not in gone),
    )


def repetitive(rng):
    out = []
    while len(out) < rng.choice([0, 20, 200, 700]):
        kind = rng.random()
        if kind < 0.3:
            out += [rng.choice("abc") for _ in range(rng.randrange(1, 20))]
        elif kind < 0.5:
            out += [f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 40))]
        else:
            p = rng.choice([1, 2, 3, 4, 7, 8, 9, 12, 16, 17, 31, 32, 64, 65])
            base = [f"v{rng.randrange(rng.choice([2, 3, 50]))}" for _ in range(p)]
            if rng.random() < 0.4:
                base = (base[: max(1, p // 3)] * 3 + base)[:p]
            out += (base * 12)[: rng.randrange(p, 8 * p + 1)]
    return out


def test_runs_of_random_texts():
    rng = random.Random(8)
    for _ in range(60):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 5))]
        names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        hashes = np.random.default_rng(1).integers(0, 1 << 62, len(names) + 1).astype(np.uint64)
        got = periodic.runs_of(hashes[[names[w] for t in texts for w in t]], np.cumsum([0, *map(len, texts)]))
        for d, t in enumerate(texts):
            assert sorted(map(tuple, got[got[:, 0] == d][:, 1:].tolist())) == runs_by_hand(t)


def test_periodic_runs(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a " * 6, "a\x0bb\x0ca\rb " * 2 + "é é é", "same " * 30000, " ".join(f"p{i % 900}" for i in range(9000))]
    texts += [" ".join(repetitive(rng)) for _ in range(40)]
    texts += [f"w{i % 11} " * 3 for i in range(5)] + ["kept as it is　with wide　space"] * 2
    rows = [(i, t, zlib.crc32(str(i).encode()), "x") for i, t in enumerate(texts)]
    rows += [rows[9], (None, "b c " * 9, None, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, seed bigint, n_runs string").repartition(3)
    short = [r for r in rows if len(r[1] or "") < 40000]
    for seed in (None, "seed"):
        got = periodic.periodic_runs(df, seed=seed, with_text=True).collect()
        assert len(got) == len(rows)
        mine = sorted(((r[0], *r[1:8], r.collapsed) for r in got if r[0] not in (6, 7)), key=repr)
        want = sorted(((i, *told_by_hand(t, s if seed else None)) for i, t, s, _ in short if i not in (6, 7)), key=repr)
        assert mine == want
    whole = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    assert tuple(whole[6])[1:6] == (1, 0, 30000, 1, 30000000) and whole[6].collapsed_sha256 == sha("same")
    assert tuple(whole[7])[1:6] == (1, 0, 9000, 900, 10000)
    assert periodic.periodic_runs(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, carry=("doc_id", "n_runs"))


# ---- packing along the curve


def test_hilbert_keys():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = curve.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_byte_encoder(tokenizer):
    import pyarrow as pa

    from opsloom.llm.texts import slices

    rng = random.Random(4)
    parts = (
        "a|don't| |  |\n|\n\n|\t|'s|'|<|<|endoftext|>|x1|12|é|ß|×|中|!|..|\x1c|\x00|’|'re|  \n |THE|́|​| | 's|\x85|½|ª|　|\xa0|word"
    ).split("|")
    encode = curve.ByteEncoder(tokenizer)
    for _ in range(150):
        texts = ["".join(rng.choice([*parts, "<|endoftext|>"]) for _ in range(rng.randrange(0, 14))) for _ in range(20)]
        ((_, _, data, bounds),) = slices(pa.array(texts))
        ids, first = encode(data, bounds)
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_curve_packing(spark, tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    vocabulary = ["the", "data", "Großer", "12", "don't", "x" * 30, "\n"] + [f"w{i}" for i in range(200)]
    texts = [None, "", "one", "long " * 30000] + [" ".join(rng.choices(vocabulary, k=rng.choice([1, 30, 400]))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(700 + i, texts[8], "x") for i in range(30)] + [(5, texts[5], "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length string").repartition(3)
    tok = Tokenizer.from_file(tokenizer)
    ids = {(i, t): [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows}
    for per_task in (4 << 20, 5000):
        got = curve.curve_sequences(df, tokenizer, per_task=per_task, with_ids=True).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in got:
            assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            by_doc[r.doc_id].append(r)
            by_sequence[r.sequence_id].append(r)
        for i, t, _ in rows:
            own = sorted(by_doc[i], key=lambda r: r.start)
            copies = sum(x[0] == i for x in rows)
            assert sorted(x for r in own for x in r.ids) == sorted(ids[i, t] * copies) and {r.doc_tokens for r in own} == {len(ids[i, t])}
            if copies == 1:
                assert [x for r in own for x in r.ids] == ids[i, t] and [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        lengths = []
        for pieces in by_sequence.values():
            pieces.sort(key=lambda r: r.offset)
            assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
            lengths.append(sum(r.length for r in pieces))
        # Nothing is padded: every sequence is full or as long as a power of two.
        assert all(n <= 1024 and n & (n - 1) == 0 for n in lengths)
        if per_task > 5000:
            copies = {r.sequence_id for i in range(700, 730) for r in by_doc[i]}
            assert len(copies) <= 2 + sum(len(ids[700 + i, texts[8]]) for i in range(30)) // 1024
    assert curve.curve_sequences(df.filter("false"), tokenizer).count() == 0
    with pytest.raises(ValueError):
        curve.curve_sequences(df, tokenizer, carry=("doc_id", "length"))


# ---- lines that repeat a run


def _entries(rows):
    """Entries of one key: (line, length, place)."""
    out = np.zeros(len(rows), lines.LINE)
    line, length, place = (np.array(c, np.uint64) for c in zip(*rows, strict=True))
    out["k"], out["i"] = 5, line
    out["v"] = length << np.uint64(51) | place << np.uint64(38)
    return out[np.lexsort((out["i"], out["v"], out["k"]))]


def test_a_line_that_repeats_a_run_is_one_entry_of_its_key(monkeypatch):
    looked, able = [0], lines._able

    def counted(a, b, *rest):
        found = able(a, b, *rest)
        looked[0] += found.size
        return found

    monkeypatch.setattr(lines, "_able", counted)
    # Forty lines repeat the run at 300 places each, and one has it far behind theirs.
    rows = [(1 + n, 1000, 3 * at + n % 2) for n in range(40) for at in range(300)] + [(99, 1000, 1500)]
    found = lines.by_runs(80)(_entries(rows))
    assert looked[0] < 100 * 100
    nodes = {x for pair in found.tolist() for x in pair}
    assert nodes == set(range(1, 41)) and len(found) >= 39
    # Their places reach from 0 to 898 and may be 200 apart, so only a run up to place 1098 meets them.
    near = lines.by_runs(80)(_entries([*rows[:-1], (99, 1000, 1098)]))
    assert 99 in {x for pair in near.tolist() for x in pair}


def test_outer_places_are_kept_with_their_copies():
    rows = [(1, 50, 4), (1, 50, 8), (1, 50, 12), (1, 50, 12), (2, 60, 7), (3, 60, 1), (3, 60, 2)]
    left = lines.outer_places(_entries(rows))
    got = sorted(zip(left["i"].tolist(), (left["v"] >> np.uint64(38) & np.uint64(8191)).tolist(), strict=True))
    assert got == [(1, 4), (1, 12), (1, 12), (2, 7), (3, 1), (3, 2)]
    assert len(lines.outer_places(np.zeros(0, lines.LINE))) == 0
