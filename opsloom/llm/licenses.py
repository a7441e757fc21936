"""License scans: a positional index of rare licence words, intersected by relative position, then verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.texts import ALNUM, LOWER, Hasher, slices, words


@dataclass(frozen=True)
class Template:
    """A licence notice in lower-case words. Every phrase of `mandatory` must stand at its place in the notice."""

    label: str
    text: str
    mandatory: tuple[str, ...]


# The three base phrases. All their words are mandatory.
BASE = (
    Template("cc-by", "cc by", ("cc by",)),
    Template("gpl", "general public license", ("general public license",)),
    Template("reserved", "all rights reserved", ("all rights reserved",)),
)

# Notices of well-known licences with the phrases without which they are not that licence.
NOTICES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license",
        ("apache license version 2 0",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
        ("permission to use copy modify and or distribute this software",),
    ),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("gnu general public license",),
    ),
    Template(
        "cc-notice",
        "this work is licensed under a creative commons attribution",
        ("licensed under a creative commons",),
    ),
)


def _vocabulary(templates: tuple[Template, ...]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of all templates, their sorted hashes, and the word number of each sorted hash."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    data = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    hashes = Hasher()(data, starts, ends)
    order = np.argsort(hashes)
    return vocabulary, hashes[order], order


def _word_numbers(hashes: np.ndarray, known: np.ndarray, order: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, order[at], -1)


def licence_idf(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = BASE + NOTICES) -> dict[str, float]:
    """ln((n + 1) / (df + 1)) of each licence word over all texts; the driver gets one row per licence word."""
    vocabulary, known, order = _vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, df, n = Hasher(), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(0)):
                low = LOWER[data]
                starts, ends, first = words(low, bounds, ALNUM)
                number = _word_numbers(hasher(low, starts, ends), known, order)
                at = np.flatnonzero(number >= 0)
                doc = np.searchsorted(first, at, "right") - 1
                pairs = np.unique(doc * len(vocabulary) + number[at])
                df += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                n += hi - lo
        yield pa.RecordBatch.from_pydict({"word": [*range(len(vocabulary)), -1], "n": [*df.tolist(), n]})

    rows = docs.select(text).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    total = found.get(-1, 0)
    return {w: math.log((total + 1) / (found.get(i, 0) + 1)) for i, w in enumerate(vocabulary)}


def scan_licenses(
    docs: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    base: tuple[Template, ...] = BASE,
    notices: tuple[Template, ...] = NOTICES,
    anchors: int = 3,
    least_match: float = 0.7,
) -> DataFrame:
    """Per row: the carried columns, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Words are runs of a-z, digits and characters outside ASCII after A-Z are lower-cased. The index holds the
    postings (template, offset) of each template's rarest words by IDF over all texts: `anchors` of them, and the
    rarest of every mandatory phrase. A hit at word p of a posting with offset o votes for a notice that starts at
    p - o. A start with the votes of two anchors (one, for a template that has one) is verified: mandatory phrases
    word by word, and an IDF share of at least `least_match` of all words at their places. Base templates are
    mandatory as a whole, so each of their places is found.

    score is the largest IDF share of the accepted notices (1 for a base phrase, 0 without any). places is
    array<struct<label, start, length>> in words. A null or empty text has 0 words, null places and empty labels;
    repeated rows are scanned each; an empty table gives an empty one.
    """
    templates = base + notices
    vocabulary, known, order = _vocabulary(templates)
    idf_of = licence_idf(docs, text, templates)
    number_of = {w: i for i, w in enumerate(vocabulary)}
    idf = np.array([idf_of[w] for w in vocabulary]) + 1e-6
    plans = []
    for t in templates:
        own = [number_of[w] for w in t.text.split()]
        need = np.zeros(len(own), bool)
        chosen = set()
        for phrase in t.mandatory:
            part = [number_of[w] for w in phrase.split()]
            at = next(i for i in range(len(own)) if own[i : i + len(part)] == part)
            need[at : at + len(part)] = True
            chosen.add(max(range(at, at + len(part)), key=lambda i: (idf[own[i]], -i)))
        if t not in base:
            chosen |= set(sorted(range(len(own)), key=lambda i: (-idf[own[i]], i))[:anchors])
        plans.append((t, np.array(own), need, sorted(chosen)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")}
            for lo, hi, data, bounds in slices(batch.column(batch.num_columns - 1)):
                low = LOWER[data]
                starts, ends, first = words(low, bounds, ALNUM)
                number = _word_numbers(hasher(low, starts, ends), known, order)
                found: dict[int, list[tuple[int, str, int, float, bool]]] = {}
                hits = np.flatnonzero(number >= 0)
                of = {int(v): hits[number[hits] == v] for v in np.unique(number[hits])}
                for t, own, need, chosen in plans:
                    votes = [of[own[o]] - o for o in chosen if own[o] in of]
                    if not votes:
                        continue
                    start, n = np.unique(np.concatenate(votes), return_counts=True)
                    start = start[(n >= min(2, len(chosen))) & (start >= 0) & (start + len(own) <= len(number))]
                    doc = np.searchsorted(first, start, "right") - 1
                    inside = start + len(own) <= first[doc + 1]
                    start, doc = start[inside], doc[inside]
                    same = number[start[:, None] + np.arange(len(own))] == own
                    share = same @ idf[own] / idf[own].sum()
                    good = same[:, need].all(1) & (share >= least_match)
                    for s, d, x in zip(start[good], doc[good], share[good], strict=True):
                        found.setdefault(int(d), []).append((int(s - first[d]), t.label, len(own), float(x), t in base))
                out["n_words"] += np.diff(first).tolist()
                for d in range(hi - lo):
                    mine = sorted(found.get(d, []))
                    places = [p[0] for p in mine if p[4]]
                    out["n_base"].append(len(places))
                    out["first_word"].append(min(places, default=None))
                    out["last_word"].append(max(places, default=None))
                    out["base_labels"].append(",".join(sorted({p[1] for p in mine if p[4]})))
                    out["labels"].append(",".join(sorted({p[1] for p in mine})))
                    out["score"].append(min(1.0, max((p[3] for p in mine), default=0.0)))
                    out["places"].append([{"label": p[1], "start": p[0], "length": p[2]} for p in mine])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(out[c], t) for c, t in zip(out, _TYPES, strict=True))], names=[*carry, *out]
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), (
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, places array<struct<label:string,start:bigint,length:bigint>>"
    )])
    return docs.select(*carry, text).mapInArrow(scan, schema)


_TYPES = (
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
    pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64())])),
)
