"""Retrieval over chunk tables for whole tables of queries: vectors, BM25, fusion, reranking."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.text import CORPUS, NOTE, Dialect, Terms, note_sentences, tokenize
from opsloom.session import stored

# Queries are scored in blocks of this many vectors; only a block is ever sent to the executors.
QUERY_BLOCK = 4096
# Terms of questions are sent to the executors in blocks of about this many rows.
TERM_BLOCK = 200_000
# Texts whose terms are counted at a time, and words whose terms a task remembers.
TERM_ROWS = 256
TERM_WORDS = 1_000_000
# Of the Jaccard search: tokens of one side of a tile, words whose postings are counted at a time, most words and cells of
# a tile's matrix.
TILE_TOKENS = 2_000_000
TILE_WORDS = 128
TILE_WIDE = 1024
TILE_CELLS = 16_000_000


def top_per_query(scored: DataFrame, k: int, *order: Column | str, query: str = "query_id") -> DataFrame:
    """Best k rows per query with their rank; Spark keeps k rows per task before the shuffle."""
    window = Window.partitionBy(query).orderBy(*order)
    ranked = scored.withColumn("rank", F.row_number().over(window).cast("bigint"))
    return ranked.filter(F.col("rank") <= k)


def vector_top_k(
    vectors: DataFrame, queries: DataFrame, k: int, vector_id: str = "id", block: int = QUERY_BLOCK
) -> DataFrame:
    """Exact cosine top k of every query: (query_id, id, score, rank).

    `vectors` has an id and an embedding, `queries` a query_id and an embedding. Queries go to the
    executors in blocks of bounded size; each block is one pass over the vectors that keeps k rows
    per Arrow batch, so the shuffle never sees more than those.
    """
    total = queries.count()
    blocks = max(1, -(-total // block))
    parts = []
    for b in range(blocks):
        chosen = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        part = _score_block(vectors, chosen.select("query_id", "embedding").toPandas(), k, vector_id)
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return top_per_query(out, k, F.desc("score"), "id")


def _score_block(vectors: DataFrame, pdf: pd.DataFrame, k: int, vector_id: str) -> DataFrame:
    query_ids = pdf["query_id"].to_numpy()
    if len(query_ids) == 0:
        empty = vectors.sparkSession.createDataFrame([], "query_id string, id string, score double")
        return empty
    matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
    norms = np.linalg.norm(matrix, axis=1)
    matrix = matrix / np.where(norms == 0, 1.0, norms)[:, None]
    types = dict(vectors.dtypes)
    id_type = types[vector_id]
    query_type = "string" if pdf["query_id"].dtype == object else "bigint"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            ids = batch["id"].to_numpy()
            block = np.vstack([np.asarray(v, dtype=np.float64) for v in batch["embedding"]])
            size = np.linalg.norm(block, axis=1)
            sims = (block / np.where(size == 0, 1.0, size)[:, None]) @ matrix.T
            # Exactly k rows leave a batch per query; ties with the k-th best go by id, as in the final ranking.
            kth = np.partition(sims, -k, axis=0)[-k] if len(ids) > k else np.full(sims.shape[1], -np.inf)
            rows, cols = np.nonzero(sims >= kth)
            by_id = np.empty(len(ids), np.int64)
            by_id[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            order = np.lexsort((by_id[rows], -sims[rows, cols], cols))
            rows, cols = rows[order], cols[order]
            first = np.arange(len(cols)) - np.searchsorted(cols, cols) < k
            rows, cols = rows[first], cols[first]
            yield pd.DataFrame({"query_id": query_ids[cols], "id": ids[rows], "score": sims[rows, cols]})

    return vectors.select(F.col(vector_id).alias("id"), "embedding").mapInPandas(
        score, f"query_id {query_type}, id {id_type}, score double"
    )


def hash_embed_entries(df: DataFrame, key: str, text: str, dimension: int = 512) -> DataFrame:
    """Feature-hashed unigrams and bigrams as unit-length sparse rows (key, idx, value).

    Rows are dealt out by key while they still are texts; what follows goes by the key, and no feature travels.
    """
    tokens = df.select(key, text).repartition(key).select(key, tokenize(F.col(text)).alias("t"))
    pairs = F.when(
        F.size("t") > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))),
            lambda i: F.concat_ws("_", F.element_at("t", i), F.element_at("t", i + 1)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    digest = F.md5("f")
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("bigint")
    signed = F.when(F.pmod(number(9, 2), F.lit(2)) == 1, 1.0).otherwise(-1.0)
    sums = (
        tokens.select(key, F.explode(F.concat("t", pairs)).alias("f"))
        .select(key, F.pmod(number(1, 8), F.lit(dimension)).alias("idx"), signed.alias("s"))
        .groupBy(key, "idx")
        .agg(F.sum("s").alias("v"))
        .filter("v <> 0")
    )
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return sums.select(key, "idx", (F.col("v") / norm).alias("value"))


def hash_embed(df: DataFrame, key: str, text: str, dimension: int = 512) -> DataFrame:
    """(key, embedding): dense hashed vectors; a row holds at most `dimension` entries before packing."""
    entries = hash_embed_entries(df, key, text, dimension)
    packed = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    dense = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(dimension - 1).cast("bigint")),
        lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)),
    )
    empty = F.array_repeat(F.lit(0.0), dimension)
    return df.select(key).join(packed, key, "left").select(key, F.coalesce(dense, empty).alias("embedding"))


def term_counts(docs: DataFrame, key: str, text: str, dialect: Dialect = CORPUS) -> DataFrame:
    """(key, term, tf, dl) of documents: how often a term comes and how many terms there are; rows of one key are one document.

    Rows meet by key while they still are texts, and stream by in its order. Words are counted as they are split off, and
    stems and stopwords looked at once for each distinct word, so no row is ever made for a single word.
    """
    whole = docs.select(key, F.lower(F.col(text)).alias("_text")).repartition(key).sortWithinPartitions(key)
    kind = whole.schema[key].dataType.simpleString()
    return whole.mapInArrow(lambda batches: _counted(batches, key, dialect), f"`{key}` {kind}, term string, tf bigint, dl bigint")


def _counted(batches: Iterator[pa.RecordBatch], key: str, dialect: Dialect) -> Iterator[pa.RecordBatch]:
    """Rows (key, lower-cased text) in the order of their keys to rows (key, term, tf, dl)."""
    split, terms = re.compile(dialect.pattern).findall, Terms(dialect)
    now, words, made = None, Counter(), []

    def ended() -> None:
        found = {}
        for word, n in words.items():
            if term := terms[word]:
                found[term] = found.get(term, 0) + n
        if found:
            made.append((now, found))

    def rows(kind: pa.DataType) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(made)), [len(found) for _, found in made])
        columns = [
            pa.array([k for k, _ in made], kind).take(pa.array(of)),
            pa.array([t for _, found in made for t in found], pa.string()),
            pa.array([n for _, found in made for n in found.values()], pa.int64()),
            pa.array([sum(found.values()) for _, found in made], pa.int64()).take(pa.array(of)),
        ]
        return pa.RecordBatch.from_arrays(columns, [key, "term", "tf", "dl"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for i in range(0, batch.num_rows, TERM_ROWS):
            part = batch.slice(i, TERM_ROWS)
            for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if k != now:
                    ended()
                    now, words = k, Counter()
                if text is not None:
                    words.update(split(text))
            if made:
                yield rows(kind)
                made.clear()
            if len(terms) > TERM_WORDS:
                terms.clear()
    ended()
    if made:
        yield rows(kind)


def _bm25_terms(
    docs: DataFrame, queries: DataFrame, key: str, text: str, query_text: str, dialect: Dialect,
    k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25,
) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, weight) of the queries and (key, term, gain) of the documents' terms that any query asks for.

    The products of weight and gain of a pair's terms add up to its Okapi score.
    """
    # The term index is written once: document frequencies and scores read it.
    tf = stored(term_counts(docs, key, text, dialect))
    total = tf.agg(F.sum("tf").alias("t")).scalar()
    size = docs.agg(F.count(F.lit(1)).alias("n")).select(F.struct(F.col("n"), (total / F.col("n")).alias("avgdl")).alias("s")).scalar()
    df = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    raw = df.withColumn("idf", F.ln(size["n"] - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf").alias("m"))
    idf = raw.select("term", F.when(F.col("idf") < 0, mean.scalar() * epsilon).otherwise(F.col("idf")).alias("idf"))
    asked = term_counts(queries.select("query_id", F.col(query_text).alias("_q")), "query_id", "_q", dialect)
    weighted = stored(asked.join(idf, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("weight")))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / size["avgdl"]))
    terms = (
        tf.filter(F.col(key).isNotNull())
        .join(weighted.select("term").distinct(), "term", "left_semi")
        .select(key, "term", gain.alias("gain"))
    )
    return weighted, terms


def bm25_scores(
    docs: DataFrame,
    queries: DataFrame,
    key: str,
    text: str,
    query_text: str,
    dialect: Dialect = CORPUS,
    k1: float = 1.5,
    b: float = 0.75,
    epsilon: float = 0.25,
    block: int = TERM_BLOCK,
) -> DataFrame:
    """Okapi scores (query_id, key, score) of documents that share a term with a query; only score > 0.

    Idf is computed over the whole corpus; negative values are replaced by epsilon times the mean
    idf. Repeated query terms count repeatedly. `queries` has query_id and a text.

    Documents are dealt out once by key, with the terms that any query asks for. The queries' terms come to them in
    blocks of about `block` rows, so a pair's score is summed where its document lies and pairs are never shuffled.
    """
    weighted, terms = _bm25_terms(docs, queries, key, text, query_text, dialect, k1, b, epsilon)
    terms = terms.repartition(key)
    blocks = max(1, -(-weighted.count() // block))
    out = None
    for i in range(blocks):
        chosen = weighted if blocks == 1 else weighted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        part = (
            terms.join(F.broadcast(chosen), "term")
            .groupBy("query_id", key)
            .agg(F.sum(F.col("weight") * F.col("gain")).alias("score"))
            .filter("score > 0")
        )
        out = part if out is None else out.unionByName(part)
    return out


def bm25_top_k(docs, queries, key, text, query_text, k, dialect: Dialect = CORPUS) -> DataFrame:
    """The k best documents per query; equal ones go by key, whatever the order in which their scores were summed.

    Queries and documents meet in tiles of a bin of each, of bounded size; a tile hands on k rows per query, and no row is
    made for a pair. Every query meets every bin, so the work is the product of both sides. Terms go by 64-bit hashes.
    """
    weighted, terms = _bm25_terms(docs, queries, key, text, query_text, dialect)
    gathered = lambda df, name, value: stored(
        df.groupBy(name)
        .agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col(value).alias("x"))).alias("e"))
        .select(name, F.col("e.t").alias("t"), F.col("e.x").alias("x"))
    )
    asked, told = gathered(weighted, "query_id", "weight"), gathered(terms, key, "gain").withColumnRenamed(key, "example_id")
    best = _by_tiles(asked, told, lambda a, b: _tile_sums(a, b, k)).withColumnRenamed("example_id", key)
    return top_per_query(best, k, F.desc(F.round("score", 9)), key)


def _tile_sums(queries: pa.Table, docs: pa.Table, k: int) -> pa.Table:
    """The k documents of one tile with the largest positive sums of weight times gain for each query, ties by id."""
    (q_size, q_words), (d_size, d_words) = _lists(queries["t"]), _lists(docs["t"])
    weight, gain = _lists(queries["x"])[1], _lists(docs["x"])[1]
    order = pc.rank(docs["example_id"].combine_chunks(), sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64)
    asked, q_at = np.unique(q_words, return_inverse=True)
    owner = np.repeat(np.arange(len(d_size)), d_size)
    at = np.searchsorted(asked, d_words)
    known = at < len(asked)
    known[known] = asked[at[known]] == d_words[known]
    at, owner, gain = at[known], owner[known], gain[known]
    held_by = np.bincount(at, minlength=len(asked))
    # The words of most pairs are summed by products of matrices, the others along their postings.
    pairs = held_by * np.bincount(q_at, minlength=len(asked))
    frequent = np.argsort(-pairs, kind="stable")[: min(TILE_WIDE, TILE_CELLS // max(1, len(d_size)))]
    wide = np.full(len(asked), -1)
    wide[frequent] = np.arange(len(frequent))
    have = np.zeros((len(frequent), len(d_size)))
    met = wide[at] >= 0
    have[wide[at[met]], owner[met]] = gain[met]
    by_word = np.flatnonzero(~met)[np.argsort(at[~met], kind="stable")]
    owner, gain = owner[by_word], gain[by_word]
    rare = np.bincount(at[by_word], minlength=len(asked))
    ends = np.cumsum(rare)
    starts = ends - rare
    q_ends = np.cumsum(q_size)
    rows, found, scores = [], [], []
    step = max(1, TILE_CELLS // 4 // max(1, len(d_size)))
    for lo in range(0, len(q_size), step):
        own = [slice(q_ends[row] - q_size[row], q_ends[row]) for row in range(lo, min(lo + step, len(q_size)))]
        want = np.zeros((len(own), len(frequent)))
        for n, part in enumerate(own):
            words = wide[q_at[part]]
            want[n, words[words >= 0]] = weight[part][words >= 0]
        for n, (score, part) in enumerate(zip(want @ have, own, strict=True)):
            some = rare[q_at[part]] > 0
            words, factor = q_at[part][some], weight[part][some]
            for j in range(0, len(words), TILE_WORDS):
                here = words[j : j + TILE_WORDS]
                place = np.concatenate([np.arange(starts[w], ends[w]) for w in here])
                score += np.bincount(owner[place], weights=gain[place] * np.repeat(factor[j : j + TILE_WORDS], rare[here]), minlength=len(score))
            hit = np.flatnonzero(score > 0)
            told = np.round(score[hit], 9)
            if len(hit) > k:
                near = told >= np.partition(told, len(told) - k)[len(told) - k]
                hit, told = hit[near], told[near]
            top = hit[np.lexsort((order[hit], -told))[:k]]
            rows.append(np.full(len(top), lo + n))
            found.append(top)
            scores.append(score[top])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table({
        "query_id": queries["query_id"].take(pa.array(join(rows, np.int64))),
        "example_id": docs["example_id"].take(pa.array(join(found, np.int64))),
        "score": pa.array(join(scores, np.float64)),
    })


def overlap_rerank(candidates: DataFrame, query_text: str, text: str, top_n: int, order: str) -> DataFrame:
    """Rerank (query_id, ..., order) rows by term coverage plus term density; ties keep their order."""
    q = F.array_distinct(tokenize(F.col(query_text)))
    t = tokenize(F.col(text))
    rows = candidates.withColumns({"_q": q, "_t": t})
    coverage = F.when(F.size("_q") == 0, 0.0).otherwise(F.size(F.array_intersect("_q", "_t")) / F.size("_q"))
    hits = F.size(F.filter("_t", lambda w: F.array_contains(F.col("_q"), w)))
    rows = rows.withColumn("rerank_score", F.round(coverage + hits / (F.size("_t") + 10), 4)).drop("_q", "_t")
    return top_per_query(rows, top_n, F.desc("rerank_score"), order)


def jaccard_top_k(
    queries: DataFrame, examples: DataFrame, k: int, exclude_same: str | None = None, dialect: Dialect | None = None
) -> DataFrame:
    """Nearest examples per query by token-set Jaccard: (query_id, example_id, score, rank).

    Both tables have `text`; examples also have example_id. Pairs that share a token meet in tiles of
    a bin of queries and a bin of examples, each of bounded size; a query with fewer than k of them is
    filled up with the first examples by id, whose score is 0. `exclude_same` names a column whose
    equal values rule a pair out. Every query meets every bin, so the work is the product of both
    sides; a tile hands on k rows per query.
    """
    from opsloom.functions.text import QUESTION

    dialect = dialect or QUESTION
    extra = [F.col(exclude_same).alias("same")] if exclude_same else []
    # Words by 64-bit hashes, written once: the bins' number and the tiles read them.
    tokens = lambda df, key: stored(
        df.select(key, F.transform(F.array_distinct(tokenize(F.col("text"), dialect)), lambda w: F.xxhash64(w)).alias("t"), *extra)
    )
    q, e = tokens(queries, "query_id"), tokens(examples, "example_id")
    met = lambda df: df.filter("size(t) > 0" + (" AND same IS NOT NULL" if extra else ""))
    best = _by_tiles(met(q), met(e), lambda a, b: _tile_best(a, b, k))
    best = top_per_query(best, k, F.desc("score"), "example_id").drop("rank")
    if extra:
        return top_per_query(best, k, F.desc("score"), "example_id")
    best = stored(best)
    # The first 2k ids are enough to fill k places even when k of them are taken already.
    first = examples.select("example_id").orderBy("example_id").limit(2 * k)
    pool = first.agg(F.array_sort(F.collect_list("example_id")).alias("p")).scalar()
    short = q.select("query_id").join(
        best.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= k), "query_id", "left_anti"
    )
    filler = short.select("query_id", F.explode(pool).alias("example_id")).join(
        best, ["query_id", "example_id"], "left_anti"
    )
    everything = best.unionByName(filler.withColumn("score", F.lit(0.0)))
    return top_per_query(everything, k, F.desc("score"), "example_id")


def _bins(df: DataFrame) -> int:
    """As many bins as hold TILE_TOKENS tokens each; of few tokens some more, so that tasks share them."""
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    return max(1, -(-total // TILE_TOKENS), min(4, n // 1024))


def _by_tiles(queries: DataFrame, examples: DataFrame, match: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """(query_id, example_id, score): what `match` finds in each tile. Rows have an id and `t`. Equal ids lie in one bin."""
    rows, columns = _bins(queries), _bins(examples)
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("r", own("query_id", rows)).withColumn("c", every(columns))
    right = examples.withColumn("c", own("example_id", columns)).withColumn("r", every(rows))
    types = f"query_id {dict(queries.dtypes)['query_id']}, example_id {dict(examples.dtypes)['example_id']}, score double"
    tile = lambda df: df.repartition(2 * rows * columns, "r", "c").groupBy("r", "c")
    return tile(left).cogroup(tile(right)).applyInArrow(match, types)


def _tile_best(queries: pa.Table, examples: pa.Table, k: int) -> pa.Table:
    """The k best examples of each query of one tile, ties by id; rows of one id and size are counted together."""
    (q_size, q_words), (e_size, e_words) = _lists(queries["t"]), _lists(examples["t"])
    q_key, e_key = _numbered(queries["query_id"], q_size), _numbered(examples["example_id"], e_size)
    asked = np.unique(q_words)
    owner = np.repeat(np.arange(len(e_size)), e_size)
    at = np.searchsorted(asked, e_words)
    known = at < len(asked)
    known[known] = asked[at[known]] == e_words[known]
    at, owner = at[known], owner[known]
    held_by = np.bincount(at, minlength=len(asked))
    q_at, q_ends = np.searchsorted(asked, q_words), np.cumsum(q_size)
    # The most frequent words are counted by products of 0/1 matrices, the others along their postings.
    wide = np.full(len(asked), -1)
    frequent = np.argsort(-held_by, kind="stable")[: min(TILE_WIDE, TILE_CELLS // max(1, len(e_size)))]
    wide[frequent] = np.arange(len(frequent))
    have = np.zeros((len(frequent), len(e_size)), np.float32)
    have[wide[at[wide[at] >= 0]], owner[wide[at] >= 0]] = 1
    owner = owner[np.argsort(at, kind="stable")]
    ends = np.cumsum(held_by)
    starts = ends - held_by

    def shared_words(rows: np.ndarray) -> Iterator[np.ndarray]:
        step = max(1, TILE_CELLS // 4 // max(1, len(e_size)))
        for i in range(0, len(rows), step):
            own = [q_at[q_ends[row] - q_size[row] : q_ends[row]] for row in rows[i : i + step]]
            want = np.zeros((len(own), len(frequent)), np.float32)
            for n, words in enumerate(own):
                want[n, wide[words[wide[words] >= 0]]] = 1
            for count, words in zip((want @ have).astype(np.int64), own, strict=True):
                words = words[(wide[words] < 0) & (held_by[words] > 0)]
                for j in range(0, len(words), TILE_WORDS):
                    found = np.concatenate([owner[starts[w] : ends[w]] for w in words[j : j + TILE_WORDS]])
                    count += np.bincount(found, minlength=len(e_size))
                yield count

    keys, sample, column = np.unique(e_key, return_index=True, return_inverse=True)
    e_same = q_same = None
    if "same" in examples.column_names:
        codes = pa.concat_arrays([x["same"].combine_chunks() for x in (queries, examples)]).dictionary_encode().indices
        q_same, e_same = np.split(codes.to_numpy(), [len(q_size)])
    at_q, at_e, scores = [], [], []
    order = np.argsort(q_key, kind="stable")
    counts = shared_words(order)
    for group in np.split(order, np.flatnonzero(np.diff(q_key[order])) + 1) if len(order) else ():
        shared = np.zeros(len(e_size), np.int64)
        for row in group:
            count = next(counts)
            if q_same is not None:
                count[e_same == q_same[row]] = 0
            shared += count
        if len(keys) < len(shared):
            shared = np.bincount(column, weights=shared, minlength=len(keys)).astype(np.int64)
        else:
            shared = shared[sample]
        hit = np.flatnonzero(shared)
        with np.errstate(divide="ignore"):
            score = shared[hit] / (q_size[group[0]] + e_size[sample[hit]] - shared[hit])
        if len(hit) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            hit, score = hit[near], score[near]
        # Columns are in the order of their ids.
        top = np.lexsort((hit, -score))[:k]
        at_q.append(np.full(len(top), group[0]))
        at_e.append(sample[hit[top]])
        scores.append(score[top])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table({
        "query_id": queries["query_id"].take(pa.array(join(at_q, np.int64))),
        "example_id": examples["example_id"].take(pa.array(join(at_e, np.int64))),
        "score": pa.array(join(scores, np.float64)),
    })


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all items of a column of lists without nulls."""
    items = column.combine_chunks()
    return pc.list_value_length(items).to_numpy().astype(np.int64), pc.list_flatten(items).to_numpy()


def _numbered(ids: pa.ChunkedArray, size: np.ndarray) -> np.ndarray:
    """A number for each id and size, in the order of the ids; nulls come first."""
    place = pc.rank(ids.combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    return place.astype(np.int64) * (int(size.max(initial=0)) + 1) + size


def keep_best_score(candidates: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """One row per key with the highest score, placed where the key was first seen."""
    rest = [c for c in candidates.columns if c not in keys]
    best = candidates.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(order))).alias("_r"), F.min(order).alias("first_seen")
    )
    return best.select(*keys, "_r.*", "first_seen")


def rank_lists(scored: DataFrame, keys: Sequence[str], score: str, item: str) -> DataFrame:
    """Position of each item in its ranking, from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint"))


def reciprocal_rank_fusion(rankings: DataFrame, keys: Sequence[str], item: str, k: int = 60) -> DataFrame:
    """Fused score per item: sum of 1 / (k + rank) over its rankings."""
    return rankings.groupBy(*keys, item).agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("score"))


def lookup_by_rank(ranked: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Chunk rows of a ranking in its order; ids without a chunk drop out."""
    return ranked.join(chunks, key)


def provenance_chunks(facts: DataFrame, provenance: DataFrame, fact_keys: Sequence[str]) -> DataFrame:
    """Chunks behind ranked facts, each at the rank of the first fact that cites it.

    `facts` has query_id, rank and the fact key; `provenance` has the fact key, chunk_id and pos.
    """
    cited = facts.join(provenance, list(fact_keys))
    first = cited.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "chunk_id")
    return first.select("query_id", "chunk_id", F.row_number().over(order).cast("bigint").alias("rank"))


def hybrid_local(
    queries: DataFrame,
    chunks: DataFrame,
    dense: DataFrame,
    sparse: DataFrame,
    graph: DataFrame | None,
    top_n: int = 6,
) -> DataFrame:
    """Fuse dense, sparse and graph rankings, then rerank the best max(4 n, 20) chunks.

    Rankings have query_id, chunk_id, rank; `queries` has query_id and text.
    """
    lists = [dense, sparse] + ([graph] if graph is not None else [])
    rankings = lists[0].select("query_id", "chunk_id", "rank")
    for other in lists[1:]:
        rankings = rankings.unionByName(other.select("query_id", "chunk_id", "rank"))
    fused = reciprocal_rank_fusion(rankings, ["query_id"], "chunk_id").withColumn("score", F.round("score", 12))
    candidates = top_per_query(fused, max(4 * top_n, 20), F.desc("score"), "chunk_id").withColumnRenamed("rank", "fused_rank")
    body = F.when(F.length("section") > 0, F.concat("section", F.lit("\n"), "text")).otherwise(F.col("text"))
    texts = chunks.select("chunk_id", "doc_id", "source", body.alias("body"))
    joined = candidates.join(texts, "chunk_id").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    return overlap_rerank(joined, "question", "body", top_n, "fused_rank").drop("question", "body")


def union_contexts(communities: DataFrame, local: DataFrame, local_n: int = 3) -> DataFrame:
    """Community hits followed by the first local chunks, as one context list per query."""
    left = communities.select(
        "query_id", F.lit(0).alias("part"), "rank", F.concat(F.lit("community:"), F.col("id").cast("string")).alias("context_id"),
        F.lit("community").alias("kind"), "score",
    )
    right = local.filter(F.col("rank") <= local_n).select(
        "query_id", F.lit(1).alias("part"), "rank", F.col("chunk_id").cast("string").alias("context_id"),
        F.lit("chunk").alias("kind"), F.col("rerank_score").alias("score"),
    )
    return left.unionByName(right)


def incremental_plan(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Each incoming document as new, changed or unchanged by checksum (doc_id, checksum)."""
    old = stored.select("doc_id", F.col("checksum").alias("_old"))
    action = (
        F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("checksum"), "unchanged").otherwise("changed")
    )
    return incoming.join(old, "doc_id", "left").withColumn("action", action).drop("_old")


def score_catalog(questions: DataFrame, catalog: DataFrame, top: int = 5, block: int = TERM_BLOCK) -> DataFrame:
    """Keyword score of every catalog table for each question, best `top` with a positive score.

    `catalog` lists table_name, kind (name, synonym, description, column, value) and text. Terms meet
    questions through a token or phrase join, never through all pairs.

    Questions are dealt out once. The catalog's terms come to them in blocks of about `block` rows, whole tables in each, so
    hits are counted and ranked where their question lies and are never shuffled.
    """
    from opsloom.functions.text import QUESTION

    # Names, descriptions and columns match on tokens. Of a description every token counts, so its rows are added up; of
    # the others an item counts once, however many of its tokens are met.
    items = catalog.filter(F.col("kind").isin("name", "description", "column"))
    words = items.select("table_name", "kind", "text", F.explode(F.array_distinct(tokenize(F.translate("text", "_", " "), QUESTION))).alias("w"))
    no_text = F.lit(None).cast("string")
    described = words.filter("kind = 'description'").groupBy("table_name", "w").agg((F.count(F.lit(1)) * 0.5).alias("points"))
    described = described.select("table_name", "w", F.lit("description").alias("kind"), no_text.alias("item"), "points")
    named = words.filter("kind <> 'description'").select(
        "table_name", "w", "kind", F.col("text").alias("item"), F.when(F.col("kind") == "name", 3.0).otherwise(1.0).alias("points")
    ).distinct()
    # Synonyms and values match as phrases: a trigram join narrows, then the phrase is checked.
    phrases = catalog.filter(F.col("kind").isin("synonym", "value")).select(
        "table_name", F.substring(F.lower("text"), 1, _GRAM).alias("w"), "kind", F.lower("text").alias("item"),
        F.when(F.col("kind") == "synonym", 2.5).otherwise(1.5).alias("points"),
    ).filter(F.length("item") >= _GRAM)
    terms = stored(described.unionByName(named).unionByName(phrases))
    blocks = max(1, -(-terms.count() // block))

    lowered = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    tagged = lambda found, token: F.transform(F.array_distinct(found), lambda w: F.struct(F.lit(token).alias("token"), w.alias("w")))
    partitions = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = questions.select("question_id", "text").repartition(partitions, "question_id")
    spots = q.select(
        "question_id", lowered.alias("lowered"),
        F.explode(F.concat(tagged(tokenize(F.col("text"), QUESTION), True), tagged(_char_grams(lowered), False))).alias("s"),
    ).select("question_id", "lowered", "s.token", "s.w")
    said = F.when(F.col("kind") == "synonym", F.contains("lowered", F.concat(F.lit(" "), F.col("item")))).when(
        F.col("kind") == "value", F.contains("lowered", F.col("item"))
    )
    once = F.col("kind").isin("name", "column")
    out = None
    for i in range(blocks):
        chosen = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("table_name"), F.lit(blocks)) == i)
        hits = spots.join(F.broadcast(chosen.withColumn("token", ~F.col("kind").isin("synonym", "value"))), ["token", "w"])
        points = (
            hits.filter(F.col("token") | said)
            .select("question_id", "table_name", F.when(once, F.struct("kind", "item")).alias("own"), "points")
            .groupBy("question_id", "table_name", "own")
            .agg(F.when(F.col("own").isNull(), F.sum("points")).otherwise(F.max("points")).alias("points"))
        )
        total = points.groupBy("question_id", "table_name").agg(F.sum("points").alias("score"))
        part = top_per_query(total.filter("score > 0"), top, F.desc("score"), "table_name", query="question_id")
        out = part if out is None else out.unionByName(part)
    return out if blocks == 1 else top_per_query(out.drop("rank"), top, F.desc("score"), "table_name", query="question_id")


_GRAM = 3


def _char_grams(text: Column) -> Column:
    """All character trigrams; every phrase of three or more characters starts with one of them."""
    last = F.greatest(F.length(text) - _GRAM + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(_GRAM)))


def few_shot_records(train: DataFrame, k: int = 3) -> DataFrame:
    """Each training question with its k nearest other examples (different SQL) as one JSON prompt part."""
    nearest = jaccard_top_k(
        train.select(F.col("id").alias("query_id"), F.col("question").alias("text"), "sql"),
        train.select(F.col("id").alias("example_id"), F.col("question").alias("text"), "sql"),
        k,
        exclude_same="sql",
    )
    shots = nearest.join(train.select(F.col("id").alias("example_id"), "question", "sql"), "example_id")
    gathered = shots.groupBy(F.col("query_id").alias("id")).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "question", "sql"))), lambda s: F.struct(s["question"].alias("question"), s["sql"].alias("sql")))).alias("shots")
    )
    return train.join(gathered, "id", "left").withColumn("shots", F.coalesce("shots", F.lit("[]")))


def relevant_sections(
    findings: DataFrame, claims: DataFrame, sections: DataFrame, k: int = 2, head: int | None = 500
) -> DataFrame:
    """Sections for each (claim, reviewer): those its findings cite, then the k best by BM25.

    The search text is the finding messages plus the first `head` characters of the note, as the
    reviewer prompt defines it; without a head the whole note takes part.
    """
    note = F.coalesce("clinical_note", F.lit(""))
    keys = ["claim_id", "reviewer"]
    cited = findings.groupBy(*keys, F.col("policy_section").alias("section_id")).agg(F.min("seq").alias("pos"))
    asked = (
        findings.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("m"))
        .join(claims.select("claim_id", "clinical_note"), "claim_id", "left")
        .select(
            F.struct(*keys).alias("query_id"),
            F.concat(
                F.array_join(F.transform("m", lambda x: x["message"]), " "), F.lit(" "),
                note if head is None else F.left(note, F.lit(head)),
            ).alias("text"),
        )
    )
    docs = sections.select("section_id", F.concat_ws(" ", "title", "text").alias("body"))
    hits = bm25_top_k(docs, asked, "section_id", "body", "text", k, NOTE)
    searched = hits.select("query_id.*", "section_id", (F.col("rank") + 10**9).alias("pos"))
    first = cited.unionByName(searched).groupBy(*keys, "section_id").agg(F.min("pos").alias("pos"))
    known = first.join(sections.select("section_id"), "section_id", "left_semi")
    order = Window.partitionBy(*keys).orderBy("pos", "section_id")
    return known.select(*keys, "section_id", F.row_number().over(order).cast("bigint").alias("position"))


def criterion_match(
    notes: DataFrame,
    note_keys: Sequence[str],
    note_text: str,
    criteria: DataFrame,
    criterion_id: str,
    criterion_text: str,
    minimum: float = 0.6,
) -> DataFrame:
    """First sentence of each note that holds the minimum share of a criterion's tokens.

    A matching sentence must share at least one of the criterion's rarest tokens (as many as it may
    miss, plus one), so only those take part in the join; the share is then checked exactly.
    """
    keys = list(note_keys)
    crit = criteria.select(criterion_id, F.array_distinct(tokenize(F.col(criterion_text), NOTE)).alias("c")).filter(
        F.size("c") > 0
    )
    sentences = notes.select(*keys, F.posexplode(note_sentences(F.col(note_text))).alias("pos", "sentence")).withColumn(
        "w", F.array_distinct(tokenize(F.col("sentence"), NOTE))
    )
    words = sentences.select(*keys, "pos", F.explode("w").alias("term"))
    rarity = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    per_term = crit.select(criterion_id, F.size("c").alias("size"), F.explode("c").alias("term")).join(rarity, "term", "left")
    order = Window.partitionBy(criterion_id).orderBy(F.coalesce("n", F.lit(0)), "term")
    may_miss = F.col("size") - F.ceil(F.col("size") * minimum)
    rare = per_term.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= may_miss + 1)
    pairs = words.join(rare.select(criterion_id, "term"), "term").select(criterion_id, *keys, "pos").distinct()
    checked = (
        pairs.join(crit, criterion_id)
        .join(sentences, [*keys, "pos"])
        .filter(F.size(F.array_intersect("c", "w")) / F.size("c") >= minimum)
    )
    return (
        checked.groupBy(criterion_id, *keys)
        .agg(F.min(F.struct("pos", "sentence")).alias("s"))
        .select(criterion_id, *keys, F.col("s.pos").cast("bigint").alias("pos"), "s.sentence")
    )
