"""Tokens, sentences, overlap scores and small extractions as JVM-side columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stopwords of the three vocabularies.
CORPUS_STOPWORDS = (
    "a an the and or but if then else of to in on at by for with from into over under about as is are was were be been "
    "being it its this that these those there here what which who whom whose when where why how do does did doing have "
    "has had having can could should would may might must will shall not no nor so than too very just also only own same "
    "such both each few more most other some any all i you he she we they me him her us them my your his our their "
    "between through during before after above below up down out off again further once tell give explain describe show "
    "list"
).split()
QUESTION_STOPWORDS = (
    "a an the and or of to in on at by for with from is are was were be what which who how many much show list give me "
    "per each all their there that this these those do does did have has"
).split()
NOTE_STOPWORDS = (
    "a an the and or of to in on at by for with from is are was were be been has have had this that these those it its as "
    "not no than at least such when which who per"
).split()


@dataclass(frozen=True)
class Dialect:
    pattern: str
    stopwords: tuple[str, ...]
    stem: str  # "corpus", "question" or "none"
    stop_before_stem: bool


CORPUS = Dialect(r"[a-z0-9]+(?:[-.][a-z0-9]+)*", tuple(CORPUS_STOPWORDS), "corpus", False)
QUESTION = Dialect(r"[a-z0-9]+", tuple(QUESTION_STOPWORDS), "question", True)
NOTE = Dialect(r"[a-z0-9]+", tuple(NOTE_STOPWORDS), "none", True)


def stem(token: Column, rule: str) -> Column:
    """Plural endings only: 'ies' becomes 'y', a final 's' goes, short words stay."""
    n = F.length(token)
    ies = F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y"))
    cut = F.substring(token, F.lit(1), n - 1)
    # Most tokens have no such ending, so that is asked first.
    if rule == "corpus":
        keep = ~token.endswith("s") | token.endswith("ss") | token.endswith("us") | token.endswith("is")
        return F.when(keep | (n <= 4), token).when(token.endswith("ies"), ies).otherwise(cut)
    if rule == "question":
        return (
            F.when(~token.endswith("s") | token.endswith("ss"), token)
            .when(token.endswith("ies") & (n > 4), ies)
            .when(n > 3, cut)
            .otherwise(token)
        )
    return token


def stem_word(word: str, rule: str) -> str:
    """The same as `stem` for one word in a task."""
    n = len(word)
    if rule == "none" or not word.endswith("s") or word.endswith("ss"):
        return word
    if rule == "corpus":
        if n <= 4 or word.endswith(("us", "is")):
            return word
        return word[:-3] + "y" if word.endswith("ies") else word[:-1]
    if word.endswith("ies") and n > 4:
        return word[:-3] + "y"
    return word[:-1] if n > 3 else word


class Terms(dict):
    """The token that `tokenize` makes of one word in a task, empty for a stopword; looked up once for each word."""

    def __init__(self, dialect: Dialect) -> None:
        super().__init__()
        self._stop, self._rule, self._first = frozenset(dialect.stopwords), dialect.stem, dialect.stop_before_stem

    def __missing__(self, word: str) -> str:
        term = stem_word(word, self._rule)
        self[word] = term = "" if (word if self._first else term) in self._stop else term
        return term


def tokenize(text: Column, dialect: Dialect = CORPUS, drop_stopwords: bool = True) -> Column:
    """Tokens in order of appearance."""
    words = F.regexp_extract_all(F.lower(text), F.lit(dialect.pattern), 0)
    keep = lambda w: ~w.isin(*dialect.stopwords)
    stems = lambda ws: ws if dialect.stem == "none" else F.transform(ws, lambda w: stem(w, dialect.stem))
    if not drop_stopwords:
        return stems(words)
    return stems(F.filter(words, keep)) if dialect.stop_before_stem else F.filter(stems(words), keep)


def explode_terms(df: DataFrame, text: str, dialect: Dialect = CORPUS) -> DataFrame:
    """One row per token of `tokenize`, as `term`, beside the other columns.

    Words are split off first, so that stems and stopwords are plain columns of compiled code, not functions over arrays.
    """
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(dialect.pattern), 0)).alias("_word")
    rows = df.select(*[c for c in df.columns if c != text], words)
    keep = lambda w: ~F.col(w).isin(*dialect.stopwords)
    if dialect.stop_before_stem:
        rows = rows.filter(keep("_word"))
    rows = rows.withColumn("term", stem(F.col("_word"), dialect.stem)).drop("_word")
    return rows if dialect.stop_before_stem else rows.filter(keep("term"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_sentences(text: Column) -> Column:
    """Sentences end at .!? before a capital, digit, quote or bracket."""
    parts = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def note_sentences(text: Column) -> Column:
    parts = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def overlap_score(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of distinct query terms found in the text; 0 without query terms."""
    terms = F.array_distinct(query_tokens)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, text_tokens)) / F.size(terms))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def extract_tag(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)


def extract_fenced(text: Column, language: str = "sql") -> Column:
    """Body of the first fenced code block of a language, else the whole trimmed text."""
    found = F.regexp_extract(text, rf"(?s)```(?:{language})?\s*(.*?)```", 1)
    return F.when(found != "", strip(found)).otherwise(strip(text))


def citations(text: Column) -> Column:
    """Distinct numbers cited as [n], in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), 1)).cast("array<int>")


def normalize_entity_name(name: Column) -> Column:
    """Lower case, without marks and outer or repeated spaces. Names of plain words need no more than the lower case."""
    kept = F.regexp_replace(F.lower(name), r"(?U)[^\w\s-]", "")
    plain = F.rlike(name, F.lit(r"\A[A-Za-z0-9_-]+(?: [A-Za-z0-9_-]+)*\z"))
    return F.when(plain, F.lower(name)).otherwise(strip(F.regexp_replace(kept, r"\s+", " ")))


def normalize_space(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, r"\s+", " ")))


def verbatim_quote(note: Column, quote: Column) -> Column:
    """A non-blank quote that occurs in the note, up to case and spacing."""
    return (strip(quote) != "") & F.contains(normalize_space(note), normalize_space(quote))


def embedding_text(title: Column, section: Column, body: Column) -> Column:
    """Heading path above the text, so that short chunks keep the context of their section."""
    path = heading_path(title, section)
    return F.when(path != "", F.concat(path, F.lit("\n\n"), body)).otherwise(body)


def heading_path(title: Column, section: Column) -> Column:
    joined = F.concat_ws(" > ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")))
    return F.when(F.startswith(section, title), section).otherwise(joined)


def as_fact(source: Column, kind: Column, target: Column, description: Column) -> Column:
    tail = F.when(F.length(description) > 0, F.concat(F.lit(" ("), description, F.lit(")"))).otherwise("")
    return F.concat(source, F.lit(" -["), kind, F.lit("]-> "), target, tail)


# Phrases that mark an abstention, and the hints of the question router.
ABSTAIN = (
    r"(?i)(does not contain|doesn't contain|not (?:enough|sufficient) information|no information|"
    r"cannot (?:find|determine|answer)|not (?:mentioned|specified|provided|available))"
)
GLOBAL_HINTS = ("overall", "themes", "main topics", "summarize", "summary of", "across the", "big picture")
WEB_HINTS = ("latest", "today", "this week", "current price", "news", "right now")
DIRECT_HINTS = ("hello", "hi ", "hey", "thanks", "thank you", "who are you", "what can you do")


def abstained(answer: Column) -> Column:
    return answer.rlike(ABSTAIN)


def _mentions(text: Column, hints: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for hint in hints:
        out = out | F.contains(text, F.lit(hint))
    return out


def route_question(question: Column) -> Column:
    """direct, web, global or local."""
    lowered = F.concat(F.lit(" "), F.lower(question), F.lit(" "))
    short = F.size(tokenize(question)) <= 3
    return (
        F.when(_mentions(lowered, DIRECT_HINTS) & short, "direct")
        .when(_mentions(lowered, WEB_HINTS), "web")
        .when(_mentions(lowered, GLOBAL_HINTS), "global")
        .otherwise("local")
    )


def sub_questions(question: Column) -> Column:
    """Up to three parts of a compound question that hold at least two terms; none for a simple one."""
    raw = F.filter(F.split(question, r"\?\s+|\band how\b|\band what\b|;"), lambda p: strip(p) != "")
    parts = F.transform(raw, lambda p: F.regexp_replace(p, r"^[ ?,.]+|[ ?,.]+$", ""))
    usable = F.filter(parts, lambda p: F.size(tokenize(p)) >= 2)
    return F.when((F.size(raw) > 1) & (F.size(usable) > 1), F.slice(usable, 1, 3)).otherwise(
        F.array().cast("array<string>")
    )


def unsupported_sentences(answer: Column, evidence_tokens: Column, minimum: float = 0.6) -> Column:
    """Answer sentences with less than the minimum share of their tokens in the evidence."""
    clean = split_sentences(F.regexp_replace(answer, r"\[[^\]]{1,6}\]", ""))

    def weak(sentence: Column) -> Column:
        words = tokenize(sentence)
        hits = F.size(F.filter(words, lambda w: F.array_contains(evidence_tokens, w)))
        return (F.size(words) > 0) & (hits < F.size(words) * minimum)

    return F.filter(clean, weak)
