"""Text search as table operators.

No index engine: documents are tokenized with Column expressions, and
matching works on the token *vocabulary* (distinct tokens), which grows far
slower than the rows.  Fuzzy matching runs edit distance only between the
few query terms and the vocabulary, never row by row, and matched tokens
are joined back to the rows.  Ranking is BM25 computed from grouped counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import round4
from ..schema import TITLE_SYNONYMS
from ..session import reuse
from .filters import PayFilter, apply_filter

#: Unicode-aware standard tokenizer: runs of letters/digits
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
#: BM25 parameters
BM25_K1 = 1.2
BM25_B = 0.75


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(col) -> Column:
    """Lower-cased letter/digit runs (empty pieces removed)."""
    return F.filter(F.split(F.lower(_c(col)), TOKEN_SPLIT), lambda t: F.length(t) > 0)


def py_tokens(text: str) -> list[str]:
    """Tokenizer for the (small) query text on the driver; same rule."""
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t]


# ---------------------------------------------------------------------------
# Synonyms and a light stemmer
# ---------------------------------------------------------------------------

def _stem(t: Column) -> Column:
    """Light English suffix stripping (tokens of 4+ letters); ends are compared, as regular expressions cost ten times as much."""
    def ends(*ends_with: str) -> Column:
        out = t.endswith(ends_with[0])
        for e in ends_with[1:]:
            out |= t.endswith(e)
        return out

    def cut(n: int) -> Column:
        return F.substring(t, F.lit(1), F.length(t) - n)

    return (F.when(F.length(t) <= 3, t)
             .when(ends("ies"), F.concat(cut(3), F.lit("y")))
             .when(ends("ss", "us", "is"), t)
             .when(ends("ing") & (F.length(t) > 5), cut(3))
             .when(ends("ed") & (F.length(t) > 4), cut(2))
             .when(ends("ches", "shes", "xes", "zes"), cut(2))
             .when(ends("s"), cut(1))
             .otherwise(t))


def normalize_title(col) -> Column:
    """Lower case, synonym groups -> the group's first entry, stemming.

    Returns the normalised tokens joined by single spaces.
    """
    lower = s = F.lower(_c(col))
    for group in TITLE_SYNONYMS:
        canon = group[0]
        alts = sorted(group[1:], key=len, reverse=True)
        pattern = r"\b(" + "|".join(re.escape(a) for a in alts) + r")\b"
        s = F.regexp_replace(s, pattern, canon)
    # a title that holds no synonym stays as it is through all groups
    some = F.lit(False)
    for alt in sorted({a for group in TITLE_SYNONYMS for a in group[1:]}):
        some |= lower.contains(alt)
    toks = F.transform(tokenize(F.when(some, s).otherwise(lower)), _stem)
    return F.array_join(toks, " ")


def title_phrases() -> list[tuple[str, str]]:
    """(phrase, first entry of its group) of all synonyms; the longest phrases first, by words, then letters."""
    pairs = [(alt, group[0]) for group in TITLE_SYNONYMS for alt in group]
    return sorted(pairs, key=lambda p: (-p[0].count(" "), -len(p[0]), p[0]))


def title_tokens(col) -> Column:
    """H02 as an analyzer: tokens, longest synonym phrases replaced by their group, stems.

    Every token stands between two blanks, so a phrase matches whole tokens
    only and neighbours share none.  A matched phrase becomes a mark that no
    later phrase can match, so the longest phrase wins; the marks become the
    words of the group's first entry at the end.
    """
    groups = sorted({first for _, first in title_phrases()})
    s = F.concat(F.lit(" "), F.array_join(tokenize(col), "  "), F.lit(" "))
    for phrase, first in title_phrases():
        s = F.replace(s, F.lit(f" {phrase.replace(' ', '  ')} "), F.lit(f" #{groups.index(first)}# "))
    for i, first in enumerate(groups):
        s = F.replace(s, F.lit(f"#{i}#"), F.lit(first))
    return F.transform(F.filter(F.split(s, " +"), lambda t: F.length(t) > 0), _stem)


# ---------------------------------------------------------------------------
# Fuzzy and exact matching
# ---------------------------------------------------------------------------

def auto_fuzziness(term: str) -> int:
    """ES ``AUTO``: 0 edits up to 2 chars, 1 up to 5, else 2."""
    n = len(term)
    return 0 if n <= 2 else (1 if n <= 5 else 2)


def vocabulary(df: DataFrame, field: str) -> DataFrame:
    """Distinct tokens of a text column."""
    return df.select(F.explode(tokenize(field)).alias("token")).distinct()


def matching_tokens(vocab: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Vocabulary tokens within AUTO edit distance of any query term."""
    conds = []
    for t in terms:
        k = auto_fuzziness(t)
        near = (F.abs(F.length("token") - F.lit(len(t))) <= k)
        conds.append(near & (F.levenshtein(F.col("token"), F.lit(t), k) >= 0))
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    return vocab.where(cond)


#: matched tokens up to which rows are filtered by a literal list
LITERALS = 5000


def fuzzy_match(df: DataFrame, field: str, text: str, key: str = "id") -> DataFrame:
    """Rows whose ``field`` has a token close to any token of ``text``."""
    terms = py_tokens(text)
    if not terms:
        return df.where(F.lit(False))
    return with_tokens(df, tokenize(field), matching_tokens(vocabulary(df, field), terms))


def with_tokens(df: DataFrame, tokens: Column, matched: DataFrame) -> DataFrame:
    """Rows that hold a matched token.

    Up to ``LITERALS`` matched tokens filter the rows where they are scanned.
    More of them meet the distinct token lists by a join, and the lists the rows.
    """
    some = [r["token"] for r in matched.limit(LITERALS + 1).collect()]
    if len(some) <= LITERALS:
        # each token is looked up in the set; arrays_overlap would go through the whole list for every row
        return df.where(F.exists(tokens, lambda t: t.isin(some))) if some else df.where(F.lit(False))
    lists = df.select(F.array_distinct(tokens).alias("_l")).distinct()
    hits = lists.select("_l", F.explode("_l").alias("token")).join(matched, "token", "left_semi").select("_l").distinct()
    return df.withColumn("_l", F.array_distinct(tokens)).join(hits, "_l", "left_semi").drop("_l")


def exact_term(df: DataFrame, field: str, value: str) -> DataFrame:
    """Keyword equality."""
    return df.where(F.col(field) == F.lit(value))


# ---------------------------------------------------------------------------
# Ranked search
# ---------------------------------------------------------------------------

def bm25(docs: DataFrame, key: str, text: Column, query: str, limit: int = 20,
         k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Top ``limit`` documents by BM25 of the query terms, tie-break key.

    Document length is the token count; term statistics come from grouped
    counts restricted to the query terms, so only matching (doc, term) pairs
    are shuffled.  The per-term table has one row per query term.
    """
    terms = sorted(set(py_tokens(query)))
    if not terms:
        return docs.sparkSession.createDataFrame([], f"{key} {dict(docs.dtypes)[key]}, score double")
    wanted = F.array(*[F.lit(t) for t in terms])
    # one tokenizing pass over the whole texts: per document its length and
    # only the query-term tokens; both branches below read this written frame
    per_doc = reuse(docs.select(F.col(key), tokenize(text).alias("_t")).select(
        key, F.size("_t").alias("_dl"),
        F.filter("_t", lambda t: F.array_contains(wanted, t)).alias("_q")))
    stats = per_doc.agg(F.count(F.lit(1)).alias("_N"), F.avg("_dl").alias("_avgdl")) \
                   .withColumn("_one", F.lit(1))
    hits = (per_doc.select(key, "_dl", F.explode("_q").alias("term"))
                   .groupBy(key, "_dl", "term").agg(F.count(F.lit(1)).alias("_tf")))
    dfreq = hits.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).withColumn("_one", F.lit(1))
    dfreq = F.broadcast(dfreq.join(F.broadcast(stats), "_one"))  # one row per query term
    j = hits.join(dfreq, "term")
    idf = F.log(F.lit(1.0) + (F.col("_N") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    tf = F.col("_tf").cast("double")
    norm = tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("_dl") / F.col("_avgdl"))
    score = idf * tf * F.lit(k1 + 1) / norm
    # ranked on the score rounded to 4 places: equal scores summed in a
    # different order must tie (and fall back to the key), not differ by an ulp
    return (j.groupBy(key).agg(round4(F.sum(score)).alias("score"))
             .orderBy(F.col("score").desc(), F.col(key).asc()).limit(limit))


def search_pay(df: DataFrame, query: str, flt: PayFilter | None = None, limit: int = 20,
               key: str = "id") -> DataFrame:
    """Free-text search over employer, title and location + filter."""
    base = apply_filter(df, flt)
    text = F.concat_ws(" ", F.col("employer"), F.col("job_title"), F.col("location"))
    return bm25(base, key, text, query, limit)


# ---------------------------------------------------------------------------
# completion
# ---------------------------------------------------------------------------

def suggest(df: DataFrame, field: str, prefix: str, limit: int = 10) -> DataFrame:
    """Case-insensitive prefix completion, most frequent first."""
    return (df.where(F.lower(F.col(field)).startswith(prefix.lower()))
              .groupBy(F.col(field).alias("text"))
              .agg(F.count(F.lit(1)).cast("double").alias("score"))
              .orderBy(F.col("score").desc(), F.col("text").asc()).limit(limit))
