"""BM25F over postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ENGLISH, STEM_CUT, STEM_TAIL, python_tokens, stem
from ..plans.params import Request
from ..sources.index import Index

K, B = 1.2, 0.75
#: Weight of a term that is the token itself over one that it only begins, or resembles.
EXACT_BOOST = 1.5
#: A token's share in a document below which it counts as absent.
LEAST = 1.2e-38
#: Tokens of a query up to which each has a column.
WIDE = 32


def query_tokens(term: str, exact: bool, language: str = ENGLISH) -> list[str]:
    """The words of a query, each followed by its stem unless only exact words count; a query
    without words has the one token that is empty."""
    out = []
    for t in python_tokens(term):
        out.append(t)
        if not exact and stem(t, language) != t:
            out.append(stem(t, language))
    return list(dict.fromkeys(out)) or [""]


def matches(token: str, exact: bool, tolerance: int | None, term: str = "term") -> Column:
    """Whether a term of the vocabulary answers a token: equal, beginning with it, or, with a
    tolerance, no more edits away than that; a tolerance of 0 asks for the term itself."""
    c = F.col(term)
    if exact or tolerance == 0:
        return c == F.lit(token)
    if tolerance:
        near = F.length(c).between(len(token) - tolerance, len(token) + tolerance) & (F.levenshtein(c, F.lit(token), tolerance) >= 0)
        return near | (c == F.lit(token))
    return c.startswith(token)


def likely(token: str, tolerance: int | None, word: str = "word") -> Column:
    """What is true of every word that answers a token, itself or by its stem, and quick to ask."""
    if tolerance:
        return F.length(word).between(len(token) - tolerance, len(token) + tolerance + STEM_CUT)
    return F.col(word).startswith(token[: max(0, len(token) - STEM_TAIL)])


def properties_of(index: Index, properties: list[str] | None) -> list[str]:
    """The text fields to search: all, or those of the list that exist."""
    return sorted(index.texts) if properties is None else [p for p in properties if p in index.texts]


def match_all(index: Index, fields: list[str], allowed: DataFrame | None) -> DataFrame:
    """Every document that has a token in the fields, at score 1."""
    ids = index.lengths.where(F.col("field").isin(fields)).select("ord").distinct()
    ids = ids if allowed is None else ids.join(allowed, "ord", "left_semi")
    return ids.withColumn("score", F.lit(1.0))


def text_scores(index: Index, request: Request, allowed: DataFrame | None = None) -> DataFrame:
    """``ord, score`` of the documents that match.

    tf / (1 - b + b * len / average len) * boost * EXACT_BOOST if exact, summed over fields
    and terms, is S of a token in a document; its document frequency is that among the
    documents ``allowed`` by the filter, N that of the index; the score is the sum over
    tokens of idf * (k + 1) * S / (k + S). Documents must match at least
    floor(tokens * threshold) tokens. Unless only exact words count, words are also found by
    their stem. Sums are of doubles in any order: scores agree to some twelve digits, and
    scores that agree to six decimals are ties.
    """
    fields = properties_of(index, request.properties)
    tokens = query_tokens(request.term, request.exact, index.language)
    if tokens == [""]:
        none = index.docs.select("ord", F.lit(1.0).alias("score")).limit(0)
        return none if request.exact else match_all(index, fields, allowed)
    conditions = [matches(t, request.exact, request.tolerance) for t in tokens]
    some = lambda test: lambda c: reduce(lambda a, b: a | b, [test(t, c) for t in tokens])
    hits = index.hits(fields, some(lambda t, c: matches(t, request.exact, request.tolerance, c)), some(lambda t, c: likely(t, request.tolerance, c)), not request.exact)
    if allowed is not None:
        hits = hits.join(allowed, "ord", "left_semi")
    weight = F.lit(1.0)
    for f in fields:
        average = index.average_lengths.get(f) or 1.0
        boost = float(request.boost.get(f, 1.0))
        weight = F.when(F.col("field") == f, boost * F.col("tf") / (1 - B + B * F.col("len") / average)).otherwise(weight)
    itself = lambda t: (F.col("term") == t) & ~F.col("stemmed")
    boosts = [F.lit(1.0) if request.exact else F.when(itself(t), EXACT_BOOST).otherwise(1.0) for t in tokens]
    needed = max(1, int(len(tokens) * (request.threshold or 0.0)))
    if len(tokens) <= WIDE:
        return _wide(hits, [F.when(c, weight * x) for c, x in zip(conditions, boosts)], index.count, needed)
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("token"), x.alias("x"))) for i, (c, x) in enumerate(zip(conditions, boosts))]))
    per_hit = hits.select("ord", weight.alias("ntf"), F.explode(found).alias("m")).select("ord", F.col("m.token").alias("token"), (F.col("ntf") * F.col("m.x")).alias("ntf"))
    s = per_hit.groupBy("ord", "token").agg(F.sum("ntf").alias("s")).where(F.col("s") > LEAST)
    df = s.groupBy("token").agg(F.count("*").alias("df"))  # a row a token of the query
    scored = s.join(F.broadcast(df), "token").groupBy("ord").agg(F.sum(_bm25(F.col("s"), F.col("df"), index.count)).alias("score"), F.count("*").alias("n"))
    return scored.where(F.col("n") >= needed).select("ord", "score")


def _bm25(s: Column, df: Column, documents: int) -> Column:
    return F.log1p((documents - df + 0.5) / (df + 0.5)) * (K + 1) * s / (K + s)


def _wide(hits: DataFrame, shares: list[Column], documents: int, needed: int) -> DataFrame:
    """Scores of few tokens, a column a token: the hits of a document meet once, and how many
    documents have each token is a subquery over the same exchange."""
    names = [f"s{i}" for i in range(len(shares))]
    sums = hits.groupBy("ord").agg(*[F.sum(x).alias(n) for n, x in zip(names, shares)])
    has = [F.col(n) > LEAST for n in names]
    df = sums.agg(*[F.count_if(h).alias(n) for n, h in zip(names, has)]).select(F.struct(*names)).scalar()
    score = reduce(lambda a, b: a + b, [F.when(h, _bm25(F.col(n), df[n], documents)).otherwise(0.0) for n, h in zip(names, has)])
    got = reduce(lambda a, b: a + b, [F.when(h, 1).otherwise(0) for h in has])
    return sums.where(got >= needed).select("ord", score.alias("score"))


def field_bm25(index: Index, term: str, fields: list[str] | None = None) -> DataFrame:
    """``ord, score``: BM25 of each field on its own, added up."""
    out = None
    for f in fields or sorted(index.texts):
        part = text_scores(index, Request(term, exact=True, properties=[f]))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("ord").agg(F.sum("score").alias("score"))
