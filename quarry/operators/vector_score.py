"""Similarity of vectors, and its fusion with text scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, rescaled


def nearest(vectors: DataFrame, query: list[float], k: int | None = None, similarity: float = 0.7, rescale: bool = False, allowed: DataFrame | None = None, column: str = "embedding") -> DataFrame:
    """``ord, score``: the ``k`` vectors nearest to the query (all, if None) that reach
    ``similarity``; a document's score is the sum over its vectors among them."""
    if allowed is not None:
        vectors = vectors.join(allowed, "ord", "left_semi")
    s = cosine(F.col(column), query)
    found = vectors.select("ord", s.alias("s")).where("s is not null")
    if k is not None:
        found = found.orderBy(F.desc("s"), "ord").limit(k)
    found = found.select("ord", (rescaled(F.col("s")) if rescale else F.col("s")).alias("s")).where(F.col("s") >= similarity)
    return found.groupBy("ord").agg(F.sum("s").alias("score"))


def fused(text: DataFrame, vector: DataFrame) -> DataFrame:
    """Both kinds of scores, each divided by the greatest of all (the least counts as 0 or
    less), added up by document. Both are read once: the sums and the ends share an exchange."""
    both = text.select("ord", "score").unionByName(vector.select("ord", "score"))
    sums = both.groupBy("ord").agg(F.sum("score").alias("total"), F.count("*").alias("parts"), F.min("score").alias("least"), F.max("score").alias("most"))
    ends = sums.agg(F.least(F.min("least"), F.lit(0.0)).alias("low"), F.greatest(F.max("most"), F.lit(0.0)).alias("high"))
    end = ends.select(F.struct("low", "high")).scalar()
    scaled = (F.col("total") - F.col("parts") * end["low"]) / F.nullif(end["high"] - end["low"], F.lit(0.0))
    return sums.select("ord", F.coalesce(scaled, F.lit(0.0)).alias("score"))
