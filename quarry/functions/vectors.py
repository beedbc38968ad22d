"""Vectors as arrays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


#: Components up to which a sum of products is unrolled; more would be too long for generated code.
UNROLLED = 128


def cosine(a: Column, b: list[float]) -> Column:
    """Cosine similarity with a fixed vector; null where the lengths differ or a vector is all
    zero. Sums of products of short vectors are unrolled, which keeps the scan inside generated
    code; those of longer ones run through Arrow, a batch at a time."""
    size = sum(x * x for x in b) ** 0.5
    fits = (F.size(a) == len(b)) & F.lit(size > 0)
    if len(b) > UNROLLED:
        return F.when(fits, _cosines(b)(F.when(fits, a)))
    products = F.lit(0.0)
    squares = F.lit(0.0)
    for i, x in enumerate(b):
        v = F.get(a, F.lit(i)).cast("double")
        products = products + v * F.lit(float(x))
        squares = squares + v * v
    return F.when(fits & (squares > 0), products / (F.sqrt(squares) * F.lit(size or 1.0)))


def _cosines(b: list[float]):
    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        import numpy as np

        query = np.asarray(b, dtype=np.float64)
        out = np.full(len(rows), np.nan)
        at = np.flatnonzero(rows.notna().to_numpy())
        if len(at):
            m = np.stack(rows.iloc[at].to_list()).astype(np.float64)
            norms = np.linalg.norm(m, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[at] = np.where(norms > 0, m @ query / (norms * np.linalg.norm(query)), np.nan)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run


def rescaled(similarity: Column, low: float = 0.7) -> Column:
    """Spreads similarities from ``low`` to 1 over 0 to 1, as models whose texts are all alike need."""
    return (F.greatest(F.least(similarity, F.lit(1.0)), F.lit(low)) - low) / (1 - low)
