"""What the operators share: columns by name, samples, workers that give memory back."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import filesystem, materialize, shared_path, ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        new, k = f"__{n}", 0
        while new.lower() in taken:
            new, k = f"__{n}_{k}", k + 1
        taken.add(new.lower())
        out.append(new)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> str:
    """A column's type as workers' results state it."""
    return df.select(col(name)).schema[0].dataType.simpleString()


def text_of(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def hash_sample(df: DataFrame, id_col: str, rows: int, seed: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows, chosen by a seeded hash of the id; all rows where there are no more."""
    total = df.count() if total is None else total
    if total <= rows:
        return df
    cut = int(rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(col(id_col), F.lit(seed)), F.lit(1 << 30)) < cut)


def tidy(run):
    """For functions over batches: a worker that Spark keeps for later tasks gives its free
    memory back when a partition is done."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
