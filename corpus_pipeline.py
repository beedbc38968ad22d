"""A corpus pipeline: documents in, packs out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import langid, mixing, neardup, packing, quality
from quarry.llm.common import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no quality rule rejects. Null and empty texts have no words and go; rows with
    null ids and repeated rows are judged each on its own."""
    return quality.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in a language that the corpus has labelled text of. Rows whose ``lang`` is null are
    judged by their text like others; where all are null none goes; texts without words go."""
    return langid.accepted(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least id, and one of each id; rows with
    a null id all stay."""
    return neardup.without_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by source and language, to tempered weights; a row a use. Rows without either are never
    chosen; ties in the seeded order are of one cell and chosen together."""
    return mixing.mix(docs, rows=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in packs of tokens, a row a piece; every use of a document is packed on
    its own. Texts without tokens have no place."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", good), ("language", known_language), ("near_duplicates", one_of_each), ("mixing", mixed), ("packing", packed)]
#: Language models, consistent sampling and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i < len(STAGES) - 1:
            df = materialize(df, name)
    return df
