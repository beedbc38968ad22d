"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, html, langid, media, mixing, neardup, packing, quality, sharding, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.write_shards(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in a known language, and which."""
    return langid.identify(table(spark, sf_dir, "documents")).where("accepted")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents."""
    return toxicity.toxic_docs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have near-duplicates, by group."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass all rules."""
    return quality.quality(table(spark, sf_dir, "documents"), only_kept=True)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.page_media(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def chat_spans_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator under the one template whose spans SQL can compute."""
    return chat.format_chats(table(spark, sf_dir, "conversations"), {"chatml": chat.chatml})


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_packing, op2_sharding, op3_language_id, op4_chat_format, op5_toxicity, op6_html_text, op7_near_duplicates, op8_quality_rules, op9_media, op10_mixing, chat_spans_chatml, pipeline)}
ORACLES: dict[str, str] = {
    "op8_quality_rules": f"select * from ({quality.oracle()}) where keep",
    "op9_media": media.ORACLE,
    "chat_spans_chatml": chat.ORACLE,
}
