"""Vectors of texts by any encoder, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from .text import chunks

#: What models of a family expect before a query and before a passage.
PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", ""), "plain": ("", "")}
#: Similarities of these families are spread (vectors.rescaled).
RESCALED = {"e5"}
MAX_BYTES = 10 << 20
#: Numbers of vectors after which a worker hands them on.
BATCH_FLOATS = 1 << 20

Encoder = Callable[[list[str]], list[list[float]]]


def for_query(family: str, text: str) -> str:
    return PREFIXES[family][0] + text


def passage(df: DataFrame, paths: list[str] | None, skip: tuple[str, ...] = ("id",)) -> Column:
    """The text of a document to embed: chosen paths joined by ``. ``, or all its string columns
    by spaces, cut at MAX_BYTES of characters."""
    if paths is not None:
        return F.substring(F.concat_ws(". ", *[F.col(p).cast("string") for p in paths]), 1, MAX_BYTES)
    return F.concat_ws(" ", *[F.col(f"`{n}`") for n, t in df.dtypes if t == "string" and n not in skip])


def embed(df: DataFrame, key: str, text: Column, make_encoder: Callable[[], Encoder], family: str = "plain", max_tokens: int = 512, batch: int = 64) -> DataFrame:
    """``key, chunk, embedding``: each text in windows of ``max_tokens`` words that overlap by
    2 %. ``make_encoder`` runs once a partition, so a model is loaded there and not sent.
    Texts without words have no vectors."""
    prefix = PREFIXES[family][1]
    # Outer, as Spark would otherwise ask first whether there are windows and so make them anew.
    parts = df.select(F.col(key).alias("key"), F.posexplode_outer(chunks(text, max_tokens)).alias("chunk", "text")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for rows in batches:
            texts, done, start = rows.column("text").to_pylist(), [], 0
            for i in range(0, len(texts), batch):
                done.append(pa.array(list(encoder([prefix + t for t in texts[i : i + batch]])), pa.list_(pa.float32())))
                end = min(i + batch, len(texts))
                if end == len(texts) or sum(len(x.values) for x in done) >= BATCH_FLOATS:
                    some = rows.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays([some.column("key"), some.column("chunk"), pa.concat_arrays(done)], ["key", "chunk", "embedding"])
                    done, start = [], end

    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]
    return parts.mapInArrow(run, f"key {kind}, chunk int, embedding array<float>").withColumnRenamed("key", key)
