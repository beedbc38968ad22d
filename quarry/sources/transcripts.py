"""JSON files of any nesting as flat documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..cluster import ship
from ..functions.documents import leaves


def flat_documents(text: str) -> Iterator[tuple[str, bool]]:
    """(body, whether it is a document) of a JSON text: of an object one, of an array one for each
    of its elements. Nested objects become dotted keys; what is no object isn't a document."""
    try:
        value = json.loads(text)
    except ValueError:
        yield text, False
        return
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, dict):
            yield json.dumps(dict(leaves(x)), ensure_ascii=False), True
        else:
            yield json.dumps(x, ensure_ascii=False), False


def transcripts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``file, place, body, fits`` of JSON files (or of files with a JSON text a line), to be
    inserted into a collection: ``fits`` is false of what isn't a document."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, k, body, fits) for f, text in zip(pdf["file"], pdf["value"]) for k, (body, fits) in enumerate(flat_documents(text))]
            yield pd.DataFrame(rows, columns=["file", "place", "body", "fits"])

    raw = spark.read.option("wholetext", not lines).text(path).selectExpr("_metadata.file_path as file", "value")
    return raw.where("trim(value) <> ''").mapInPandas(run, "file string, place int, body string, fits boolean")
