"""Records of searches and interactions."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import filesystem, write_file

SCHEMA = "id string, at timestamp, kind string, term string, mode string, count long, has_filters boolean, has_groups boolean, has_sort boolean, user_id string"


class EventLog:
    """Events as JSON lines; those of one log object are written together, ``every`` of them or when
    it is asked to :meth:`flush`. ``drain`` hands all over and forgets them. path: a folder, or
    URI, that the readers reach."""

    def __init__(self, path: str, every: int = 100):
        self.uri, self.every, self.held = path.rstrip("/"), every, []
        self.fs, self.path = filesystem(self.uri)
        self.fs.create_dir(self.path, recursive=True)

    def append(self, record: dict, kind: str = "search") -> None:
        self.held.append(json.dumps({"id": uuid.uuid4().hex, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "kind": kind, **record}))
        if len(self.held) >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.held:
            write_file(self.fs, f"{self.path}/{time.time_ns():020d}-{uuid.uuid4().hex}.json", "".join(x + "\n" for x in self.held).encode())
            self.held = []

    def _files(self) -> list[str]:
        self.flush()
        return sorted(x.path for x in self.fs.get_file_info(pafs.FileSelector(self.path)) if x.path.endswith(".json"))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).json(f"{self.uri}/*.json") if self._files() else spark.createDataFrame([], SCHEMA)

    def drain(self) -> Iterator[dict]:
        """The events, file by file; a file is deleted when all of it was taken."""
        for name in self._files():
            with self.fs.open_input_stream(name) as f:
                lines = f.read().splitlines()
            yield from map(json.loads, lines)
            self.fs.delete_file(name)


def by_day(events: DataFrame, at: str, kind: str, value: str | None = None) -> DataFrame:
    """``day, kind, n`` and the total of a value."""
    total = [F.round(F.sum(value), 4).alias("total")] if value else []
    return events.groupBy(F.to_date(at).alias("day"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), *total)
