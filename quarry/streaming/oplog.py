"""An operation log, consumed exactly once into the latest state of each document."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import exists, filesystem, write_file
from ..sources.store import latest

#: Batches that are kept beside the compacted rows; beyond them all is compacted.
MAX_DELTAS = 8


class State:
    """The latest row of each key: compacted rows, the batches since, and ``current``, a file that
    names both and the newest batch. A batch writes its own rows alone; one that comes again
    finds its number and is left out. path: a folder, or URI, that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, key: str, offset: str):
        self.spark, self.uri, self.key, self.offset = spark, path.rstrip("/"), key, offset
        self.fs, self.path = filesystem(self.uri)
        self.fs.create_dir(self.path, recursive=True)

    def _current(self) -> dict:
        if not exists(self.fs, f"{self.path}/current"):
            return {"batch": -1, "base": None, "deltas": []}
        with self.fs.open_input_stream(f"{self.path}/current") as f:
            return json.loads(f.read())

    def version(self) -> int:
        return self._current()["batch"]

    def _rows(self, c: dict) -> DataFrame | None:
        names = [x for x in (c["base"], *c["deltas"]) if x]
        parts = [self.spark.read.parquet(f"{self.uri}/{x}") for x in names]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def read(self) -> DataFrame | None:
        rows = self._rows(self._current())
        return None if rows is None else latest(rows, self.key, self.offset)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Offsets at or below a key's own are replays and change nothing; ``deleted`` rows
        stay as such, so that an older insert can't bring a document back."""
        c = self._current()
        if batch_id <= c["batch"]:
            return
        name = f"d{batch_id}-{uuid.uuid4().hex}"
        latest(batch, self.key, self.offset).write.parquet(f"{self.uri}/{name}")
        c |= {"batch": batch_id, "deltas": [*c["deltas"], name]}
        if len(c["deltas"]) > MAX_DELTAS:
            base = f"v{batch_id}-{uuid.uuid4().hex}"
            latest(self._rows(c), self.key, self.offset).write.parquet(f"{self.uri}/{base}")
            self.clean()  # of the compaction before
            c = {"batch": batch_id, "base": base, "deltas": [], "old": [x for x in (c["base"], *c["deltas"]) if x]}
        write_file(self.fs, f"{self.path}/current", json.dumps(c).encode())

    def clean(self) -> None:
        """Deletes what the last compaction left for readers that began before it."""
        c = self._current()
        for x in c.get("old", []):
            if exists(self.fs, f"{self.path}/{x}"):
                self.fs.delete_dir(f"{self.path}/{x}")


def consume(stream: DataFrame, state: State, checkpoint: str, trigger: dict | None = None):
    """Starts the consumer; by default it takes all there is and ends."""
    return stream.writeStream.foreachBatch(lambda df, i: state.apply(df, i)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def consume_again(start, attempts: int = 5, first_wait: float = 1.0, sleep=None):
    """Runs ``start()``, a consumer, until it ends well; one that fails is started again from its
    checkpoint after a wait that doubles each time. The last failure is raised."""
    import time

    for k in range(attempts):
        query = start()
        try:
            query.awaitTermination()
            return query
        except Exception:  # noqa: BLE001 - whatever ended the stream, the checkpoint has what it did
            if k == attempts - 1:
                raise
            (sleep or time.sleep)(first_wait * 2**k)


def visible(base: DataFrame, delta: DataFrame, key: str, offset: str, deleted: str | None = None) -> DataFrame:
    """What readers see of a compacted base and the operations since."""
    rows = latest(base.unionByName(delta, allowMissingColumns=True), key, offset)
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else rows
