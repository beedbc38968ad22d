"""What jobs share: the folder that all executors reach, written tables, shipped code."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "quarry.shipped"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``. Where it is unset, a
    local session (tests) gets a folder of its own and any other one is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if urlparse(path).scheme == "file":
        return pafs.LocalFileSystem(), unquote(urlparse(path).path)
    return pafs.FileSystem.from_uri(path)


def exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def write_file(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Writes beside the place and moves there, so that readers see the old or the new whole."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` into the shared folder and reads it back, so that a lost
    executor costs a read and not a new run of what came before."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes what this application's jobs wrote into the shared folder. Results that were
    read from there can't be read again afterwards."""
    fs, path = filesystem(session_dir(spark))
    if exists(fs, path):
        fs.delete_dir(path)
    spark.conf.unset(_SHIPPED)


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers, once a session."""
    if spark.conf.get(_SHIPPED, "") == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = shared_path(spark, "source") + ".zip"
    fs, at = filesystem(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
