"""Media columns: a data source over archives of payloads."""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import col, filesystem, shared_path, ship

SCHEMA = "archive string, member string, offset long, size long, payload binary, error string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
_LOCAL, _CENTRAL, _END, _END64, _LOC64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


class Member(NamedTuple):
    name: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int


def read_directory(f: pa.NativeFile, size: int) -> list[Member]:
    """A ZIP file's central directory, ZIP64 included; nothing but its end is read."""
    tail_at = max(0, size - 65557 - 20)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, n, length, start, _ = struct.unpack("<4HIIH", tail[at + 4 : at + 22])
    if at >= 20 and tail[at - 20 : at - 16] == _LOC64:
        (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        f.seek(end64)
        head = f.read(56)
        n, length, start = struct.unpack("<QQQ", head[32:56])
    f.seek(start)
    directory, out, p = f.read(length), [], 0
    for _ in range(n):
        if directory[p : p + 4] != _CENTRAL:
            raise ValueError("a broken central directory")
        method, _, _, crc, packed, full, n_name, n_extra, n_comment = struct.unpack("<HHHIIIHHH", directory[p + 10 : p + 34])
        (offset,) = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            kind, m = struct.unpack("<HH", extra[q : q + 4])
            if kind == 1:
                wide = list(struct.unpack(f"<{m // 8}Q", extra[q + 4 : q + 4 + m // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            q += 4 + m
        out.append(Member(name, offset, packed, full, crc, method))
        p += 46 + n_name + n_extra + n_comment
    return out


def read_member(f: pa.NativeFile, m: Member) -> bytes:
    f.seek(m.offset)
    head = f.read(30)
    if head[:4] != _LOCAL:
        raise ValueError("no member starts here")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    f.seek(m.offset + 30 + n_name + n_extra)
    data = f.read(m.packed)
    if m.method == 8:
        engine = zlib.decompressobj(-15)
        data = engine.decompress(data, m.size + 1)  # no more than a byte over what it should be
    elif m.method:
        raise ValueError(f"compression method {m.method} is not known")
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise ValueError("the payload doesn't match its checksum")
    return data


class Range(InputPartition):
    def __init__(self, path: str, size: int, low: int, high: int):
        self.path, self.size, self.low, self.high = path, size, low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.split = int(options.get("partitionbytes", 32 << 20))
        self.retries = int(options.get("retries", 3))
        self.batch = int(options.get("batchbytes", 8 << 20))

    def partitions(self) -> list[Range]:
        """Byte ranges of all archives under the folder. Only names and sizes are listed here;
        each task reads the directory of its own archive."""
        fs, path = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        out = []
        for x in sorted((x for x in found if x.is_file and x.path.endswith(".zip")), key=lambda x: x.path):
            parts = max(1, -(-x.size // self.split))
            out += [Range(x.path, x.size, x.size * i // parts, x.size * (i + 1) // parts) for i in range(parts)]
        return out

    def again(self, work, reopen):
        """(result, error) of ``work(file)``, tried ``retries`` times more on a file opened anew."""
        error = None
        for attempt in range(self.retries + 1):
            try:
                return work(reopen(attempt > 0)), None
            except (OSError, ValueError, EOFError, zlib.error, struct.error) as e:
                error = f"{type(e).__name__}: {e}"[:200]
                if attempt < self.retries:
                    time.sleep(0.01 * 2**attempt)
        return None, error

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        """The members that start in the range, by offset. A member that fails is read anew,
        from its own offset, ``retries`` times; then its payload is null and its error says
        why, and the others are unaffected. An archive whose directory can't be read is one
        row with an error, from its first range."""
        if partition is None:  # a folder without archives
            return
        fs, root = filesystem(self.path)
        name = partition.path.removeprefix(root.rstrip("/") + "/")
        held: list = [None]

        def reopen(anew: bool):
            if held[0] is None or anew:
                if held[0] is not None:
                    held[0].close()
                held[0] = fs.open_input_file(partition.path)
            return held[0]

        members, error = self.again(lambda f: read_directory(f, partition.size), reopen)
        if members is None:
            if partition.low == 0:
                yield _batch([(name, None, None, None, None, error)])
            return
        rows, bytes_held = [], 0
        for m in sorted((m for m in members if partition.low <= m.offset < partition.high and not m.name.endswith("/")), key=lambda m: m.offset):
            payload, error = self.again(lambda f, m=m: read_member(f, m), reopen)
            rows.append((name, m.name, m.offset, m.size, payload, error))
            bytes_held += len(payload or b"")
            if bytes_held >= self.batch:
                yield _batch(rows)
                rows, bytes_held = [], 0
        if held[0] is not None:
            held[0].close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), _ARROW)], schema=_ARROW)


class ArchiveSource(DataSource):
    """``spark.read.format("quarry_archive").load(folder)``: a row a member of each ZIP file
    below the folder. Options: partitionBytes, retries, batchBytes."""

    @classmethod
    def name(cls) -> str:
        return "quarry_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        context = TaskContext.get()
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        final = f"{path}/part-{context.partitionId():06d}.zip"
        part = f"{path}/part-{context.partitionId():06d}-{context.taskAttemptId()}.tmp"
        n = 0
        with fs.open_output_stream(part) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            for batch in batches:
                for member, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                    z.writestr(zipfile.ZipInfo(member), payload.as_buffer().to_pybytes(), zipfile.ZIP_DEFLATED, 1)
                    n += 1
        fs.move(part, final) if n else fs.delete_file(part)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64())], names=["archive", "members"])

    return run


def write_archives(df: DataFrame, member, payload, folder: str | None = None) -> str:
    """Writes a ZIP file a partition into a folder that all executors share and returns the
    folder. Repeated names are members of their own. A task writes under a name of its attempt and renames it when complete, so a
    repeated attempt replaces the same archive. Rows of a null payload or name are left out.
    """
    spark = df.sparkSession
    ship(spark)
    folder = folder or shared_path(spark, "archives")
    rows = df.select(member.cast("string").alias("member"), payload.cast("binary").alias("payload")).where("member is not null and payload is not null")
    rows.mapInArrow(_write(folder), "archive string, members long").agg(F.sum("members")).collect()
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    return folder


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Columns ``archive, member, offset, size, payload, error``; archive is the path below the
    folder. Repeated member names are rows of their own; an empty payload is empty and not
    null; a folder without archives gives an empty table. A member that is broken, or inflates
    to more than its stated size, and an archive without a readable directory have an error and
    no payload. A member is held in memory as a whole, so the largest must fit a worker."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("quarry_archive").options(**{k: str(v) for k, v in options.items()}).load(folder)


def page_media(pages: DataFrame) -> DataFrame:
    """The bodies of ``pages`` as members of archives, read back: ``page_id, size,
    payload_md5, kind, error``. Kind is told from the payload's first bytes. Null pages and null
    ids are left out, repeated rows are members each, an empty table gives no rows; other
    columns are left out."""
    folder = write_archives(pages, F.concat(col("page_id").cast("string"), F.lit(".html")), col("html"))
    got = read_archives(pages.sparkSession, folder)
    head = F.lower(F.decode(F.substring("payload", 1, 14), "ISO-8859-1"))
    kind = F.when(F.col("payload").isNull(), None).when(head.startswith("<!doctype html") | head.startswith("<html"), "text/html").when(F.length("payload") == 0, "empty").otherwise("application/octet-stream")
    return got.select(F.split_part("member", F.lit("."), F.lit(1)).cast("long").alias("page_id"), F.col("size"), F.md5("payload").alias("payload_md5"), kind.alias("kind"), "error")


ORACLE = """
select page_id, octet_length(encode(html))::bigint as size, md5(html) as payload_md5,
       case when starts_with(lower(html), '<!doctype html') or starts_with(lower(html), '<html') then 'text/html'
            when html = '' then 'empty' else 'application/octet-stream' end as kind,
       cast(null as varchar) as error
from pages where html is not null and page_id is not null
"""
