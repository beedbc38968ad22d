"""Sharding: a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, materialize, shared_path, ship, tidy

#: Rows that a broadcast of keys of repeated rows may have; what is repeated less isn't dealt out.
MOST_HOT, LEAST_COPIES = 1_000_000, 1000
#: Copies that one task makes anew at a time.
BLOCK = 10_000
#: Bytes of a batch that goes back to Spark.
BATCH_BYTES = 8 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of ``range(n)``, each equally likely."""
    order = np.arange(n)
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(max(0, n - 1))
    at = (draws * np.arange(n, 1, -1)).astype(np.int64)
    out = order.tolist()
    for i, j in zip(range(n - 1, 0, -1), at.tolist()):
        out[i], out[j] = out[j], out[i]
    return np.asarray(out, dtype=np.int64)


def shuffle_buckets(shard: str, key: str, position: str, seed: int):
    """For mapInArrow: a partition is a bucket. It is put in the order of its rows' keys,
    which no arrival order can change, then shuffled."""

    def run(batches):
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held)
        del held
        for bucket in pc.unique(whole[shard]).to_pylist():
            rows = whole.filter(pc.equal(whole[shard], bucket))
            order = pc.sort_indices(rows[key]).to_numpy()[fisher_yates(rows.num_rows, seed, bucket)]
            step = max(1, int(rows.num_rows * BATCH_BYTES / max(1, rows.nbytes)))
            for i in range(0, rows.num_rows, step):
                part = rows.take(pa.array(order[i : i + step])).drop_columns([key])
                part = part.append_column(position, pa.array(np.arange(i, i + part.num_rows), pa.int64()))
                yield from part.combine_chunks().to_batches()

    return run


def _hashable(field: T.StructField) -> Column:
    """A column as what can be hashed: maps and variants, wherever they are, as JSON."""
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(col(field.name))) if "map<" in kind or "variant" in kind else col(field.name)


def _bytes(field: T.StructField) -> Column:
    """About how many bytes a value takes."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col(field.name)), F.lit(0)) + 8
    if isinstance(field.dataType, T.AtomicType):
        return F.lit(8)
    return F.coalesce(F.octet_length(F.to_json(F.struct(col(field.name)))), F.lit(0)) + 8


def _dealt(keyed: DataFrame, copies: int) -> DataFrame:
    """``keyed`` with ``copy``, 0 but for rows of which there are more than ``copies`` alike: these
    are counted, which leaves one row of each, and made anew with numbers from 0, so that their
    copies don't all go where one goes. Rows are alike if both their keys are."""
    hot = keyed.groupBy("key", "key2").agg(F.count("*").alias("n")).where(F.col("n") > copies)
    hot = materialize(hot, "hot")
    one = keyed.withColumn("copy", F.lit(0).cast("long"))
    if hot.isEmpty():
        return one
    keys = F.broadcast(hot.select("key", "key2"))  # at most MOST_HOT rows, by the choice of ``copies``
    names = keyed.columns
    rows = keyed.join(keys, ["key", "key2"], "left_semi").groupBy("key", "key2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in names if c not in ("key", "key2")])
    blocks = materialize(rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))), "blocks")
    low = F.col("block") * BLOCK
    again = blocks.repartition(F.xxhash64("key", "block")).withColumn("copy", F.explode(F.sequence(low, F.least(low + BLOCK, F.col("n")) - 1)))
    return one.join(keys, ["key", "key2"], "left_anti").select(*names, "copy").unionByName(again.select(*names, "copy"))


def shuffled(docs: DataFrame, bucket_bytes: int = 64 << 20, seed: int = 11, most_hot: int = MOST_HOT) -> DataFrame:
    """All rows of ``docs`` in a uniformly random order, as ``shard`` and ``position`` in it.

    The first pass scatters rows by a seeded hash of all their columns into so many buckets
    that each has about ``bucket_bytes`` and fits a task's memory. Rows that are repeated more
    often than a ``most_hot``-th of the table (1000 times at least) are counted first and
    dealt out copy by copy. The second pass puts a bucket into key order and applies a seeded
    Fisher-Yates shuffle. The same rows and seed give the same result whatever the partitions
    were. Columns named shard or position are replaced; nulls are values like any other; an
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.drop("shard", "position")
    size, n = docs.agg(F.sum(sum((_bytes(f) for f in docs.schema), F.lit(0))), F.count("*")).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots can't go to a worker
    hashed = [_hashable(f) for f in plain.schema]
    keyed = plain.withColumns({"key": F.xxhash64(F.lit(seed), *hashed), "key2": F.xxhash64(*reversed(hashed), F.lit(seed + 2))})
    dealt = _dealt(keyed, max(LEAST_COPIES, n // most_hot))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key"), F.col("copy")), F.lit(buckets)).cast("int")).drop("key2", "copy")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields) + ", shard int, position long"
    out = dealt.repartitionById(buckets, F.col("shard")).mapInArrow(tidy(shuffle_buckets("shard", "key", "position", seed)), schema)
    return out.toDF(*names, "shard", "position")


def write_shards(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes :func:`shuffled`, a file a bucket, and reads it back. path: a folder that all
    executors share; one in ``spark.checkpoint.dir`` unless given."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "shards")
    out = shuffled(docs, **options)
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
