"""Shared plumbing: table reading, the shared folder, batch sizing, split hash, joins with hot keys."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Arrow data handed to a Python worker at once.
BATCH_BYTES = 2 << 20
#: A key with more than this share of the rows is split in a join.
HOT_SHARE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, n_bytes: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, so a few long texts cannot fill a worker.

    Plans read the setting when they run, so it has to stay; it is only ever lowered."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > n_bytes:
        spark.conf.set(name, str(n_bytes))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.  Where that is unset a local master gets a temporary
    one; a cluster gets an error, as its executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "fallback", None) or tempfile.mkdtemp(prefix="antiphon-")
        shared_dir.fallback = base
    return f"{base.rstrip('/')}/antiphon-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The folder goes when the session ends, or with ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    parent, fs = _hadoop(spark, path.rpartition("/")[0])
    fs.deleteOnExit(parent)
    out = spark.read.schema(df.schema).parquet(path)
    out._antiphon_folder = path.rpartition("/")[0]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these tables; nothing may read them any more."""
    for df in tables:
        if folder := getattr(df, "_antiphon_folder", None):
            path, fs = _hadoop(df.sparkSession, folder)
            fs.delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: it does so when the
    driver collects garbage, which a small driver heap may not need for long.  What the first round frees
    holds more, so there are three."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; 0 marks held-out rows."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % 5


def summed(parts: DataFrame, kinds: dict[str, tuple[type, type]], blocks: int) -> DataFrame:
    """``parts`` (block int, then a binary array of numbers for each of ``kinds``) added up by block: one row each.

    ``kinds`` gives the numbers' type in a part and in a sum.  Tasks hold sums only, however many parts there are."""
    schema = ", ".join(["block int", *(f"{k} binary" for k in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, *values in zip(*(c.to_pylist() for c in b.columns)):
                values = [np.frombuffer(v, t) for v, (t, _) in zip(values, kinds.values())]
                if k not in held:
                    held[k] = [np.zeros(len(v), t) for v, (_, t) in zip(values, kinds.values())]
                for total, v in zip(held[k], values):
                    total += v
        for k, values in held.items():
            yield block_row(k, dict(zip(kinds, values)))

    n = max(1, min(blocks, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return parts.select("block", *kinds).repartition(n, "block").mapInArrow(run, schema)


def block_row(block: int, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for ``summed``."""
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values.values())], names=["block", *values])


def free_name(df: DataFrame, base: str) -> str:
    """``base`` with as many underscores as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int, spread: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (one row a key), with hot keys dealt over tasks.

    ``right`` has in ``size`` how many rows of ``left`` (``total`` in all) its key has.  At most HOT_SHARE
    keys can have more than a HOT_SHARE-th of the rows, which bounds the broadcast; those are split into
    parts by a hash of ``spread``, and their row of ``right`` is repeated for each part."""
    limit = max(1000, total // HOT_SHARE)
    parts = F.ceil(F.col(size) / limit).cast("int")
    hot = right.filter(F.col(size) > limit).select(*keys, parts.alias("_parts"))
    left = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")).drop("_parts")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


#: Ids up to which a list of rows to drop is broadcast (16 bytes each at most); longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not among ``ids`` (one column); rows with a null id stay."""
    ids = materialise(ids.toDF("drop_id").filter("drop_id is not null").distinct(), "dropped")
    small = ids.count() <= BROADCAST_IDS
    key = free_name(df, "drop_id")
    ids = ids.toDF(key)
    return df.join(F.broadcast(ids) if small else ids, df[id_col] == ids[key], "left_anti")
