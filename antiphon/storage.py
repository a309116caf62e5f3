"""Writing a table once that a plan reads several times, and adding up arrays of numbers over tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame


def once(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df``, computed once: written under ``spark.checkpoint.dir`` where the session names that folder
    (it goes when the session ends), else kept by Spark in memory and on disk.  ``by``: a column with a
    folder for each value, so that filters on it read those alone."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    folder = f"{base.rstrip('/')}/once-{uuid.uuid4().hex}"
    (df.repartition(by) if by else df).write.parquet(folder, partitionBy=by)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def part(block: int, values: np.ndarray) -> pa.RecordBatch:
    """A row for ``added``."""
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([values.astype(np.float64).tobytes()], pa.binary())], names=["block", "sums"])


def added(parts: DataFrame, blocks: int, then: Callable[[int, np.ndarray], pa.RecordBatch] = part, schema: str = "block int, sums binary") -> DataFrame:
    """``parts`` (block int, sums binary: doubles) added up by block in one shuffle, and ``then`` of each sum.

    A task holds a sum for each of its blocks, however many parts there are; a part's place in the order of
    addition is its place in the shuffle, so sums of doubles may differ in their last digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(s)
                held[k] = held[k] + v if k in held else v
        for k, v in sorted(held.items()):
            yield then(k, v)

    n = max(1, min(blocks, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return parts.select("block", "sums").repartition(n, "block").mapInArrow(run, schema)
