"""Ranks over a whole table without a window over it: sorted ranges, numbered within, after the rows before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import once


def ranked(df: DataFrame, *order: str | Column, as_col: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 1, in the order of the columns; rows equal in all of them have any order.

    The driver gets one count for each range, as many as there are shuffle partitions."""
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(many, *order).sortWithinPartitions(*order)
    rows = once(rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    at, before = 0, []
    for r in sorted(rows.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r._part):
        before.append((r._part, at))
        at += r.n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(as_col, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
