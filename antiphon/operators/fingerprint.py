"""Fingerprints of tables: a hash of the multiset of rows, whatever their order or partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """The md5 (32 hex digits) of a row's values as text, each with its length, nulls apart from all texts."""
    told = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws(",", *told).cast("binary"))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (n, fingerprint): the number of rows, and the sha256 of it and of the sums of the four parts
    of the rows' hashes.  Tasks add up their rows; a changed, missing or repeated row changes a sum.

    ``columns``: plain ones in the order in which they count; by default all, by name.  No rows have sums of 0."""
    columns = sorted(df.columns) if columns is None else list(columns)
    word = lambda k: F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = df.select(row_hash(columns).alias("_h")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(word(k)), F.lit(0)).cast("string").alias(f"_s{k}") for k in range(4)])
    return sums.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[f"_s{k}" for k in range(4)]).cast("binary"), 256).alias("fingerprint"))
