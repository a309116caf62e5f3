"""Bounded labelled samples for fitting: hash-thresholded, so few rows move to draw them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A thousandth more than the share keeps a sample of a small table whole.
SCALE = 1 << 30
#: Rows of all labels together, and bytes of a text, that a fit may take.
MAX_ROWS, MAX_BYTES = 100_000, 1 << 16


def short(text: Column) -> Column:
    """Texts that a fit may take: not null or empty, at most MAX_BYTES long."""
    return F.octet_length(text).between(1, MAX_BYTES)


def capped(df: DataFrame, label: str, order: str, per_label: int) -> DataFrame:
    """The ``per_label`` rows of each label with the smallest ``order``, however often one is repeated."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= per_label).drop("_rank")


def stratified(df: DataFrame, label: str, key: Column, per_label: int, max_labels: int = 1000) -> DataFrame:
    """At most ``per_label`` rows of each label (all, where it has fewer), picked by a hash of ``key``.

    Only the labels' counts reach the driver: at most ``max_labels`` rows, the commonest labels."""
    counts = df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(max_labels).collect()
    per_label = min(per_label, max(20, MAX_ROWS // max(1, len(counts))))
    pick = F.lit(False)
    for r in counts:
        share = F.pmod(F.xxhash64(key), F.lit(SCALE)) < int(min(1.0, 1.2 * per_label / r.n) * SCALE)
        pick = pick | ((F.col(label) == F.lit(r[label])) & share)
    return capped(df.filter(pick).withColumn("_order", F.xxhash64(key, F.lit(1))), label, "_order", per_label).drop("_order")
