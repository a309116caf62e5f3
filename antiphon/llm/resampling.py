"""Importance resampling towards a target's distribution of hashed word features.

A text's features are its runs of 1 to ``n`` consecutive words (A-Z as a-z), hashed into BUCKETS buckets by
the crc32 of their bytes.  Identical texts are collapsed first, by grouping on the full text: each distinct
one is tokenised once, and its counts are multiplied by its number of copies.  A bucket's gain is the
logarithm of its share in the target over its share in the documents, smoothed by one.  A document's weight
is the sum of the gains over its features; it is joined back to every copy, and only then does each document
draw noise from its id.  The highest scores are drawn, ties to the smaller id.

Copies are counted within each task before the shuffle, and the join back deals hot texts over tasks.  Per
bucket sums go through the driver (BUCKETS numbers).  Ranks come from a range partitioning by score: one
count for each partition goes through the driver, no rows do.

Null and empty texts have no features and weight 0.  Texts under ``least`` words are scored and not drawn.  A
null id draws its noise as the text ``null`` and comes last among ties; repeated rows are drawn one by one.
Without documents there are no rows; without a target every bucket's share of it is equal.  Only the id and
the text are read, so other columns clash with nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_row, discard, materialise, salted_join, small_batches, summed

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Buckets of one row of partial sums; distinct features a task remembers.
BLOCK, SEEN = 1_000, 1 << 18
#: Fixed value: words are runs of ASCII letters and digits and of all that is not ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hashed(buckets: int, n: int):
    """A function from a text to its features' buckets, each as often as it occurs."""
    known: dict[bytes, int] = {}

    def run(text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
        out: list[int] = []
        for k in range(1, n + 1):
            for f in words if k == 1 else (b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)):
                b = known.get(f)
                if b is None:
                    if len(known) >= SEEN:
                        known.clear()
                    b = known[f] = zlib.crc32(f) % buckets
                out.append(b)
        return np.array([len(words), *out], np.int64)

    return run


def features(docs: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Per distinct text: key (its sha256), copies, n_words, n_features, and its buckets and counts (binary)."""
    small_batches(docs.sparkSession)
    once = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null").groupBy("text").agg(F.count("*").alias("copies"))
    once = once.select("text", "copies", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hashed(buckets, n)
        for b in batches:
            words, total, where, many = [], [], [], []
            for t in b.column(0):
                got = hashed(t.as_py())
                at, c = np.unique(got[1:], return_counts=True)
                words.append(int(got[0]))
                total.append(len(got) - 1)
                where.append(at.astype(np.uint32).tobytes())
                many.append(c.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(words, pa.int64()), pa.array(total, pa.int64()), pa.array(where, pa.binary()), pa.array(many, pa.binary())], names=["key", "copies", "n_words", "n_features", "at", "many"])

    return once.mapInArrow(run, "key binary, copies long, n_words long, n_features long, at binary, many binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts, copies counted, each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-buckets // BLOCK) * BLOCK, np.int64)
        for b in batches:
            for copies, at, many in zip(*(c.to_pylist() for c in b.columns)):
                total[np.frombuffer(at, np.uint32)] += copies * np.frombuffer(many, np.uint32).astype(np.int64)
        for k, own in enumerate(total.reshape(-1, BLOCK)):
            if own.any():
                yield block_row(k, {"sums": own})

    blocks = -(-buckets // BLOCK)
    out = np.zeros(blocks * BLOCK, np.int64)
    for r in summed(found.select("copies", "at", "many").mapInArrow(run, "block int, sums binary"), {"sums": (np.int64, np.int64)}, blocks).collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, np.int64)
    return out[:buckets]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket, in doubles."""
    n = len(source)
    of_source, of_target = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_source / ((s + 1.0) * of_target))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = [int(gain[np.frombuffer(at, np.uint32)] @ np.frombuffer(many, np.uint32).astype(np.int64)) for at, many in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(weight, pa.int64())], names=["key", "copies", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "key binary, copies long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of the sha256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_text: str = "text", n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: id, n_features, weight, score, rank (null where it is not drawn)."""
    spark = docs.sparkSession
    found = materialise(features(docs, text_col, n, buckets), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, target_text, n, buckets), buckets))
    weights = materialise(_weights(found, gain), "weights")
    discard(found)
    text = F.col(text_col).cast("string")
    own = F.unhex(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")))  # meets no text's key, and spreads null texts
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), own).alias("key"))
    total = weights.agg(F.sum("copies")).first()[0] or 0
    rows = salted_join(rows, weights, ["key"], "copies", total, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = rows.select("id", zero("n_words"), zero("n_features"), zero("weight")).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    discard(weights)

    # ranks: sorted ranges, numbered within, and each range's rows before it
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.filter(F.col("n_words") >= least).repartitionByRange(many, *order).sortWithinPartitions(*order)
    ranged = materialise(ranged.select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "ranked")
    counts = sorted((r.part, r.m) for r in ranged.groupBy("part").agg(F.count("*").alias("m")).collect())  # one a partition
    taken = percent * sum(m for _, m in counts) // 100
    before, at = [], 0
    for part, m in counts:
        before.append((part, at))
        at += m
    offsets = spark.createDataFrame([b for b in before if b[1] < taken], "part int, before long")
    ranks = ranged.join(F.broadcast(offsets), "part").select("row", (F.col("before") + F.col("place") + 1).alias("rank")).filter(F.col("rank") <= taken)
    out = rows.join(ranks, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
