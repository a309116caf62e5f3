"""Training data: carry-forward pairs, distinct, negatives, unions, splits, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..functions.text import collapse, is_blank, strip
from .filters import is_claim, min_words, non_empty, require
from .tiles import tiled_join


def hash_key(seed: int | str, *cols: str | Column) -> Column:
    """SHA-256 of the seed and the columns: an order that does not depend on partitioning."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]), 256)


def shuffled(df: DataFrame, seed: int | None, *keys: str) -> DataFrame:
    """Rows in a seeded order; without a seed the order differs from run to run."""
    return df.orderBy(F.rand()) if seed is None else df.orderBy(hash_key(seed, *keys), *keys)


def sample(df: DataFrame, n: int | None, seed: int | None, *keys: str) -> DataFrame:
    """min(n, rows) rows without replacement; None and 0 mean all."""
    return shuffled(df, seed, *keys).limit(n) if n else df


def claim_sentences(essays: DataFrame, essay: str = "essay_id_comp", kind: str = "discourse_type", text: str = "discourse_text", start: str = "discourse_start") -> DataFrame:
    """(essay, start, sentence, is_claim) of the non-blank segments with four words or more."""
    rows = require(essays, essay, kind, text, start).filter(F.col(essay).isNotNull())
    rows = rows.select(essay, start, collapse(F.col(text)).alias("sentence"), is_claim(F.col(kind)).alias("is_claim"))
    return rows.filter(F.col("sentence").isNotNull() & (F.col("sentence") != "") & min_words(F.col("sentence")))


def carry_forward(essays: DataFrame, essay: str = "essay_id_comp", kind: str = "discourse_type", text: str = "discourse_text", order: Sequence[str] = ("discourse_start",)) -> DataFrame:
    """(essay, order, claim, evidence): each evidence with the last claim or position before it in its
    essay; evidence before any claim is dropped, blank segments are skipped, other types ignored."""
    low = F.lower(strip(F.col(kind)))
    rows = essays.filter(F.col(essay).isNotNull() & ~is_blank(F.col(text))).select(essay, *order, low.alias("_kind"), collapse(F.col(text)).alias("_text"))
    before = Window.partitionBy(essay).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    claim = F.last(F.when(F.col("_kind").isin("claim", "position"), F.col("_text")), ignorenulls=True).over(before)
    return rows.withColumn("claim", claim).filter((F.col("_kind") == "evidence") & F.col("claim").isNotNull()).select(essay, *order, "claim", F.col("_text").alias("evidence"))


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: Ranges of the seeded hash: rows in hash order are dealt into so many groups, each small enough for a task.
RANGES = 4096


def _range_of(hashed: str) -> Column:
    return F.conv(F.substring(hashed, 1, 3), 16, 10).cast("int")


def negatives(positives: DataFrame, seed: int, order: Sequence[str], within: str | None = None, claim: str = "claim") -> DataFrame:
    """Each row with another row's claim, label 0, rows that would keep their own claim left out.

    Claims move along the seeded order by one place, the first to the last row: a permutation within each
    ``within`` (a split, so that no claim crosses it), or over all rows.  The order is cut into RANGES of
    the hash; only the ranges' first claims, a row for each, are put in order by one task."""
    rows = positives.withColumn("_in", F.col(within) if within else F.lit(0)).withColumn("_h", hash_key(seed, *order)).withColumn("_b", _range_of("_h"))
    rows = rows.withColumn("_next", F.lead(claim).over(Window.partitionBy("_in", "_b").orderBy("_h", *order)))
    firsts = rows.groupBy("_in", "_b").agg(F.min_by(claim, F.struct("_h", *order)).alias("_c"))
    along = Window.partitionBy("_in").orderBy("_b")
    whole = Window.partitionBy("_in")
    firsts = firsts.select(F.col("_in").alias("_i2"), F.col("_b").alias("_b2"), F.coalesce(F.lead("_c").over(along), F.min_by("_c", "_b").over(whole)).alias("_wrap"))
    rows = rows.join(firsts, F.col("_in").eqNullSafe(F.col("_i2")) & (F.col("_b") == F.col("_b2")), "left")
    rows = rows.withColumn("_claim", F.coalesce("_next", "_wrap")).filter(F.col("_claim") != F.col(claim)).withColumn(claim, F.col("_claim"))
    return rows.drop("_claim", "_next", "_wrap", "_in", "_i2", "_h", "_b", "_b2").withColumn("is_evidence", F.lit(0))


def labelled_pairs(positives: DataFrame, seed: int, order: Sequence[str], within: str | None = None) -> DataFrame:
    """Positives with label 1 and their negatives with label 0; empty and typed without positives."""
    return positives.withColumn("is_evidence", F.lit(1)).unionByName(negatives(positives, seed, order, within))


def group_split(df: DataFrame, group: str, seed: int = 42, cuts: tuple[float, float] = (0.8, 0.9)) -> DataFrame:
    """``df`` with ``split``: whole groups, about 80/10/10, by a hash of the group.

    Every row finds its split alone: no ranking, no shuffle, and later data never moves a group."""
    u = F.conv(F.substring(hash_key(seed, group), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < cuts[0], "training").when(u < cuts[1], "validation").otherwise("testing"))


def stratified_halves(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: each class halved exactly, validation first, by the key's hash.

    A row's rank is its rank in its range of the hash plus the rows of the ranges before it."""
    rows = df.withColumn("_h", hash_key(seed, key)).withColumn("_b", _range_of("_h"))
    counts = rows.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_b2")).agg(F.count("*").alias("_n"))
    whole, before = Window.partitionBy("_l"), Window.partitionBy("_l").orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_l", "_b2", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)))
    rows = rows.join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_b2")), "left")
    split = F.when(F.col("_before") + F.col("_r") <= F.ceil(F.col("_total") / 2), "validation").otherwise("testing")
    return rows.withColumn("split", split).drop("_h", "_b", "_b2", "_l", "_r", "_before", "_total")


def argument_split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``split`` for arguments that are paired later; fewer than three are all training."""
    if df.limit(3).count() < 3:
        return df.withColumn("split", F.lit("training"))
    return group_split(df, key, seed)


def pair_up(df: DataFrame, columns: Sequence[str], within: str = "split") -> DataFrame:
    """All ordered pairs within a split, each row with itself included: columns as c_1 and c_2, block by block."""
    a = df.select(within, *[F.col(c).alias(f"{c}_1") for c in columns])
    b = df.select(within, *[F.col(c).alias(f"{c}_2") for c in columns])
    return tiled_join(a, b, [within])


def store_values(df: DataFrame, path: str, key: str, value: str, place: int) -> None:
    """Append (key, value, place) to a side table in Parquet, which ``look_up`` reads: a later ``place`` wins."""
    df.select(F.col(key).alias("key"), F.col(value).alias("value"), F.lit(place).alias("place")).write.mode("append").parquet(path)


def look_up(df: DataFrame, side: DataFrame, key: str, value: str, as_col: str) -> DataFrame:
    """``df`` with the side table's value by key; the last of repeated keys wins, a missing key is an error.

    ``side``: (key, value, place)."""
    last = side.groupBy(F.col(key).alias("_k")).agg(F.max_by(value, "place").alias("_v"), F.max(F.lit(True)).alias("_hit"))
    out = df.join(last, F.col(key) == F.col("_k"), "left")
    miss = F.raise_error(F.concat(F.lit("no entry for "), F.col(key)))
    return out.withColumn(as_col, F.when(F.col("_hit"), F.col("_v")).otherwise(miss)).drop("_k", "_v", "_hit")


def combined(parts: Sequence[DataFrame], seed: int | None, *keys: str) -> DataFrame:
    """All parts' rows in a seeded order."""
    parts = [p for p in parts if p is not None]
    if not parts:
        raise DatasetError("no parts to combine")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return shuffled(out, seed, *keys)


def cleaned(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without blanks in the columns (sentence, or claim and evidence)."""
    return non_empty(df, *columns)


def totals(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split and, under a null split, altogether."""
    return df.rollup(split).agg(F.count("*").alias("n"))


def label_balance(df: DataFrame, label: str) -> DataFrame:
    """(positives, negatives) of a 0/1 label."""
    pos = F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))
    return df.agg(pos.alias("positives"), (F.count("*") - pos).alias("negatives"))


def histogram(df: DataFrame, label: str, top: int | None = None) -> DataFrame:
    """(label, n), the commonest first."""
    out = df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)
    return out.limit(top) if top else out
