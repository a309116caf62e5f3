"""Filters, predicates and label casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..functions.text import is_blank, strip, truncate, words
from ..schemas import frames


def sanitise(text: Column, max_length: int = 10_000) -> Column:
    """Stripped, an error where nothing is left, then cut to ``max_length`` code points."""
    clean = strip(text)
    return F.when(F.coalesce(clean, F.lit("")) == "", F.raise_error(F.lit("the reference text is empty"))).otherwise(truncate(clean, max_length))


def non_empty(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose listed columns are neither null nor blank."""
    return df.filter(reduce(lambda a, b: a & b, [~is_blank(F.col(c)) for c in columns]))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself, or a DatasetError that names the missing columns."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise DatasetError(f"missing columns: {missing}")
    return df


def by_frame(df: DataFrame, frame: str, column: str = "primary_frame") -> DataFrame:
    return df.filter(F.col(column) == frame)


def min_words(text: Column, least: int = 4) -> Column:
    return F.size(words(text)) >= least


def is_claim(kind: Column) -> Column:
    """1 for the discourse types claim and position, else 0."""
    return F.coalesce(F.lower(strip(kind)).isin("claim", "position").cast("int"), F.lit(0))


def common_classes(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows of classes with at least ``least`` rows."""
    keep = df.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(label)
    return df.join(keep, label, "left_semi")


def frame_corpus(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(text, interpretative_frame) of the complete rows."""
    return require(df, text, label).dropna(subset=[text, label]).select(F.col(text).alias("text"), F.col(label).alias("interpretative_frame"))


def head(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in order; None and 0 mean all."""
    return df.orderBy(*order).limit(n) if n else df


def known_frames(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows with a known frame and the number of the others; an error if none is left."""
    names = frames(df.sparkSession).select(F.col("frame").alias("_frame"))
    good = df.join(F.broadcast(names), F.col(column) == F.col("_frame"), "left_semi")
    total, kept = df.count(), good.count()
    if not kept:
        raise DatasetError("no row has a known frame")
    return good, total - kept


def inference_label(label: Column) -> Column:
    """0, 1 or -1 for neutral, entailment or contradiction; an error for anything else."""
    low = F.lower(strip(label))
    return F.when(low == "neutral", 0).when(low == "entailment", 1).when(low == "contradiction", -1).otherwise(F.raise_error(F.concat(F.lit("unknown inference label: "), F.coalesce(label, F.lit("null")))))
