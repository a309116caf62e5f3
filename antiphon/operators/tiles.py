"""Joins whose keys have many rows on both sides: each key's rows are dealt into blocks, and blocks meet in pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..storage import once

BLOCK = 2_048
#: Keys up to which the table of their block counts is broadcast (some tens of bytes each).
BROADCAST_KEYS = 100_000


def shape(left: DataFrame, right: DataFrame, on: Sequence[str], size: int = BLOCK) -> DataFrame:
    """(on, _lb, _rb): the numbers of blocks on either side, of keys that both sides have."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    if left is right:
        out = blocks(left, "_lb").withColumn("_rb", F.col("_lb"))
    else:
        out = blocks(left, "_lb").join(blocks(right, "_rb"), list(on))
    out = once(out)
    return F.broadcast(out) if out.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else out


def own_block(of: str | Sequence[str], blocks: str) -> Column:
    """The block of a row by a hash of columns ``of``."""
    return F.pmod(F.xxhash64(*([of] if isinstance(of, str) else of)), F.col(blocks).cast("long")).cast("int")


def every_block(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def tiled_join(left: DataFrame, right: DataFrame, on: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """The inner join on ``on`` (every row with every row, if that is empty): what meets in one task is one
    block of each side, however many rows a key has.  The sides share no other column's name."""
    if not on:
        left, right, on = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0)), ["_all"]
    by = shape(left, right, on, size)

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
        return df.join(by, list(on)).withColumn(mine, own_block(hashed, own)).withColumn(theirs, every_block(other)).drop("_lb", "_rb")

    return dealt(left, "_lb", "_rb", "_l", "_r").join(dealt(right, "_rb", "_lb", "_r", "_l"), [*on, "_l", "_r"]).drop("_l", "_r", "_all")
