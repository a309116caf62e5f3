"""Assigning frames: scores in frame order, the first maximum wins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counting import pieces
from ..functions.vectors import argmax
from ..schemas import FRAMES, frame_name

#: text -> array of len(FRAMES) probabilities in frame order
Framer = Callable[[Column], Column]


def hashed(text: Column) -> Column:
    """Default: tokens hashed to frames by first letter and length, add-one smoothed shares."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        n, found = len(FRAMES), [np.zeros((0, len(FRAMES)))]
        for t in pieces(texts):
            some = np.flatnonzero(t.latin & (t.size >= 2))  # the tokens of text.tokens
            bucket = ((t.letter(t.start[some]) + 96) * 31 + t.size[some]) % n
            own = np.searchsorted(t.first, t.start[some], "right") - 1
            counts = np.bincount(own * n + bucket, minlength=len(t.texts) * n).reshape(-1, n)
            found.append((counts + 1) / (counts.sum(1, keepdims=True) + float(n)))
        shares = np.concatenate(found)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1) * n, pa.int32()), pa.array(shares.ravel()))

    return run(text)


def assign(df: DataFrame, text: Column, framer: Framer = hashed) -> DataFrame:
    """``df`` with primary_frame and frame_probabilities (a map with all frames)."""
    names = F.array(*[F.lit(f) for f in FRAMES])
    out = df.withColumn("_p", framer(text))
    return out.withColumn("primary_frame", frame_name(argmax(F.col("_p")))).withColumn("frame_probabilities", F.map_from_arrays(names, F.col("_p"))).drop("_p")


def probabilities(column: Column) -> Column:
    """Probabilities in frame order from a map; missing frames and a null map count 0."""
    return F.array(*[F.coalesce(F.try_element_at(column, F.lit(f)), F.lit(0.0)) for f in FRAMES])


def parsed(column: Column) -> Column:
    """Map from a JSON object in a string; an empty map for null or an invalid string."""
    return F.coalesce(F.from_json(column, "map<string,double>"), F.create_map().cast("map<string,double>"))


def frame_index(frame: Column) -> Column:
    names = F.array(*[F.lit(f) for f in FRAMES])
    return (F.array_position(names, frame) - 1).cast("int")
