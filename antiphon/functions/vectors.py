"""Array arithmetic in JVM expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

EPSILON = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; null for a zero vector."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def expected_distance(style_1: Column, style_2: Column, result: Column, text_cosine: Column, semantics_weight: float = 0.7) -> Column:
    """Training target for two arguments, to five digits: style distance and what the inference says.

    Entailment is near (0), contradiction far (1); for neutral pairs the texts' similarity itself counts,
    since the same topic under another claim is a counterargument."""
    length = norm(style_1) * norm(style_2)
    style = 1 - dot(style_1, style_2) / F.when(length == 0, F.lit(EPSILON)).otherwise(length)
    semantic = F.when(result == 1, 0.0).when(result == -1, 1.0).otherwise(text_cosine)
    return F.round((1 - semantics_weight) * style + semantics_weight * semantic, 5)


def clip(x: Column) -> Column:
    """Into 0..1; NaN stays NaN."""
    return let(x, lambda v: F.when(F.isnan(v), v).otherwise(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))))


def softmax(logits: Column) -> Column:
    powers = let(logits, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total)))


def argmax(a: Column) -> Column:
    """Index from 0 of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def project(a: Column, outputs: int, inputs: int) -> Column:
    """A fixed linear map: weight (i, j) is sin((i + 1) * (j + 1)) / sqrt(inputs)."""
    if outputs <= 0:
        raise ValueError("outputs must be positive")
    rows = [[math.sin((i + 1) * (j + 1)) / math.sqrt(inputs) for j in range(inputs)] for i in range(outputs)]
    return F.array(*[dot(a, constant(r)) for r in rows])


def constant(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
