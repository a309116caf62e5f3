"""Natural-language inference over pairs, claim merging, absorbed claims."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import normalise_equal, tokens
from ..schemas import CONTRADICTION, ENTAILMENT, NEUTRAL
from .extract import overlap
from .tiles import tiled_join

NEGATIONS = ("no", "not", "never", "none", "nicht", "kein", "pas", "jamais", "nunca")
#: (text, other text) -> struct(result, confidence)
Inference = Callable[[Column, Column], Column]


def lexical(a: Column, b: Column, entail: float = 0.6, oppose: float = 0.3) -> Column:
    """Default: equal or largely overlapping texts entail, overlap with one-sided negation contradicts."""
    words = F.struct(F.array_distinct(tokens(a)).alias("a"), F.array_distinct(tokens(b)).alias("b"))
    return let(words, lambda w: let(overlap(w["a"], w["b"]), lambda share: _lexical(a, b, w["a"], w["b"], share, entail, oppose)))


def _lexical(a: Column, b: Column, ta: Column, tb: Column, share: Column, entail: float, oppose: float) -> Column:
    negated = lambda t: F.exists(t, lambda w: w.isin(*NEGATIONS))
    one_sided = negated(ta) != negated(tb)
    equal = normalise_equal(a) == normalise_equal(b)
    result = F.when(equal, ENTAILMENT).when(one_sided & (share >= oppose), CONTRADICTION).when(share >= entail, ENTAILMENT).otherwise(NEUTRAL)
    sure = F.when(equal, 1.0).when(result == NEUTRAL, 1 - share).otherwise(share)
    return F.struct(result.cast("int").alias("result"), sure.cast("double").alias("confidence"))


def pairs(references: DataFrame, others: DataFrame, on: Sequence[str] = (), text: str = "text", infer: Inference = lexical) -> DataFrame:
    """Every reference with every other text of the same ``on`` (of all, if that is empty): reference
    columns as r_*, others as o_*, and result and confidence.  Either side empty gives no rows.  Both sides
    meet block by block, whatever their sizes."""
    r = references.select(*[F.col(c).alias(c if c in on else f"r_{c}") for c in references.columns])
    o = others.select(*[F.col(c).alias(c if c in on else f"o_{c}") for c in others.columns])
    both = tiled_join(r, o, on)
    return both.withColumn("_p", infer(F.col(f"r_{text}"), F.col(f"o_{text}"))).select("*", "_p.result", "_p.confidence").drop("_p")


def merge_claims(arguments: DataFrame, candidates: DataFrame, on: Sequence[str], infer: Inference = lexical) -> DataFrame:
    """Every argument with every candidate of the same run: the argument's claim where it entails the
    candidate's, else the candidate's own; evidence stays the candidate's.  No row is removed.

    Inputs have ``on``, an id, claim and evidence; the output adds r_id, o_id, claim, evidence, merged."""
    r = arguments.select(*on, F.col("id").alias("r_id"), F.col("claim").alias("r_claim"))
    o = candidates.select(*on, F.col("id").alias("o_id"), F.col("claim").alias("o_claim"), "evidence")
    both = tiled_join(r, o, on).withColumn("merged", infer(F.col("r_claim"), F.col("o_claim"))["result"] == ENTAILMENT)
    return both.select(*on, "r_id", "o_id", F.when(F.col("merged"), F.col("r_claim")).otherwise(F.col("o_claim")).alias("claim"), "evidence", "merged")


def absorbed(candidates: DataFrame, merged: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per run: distinct candidate claims, how many of them no merged row keeps, and their percentage."""
    before = candidates.select(*on, "claim").distinct()
    left = merged.select(*on, "claim").distinct().withColumn("kept", F.lit(1))
    both = before.join(left, [*on, "claim"], "left")
    lost = F.sum(F.when(F.col("kept").isNull(), 1).otherwise(0))
    return both.groupBy(*on).agg(F.count("*").alias("claims"), lost.alias("absorbed"), F.round(100.0 * lost / F.count("*"), 4).alias("percent"))
