"""Building training sets: claims, evidence pairs, encoder pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import style
from ..functions.vectors import expected_distance
from ..operators import datasets, framing, inference
from ..operators.filters import common_classes

ORDER = ("discourse_start", "discourse_text")


def claim_set(essays: DataFrame, seed: int = 42) -> DataFrame:
    """(split, sentence, is_claim): no essay straddles splits."""
    rows = datasets.group_split(datasets.claim_sentences(essays), "essay_id_comp", seed)
    return datasets.cleaned(rows.select("split", "sentence", "is_claim"), "sentence")


def evidence_set(essays: DataFrame, seed: int = 42) -> DataFrame:
    """(split, claim, evidence, is_evidence): split by essay first, negatives drawn within each split."""
    keys = ["essay_id_comp", *ORDER]
    pairs = datasets.distinct_first(datasets.carry_forward(essays, order=ORDER), ["claim", "evidence"], keys)
    rows = datasets.labelled_pairs(datasets.group_split(pairs, "essay_id_comp", seed), seed, keys, within="split")
    return datasets.cleaned(rows.select("split", "claim", "evidence", "is_evidence"), "claim", "evidence")


def frame_set(training: DataFrame, validation: DataFrame, seed: int = 42) -> DataFrame:
    """(split, text, interpretative_frame): the validation corpus's common classes halved by class."""
    common = common_classes(validation, "interpretative_frame", 2)
    key = common.withColumn("_key", F.sha2(F.concat_ws("\n", F.col("interpretative_frame").cast("string"), "text"), 256))
    halves = datasets.stratified_halves(key, "interpretative_frame", "_key", seed).drop("_key")
    return training.withColumn("split", F.lit("training")).unionByName(halves).select("split", "text", "interpretative_frame")


def encoder_set(arguments: DataFrame, framer: framing.Framer = framing.hashed, infer: inference.Inference = inference.lexical, semantics_weight: float = 0.7, seed: int = 42) -> DataFrame:
    """(split, claim_1, evidence_1, frame_1, style_1, ..., expected_distance) of all pairs within a split.

    ``arguments``: (claim, evidence).  The text similarity of neutral pairs is the inference's overlap."""
    once = arguments.dropDuplicates(["claim", "evidence"]).withColumn("_text", F.concat("claim", F.lit(" "), "evidence"))
    framed = framing.assign(once, F.col("_text"), framer)
    rows = style.with_counts(framed, "_text").withColumn("style", style.vector(F.col("_style"))).filter("style is not null")
    rows = datasets.argument_split(rows.select("claim", "evidence", F.col("primary_frame").alias("frame"), "style", F.col("_text").alias("text")), "text", seed)
    pairs = datasets.pair_up(rows, ["claim", "evidence", "frame", "style", "text"])
    pairs = pairs.withColumn("_p", infer(F.col("text_1"), F.col("text_2")))
    near = F.when(F.col("_p.result") == 0, 1 - F.col("_p.confidence")).otherwise(0.0)
    return pairs.withColumn("expected_distance", expected_distance(F.col("style_1"), F.col("style_2"), F.col("_p.result"), near, semantics_weight)).drop("_p", "text_1", "text_2")
