"""Scoring a run against golden annotations."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotations, metrics
from ..sources.tables import write_result
from .pipeline import Counterarguments


def _pair(claim_a: str, evidence_a: str, claim_b: str, evidence_b: str):
    side = lambda c, e: F.struct(F.col(c).alias("claim"), F.col(e).alias("evidence"))
    return metrics.unordered(side(claim_a, evidence_a), side(claim_b, evidence_b)).alias("pair")


def evaluate(predicted: DataFrame, golden: DataFrame) -> DataFrame:
    """The seven figures of a run's output against golden annotations.

    ``predicted``: claim, evidence and counterarguments, as the pipeline returns them."""
    pairs = predicted.select("claim", "evidence", F.explode("counterarguments").alias("c")).select("claim", "evidence", F.col("c.claim").alias("c2"), F.col("c.evidence").alias("e2"))
    gold = annotations.related_pairs(golden)
    return metrics.benchmark_metrics(
        predicted.select("claim", "evidence"), annotations.arguments(golden).select("claim", "evidence"),
        pairs.select(_pair("claim", "evidence", "c2", "e2")), gold.select(_pair("claim_a", "evidence_a", "claim_b", "evidence_b")),
    )


def run(golden: DataFrame, folder: str, pipeline: Counterarguments | None = None) -> Path:
    """Every raw text as a reference against all raw texts, its figures written as JSON."""
    pipeline = pipeline or Counterarguments()
    start = dt.datetime.now(dt.UTC)
    texts = annotations.raw_texts(golden).select(F.col("title").alias("ref_id"), "text")
    # the local source answers every query with all of its documents
    found = texts.select("ref_id").crossJoin(texts.select(F.col("ref_id").alias("doc_id"), "text"))
    figures = evaluate(pipeline.run(texts, found), golden).first().asDict()
    version = golden.select("version").first().version
    return write_result(folder, figures, pipeline.config(), start, dt.datetime.now(dt.UTC), version)
