"""Counterarguments for many reference texts at once, in one lazy plan."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import style
from ..operators import encode, extract, framing, inference, search
from ..operators.datasets import hash_key
from ..operators.filters import sanitise
from ..storage import once


@dataclass
class Stages:
    """The replaceable parts; each is a column function."""

    claim_scorer: extract.ClaimScorer = extract.claim_score
    evidence_scorer: extract.EvidenceScorer = extract.overlap
    infer: inference.Inference = inference.lexical
    framer: framing.Framer = framing.hashed
    encoder: Callable[[Column], Column] = encode.projection


@dataclass
class Counterarguments:
    """arguments -> candidates -> claim merging -> frames -> style -> encoding -> farthest in frame."""

    settings: Settings = field(default_factory=Settings)
    stages: Stages = field(default_factory=Stages)

    def config(self) -> dict[str, Any]:
        """Settings and the stages' names, for reports."""
        return {"settings": dataclasses.asdict(self.settings), "stages": {f.name: getattr(getattr(self.stages, f.name), "__name__", "custom") for f in dataclasses.fields(self.stages)}}

    def arguments(self, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, id, claim, evidence) in order of appearance."""
        e, s = self.settings.extraction, self.stages
        flat = extract.claim_evidence(texts, e.claim_threshold, e.evidence_threshold, key, text, s.claim_scorer, s.evidence_scorer)
        return flat.select(key, F.concat_ws(":", key, "claim_pos", "evidence_pos").alias("id"), "claim", "evidence")

    def candidates(self, documents: DataFrame, key: str = "ref_id", doc: str = "doc_id", text: str = "text", without_self: bool = False) -> DataFrame:
        """At most ``max_candidates`` arguments per reference from its found documents (key, doc, text),
        chosen by the seeded hash order; without a seed the choice differs from run to run."""
        docs = documents.filter(F.col(doc).cast("string") != F.col(key).cast("string")) if without_self else documents
        once = docs.select(F.col(doc).alias("_doc"), text).dropDuplicates(["_doc"])
        args = self.arguments(once, "_doc", text)
        rows = docs.select(key, F.col(doc).alias("_doc")).join(args, "_doc")
        order = F.rand() if self.settings.seed is None else hash_key(self.settings.seed, "id")
        rank = F.row_number().over(Window.partitionBy(key).orderBy("_h", "id"))
        return rows.withColumn("_h", order).withColumn("_r", rank).filter(F.col("_r") <= self.settings.max_candidates).select(key, "id", "claim", "evidence")

    def encoded(self, args: DataFrame) -> DataFrame:
        """Frame, probabilities, style vector and code of each argument; texts without words drop out."""
        both = args.withColumn("_text", F.concat("claim", F.lit(" "), "evidence"))
        framed = framing.assign(both, F.col("_text"), self.stages.framer)
        styled = style.with_counts(framed, "_text").withColumn("style_vector", style.vector(F.col("_style"))).filter("style_vector is not null").drop("_style", "_text")
        return styled.withColumn("code", self.stages.encoder(encode.encoder_input(F.col("style_vector"), F.col("primary_frame"), F.col("frame_probabilities"))))

    def run(self, references: DataFrame, documents: DataFrame, key: str = "ref_id", text: str = "text", k: int | None = None) -> DataFrame:
        """(key, id, claim, evidence, primary_frame, counterarguments) of every reference's arguments.

        ``references``: (key, text); ``documents``: (key, doc_id, text), what was found for each."""
        clean = references.select(key, sanitise(F.col(text), self.settings.reference_text_max_length).alias(text))
        args = self.arguments(clean, key, text)
        cand = inference.merge_claims(args, self.candidates(documents, key), [key], self.stages.infer)
        # every argument's merge of a candidate is a candidate of its own
        cand = cand.select(key, F.concat_ws("/", "r_id", "o_id").alias("id"), "claim", "evidence")
        group = F.concat_ws("|", key, "primary_frame").alias("grp")
        a, c = (once(self.encoded(df).select("*", group)) for df in (args, cand))  # each is read by the search and by what follows
        found = search.farthest(a, c, k, group="grp", key="id", vector="code")
        out = search.counterarguments(a, found, c.select("id", "claim", "evidence"), group="grp")
        return out.select(key, "id", "claim", "evidence", "primary_frame", framing.frame_index(F.col("primary_frame")).alias("frame_idx"), "counterarguments").orderBy(key, "frame_idx", "id").drop("frame_idx")
