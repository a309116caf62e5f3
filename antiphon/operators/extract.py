"""Claims and evidence within documents.

Scorers are column functions and replaceable.  Sentences stay an array in their document's row, so the
claim-by-sentence join never moves a row: pairs are formed, scored and filtered in place, and only those
over the threshold are exploded.  The default evidence scorer counts common tokens by matrix products over
blocks of claims and sentences; long documents are cut into rows of CLAIMS claims each for that."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_equal, sentences, strip, tokens

ClaimScorer = Callable[[Column], Column]
#: (claim's tokens, sentence's tokens) -> score
EvidenceScorer = Callable[[Column, Column], Column]


def claim_score(words: Column) -> Column:
    """Distinct tokens over 20, at most 1: a deterministic default on a sentence's distinct tokens."""
    return F.least(F.lit(1.0), F.size(words) / F.lit(20.0))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct tokens; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def with_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_sents``: array of (pos, s, t, norm), the stripped non-blank sentences with distinct tokens."""
    clean = F.filter(F.transform(sentences(F.col(text)), strip), lambda s: s != "")
    return df.withColumn("_sents", F.transform(clean, lambda s, i: F.struct(i.alias("pos"), s.alias("s"), F.transform(F.array_distinct(tokens(s)), lambda t: F.xxhash64(t)).alias("t"), normalise_equal(s).alias("norm"))))


def claims(df: DataFrame, threshold: float = 0.45, key: str = "doc_id", text: str = "text", scorer: ClaimScorer = claim_score) -> DataFrame:
    """(key, pos, claim, p) of the sentences that score at least ``threshold``."""
    rows = with_sentences(df.select(key, text), text).select(key, F.explode("_sents").alias("x"))
    return rows.select(key, F.col("x.pos").alias("pos"), F.col("x.s").alias("claim"), scorer(F.col("x.t")).alias("p")).filter(F.col("p") >= threshold)


#: Claims in a block of a product, and sentences and tokens; the characters from which a document's blocks of claims are dealt over tasks.
CLAIMS, SENTENCES, TOKENS = 1_024, 2_048, 4_096
LONG = 100_000
_PAIRS = "array<struct<c:int,e:int,p:double>>"


def _pairs_of(flat: np.ndarray, size: np.ndarray, claims: np.ndarray, norm: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Claims' and sentences' numbers and similarities of a document's pairs that reach the threshold."""
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    values, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    keep = many[column] > 1  # a token of one sentence is common to no pair
    column, owner = (np.cumsum(many > 1) - 1)[column[keep]], owner[keep]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    width = int(column[-1]) + 1 if len(column) else 0
    found = []
    for lo in range(0, len(claims), CLAIMS):
        own = claims[lo : lo + CLAIMS]
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        for at in range(0, n, SENTENCES):
            end = min(n, at + SENTENCES)
            both = np.zeros((len(own), end - at), np.float32)
            for t in range(0, width, TOKENS):
                i, j = np.searchsorted(column, (t, t + TOKENS))
                col, row = column[i:j] - t, owner[i:j]
                left, right = np.zeros((len(own), min(TOKENS, width - t)), np.float32), np.zeros((end - at, min(TOKENS, width - t)), np.float32)
                a, b = place[row] >= 0, (row >= at) & (row < end)
                left[place[row[a]], col[a]] = 1
                right[row[b] - at, col[b]] = 1
                both += left @ right.T
            union = size[own][:, None] + size[at:end][None] - both
            p = np.divide(both, union, out=np.zeros(both.shape), where=union > 0, dtype=np.float64)
            good = (p >= threshold) & (norm[own][:, None] != norm[at:end][None])
            c, e = np.nonzero(good)
            found.append((own[c], e + at, p[c, e]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    c, e, p = (np.concatenate(v) for v in zip(*found))
    by = np.lexsort((e, c))
    return c[by], e[by], p[by]


def _overlap_pairs(claims: Column, part: Column, norm: Column, words: Column, threshold: float) -> Column:
    """The pairs of one row: ``claims`` tells which sentences are claims, ``part`` which CLAIMS of them are meant (-1: all)."""

    @F.arrow_udf(_PAIRS)
    def run(claim: pa.Array, part: pa.Array, norm: pa.Array, words: pa.Array) -> pa.Array:
        counts, out = [0], []
        for i in range(len(words)):
            own = words[i].values
            size = np.asarray(own.value_lengths().fill_null(0)) if own is not None else np.zeros(0, int)
            chosen = np.flatnonzero(np.asarray(claim[i].values)) if len(size) else np.zeros(0, int)
            if (block := part[i].as_py()) >= 0:
                chosen = chosen[block * CLAIMS : (block + 1) * CLAIMS]
            got = _pairs_of(np.asarray(own.flatten()), size, chosen, np.asarray(norm[i].values), threshold) if len(chosen) else None
            if got is not None and len(got[0]):
                out.append(got)
            counts.append(counts[-1] + (len(got[0]) if got is not None else 0))
        c, e, p = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        rows = pa.StructArray.from_arrays([pa.array(c, pa.int32()), pa.array(e, pa.int32()), pa.array(p, pa.float64())], names=["c", "e", "p"])
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rows)

    return run(claims, part, norm, words)


def claim_evidence(df: DataFrame, claim_threshold: float = 0.45, evidence_threshold: float = 0.35, key: str = "doc_id", text: str = "text", claim_scorer: ClaimScorer = claim_score, evidence_scorer: EvidenceScorer = overlap) -> DataFrame:
    """(key, claim_pos, evidence_pos, claim, evidence, p): each claim with each other sentence of its
    document that scores; a sentence equal to the claim (case and white space aside) is left out."""
    base = with_sentences(df.select(key, F.col(text).alias("_text")), "_text").select(key, "_text", "_sents")
    if evidence_scorer is overlap and evidence_threshold > 0:
        base = base.withColumn("_claims", F.transform("_sents", lambda s: claim_scorer(s["t"]) >= claim_threshold))
        many = F.size(F.filter("_claims", lambda c: c))
        small = base.filter(F.length(F.coalesce("_text", F.lit(""))) <= LONG).withColumn("_part", F.lit(-1))
        parts = base.filter(F.length("_text") > LONG).withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(many / CLAIMS).cast("int"), F.lit(1)) - 1)))
        rows = small.unionByName(parts.repartition(key, "_part"))
        rows = rows.withColumn("_p", F.explode(_overlap_pairs(F.col("_claims"), F.col("_part"), F.transform("_sents", lambda s: F.xxhash64(s["norm"])), F.transform("_sents", lambda s: s["t"]), evidence_threshold)))
        c, e = F.get("_sents", F.col("_p.c")), F.get("_sents", F.col("_p.e"))
        return rows.select(key, c["pos"].alias("claim_pos"), e["pos"].alias("evidence_pos"), c["s"].alias("claim"), e["s"].alias("evidence"), F.col("_p.p").alias("p"))
    found = F.filter("_sents", lambda s: claim_scorer(s["t"]) >= claim_threshold)
    good = lambda c: F.filter("_sents", lambda s: (evidence_scorer(c["t"], s["t"]) >= evidence_threshold) & (s["norm"] != c["norm"]))
    pairs = F.flatten(F.transform(found, lambda c: F.transform(good(c), lambda s: F.struct(c["pos"].alias("claim_pos"), s["pos"].alias("evidence_pos"), c["s"].alias("claim"), s["s"].alias("evidence"), evidence_scorer(c["t"], s["t"]).alias("p")))))
    return base.select(key, F.explode(pairs).alias("x")).select(key, "x.claim_pos", "x.evidence_pos", "x.claim", "x.evidence", "x.p")


def regroup(documents: DataFrame, flat: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, arguments): each document's (claim, evidence) in order, [] for documents without any."""
    lists = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("claim_pos", "evidence_pos", "claim", "evidence"))).alias("r"))
    out = F.coalesce(F.transform("r", lambda x: F.struct(x["claim"].alias("claim"), x["evidence"].alias("evidence"))), F.array().cast("array<struct<claim:string,evidence:string>>"))
    return documents.select(key).join(lists, key, "left").select(key, out.alias("arguments"))
