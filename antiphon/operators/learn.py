"""Fitted models on ``pyspark.ml``: claim, evidence and frame classifiers, their search and storage."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens
from ..storage import once

EMBEDDING = 256
#: Words up to which a task holds the common ones; with more of them all longer grams are counted.
COMMON = 1_000_000
#: The boosted models' trees and their depth.
TREES, DEPTH = 200, 4


def _tokenised(column: str, out: str) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, filter(split(lower(coalesce({column}, '')), '[^\\\\p{{L}}\\\\p{{N}}_]+'), t -> t rlike '^[a-z]{{2,}}$') AS {out} FROM __THIS__")


def claim_pipeline(label: str = "is_claim", text: str = "sentence", trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> Pipeline:
    """A sentence's hashed tokens to boosted trees."""
    return Pipeline(stages=[_tokenised(text, "_t"), HashingTF(inputCol="_t", outputCol="features", numFeatures=EMBEDDING), GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)])


def evidence_pipeline(label: str = "is_evidence", trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> Pipeline:
    """Claim and evidence embeddings side by side to boosted trees."""
    hashed = lambda a, b: HashingTF(inputCol=a, outputCol=b, numFeatures=EMBEDDING)
    return Pipeline(stages=[_tokenised("claim", "_a"), _tokenised("evidence", "_b"), hashed("_a", "_va"), hashed("_b", "_vb"), VectorAssembler(inputCols=["_va", "_vb"], outputCol="features"), GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)])


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def tf_idf_weights(df: DataFrame, key: str, text: str = "text", max_n: int = 2, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """((key, idx, term, w), (term, idx, idf)): counts of the ``limit`` commonest 1..max_n-grams times
    ln((1 + documents) / (1 + document count)) + 1, scaled to length 1 per document.

    The vocabulary has at most ``limit`` rows, which bounds its broadcast."""
    held, vocabulary = _term_weights(df, key, text, max_n, limit)
    named = held.select(key, F.explode(F.arrays_zip("idx", "w")).alias("_e")).select(key, "_e.idx", "_e.w")
    return named.join(F.broadcast(vocabulary.select("idx", "term")), "idx").select(key, "idx", "term", "w"), vocabulary


def _commonest(df: DataFrame, text: str, max_n: int, limit: int) -> list[str]:
    """The ``limit`` commonest 1..max_n-grams, ties to the smaller term.

    A longer gram is at most as common as each of its words.  So only those count whose words all are at least
    as common as the ``limit``-th word: what is counted and shuffled is bounded by those words."""
    best = lambda terms: terms.groupBy("term").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "term").limit(limit)
    words = once(df.select(F.explode(tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("total")))
    top = words.orderBy(F.desc("total"), "term").limit(limit).collect()
    if max_n > 1 and top:
        least = top[-1].total if len(top) == limit else 1
        common = words.filter(F.col("total") >= least)
        longer = _longer(df, text, max_n, [r.term for r in common.collect()] if common.count() <= COMMON else None)
        top = best(longer).collect() + top
    words.unpersist()
    return [r.term for r in sorted(top, key=lambda r: (-r.total, r.term))[:limit]]


def _longer(df: DataFrame, text: str, max_n: int, words: list[str] | None) -> DataFrame:
    """(term): the 2..max_n-grams of the texts, of those words only if there are any given."""
    grams = F.concat(*[ngrams(F.col("_t"), n) for n in range(2, max_n + 1)])
    rows = df.select(tokens(F.col(text)).alias("_t"))
    if words is None:
        return rows.select(F.explode(grams).alias("term"))
    known = frozenset(words)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            out = []
            for t in many:
                some = [w if w in known else None for w in t]
                out.append([" ".join(some[i : i + n]) for n in range(2, max_n + 1) for i in range(len(some) - n + 1) if None not in some[i : i + n]])
            yield pd.Series(out, dtype=object)

    return rows.select(F.explode(run("_t")).alias("term"))


def _term_weights(df: DataFrame, key: str, text: str, max_n: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """((key, idx, w), (term, idx, idf)), arrays in order of the terms: a document's terms are counted in its rows,
    and one shuffle of counts by number brings together the rows of a key."""
    terms = sorted(_commonest(df, text, max_n, limit))
    spark, at = df.sparkSession, {t: i for i, t in enumerate(terms)}

    @F.pandas_udf("struct<idx:array<int>,tf:array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for many in batches:
            ids, counts = [], []
            for t in many:
                own = Counter(at[x] for n in range(1, max_n + 1) for x in (t if n == 1 else map(" ".join, zip(*(t[i:] for i in range(n))))) if x in at)
                ids.append(list(own.keys()))
                counts.append(list(own.values()))
            yield pd.DataFrame({"idx": pd.Series(ids, dtype=object), "tf": pd.Series(counts, dtype=object)})

    rows = df.select(key, run(tokens(F.col(text))).alias("c")).groupBy(key).agg(F.collect_list("c").alias("_c"))

    @F.pandas_udf("struct<idx:array<int>,tf:array<long>>")
    def added(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for many in batches:
            ids, counts = [], []
            for parts in many:
                own: Counter = Counter()
                for c in parts:
                    for i, n in zip(np.asarray(c["idx"]).tolist(), np.asarray(c["tf"]).tolist()):
                        own[i] += n
                ids.append(sorted(own))
                counts.append([own[i] for i in ids[-1]])
            yield pd.DataFrame({"idx": pd.Series(ids, dtype=object), "tf": pd.Series(counts, dtype=object)})

    held = once(rows.select(key, added("_c").alias("_n")).select(key, F.col("_n.idx").alias("_i"), F.col("_n.tf").alias("_tf")))
    docs = held.count()
    df_of = {r.idx: r.df for r in held.select(F.explode("_i").alias("idx")).groupBy("idx").agg(F.count("*").alias("df")).collect()}  # at most ``limit``
    weights = np.array([math.log((1.0 + docs) / (1 + df_of[i])) + 1 for i in range(len(terms))])
    vocabulary = spark.createDataFrame([(t, i, float(weights[i])) for i, t in enumerate(terms)], "term string, idx int, idf double")

    @F.pandas_udf("array<double>")
    def weighed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, counts in batches:
            out = []
            for i, n in zip(ids, counts):
                w = np.asarray(n, float) * weights[np.asarray(i, int)]
                out.append(w / np.sqrt((w * w).sum()) if len(w) else w)
            yield pd.Series(out, dtype=object)

    return held.select(key, F.col("_i").alias("idx"), weighed("_i", "_tf").alias("w")), vocabulary


def tf_idf(df: DataFrame, key: str, text: str = "text", max_n: int = 2, limit: int = 1000) -> DataFrame:
    """(key, features): the weights as sparse vectors; a document without known terms has an empty one.

    The vocabulary, at most ``limit`` terms, goes through the driver."""
    _, vocabulary = tf_idf_weights(df, key, text, max_n, limit)
    terms = vocabulary.orderBy("idx").collect()
    t = F.col("_t")
    rows = df.select(key, tokens(F.col(text)).alias("_t")).select(key, F.concat(*[ngrams(t, n) for n in range(1, max_n + 1)]).alias("_grams"))
    if not terms:
        return rows.select(key, array_to_vector(F.array_repeat(F.lit(0.0), limit)).alias("features"))
    counts = CountVectorizerModel.from_vocabulary([r.term for r in terms], inputCol="_grams", outputCol="_counts")
    weighted = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in terms]), inputCol="_counts", outputCol="_weighted")
    out = Normalizer(p=2.0, inputCol="_weighted", outputCol="features").transform(weighted.transform(counts.transform(rows)))
    return out.select(key, "features")


def sparse_rows(df: DataFrame, key: str, text: str = "text", max_n: int = 2, limit: int = 1000) -> DataFrame:
    """(key, idx, w): ``tf_idf_weights`` as two arrays per document, in order of the terms; empty ones without known terms."""
    return _term_weights(df, key, text, max_n, limit)[0]


def frame_classifier(label: str = "label", iterations: int = 30) -> LogisticRegression:
    """Multinomial logistic regression: quick; ``boosted_frames`` takes trees."""
    return LogisticRegression(labelCol=label, featuresCol="features", family="multinomial", maxIter=iterations, regParam=0.01)


def boosted_frames(label: str = "label", trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> OneVsRest:
    """Boosted trees for each frame against the others, since they know two classes only."""
    return OneVsRest(labelCol=label, featuresCol="features", classifier=GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, seed=seed))


def tuned(pipeline: Pipeline, train: DataFrame, label: str, grid: dict[str, list] | None = None, folds: int = 3, seed: int = 42) -> CrossValidatorModel:
    """Grid search with cross-validation over the last stage's parameters (F1)."""
    last = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in (grid or {"maxDepth": [2, 4]}).items():
        builder = builder.addGrid(last.getParam(name), values)
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    return CrossValidator(estimator=pipeline, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, seed=seed).fit(train)


def mean_score(model: CrossValidatorModel) -> float:
    """The best setting's mean over the folds."""
    return max((m for m in model.avgMetrics if not math.isnan(m)), default=0.0)


def area(scored: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label).evaluate(scored)


def save(model: Transformer, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scored_once(df: DataFrame, text: str, score) -> DataFrame:
    """``df`` with ``_score``: each distinct text is scored once and joined back."""
    once = df.select(text).distinct()
    return df.join(once.withColumn("_score", score(F.col(text))), text, "left")
