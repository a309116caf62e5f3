"""Dense text vectors without a language model: co-occurrence counts, positive PMI, a randomised SVD.

Counting and every product with the matrix run in tasks; what the driver and each task hold is bounded by the
vocabulary (``limit`` words) times the dimensions, never by the corpus.  Sums follow a fixed order, so a model
is the same however the input is partitioned.  Null and empty texts have no words; a text without known words
gets zeros; repeated rows count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import dot
from ..storage import once

LIMIT, WINDOW, DIMENSIONS = 2_000, 5, 64
#: Columns beyond the dimensions and rounds of the randomised SVD.
EXTRA, ROUNDS = 16, 3
#: Places whose pairs are counted at once.
SLICE = 1 << 18


def vocabulary(df: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(word, idx, n): the ``limit`` commonest tokens of all texts, ties in order of the words; idx from 0."""
    top = df.select(F.explode(tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(limit)
    return top.withColumn("idx", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).cast("int")).select("word", "idx", "n")


def _codes(lists: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, word) of each token by number, -1 for an unknown word."""
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    code = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1)).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), code


def cooccurrences(df: DataFrame, words: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """(a, b, n): how often words a and b (by number) stand at most ``window`` tokens apart, in both orders.

    Other words keep their places.  Only a <= b is shuffled, at most limit * (limit + 1) / 2 sums."""
    known, many = pa.array(words, pa.string()), max(1, len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, code = _codes(batch.column(0), known)
            for lo in range(0, len(code), SLICE):
                keys = []
                for d in range(1, window + 1):
                    i = np.arange(lo, min(lo + SLICE, len(code) - d))
                    i = i[(code[i] >= 0) & (code[i + d] >= 0) & (doc[i] == doc[i + d])]
                    a, b = code[i], code[i + d]
                    keys.append(np.minimum(a, b) * many + np.maximum(a, b))
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // many, pa.int32()), pa.array(key % many, pa.int32()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    half = df.select(tokens(F.col(text)).alias("t")).mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    same, sides = F.col("a") == F.col("b"), F.struct("a", "b")
    both = F.when(same, F.array(sides)).otherwise(F.array(sides, F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(F.explode(both).alias("x"), F.when(same, 2 * F.col("n")).otherwise(F.col("n")).alias("n")).select("x.a", "x.b", "n")


def positive_pmi(counts: DataFrame) -> DataFrame:
    """(a, b, n, ppmi): ln(n * all / (n of a * n of b)) where that is above 0; other pairs go.

    ``counts`` is read twice: pass a written table."""
    by_word = counts.groupBy("a").agg(F.sum("n").alias("own"))
    total = by_word.agg(F.sum("own").alias("all"))
    # a row for each word of a bounded vocabulary, and one for the total
    sized = counts.join(F.broadcast(by_word), "a").join(F.broadcast(by_word.select(F.col("a").alias("b"), F.col("own").alias("other"))), "b").crossJoin(F.broadcast(total))
    pmi = F.log(F.col("n").cast("double") * F.col("all") / (F.col("own").cast("double") * F.col("other")))
    return sized.select("a", "b", "n", pmi.alias("ppmi")).filter("ppmi > 0")


def _product(rows: DataFrame, right: np.ndarray) -> np.ndarray:
    """The matrix of ``rows`` (a, idx, w) times ``right``; each row's sum follows its own order of columns."""
    sent = rows.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(np.asarray(w) @ sent.value[np.asarray(idx)]).tobytes() for idx, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["a", "y"])

    out = np.zeros_like(right)
    for r in rows.mapInArrow(run, "a int, y binary").collect():  # a row for each word of the vocabulary
        out[r.a] = np.frombuffer(r.y)
    sent.destroy()
    return out


def decompose(ppmi: DataFrame, words: int, dimensions: int = DIMENSIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(left singular vectors, singular values) of the symmetric matrix of ``ppmi``, the largest first.

    A vector's largest entry is positive.  Fewer dimensions where the vocabulary is smaller."""
    # a word's row has at most as many entries as the vocabulary has words
    rows = once(ppmi.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "ppmi"))).alias("x")).select("a", F.col("x.b").alias("idx"), F.col("x.ppmi").alias("w")))
    k = min(dimensions, words)
    q = np.random.default_rng(seed).standard_normal((words, min(words, k + EXTRA)))
    for _ in range(ROUNDS):
        q = np.linalg.qr(_product(rows, np.linalg.qr(q)[0]))[0]
    u, s, _ = np.linalg.svd(_product(rows, q), full_matrices=False)
    u, s = u[:, :k], s[:k]
    if words:
        u = u * np.where(u[np.abs(u).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return u, s


def nearness(a: Column, b: Column) -> Column:
    """The cosine of two text vectors, 0 where either has no known words."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


class WordVectors:
    """A word's vector: its row of left singular vectors, each times the root of its singular value."""

    def __init__(self, words: list[str], matrix: np.ndarray):
        self.words, self.matrix = words, matrix.astype(np.float64)

    @property
    def dimensions(self) -> int:
        return self.matrix.shape[1]

    def embed(self, text: Column) -> Column:
        """The mean vector of a text's known tokens, repeats counted; zeros where there are none."""
        words, matrix = pa.array(self.words, pa.string()), self.matrix

        @F.arrow_udf("array<double>")
        def run(lists: pa.Array) -> pa.Array:
            doc, code = _codes(lists, words)
            doc, code = doc[code >= 0], code[code >= 0]
            pair, n = np.unique(doc * max(1, len(words)) + code, return_counts=True)
            doc, code = pair // max(1, len(words)), pair % max(1, len(words))
            out = np.zeros((len(lists), matrix.shape[1]))
            for lo in range(0, len(doc), 4096):
                np.add.at(out, doc[lo : lo + 4096], matrix[code[lo : lo + 4096]] * n[lo : lo + 4096, None])
            out /= np.maximum(np.bincount(doc, n, len(lists)), 1)[:, None]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * matrix.shape[1], pa.int32()), pa.array(out.ravel()))

        return run(tokens(text))

    def table(self, spark: SparkSession) -> DataFrame:
        """(idx, word, vector), a row for each word."""
        return spark.createDataFrame([(i, w, v.tolist()) for i, (w, v) in enumerate(zip(self.words, self.matrix))], "idx int, word string, vector array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WordVectors:
        rows = spark.read.parquet(path).orderBy("idx").collect()  # the vocabulary, as bounded when it was fitted
        return cls([r.word for r in rows], np.array([r.vector for r in rows]).reshape(len(rows), -1))


def fit(df: DataFrame, text: str = "text", limit: int = LIMIT, window: int = WINDOW, dimensions: int = DIMENSIONS, seed: int = 42) -> WordVectors:
    """Vectors of the ``limit`` commonest words, from all texts."""
    words = [r.word for r in vocabulary(df, text, limit).orderBy("idx").collect()]
    u, s = decompose(positive_pmi(once(cooccurrences(df, words, text, window))), len(words), dimensions, seed)
    return WordVectors(words, u * np.sqrt(s))
