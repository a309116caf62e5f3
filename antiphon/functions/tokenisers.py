"""Tokenisers with an alphabet of their own: text to tokens, to ids and back, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens


class Tokeniser(Protocol):
    def tokenise(self, text: Column) -> Column: ...

    def encode(self, text: Column) -> Column: ...

    def decode(self, ids: Column) -> Column: ...


class WordTokeniser:
    """Words a-z by their place in a vocabulary, from 1; id 0 stands for every other word.

    Calling it tokenises, so that it serves where a column function is wanted."""

    def __init__(self, vocabulary: Sequence[str], unknown: str = "?"):
        if len(set(vocabulary)) < len(vocabulary):
            raise ValueError("a vocabulary must not repeat words")
        self.vocabulary, self.unknown = list(vocabulary), unknown
        self._known = {w: i for i, w in enumerate(self.vocabulary, 1)}

    @classmethod
    def fit(cls, df: DataFrame, size: int, text: str = "text") -> WordTokeniser:
        """With the ``size`` commonest words of a column, ties in their own order; those reach the driver."""
        counts = df.select(F.explode(tokens(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        return cls([r.w for r in counts.orderBy(F.desc("n"), "w").limit(size).collect()])

    def tokenise(self, text: Column) -> Column:
        return tokens(text)

    __call__ = tokenise

    def encode(self, text: Column) -> Column:
        """Ids from a table by word, however large the vocabulary."""
        known = self._known

        @F.pandas_udf("array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series([[known.get(w, 0) for w in words] for words in b], dtype=object)

        return run(tokens(text))

    def decode(self, ids: Column) -> Column:
        """Words joined by spaces; null for an id outside the vocabulary."""
        words = F.array(*[F.lit(w) for w in (self.unknown, *self.vocabulary)])
        found = F.transform(ids, lambda i: F.get(words, i))
        return F.when(~F.exists(found, lambda w: w.isNull()), F.array_join(found, " "))
