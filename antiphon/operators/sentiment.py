"""Sentiment by association: a word leans the way of the seed words that share its sentences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.style import NEGATIVE, POSITIVE
from ..functions.text import sentences, tokens
from ..storage import once
from .wordvectors import WordVectors

#: Words of a lexicon at most, and the least sum of a word's counts.
LIMIT, LEAST = 2_000, 3


def orientations(df: DataFrame, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE, text: str = "text", least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """(word, good, bad, orientation): in how many sentences with a positive or a negative seed a word stands,
    and ln((good + 1/2) * (all bad + 1/2) / ((bad + 1/2) * (all good + 1/2))).

    Words whose good and bad come to ``least`` or more, the ``limit`` strongest, ties in order of the words.  Sentences
    without a seed go before anything is shuffled; one with seeds of both sides counts for both; the seeds have
    an orientation like any other word.  Null and empty texts have no sentences."""
    t = F.col("t")
    has = lambda seeds: F.arrays_overlap(t, F.array(*[F.lit(s) for s in seeds]).cast("array<string>"))
    rows = df.select(F.explode(sentences(F.col(text))).alias("s")).select(F.array_distinct(tokens(F.col("s"))).alias("t"))
    rows = rows.select("t", has(positive).cast("long").alias("p"), has(negative).cast("long").alias("m")).filter("p + m > 0")
    # the empty word stands in every sentence: its counts are the totals
    counts = once(rows.select(F.explode(F.array_append(t, "")).alias("word"), "p", "m").groupBy("word").agg(F.sum("p").alias("good"), F.sum("m").alias("bad")))
    total = counts.filter("word = ''").select(F.col("good").alias("_p"), F.col("bad").alias("_m"))
    value = F.log((F.col("good") + 0.5) * (F.col("_m") + 0.5) / ((F.col("bad") + 0.5) * (F.col("_p") + 0.5)))
    some = counts.filter((F.col("word") != "") & (F.col("good") + F.col("bad") >= least)).crossJoin(F.broadcast(total))  # one row
    return some.select("word", "good", "bad", value.alias("orientation")).orderBy(F.desc(F.round(F.abs("orientation"), 9)), "word").limit(limit)


class Lexicon(WordVectors):
    """Words with their orientation as a vector of one entry."""

    def positivity(self, text: Column) -> Column:
        """1 / (1 + exp(-mean orientation of a text's known tokens)); a half where there are none."""
        return F.coalesce(1 / (1 + F.exp(-self.embed(text)[0])), F.lit(0.5)) if self.words else F.lit(0.5)


def lexicon(rows: DataFrame) -> Lexicon:
    """The lexicon of ``orientations``, whose limit bounds what the driver gets."""
    found = sorted(rows.select("word", "orientation").collect())
    return Lexicon([r.word for r in found], np.array([[r.orientation] for r in found]).reshape(-1, 1))
