"""Keyword extraction: counts of tokens or n-grams per document, the k most frequent.

A document is one row, so its items are counted and ranked where the row stands: nothing is shuffled and
only the k best leave.  Counting works on whole Arrow batches of token lists, as numbers; n-grams never
exist as strings but for those that are returned."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens

Tokeniser = Callable[[Column], Column]


def _top(items: Column, k: int, sizes: Sequence[int] = (1,)) -> Column:
    """Array of (keyword, n): the k most frequent n-grams of the sizes; ties to the smaller size, then the first place."""

    @F.arrow_udf("array<struct<keyword:string,n:bigint>>")
    def run(lists: pa.Array) -> pa.Array:
        size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        code, names = np.asarray(words.indices).astype(np.int64), words.dictionary.to_pylist()
        doc = np.repeat(np.arange(len(size)), size)
        left = np.cumsum(size)[doc] - np.arange(len(doc))  # tokens of the document from here on
        gram, found = np.zeros(len(doc), np.int64), []
        for n in range(1, max(sizes) + 1):
            at = np.flatnonzero(left >= n)
            gram = np.unique(gram[at] * len(names) + code[at + n - 1], return_inverse=True)[1] if len(at) else at
            if n in sizes and len(at):
                _, first, many = np.unique(doc[at] * (gram.max() + 1) + gram, return_index=True, return_counts=True)
                found.append((doc[at[first]], many, np.full(len(first), n), at[first]))
            whole = np.zeros(len(doc), np.int64)
            whole[at] = gram
            gram = whole
        if not found:
            return pa.array([[]] * len(size), pa.list_(pa.struct([("keyword", pa.string()), ("n", pa.int64())])))
        own, many, of, place = (np.concatenate(v) for v in zip(*found))
        by = np.lexsort((place, of, -many, own))
        own, many, of, place = own[by], many[by], of[by], place[by]
        keep = np.arange(len(own)) - np.searchsorted(own, own) < k
        own, many, of, place = own[keep], many[keep], of[keep], place[keep]
        text = [" ".join([names[c] for c in code[p : p + n]]) for p, n in zip(place.tolist(), of.tolist())]
        rows = pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(many, pa.int64())], names=["keyword", "n"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(size) + 1)), pa.int32()), rows)

    return run(items)


def _ranked(df: DataFrame, key: str, items: Column, k: int, sizes: Sequence[int] = (1,)) -> DataFrame:
    rows = df.select(key, F.posexplode(_top(items, k, sizes)).alias("rank", "x"))
    return rows.select(key, (F.col("rank") + 1).alias("rank"), "x.keyword", "x.n")


def _places(items: Column, stop_words: Sequence[str]) -> Column:
    return F.filter(items, lambda t: ~t.isin(*stop_words)) if stop_words else items


def simple(df: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text", tokeniser: Tokeniser = tokens, stop_words: Sequence[str] = ()) -> DataFrame:
    """(key, rank, keyword, n): the k most frequent tokens, ties by first occurrence."""
    items = _places(tokeniser(F.col(text)), stop_words)
    return _ranked(df, key, items, k)


def ngram(df: DataFrame, k: int = 5, min_n: int = 2, max_n: int = 4, key: str = "doc_id", text: str = "text", tokeniser: Tokeniser = tokens, stop_words: Sequence[str] = ()) -> DataFrame:
    """The k most frequent n-grams of the sizes given; ties to the smaller size, then first occurrence."""
    if not 1 <= min_n <= max_n:
        raise ValueError("sizes must satisfy 1 <= min_n <= max_n")
    return _ranked(df, key, _places(tokeniser(F.col(text)), stop_words), k, range(min_n, max_n + 1))


def by_embedding(df: DataFrame, embed: Callable[[Column], Column], similarity: Callable[[Column, Column], Column], k: int = 5, max_n: int = 2, key: str = "doc_id", text: str = "text", stop_words: Sequence[str] = ()) -> DataFrame:
    """The k phrases nearest to their document; ``embed`` maps text to an array (any expression or UDF)."""
    base = df.select(key, F.col(text).alias("_doc"), _places(tokens(F.col(text)), stop_words).alias("t"))
    grams = F.array_distinct(F.concat(*[ngrams(F.col("t"), n) for n in range(1, max_n + 1)]))
    rows = base.select(key, embed(F.col("_doc")).alias("_v"), F.posexplode(grams).alias("place", "keyword"))
    scored = rows.select(key, "keyword", "place", similarity(F.col("_v"), embed(F.col("keyword"))).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "place")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "rank", "keyword", "score")


def query_text(top: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, keywords, normalized): the ranked keywords, and joined by spaces."""
    kept = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("r"))
    words = F.transform("r", lambda x: x["keyword"])
    return kept.select(key, words.alias("keywords"), F.array_join(words, " ").alias("normalized"))
