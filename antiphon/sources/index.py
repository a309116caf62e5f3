"""An inverted index as a table: lists of terms in blocks of documents, with score bounds for early stop.

Documents are dealt into blocks of about ``BLOCK`` by a hash of their address and numbered within a block
in order of their addresses.  A row of ``postings`` is one term in one block: the term's number of
documents in all blocks, its numbers in this one, each with its share of a score, and the largest of those
shares.  Common terms therefore have a row for each block, not for each document.  The table is written in
folders by a hash of the term, so that a search reads the folders of its own terms alone.

A search first adds up each block's bound from those largest shares, without opening a list.  The block
with the highest bound is scored whole; then only blocks whose bound reaches the k-th best score so far.
Results are exact; ties go to the smaller address.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import once

BLOCK = 2_048
FOLDERS = 64
#: Terms up to which an index for some terms alone holds them in its tasks.
KNOWN = 100_000
#: The saturation of a term's frequency, and how much a document's length counts.
K1, B = 1.2, 0.75
#: Decimal places to which scores are compared.
PLACES = 9


@dataclass(frozen=True)
class Index:
    """``documents``: (block, ord, url); ``postings``: (folder, term, block, df, bound, ords, shares)."""

    documents: DataFrame
    postings: DataFrame
    n: int

    def save(self, path: str) -> None:
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        self.postings.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        documents = spark.read.parquet(f"{path}/documents")
        return cls(documents, spark.read.parquet(f"{path}/postings"), documents.count())


def _folder(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _counted(known: frozenset[str] | None):
    """A document's distinct tokens, of ``known`` ones if there are any given, and how often each is there."""

    @F.pandas_udf("struct<terms:array<string>,tf:array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for many in batches:
            bags = [Counter(t if known is None else (w for w in t if w in known)) for t in many]
            yield pd.DataFrame({"terms": pd.Series([list(b.keys()) for b in bags], dtype=object), "tf": pd.Series([list(b.values()) for b in bags], dtype=object)})

    return run


def build(documents: DataFrame, url: str = "url", text: str = "text", block: int = BLOCK, terms: DataFrame | None = None) -> Index:
    """The index of all rows; each row is a document of its own.  Rows without an address are left out.

    ``terms`` (term): an index for searches of those terms alone, with the scores of the whole one; if they
    are over ``KNOWN``, all terms are indexed.  Terms are counted in their row, so that only postings move."""
    known = None
    if terms is not None and len(found := terms.select("term").distinct().limit(KNOWN + 1).collect()) <= KNOWN:
        known = frozenset(r.term for r in found)
    rows = documents.select(F.col(url).cast("string").alias("url"), tokens(F.col(text)).alias("t")).filter("url is not null")
    rows = once(rows.select("url", F.size("t").alias("length"), _counted(known)("t").alias("c")))
    n, mean = rows.agg(F.count("*"), F.avg("length")).first()
    blocks = max(1, ceil(n / block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks)).cast("int"))
    rows = once(rows.withColumn("ord", F.row_number().over(Window.partitionBy("block").orderBy("url")) - 1))
    norm = K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1.0)))
    counted = rows.select("block", "ord", norm.alias("norm"), F.explode(F.arrays_zip("c.terms", "c.tf")).alias("e")).select("block", "ord", "norm", F.col("e.terms").alias("term"), F.col("e.tf").alias("tf"))
    counted = counted.select("term", "block", "ord", (F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))).alias("share"))
    lists = once(counted.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("ord", "share"))).alias("p"), F.max("share").alias("bound")))
    df = lists.groupBy("term").agg(F.sum(F.size("p")).alias("df"))
    postings = lists.join(df, "term").select(_folder().alias("folder"), "term", "block", "df", "bound", F.col("p.ord").alias("ords"), F.col("p.share").alias("shares"))
    return Index(rows.select("block", "ord", "url"), once(postings, by="folder"), n)


def terms_of(queries: DataFrame, text: str = "normalized") -> DataFrame:
    """(term): the tokens that searches for these queries look up."""
    return queries.select(F.explode(tokens(F.col(text))).alias("term")).distinct()


def _best(limit: int):
    """The best documents of a block for a query, from its lists (term, df, weight, ords, shares or null)."""

    @F.pandas_udf("array<struct<ord:int,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            out = []
            for terms in many:
                terms = sorted(terms, key=lambda t: (-t["df"], t["term"]))  # sums do not depend on the order of arrival
                size = 1 + max(int(t["ords"][-1]) for t in terms)
                score, hit = np.zeros(size), np.zeros(size, bool)
                for t in terms:
                    at = np.asarray(t["ords"])
                    score[at] += t["weight"] if t["shares"] is None else t["weight"] * np.asarray(t["shares"], float)
                    hit[at] = True
                score, ords = np.round(score, PLACES), np.flatnonzero(hit)
                best = ords[np.lexsort((ords, -score[ords]))][:limit]
                out.append([{"ord": int(o), "score": float(score[o])} for o in best])
            yield pd.Series(out, dtype=object)

    return run


def search(index: Index, queries: DataFrame, limit: int = 5, key: str = "doc_id", text: str = "normalized", scoring: str = "bm25") -> DataFrame:
    """(key, rank, url, score): each query's best documents among those that share a token with it.

    ``scoring``: "bm25", or "shared" for the number of distinct tokens in common.  Blank queries find
    nothing; rows of one key are one query."""
    if scoring not in ("bm25", "shared"):
        raise ValueError(f"no scoring {scoring}")
    terms = queries.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).distinct().withColumn("folder", _folder())
    met = index.postings.join(terms, ["folder", "term"])
    plain = scoring == "shared"
    weight = F.lit(1.0) if plain else F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    met = once(met.select(key, "block", "term", "df", weight.alias("weight"), F.lit(1.0).alias("bound") if plain else "bound", "ords", F.lit(None).cast("array<double>").alias("shares") if plain else "shares"))
    bounds = met.groupBy(key, "block").agg((F.sum(F.col("weight") * F.col("bound")) + 10.0**-PLACES).alias("most"))
    first = bounds.groupBy(key).agg(F.max_by("block", F.struct("most", "block")).alias("block"))

    pick = _best(limit)

    def best(of: DataFrame) -> DataFrame:
        lists = met.join(of, [key, "block"], "left_semi").groupBy(key, "block").agg(F.collect_list(F.struct("term", "df", "weight", "ords", "shares")).alias("l"))
        return lists.select(key, "block", F.explode(pick("l")).alias("d")).select(key, "block", "d.ord", "d.score")

    opened = once(best(first))
    least = opened.groupBy(key).agg(F.count("*").alias("m"), F.min("score").alias("least"))
    more = bounds.join(first, [key, "block"], "left_anti").join(least, key).filter((F.col("m") < limit) | (F.col("most") >= F.col("least")))
    found = opened.union(best(more.select(key, "block"))).join(index.documents, ["block", "ord"])
    order = Window.partitionBy(key).orderBy(F.desc("score"), "url")
    return found.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < limit).select(key, "rank", "url", "score")
