"""Exact top-k by inner product as a Voronoi join.

Vectors become integers (floor of ``scale`` times the component).  Pivots come from a bounded sample;
every vector belongs to its nearest pivot's cell, whose count and radius are its summary.

1. A query meets all vectors of its own cell; the k-th best score there is its bound.
2. Another cell is needed if query * pivot + |query| * radius reaches that bound (Cauchy-Schwarz).  Only
   then the query is copied to it; what a cell gives is merged with the best of the own cell.

The queries are the smaller side, so they travel: a vector moves once in each of the two passes, a query
to every block of the cells it needs.  A cell is dealt into blocks of about BLOCK_VALUES components, which
a task holds while queries stream past it, so neither a large cell nor a cell that all queries need has to
fit a task.

The sample and the pivots change the speed, not the result.  Ties go to the smaller id.  Vectors that are
null, empty or hold a null or non-finite component take no part, nor do rows with a null id.  Only
vectors of one length have an inner product: those of another length than the sample's commonest form a
cell of their own for each length.  Rows with equal ids are separate candidates, but a query never meets
rows of its own id, and of equal query ids the smallest vector asks.  With fewer than k candidates all are
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Sampled vectors, at least and for each pivot, and the most pivots.
SAMPLE, PER_PIVOT, PIVOTS = 2_000, 4, 2_048
#: Components in a block of data, and queries whose scores are held at once.
BLOCK_VALUES, TILE = 1 << 20, 128
NONE = np.iinfo(np.int64).min


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null where the vector is unusable."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """A few rounds of k-means from evenly spaced rows."""
    centre = sample[np.linspace(0, len(sample) - 1, k).astype(int)].astype(float)
    centre = np.unique(centre, axis=0)
    for _ in range(6):
        near = _nearest(sample, centre)[0]
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=len(centre))
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(float)
    near = ((centre**2).sum(1)[None] - 2 * x @ centre.T).argmin(1)
    return near, np.sqrt(((x - centre[near]) ** 2).sum(1))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where those are exact, else in 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if top < 2**53 else q @ x.T


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.values.slice(col.offsets[0].as_py(), len(col) * dim)).reshape(-1, dim) if len(col) else np.zeros((0, dim), np.int64)


def _block_rows(dim: Column, values: int) -> Column:
    return F.greatest(F.floor(F.lit(values) / dim), F.lit(64))


def _solve(k: int, dim_of):
    """The k best of each block for each query: rows (cell, block, kind, id, v) in order, data (0) before queries (1)."""

    def best(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(qids), TILE):
            own = qids[lo : lo + TILE]
            s = _scores(q[lo : lo + TILE], x)
            s[own[:, None] == ids[None]] = NONE
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(own), NONE)
            row, col = np.nonzero((s >= least[:, None]) & (s > NONE))
            score = s[row, col]
            by = np.lexsort((ids[col], -score, row))
            row, col, score = row[by], col[by], score[by]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(own[row[keep]]), pa.array(ids[col[keep]]), pa.array(score[keep])], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, x = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            of = np.stack([np.asarray(b.column(i)) for i in range(3)], 1)
            cut = np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(of)]):
                if key != (now := tuple(of[lo, :2].tolist())):
                    key, ids, parts, x = now, [], [], None
                part = b.slice(lo, hi - lo)
                own, v = np.asarray(part.column(3)), _matrix(part.column(4), dim_of(key[0]))
                if of[lo, 2] == 0:
                    ids.append(own)
                    parts.append(v)
                elif parts:
                    if x is None:
                        ids, x = [np.concatenate(ids)], np.concatenate(parts)
                        parts = [x]
                    yield from best(ids[0], x, own, v)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_values: int = BLOCK_VALUES) -> DataFrame:
    """(query_id, rank, id, score) of the k best rows for each row that ``queries`` (on ``id``) marks."""
    spark = vectors.sparkSession
    small_batches(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    n = base.count()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    if not n:
        return empty
    many = min(PIVOTS, max(1, int(math.sqrt(n) / 4)))
    share = max(1, n // max(SAMPLE, PER_PIVOT * many))
    got = base.filter(F.pmod(F.xxhash64("id", "v"), F.lit(share)) == 0).limit(4 * max(SAMPLE, PER_PIVOT * many)).collect() or base.limit(SAMPLE).collect()
    dim = Counter(len(r.v) for r in got).most_common(1)[0][0]
    sample = np.array(sorted(r.v for r in got if len(r.v) == dim), np.int64)
    centre = _pivots(sample, min(many, len(sample)))
    dim_of = lambda cell: dim if cell >= 0 else -cell  # noqa: E731  cells below 0 hold the vectors of one other length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, far = _nearest(_matrix(b.column(1), dim), centre)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(far)], names=["id", "v", "cell", "far"])

    odd = base.filter(F.size("v") != dim).withColumn("cell", -F.size("v")).withColumn("far", F.lit(0.0))
    placed = materialise(base.filter(F.size("v") == dim).mapInArrow(assign, "id long, v array<long>, cell int, far double").union(odd), "cells")
    counts = placed.groupBy("cell").agg(F.count("*").alias("m"), F.max("far").alias("far"))
    blocks = F.ceil(F.col("m") / _block_rows(F.when(F.col("cell") >= 0, dim).otherwise(-F.col("cell")), block_values)).cast("int")
    sizes = materialise(counts.select("cell", "far", blocks.alias("blocks")), "sizes")
    large = F.broadcast(sizes.filter("blocks > 1").select("cell", "blocks"))  # at most as many rows as there are blocks of data
    summary = {r.cell: (r.blocks, r.far) for r in sizes.filter("cell >= 0").collect()}  # a row per pivot
    cells = np.array(sorted(summary), np.int64)
    radius = np.array([summary[c][1] for c in cells.tolist()]) * (1 + 1e-9) + 1e-6

    asked = placed.filter(queries).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("s")).select("id", "s.v", "s.cell")
    asked = materialise(asked, "asked")
    data = placed.join(large, "cell", "left").select("cell", F.pmod(F.xxhash64("id", "v"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def solved(data: DataFrame, sent: DataFrame) -> DataFrame:
        rows = data.unionByName(sent.select("cell", "block", F.lit(1).alias("kind"), "id", "v"))
        return rows.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(_solve(k, dim_of), "query_id long, id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # 1. the own cell
    home = asked.join(large, "cell", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    held = sizes.select("cell").join(asked.select("cell").distinct(), "cell")
    first = materialise(ranked(solved(data.join(held, "cell", "left_semi"), home)), "first")

    # 2. the cells that could hold a better one
    bound = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, q, own = np.asarray(b.column(0)), _matrix(b.column(1), dim), np.asarray(b.column(2))
            least = b.column(3).fill_null(NONE).to_numpy().astype(float)
            f = q.astype(float)
            most = f @ centre[cells].T + np.sqrt((f**2).sum(1))[:, None] * radius[None]
            row, col = np.nonzero((most + np.abs(most) * 1e-9 + 1 >= least[:, None]) & (cells[None] != own[:, None]))
            times = np.array([summary[c][0] for c in cells.tolist()], np.int64)[col]
            at, row, col = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times), np.repeat(row, times), np.repeat(col, times)
            for lo in range(0, len(row), 4096):
                r, c = row[lo : lo + 4096], cells[col[lo : lo + 4096]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at[lo : lo + 4096], pa.int32()), pa.array(ids[r], pa.int64()), b.column(1).take(pa.array(r))], names=["cell", "block", "id", "v"])

    sent = asked.filter("cell >= 0").join(bound, "id", "left").select("id", "v", "cell", "least").mapInArrow(route, "cell int, block int, id long, v array<long>")
    more = solved(data.filter("cell >= 0"), sent)
    found = ranked(first.select("query_id", "id", "score").union(more))
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
