"""Farthest-k search: the candidates least similar to each reference, within a group.

Both sides are dealt into blocks of bounded size by a hash of their ids; each pair of blocks goes by
matrix products, keeps k rows per reference, and the blocks' winners are merged by a window whose input is
already cut to k rows a block.  A hot group therefore spreads over many tasks.  A row is copied once for each
block of the other side, so the blocks of a large group grow: it has ``COPIES`` of them until one would hold
more than ``MOST`` rows.

Within a pair of blocks, candidates lie in cells of ``CELL`` close ones.  No candidate of a cell is less similar
to a reference than the cell's centre by more than its radius, so ``NEAR`` close references leave out the cells
that this bound puts above all their k-th values.  Of candidates with one vector the k first ids count.  A group
of g references and candidates still costs g squared products over ``CELL``, and where the bound says nothing
(many dimensions without structure) all g squared: that is the operator's own size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from . import tiles

MAX_CANDIDATES = 100
BLOCK = tiles.BLOCK
#: Blocks that a side of a group has while they hold no more rows than ``MOST``.
COPIES, MOST = 4, 65_536
#: Rows of an Arrow batch of pairs; most partitions over which blocks of pairs are dealt.
BATCH, PARTITIONS = 65_536, 2_000
#: Candidates of a cell, references that choose cells together, and what rounding to single precision may move a
#: product or bound of unit vectors by, for each dimension and four more.
CELL, NEAR, SLACK = 32, 256, 2e-7


def _checked(k: int | None) -> int:
    if k is not None and k <= 0:
        raise ValueError("k must be positive")
    return min(k or MAX_CANDIDATES, MAX_CANDIDATES)


def blocks(n: Column, block: int) -> Column:
    """The number of blocks for a side that has ``n`` of ``block`` rows."""
    return F.when(n > COPIES, F.greatest(F.lit(COPIES), F.ceil(n * block / max(MOST, block)))).otherwise(n).cast("int")


def farthest(references: DataFrame, candidates: DataFrame, k: int | None = None, group: str = "label", key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(group, ref_id, rank, cand_id, similarity): at most min(k, 100) candidates of the reference's group
    in ascending cosine similarity, ties by id.  Zero vectors and unequal lengths are errors."""
    k = _checked(k)
    by = tiles.shape(references, candidates, [group], block)
    by = by.withColumn("_lb", blocks(F.col("_lb"), block)).withColumn("_rb", blocks(F.col("_rb"), block))
    rows = lambda df: df.select(group, F.col(key).alias("id"), F.col(vector).alias("v")).join(by, group)
    left = rows(references).withColumn("rb", tiles.own_block("id", "_lb")).withColumn("cb", tiles.every_block("_rb")).select(group, "rb", "cb", "id", "v")
    right = rows(candidates).withColumn("cb", tiles.own_block("id", "_rb")).withColumn("rb", tiles.every_block("_lb"))
    right = right.select(*[F.col(c).alias(n) for c, n in ((group, "_g"), ("rb", "_r"), ("cb", "_c"), ("id", "id"), ("v", "v"))])  # fresh names: both sides may be one table

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        one, two, label = (t[c].combine_chunks() for t, c in ((a, "id"), (b, "id"), (a, group)))
        i, j, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if len(one) and len(two):
            i, j, s = _farthest(_unit(_matrix(a["v"])), _unit(_matrix(b["v"])), two.to_numpy(zero_copy_only=False), k, block)
        columns = [label.take(pa.array(np.zeros(len(i), int))), one.take(pa.array(i)), two.take(pa.array(j)), pa.array(s)]
        return pa.table(columns, names=[group, "ref_id", "cand_id", "similarity"])

    kind = references.schema[group].dataType.simpleString()
    idk = references.schema[key].dataType.simpleString()
    tasks = min(max(1, by.agg(F.sum(F.col("_lb").cast("long") * F.col("_rb"))).first()[0] or 1), PARTITIONS)
    left, right = left.repartition(tasks, group, "rb", "cb"), right.repartition(tasks, "_g", "_r", "_c")
    found = left.groupBy(group, "rb", "cb").cogroup(right.groupBy("_g", "_r", "_c")).applyInArrow(solve, f"`{group}` {kind}, ref_id {idk}, cand_id {idk}, similarity double")
    order = Window.partitionBy(group, "ref_id").orderBy("similarity", "cand_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(group, "ref_id", "rank", "cand_id", "similarity")


def _farthest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, similarity) of each row's k least, ties by id."""
    rows = _first_copies(y, ids, k)
    cells = [rows[c] for c in _halves(y[rows], CELL)]
    rows, many = np.concatenate(cells), np.array([len(c) for c in cells])
    place = np.empty(len(ids), int)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    place, z = place[rows], y[rows]
    centre = np.add.reduceat(z, np.cumsum(many) - many) / many[:, None]
    radius = np.maximum.reduceat(np.sqrt(((z - np.repeat(centre, many, axis=0)) ** 2).sum(1)), np.cumsum(many) - many)
    found, won, slack, single = [], np.zeros(0, int), SLACK * (x.shape[1] + 4), np.float32
    centre, radius, rough = centre.T.astype(single), radius.astype(single), z.astype(single)
    for mine in _halves(x, min(NEAR, block)):
        u = x[mine]
        bound = u.astype(single) @ centre - radius
        best = np.zeros(len(many), bool)
        best[np.argsort(bound.min(0))[: 1 + 4 * k // CELL]] = True
        seeds = np.union1d(won, np.flatnonzero(np.repeat(best, many)))
        least = np.full((len(u), 1), np.inf)
        if len(seeds) >= k:
            least = np.partition(u @ z[seeds].T, k - 1, axis=1)[:, k - 1 : k]
        some = np.flatnonzero(np.repeat((~(bound > (least + slack).astype(single))).any(0), many))
        i, j, s = _least(u, z[some], rough[some], place[some], k, block, least, slack)
        j = some[j]
        won = np.unique(j)[:block]
        found.append((mine[i], rows[j], s))
    return tuple(np.concatenate(v) for v in zip(*found))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """One row a vector; all must have one length."""
    lists = vectors.combine_chunks()
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    if lists.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors must have one length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _first_copies(y: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows of y without those that k equal rows with smaller ids precede."""
    by = np.argsort(ids, kind="stable")
    code = np.ascontiguousarray(y[by] + 0.0)  # no negative zeros
    code = code.view(np.dtype((np.void, code.dtype.itemsize * code.shape[1]))).ravel()
    order = np.argsort(code, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
    nth = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return by[order[nth < k]]


def _halves(m: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of m in parts of at most ``size``: halved at the coordinate that varies most."""
    parts, left = [], [np.arange(len(m))]
    while left:
        rows = left.pop()
        if len(rows) <= size:
            parts.append(rows)
            continue
        mid = len(rows) // 2
        order = np.argpartition(m[rows, m[rows].var(0).argmax()], mid)
        left += [rows[order[mid:]], rows[order[:mid]]]
    return parts


def _least(x: np.ndarray, y: np.ndarray, rough: np.ndarray, place: np.ndarray, k: int, block: int, least: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, similarity) of each row's k least, ties by place; what is over a row's ``least``, and
    its k-th so far, by ``rough`` products is left out.  Equal pairs have equal similarities wherever they stand."""
    i, j, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    for lo in range(0, len(y), block):
        sim = x.astype(rough.dtype) @ rough[lo : lo + block].T
        if sim.shape[1] > k and not np.isfinite(least).all():  # all up to the k-th value, which ties may exceed
            least = np.minimum(least, np.partition(sim, k - 1, axis=1)[:, k - 1 : k] + slack)
        at = np.divmod(np.flatnonzero(~(sim > (least + slack).astype(rough.dtype))), sim.shape[1])
        if not len(at[0]):
            continue
        i, j, s = np.concatenate([i, at[0]]), np.concatenate([j, at[1] + lo]), np.concatenate([s, (x[at[0]] * y[at[1] + lo]).sum(1)])
        order = np.lexsort((place[j], s, i))
        i, j, s = i[order], j[order], s[order]
        some = np.arange(len(i)) - np.searchsorted(i, np.arange(len(x)))[i] < k
        i, j, s = i[some], j[some], s[some]
        full = np.bincount(i, minlength=len(x)) == k
        last = np.searchsorted(i, np.arange(len(x)), "right") - 1
        least[full, 0] = s[last[full]]
    return i, j, s


def cosine_pairs(df: DataFrame, group: str = "label", key: str = "vec_id", vector: str = "embedding", digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(group, key_1, key_2, similarity): all ordered pairs of a group's rows, each row with itself included.

    Each pair of blocks is one matrix product, written as Arrow batches.  The similarity is null where a side
    is null, zero or holds nulls, or where lengths differ; rows without a group meet nothing."""
    by = tiles.shape(df, df, [group], block)
    tasks = min(max(1, by.agg(F.sum(F.col("_lb").cast("long") * F.col("_rb"))).first()[0] or 1), PARTITIONS)
    rows = df.select(group, F.col(key).alias("id"), F.col(vector).alias("v")).join(by, group)
    left = rows.withColumn("lb", tiles.own_block("id", "_lb")).withColumn("rb", tiles.every_block("_rb")).select(group, "lb", "rb", "id", "v")
    right = rows.withColumn("rb", tiles.own_block("id", "_rb")).withColumn("lb", tiles.every_block("_lb"))
    right = right.select(*[F.col(c).alias(n) for c, n in ((group, "_g"), ("lb", "_l"), ("rb", "_r"), ("id", "id"), ("v", "v"))])  # fresh names: both sides are one table
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{group}` {kinds[group]}, `{key}_1` {kinds[key]}, `{key}_2` {kinds[key]}, similarity double"
    names = [group, f"{key}_1", f"{key}_2", "similarity"]

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        one, two = (t["id"].combine_chunks() for t in (a, b))
        label, batches = a[group].combine_chunks()[:1], []
        x, y = _by_length(a["v"]), _by_length(b["v"])
        step = max(1, BATCH // max(1, len(two)))
        for lo in range(0, len(one) if len(two) else 0, step):
            n = min(step, len(one) - lo)
            sim, null = np.zeros((n, len(two))), np.ones((n, len(two)), bool)
            for width in x.keys() & y.keys():
                (i, u), (j, v) = x[width], y[width]
                some = (i >= lo) & (i < lo + n)
                at = np.ix_(i[some] - lo, j)
                sim[at], null[at] = u[some] @ v.T, False
            s = np.floor(np.abs(sim) * 10.0**digits + 0.5) / 10.0**digits
            s = np.where(s == 0, 0.0, np.copysign(s, sim)).ravel()
            at = pa.array(np.repeat(np.arange(lo, lo + n), len(two))), pa.array(np.tile(np.arange(len(two)), n))
            columns = [label.take(pa.array(np.zeros(len(s), int))), one.take(at[0]), two.take(at[1]), pa.array(s, mask=null.ravel())]
            batches.append(pa.RecordBatch.from_arrays(columns, names=names))
        return pa.Table.from_batches(batches) if batches else pa.table([label[:0], one[:0], two[:0], pa.array([], pa.float64())], names=names)

    left, right = left.repartition(tasks, group, "lb", "rb"), right.repartition(tasks, "_g", "_l", "_r")
    return left.groupBy(group, "lb", "rb").cogroup(right.groupBy("_g", "_l", "_r")).applyInArrow(solve, schema)


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the rows and the unit vectors of those that have one."""
    lists = vectors.combine_chunks()
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    values = lists.flatten()
    start = np.cumsum(lengths) - lengths
    gaps = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
    held = np.asarray(values.fill_null(0), float)
    out = {}
    for width in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero((lengths == width) & (gaps[start + lengths] == gaps[start]))
        m = held[start[rows][:, None] + np.arange(width)]
        norm = np.sqrt((m * m).sum(1))
        some = ~(norm == 0)
        out[width] = rows[some], m[some] / norm[some, None]
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    if (n == 0).any():
        raise ValueError("a vector has zero length")
    return m / n


def farthest_native(references: DataFrame, candidates: DataFrame, k: int | None = None, group: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The same rows from JVM expressions alone: better for short vectors and small groups."""
    k = _checked(k)
    r = references.select(group, F.col(key).alias("ref_id"), unit(F.col(vector)).alias("_a"))
    c = candidates.select(group, F.col(key).alias("cand_id"), unit(F.col(vector)).alias("_b"))
    sim = r.join(c, group).select(group, "ref_id", "cand_id", dot(F.col("_a"), F.col("_b")).alias("similarity"))
    order = Window.partitionBy(group, "ref_id").orderBy("similarity", "cand_id")
    return sim.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(group, "ref_id", "rank", "cand_id", "similarity")


def counterarguments(arguments: DataFrame, found: DataFrame, candidates: DataFrame, group: str = "primary_frame", key: str = "id") -> DataFrame:
    """(argument columns, counterarguments): each argument with its found candidates in rank order; an
    argument without any keeps an empty list.  ``candidates``: (key, claim, evidence)."""
    named = found.join(candidates.select(F.col(key).alias("cand_id"), F.struct("claim", "evidence").alias("c")), "cand_id")
    lists = named.groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("r"))
    out = arguments.join(lists.withColumnRenamed("ref_id", key), key, "left")
    empty = F.array().cast("array<struct<claim:string,evidence:string>>")
    return out.withColumn("counterarguments", F.coalesce(F.transform("r", lambda x: x["c"]), empty)).drop("r")
