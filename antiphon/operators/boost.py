"""Gradient boosting for several classes at once: softmax gradients, histograms added up by Spark.

A round grows one tree for each class, level by level; a level is one job.  Tasks hold their rows' features
with their bins as numbers, turn the margins so far into probabilities, and count gradients and curvatures by
class, node, feature and bin.  Below the root only the child with less curvature is counted: its sibling's
histogram is their parent's, which is kept, less its own.  Histograms are added up in one shuffle by class and
node, each sum's best split is found where it lies, and the driver gets one row for each class and node.
Gradients and curvatures are multiples of ``UNIT``, so that sums of up to 8 million rows are exact in any order.
Leaves follow from the splits' own sums.  Margins are written anew every ``KEEP`` rounds, so that a row meets
few trees in a level.

Features are sparse: ``idx`` (numbers below ``features``) and ``w`` (their values, above 0; all others are
0).  A feature's bins are cut at quantiles of its values; bin 0 is for 0.  A histogram has features x BINS
entries, which bounds what a task holds: classes x 2 ** (depth - 2) of them, times two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..storage import once, part

BINS, KEEP = 8, 5
#: Gradients and curvatures are multiples of it; entries that are added up at a time at a root.
UNIT, ENTRIES = 2.0**-30, 100_000
#: The share of a tree's values that counts, the pull of leaves towards 0, the least curvature of a leaf.
RATE, PULL, LEAST = 0.3, 1.0, 1.0


@dataclass
class Tree:
    """A full tree of some depth: rows whose bin is over ``cut`` go right; a node without a feature sends all left."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2**depth - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n + 1))

    def nodes(self, x: np.ndarray, level: int) -> np.ndarray:
        """Each row's node of a level, from 0 on."""
        at = np.zeros(len(x), np.uint8 if level <= 8 else int)
        for above in range(level):
            right = np.zeros(len(x), bool)
            for m in range(2**above):
                f = self.feature[2**above - 1 + m]
                if f >= 0:
                    right |= (at == m) & (x[:, f] > self.cut[2**above - 1 + m])
            at = 2 * at + right
        return at


@dataclass
class Forest:
    edges: list[np.ndarray]
    base: np.ndarray
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, idx: list[np.ndarray], w: list[np.ndarray]) -> np.ndarray:
        """A row of bins for each list of features."""
        out = np.zeros((len(self.edges), len(idx)), np.uint8).T  # a feature's bins side by side
        sizes = np.array([min(len(a), len(b)) for a, b in zip(idx, w)], int)
        if not sizes.sum():
            return out
        f = np.concatenate([np.asarray(a, int)[:n] for a, n in zip(idx, sizes)])
        v = np.concatenate([np.asarray(b, float)[:n] for b, n in zip(w, sizes)])
        row, some = np.repeat(np.arange(len(idx)), sizes), (f >= 0) & (f < len(self.edges))
        row, f, v = row[some], f[some], v[some]
        most = np.array([len(e) for e in self.edges])
        cuts = np.full((len(self.edges), most.max()), np.inf)
        for e, at in zip(self.edges, cuts):
            at[: len(e)] = e
        below = np.where(np.isnan(v), most[f], 0)
        for c in cuts.T:
            below += c[f] <= v
        out[row, f] = 1 + np.minimum(below, most[f])
        return out

    def margins(self, x: np.ndarray, since: int = 0) -> np.ndarray:
        """What the rounds from ``since`` on add up to, for each class."""
        out = np.zeros((len(self.base), len(x)))
        for trees in self.rounds[since:]:
            for k, t in enumerate(trees):
                out[k] += t.leaf[t.nodes(x, self.depth)]
        return out.T

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.base + self.margins(x))

    def column(self, idx: Column, w: Column) -> Column:
        """The classes' probabilities of sparse features."""

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for i, v in batches:
                yield pd.Series(list(self.probabilities(self.bins(i.tolist(), v.tolist()))), dtype=object)

        return run(idx, w)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def best_split(sums: np.ndarray, features: int) -> tuple[float, float, float, int, int, float, float]:
    """(G, H, gain, feature, cut, G left, H left) of a node's sums; feature is -1 where no split gains."""
    G, H = float(sums[0]), float(sums[1])
    g, h = sums[2:].reshape(2, features, BINS).copy()
    g[:, 0], h[:, 0] = G - g[:, 1:].sum(1), H - h[:, 1:].sum(1)
    gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    gain = gl**2 / (hl + PULL) + (G - gl) ** 2 / (H - hl + PULL) - G**2 / (H + PULL)
    gain[(hl < LEAST) | (H - hl < LEAST)] = 0
    k = int(gain.argmax())
    f, cut = divmod(k, BINS - 1)
    return (G, H, float(gain[f, cut]), f, cut, float(gl[f, cut]), float(hl[f, cut])) if gain[f, cut] > 1e-9 else (G, H, 0.0, -1, 0, G, H)


_SPLITS = "block int, g double, h double, gain double, feature int, cut int, gl double, hl double, sums binary"
_KINDS = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary()]


def _codes(x: np.ndarray) -> list[bytes]:
    """Of each row, feature * BINS + bin of its features over 0."""
    row, f = np.nonzero(x)
    codes = (f * BINS + x[row, f]).astype(np.uint32)
    ends = np.cumsum(np.bincount(row, minlength=len(x)))
    return [codes[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class _Rows:
    """A batch (x, y, m): its entries by row, its bins as a table, its margins."""

    def __init__(self, b: pa.RecordBatch, features: int):
        held = b.column(0).to_pylist()
        self.codes = np.frombuffer(b"".join(held), np.uint32).astype(int)
        self.sizes = np.array([len(v) // 4 for v in held])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(held)), self.sizes)
        self.y = np.asarray(b.column(1))
        self.m = np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(len(held), -1)
        x = np.zeros((features, len(held)), np.uint8)
        x[self.codes // BINS, self.row] = self.codes % BINS
        self.x = x.T

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of some rows, and for each the row's place among them."""
        sizes = self.sizes[rows]
        at = np.repeat(np.arange(len(rows)), sizes)
        return self.codes[np.arange(len(at)) + (self.starts[rows] - np.cumsum(sizes) + sizes)[at]], at


def _level(rows: DataFrame, forest: Forest, trees: list[Tree], level: int, since: int, counted: np.ndarray, above: DataFrame | None) -> DataFrame:
    """The sums and best splits of the classes' nodes of a level.  ``counted``: by class and node whether rows
    are counted; ``above``: the parents' rows, at a root none."""
    features, classes = len(forest.edges), len(forest.base)
    wide, width = max(1, 2**level // 2), features * BINS
    forest = Forest([], forest.base, forest.depth, forest.rounds[since:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes, wide, 2, width)) if level else np.zeros((width, 2 * classes))
        totals = np.zeros((classes, wide, 2))
        some = False
        for b in batches:
            if not b.num_rows:
                continue
            some, held = True, _Rows(b, features)
            p = softmax(held.m + forest.margins(held.x))
            own = held.y[:, None] == np.arange(classes)
            g, h = (np.ascontiguousarray(np.rint(v / UNIT) * UNIT) for v in (p - own, np.maximum(2 * p * (1 - p), 1e-16)))
            if not level:
                totals[:, 0] += np.stack([g.sum(0), h.sum(0)], 1)
                both, order = np.concatenate([g, h], 1), np.argsort(held.codes.astype(np.uint16 if width < 65_536 else np.uint32), kind="stable")
                for lo in range(0, len(order), ENTRIES):
                    at = order[lo : lo + ENTRIES]
                    code = held.codes[at]
                    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                    sums[code[first]] += np.add.reduceat(both[held.row[at]], first, axis=0)
                continue
            for k, t in enumerate(trees):
                if counted[k].any():
                    node = t.nodes(held.x, level)
                    mine = np.flatnonzero(counted[k][node])
                    code, at = held.entries(mine)
                    slot = node[mine].astype(int) // 2
                    key = (slot * width)[at] + code
                    for i, v in enumerate((g[mine, k], h[mine, k])):
                        sums[k, :, i] += np.bincount(key, v[at], wide * width).reshape(wide, width)
                        totals[k, :, i] += np.bincount(slot, v, wide)
        if some:
            if not level:
                sums = sums.T.reshape(2, classes, 1, width).transpose(1, 2, 0, 3)
            for k in range(classes):
                for m in range(wide):
                    if not level or counted[k, 2 * m : 2 * m + 2].any():
                        yield part(k * wide + m, np.concatenate([totals[k, m], sums[k, m].ravel()]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[dict, dict] = ({}, {})
        for b in batches:
            for k, up, v in zip(*(c.to_pylist() for c in b.columns)):
                v = np.frombuffer(v)
                held[up][k] = held[up][k] + v if k in held[up] else v
        below, parents = held
        for block in sorted(below.keys() | parents.keys()):
            if not level:
                nodes = [(block, below[block])]
            else:
                k, m = divmod(block, wide)
                one = below.get(block, 0 * parents[block])
                first = 2 * block
                nodes = [(first, one), (first + 1, parents[block] - one)] if counted[k, 2 * m] else [(first, parents[block] - one), (first + 1, one)]
            for node, sums in nodes:
                values = [node, *best_split(sums, features), sums.tobytes() if level < forest.depth - 1 else None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS)], names=[c.split()[0] for c in _SPLITS.split(", ")])

    parts = rows.mapInArrow(run, "block int, sums binary").select("block", F.lit(False).alias("up"), "sums")
    if above is not None:
        parts = parts.union(above.filter("feature >= 0").select("block", F.lit(True), "sums"))
    n = max(1, min(classes * wide, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return parts.repartition(n, "block").mapInArrow(split, _SPLITS)


def fit(rows: DataFrame, classes: int, features: int, trees: int = 30, depth: int = 4, label: str = "label") -> Forest:
    """A forest of ``trees`` rounds from rows (idx, w, label from 0 on).  Labels of no class are left out; no rows are an error."""
    sound = rows.select("idx", "w", F.col(label).cast("int").alias("y")).filter(F.col("y").between(0, classes - 1))
    counts = {r.y: r.n for r in sound.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        raise DatasetError("no rows with a label to fit")
    cuts = [i / (BINS - 1) for i in range(1, BINS - 1)]
    values = sound.select(F.explode(F.arrays_zip("idx", "w")).alias("z")).select("z.idx", "z.w").filter(F.col("idx").between(0, features - 1))
    edges = [np.zeros(0)] * features
    for r in values.groupBy("idx").agg(F.percentile_approx("w", cuts, 10_000).alias("q")).collect():  # one for each feature
        edges[r.idx] = np.unique(r.q)
    share = np.array([counts.get(k, 0) + 1.0 for k in range(classes)])
    forest = Forest(edges, np.log(share / share.sum()), depth)
    start = forest.base.tobytes()

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = forest.bins(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(_codes(x), pa.binary()), b.column(2), pa.array([start] * len(x), pa.binary())], names=["x", "y", "m"])

    held, since = once(sound.mapInArrow(binned, "x binary, y int, m binary")), 0
    for r in range(trees):
        grown = [Tree.empty(depth) for _ in range(classes)]
        counted, above = np.ones((classes, 1), bool), None
        for level in range(depth):
            wide, live = 2**level, np.zeros((classes, 2 ** (level + 1)), bool)
            found = _level(held, forest, grown, level, since, counted, above)
            found = once(found) if level < depth - 1 else found
            for s in found.drop("sums").collect():
                k, m = divmod(s.block, wide)
                t, node = grown[k], wide - 1 + m
                t.feature[node], t.cut[node] = s.feature, s.cut
                live[k, 2 * m + (s.h - s.hl <= s.hl)] = s.feature >= 0
                below = 2 ** (depth - level - 1)  # leaves under a child
                for side, (g, h) in enumerate(((s.gl, s.hl), (s.g - s.gl, s.h - s.hl))):
                    lo = (2 * m + side) * below
                    t.leaf[lo : lo + below] = -RATE * g / (h + PULL) if s.feature >= 0 or not side else 0.0
            if above is not None:
                above.unpersist()
            counted, above = live, found
            if not live.any():
                break
        forest.rounds.append(grown)
        if (r + 1) % KEEP == 0 and r + 1 < trees:
            held, since = once(_with_margins(held, forest, since)), r + 1
    return forest


def _with_margins(rows: DataFrame, forest: Forest, since: int) -> DataFrame:
    features, forest = len(forest.edges), Forest([], forest.base, forest.depth, forest.rounds[since:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                of = _Rows(b, features)
                m = of.m + forest.margins(of.x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in m], pa.binary())], names=["x", "y", "m"])

    return rows.mapInArrow(run, "x binary, y int, m binary")


def log_loss(probabilities: Column, label: Column) -> Column:
    """The mean of -ln p of the right class, an aggregate."""
    return F.avg(-F.log(F.greatest(F.get(probabilities, label), F.lit(1e-15))))
