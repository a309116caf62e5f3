"""Data-parallel training of the encoder network from a table of pairs.

Pairs are written once, dealt into steps by a hash of both inputs, a folder each, so that a step reads its
own rows alone.  In a step every task takes its pairs in batches of at most ``chunk`` rows, each normalised
by its own statistics, and adds up gradients and the batches' means and variances, weighted by rows.
Those sums, as large as the network, are added over tasks in two levels and only the result reaches the
driver, which takes one step of Adam.  Validation sums its squared errors in the same way.  No row leaves
the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..storage import added, once, part
from .encode import Adam, Network, pair_gradient


@dataclass(frozen=True)
class Settings:
    """``step``: pairs of all tasks together that one gradient is taken over; ``chunk``: of one normalisation."""

    epochs: int = 60
    rate: float = 0.01
    patience: int = 8
    dropout: float = 0.1
    step: int = 100_000
    chunk: int = 256
    seed: int = 0


@dataclass(frozen=True)
class Trained:
    network: Network
    losses: list[float]
    best_epoch: int


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (*(np.stack(b.column(i).to_pylist()).astype(float) for i in (0, 1)), np.asarray(b.column(2)).astype(float))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of ``size`` rows, the last one smaller; a single last row joins the batch before it."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
        while held.num_rows > size + 1:
            yield _arrays(held.slice(0, size).combine_chunks().to_batches()[0])
            held = held.slice(size)
    if held is not None:
        yield _arrays(held.combine_chunks().to_batches()[0])


def _summed(rows: DataFrame, run) -> np.ndarray | None:
    """The sum of the arrays that ``run`` makes of the tasks' batches, added over about the root of their number first."""
    groups = max(1, isqrt(max(1, rows.rdd.getNumPartitions())))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        if total is not None:
            yield part(TaskContext.get().partitionId() % groups, total)

    got = sorted((r.block, r.sums) for r in added(rows.mapInArrow(keyed, "block int, sums binary"), groups).collect())
    return sum((np.frombuffer(s) for _, s in got[1:]), np.frombuffer(got[0][1]).copy()) if got else None


def _flat(arrays: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _like(flat: np.ndarray, arrays: Sequence[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([a.size for a in arrays])[:-1]
    return [v.reshape(a.shape) for v, a in zip(np.split(flat, cuts), arrays)]


def step_sums(net: Network, rows: DataFrame, dropout: float, chunk: int, seed: Sequence[int]) -> tuple[list[np.ndarray], list[np.ndarray], int] | None:
    """(mean gradients, mean batch statistics, rows) of one step over ``rows`` (x1, x2, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        rng = np.random.default_rng([*seed, TaskContext.get().partitionId()])
        total = None
        for a, b, distance in _chunks(batches, chunk):
            own = net.copy()
            grads = own._gradients(np.concatenate([a, b]), pair_gradient(distance), dropout, rng, momentum=1.0)
            now = len(distance) * np.append(_flat([*grads, *own.means, *own.variances]), 1.0)
            total = now if total is None else total + now
        return total

    total = _summed(rows, run)
    if total is None:
        return None
    values = net._values()
    mean = total[:-1] / total[-1]
    cut = sum(v.size for v in values)
    return _like(mean[:cut], values), _like(mean[cut:], [*net.means, *net.variances]), int(total[-1])


def mean_loss(net: Network, rows: DataFrame) -> float:
    """The mean squared error of the codes' cosine distance over ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(2)
        for b in batches:
            if b.num_rows:
                a, c, distance = _arrays(b)
                total += np.array([net.loss(a, c, distance), 1.0]) * len(distance)
        return total if total[1] else None

    total = _summed(rows, run)
    return float(total[0] / total[1]) if total is not None else float("nan")


def train_encoder(training: DataFrame, validation: DataFrame, layers: Sequence[int], settings: Settings | None = None, momentum: float = 0.1) -> Trained:
    """Fit a network to pairs (x1, x2: arrays of numbers, distance) with early stopping; the best epoch's stays.

    Pairs without a distance or an input are left out; a side without pairs is an error."""
    settings = settings or Settings()
    sound = lambda df: df.select("x1", "x2", "distance").dropna()
    check = once(sound(validation))
    net = Network.fresh(layers, settings.seed)
    losses = [mean_loss(net, check)]
    if losses[0] != losses[0]:
        raise DatasetError("no pairs to validate with")
    rows = sound(training)
    n = rows.count()
    if not n:
        raise DatasetError("no pairs to train on")
    steps = ceil(n / settings.step)
    dealt = once(rows.withColumn("step", F.pmod(F.xxhash64("x1", "x2"), F.lit(steps)).cast("int")), by="step" if steps > 1 else None)
    adam = Adam(net, settings.rate)
    rng = np.random.default_rng(settings.seed)
    best, best_epoch, wait = net.copy(), 0, 0
    for epoch in range(1, settings.epochs + 1):
        for k in rng.permutation(steps).tolist():
            own = dealt.filter(F.col("step") == k) if steps > 1 else dealt
            got = step_sums(net, own.select("x1", "x2", "distance"), settings.dropout, settings.chunk, (settings.seed, epoch, k))
            if got is None:
                continue
            grads, statistics, _ = got
            for held, now in zip([*net.means, *net.variances], statistics):
                held += momentum * (now - held)
            adam.step(grads)
        losses.append(mean_loss(net, check))
        if losses[-1] < min(losses[:-1]) - 1e-7:
            best, best_epoch, wait = net.copy(), epoch, 0
        else:
            wait += 1
            if wait >= settings.patience:
                break
    return Trained(best, losses, best_epoch)
