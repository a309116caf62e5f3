"""Encoder inputs and encoders: 48 numbers in, a fixed projection or a small network out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.vectors import one_hot, project
from ..schemas import FRAMES
from .framing import frame_index, probabilities

#: Added to variances before they divide.
EPSILON = 1e-5


def encoder_input(style: Column, frame: Column, frame_probabilities: Column) -> Column:
    """Style vector, one-hot frame, frame probabilities: 18 + 15 + 15 numbers."""
    return F.concat(style, one_hot(frame_index(frame), len(FRAMES)), probabilities(frame_probabilities))


def projection(x: Column, outputs: int | None = None, inputs: int = 48) -> Column:
    """The default encoder: a deterministic linear map to ``outputs`` (10) numbers."""
    outputs = 10 if outputs is None else outputs
    if outputs <= 0:
        raise ConfigurationError("the encoder's output must be positive")
    return project(x, outputs, inputs)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def pair_gradient(distance: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The gradient, by the codes of both sides one below the other, of the mean squared error of their cosine distance."""

    def of_codes(y: np.ndarray) -> np.ndarray:
        ya, yb = y[: len(distance)], y[len(distance) :]
        na, nb = (np.linalg.norm(v, axis=1, keepdims=True) for v in (ya, yb))
        cos = (ya * yb).sum(1, keepdims=True) / (na * nb)
        g = (-2 * (1 - cos[:, 0] - distance) / len(distance))[:, None]
        return np.concatenate([g * (yb / (na * nb) - cos * ya / na**2), g * (ya / (na * nb) - cos * yb / nb**2)])

    return of_codes


class Adam:
    """Steps of a network's own arrays."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.steps = net, rate, 0
        self.first, self.second = ([np.zeros_like(v) for v in net._values()] for _ in range(2))

    def step(self, grads: Sequence[np.ndarray]) -> None:
        self.steps += 1
        for v, g, m, q in zip(self.net._values(), grads, self.first, self.second):
            m += 0.1 * (g - m)
            q += 0.001 * (g * g - q)
            v -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(q / (1 - 0.999**self.steps)) + 1e-8)


@dataclass
class Network:
    """[linear, batch norm, SiLU, dropout]* then linear and sigmoid; weights are plain arrays (a few kilobytes)."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    scales: list[np.ndarray]
    shifts: list[np.ndarray]
    means: list[np.ndarray]
    variances: list[np.ndarray]

    @classmethod
    def fresh(cls, layers: Sequence[int], seed: int = 0) -> Network:
        if len(layers) < 2 or min(layers) <= 0:
            raise ConfigurationError("a network needs two or more positive layers")
        rng = np.random.default_rng(seed)
        w = [rng.normal(0, (2 / a) ** 0.5, (a, b)) for a, b in zip(layers, layers[1:])]
        inner = layers[1:-1]
        return cls(w, [np.zeros(b) for b in layers[1:]], [np.ones(b) for b in inner], [np.zeros(b) for b in inner], [np.zeros(b) for b in inner], [np.ones(b) for b in inner])

    def forward(self, x: np.ndarray) -> np.ndarray:
        """The codes, with the statistics that training has gathered."""
        for i in range(len(self.scales)):
            u = (x @ self.weights[i] + self.biases[i] - self.means[i]) / np.sqrt(self.variances[i] + EPSILON) * self.scales[i] + self.shifts[i]
            x = u * _sigmoid(u)
        return _sigmoid(x @ self.weights[-1] + self.biases[-1])

    def _values(self) -> list[np.ndarray]:
        return [*self.weights, *self.biases, *self.scales, *self.shifts]

    def _gradients(self, x: np.ndarray, of_codes: Callable[[np.ndarray], np.ndarray], dropout: float, rng: np.random.Generator, momentum: float = 0.1) -> list[np.ndarray]:
        """Gradients in the order of ``_values``: batch statistics and dropout on the way there, the loss's
        gradient by the codes from ``of_codes``, then back through every layer."""
        held = []
        for i in range(len(self.scales)):
            z = x @ self.weights[i] + self.biases[i]
            mean, var = z.mean(0), z.var(0)
            self.means[i] += momentum * (mean - self.means[i])
            self.variances[i] += momentum * (var - self.variances[i])
            zn = (z - mean) / np.sqrt(var + EPSILON)
            u = zn * self.scales[i] + self.shifts[i]
            keep = (rng.random(u.shape) >= dropout) / (1 - dropout)
            held.append((x, zn, var, u, keep))
            x = u * _sigmoid(u) * keep
        y = _sigmoid(x @ self.weights[-1] + self.biases[-1])
        d = of_codes(y) * y * (1 - y)
        dw, db, ds, dh = [x.T @ d], [d.sum(0)], [], []
        d = d @ self.weights[-1].T
        for i in range(len(self.scales) - 1, -1, -1):
            x, zn, var, u, keep = held[i]
            s = _sigmoid(u)
            du = d * keep * (s + u * s * (1 - s))
            ds.insert(0, (du * zn).sum(0))
            dh.insert(0, du.sum(0))
            dn = du * self.scales[i]
            dz = (dn - dn.mean(0) - zn * (dn * zn).mean(0)) / np.sqrt(var + EPSILON)
            dw.insert(0, x.T @ dz)
            db.insert(0, dz.sum(0))
            d = dz @ self.weights[i].T
        return [*dw, *db, *ds, *dh]

    def train(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray, epochs: int = 60, rate: float = 0.01, patience: int = 8, seed: int = 0, dropout: float = 0.1, batch: int = 256) -> list[float]:
        """Siamese fit of all layers by Adam: squared error of the codes' cosine distance; every fifth pair
        validates, the best network stays.  The losses are the validation's, before and after each epoch."""
        rng = np.random.default_rng(seed)
        held = np.arange(len(a)) % 5 == 4
        check, fit = np.flatnonzero(held if held.any() else ~held), np.flatnonzero(~held)
        adam = Adam(self, rate)
        losses, best, wait = [self.loss(a[check], b[check], distance[check])], self.copy(), 0
        for _ in range(epochs):
            order = rng.permutation(fit)
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                if len(rows) > 1:
                    adam.step(self._gradients(np.concatenate([a[rows], b[rows]]), pair_gradient(distance[rows]), dropout, rng))
            losses.append(self.loss(a[check], b[check], distance[check]))
            if losses[-1] < min(losses[:-1]) - 1e-7:
                best, wait = self.copy(), 0
            else:
                wait += 1
                if wait >= patience:
                    break
        self.__dict__.update(best.__dict__)
        return losses

    def loss(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> float:
        ya, yb = self.forward(a), self.forward(b)
        cos = (ya * yb).sum(1) / (np.linalg.norm(ya, axis=1) * np.linalg.norm(yb, axis=1))
        return float(((1 - cos - distance) ** 2).mean())

    def copy(self) -> Network:
        return Network(*[[v.copy() for v in getattr(self, f.name)] for f in fields(self)])

    def save(self, path: str) -> None:
        """Write all layers to one file (.npz)."""
        with open(path, "wb") as f:
            np.savez(f, **{f"{x.name}{i}": v for x in fields(self) for i, v in enumerate(getattr(self, x.name))})

    @classmethod
    def load(cls, path: str) -> Network:
        with np.load(path) as held:
            return cls(*[[held[f"{x.name}{i}"] for i in range(sum(k.rstrip("0123456789") == x.name for k in held))] for x in fields(cls)])


def network(x: Column, net: Network) -> Column:
    """The network over Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(net.forward(np.stack(b.to_numpy()).astype(float)))) if len(b) else pd.Series([], dtype=object)

    return run(x)
