"""Search over settings: a tree-structured Parzen estimator, folds by hash, trials in parallel, early pruning.

The first ``startup`` trials are drawn at random.  Each later one compares the settings of the best quarter
of the finished trials with those of the rest: every setting gets a density of either side (a mixture of
normals round the tried values for numbers, smoothed shares for choices), candidates are drawn from the
better side's, and the one with the highest ratio is tried.  Trials run in rounds of ``parallel`` threads,
whose Spark jobs share the cluster; a round knows the rounds before it alone, so that a seed gives the same
trials however long each takes.  A trial that reports less after a fold than the median of the finished
trials did after it is given up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..storage import once

BEST, CANDIDATES, STARTUP = 0.25, 24, 10


@dataclass(frozen=True)
class Number:
    """A number from ``lo`` to ``hi``; ``log``: by its logarithm; ``whole``: rounded."""

    lo: float
    hi: float
    log: bool = False
    whole: bool = False

    def inner(self, value: float) -> float:
        lo, hi, v = (math.log(x) if self.log else x for x in (self.lo, self.hi, value))
        return (v - lo) / (hi - lo) if hi > lo else 0.0

    def outer(self, u: float) -> float | int:
        lo, hi = (math.log(x) if self.log else x for x in (self.lo, self.hi))
        v = lo + min(max(u, 0.0), 1.0) * (hi - lo)
        v = math.exp(v) if self.log else v
        return int(min(max(round(v), self.lo), self.hi)) if self.whole else min(max(v, self.lo), self.hi)

    def draw(self, rng: np.random.Generator):
        return self.outer(rng.random())

    def pick(self, rng: np.random.Generator, good: list, bad: list):
        """A candidate from the good values' density, and the logarithm of the densities' ratio at it."""
        g, b = (np.sort([self.inner(v) for v in of]) for of in (good, bad))
        at = np.append(g, 0.5)  # the last one is the prior, over the whole range
        width = np.append(_widths(g), 1.0)
        k = rng.integers(len(at))
        u = rng.normal(at[k], width[k])
        u = min(max(u, 0.0), 1.0)
        return self.outer(u), _density(u, at, width) - _density(u, np.append(b, 0.5), np.append(_widths(b), 1.0))


def _widths(x: np.ndarray) -> np.ndarray:
    """The larger distance of each value to its neighbours or the range's ends, not too small."""
    edge = np.concatenate([[0.0], x, [1.0]])
    gap = np.diff(edge)
    return np.clip(np.maximum(gap[:-1], gap[1:]), 1 / (1 + len(x)) / 2, 1.0) if len(x) else np.zeros(0)


def _density(u: float, at: np.ndarray, width: np.ndarray) -> float:
    z = (u - at) / width
    inside = np.array([0.5 * (math.erf((1 - a) / w / 2**0.5) + math.erf(a / w / 2**0.5)) for a, w in zip(at, width)])
    return float(np.log(np.mean(np.exp(-0.5 * z * z) / (width * inside)) + 1e-300))


@dataclass(frozen=True)
class Choice:
    options: tuple

    def draw(self, rng: np.random.Generator):
        return self.options[rng.integers(len(self.options))]

    def pick(self, rng: np.random.Generator, good: list, bad: list):
        g, b = (np.array([1.0 + sum(v == o for v in of) for o in self.options]) for of in (good, bad))
        g, b = g / g.sum(), b / b.sum()
        k = rng.choice(len(g), p=g)
        return self.options[k], float(np.log(g[k] / b[k]))


Space = Mapping[str, Number | Choice]


class Pruned(Exception):
    """A trial is given up."""


@dataclass
class Trial:
    number: int
    settings: dict
    reports: list[float] = field(default_factory=list)
    score: float = -math.inf
    pruned: bool = False
    least: tuple[float, ...] = ()

    def report(self, value: float) -> None:
        """The score after one more fold; raises ``Pruned`` if it is not worth going on."""
        self.reports.append(value)
        k = len(self.reports) - 1
        if k < len(self.least) and value < self.least[k]:
            raise Pruned


@dataclass
class Study:
    trials: list[Trial]

    @property
    def best(self) -> Trial:
        """The highest score, the earliest of equal ones."""
        return max(self.trials, key=lambda t: (t.score, -t.number))


def suggest(space: Space, finished: list[Trial], rng: np.random.Generator, startup: int = STARTUP) -> dict:
    if len(finished) < startup:
        return {name: of.draw(rng) for name, of in space.items()}
    ranked = sorted(finished, key=lambda t: (-t.score, t.number))
    cut = max(1, math.ceil(BEST * math.sqrt(len(ranked)) * 2))
    good, bad = ranked[:cut], ranked[cut:]
    out = {}
    for name, of in space.items():
        drawn = [of.pick(rng, [t.settings[name] for t in good], [t.settings[name] for t in bad]) for _ in range(CANDIDATES)]
        out[name] = max(drawn, key=lambda d: d[1])[0]
    return out


def search(space: Space, objective: Callable[[Trial], float], trials: int = 50, parallel: int = 4, seed: int = 42, startup: int = STARTUP) -> Study:
    """Maximise ``objective(trial)``, which may ``trial.report`` on the way; a score that is no number counts least."""
    if not space or trials <= 0 or parallel <= 0:
        raise ConfigurationError("a search needs settings, trials and threads")
    rng = np.random.default_rng(seed)
    done: list[Trial] = []

    def run(t: Trial) -> Trial:
        try:
            score = float(objective(t))
            t.score = score if score == score else -math.inf
        except Pruned:
            t.pruned, t.score = True, t.reports[-1]
        return t

    with ThreadPoolExecutor(parallel) as pool:
        while len(done) < trials:
            whole = [t for t in done if not t.pruned]
            most = max((len(t.reports) for t in whole), default=0)
            least = tuple(float(np.median([t.reports[k] for t in whole if len(t.reports) > k])) for k in range(most)) if len(done) >= startup else ()
            batch = [Trial(len(done) + i, suggest(space, done, rng, startup), least=least) for i in range(min(parallel, trials - len(done)))]
            done += list(pool.map(run, batch))
    return Study(done)


#: The boosted classifiers' settings, by the names of ``pyspark.ml``'s parameters.
BOOSTED: Space = {"maxIter": Number(20, 200, whole=True), "maxDepth": Number(2, 8, whole=True), "stepSize": Number(0.01, 0.3, log=True), "subsamplingRate": Number(0.5, 1.0), "minInstancesPerNode": Number(1, 20, whole=True)}


def tuned(pipeline: Pipeline, data: DataFrame, label: str, key: str, space: Space | None = None, trials: int = 50, folds: int = 5, parallel: int = 4, seed: int = 42, metric: str = "f1") -> tuple[Study, object]:
    """(study, the best settings' model on all rows) of the last stage's parameters, by the mean over folds.

    A row's fold is a hash of its key, whatever else is in the table."""
    rows = once(data.withColumn("_fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")))
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    last = pipeline.getStages()[-1]

    def built(settings: dict) -> Pipeline:
        return Pipeline(stages=[*pipeline.getStages()[:-1], last.copy({last.getParam(k): v for k, v in settings.items()})])

    def objective(t: Trial) -> float:
        scores = []
        for k in range(folds):
            fit, check = rows.filter(F.col("_fold") != k), rows.filter(F.col("_fold") == k)
            if check.isEmpty() or fit.isEmpty():
                continue
            scores.append(judge.evaluate(built(t.settings).fit(fit).transform(check)))
            t.report(float(np.mean(scores)))
        return float(np.mean(scores)) if scores else math.nan

    study = search(space or BOOSTED, objective, trials, parallel, seed)
    return study, built(study.best.settings).fit(rows)
