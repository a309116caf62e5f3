"""Toxicity: a subsequence string kernel, Nyström landmarks and a support vector machine.

A string (a run of letters in windows of up to eight, the first with a mark at its start) has one feature
for every three symbols in order, weighted by DECAY to the power of the stretch they span, so gaps and
inserted characters cost a little and lose nothing.  Windows further on start at every other letter, so
that an insult glued to another word is met as well.  Landmarks are strings that set labelled toxic
documents apart and differ from one another, the best also without the mark.  A document's features are its best normalised kernel values with each landmark, over
all its words, and over words spelled out with spaces; the landmarks' own kernel matrix (its inverse
root) maps them to the Nyström space, where a linear SVM is trained with Platt scaling.

The fit takes at most ``PER_LABEL`` documents of each label, none over ``sampling.MAX_BYTES`` long
(documented bounds); every text is scored whole, a long one in parts whose best values count.  A null or empty text has no features: it gets the score of a text without any match.
Documents with several labels count as toxic if one says so; labels without a document are ignored.
Without both labels the score is the share of toxic rows (0 without rows).  Repeated rows get equal
scores; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches
from .sampling import capped, short, stratified

PER_LABEL = 2500
LANDMARKS = 96
#: Marked landmarks are less alike than ALIKE.  Those that set documents apart by WORTH of what the best does
#: and differ more than that stand without the mark, too.
ALIKE, WORTH, APART = 0.85, 0.4, 0.6
DECAY = 0.85
WINDOW, STEP = 8, 2
FLOOR = 0.4
#: Words that are remembered, and those whose values are computed at once.
SEEN, PART = 200_000, 4_000
#: Characters of text whose words are held at once.
CHUNK = 1 << 18
_SPELLED = re.compile(r"(?<!\S)\w(?:\s\w){3,}(?!\S)")
_RUNS = re.compile(r"[^\W\d_]+")
_WORD_END = re.compile(r"\w\w\s")
_TRIPLES = [(i, j, k, DECAY ** (k - i + 1)) for i, j, k in combinations(range(WINDOW + 1), 3)]
_START = 40
#: The norm by length, as if no three symbols stood twice; where they do, the bound is this much too low.
_NORMS = np.array([sum(w * w for *_, k, w in _TRIPLES if k < n) ** 0.5 for n in range(WINDOW + 2)], np.float32)
_REPEATS = np.float32(1.6)


def _symbols(strings: list[str]) -> np.ndarray:
    """A row of WINDOW + 1 symbols per string: the start mark '^', a-z, 13 classes of other letters; 0 pads."""
    raw = np.zeros((len(strings), WINDOW + 1), np.int64)
    flat = np.frombuffer("".join(s.ljust(WINDOW + 1, "\0") for s in strings).encode("utf-32-le"), np.uint32).reshape(len(strings), -1).astype(np.int64)
    raw[:] = np.where(flat == 0, 0, np.where(flat == 94, _START, np.where((flat >= 97) & (flat <= 122), flat - 96, 27 + flat % 13)))
    return raw


def windows(word: str) -> list[str]:
    """A run's strings: its start, marked, and windows further on of at least four letters."""
    return ["^" + word[:WINDOW], *(word[k : k + WINDOW] for k in range(STEP, len(word) - 3, STEP))]


class Kernel:
    """Normalised kernel values of strings with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        sym = _symbols(landmarks)
        feats: list[dict[int, float]] = []
        for row in sym.tolist():
            f: dict[int, float] = {}
            for i, j, k, w in _TRIPLES:
                if row[k]:
                    key = (row[i] * 41 + row[j]) * 41 + row[k]
                    f[key] = f.get(key, 0.0) + w
            n = sum(v * v for v in f.values()) ** 0.5 or 1.0
            feats.append({a: v / n for a, v in f.items()})
        keys = sorted({a for f in feats for a in f})
        self.where = np.zeros(41**3, np.int32)
        self.where[keys] = np.arange(1, len(keys) + 1)
        self.rows = np.zeros((len(keys) + 1, len(landmarks)), np.float32)
        for m, f in enumerate(feats):
            for a, v in f.items():
                self.rows[self.where[a], m] = v

    def near(self, strings: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
        """The strings (by number) that can have a value of ``least`` or more, and all of their values.

        A value is at most the share of a string's norm that lies in features of any landmark."""
        sym = _symbols(strings)
        size = (sym > 0).sum(1)
        order = np.argsort(-size, kind="stable")  # so that the strings with a symbol k come first
        sym, size = np.ascontiguousarray(sym[order].T.astype(np.int32)), size[order]
        many = [int((size > k).sum()) for k in range(len(sym))]
        norm = _NORMS[size]
        held, at = np.zeros(len(strings), np.float32), []
        pair, last = None, None
        for i, j, k, w in _TRIPLES:
            if last != (i, j):
                pair, last = (sym[i] * 41 + sym[j]) * 41, (i, j)
            own = self.where[pair[: many[k]] + sym[k, : many[k]]]
            at.append(own)
            held[: many[k]] += (own > 0) * np.float32(w * w)
        some = np.flatnonzero(np.sqrt(held) * _REPEATS >= least * norm)
        out = np.zeros((len(some), self.rows.shape[1]), np.float32)
        for own, (_, _, k, w) in zip(at, _TRIPLES):
            own = own[some[: np.searchsorted(some, many[k])]]
            hit = np.flatnonzero(own)
            out[hit] += np.float32(w) * self.rows[own[hit]]
        value = np.minimum(out / np.maximum(norm[some], 1e-6)[:, None], 1)
        back = np.argsort(order[some], kind="stable")
        return order[some][back], value[back]

    def __call__(self, strings: list[str]) -> np.ndarray:
        return self.near(strings, -1.0)[1]


def _pieces(word: str) -> list[str]:
    """A word's runs of letters, and all of its letters together if others stand between."""
    runs = _RUNS.findall(word)
    return [*runs, "".join(runs)] if len(runs) > 1 and len(word) <= 4 * WINDOW else runs


def parts(text: str) -> Iterator[str]:
    """Pieces of at most CHUNK characters, cut after a word of several letters if there is one near."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            near = max(at, end - 4096)
            last = max((m.end() for m in _WORD_END.finditer(text, near, end)), default=end)
            end = last
        yield text[at:end]
        at = end


class Features:
    """Documents' landmark features; remembers words, in two generations of at most SEEN."""

    def __init__(self, landmarks: list[str]):
        self.kernel, self.m = Kernel(landmarks), len(landmarks)
        self.cold: set[str] = set()
        self.warm: dict[str, np.ndarray] = {}

    def _learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), PART):
            part = words[lo : lo + PART]
            strings, owner = [], []
            for i, w in enumerate(part):
                for run in (w,) if w.isalpha() else _pieces(w):
                    if len(run) >= 3:
                        got = windows(run)
                        strings += got
                        owner += [i] * len(got)
            if not strings:
                continue
            some, value = self.kernel.near(strings, FLOOR)
            value = np.maximum(value - FLOOR, 0) / (1 - FLOOR)
            for r in np.flatnonzero(value.any(1)).tolist():
                w = part[owner[some[r]]]
                self.warm[w] = np.maximum(self.warm[w], value[r]) if w in self.warm else value[r].copy()  # a view would hold all rows

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.m), np.float32)
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for piece in parts(text or ""):
                if held and size + len(piece) > CHUNK:
                    self._add(held, out)
                    held, size = [], 0
                held.append((i, piece))
                size += len(piece)
        self._add(held, out)
        return out

    def _add(self, pieces: list[tuple[int, str]], out: np.ndarray) -> None:
        sets = []
        for _, t in pieces:
            t = t.lower()
            s = set(t.split())
            s.update("".join(m.split()) for m in _SPELLED.findall(t))
            sets.append(s)
        new = set().union(*sets) - self.cold if sets else set()
        new -= self.warm.keys()
        self._learn(list(new))
        for (i, _), s in zip(pieces, sets):
            for w in s & self.warm.keys():
                np.maximum(out[i], self.warm[w], out=out[i])
        self.cold |= new - self.warm.keys()
        if len(self.cold) > SEEN:
            self.cold = set()
        if len(self.warm) > SEEN // 8:
            self.warm = {}


class Model:
    def __init__(self, landmarks: list[str], root: np.ndarray, weight: np.ndarray, bias: float, platt: tuple[float, float], prior: float):
        self.landmarks, self.root, self.weight, self.bias, self.platt, self.prior = landmarks, root, weight, bias, platt, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.root @ self.weight + self.bias
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))


def pick_landmarks(texts: list[str], y: np.ndarray, limit: int = LANDMARKS) -> list[str]:
    """Words and word starts of four letters to eight whose document counts differ most by label, marked and, the best, unmarked."""
    counts = (Counter(), Counter())
    for t, label in zip(texts, y):
        own = set()
        for w in set(t.lower().split()):
            for run in (w,) if w.isalpha() else _pieces(w):
                own.update(run[:n] for n in (4, 5, 6, WINDOW) if n <= max(4, len(run)) and len(run) >= 4)
        counts[int(label)].update(own)
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    share = pos / (pos + neg)
    ranked = []
    for s, a in counts[1].items():
        expect = (a + counts[0][s]) * share
        if a >= 3 and a > expect:
            ranked.append(((a - expect) / (expect * (1 - share) + 1) ** 0.5, s))
    ranked.sort(key=lambda r: (-round(r[0], 6), -len(r[1]), r[1]))
    chosen: list[str] = []
    inner: list[str] = []
    for z, s in ranked[: 20 * limit]:
        if not chosen or Kernel(chosen)(["^" + s]).max() < ALIKE:
            chosen.append("^" + s)
        if z >= WORTH * ranked[0][0] and 4 * len(inner) < limit and (not inner or Kernel(inner)([s]).max() < APART):
            inner.append(s)
        if len(chosen) == limit:
            break
    return chosen + inner


def svm(z: np.ndarray, y: np.ndarray, c: float = 0.3) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton steps; each label weighs as its share of the rows."""
    x, t = np.hstack([z, np.ones((len(z), 1))]), 2.0 * y - 1
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-4
    for _ in range(30):
        on = t * (x @ w) < 1
        a, b = x[on], t[on]
        new = np.linalg.solve(ridge + 2 * c * a.T @ a, 2 * c * a.T @ b)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


def platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over SVM outputs (targets smoothed as Platt does)."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g = np.array([((p - t) * f).sum(), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * f * f).sum(), (s * f).sum()], [(s * f).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def fit(texts: list[str], y: np.ndarray) -> Model:
    """Fit from labelled texts in a fixed order; every fourth is kept aside for Platt scaling."""
    prior = float(y.mean()) if len(y) else 0.0
    aside = np.arange(len(y)) % 4 == 3
    marks = pick_landmarks([t for t, a in zip(texts, aside) if not a], y[~aside]) if len(y) else []
    if not marks or len(set(y[~aside])) < 2:
        return Model([], np.zeros((0, 0)), np.zeros(0), 0.0, (0.0, 0.0), prior)
    x = Features(marks)(texts).astype(float)
    value, vector = np.linalg.eigh(Kernel(marks)(marks).astype(float))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    w, b = svm(x[~aside] @ root, y[~aside])
    model = Model(marks, root, w, b, (1.0, 0.0), prior)
    held = aside if len(set(y[aside])) == 2 else ~aside
    model.platt = platt(x[held] @ root @ w + b, y[held])
    return model


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Fit on labelled rows whose id is outside the held-out fold."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    some = stratified(marks, "y", F.col("id").cast("string"), per_label, 2)
    # at most 2 * per_label ids: that bound allows the broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(short(F.col("text"))).join(F.broadcast(some), "id").select(F.xxhash64("id", "text").alias("h"), "text", "y")
    rows = sorted(capped(rows, "y", "h", per_label).collect(), key=lambda r: (r.h, r.y))
    return fit([r.text for r in rows], np.array([int(r.y == 1) for r in rows]))


_FEATURES: dict[tuple[str, ...], Features] = {}


def score(text: Column, model: Model) -> Column:
    """The score, 0 to 1, of a text column."""
    if not model.landmarks:
        return F.lit(model.prior)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = tuple(model.landmarks)
        if key not in _FEATURES:
            _FEATURES.clear()
            _FEATURES[key] = Features(model.landmarks)
        for b in batches:
            yield pd.Series(model.scores(_FEATURES[key](b.tolist())))

    return run(text.cast("string"))


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "_toxicity") -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.withColumn(as_col, score(F.col(text_col), model))
