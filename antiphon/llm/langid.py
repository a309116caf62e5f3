"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits.  For every bit a binary classifier over letter n-grams (a
naive Bayes log odds, calibrated on rows kept aside) says which side a text is on; the language whose
codeword has the least weighted loss wins.  A text whose two best codewords lose almost equally is
flagged as ambiguous.  Up to seven languages the code is exhaustive; beyond, it has
10 * log2(languages) pseudo-random columns.

The model is fitted from at most ``PER_LABEL`` texts of each language, none over ``sampling.MAX_BYTES`` long
(documented bounds); every
text is then scored whole, in parts of CHUNK characters whose sums add up (cut between letters' runs, so
that no n-gram is lost, where a run is not longer than that).  A null text, or one without a letter, is
``und`` with score 0 and not ambiguous.  The sample's n-grams are counted text by text on the driver.  Without labelled rows every text is ``und``.  Ties go to the language first in order.
Repeated rows get equal answers; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches
from .sampling import short, stratified

PER_LABEL = 700
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
CHUNK = 1 << 17
#: Least difference of the two best languages' shares; below it a text is ambiguous.
AMBIGUOUS = 0.02
UNDETERMINED = "und"

_TABLES: dict[int, np.ndarray] = {}


def _letters(top: int) -> np.ndarray:
    """Code point below ``top`` -> its lower case, 0 where it is no letter."""
    if top not in _TABLES:
        out = np.zeros(top, np.uint32)
        for c in range(top):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _TABLES[top] = out
    return _TABLES[top]


def parts(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces of about ``size`` characters, cut where a run of letters ends if that is near."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        back = end
        while back > at + size - 4096 and back > at and end < len(text) and text[back - 1].isalpha():
            back -= 1
        end = back if back > max(at, at + size - 4096) else end
        yield text[at:end]
        at = end


def grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets of the texts in one array of letters (0 between words), and per order the n-grams' buckets
    by start; n-grams over a gap between words get bucket 0, whose weight is 0."""
    raw = np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 2 for t in texts])
    c = _letters(1 << 16 if not len(raw) or raw.max() < 1 << 16 else 0x110000)[raw]
    at = np.cumsum(size) - size
    edge = np.zeros(len(c), bool)
    edge[at] = True
    keep = (c > 0) | edge
    keep[1:] |= c[:-1] > 0  # one 0 after each word
    new = np.cumsum(keep) - 1
    c, at = c[keep], new[at]
    out = []
    for n in ORDERS:
        m = len(c) - n + 1
        h = np.full(len(c), n, np.uint32)
        if m > 0:
            g = h[:m]
            for k in range(n):
                g = (g ^ c[k : k + m]) * np.uint32(0x9E3779B1)
                g ^= g >> np.uint32(15)
            g = g % np.uint32(BUCKETS - 1) + 1
            inner = np.ones(m, bool)
            for k in range(1, n - 1):
                inner &= c[k : k + m] > 0
            if n == 1:
                inner = c > 0
            elif n == 2:
                inner = (c[:-1] > 0) | (c[1:] > 0)
            h[:m] = np.where(inner, g, 0)
            h[m:] = 0
        else:
            h[:] = 0
        out.append(h)
    return at, out


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1; no two rows, and no two columns up to sign, are equal."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        cols = [[1] + [1 if b >> k & 1 else -1 for k in range(n - 1)] for b in range(2 ** (n - 1) - 1)]
        return np.array(cols, float).T
    rng = np.random.default_rng(12345)
    while True:
        code = rng.choice([-1.0, 1.0], (n, math.ceil(10 * math.log2(n))))
        if len(np.unique(code, axis=0)) == n and (abs(code.sum(0)) < n).all():
            return code


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weights: list[np.ndarray], scale: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.scale, self.trust = langs, code, weights, scale, trust

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds of each bit per text (0 without an n-gram)."""
        bits = self.code.shape[1]
        total, many = np.zeros((len(ORDERS), len(texts), bits)), np.zeros((len(ORDERS), len(texts)))

        def add(owner: list[int], pieces: list[str]) -> None:
            at, hs = grams(pieces)
            for k, (w, h) in enumerate(zip(self.weights, hs)):
                np.add.at(total[k], owner, np.add.reduceat(w[h], at, axis=0, dtype=np.float64)[:, :bits])
                np.add.at(many[k], owner, np.add.reduceat(h > 0, at, dtype=np.int64))

        owner, pieces, n = [], [], 0
        for i, text in enumerate(texts):
            for piece in parts(text) if len(text) > CHUNK else (text,):
                if pieces and n + len(piece) > CHUNK:
                    add(owner, pieces)
                    owner, pieces, n = [], [], 0
                owner.append(i)
                pieces.append(piece)
                n += len(piece)
        if pieces:
            add(owner, pieces)
        return (total / np.maximum(1, many)[:, :, None]).mean(0)

    def shares(self, texts: list[str]) -> np.ndarray:
        """Loss-weighted decoding: exponential loss of each bit against each codeword, as shares."""
        z = np.clip(self.margins(texts) * self.scale, -8, 8)
        loss = (np.log1p(np.exp(-z[:, None, :] * self.code[None])) * self.trust).sum(2)
        e = np.exp(loss.min(1, keepdims=True) - loss)
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        lang, score, flag = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        if some:
            p = self.shares([texts[i] for i in some])
            best = p.argmax(1)
            top = np.sort(p, axis=1)
            near = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0) < AMBIGUOUS
            for i, b, s, a in zip(some, best.tolist(), p.max(1).tolist(), near.tolist()):
                lang[i], score[i], flag[i] = self.langs[b], s, a
        return pd.DataFrame({"lang": lang, "score": score, "ambiguous": flag})


def fit(texts: list[str], langs: list[str]) -> Model:
    """Fit from labelled texts; every fourth text of a language is kept aside for calibration."""
    names = sorted(set(langs))
    code = codewords(len(names))
    y = np.array([names.index(x) for x in langs], int)
    rank = np.zeros(len(y), int)
    for k in range(len(names)):
        own = np.flatnonzero(y == k)
        rank[own] = np.arange(len(own))
    aside = rank % 4 == 3
    counts = [np.zeros((len(names), BUCKETS)) for _ in ORDERS]
    for i in np.flatnonzero(~aside):
        own = [np.zeros(BUCKETS) for _ in ORDERS]
        for piece in parts(texts[i]):
            for c, h in zip(own, grams([piece])[1]):
                c += np.bincount(h, minlength=BUCKETS)
        for c, o in zip(counts, own):
            c[y[i]] += o / max(1.0, o.sum())  # each text counts alike
    weights = []
    for c in counts:
        c[:, 0] = 0
        c *= 1e5 / np.maximum(c.sum(1, keepdims=True), 1e-9)
        w = np.zeros((BUCKETS, max(8, code.shape[1])), np.float32)
        for b in range(code.shape[1]):
            p, q = (c[code[:, b] == s].mean(0) if (code[:, b] == s).any() else np.zeros(BUCKETS) for s in (1, -1))
            w[:, b] = np.clip(np.log((p + 0.5) / (q + 0.5)), -4, 4)
        w[0] = 0
        weights.append(w)
    model = Model(names, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]) / code.shape[1])
    z = model.margins([texts[i] for i in np.flatnonzero(aside)]) if aside.any() else np.zeros((0, code.shape[1]))
    if len(z):
        side = code[y[aside]]
        spread = np.abs(z).mean(0)
        right = ((z * side) > 0).mean(0)
        model.scale = 4 / np.maximum(spread, 1e-6)
        model.trust = np.maximum(right - 0.5, 0.01) * 2
        model.trust = model.trust / model.trust.sum() * min(4.0, code.shape[1])
    return model


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_label: int = PER_LABEL) -> Model:
    """Fit on rows with a language and an id outside the held-out fold."""
    text = F.col(text_col).cast("string")
    learnable = F.col(lang_col).isNotNull() & (F.coalesce(fold(id_col), F.lit(1)) != 0) & short(text)
    rows = docs.filter(learnable).select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), text).alias("h"))
    got = sorted(stratified(rows, "lang", F.col("h"), per_label).collect(), key=lambda r: (r.h, r.lang))
    return fit([r.text for r in got], [r.lang for r in got])


def identify(text: Column, model: Model) -> Column:
    """(lang, score, ambiguous) of a text column."""

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model.predict(b.tolist())

    return run(text.cast("string"))


def with_language(docs: DataFrame, model: Model | None = None, text_col: str = "text", id_col: str = "doc_id", as_col: str = "_language") -> DataFrame:
    small_batches(docs.sparkSession)
    model = train(docs, text_col=text_col, id_col=id_col) if model is None else model
    return docs.withColumn(as_col, identify(F.col(text_col), model))
