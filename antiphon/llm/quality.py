"""Quality: random-indexing word vectors pooled per document, then a two-layer network.

A token is a run of letters, of digits, of one punctuation mark, or of line breaks.  It falls into one of
BUCKETS buckets by its content, those of lower-case, capitalised, upper-case and other words, of numbers
and of marks apart from one another, so that rare words that share a bucket are at least alike.  Every
bucket has a fixed ternary index vector, its own and its sort's.  A bucket's word vector is the sum of
the index vectors of the two tokens on either side over all occurrences in all documents (random
indexing), less the mean context, scaled to length 1.  A document's features are the weighted mean and
deviation of its tokens' vectors (rarer buckets weigh more), the mean product of vectors one and two
tokens apart (1 where words repeat), and the logarithm of the tokens' number.

A network with one hidden layer is trained in numpy from at most ``PER_LABEL`` labelled documents of each
label, none over ``sampling.MAX_BYTES`` long (documented bounds); every fifth of them is kept aside, for
the best epoch and for the temperature that calibrates the probabilities.  Word vectors count all
documents: every task adds up its own sums, blocks of them are summed after one shuffle, and the finished
table (BUCKETS x DIMENSIONS, whatever the input) goes through the driver.

Every text is counted and scored whole; long ones are cut into tokens in parts of PART bytes (between words,
where there is white space) and summed by stretches of PART tokens, which loses nothing.  Null and empty texts, and texts of white space, have zero
features and are scored like any other.  Documents with several labels count as good only if all say so;
labels without a document, and null labels, are ignored.  Without both labels the score is the share of
good rows (0 without rows).  Repeated rows get equal scores; an empty table gives no rows; other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_row, fold, small_batches, summed
from .sampling import capped, short, stratified

PER_LABEL = 4_000
DIMENSIONS, SPIKES, WINDOW = 64, 8, 2
HIDDEN = 32
#: Bytes of texts, and tokens, held at once; tokens that a task counts before it passes its sums on.
PART, FLUSH = 1 << 18, 1 << 27
#: Buckets of lower-case, capitalised, upper-case, other words, numbers, marks (32 lengths each of 128 characters), line breaks.
_SORTS = {"lower": 1 << 15, "title": 1 << 13, "upper": 1 << 13, "mixed": 1 << 12, "digits": 1 << 11, "mark": 1 << 12, "break": 64}
BUCKETS = sum(_SORTS.values())
_AT = dict(zip(_SORTS, (int(x) for x in np.cumsum([0, *_SORTS.values()]))))
#: Buckets of one row of partial sums.
BLOCK = 256
#: Weight of a bucket with a share p of all tokens: RARE / (RARE + p).
RARE = 1e-3

_SPACE, _LETTER, _DIGIT, _BREAK, _MARK, _EDGE = range(6)
_KIND = np.full(256, _LETTER, np.uint8)
_KIND[:128] = _MARK
_KIND[[9, 11, 12, 13, 32, 127, *range(1, 9), *range(14, 32)]] = _SPACE
_KIND[0], _KIND[10], _KIND[48:58] = _EDGE, _BREAK, _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.full(max(n, 1 << 18), np.uint64(b)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for a in _POWERS:
            a[0] = 1
            np.multiply.accumulate(a, out=a)
    return _POWERS


def index_vectors() -> np.ndarray:
    """(BUCKETS + 1) x DIMENSIONS of -2..2: a bucket's own spikes and its sort's; the last row, an edge's, is 0."""
    rng = np.random.default_rng(2024)

    def spikes(n: int) -> np.ndarray:
        out = np.zeros((n, DIMENSIONS), np.int8)
        at = rng.random((n, DIMENSIONS)).argsort(1)[:, :SPIKES]
        np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), (n, SPIKES)), 1)
        return out

    out = np.zeros((BUCKETS + 1, DIMENSIONS), np.int8)
    out[:-1] = spikes(BUCKETS)
    for sort, n in _SORTS.items():
        shared = np.repeat(spikes(128), 32, axis=0) if sort == "mark" else spikes(1)
        out[_AT[sort] : _AT[sort] + n] += shared
    return out


_INDEX: list[np.ndarray] = []


def _index() -> np.ndarray:
    if not _INDEX:
        _INDEX.append(index_vectors())
    return _INDEX[0]


def buckets(parts: list[bytes], ends: bool = True) -> np.ndarray:
    """Buckets of all tokens; where parts are whole texts (``ends``), each one's are followed by WINDOW edges."""
    raw = np.frombuffer(b"".join(t.replace(b"\0", b" ") + b"\0" * WINDOW * ends for t in parts), np.uint8)
    kind = _KIND[raw]
    begin = np.ones(len(raw), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == _MARK) & (raw[1:] != raw[:-1])) | (kind[1:] == _EDGE)
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(raw))
    kind = kind[start]
    some = kind != _SPACE
    start, end, kind = start[some], end[some], kind[some]
    power, inverse = _powers(len(raw) + 1)
    total, upper, lower = np.zeros(len(raw) + 1, np.uint64), np.zeros(len(raw) + 1, np.int64), np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_CODE[raw] * inverse[: len(raw)], out=total[1:])
    np.cumsum(_UPPER[raw], out=upper[1:])
    np.cumsum(_LOWER[raw], out=lower[1:])
    h = (total[end] - total[start]) * power[start]
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    size, ups, lows = end - start, upper[end] - upper[start], lower[end] - lower[start]
    at, many = np.zeros(len(start), np.int64), np.ones(len(start), np.int64)
    word = kind == _LETTER
    for sort, which in (
        ("lower", word & (ups == 0)),
        ("upper", word & (ups > 1) & (lows == 0) | word & (ups == 1) & (size == 1)),
        ("title", word & (ups == 1) & (size > 1) & (_UPPER[raw[start]] == 1)),
        ("digits", kind == _DIGIT),
    ):
        at[which], many[which] = _AT[sort], _SORTS[sort]
    other = word & (at == 0) & (ups > 0)
    at[other], many[other] = _AT["mixed"], _SORTS["mixed"]
    out = at + (h % many.astype(np.uint64)).astype(np.int64)
    mark, line = kind == _MARK, kind == _BREAK
    out[mark] = _AT["mark"] + raw[start[mark]].astype(np.int64) * 32 + np.minimum(size[mark], 31)
    out[line] = _AT["break"] + np.minimum(size[line], 63)
    out[kind == _EDGE] = BUCKETS
    return out


def split(text: bytes) -> Iterator[bytes]:
    """Parts of about PART bytes, cut before white space if there is any near."""
    at = 0
    while len(text) - at > PART:
        cut = text.rfind(b" ", at + PART // 2, at + PART)
        if cut < 0:
            cut = text.rfind(b"\n", at + PART // 2, at + PART)
            while cut > at and text[cut - 1] == 10:  # a run of line breaks is one token
                cut -= 1
        end = cut if cut > at else at + PART
        yield text[at:end]
        at = end
    yield text[at:]


def runs(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of texts, their buckets, where each begins): short texts together, a long one alone."""

    def short_ones(own: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        b = buckets([texts[i] for i in own])
        return own, b, np.append(0, np.flatnonzero(b == BUCKETS)[WINDOW - 1 :: WINDOW][:-1] + 1)

    held, n = [], 0
    for i, text in enumerate(texts):
        if len(text) > PART:
            yield [i], np.concatenate([*(buckets([p], False) for p in split(text)), np.full(WINDOW, BUCKETS)]), np.zeros(1, np.int64)
            continue
        if n + len(text) > PART:
            yield short_ones(held)
            held, n = [], 0
        held.append(i)
        n += len(text)
    if held:
        yield short_ones(held)


def add_contexts(sums: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> None:
    """Add the index vectors round each token to its bucket's row of ``sums``."""
    table = _index()
    edge = np.full(WINDOW, BUCKETS)
    for _, b, _ in runs(texts):
        padded = np.concatenate([edge, b, edge])
        order = np.argsort(b.astype(np.uint16), kind="stable")
        order = order[b[order] < BUCKETS]
        for lo in range(0, len(order), PART):
            part = order[lo : lo + PART]
            near = table[padded[part]]
            for k in range(1, 2 * WINDOW + 1):
                if k != WINDOW:
                    near += table[padded[part + k]]
            own = b[part]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums[own[first]] += np.add.reduceat(near, first, axis=0, dtype=np.int32)
            counts[own[first]] += np.diff(np.append(first, len(own)))


class Vectors:
    """Word vectors of length 1 and weights by bucket, from sums and counts over all documents."""

    def __init__(self, sums: np.ndarray, counts: np.ndarray):
        total = max(1, int(counts.sum()))
        seen = np.maximum(counts, 1)[:, None]
        v = sums / seen - sums.sum(0) / total
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        v[counts == 0] = 0
        self.vectors = np.concatenate([v, np.zeros((1, v.shape[1]))]).astype(np.float32)
        self.weights = np.append(RARE / (RARE + counts / total), 0).astype(np.float32)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Per text its tokens' weighted mean and deviation, mean products of near tokens, and the logarithm of their number."""
        d = self.vectors.shape[1]
        total, square, weight, many, agree = np.zeros((len(texts), d)), np.zeros((len(texts), d)), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros((len(texts), WINDOW))

        for own, every, begins in runs(texts):
            for lo in range(0, len(every), PART) if len(own) == 1 else (0,):
                b = every[lo : lo + PART + WINDOW] if len(own) == 1 else every
                n = min(PART, len(every) - lo) if len(own) == 1 else len(every)
                at, w, v = begins if lo == 0 else np.zeros(1, np.int64), self.weights[b[:n]], self.vectors[b]
                for k in range(1, WINDOW + 1):  # an edge's vector is 0
                    near = np.zeros(n, np.float32)
                    m = min(n, len(b) - k)
                    np.einsum("ij,ij->i", v[:m], v[k : k + m], out=near[:m])
                    agree[own, k - 1] += np.add.reduceat(near, at)
                v = v[:n]
                wv = v * w[:, None]
                total[own] += np.add.reduceat(wv, at, axis=0)
                wv *= v
                square[own] += np.add.reduceat(wv, at, axis=0)
                weight[own] += np.add.reduceat(w, at)
                many[own] += np.add.reduceat((b[:n] < BUCKETS).astype(np.int64), at)
        weight = np.maximum(weight, 1e-9)[:, None]
        mean = total / weight
        return np.concatenate([mean, np.sqrt(np.maximum(square / weight - mean * mean, 0)), agree / np.maximum(many, 1)[:, None], np.log1p(many)[:, None]], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """Standardised features, one hidden layer of rectified units, one output, a temperature."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, layers: list[np.ndarray], temperature: float = 1.0):
        self.mean, self.scale, self.layers, self.temperature = mean, scale, layers, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.maximum((np.clip((x - self.mean) / self.scale, -8, 8)) @ w + b, 0) @ v + c[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def log_loss(y: np.ndarray, z: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).mean())


def best_temperature(y: np.ndarray, z: np.ndarray) -> float:
    """The temperature that gives the least log loss, by golden section over its logarithm."""
    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    while hi - lo > 1e-4:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        if log_loss(y, z / np.exp(a)) <= log_loss(y, z / np.exp(b)):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 80, rate: float = 3e-3, decay: float = 1e-3, batch: int = 128, patience: int = 12) -> Network:
    """Adam on the log loss; every fifth row is kept aside, and the epoch that does best on those stays."""
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    check = aside if aside.any() else ~aside
    rng = np.random.default_rng(5)
    mean, scale = x[~aside].mean(0), np.maximum(x[~aside].std(0), 1e-6)
    n = x.shape[1]
    net = Network(mean, scale, [rng.normal(0, (2 / n) ** 0.5, (n, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array([np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))])])
    rows = np.flatnonzero(~aside)
    z = np.clip((x - mean) / scale, -8, 8)
    first, second = ([np.zeros_like(p) for p in net.layers] for _ in range(2))
    best, kept, wait, step = np.inf, None, 0, 0
    for _ in range(epochs):
        order = rng.permutation(rows)
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            w, b, v, c = net.layers
            a = z[own] @ w + b
            h = np.maximum(a, 0)
            d = (_sigmoid(h @ v + c[0]) - y[own]) / len(own)
            back = np.outer(d, v) * (a > 0)
            grads = [z[own].T @ back + decay * w, back.sum(0), h.T @ d + decay * v, np.array([d.sum()])]
            step += 1
            for p, g, m, q in zip(net.layers, grads, first, second):
                m += 0.1 * (g - m)
                q += 0.001 * (g * g - q)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
        now = log_loss(y[check], net.logits(x[check]))
        if now < best - 1e-5:
            best, kept, wait = now, [p.copy() for p in net.layers], 0
        else:
            wait += 1
            if wait >= patience:
                break
    net.layers = kept
    net.temperature = best_temperature(y[check], net.logits(x[check]))
    return net


def _encoded(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def word_vectors(docs: DataFrame, text_col: str = "text") -> Vectors:
    """Random indexing over all texts: partial sums by task, one shuffle of blocks of BLOCK buckets."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    blocks = -(-BUCKETS // BLOCK)
    size = blocks * BLOCK

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((size, DIMENSIONS), np.int32), np.zeros(size, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for k in np.flatnonzero(counts.reshape(blocks, BLOCK).any(1)).tolist():
                own = slice(k * BLOCK, (k + 1) * BLOCK)
                yield block_row(k, {"sums": sums[own], "counts": counts[own]})

        for b in batches:
            add_contexts(sums, counts, _encoded(b.column(0).to_pylist()))
            if counts.sum() > FLUSH:
                yield from rows()
                sums[:], counts[:] = 0, 0
        yield from rows()

    parts = docs.select(text).filter(F.octet_length(text) > 0).mapInArrow(partial, "block int, sums binary, counts binary")
    sums, counts = np.zeros((size, DIMENSIONS), np.int64), np.zeros(size, np.int64)
    for r in summed(parts, {"sums": (np.int32, np.int64), "counts": (np.int64, np.int64)}, blocks).collect():  # one row a block
        own = slice(r.block * BLOCK, (r.block + 1) * BLOCK)
        sums[own], counts[own] = np.frombuffer(r.sums, np.int64).reshape(BLOCK, -1), np.frombuffer(r.counts, np.int64)
    return Vectors(sums[:BUCKETS], counts[:BUCKETS])


class Model:
    """Word vectors, shared with the executors once, and the network (None: every text scores ``prior``)."""

    def __init__(self, vectors, network: Network | None, prior: float):
        self.vectors, self.network, self.prior = vectors, network, prior


def _features(text: Column, vectors) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(vectors.value.pooled(_encoded(b.tolist()))), dtype=object)

    return run(text.cast("string"))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Word vectors from all texts; the network from labelled rows whose id is outside the held-out fold."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text_col))
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    marks = known.groupBy(F.col(id_col).alias("id")).agg(F.min((F.col(label_col) == 1).cast("int")).alias("y"))
    some = stratified(marks, "y", F.col("id").cast("string"), per_label, 2)
    # at most 2 * per_label ids: that bound allows the broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(short(F.col("text"))).join(F.broadcast(some), "id").select(F.xxhash64("id", "text").alias("h"), "text", "y")
    rows = capped(rows, "y", "h", per_label).select("h", "y", _features(F.col("text"), vectors).alias("x"))
    rows = sorted(rows.collect(), key=lambda r: (r.h, r.y))
    y = np.array([r.y for r in rows], float)
    network = fit(np.array([r.x for r in rows]), y) if len(set(y)) == 2 else None
    return Model(vectors, network, float(y.mean()) if len(y) else 0.0)


def score(text: Column, model: Model) -> Column:
    """The probability, 0 to 1, that a text is good."""
    if model.network is None:
        return F.lit(model.prior)
    vectors, network = model.vectors, model.network

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(network.probabilities(vectors.value.pooled(_encoded(b.tolist()))))

    return run(text.cast("string"))


def with_quality(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "_quality") -> DataFrame:
    """``docs`` with the score as ``as_col`` (a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    return docs.withColumn(as_col, score(F.col(text_col), model))
