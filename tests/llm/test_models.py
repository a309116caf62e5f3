"""Quality, whitening and resampling: brute-force versions, held-out figures, odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from antiphon.llm import quality, queries, resampling, whitening

# --- quality -------------------------------------------------------------------------------------


def slow_buckets(text):
    """Sort and content of each token, straight from the definition."""
    out = []
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|\n+|([^\x00-\x20A-Za-z0-9\x7f-\xff])\1*", text.replace(b"\0", b" ")):
        t = m[0]
        ups, lows = len(re.findall(rb"[A-Z]", t)), len(re.findall(rb"[a-z]", t))
        if t[:1] == b"\n":
            kind = "break"
        elif t.isdigit():
            kind = "digits"
        elif m[1]:
            kind = "mark"
        elif not ups:
            kind = "lower"
        elif lows == 0 and (ups > 1 or len(t) == 1):
            kind = "upper"
        elif ups == 1 and t[:1].isupper():
            kind = "title"
        else:
            kind = "mixed"
        out.append((kind, t))
    return out


def sort_of(bucket):
    return next(k for k, n in quality._SORTS.items() if quality._AT[k] <= bucket < quality._AT[k] + n)


TEXTS = ["The end of THE end, isn't it?!! 12 34", "", " \n\n ", "x", "É über ÉCOLE iPhone\n\nA B", "a\0b | c | d", "word " * 500, "12,5 %%% &&& a.b"]


def test_tokens_by_sort_and_content():
    known = {}
    for t in TEXTS:
        want, got = slow_buckets(t.encode()), quality.buckets([t.encode()])
        assert got[-quality.WINDOW :].tolist() == [quality.BUCKETS] * quality.WINDOW
        assert len(want) == len(got) - quality.WINDOW
        for (kind, content), b in zip(want, got.tolist()):
            assert sort_of(b) == kind and known.setdefault(content, b) == b


def test_contexts_and_pooled_features_equal_loops(monkeypatch):
    texts = [t.encode() for t in TEXTS]
    index = quality.index_vectors().astype(np.int64)
    want, many = Counter(), Counter()
    for t in texts:
        b = quality.buckets([t])[: -quality.WINDOW].tolist()
        for i, x in enumerate(b):
            many[x] += 1
            want[x] = want[x] + sum((index[b[j]] for j in range(max(0, i - 2), min(len(b), i + 3)) if j != i), np.zeros(quality.DIMENSIONS, int))
    made = {}
    for part in (1 << 18, 24, 64):  # whatever the texts are cut into
        monkeypatch.setattr(quality, "PART", part)
        sums, counts = np.zeros((quality.BUCKETS, quality.DIMENSIONS), np.int64), np.zeros(quality.BUCKETS, np.int64)
        quality.add_contexts(sums, counts, texts)
        assert {k: int(v) for k, v in enumerate(counts) if v} == many
        assert all((sums[k] == v).all() for k, v in want.items())
        made[part] = quality.Vectors(sums, counts).pooled(texts)
        assert np.allclose(made[part], made[1 << 18], atol=1e-3)  # deviations are roots of small differences
    vectors = quality.Vectors(sums, counts)
    for t, row in zip(texts, made[1 << 18]):
        b = quality.buckets([t])[: -quality.WINDOW]
        v, w = vectors.vectors[b].astype(float), vectors.weights[b].astype(float)[:, None]
        mean = (v * w).sum(0) / max(w.sum(), 1e-9)
        spread = np.sqrt(np.maximum((v * v * w).sum(0) / max(w.sum(), 1e-9) - mean**2, 0))
        near = [sum(float(v[i] @ v[i + k]) for i in range(len(b) - k)) / max(1, len(b)) for k in (1, 2)]
        assert np.allclose(row, [*mean, *spread, *near, math.log1p(len(b))], atol=1e-3)


def test_network_gradients_and_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(600) < 0.1)).astype(float)  # no linear model can
    net = quality.fit(x, y, hidden=16, epochs=200, patience=40)
    p = net.probabilities(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.8
    z = rng.normal(size=4000) * 2
    t = quality.best_temperature((rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float), z * 3)
    assert 2.6 < t < 3.4


def test_quality_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op11_quality(spark, big).collect()}
    docs = spark.read.parquet(f"{big}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert got.keys() == {d.doc_id for d in docs}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(got[i].score, labels[i]) for i in labels if got[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.93


def test_quality_of_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = [(900_001, None), (900_002, ""), (900_003, " \n"), (None, "a b"), (None, "a b"), (900_004, "long text, " * 100_000), (900_005, "x" * 600_000), (900_006, "!?" * 200_000)]
    df = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 AS x", "2 AS h", "3 AS y", "4 AS block", "5 AS id")
    more = labels.union(spark.createDataFrame([(1, None, None), (None, 1, 0), (777_777, 0, 0)], labels.schema))
    model = quality.train(df, more)
    got = quality.with_quality(df, model).filter("doc_id is null or doc_id > 900000").collect()
    assert len(got) == len(odd) and all(0 <= r._quality <= 1 and (r.x, r.h, r.block) == (1, 2, 5 - 1) for r in got)
    assert len({r._quality for r in got if r.doc_id is None}) == 1
    assert len({r._quality for r in got if r.doc_id in (900_001, 900_002, 900_003)}) <= 2
    one = quality.train(docs, labels.filter("quality = 1"))
    assert {r._quality for r in quality.with_quality(docs, one).collect()} == {1.0}
    none = quality.train(docs.limit(0), labels)
    assert quality.with_quality(docs.limit(0), none).count() == 0
    assert {r._quality for r in quality.with_quality(docs.limit(3), none).collect()} == {0.0}


# --- whitening -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 16, 33])
def test_jacobi_against_known_spectra(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    e = np.sort(10.0 ** rng.uniform(-6, 3, n))[::-1]
    got, v = whitening.jacobi(q @ np.diag(e) @ q.T)
    assert np.allclose(got, e, rtol=1e-9, atol=1e-12) and np.allclose(v.T @ v, np.eye(n), atol=1e-12)
    assert np.allclose(v @ np.diag(got) @ v.T, q @ np.diag(e) @ q.T, atol=1e-9)


def test_jacobi_keeps_small_eigenvalues():
    d = np.diag([1e10, 1.0, 1e-10])
    a = d @ np.array([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]]) @ d
    got, _ = whitening.jacobi(a)
    assert abs(np.prod(got / 10.0 ** np.array([20, 0, -20])) / np.linalg.det([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]]) - 1) < 1e-9
    assert (whitening.jacobi(np.zeros((4, 4)))[0] == 0).all()


def check_whitening(rows, got):
    """``rows``: (id, vector) that take part."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    fits = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fits), fits.sum(0)
    centred = np.array([[float(n * a - s) for a, s in zip(r, sums)] for r in fits.tolist()]) / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(16, len(sums))
    own = Counter()
    for r in got:
        own[r.vec_id] += 1
    assert own == Counter({i: c * k for i, c in Counter(i for i, _ in rows).items()})
    table = {(r.vec_id, r.component): r for r in got}
    live = value > 1e-10 * value[0]
    signs = [None] * k
    for (i, _), a in zip(rows, x):
        y = np.array([float(n * b - s) for b, s in zip(a, sums)]) / n
        for c in range(k):
            r = table[i, c + 1]
            assert r.n == n and r.deviation == sum((n * b - s) ** 2 for b, s in zip(a, sums))
            assert abs(r.explained - max(value[c], 0) / value.sum()) <= 1e-6 * abs(value[c] / value.sum()) + 1e-12 if value.sum() > 0 else r.explained == 0
            assert r.identity_error < 1e-6
            if live[c]:
                want = float(y @ vector[:, c]) / value[c] ** 0.5
                if signs[c] is None and abs(want) > 1e-3:
                    signs[c] = 1 if want * r.whitened > 0 else -1
                assert abs(abs(want) - abs(r.whitened)) < 1e-6 and (signs[c] is None or abs(want - signs[c] * r.whitened) < 1e-6)
            else:
                assert r.whitened == 0


def test_whitening_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op12_whitening(spark, sf_dir).collect())


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    sound = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * [1, 2, 3, 0.5, 0, 1]]) for i in range(80)]
    sound[3] = (3, sound[4][1])
    sound += [(200 + i, sound[0][1]) for i in range(60)] + [(3, sound[4][1])]
    odd = [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [1.0, float("inf")] + [0.0] * 4), (504, [1e30] * 6), (505, []), (506, [1.0, 2.0]), (507, [1.0] * 5 + [None])]
    df = spark.createDataFrame(sound + odd, "vec_id long, embedding array<float>").repartition(3).selectExpr("*", "1 AS x", "2 AS id", "3 AS n", "4 AS component")
    got = whitening.whiten(df).collect()
    check_whitening([r for r in sound if r[0] != 3] + [(3, sound[4][1])] * 2, [*(r for r in got if r.vec_id != 3), *(r for r in got if r.vec_id == 3)])
    assert whitening.whiten(df.limit(0)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0]), (None, [2.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0.0, 0.0, 0.0) for r in same)


def test_exact_deviations_and_their_limit():
    big = whitening.Whitening(3, np.array([3 * (1 << 40), 5]), np.ones(2), np.eye(2), 2.0)
    x = np.array([[(1 << 40) + (1 << 29), 7]])
    assert big.deviation(x).tolist() == [(3 << 29) ** 2 + 16**2]
    with pytest.raises(OverflowError):
        big.deviation(np.array([[1 << 42, 0]]))


# --- resampling ----------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_resample(docs, target, percent=10, least=20, n=1, buckets=10_000):
    def buckets_of(text):
        w = WORD.findall((text or "").encode().lower())
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    seen = [(i, *buckets_of(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in seen for b in f), Counter(b for x in target for b in buckets_of(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, words, f in seen:
        weight = sum(gain(b) for b in f)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    pool = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(pool[: percent * len(pool) // 100], 1)}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def test_resampling_of_the_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert order(tuple(r) for r in queries.op13_resampling(spark, sf_dir).collect()) == order(slow_resample(docs, target))


@pytest.mark.parametrize("n", [1, 2])
def test_resampling_of_odd_tables(spark, n):
    rng = random.Random(n)
    line = lambda: " ".join(rng.choice("alpha Beta gamma, delta é 日本 x1 don't".split()) for _ in range(rng.randrange(0, 60)))
    docs = [(i, line()) for i in range(150)] + [(1000 + i, "hot text " * 15) for i in range(200)] + [(None, "hot text " * 15)] * 3 + [(7, "hot text " * 15)] * 2
    docs += [(2000, None), (2001, ""), (2002, "\x00 \n"), (2003, "word " * 300_000), (None, None)]
    target = [line() for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS id", "2 AS key", "3 AS row", "4 AS weight", "5 AS copies")
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, other, n=n, percent=50).collect()
    assert order(tuple(r) for r in got) == order(slow_resample(docs, target, 50, n=n))
    assert resampling.resample(df.limit(0), other).collect() == []
    alone = resampling.resample(df, other.limit(0), n=n).collect()
    assert order(tuple(r) for r in alone) == order(slow_resample(docs, [], n=n))
