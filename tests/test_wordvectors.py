import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from antiphon.functions import style
from antiphon.operators import keywords, sentiment, wordvectors

TEXTS = [
    "the cat sat on the mat while the dog slept",
    "the dog chased the cat over the mat",
    "stock prices rose while bond prices fell",
    "bond markets and stock markets fell on the news",
    "the the the cat",
    "Zz 99 é",
    "",
    None,
    "the the the cat",
]


def brute(texts, limit, window):
    """(words, counts, positive PMI) by loops."""
    lists = [[t for t in re.split(r"\W+", (x or "").lower()) if re.fullmatch("[a-z]{2,}", t)] for x in texts]
    count = {}
    for l in lists:
        for t in l:
            count[t] = count.get(t, 0) + 1
    words = sorted(count, key=lambda w: (-count[w], w))[:limit]
    at = {w: i for i, w in enumerate(words)}
    c = np.zeros((len(words), len(words)))
    for l in lists:
        for i, x in enumerate(l):
            for j in range(max(0, i - window), min(len(l), i + window + 1)):
                if i != j and x in at and l[j] in at:
                    c[at[x], at[l[j]]] += 1
    p = np.zeros_like(c)
    for i, j in zip(*np.nonzero(c)):
        p[i, j] = max(0.0, math.log(c[i, j] * c.sum() / (c[i].sum() * c[j].sum())))
    return words, c, p


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.mark.parametrize("limit", [6, 100])
def test_counts_and_positive_pmi(spark, docs, limit):
    words, c, p = brute(TEXTS, limit, 3)
    assert [r.word for r in wordvectors.vocabulary(docs, limit=limit).orderBy("idx").collect()] == words
    counts = wordvectors.cooccurrences(docs.repartition(3), words, window=3)
    got = {(r.a, r.b): r.n for r in counts.collect()}
    assert got == {(i, j): int(c[i, j]) for i, j in zip(*np.nonzero(c))}
    pmi = {(r.a, r.b): r.ppmi for r in wordvectors.positive_pmi(counts).collect()}
    assert pmi == pytest.approx({(i, j): p[i, j] for i, j in zip(*np.nonzero(p))})


def test_long_texts_are_counted_in_slices(spark, monkeypatch):
    text = " ".join(np.random.default_rng(1).choice(["aa", "bb", "cc", "dd"], 999))
    words, c, _ = brute([text], 9, 5)
    monkeypatch.setattr(wordvectors, "SLICE", 100)
    run = wordvectors.cooccurrences(spark.createDataFrame([(text,)], "text string"), words)
    assert {(r.a, r.b): r.n for r in run.collect()} == {(i, j): int(c[i, j]) for i, j in zip(*np.nonzero(c))}


def test_vectors_are_the_decomposition_and_follow_no_partition(spark, docs):
    words, _, p = brute(TEXTS, 100, 5)
    one, other = (wordvectors.fit(docs.repartition(n), dimensions=5) for n in (1, 7))
    assert one.words == other.words == words
    assert np.array_equal(one.matrix, other.matrix)
    s = np.linalg.svd(p)[1][:5]
    assert np.linalg.norm(one.matrix, axis=0) ** 2 == pytest.approx(s, rel=1e-6)
    u = one.matrix / np.sqrt(s)
    assert np.abs(p @ p @ u - u * s**2).max() < 1e-4 * s[0] ** 2


def test_texts_get_the_mean_of_their_words(spark, docs):
    model = wordvectors.fit(docs, dimensions=4)
    at = {w: v for w, v in zip(model.words, model.matrix)}
    for r in docs.select("text", model.embed(F.col("text")).alias("v")).collect():
        own = [at[t] for t in re.split(r"\W+", (r.text or "").lower()) if t in at]
        assert r.v == pytest.approx(np.mean(own, axis=0).tolist() if own else [0.0] * 4, abs=1e-12)


def test_kept_models_are_the_same(spark, docs, tmp_path):
    model = wordvectors.fit(docs, dimensions=4)
    model.save(spark, str(tmp_path / "m"))
    again = wordvectors.WordVectors.load(spark, str(tmp_path / "m"))
    assert again.words == model.words and np.array_equal(again.matrix, model.matrix)


def test_empty_tables(spark, docs):
    model = wordvectors.fit(docs.limit(0))
    assert model.words == [] and model.dimensions == 0
    assert docs.select(model.embed(F.col("text")).alias("v")).first().v == []


def test_nearest_phrases(spark, docs):
    model = wordvectors.fit(docs, dimensions=4)
    top = keywords.by_embedding(docs.filter("doc_id = 2"), model.embed, wordvectors.nearness, k=3, max_n=1).orderBy("rank").collect()
    whole = docs.filter("doc_id = 2").select(model.embed(F.col("text")).alias("v")).first().v
    at = {w: v for w, v in zip(model.words, model.matrix)}
    near = lambda w: float(at[w] @ np.array(whole) / np.linalg.norm(at[w]) / np.linalg.norm(whole))
    own = sorted({t for t in TEXTS[2].split()}, key=lambda w: -near(w))[:3]
    assert spark.range(1).select(wordvectors.nearness(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("x")).first().x == 0
    assert [r.keyword for r in top] == own and [r.score for r in top] == pytest.approx([near(w) for w in own])


def test_words_lean_the_way_of_their_seeds(spark):
    texts = ["Nice sun is good. Nice day! Cold rain is bad.", "Cold wind is bad. A sun, so good and great.", "Good and bad alike.", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: (r.good, r.bad, r.orientation) for r in sentiment.orientations(df, ["good", "great"], ["bad"], least=2).collect()}
    value = lambda good, bad: math.log((good + 0.5) * 3.5 / ((bad + 0.5) * 3.5))
    assert got == {w: (g, b, pytest.approx(value(g, b))) for w, (g, b) in {"is": (1, 2), "cold": (0, 2), "sun": (2, 0), "good": (3, 1), "bad": (1, 3), "and": (2, 1), "alike": (1, 1)}.items()}
    words = sentiment.lexicon(sentiment.orientations(df, ["good", "great"], ["bad"], least=2))
    scores = [r.p for r in spark.createDataFrame([("Sun sun",), ("cold unknown",), ("unknown",), (None,)], "t string").select(words.positivity(F.col("t")).alias("p")).collect()]
    assert scores == pytest.approx([1 / (1 + math.exp(-value(2, 0))), 1 / (1 + math.exp(-value(0, 2))), 0.5, 0.5])
    styled = style.with_counts(df.filter("text like 'Nice%'"), "text").select(style.vector(F.col("_style"), words.positivity(F.col("text"))).alias("v")).first().v
    assert len(styled) == 18 and 0 < styled[-1] < 1
    assert sentiment.lexicon(sentiment.orientations(df, [], [])).words == []
