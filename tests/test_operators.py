import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from antiphon.errors import ConfigurationError, DatasetError
from antiphon.functions.tokenisers import WordTokeniser
from antiphon.operators import annotations, datasets, encode, extract, filters, inference, keywords, learn, metrics, search, tiles
from antiphon.schemas import ANNOTATIONS, FRAMES


def test_keyword_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "bb aa bb aa cc"), (2, ""), (3, None)], "doc_id int, text string")
    assert [(r.rank, r.keyword, r.n) for r in keywords.simple(df, k=2).orderBy("rank").collect()] == [(1, "bb", 2), (2, "aa", 2)]
    grams = keywords.ngram(df, k=3, min_n=1, max_n=2).orderBy("rank").collect()
    assert [r.keyword for r in grams] == ["bb", "aa", "bb aa"]
    assert keywords.query_text(keywords.simple(df, k=2)).first().normalized == "bb aa"
    with pytest.raises(ValueError):
        keywords.ngram(df, min_n=3, max_n=2)


def test_keywords_by_embedding(spark):
    df = spark.createDataFrame([(1, "aa aa bb")], "doc_id int, text string")
    embed = lambda c: F.array(F.length(F.regexp_replace(c, "[^a]", "")), F.length(F.regexp_replace(c, "[^b]", "")))
    sim = lambda a, b: -(F.abs(a[0] - b[0]) + F.abs(a[1] - b[1]))
    assert [r.keyword for r in keywords.by_embedding(df, embed, sim, k=1).collect()] == ["aa aa"]


SENTENCES = "alpha beta gamma delta epsilon zeta eta theta iota kappa. Alpha  beta gamma delta epsilon zeta eta theta iota kappa. alpha beta gamma delta epsilon zeta eta theta other words. nothing alike."


def test_claims_and_evidence(spark):
    df = spark.createDataFrame([(1, SENTENCES), (2, "too short."), (3, None)], "doc_id int, text string")
    assert sorted(r.pos for r in extract.claims(df).collect()) == [0, 1, 2]
    pairs = extract.claim_evidence(df)
    got = {(r.claim_pos, r.evidence_pos) for r in pairs.collect()}
    assert got == {(0, 2), (1, 2), (2, 0), (2, 1)}  # a sentence equal to its claim is no evidence
    grouped = {r.doc_id: len(r.arguments) for r in extract.regroup(df, pairs).collect()}
    assert grouped == {1: 4, 2: 0, 3: 0}


def test_scorers_are_replaceable(spark):
    df = spark.createDataFrame([(1, "one two. three four.")], "doc_id int, text string")
    none = extract.claim_evidence(df, claim_scorer=lambda t: F.lit(0.0))
    every = extract.claim_evidence(df, claim_scorer=lambda t: F.lit(0.9), evidence_scorer=lambda a, b: F.lit(0.9))
    assert none.count() == 0 and every.count() == 2


def test_inference_pairs(spark):
    a = spark.createDataFrame([(1, "x y z"), (2, "We should go home now")], "id int, text string")
    b = spark.createDataFrame([(1, "we should GO home now"), (2, "We should not go home now")], "id int, text string")
    got = {(r.r_id, r.o_id): r.result for r in inference.pairs(a, b).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (2, 1): 1, (2, 2): -1}
    assert inference.pairs(a, b.limit(0)).count() == 0


def test_merge_claims_and_absorbed(spark):
    args = spark.createDataFrame([("r", 1, "Taxes are too high", "e1")], "run string, id int, claim string, evidence string")
    cand = spark.createDataFrame([("r", 1, "taxes are too high", "c1"), ("r", 2, "Dogs bark", "c2")], "run string, id int, claim string, evidence string")
    merged = inference.merge_claims(args, cand, ["run"])
    assert sorted((r.claim, r.evidence, r.merged) for r in merged.collect()) == [("Dogs bark", "c2", False), ("Taxes are too high", "c1", True)]
    r = inference.absorbed(cand, merged, ["run"]).first()
    assert (r.claims, r.absorbed, r.percent) == (2, 1, 50.0)
    assert inference.merge_claims(args.limit(0), cand, ["run"]).count() == 0


def vectors(spark, x, label=0):
    return spark.createDataFrame([(i, label, v.tolist()) for i, v in enumerate(x)], "vec_id int, label int, embedding array<double>")


@pytest.mark.parametrize(("refs", "others", "k", "each"), [(1, 1, 50, 1), (1, 25, 50, 25), (20, 1, 50, 1), (20, 60, 50, 50), (3, 130, 200, 100)])
def test_farthest_counts(spark, refs, others, k, each):
    rng = np.random.default_rng(0)
    got = search.farthest(vectors(spark, rng.normal(size=(refs, 5))), vectors(spark, rng.normal(size=(others, 5))), k, block=16)
    assert {r["count"] for r in got.groupBy("ref_id").count().collect()} == {each}


def test_farthest_is_the_opposite(spark):
    x = np.random.default_rng(1).normal(size=(200, 20))
    a, b = vectors(spark, x), vectors(spark, -x)
    got = search.farthest(a, b, 3, block=64).filter("rank = 1").collect()
    assert len(got) == 200 and all(r.ref_id == r.cand_id for r in got)
    native = search.farthest_native(a, b, 3).orderBy("ref_id", "rank").collect()
    assert [(r.ref_id, r.cand_id) for r in native] == [(r.ref_id, r.cand_id) for r in search.farthest(a, b, 3, block=50).orderBy("ref_id", "rank").collect()]


def test_farthest_edges(spark):
    a = vectors(spark, np.ones((2, 3)))
    assert search.farthest(a, a.limit(0), 3).count() == 0 and search.farthest(a.limit(0), a, 3).count() == 0
    assert [(r.ref_id, r.rank, r.cand_id) for r in search.farthest(a, a, 1).orderBy("ref_id").collect()] == [(0, 1, 0), (1, 1, 0)]
    for k in (0, -1):
        with pytest.raises(ValueError):
            search.farthest(a, a, k)
    with pytest.raises(PySparkException):
        search.farthest(vectors(spark, np.zeros((1, 3))), a, 1).collect()


def test_farthest_copies_rows_a_few_times(spark):
    x = np.random.default_rng(3).normal(size=(400, 3)).round(1) + 0.01
    x[300:] = x[:100]  # ties
    df = vectors(spark, x)
    got = search.farthest(df, df, 4, block=10)
    copies = tiles.shape(df, df, ["label"], 10).first()._lb
    assert copies == 40 and spark.range(1).select(search.blocks(F.lit(copies), 10).alias("n")).first().n == search.COPIES
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    have = {}
    for r in got.orderBy("ref_id", "rank").collect():
        have.setdefault(r.ref_id, []).append(r.similarity)
    assert all(np.allclose(have[i], np.sort(u @ u[i])[:4]) for i in range(400))
    seen = search.farthest(df, df, 4, block=10).groupBy("ref_id").agg(F.countDistinct("cand_id").alias("n")).agg(F.min("n")).first()[0]
    assert seen == 4


def test_farthest_leaves_out_cells(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 6)) * [1, 0.3, 0.2, 0.1, 0.05, 0.02] + [3, 0, 0, 0, 0, 0]
    x[2000:] = x[rng.integers(0, 40, 1000)]  # many copies of few
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    ids, seen, least = rng.permutation(3000), [], search._least
    monkeypatch.setattr(search, "_least", lambda u, z, *rest: (seen.append(len(u) * len(z)), least(u, z, *rest))[1])
    i, j, s = search._farthest(x, x, ids, 4, 256)
    order = np.lexsort((ids[j], s, i))
    same = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    exact = np.array([[(u * v).sum() for v in np.unique(x, axis=0)] for u in x[:200]])[:, same]
    for r in range(200):
        assert j[order][i[order] == r].tolist() == np.lexsort((ids, exact[r]))[:4].tolist()
    assert np.bincount(i).tolist() == [4] * 3000 and sum(seen) < 3000 * 3000 / 3


def test_farthest_with_nan_and_copies(spark):
    x = np.ones((300, 2)) * np.arange(1, 301)[:, None]  # one direction
    x[7], x[250] = [np.nan, 1], [-1, 0]
    got = search.farthest(vectors(spark, x), vectors(spark, x), 3, block=64).filter("ref_id in (5, 7, 250)").orderBy("ref_id", "rank").collect()
    assert [r.cand_id for r in got if r.ref_id == 5][0] == 250
    assert len(got) == 9 and all(np.isnan(r.similarity) for r in got if r.ref_id == 7)
    same = search.farthest(vectors(spark, np.tile([[1.0, 2.0, 0.7]], (300, 1))), vectors(spark, np.tile([[0.3, -2.0, 0.7]], (300, 1))), 3, block=64)
    assert {(r.rank, r.cand_id) for r in same.select("rank", "cand_id").distinct().collect()} == {(1, 0), (2, 1), (3, 2)}
    with pytest.raises(PySparkException):
        search.farthest(spark.createDataFrame([(0, 0, [1.0]), (1, 0, [1.0, 2.0])], "vec_id int, label int, embedding array<double>"), vectors(spark, x), 1).collect()


def test_cosine_pairs_by_blocks(spark):
    x = np.random.default_rng(2).normal(size=(60, 4)).round(2).tolist()
    odd = [(90, 0, None), (91, 0, [0.0] * 4), (92, 0, [1.0, None, 0.0, 2.0]), (93, 0, [1.0, 2.0]), (94, 0, []), (95, None, [1.0] * 4), (96, 0, [2.0, 4.0])]
    rows = [(i, i % 2, v) for i, v in enumerate(x)] + odd
    got = search.cosine_pairs(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), block=8)
    assert got.columns == ["label", "vec_id_1", "vec_id_2", "similarity"]
    at = {i: (g, v) for i, g, v in rows}

    def cosine(a, b):
        if any(not v or None in v or not any(v) for v in (a, b)) or len(a) != len(b):
            return None
        a, b = (np.array(v, np.float32).astype(float) for v in (a, b))
        return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)

    want = {(g, i, j): cosine(v, at[j][1]) for i, (g, v) in at.items() for j in at if g is not None and at[j][0] == g}
    have = {(r.label, r.vec_id_1, r.vec_id_2): r.similarity for r in got.collect()}
    assert got.count() == len(have) and have.keys() == want.keys() and have[0, 93, 96] == 1.0
    assert all(have[k] is None if v is None else abs(have[k] - v) < 2e-6 for k, v in want.items())
    assert search.cosine_pairs(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_counterarguments_keep_lonely_arguments(spark):
    args = spark.createDataFrame([("a", "Other", "c", "e"), ("b", "Morality", "c", "e")], "id string, primary_frame string, claim string, evidence string")
    found = spark.createDataFrame([("Other", "a", 1, "x", 0.1), ("Other", "a", 2, "y", 0.2)], "primary_frame string, ref_id string, rank int, cand_id string, similarity double")
    cand = spark.createDataFrame([("x", "cx", "ex"), ("y", "cy", "ey")], "id string, claim string, evidence string")
    got = {r.id: [c.claim for c in r.counterarguments] for r in search.counterarguments(args, found, cand).collect()}
    assert got == {"a": ["cx", "cy"], "b": []}


ESSAYS = [("1", "Evidence", "lost before a claim", 0.0), ("1", "Claim", "  first\nclaim ", 1.0), ("1", "Evidence", "proof one", 2.0), ("1", "Evidence", " ", 3.0), ("1", "Rebuttal", "ignored", 4.0), ("1", "Position", "second claim", 5.0), ("1", "Evidence", "proof two", 6.0), ("2", "Claim", "first claim", 1.0), ("2", "Evidence", "proof one", 2.0), (None, "Claim", "nobody", 1.0)]


@pytest.fixture(scope="module")
def essays(spark):
    return spark.createDataFrame(ESSAYS, "essay_id_comp string, discourse_type string, discourse_text string, discourse_start double")


def test_carry_forward(essays):
    got = [(r.essay_id_comp, r.claim, r.evidence) for r in datasets.carry_forward(essays).orderBy("essay_id_comp", "discourse_start").collect()]
    assert got == [("1", "first claim", "proof one"), ("1", "second claim", "proof two"), ("2", "first claim", "proof one")]
    once = datasets.distinct_first(datasets.carry_forward(essays), ["claim", "evidence"], ["essay_id_comp", "discourse_start"])
    assert sorted((r.essay_id_comp, r.claim) for r in once.collect()) == [("1", "first claim"), ("1", "second claim")]


def test_claim_sentences(essays):
    rows = datasets.claim_sentences(essays).collect()
    assert [(r.sentence, r.is_claim) for r in rows] == [("lost before a claim", 0)]
    with pytest.raises(DatasetError):
        datasets.claim_sentences(essays.drop("discourse_start"))


def test_negatives_never_leak_or_repeat(spark):
    pos = spark.createDataFrame([(f"s{i % 2}", i, f"c{i}", f"e{i}") for i in range(20)], "split string, n int, claim string, evidence string")
    neg = datasets.negatives(pos, 1, ["n"], within="split").collect()
    assert len(neg) == 20 and all(r.claim is not None and r.claim != f"c{r.n}" and int(r.claim[1:]) % 2 == r.n % 2 for r in neg)
    assert sorted(r.claim for r in neg) == sorted(f"c{i}" for i in range(20))
    empty = datasets.labelled_pairs(pos.limit(0), 1, ["n"])
    assert empty.count() == 0 and "is_evidence" in empty.columns


def test_splits(spark):
    df = spark.createDataFrame([(i, i // 3, i % 2) for i in range(900)], "id int, g int, y int")
    split = datasets.group_split(df, "g")
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    share = {r.split: r.n / 900 for r in datasets.totals(split).collect()}
    assert 0.7 < share["training"] < 0.9 and share[None] == 1
    half = datasets.stratified_halves(df, "y", "id").groupBy("y", "split").count().collect()
    assert {r["count"] for r in half} == {225}
    assert {r.split for r in datasets.argument_split(df.limit(2), "id").collect()} == {"training"}


def test_sample_and_union(spark):
    df = spark.range(50)
    a, b = ([r.id for r in datasets.sample(df.repartition(n), 10, 7, "id").collect()] for n in (1, 5))
    assert a == b and len(set(a)) == 10 and datasets.sample(df, 0, 7, "id").count() == 50
    assert datasets.combined([df, df.limit(0)], 1, "id").count() == 50


def test_look_up(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    side = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 0)], "k string, v int, place int")
    assert {r.k: r.got for r in datasets.look_up(df, side, "k", "v", "got").collect()} == {"a": 2, "b": 3}
    with pytest.raises(PySparkException):
        datasets.look_up(df, side.filter("k = 'a'"), "k", "v", "got").collect()


def test_filters(spark):
    df = spark.createDataFrame([("a", "Other"), ("b", "Nope"), (" ", "Other"), (None, "Economic")], "text string, frame string")
    assert filters.non_empty(df, "text").count() == 2
    good, lost = filters.known_frames(df, "frame")
    assert good.count() == 3 and lost == 1
    with pytest.raises(DatasetError):
        filters.known_frames(df.filter("frame = 'Nope'"), "frame")
    assert filters.common_classes(df, "frame").count() == 2 and filters.by_frame(df, "Other", "frame").count() == 2
    assert filters.head(df, 1, "frame").first().frame == "Economic" and filters.head(df, None).count() == 4


def args(spark, rows):
    return spark.createDataFrame([(c, e) for c, e in rows], "claim string, evidence string")


def test_set_metrics(spark):
    gold = args(spark, [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")])
    pred = args(spark, [("a", "1"), ("b", "2"), ("c", "3"), ("x", "9"), ("a", "1")])
    m = metrics.set_metrics(pred, gold, ["claim", "evidence"]).first()
    assert (m.iou, m.precision, m.recall) == (0.5, 0.75, 0.6) and m.f1 == pytest.approx(2 / 3)
    for p, g in ((pred.limit(0), gold), (pred, gold.limit(0)), (pred.limit(0), gold.limit(0))):
        m = metrics.set_metrics(p, g, ["claim", "evidence"]).first()
        assert (m.iou, m.precision, m.recall, m.f1) == (0, 0, 0, 0)


def test_pairs_are_unordered(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string")
    assert df.select(metrics.unordered(F.col("x"), F.col("y")).alias("p")).distinct().count() == 1


def test_class_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y_true string, y_pred string")
    cells = metrics.confusion(df, spark.createDataFrame([("a",), ("b",), ("c",)], "class string"))
    assert cells.count() == 9 and cells.agg(F.sum("n")).first()[0] == 3
    m = {r["class"]: (r.precision, r.recall, r.support) for r in metrics.class_metrics(cells).collect()}
    assert m == {"a": (1.0, 0.5, 2), "b": (0.5, 1.0, 1), "c": (0.0, 0.0, 0)}
    s = metrics.summary_metrics(cells).first()
    assert s.accuracy == pytest.approx(2 / 3) and s.macro_precision == pytest.approx(0.5)
    assert metrics.confusion_matrix(cells, ["a", "b", "c"]).count() == 3


SPAN = lambda kind, t, a=0, b=3: (kind, a, b, t)
GOOD = ([(1, "t1", "text", None), (2, "t1", "later", "s")], [(1, 1, SPAN("claim", "c1"), [SPAN("evidence", "e1"), SPAN("evidence", "e2")]), (2, 2, SPAN("claim", "c2"), [SPAN("evidence", "e3")])], [(1, "contradicts", 2)], "1")


def golden(spark, row):
    return spark.createDataFrame([row], ANNOTATIONS)


def test_annotations(spark):
    g = golden(spark, GOOD)
    assert sorted((r.claim, r.evidence) for r in annotations.arguments(g).collect()) == [("c1", "e1"), ("c1", "e2"), ("c2", "e3")]
    assert [(r.title, r.text) for r in annotations.raw_texts(g).collect()] == [("t1", "later")]
    assert sorted((r.evidence_a, r.evidence_b) for r in annotations.related_pairs(g).collect()) == [("e1", "e3"), ("e2", "e3")]
    assert annotations.record_errors(g).count() == 0
    assert [r.new for r in annotations.rekeyed(annotations.documents(g), 10).orderBy("old").collect()] == [11, 12]


def test_annotation_errors(spark):
    bad = ([(0, " ", None, None)], [(1, 9, SPAN("claim", "c", 5, 5), []), (2, 0, ("x", -1, 2, None), [SPAN("evidence", "e")])], [(1, "supports", 1), (1, "contradicts", 7)], None)
    errors = [(r.kind, r.error) for r in annotations.record_errors(golden(spark, bad)).collect()]
    for want in (("document", "id must be positive"), ("document", "title must not be empty"), ("document", "text is missing"), ("argument", "evidence must not be empty"), ("argument", "span end must be after its start"), ("argument", "span kind must be claim or evidence"), ("argument", "unknown document"), ("relation", "a and b must differ"), ("relation", "type must be contradicts"), ("relation", "unknown argument")):
        assert want in errors
    with pytest.raises(PySparkException):
        annotations.related_pairs(golden(spark, bad)).collect()


def test_references_stay_within_their_row(spark):
    loose = ([(1, "t", "text", None)], [(1, 1, SPAN("claim", "c"), [SPAN("evidence", "e")]), (2, 8, SPAN("claim", "c"), [SPAN("evidence", "e")])], [(1, "contradicts", 9), (8, "contradicts", 9)], "1")
    other = ([(8, "t", "text", None)], [(8, 8, SPAN("claim", "c"), [SPAN("evidence", "e")]), (9, 8, SPAN("claim", "c"), [SPAN("evidence", "e")])], [(8, "contradicts", 9)], "1")
    got = annotations.record_errors(spark.createDataFrame([loose, other, other], ANNOTATIONS)).collect()
    assert sorted(map(tuple, got)) == [("argument", 2, "unknown document"), ("relation", 0, "unknown argument"), ("relation", 1, "unknown argument")]


def test_encoder(spark):
    df = spark.createDataFrame([([0.1] * 18, "Morality", {"Morality": 0.7})], "s array<double>, f string, p map<string,double>").select(encode.encoder_input(F.col("s"), F.col("f"), F.col("p")).alias("x"))
    x = df.first().x
    assert len(x) == 48 and x[18 + FRAMES.index("Morality")] == 1 and x[33 + FRAMES.index("Morality")] == 0.7
    for n, want in ((None, 10), (5, 5), (100, 100)):
        assert len(df.select(encode.projection(F.col("x"), n).alias("y")).first().y) == want
    for n in (0, -100):
        with pytest.raises(ConfigurationError):
            encode.projection(F.col("x"), n)
    net = encode.Network.fresh((48, 8, 4))
    y = df.select(encode.network(F.col("x"), net).alias("y")).first().y
    assert y == pytest.approx(net.forward(np.array([x]))[0].tolist()) and all(0 < v < 1 for v in y)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 60, 48))
    losses = net.train(a, b, np.full(60, 0.1))
    assert min(losses) <= losses[0]


def test_network_learns_in_all_layers(tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 400, 6))
    distance = np.where((a[:, 0] > 0) == (b[:, 0] > 0), 0.0, 0.5)
    net = encode.Network.fresh((6, 16, 8, 4))
    before = net.copy()
    losses = net.train(a, b, distance, epochs=60, batch=64)
    assert min(losses) < 0.5 * losses[0] and net.loss(a[4::5], b[4::5], distance[4::5]) == pytest.approx(min(losses))
    assert all(np.abs(v - w).max() > 1e-3 for v, w in zip(net.weights, before.weights))
    net.save(str(tmp_path / "net.npz"))
    assert (encode.Network.load(str(tmp_path / "net.npz")).forward(a) == net.forward(a)).all()


def test_network_gradients():
    rng = np.random.default_rng(2)
    net, x, want = encode.Network.fresh((3, 4, 2), seed=3), rng.normal(size=(7, 3)), rng.random((7, 2))
    got = net._gradients(x, lambda y: y - want, 0.0, rng)

    def loss():
        values = []
        net.copy()._gradients(x, lambda y: values.append(((y - want) ** 2).sum() / 2) or y - want, 0.0, rng)
        return values[0]

    for v, g in zip(net._values(), got):
        for at in np.ndindex(v.shape):
            v[at] += 1e-6
            up = loss()
            v[at] -= 2e-6
            down = loss()
            v[at] += 1e-6
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_word_tokeniser(spark):
    df = spark.createDataFrame([("the cat the dog",), ("a cat",)], "text string")
    tok = WordTokeniser.fit(df, 2)
    assert tok.vocabulary == ["cat", "the"]
    got = df.select(tok.encode(F.col("text")).alias("ids"), tok.decode(tok.encode(F.col("text"))).alias("back")).collect()
    assert [r.ids for r in got] == [[2, 1, 2, 0], [1]] and [r.back for r in got] == ["the cat the ?", "cat"]
    assert keywords.simple(df.withColumn("doc_id", F.length("text")), tokeniser=tok).filter("doc_id = 15 and rank = 1").first().keyword == "the"
    assert df.select(tok.decode(F.array(F.lit(9))).alias("x")).first().x is None


def test_merged_annotations(spark):
    g = golden(spark, GOOD)
    both = annotations.merged(g, g)
    assert annotations.record_errors(both).count() == 0
    r = both.first()
    assert [d.id for d in r.documents] == [1, 2, 3, 4] and [(a.id, a.documentId) for a in r.arguments] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert [(x.a, x.b) for x in r.relations] == [(1, 2), (3, 4)]
    with pytest.raises(DatasetError):
        annotations.merged(g, golden(spark, ([(0, " ", None, None)], [], [], None)))


def test_side_store(spark, tmp_path):
    for place, vector in enumerate(([1.0], [2.0])):
        datasets.store_values(spark.createDataFrame([("a", vector)], "t string, v array<double>"), str(tmp_path / "s"), "t", "v", place)
    side = spark.read.parquet(str(tmp_path / "s")).withColumnRenamed("key", "t")
    assert datasets.look_up(spark.createDataFrame([("a",)], "t string"), side, "t", "value", "v").first().v == [2.0]


def test_pairs_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(tiles.tiled_join, "__defaults__", ((), 4))
    left = spark.createDataFrame([(i, f"a{i}", {"m": i}) for i in range(23)] + [(None, "x", None)], "k long, text string, m map<string,int>")
    right = spark.createDataFrame([(i % 3, f"b{i}") for i in range(31)] + [(None, "y")], "k long, text string")
    got = [(r.r_text, r.o_text) for r in inference.pairs(left, right).collect()]
    assert len(got) == len(set(got)) == 24 * 32
    keyed = [(r.k, r.r_text, r.o_text) for r in inference.pairs(left.withColumn("k", F.col("k") % 2), right, ["k"]).collect()]
    assert sorted(keyed) == sorted((k, f"a{i}", f"b{j}") for k in (0, 1) for i in range(23) if i % 2 == k for j in range(31) if j % 3 == k)
    assert inference.pairs(left.limit(0), right).count() == inference.pairs(left, right.limit(0)).count() == 0
    rows = spark.createDataFrame([(f"t{i % 2}", i) for i in range(40)], "split string, n int")
    assert sorted((r.split, r.n_1, r.n_2) for r in datasets.pair_up(rows, ["n"]).collect()) == sorted((f"t{i % 2}", i, j) for i in range(40) for j in range(40) if i % 2 == j % 2)


def test_farthest_search_with_ties_and_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, rng.integers(-1, 2, 4).tolist()) for i in range(150)]
    rows = [(i, g, [float(v) for v in x] if any(x) else [1.0, 0.0, 0.0, 0.0]) for i, g, x in rows]
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    unit = {i: np.array(x) / np.linalg.norm(x) for i, _, x in rows}
    got = {}
    for r in search.farthest(e, e, k=6, block=16).collect():
        got.setdefault(r.ref_id, []).append((r.rank, r.cand_id, round(r.similarity, 6)))
    for i, g, _ in rows:
        want = sorted((round(float(unit[i] @ unit[j]), 6) + 0.0, j) for j, h, _ in rows if h == g)[:6]
        assert [s + 0.0 for _, _, s in sorted(got[i])] == [s for s, _ in want]


def test_hash_ranges_keep_the_order(spark):
    rows = spark.createDataFrame([(i, f"c{i}", i % 2) for i in range(200)], "k long, claim string, split int")
    got = datasets.negatives(rows, 7, ["k"], within="split").collect()
    assert len(got) == 200 and sorted(r.claim for r in got) == sorted(f"c{i}" for i in range(200))  # a permutation
    assert all(r.claim != f"c{r.k}" and int(r.claim[1:]) % 2 == r.split for r in got)
    halves = datasets.stratified_halves(rows, "split", "k").groupBy("split").count().collect()
    assert {r["count"] for r in halves} == {100}


def test_models(spark, tmp_path):
    rows = [(f"we claim point {w}", 1) for w in "abcdefghij" * 2] + [(f"nothing to see {w}", 0) for w in "abcdefghij" * 2]
    df = spark.createDataFrame(rows, "sentence string, is_claim int")
    model = learn.claim_pipeline(trees=3, depth=2).fit(df)
    learn.save(model, str(tmp_path / "m"))
    scored = learn.load(str(tmp_path / "m")).transform(df)
    assert learn.area(scored, "is_claim") == pytest.approx(1.0)
    assert scored.select(learn.positive_probability().alias("p")).filter("p between 0 and 1").count() == 40
    cv = learn.tuned(learn.claim_pipeline(trees=2), df, "is_claim", {"maxDepth": [1, 2]}, folds=2)
    assert 0.5 < learn.mean_score(cv) <= 1
    once = learn.scored_once(df, "sentence", lambda c: F.length(c))
    assert once.count() == 40 and once.filter("_score is null").count() == 0
    pairs = spark.createDataFrame([("a claim", "its proof", 1), ("a claim", "other words", 0)] * 5, "claim string, evidence string, is_evidence int")
    assert learn.evidence_pipeline(trees=1, depth=1).fit(pairs).transform(pairs).count() == 10


def test_commonest_terms_need_few_counts(spark):
    rows = [(i, "aa bb " * 5 + f"cc{chr(97 + i % 26)} dd{chr(97 + i // 2)}") for i in range(30)] + [(3, "aa bb"), (50, ""), (51, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert learn._longer(df, "text", 2, ["aa", "bb"]).distinct().count() == 2  # pairs of rarer words are not counted
    w, vocabulary = learn.tf_idf_weights(df, "doc_id", limit=3)
    assert {r.term for r in vocabulary.collect()} == {"aa", "bb", "aa bb"}
    got = {(r.doc_id, r.term): r.w for r in w.collect()}
    assert len(got) == 90 and got[3, "aa"] == pytest.approx(6 / 108**0.5)  # both rows of document 3
    assert {r.doc_id: len(r.idx) for r in learn.sparse_rows(df, "doc_id", limit=3).collect()} == {**{i: 3 for i in range(30)}, 50: 0, 51: 0}


def test_tf_idf(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc"), (3, "")], "doc_id int, text string")
    w, vocabulary = learn.tf_idf_weights(df, "doc_id", max_n=1)
    idf = {r.term: r.idf for r in vocabulary.collect()}
    assert idf["aa"] == pytest.approx(np.log(4 / 3) + 1) and idf["bb"] == pytest.approx(np.log(2) + 1)
    assert w.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).filter("abs(n - 1) > 1e-9").count() == 0
    v = {r.doc_id: r.features.numNonzeros() for r in learn.tf_idf(df, "doc_id", max_n=1).collect()}
    assert v == {1: 2, 2: 2, 3: 0}
    train = learn.tf_idf(df, "doc_id", max_n=1).withColumn("label", (F.col("doc_id") % 3).cast("double"))
    assert learn.frame_classifier(iterations=2).fit(train).transform(train).count() == 3
    assert learn.boosted_frames(trees=1, depth=1).fit(train).transform(train).count() == 3


def test_balance_and_histogram(spark):
    df = spark.createDataFrame(pd.DataFrame({"y": [1, 0, 1], "c": ["a", "b", "a"]}))
    assert tuple(datasets.label_balance(df, "y").first()) == (2, 1)
    assert [tuple(r) for r in datasets.histogram(df, "c", 1).collect()] == [("a", 2)]
