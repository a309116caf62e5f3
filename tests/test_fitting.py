"""Models fitted on tables, and the inverted index: against plain numpy and full scans."""

import math
import random
import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from antiphon.errors import DatasetError
from antiphon.config import Cache
from antiphon.functions.tokenisers import WordTokeniser
from antiphon.operators import annotations, boost, encode, fingerprint, learn, ranks, train, tune
from antiphon.plans import registry
from antiphon.sources import index, web

# --- the encoder ---------------------------------------------------------------------------------


def pairs(spark, n=160, width=6, parts=1, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, width)), rng.normal(size=(n, width))
    d = np.where(a[:, 0] * b[:, 0] > 0, 0.05, 0.8)
    rows = [(x.tolist(), y.tolist(), float(t)) for x, y, t in zip(a, b, d)]
    return a, b, d, spark.createDataFrame(rows, "x1 array<double>, x2 array<double>, distance double").repartition(parts)


def test_one_partition_trains_as_the_network_does(spark):
    a, b, d, _ = pairs(spark)
    held = np.arange(len(a)) % 5 == 4
    table = lambda m: spark.createDataFrame([(x.tolist(), y.tolist(), float(t)) for x, y, t in zip(a[m], b[m], d[m])], "x1 array<double>, x2 array<double>, distance double").coalesce(1)
    net = encode.Network.fresh((6, 8, 4))
    want = net.train(a, b, d, epochs=4, batch=10**6, dropout=0.0)
    got = train.train_encoder(table(~held), table(held), (6, 8, 4), train.Settings(epochs=4, dropout=0.0, chunk=10**6))
    assert np.allclose(got.losses, want, atol=1e-6) and got.losses[got.best_epoch] == min(got.losses)
    assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(got.network._values(), net._values()))


def test_gradients_of_tasks_are_added_up(spark):
    _, _, _, df = pairs(spark, parts=3)
    net = encode.Network.fresh((6, 5, 4), seed=2)
    grads, statistics, n = train.step_sums(net, df, 0.0, 16, (0,))
    total, means, rows = None, None, 0
    for own in df.rdd.glom().collect():
        at = 0
        while at < len(own):
            size = 16 if len(own) - at > 17 else len(own) - at
            part = own[at : at + size]
            at += size
            x, y, t = (np.array([r[k] for r in part], float) for k in range(3))
            copy = net.copy()
            g = copy._gradients(np.concatenate([x, y]), encode.pair_gradient(t), 0.0, np.random.default_rng(0), momentum=1.0)
            now, stat = [v * size for v in g], [v * size for v in (*copy.means, *copy.variances)]
            total = now if total is None else [p + q for p, q in zip(total, now)]
            means = stat if means is None else [p + q for p, q in zip(means, stat)]
            rows += size
    assert n == rows == 160
    assert all(np.allclose(g, v / rows, atol=1e-9) for g, v in zip(grads, total))
    assert all(np.allclose(g, v / rows, atol=1e-9) for g, v in zip(statistics, means))


def test_training_in_steps_learns(spark):
    _, _, _, df = pairs(spark, 600, parts=3)
    _, _, _, check = pairs(spark, 200, parts=2, seed=9)
    got = train.train_encoder(df.union(df.limit(1).withColumn("distance", F.lit(None).cast("double"))), check, (6, 16, 8), train.Settings(epochs=6, dropout=0.0, step=250, chunk=64, rate=0.02))
    assert min(got.losses) < 0.9 * got.losses[0]
    assert abs(train.mean_loss(got.network, check) - got.losses[got.best_epoch]) < 1e-9
    for a, b in ((df.limit(0), check), (df, check.limit(0))):
        with pytest.raises(DatasetError):
            train.train_encoder(a, b, (6, 4), train.Settings(epochs=1))


# --- boosting ------------------------------------------------------------------------------------


def sparse(seed, n=400, features=12, classes=4):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, features)) < 0.5, 0, np.round(rng.random((n, features)) + 0.01, 3))
    y = ((x[:, 0] > 0.5) * 2 + (x[:, 1] > x[:, 2])).astype(int) % classes
    rows = [([int(f) for f in np.flatnonzero(r)], [float(v) for v in r[r > 0]], int(t)) for r, t in zip(x, y)]
    return x, y, rows


SPARSE = "idx array<int>, w array<double>, label int"


def grown(forest, x, y, classes, depth):
    """The next round's trees by going over all rows."""
    p = boost.softmax(forest.base + forest.margins(x))
    out = []
    for k in range(classes):
        g, h = p[:, k] - (y == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)
        leaves = []

        def grow(own, level):
            G, H = g[own].sum(), h[own].sum()
            best = (1e-9, None, None)
            for f in range(x.shape[1]) if level < depth else ():
                for cut in range(boost.BINS - 1):
                    left = own & (x[:, f] <= cut)
                    gl, hl = g[left].sum(), h[left].sum()
                    if hl >= boost.LEAST and H - hl >= boost.LEAST:
                        gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, cut)
            if best[1] is None:
                leaves.append((own, -boost.RATE * G / (H + 1)))
            else:
                grow(own & (x[:, best[1]] <= best[2]), level + 1)
                grow(own & (x[:, best[1]] > best[2]), level + 1)

        grow(np.ones(len(y), bool), 0)
        v = np.zeros(len(y))
        for own, value in leaves:
            v[own] = value
        out.append(v)
    return np.array(out).T


def test_trees_are_those_of_one_pass_over_all_rows(spark):
    _, y, rows = sparse(3)
    forest = boost.fit(spark.createDataFrame(rows + [([1], [0.5], 9), ([1], [0.5], None)], SPARSE).repartition(3), 4, 12, trees=7, depth=3)
    assert len(forest.rounds) == 7 and all(len(r) == 4 for r in forest.rounds)
    x = forest.bins([r[0] for r in rows], [r[1] for r in rows])
    for k in (0, 3, 6):
        before = boost.Forest(forest.edges, forest.base, 3, forest.rounds[:k])
        now = boost.Forest(forest.edges, np.zeros(4), 3, forest.rounds[k : k + 1])
        assert np.allclose(now.margins(x), grown(before, x, y, 4, 3), atol=1e-9)


def test_trees_are_the_same_bits_however_rows_are_dealt(spark):
    df = spark.createDataFrame(sparse(6, 700)[2], SPARSE)
    one, many = (boost.fit(df.repartition(n), 4, 12, trees=6, depth=3) for n in (1, 5))
    for a, b in zip(sum(one.rounds, []), sum(many.rounds, [])):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.leaf == b.leaf).all()


def test_joint_classes_beat_one_against_the_rest(spark):
    _, y, rows = sparse(4, 900)
    _, yt, test = sparse(5, 500)
    df = spark.createDataFrame(rows, SPARSE).repartition(2)
    loss = lambda p, y: -np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)).mean()
    joint = boost.fit(df, 4, 12, trees=6, depth=3)
    idx, w = [r[0] for r in test], [r[1] for r in test]
    p = joint.probabilities(joint.bins(idx, w))
    single = [boost.fit(df.withColumn("label", (F.col("label") == k).cast("int")), 2, 12, trees=3, depth=3) for k in range(4)]  # as many trees: two a round
    q = np.stack([f.probabilities(f.bins(idx, w))[:, 1] for f in single], 1)
    assert np.allclose(p.sum(1), 1) and loss(p, yt) < loss(q / q.sum(1, keepdims=True), yt)
    got = spark.createDataFrame(test, SPARSE).withColumn("p", joint.column(F.col("idx"), F.col("w"))).agg(boost.log_loss(F.col("p"), F.col("label"))).first()[0]
    assert abs(got - loss(p, yt)) < 1e-9
    with pytest.raises(DatasetError):
        boost.fit(df.limit(0), 4, 12)


# --- the index -----------------------------------------------------------------------------------


def slow_search(docs, query, limit, scoring):
    words = lambda t: [w for w in __import__("re").findall(r"(?<!\w)[a-z]{2,}(?!\w)", (t or "").lower())]
    bags = [(u, Counter(words(t)), len(words(t))) for u, t in docs]
    n, mean = len(docs), sum(m for _, _, m in bags) / len(docs)
    df = Counter(w for _, bag, _ in bags for w in bag)
    found = []
    for u, bag, m in bags:
        own = [w for w in sorted(set(words(query))) if w in bag]
        if own:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * m / mean)) for w in own)
            found.append((-round(s, 9) if scoring == "bm25" else -float(len(own)), u))
    return [(r, u, -s) for r, (s, u) in enumerate(sorted(found)[:limit])]


@pytest.mark.parametrize("scoring", ["bm25", "shared"])
def test_search_equals_a_full_scan(spark, scoring, tmp_path):
    rng = random.Random(8)
    words = [a + b for a in "abcdefgh" for b in "klmnop"]
    line = lambda n: " ".join(words[min(int(rng.expovariate(0.12)), len(words) - 1)] for _ in range(n))
    docs = [(f"u{i:03}", line(rng.randrange(0, 40))) for i in range(300)] + [("v1", None), ("v2", ""), ("v3", "ak " * 500), ("v4", "same text here"), ("v5", "same text here")]
    queries = [(i, line(rng.randrange(1, 6))) for i in range(25)] + [(90, ""), (91, None), (92, "unknownword"), (93, "same"), (94, "ak al am")]
    held = index.build(spark.createDataFrame([*docs, (None, "ak al")], "url string, text string").repartition(3), block=20)
    assert held.postings.groupBy("term").count().agg(F.max("count")).first()[0] <= 16  # blocks, not documents
    q = spark.createDataFrame(queries, "doc_id long, normalized string")
    got = {}
    for r in index.search(held, q, 4, scoring=scoring).collect():
        got.setdefault(r.doc_id, []).append((r.rank, r.url, r.score))
    for key, text in queries:
        want, have = slow_search(docs, text, 4, scoring), sorted(got.get(key, []))
        assert [w[:2] for w in want] == [h[:2] for h in have] and np.allclose([w[2] for w in want], [h[2] for h in have], atol=1e-8)
    if scoring == "shared":
        assert web.keyword_results(q, held, 4).count() == sum(map(len, got.values()))
    held.save(str(tmp_path / "i"))
    again = index.search(index.Index.load(spark, str(tmp_path / "i")), q, 4, scoring=scoring)
    assert {(r.doc_id, r.rank, r.url) for r in again.collect()} == {(k, r, u) for k, v in got.items() for r, u, _ in v}


def test_an_index_of_some_terms_finds_the_same(spark):
    docs = spark.createDataFrame([(f"u{i:02}", f"aa {'bb ' * (i % 4)}cc{chr(97 + i % 9)} rare{chr(97 + i % 26)}") for i in range(60)] + [("u03", "aa bb"), ("w", None)], "url string, text string")
    q = spark.createDataFrame([(1, "bb cca"), (2, "aa unknown"), (3, "")], "doc_id long, normalized string")
    some, whole = (index.build(docs, block=20, terms=t) for t in (index.terms_of(q), None))
    assert {r.term for r in some.postings.select("term").collect()} == {"aa", "bb", "cca"} and some.n == whole.n == 62
    found = [{tuple(r) for r in index.search(held, q, 4).collect()} for held in (some, whole)]
    assert found[0] == found[1] and {r[0] for r in found[0]} == {1, 2}


def test_an_empty_index(spark):
    held = index.build(spark.createDataFrame([], "url string, text string"))
    assert index.search(held, spark.createDataFrame([(1, "a word")], "doc_id long, normalized string")).collect() == []
    with pytest.raises(ValueError):
        index.search(held, spark.range(1).selectExpr("id doc_id", "'a' normalized"), scoring="other")


# --- settings, fingerprints, the cache -------------------------------------------------------------

SPACE = {"x": tune.Number(-5, 5), "rate": tune.Number(1e-4, 1, log=True), "n": tune.Number(1, 30, whole=True), "kind": tune.Choice(("a", "b", "c"))}


def hill(t):
    s = t.settings
    return -((s["x"] - 1.5) ** 2) - math.log10(s["rate"] / 0.02) ** 2 - abs(s["n"] - 11) / 10 - (s["kind"] != "b")


def test_search_is_deterministic_and_beats_chance():
    a, b = (tune.search(SPACE, hill, 40, parallel=4, seed=3) for _ in range(2))
    assert [t.settings for t in a.trials] == [t.settings for t in b.trials] and len(a.trials) == 40
    assert all(-5 <= t.settings["x"] <= 5 and 1e-4 <= t.settings["rate"] <= 1 and isinstance(t.settings["n"], int) for t in a.trials)
    led, drawn = ([tune.search(SPACE, hill, 40, seed=s, startup=n).best.score for s in range(12)] for n in (10, 40))
    assert np.mean(led) > np.mean(drawn) and np.median(led) > np.median(drawn)
    worst = tune.search(SPACE, lambda t: math.nan, 4).best
    assert worst.score == -math.inf
    with pytest.raises(Exception, match="needs settings"):
        tune.search({}, hill)


def test_weak_trials_are_given_up():
    def objective(t):
        for k in range(5):
            t.report(hill(t) + 0.01 * k)
        return hill(t) + 0.04

    study = tune.search(SPACE, objective, 30, parallel=3, seed=1, startup=8)
    gone = [t for t in study.trials if t.pruned]
    assert gone and all(len(t.reports) < 5 and t.number >= 8 for t in gone) and not study.best.pruned


def test_settings_of_a_pipeline(spark):
    words = ["therefore we must act", "it is raining today", "we should because of that", "the cat sat there"]
    df = spark.createDataFrame([(i, f"{words[i % 4]} w{'abcdefgh'[i % 8]}", (i + 1) % 2) for i in range(80)], "id long, sentence string, is_claim int")
    study, model = tune.tuned(learn.claim_pipeline(), df, "is_claim", "id", {"maxDepth": tune.Number(1, 3, whole=True), "maxIter": tune.Number(1, 3, whole=True)}, trials=3, folds=2, parallel=2)
    assert len(study.trials) == 3 and study.best.score > 0.9 and model.transform(df).count() == 80


def test_fingerprints_of_tables(spark):
    rows = [(1, "a", None), (2, "b", 1.5), (2, "b", 1.5), (None, "", 2.0)]
    of = lambda r, **k: fingerprint.fingerprint(spark.createDataFrame(r, "i long, t string, d double").repartition(k.get("parts", 1))).first()
    base = of(rows)
    assert base.n == 4 and of(rows[::-1], parts=3) == base
    others = [rows[:-1], [*rows, rows[0]], rows[:3] + [(None, None, 2.0)], [(1, "a", 0.0), *rows[1:]], [(1, "b", 1.5), *rows[1:]], rows[:2] + [rows[0], rows[3]], []]
    assert len({base.fingerprint, *(of(r).fingerprint for r in others)}) == len(others) + 1


def test_cache_reads_its_folders_and_compacts(spark, tmp_path):
    cache = web.CacheTable(spark, Cache(ttl_seconds=10), str(tmp_path / "c"))
    kind = ", ".join(web.CacheTable.SCHEMA.split(", ")[:2])
    entries = lambda tag, n: spark.createDataFrame([(f"k{i}", [(f"u{i}", tag, *[None] * (len(web.DOCUMENT.fields) - 2))]) for i in range(n)], kind)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    for now, tag, n in ((0, "old", 30), (5, "new", 20), (8, "newest", 2)):
        cache.set(entries(tag, n), now)
    got = cache.get(keys("k1", "k5", "none"), 9)
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:60]
    own = {r.b for r in keys("k1", "k5", "none").select(cache._bucket().alias("b")).collect()}
    shutil.copytree(tmp_path / "c", tmp_path / "other")
    for f in (tmp_path / "other").rglob("*.parquet"):  # whatever it must not read is broken
        if int(f.parent.name.split("=")[1]) not in own:
            f.write_bytes(b"broken")
            (f.parent / f".{f.name}.crc").unlink()
    other = web.CacheTable(spark, Cache(ttl_seconds=10), str(tmp_path / "other"))
    assert {r.key for r in other.get(keys("k1", "k5", "none"), 9).collect()} == {"k1", "k5"}
    assert {r.key: r.docs[0][1] for r in got.collect()} == {"k1": "newest", "k5": "new"}
    assert {r.key: r.docs[0][1] for r in cache.get(keys("k1", "k5", "k25"), 12).collect()} == {"k1": "newest", "k5": "new"}
    before = cache.get(keys("k5"), 12)
    cache.compact(12)
    assert cache._rows().count() == 20 and [r.docs[0][1] for r in before.collect()] == ["new"]
    (tmp_path / "c" / "generation-000000009").mkdir()  # half written
    assert cache._current().endswith("generation-000000001")
    assert {r.key: r.docs[0][1] for r in cache.get(keys("k1", "k5", "k25"), 12).collect()} == {"k1": "newest", "k5": "new"}
    cache.set(entries("again", 1), 13)
    cache.compact(17)
    assert {r.key: r.docs[0][1] for r in cache._rows().collect()} == {"k0": "again", "k1": "newest"} and len(cache._generations()) == 2
    cache.clear()
    assert cache._rows().count() == 0 and len(cache._generations()) == 1


# --- ranks, merged records, stored models ----------------------------------------------------------


def test_ranks_of_a_whole_table(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), i) for i in range(500)] + [(None, 900)]
    got = ranks.ranked(spark.createDataFrame(rows, "k int, i int").repartition(5), F.desc("k"), "i").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.rank)] == want and sorted(r.rank for r in got) == list(range(1, 502))
    assert ranks.ranked(spark.createDataFrame([], "k int"), "k").count() == 0


def test_merged_records(spark):
    side = lambda ids: {"documents": spark.createDataFrame([(i, f"d{i}") for i in ids], "id long, title string"), "arguments": spark.createDataFrame([(10 * i, i) for i in ids], "id long, documentId long"), "relations": spark.createDataFrame([(10 * a, 10 * b) for a, b in zip(ids, ids[1:])], "a long, b long")}
    got = annotations.merged_rows(side([1, 5]), side([2, 3, 9]))
    assert sorted(tuple(r) for r in got["documents"].collect()) == [(1, "d1"), (5, "d5"), (6, "d2"), (7, "d3"), (8, "d9")]
    assert sorted(tuple(r) for r in got["arguments"].collect()) == [(10, 1), (50, 5), (51, 6), (52, 7), (53, 8)]
    assert sorted(tuple(r) for r in got["relations"].collect()) == [(10, 50), (51, 52), (52, 53)]
    empty = annotations.merged_rows({k: v.limit(0) for k, v in side([1]).items()}, side([4]))
    assert empty["documents"].collect()[0].id == 1
    bad = side([2]) | {"relations": spark.createDataFrame([(20, 77)], "a long, b long")}
    with pytest.raises(Exception, match="unknown 77"):
        annotations.merged_rows(side([1]), bad)["relations"].collect()


def test_words_of_a_large_vocabulary(spark):
    names = [a + b + c for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst"]
    tok = WordTokeniser(names)
    df = spark.createDataFrame([("aaa aab zzz ttt",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(tok.encode(F.col("t")).alias("x")).collect()] == [[1, 2, 0, 8000], [], []]


def test_models_in_folders(spark, tmp_path):
    store = registry.ModelFolder(spark, str(tmp_path / "m"))
    write = lambda folder: (__import__("pathlib").Path(folder.removeprefix("file:")) / "weights").write_text("w")
    assert store.find({"a": 1}, "v1") is None
    with pytest.raises(ZeroDivisionError):
        store.commit({"a": 1}, "v1", {}, lambda folder: 1 / 0)
    assert store.find({"a": 1}, "v1") is None  # half written
    place = store.resolve({"a": 1}, "v1", lambda: ({"f1": 0.8}, write), {"f1": 0.5}, ("weights",))
    assert store.find({"a": 1}, "v1", {"f1": 0.8}) == place == store.resolve({"a": 1}, "v1", lambda: 1 / 0)
    assert store.find({"a": 2}, "v1") is None and store.find({"a": 1}, "v2") is None
    assert store.find({"a": 1}, "v1", {"f1": 0.9}) is None and store.find({"a": 1}, "v1", {"recall": 0.1}) is None
    here = __import__("pathlib").Path(place.removeprefix("file:"))
    (here / "weights").rename(here / "gone")
    assert store.find({"a": 1}, "v1") is None
    (here / "gone").rename(here / "weights")
    for text in ('{"fingerprint": "other", "data_version": "v1", "metrics": {}, "files": []}', "{", "[]"):
        (here / ".manifest.json.crc").unlink(missing_ok=True)
        (here / "manifest.json").write_text(text)
        assert store.find({"a": 1}, "v1") is None
    assert store.refused == ["no manifest", "no manifest", "no manifest", "no manifest", "data version v1", "f1 is 0.8", "recall is None", "missing weights", "other settings", "unreadable manifest", "unreadable manifest"]
    assert store.resolve({"a": 1}, "v2", lambda: ({"f1": 0.7}, write)) == place and store.find({"a": 1}, "v2") == place
