import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from antiphon import config
from antiphon.errors import ConfigurationError
from antiphon.operators import framing
from antiphon.plans import benchmark, registry, retrieval, training
from antiphon.plans.pipeline import Counterarguments, Stages
from antiphon.schemas import ANNOTATIONS
from antiphon.sources import web
from antiphon.streaming import clean

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa. alpha beta gamma delta epsilon zeta eta theta other words. {} beta gamma delta epsilon zeta eta theta iota kappa lamda."


def test_settings(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('seed = 7\n[keywords]\ntop_k = 3\nstop_words = ["the"]\n')
    s = config.load(file)
    assert (s.seed, s.keywords.top_k, s.keywords.stop_words) == (7, 3, ("the",))
    for bad in ("seed = ", "unknown = 1", "[keywords]\nmin_n = 5\nmax_n = 2", "[encoder]\nlayers = [4]", "[encoder]\ndevice = 'tpu'", "keywords = 3", "max_candidates = 0"):
        file.write_text(bad)
        with pytest.raises(ConfigurationError):
            config.load(file)
    with pytest.raises(ConfigurationError):
        config.load(tmp_path / "missing.toml")


def test_fingerprints_and_names(tmp_path):
    assert config.fingerprint({"a": 1, "b": 2}) == config.fingerprint({"b": 2, "a": 1}) != config.fingerprint({"a": 1})
    assert config.differences({"x": 1.0, "y": 1}, {"x": 1.0 + 1e-13, "y": 2}) == ["y"]
    assert config.path_name("a b-c") == "a_b_c" and config.encoder_file(48, 10) == "mlp_encoder_in48_out10.pkl"
    (tmp_path / "f").write_text("x")
    assert len(config.files_digest([tmp_path / "f"])) == 64


def test_registry():
    assert registry.build("framer", "hashed") is framing.hashed and "projection" in registry.names("encoder")
    with pytest.raises(ConfigurationError):
        registry.build("framer", "other")
    store: dict = {}
    models = registry.ModelStore(store.get, store.__setitem__, lambda want: (want, "hub") if want == config.fingerprint({"v": 2}) else ("other", "wrong"))
    assert models.resolve({"v": 1}, lambda: "trained") == "trained" and models.resolve({"v": 1}, lambda: 1 / 0) == "trained"
    assert models.resolve({"v": 2}, lambda: 1 / 0) == "hub" and sorted(models.found.values()) == ["hub", "store"]


def run_inputs(spark):
    refs = spark.createDataFrame([("r1", TEXT.format("first")), ("r2", "nothing to find here.")], "ref_id string, text string")
    docs = spark.createDataFrame([(r, d, TEXT.format(d)) for r in ("r1", "r2") for d in ("second", "third")], "ref_id string, doc_id string, text string")
    return refs, docs


def test_pipeline(spark):
    refs, docs = run_inputs(spark)
    one = Stages(framer=lambda t: F.array(F.lit(0.4), *[F.lit(0.6 / 14)] * 14))
    got = Counterarguments(stages=one).run(refs, docs).collect()
    assert {r.ref_id for r in got} == {"r1"} and all(r.primary_frame == "Economic" and r.counterarguments for r in got)
    assert Counterarguments(stages=one).run(refs, docs, k=1).filter("size(counterarguments) <> 1").count() == 0
    assert Counterarguments(stages=one).run(refs, docs.limit(0)).filter("size(counterarguments) <> 0").count() == 0
    small = Counterarguments(dataclasses.replace(config.Settings(), max_candidates=2), one)
    assert small.candidates(docs).groupBy("ref_id").count().filter("count <> 2").count() == 0
    a, b = (sorted(r.id for r in small.candidates(docs.repartition(n)).collect()) for n in (1, 4))
    assert a == b and json.dumps(small.config())


def test_candidates_without_self(spark):
    docs = spark.createDataFrame([("d1", "d1", TEXT.format("x")), ("d1", "d2", TEXT.format("y"))], "ref_id string, doc_id string, text string")
    p = Counterarguments()
    assert p.candidates(docs, without_self=True).count() * 2 == p.candidates(docs).count()


def test_retrieval(spark, tmp_path):
    texts = spark.createDataFrame([(1, "cats cats dogs"), (2, "nothing matches"), (3, "")], "doc_id int, text string")
    corpus = spark.createDataFrame([("u1", "cats and dogs"), ("u2", "dogs only")], "url string, text string")
    pages = spark.createDataFrame([("u1", f"<title>T</title><p>{'word ' * 40}</p>"), ("u2", "<p>short</p>")], "url string, html string")
    cache = web.CacheTable(spark, config.Cache(ttl_seconds=60), str(tmp_path / "cache"))
    r = retrieval.Retrieval(config.Settings(), cache)
    first = {x.doc_id: [d.url for d in x.docs] for x in r.search(texts, corpus, pages, now=1000).collect()}
    assert first == {1: ["u1"], 2: []}
    again = {x.doc_id: [d.url for d in x.docs] for x in r.search(texts, corpus.limit(0), pages.limit(0), now=1030).collect()}
    assert again == first  # from the cache alone
    late = {x.doc_id: len(x.docs) for x in r.search(texts, corpus.limit(0), pages, now=2000).collect()}
    assert late == {1: 0, 2: 0}
    other = retrieval.Retrieval(config.Settings(max_results=1), cache)
    assert other.scope() != r.scope()
    assert retrieval.Retrieval(config.Settings()).search(texts, corpus, pages).count() == 2


def golden(spark):
    span = lambda t: ("claim", 0, 1, t)
    docs = [(1, "a", TEXT.format("first"), None), (2, "b", TEXT.format("second"), None)]
    return spark.createDataFrame([(docs, [(1, 1, span("c1"), [span("e1")]), (2, 2, span("c2"), [span("e2")])], [(1, "contradicts", 2)], "1")], ANNOTATIONS)


def test_benchmark(spark, tmp_path):
    g = golden(spark)
    perfect = spark.createDataFrame([("c1", "e1", [("c2", "e2")]), ("c2", "e2", [("c1", "e1")])], "claim string, evidence string, counterarguments array<struct<claim:string,evidence:string>>")
    assert set(benchmark.evaluate(perfect, g).first().asDict().values()) == {1.0}
    assert set(benchmark.evaluate(perfect.limit(0), g).first().asDict().values()) == {0.0}
    out = json.loads(benchmark.run(g, str(tmp_path)).read_text())
    assert sorted(out) == ["configuration", "metadata", "metrics"] and len(out["metrics"]) == 7


def test_training_sets(spark):
    rows = [(str(e), k, f"{t} number {e % 7} said so", float(i)) for e in range(30) for i, (k, t) in enumerate([("Claim", "we claim"), ("Evidence", "proof one"), ("Evidence", "proof two")])]
    essays = spark.createDataFrame(rows, "essay_id_comp string, discourse_type string, discourse_text string, discourse_start double")
    assert training.claim_set(essays).count() == 90
    ev = training.evidence_set(essays)
    assert ev.filter("is_evidence = 1").count() == 14 and ev.filter("claim is null").count() == 0
    frames = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "text string, interpretative_frame string")
    assert {r.split: r["count"] for r in training.frame_set(frames, frames).groupBy("split").count().collect()} == {"training": 3, "validation": 1, "testing": 1}
    args = spark.createDataFrame([("we should go", "because it is late"), ("we should not go", "because it is early")], "claim string, evidence string")
    pairs = training.encoder_set(args)
    assert pairs.count() == 4 and pairs.filter("expected_distance < 0 or expected_distance > 1.00001").count() == 0
    same = pairs.filter("claim_1 = claim_2").collect()
    assert all(abs(r.expected_distance) < 1e-5 for r in same)


def test_stream(spark, tmp_path):
    page = "<title>T</title><p>" + "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda. " * 5 + "</p>"
    spark.createDataFrame([("u1", page), ("u1", page), ("u2", "<p>short</p>")], "url string, html string").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, html string, at timestamp").parquet(str(tmp_path / "in"))
    q = clean.write(clean.claims(clean.cleaned_pages(stream)), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 5 and {r.url for r in got} == {"u1"}


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2500 and entry.oracle_sql().keys() <= entry.queries().keys()
