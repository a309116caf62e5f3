import datetime as dt
import json
import zipfile

import pytest

from antiphon.config import Cache
from antiphon.errors import DatasetError
from antiphon.schemas import DOCUMENT
from antiphon.sources import tables, web


def test_splits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, 'say "hi",\nthere', [0.5], ("training", "validation")[i % 2]) for i in range(10)], "id int, text string, v array<double>, split string")
    tables.write_splits(df, str(tmp_path / "p"))
    got = tables.split_scan(spark, str(tmp_path / "p"), "training")
    assert got.count() == 5 and got.columns == ["id", "text", "v"]
    assert tables.split_scan(spark, str(tmp_path / "p"), "training", 3).count() == 3
    assert tables.split_scan(spark, str(tmp_path / "p"), "training", None).count() == 5
    tables.write_split_csv(df, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), "id int, text string, split string")
    assert back.count() == 10 and back.first().text == 'say "hi",\nthere'
    for folder, split in ((str(tmp_path / "nowhere"), "training"), (str(tmp_path / "p"), "other")):
        with pytest.raises(DatasetError):
            tables.split_scan(spark, folder, split)
    tables.clear(str(tmp_path / "p"))
    assert not (tmp_path / "p").exists()


ESSAY = "essay_id_comp,discourse_type,discourse_text,discourse_start,extra\n1,Claim,\"a, b\nc\",0,x\n"


def test_essays(spark, tmp_path):
    (tmp_path / "e.csv").write_text(ESSAY)
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("in/e2.csv", ESSAY)
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.txt", "x")
    for name in ("e.csv", "e.zip"):
        r = tables.essays(spark, str(tmp_path / name)).first()
        assert (r.discourse_text, r.discourse_start) == ("a, b\nc", 0.0)
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    for name in ("none.zip", "bad.csv", "missing.csv"):
        with pytest.raises(DatasetError):
            tables.essays(spark, str(tmp_path / name))


def test_frame_corpora(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("text,label\nhello,3\n,4\n")
    assert tables.frame_corpora(spark, str(a), str(b)) == {}
    b.write_text("text,label\nbye,1\n")
    got = tables.frame_corpora(spark, str(a), str(b))
    assert got["training"].columns == ["text", "interpretative_frame"] and got["training"].count() == 1


def test_supported_claims(spark):
    df = spark.createDataFrame([("SUPPORTS", "h1", "p1"), ("REFUTES", "h2", "p2"), ("supports", "h3", "p3")], "label string, hypothesis string, premise string")
    assert sorted(r.claim for r in tables.supported_claims(df).collect()) == ["h1", "h3"] and tables.supported_claims(df, 1).count() == 1


def test_golden_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.golden(spark, str(tmp_path / "no"))
    file = tmp_path / "argument-annotations.json"
    with pytest.raises(FileNotFoundError):
        tables.golden(spark, str(tmp_path))
    file.write_text(json.dumps({"documents": [{"id": 1, "title": "t", "text": "x"}], "arguments": [], "relations": []}))
    with pytest.raises(NotADirectoryError):
        tables.golden(spark, str(file))
    g = tables.golden(spark, str(tmp_path))
    assert g.first().version == "1"
    tables.write_golden(g, str(file))
    assert tables.golden(spark, str(tmp_path)).first().documents[0].title == "t"


def test_results(tmp_path):
    at = dt.datetime(2024, 5, 6, 7, 8, 9)
    old = tables.write_result(str(tmp_path), {"iou": 1.0}, {"k": 1}, at, at, "1")
    new = tables.write_result(str(tmp_path), {"iou": 0.5}, {"k": 1}, at, at + dt.timedelta(days=1), "1")
    assert tables.latest_result(str(tmp_path)) == new != old
    data = json.loads(new.read_text())
    assert data["metadata"]["duration"] == 86400 and data["metrics"]["iou"] == 0.5
    assert tables.latest_result(str(tmp_path / "none")) is None


def test_landing_skips_what_is_there(tmp_path):
    asked = []
    fetch = lambda u: asked.append(u) or b"data"
    for _ in range(2):
        tables.land(["http://x.org/d/a.csv?x=1"], str(tmp_path), fetch)
    (tmp_path / "a.csv").write_bytes(b"")
    tables.land(["http://x.org/d/a.csv"], str(tmp_path), fetch)
    assert len(asked) == 2 and (tmp_path / "a.csv").read_bytes() == b"data"


def cached(spark, key, texts):
    doc = lambda t: ("u", t, "t", "s", "q", None, 200, "text/html", "en")
    return spark.createDataFrame([(key, [doc(t) for t in texts])], f"key string, docs array<{DOCUMENT.simpleString()}>")


def test_cache(spark, tmp_path):
    cache = web.CacheTable(spark, Cache(ttl_seconds=10), str(tmp_path / "c"))
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert cache.get(keys, 0).count() == 0
    cache.set(cached(spark, "a", ["old"]), 100)
    cache.set(cached(spark, "a", ["new", "two"]), 105)
    cache.set(cached(spark, "b", []), 105)
    got = {r.key: [d.text for d in r.docs] for r in cache.get(keys, 114).collect()}
    assert got == {"a": ["new", "two"], "b": []}
    assert cache.get(keys, 115).count() == 0
    cache.clear()
    assert cache.get(keys, 106).count() == 0
    off = web.CacheTable(spark, Cache(enabled=False), str(tmp_path / "off"))
    off.set(cached(spark, "a", ["x"]))
    assert off.get(keys).count() == 0


def test_search_and_downloads(spark):
    q = spark.createDataFrame([(1, "cats dogs"), (2, " "), (3, None)], "doc_id int, normalized string")
    corpus = spark.createDataFrame([("u1", "dogs bark"), ("u2", "cats and dogs"), ("u3", "fish")], "url string, text string")
    got = web.keyword_results(q, corpus, 5)
    assert [(r.doc_id, r.rank, r.url, r.shared) for r in got.orderBy("rank").collect()] == [(1, 0, "u2", 2), (1, 1, "u1", 1)]
    pages = spark.createDataFrame([("u1", "<p>x</p>")], "url string, html string")
    assert {r.url: r.html for r in web.download(got, pages).collect()} == {"u1": "<p>x</p>", "u2": ""}
    assert web.download_present(got, pages).count() == 1
    assert {r.url: (r.title, r.snippet) for r in web.local_results(corpus).collect()}["u3"] == ("fish", "fish")

    def get(url):
        if url == "u2":
            raise OSError("gone")
        return "page"

    assert {r.url: r.html for r in web.fetch(got, get, 2).collect()} == {"u1": "page", "u2": ""}
