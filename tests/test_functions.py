import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from antiphon.config import Cleaning
from antiphon.functions import counting, html, style, text, vectors, readable
from antiphon.operators import filters, framing


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_strip_takes_unicode_white_space(spark):
    assert one(spark, "\t\u00a0 a\u00a0b \x1c\u2003", text.strip) == "a\u00a0b"
    assert one(spark, " a \n\u00a0 b ", text.collapse) == "a b"


def test_sentences(spark):
    assert one(spark, "One two. Three 3.14 four!  Five", text.sentences) == ["One two.", "Three 3.14 four!", "Five"]
    assert one(spark, "", text.sentences) == [] and one(spark, None, text.sentences) == []
    assert one(spark, 'He said "no." Then', text.sentences) == ['He said "no."', "Then"]


def test_tokens_and_ngrams(spark):
    assert one(spark, "An été b2b THE x the_end", text.tokens) == ["an", "the"]
    grams = lambda n: one(spark, "aa bb cc", lambda c: text.ngrams(text.tokens(c), n))
    assert grams(2) == ["aa bb", "bb cc"] and grams(3) == ["aa bb cc"] and grams(4) == []


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a\r\nb", "a b\n"),
        ("a\n    b", "a\n\nb\n"),
        ("a\n\n\n\nb  c", "a\n\nb c\n"),
        ("so [1, 2] it", "so it\n".replace("so it", "so  it")),
        ("claim.4 Next", "claim. Next\n"),
        ("pi is 3.14 ok", "pi is 3.14 ok\n"),
        ("claim4.", "claim.\n"),
    ],
)
def test_corpus_normalise(spark, raw, want):
    assert one(spark, raw, text.corpus_normalise) == want


@settings(max_examples=15, deadline=None)
@given(raw=st.text(alphabet="ab .\n\t", max_size=30))
def test_collapse_is_idempotent(spark, raw):
    once = one(spark, raw, text.collapse)
    assert one(spark, once, text.collapse) == once


def test_trailer(spark):
    r = one(spark, "body text\n\nsource: http://x.org/a\n", text.split_trailer)
    assert (r.body, r.source) == ("body text", "http://x.org/a")


def test_vectors(spark):
    f = lambda g, a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(g(F.col("a"), F.col("b")).alias("y")).first().y
    assert f(vectors.cosine, [1.0, 0.0], [1.0, 1.0]) == pytest.approx(2**-0.5)
    assert one(spark, [0.0, 0.0], vectors.unit, "array<double>") is None
    p = one(spark, [1000.0, 1000.0], vectors.softmax, "array<double>")
    assert p == [0.5, 0.5]
    assert one(spark, [1.0, 3.0, 3.0], vectors.argmax, "array<double>") == 1
    assert one(spark, 1, lambda c: vectors.one_hot(c, 3), "int") == [0.0, 1.0, 0.0]
    assert math.isnan(one(spark, float("nan"), vectors.clip, "double")) and one(spark, 3.0, vectors.clip, "double") == 1.0


@pytest.mark.parametrize(("result", "want"), [(1, 0.3), (-1, 1.0), (0, 0.3 + 0.7 * 0.4)])
def test_expected_distance(spark, result, want):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], result, 0.4)], "a array<double>, b array<double>, r int, t double")
    assert df.select(vectors.expected_distance(*map(F.col, "abrt")).alias("y")).first().y == pytest.approx(want)


def test_expected_distance_of_zero_vectors(spark):
    df = spark.createDataFrame([([0.0], [0.0], 1)], "a array<double>, b array<double>, r int")
    assert df.select(vectors.expected_distance(F.col("a"), F.col("b"), F.col("r"), F.lit(0.0)).alias("y")).first().y == pytest.approx(0.3)


LONG = "word " * 40


@pytest.mark.parametrize(
    ("page", "text_out", "reason"),
    [
        (f"<title>T</title><article><p>{LONG}</p></article><p>out</p>", LONG.strip(), None),
        (f"<p>{LONG}</p><p>Please SUBSCRIBE now</p><p>https://x.org/a</p><p>function f()</p><p>var x = 1</p><p>{{json}}</p>", LONG.strip(), None),
        (f"<p>{LONG} 404 Not Found</p>", "", "unwanted keyword"),
        ("<p>short</p>", "", "too short"),
        ("<p>" + "x" * 149 + "</p>", "", "too short"),
        ("<p>" + "x" * 150 + "</p>", "", "too few words"),
        ("<p>" + " ".join(["abcdef"] * 29) + "</p>", "", "too few words"),
        (f"<form>{LONG}</form><svg>{LONG}</svg><noscript>{LONG}</noscript>", "", "too short"),
        ("<p>" + "y" * 50_001 + " a" * 40 + "</p>", "", "too few words"),
        ("", "", "too short"),
        (None, "", "too short"),
    ],
)
def test_cleaner(spark, page, text_out, reason):
    c = Cleaning()
    r = one(spark, page, lambda p: html.verdict(html.clean_text(p, c), c))
    assert (r.text, r.reason) == (text_out, reason)


def test_cleaner_decodes(spark):
    assert one(spark, "<p>a &lt;b&gt; &amp;amp; c</p>", lambda p: html.clean_text(p, Cleaning())) == "a <b> &amp; c"


def test_style_vector(spark):
    s = "The cat sat on the mat. A dog was running quickly, and 3 birds watched beautiful Paris."
    df = style.with_counts(spark.createDataFrame([(s,), ("",), ("...",)], "text string"), "text")
    got = df.select(style.vector(F.col("_style")).alias("v"), style.checked(F.col("_style"), F.col("text")).alias("e")).collect()
    assert len(got[0].v) == 18 and all(0 <= x <= 1 for x in got[0].v) and got[0].e is None
    assert [r.v for r in got[1:]] == [None, None] and [r.e for r in got[1:]] == ["empty text", "no words"]
    again = df.select(style.vector(F.col("_style")).alias("v")).first().v
    assert again == got[0].v


def test_positivity(spark):
    df = spark.createDataFrame([("positive", 0.9), ("neutral", 0.8), ("negative", 0.7)], "s string, c double")
    assert [round(r.y, 3) for r in df.select(style.positivity(F.col("s"), F.col("c")).alias("y")).collect()] == [0.9, 0.4, 0.0]


def test_sanitise(spark):
    assert one(spark, "  ab cd ", lambda c: filters.sanitise(c, 3)) == "ab "
    for bad in ("", " \u00a0 ", None):
        with pytest.raises(PySparkException):
            one(spark, bad, filters.sanitise)


@pytest.mark.parametrize(("label", "want"), [("neutral", 0), (" Entailment ", 1), ("CONTRADICTION", -1)])
def test_inference_labels(spark, label, want):
    assert one(spark, label, filters.inference_label) == want


@pytest.mark.parametrize("label", ["", "maybe", "entail", None])
def test_unknown_inference_labels(spark, label):
    with pytest.raises(PySparkException):
        one(spark, label, filters.inference_label)


def test_framing(spark):
    got = framing.assign(spark.createDataFrame([("some text here",), ("",)], "text string"), F.col("text")).collect()
    for r in got:
        assert len(r.frame_probabilities) == 15 and sum(r.frame_probabilities.values()) == pytest.approx(1, abs=1e-5)
    assert got[1].primary_frame == "Economic"
    assert one(spark, '{"Other": 0.5}', lambda c: framing.probabilities(framing.parsed(c)))[-1] == 0.5
    assert one(spark, None, lambda c: framing.probabilities(framing.parsed(c))) == [0.0] * 15


PARAGRAPHS = "<h1>A title of its own</h1><p>First para, of some words, that run on for a while so that it counts.<p>Second <b>para</b> with more <a href=/x>words</a>, and more words than that, all in one line.</p><p>Short one.</p>"
LINES = "A title of its own\nFirst para, of some words, that run on for a while so that it counts.\nSecond para with more words, and more words than that, all in one line.\nShort one."
SITE = "<html><head><title>t</title></head><body><nav><ul><li><a href=/a>One</a></li></ul></nav>{}<div class='sidebar'><p>Other things to read, that are long enough to count as text.</p></div><ul>" + "<li><a href=/y>A long link to another page of the site, with commas, too</a></li>" * 9 + "</ul><footer>All rights, of all kinds, are reserved by those who reserve them</footer></body></html>"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>", "<div class='content'><div>{}</div></div>", "<div class='has-sidebar'><main>{}</main></div>", "<form><article>{}</article></form>", "<div class=nav><article>{}</article></div>", "<table><tr><td>{}</td></tr></table>"])
def test_readable_content(wrap):
    assert readable.content(SITE.format(wrap.format(PARAGRAPHS))) == LINES


def test_readable_decodes_whole_references_alone():
    pages = ["<article><h1>and&amp</h1><p>a &lt; b &amp;&amp;&amp &notit; &#38; &#x26 &ampamp; & &amp;lt; &lt</p></article>", "<p>end &amp", "<p title='x &copy y'>&nosuch; &copy;</p>"]
    assert [readable.content(p) for p in pages] == ["and&amp\na < b &&&amp &notit; & &#x26 &ampamp; & &lt; &lt", "end &amp", "&nosuch; ©"]


def test_readable_content_of_odd_pages(spark):
    pages = [None, "", " ", "<p>", "plain text only", "<p>Hello big world", "<nav>menu</nav>", "a &lt; b <!-- never closed <p>gone", "<p>x &amp; y</p><script>no</script>", "<div><a href=/>only a link</a></div>", "<p>end <b"]
    want = ["", "", "", "", "plain text only", "Hello big world", "", "a < b", "x & y", "", "end <b"]
    assert [readable.content(p) for p in pages] == want
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").withColumn("t", readable.readable(F.col("p"))).orderBy("i").collect()
    assert [r.t for r in got] == want


def test_counts_of_odd_texts_equal_the_twin(spark, tmp_path):
    import duckdb

    from antiphon.plans import catalog, catalog_sql

    rng = np.random.default_rng(5)
    bits = ["İstanbul", "FAİL", "İ", "a", "Good", "bad_", "sing", "ing", "xyzable", "able", "ible", "famous", "ßen", "Élan", "été", "DŽ", "Dž", "42", "٣", "x1", "_", "rhythm", "queueing", "areaea", "Kelvin", "⺿0", "́"]
    bits += ["\U0001f600", "\U0002ebf0", ".", "!?", "...", '"', ")", "]'", ".)", '?")', ",", "-", "\x1f", "\x1f\x1f", "\n", "\t", "\x0b", "\u00a0", "\x85", "\u2028", " ", "  ", " ", " ", " "]
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(600)] + [None, "", " ", ".", ". ", " .", "\x1f", "aeb" * 300, ")" * 5000 + " A", "." + ")" * 5000 + " A b", "no end", "End. ", "A.\x1f B"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("style_features", "frame_predict"):
        got, want = (df.sort_values("doc_id").reset_index(drop=True) for df in (catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(catalog_sql.ORACLE_SQL[name]).df()))
        pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False, rtol=0, atol=1.1e-6)


def test_words_meet_across_pieces(monkeypatch):
    texts = pa.array(["Good dogs. (Bad) cats", None, "x" * 30, "", "e. A\nE"])
    whole = [c.tolist() for t in counting.pieces(texts) for c in style._counts(t)]
    monkeypatch.setattr(counting, "PIECE", 5)
    parts = [style._counts(t) for t in counting.pieces(texts)]
    assert len(parts) > 2 and [[n for p in parts for n in p[i].tolist()] for i in range(len(whole))] == whole
