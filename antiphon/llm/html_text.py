"""Main text of web pages by a maximum-scoring subsequence.

A page is a row of tokens: words score by where they stand (plain, in a heading, in a list, in a link, outside
the article on a page that has one), tags score below zero.  The weights are log odds of lying inside the
article, counted by Spark on a bounded sample of pages that label their own article by its element; words'
weights are kept above zero inside articles and tags' below.  One linear scan finds the contiguous region
with the highest sum, which is then widened to whole blocks.

Elements that are no main text wherever they stand (menus, forms, adverts, notices, reader comments, ...) are
left out first: their tag, role, and class and id tokens have weights, too, and an element goes when they sum
to OUT or less.  Those weights are the log odds counted on the sample, at most PRIOR for names that say so
themselves (whole tokens made of known parts only: ``cookie-notice``, not ``has-sidebar``).  An element that
holds an article never goes, nor does a form, or one that goes by counted weights, with half of the page's
words in it.  Attribute values are never taken for names.  Elements with a ``hidden`` attribute or
``display: none`` go.  A block's links score as the rest of it, if that is a sixth of its words or if it
stands in an article and in no list.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one
line break in page order; nothing else is dropped or cut, whatever the length of tags or attributes.  A null
or empty page, or one without a region above zero, gives the empty string.  Elements that are never closed
end with their parent or at the next block, an open head at the body or its first block or text; scripts,
styles, text areas and comments, whose content is no markup, run to the end of the page.  A tag whose quotes
leave it open to the end of the page ends at its first ``>``; without one it is text.  Every step is linear
in the page.  Repeated rows get equal texts; an empty table gives no rows; other columns pass through (one
called as the result is replaced).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: About so many pages are sampled for the weights, none over SAMPLE_BYTES, and at most NAMES weights come of it.
TRAIN_PAGES, SAMPLE_BYTES, NAMES = 400, 1 << 20, 20_000

#: A tag whose quoted values hold no angle brackets, and the pieces of any other.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=`]++))?+)*+\s*+/?)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_GAP, _NAME, _EQUALS, _BARE = re.compile(r"[\s/]*+"), re.compile(r"=?[^\s/>=]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?")
_RAW_START = re.compile(r"<(?:script|style|textarea)\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in ("script", "style", "textarea")}
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Tags, roles and parts of class and id tokens that say themselves that they hold no main text,
# parts that say so outside an article, and parts that say nothing.
OUT_TAGS = frozenset("nav footer aside form button select dialog menu".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
OUT_PARTS = frozenset("ad ads adv advert adverts advertisement advertising banner comment comments commentlist cookie cookies consent notice notices notification sidebar menu nav navbar navigation breadcrumb breadcrumbs reply replies disqus promo promotion sponsor sponsored newsletter subscribe popup modal overlay share sharing social related footer toolbar widget".split())
HEAD_PARTS = frozenset("header masthead topbar".split())
FILL_PARTS = frozenset("site page main top bottom left right list area box block bar link links post posts section container wrapper wrap inner outer body content item items button buttons icon icons text title form thread group signup global primary secondary".split())
#: The weight of such a name, and the sum from which an element goes.
PRIOR, OUT = -2.0, -1.0
_PART = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
KEEP = frozenset("html body main".split())
#: Elements that are left out before anything else is read, as the head is.
INERT = frozenset("noscript template svg iframe".split())


@lru_cache(1 << 16)
def _prior(name: str, inside: bool) -> float:
    kind, value = name[0], name[1:]
    if kind == "<":
        return PRIOR if value in OUT_TAGS or (value == "header" and not inside) else 0.0
    if kind == "@":
        return PRIOR if value in OUT_ROLES else 0.0
    parts = [p.lower() for p in _PART.split(value) if p]
    said = OUT_PARTS if inside else OUT_PARTS | HEAD_PARTS
    return PRIOR if any(p in said for p in parts) and all(p in said or p in FILL_PARTS or p[0].isdigit() for p in parts) else 0.0


@lru_cache(1 << 14)
def _named(tag: str, attrs: str | tuple[tuple[str, str], ...]) -> tuple[tuple[str, ...], bool]:
    """The names of an element (tag, roles, class and id tokens), and whether it is hidden."""
    names, hidden = ["<" + tag], False
    for name, value in _ATTR.findall(attrs) if isinstance(attrs, str) else attrs:
        name = name.lower()
        if isinstance(attrs, str) and value[:1] in "\"'":
            value = value[1:-1]
        if name == "hidden":
            hidden = True
        elif name == "role":
            names += ["@" + v for v in value.lower().split()]
        elif name in ("class", "id"):
            names += ["." + v for v in value.split()]
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return tuple(dict.fromkeys(names)), hidden


def _verdict(tag: str, attrs, inside: bool, weights: dict[str, float]) -> str:
    """Whether an element stays (""), goes if it is not most of the page ("perhaps"), or goes ("out")."""
    if tag in KEEP:
        return ""
    names, hidden = _named(tag, attrs)
    if hidden:
        return "out"
    prior = [_prior(n, inside) for n in names]
    if sum(prior) <= OUT:
        return "perhaps" if tag == "form" and not any(prior[1:]) else "out"
    if tag == "article" or inside:
        return ""
    return "perhaps" if sum(min(p, weights.get(n, 0.0)) for n, p in zip(names, prior) if n[0] != "<") <= OUT else ""


def _scan(page: str) -> list[tuple[str, str, object]]:
    """("open" or "close", tag, attributes) or ("text", text, "") in page order; comments and raw elements are gone."""
    raw: list[tuple[str, str, object]] = []
    n, last, at, doomed = len(page), page.rfind(">"), 0, set()
    quotes = {q: page.rfind(q) for q in "\"'"}
    text: list[str] = []

    def attributes(i: int) -> tuple[tuple[tuple[str, str], ...], int] | None:
        """The attributes from ``i`` on and where their tag ends; None if that is never."""
        found, seen = [], []
        while True:
            i = _GAP.match(page, i).end()
            if i > last or i in doomed:
                doomed.update(seen)
                return None
            if page[i] == ">":
                return tuple(found), i + 1
            seen.append(i)
            m = _NAME.match(page, i)
            name, i = m[0], m.end()
            value = ""
            if e := _EQUALS.match(page, i):
                i = e.end()
                if (q := page[i : i + 1]) and q in "\"'":
                    j = page.find(q, i + 1) if quotes[q] > i else -1
                    if j < 0:
                        doomed.update(seen)
                        return None
                    value, i = page[i + 1 : j], j + 1
                else:
                    m = _BARE.match(page, i)
                    value, i = m[0], m.end()
            found.append((name, value))

    while at < n:
        i = page.find("<", at)
        if i < 0:
            break
        if i > at:
            text.append(page[at:i])
        nxt = page[i + 1 : i + 2]
        if nxt in ("!", "?") and nxt:
            if page.startswith("<!--", i):
                j = page.find("-->", i + 4)
                at = n if j < 0 else j + 3
            else:
                if i > last:
                    text.append("<")
                at = i + 1 if i > last else page.find(">", i) + 1
            continue
        if i > last:  # no tag ends from here on
            if _RAW_START.match(page, i):
                break
            text.append("<")
            at = i + 1
            continue
        m = _TAG.match(page, i)
        if m:
            closing, tag, attrs, end = m[1], m[2].lower(), m[3], m.end()
        else:
            m = _TAG_NAME.match(page, i)
            if not m:
                text.append("<")
                at = i + 1
                continue
            closing, tag = m[1], m[2].lower()
            got = attributes(m.end())
            attrs, end = got if got else ((), page.find(">", m.end()) + 1)
        if text:
            raw.append(("text", "".join(text), ""))
            text.clear()
        if not closing and tag in _RAW_END:
            m = _RAW_END[tag].search(page, end)
            at = n if m is None else m.end()
            continue
        raw.append(("close" if closing else "open", tag, attrs))
        at = end
    if at < n and page.find("<", at) < 0:
        text.append(page[at:])
    if text:
        raw.append(("text", "".join(text), ""))
    return raw


def _without_inert(raw: list[tuple[str, str, object]]) -> list[tuple[str, str, object]]:
    """``raw`` without the head and INERT elements; those never closed end before the next block."""
    n, ends, open_at = len(raw), {}, {}
    for i, (kind, tag, attrs) in enumerate(raw):
        if tag in INERT and kind == "open":
            if tag == "svg" and (attrs.endswith("/") if isinstance(attrs, str) else not attrs):
                ends[i] = i + 1
            else:
                open_at.setdefault(tag, []).append(i)
        elif kind == "close" and open_at.get(tag):
            ends[open_at[tag].pop()] = i + 1
    block = lambda i: raw[i][0] != "text" and raw[i][1] in BLOCKS and raw[i][1] != "title"

    def end(i: int) -> int:
        if i in ends:
            return ends[i]
        i += 1
        while i < n and not block(i):
            i += 1
        return i

    out, i = [], 0
    while i < n:
        kind, tag, _ = raw[i]
        if kind == "open" and tag in INERT:
            i = end(i)
        elif kind == "open" and tag == "head":
            title, text, i = False, -1, i + 1
            while i < n and not block(i):
                kind, tag, _ = raw[i]
                if (kind, tag) == ("close", "head"):
                    break
                if kind == "open" and tag in INERT:
                    i = end(i)
                    continue
                if kind == "text":
                    text = i if text < 0 and not title and tag.strip() else text
                elif tag == "title":
                    title = kind == "open"
                i += 1
            if i < n and raw[i][1] == "head":
                i += 1
            elif text >= 0 and not (i < n and raw[i][:2] == ("open", "body")):
                i = text
        else:
            out.append(raw[i])
            i += 1
    return out


def _closes(raw: list[tuple[str, str, object]]) -> dict[int, int]:
    """Where each element that closes does so: elements of one name nest."""
    open_at: dict[str, list[int]] = {}
    ends = {}
    for i, (kind, tag, _) in enumerate(raw):
        if kind == "open":
            open_at.setdefault(tag, []).append(i)
        elif kind == "close" and open_at.get(tag):
            ends[open_at[tag].pop()] = i
    return ends


def _next(raw: list[tuple[str, str, object]], wanted) -> list[int]:
    """For each place the first place from there on whose token is wanted; the row's length without one."""
    out = [len(raw)] * (len(raw) + 1)
    for i in range(len(raw) - 1, -1, -1):
        out[i] = i if wanted(*raw[i][:2]) else out[i + 1]
    return out


def _sums(values: list[int]) -> list[int]:
    out = [0]
    for v in values:
        out.append(out[-1] + v)
    return out


def _parsed(page: str) -> tuple[list[tuple[str, str, object]], dict[int, int], list[int], list[int]]:
    """Tokens, where elements close, and sums of words and of articles before each token."""
    raw = _without_inert(_scan(page))
    words = _sums([len(tag.split()) if kind == "text" else 0 for kind, tag, _ in raw])
    articles = _sums([int(kind == "open" and (tag == "main" or tag == "article" and not _verdict(tag, attrs, True, {}))) for kind, tag, attrs in raw])
    return raw, _closes(raw), words, articles


def tokens(page: str, weights: dict[str, float] | None = None, parsed=None) -> list[tuple[str, str, bool]]:
    """(kind, text, inside the article): kinds are "<tag" for tags, "#context" for text, "!" for what is left out."""
    weights = weights or {}
    raw, ends, words, articles = parsed or _parsed(page)
    block, article = _next(raw, lambda kind, tag: kind != "text" and tag in BLOCKS), _next(raw, lambda kind, tag: kind == "open" and tag in ("article", "main"))
    labelled = articles[-1] > 0
    out: list[tuple[str, str, bool]] = []
    linked: list[int] = []  # the current block's links, by number, and its words in them and beside them
    in_link = beside = 0
    inside, link, item, head = 0, 0, 0, 0

    def where() -> str:
        return "#outer" if labelled and not inside else "#head" if head else "#item" if item else "#text"

    def end_block() -> None:
        nonlocal in_link, beside
        if linked:
            plain = 6 * beside >= in_link + beside
            for k, kind, listed in linked:
                if plain or (kind != "#outer" and labelled and not listed):
                    out[k] = (kind, *out[k][1:])
        linked.clear()
        in_link = beside = 0

    i, n = 0, len(raw)
    while i < n:
        kind, tag, attrs = raw[i]
        if kind == "text":
            m = words[i + 1] - words[i]
            if link:
                linked.append((len(out), where(), item > 0))
                in_link += m
            else:
                beside += m
            out.append(("#link" if link else where(), tag, inside > 0))
            i += 1
            continue
        if tag in BLOCKS:
            end_block()
        if kind == "open" and tag not in VOID:
            to = ends.get(i, n)
            verdict = _verdict(tag, attrs, inside > 0, weights)
            if verdict and i in ends and articles[to] > articles[i + (tag == "article")]:
                verdict = ""  # holds an article
            if verdict == "perhaps" and 2 * (words[to] - words[i]) >= words[-1]:
                verdict = ""
            if verdict:
                end_block()
                out.append(("!", "", inside > 0))
                if i in ends:
                    i = ends[i] + 1
                else:  # never closed: up to an article further on, else its own text only, up to the next block
                    i = article[i + 1] if article[i + 1] < n else block[i + 1]
                continue
        step = 1 if kind == "open" else -1
        if tag in ("article", "main"):
            inside = max(0, inside + step)
        elif tag == "a":
            link = 1 if step > 0 else 0
        elif tag == "li":
            item, link = max(0, item + step), 0
        elif tag in ("ul", "ol", "p", "div", "section"):
            link = 0
            if tag in ("ul", "ol") and step < 0:
                item = 0
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            head, link = max(0, step), 0
        out.append(("<" + tag, "", inside > 0 or (tag in ("article", "main") and step < 0)))
        i += 1
    end_block()
    return out


DEFAULT = {"#text": 1.0, "#head": 0.6, "#item": 0.3, "#link": -0.8, "#outer": -0.5}
TAG_DEFAULT = -0.3
LEAST = 0.05


def counts(page: str) -> Counter:
    """(kind or name, inside) -> words (tags: how many) on a page with one article element."""
    out: Counter = Counter()
    if len(re.findall(r"(?i)<article[\s>]", page)) != 1:
        return out
    raw, ends, words, articles = parsed = _parsed(page)
    for kind, text, inside in tokens(page, None, parsed):
        if kind != "!":
            kind = "#text" if kind == "#outer" else kind
            out[kind, inside] += len(text.split()) if kind[0] == "#" else 1
    own, depth = [], 0
    for kind, tag, _ in raw:
        if tag == "article":
            depth = max(0, depth + (1 if kind == "open" else -1))
        own.append(len(tag.split()) if kind == "text" and depth else 0)
    own = _sums(own)
    for i, to in ends.items():
        kept = own[to] - own[i]
        for name in _named(raw[i][1], raw[i][2])[0]:
            if name[0] != "<":
                out[name, True] += kept
                out[name, False] += words[to] - words[i] - kept
    return out


def learn(counted: Counter) -> dict[str, float]:
    """Weights by token kind and name from counts inside and outside articles; without any, the defaults."""
    kinds = {k for k, _ in counted}
    n, m = (sum(v for (k, i), v in counted.items() if i == inside and k[0] in "#<") + 1.0 for inside in (True, False))
    weights = {}
    for kind in sorted(kinds) if n > 1 else ():
        inner, outer = counted[kind, True], counted[kind, False]
        if inner + outer < 5:
            continue
        odds = max(-2.0, min(2.0, math.log(((inner + 0.5) / n) / ((outer + 0.5) / m))))
        if kind in ("#text", "#head", "#item"):
            weights[kind] = max(4 * LEAST, odds)
        elif kind == "#link":
            weights[kind] = max(-1.0, min(-LEAST, odds))
        elif kind[0] == "<":
            weights[kind] = min(-LEAST, odds / 2)
        else:
            weights[kind] = odds
    return weights


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The text of the maximum-scoring region."""
    if not page:
        return ""
    row = tokens(page, weights)
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, text, _) in enumerate(row):
        if kind == "!":
            continue
        if kind[0] == "#":
            run += len(text.split()) * weights.get(kind, DEFAULT[kind])
        else:
            run += weights.get(kind, TAG_DEFAULT)
        if run <= 0:
            run, start = 0.0, i + 1
        elif run >= best:
            best, best_at = run, (start, i + 1)
    lo, hi = best_at
    inner = lambda k: k[0] == "#" and k != "#outer" or k[0] == "<" and k[1:] not in BLOCKS
    while 0 < lo < hi and inner(row[lo - 1][0]):  # whole blocks
        lo -= 1
    while lo < hi < len(row) and inner(row[hi][0]):
        hi += 1
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()

    for kind, text, _ in row[lo:hi]:
        if kind[0] == "#":
            now.append(text)
        elif kind == "<br":
            now.append(" ")
        elif kind == "!" or kind[1:] in BLOCKS:
            close()
    close()
    return "\n".join(blocks)


def train(pages: DataFrame, html_col: str = "html", sample: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from about ``sample`` pages that hold one article element, picked by a hash of the page.

    Executors count; at most NAMES kinds and names, the commonest, reach the driver."""
    labelled = pages.select(F.col(html_col).cast("string").alias("html")).filter(F.col("html").rlike(r"(?i)<article[\s>]") & (F.octet_length("html") <= SAMPLE_BYTES))
    n = labelled.count()
    if not n:
        return {}
    share = max(1, n // sample)
    some = labelled.filter(F.pmod(F.xxhash64("html"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter = Counter()
            for page in b.column(0):
                total.update(counts(page.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["kind", "inside", "n"])

    found = some.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    got = found.filter("a + b >= 5").orderBy(F.desc(F.col("a") + F.col("b")), "kind").limit(NAMES).collect()
    return learn(Counter({(r.kind, i): v for r in got for i, v in ((True, r.a), (False, r.b))}))


def main_text(page: Column, weights: dict[str, float]) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([extract(p, weights) for p in b.tolist()], dtype=object)

    return run(page.cast("string"))


def with_main_text(pages: DataFrame, weights: dict[str, float] | None = None, html_col: str = "html", as_col: str = "_main_text") -> DataFrame:
    small_batches(pages.sparkSession)
    weights = train(pages, html_col) if weights is None else weights
    return pages.withColumn(as_col, main_text(F.col(html_col), weights))
