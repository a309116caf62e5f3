"""Personal data: candidate gradient boosting beside fixed base patterns, in DataFrame operations only.

Base spans of four kinds come from fixed patterns and checks (see BASE).  Beside them, high-recall
generators propose overlapping spans (spelled-out addresses, digit groups without a plus sign, ...).
Boosted trees score each candidate by format and context, and those over the kind's calibrated threshold
that overlap no base span are added.  No table labels such spans, so the trees learn from rewritten ones:
base spans of a sample of about ``TRAIN_DOCS`` documents and ``SEEDS`` made-up ones of each kind are
written as the base patterns do not allow ([at] for @, no plus sign, other separators) in their own
context, against look-alikes of the same digits and names (failed checks, dates, amounts, number rows).
Candidates of the sample itself count only where they are surely wrong: glued to a word, of another
kind, or failing the kind's check; all others are unknown and left out.  No feature tells whether a base
pattern could match.  The trees are fitted on the driver (at most 2 x ``MAX_TRAIN`` rows a kind) and run
as one SQL expression.  A threshold is the lowest score at which held-out examples are right with at least
``PRECISION``; without such a score nothing is added.

Positions count code points, ends are exclusive.  Null and empty texts have no spans.  Rows with equal
ids are treated one by one.  An empty table gives no rows.  Other columns pass through ``redact`` untouched and clash with nothing.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

# The contract's patterns, in possessive form where that cannot change a match, so that
# long runs neither recurse nor backtrack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: High-recall generators; each may propose spans of several kinds.
AT_LIKE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\[(?i:at)\]|\((?i:at)\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20\.\x20|\x20?(?:\[(?i:dot)\]|\((?i:dot)\))\x20?)[A-Za-z0-9-]++)*+"
DIGIT_LIKE = r"[+(]?[0-9]++(?:[\x20().-]{1,2}[0-9]++)*+"
GENERATORS = {"email": AT_LIKE, "ip": DIGIT_LIKE, "card": DIGIT_LIKE, "phone": DIGIT_LIKE}

TRAIN_DOCS = 4_000
MAX_TRAIN = 20_000
#: Made-up spans of each kind, and the most examples of a kind from one document.
SEEDS, PER_DOC = 96, 64
PRECISION = 0.995
ROUNDS, DEPTH, RATE = 40, 4, 0.3
FEATURES = ("chars", "digits", "groups", "dots", "dashes", "spaces", "parens", "first_group", "last_group", "letters", "joints", "luhn", "octets", "before_word", "before_mark", "after_word", "after_mark", "hint")

def _located(text: Column, pattern: str, make) -> Column:
    """Arrays of ``make(match, start, gap before, gap after)`` over the leftmost matches.

    ``split`` gives what lies between the matches, so their lengths add up to the positions."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n = F.size(found)
    both = F.zip_with(F.zip_with(F.slice(gaps, 1, n), F.slice(gaps, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), found, lambda g, m: F.struct(g["a"].alias("a"), g["b"].alias("b"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,start:int,a:string,b:string>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["a"]) + F.length(x["m"])).alias("at"),
        F.when(make(x["m"]), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), (acc["at"] + F.length(x["a"])).alias("start"), F.right(x["a"], F.lit(16)).alias("a"), F.left(x["b"], F.lit(8)).alias("b"))))).otherwise(acc["out"]).alias("out"),
    )
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 0, at(i)).otherwise((at(i) * 2) % 10 + F.floor(at(i) * 2 / 10).cast("int")))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(m) >= 14, F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_GATE = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}
_NONE = "array<struct<start:int,kind:int,end:int>>"


def _base(text: Column, k: int) -> Column:
    found = _located(text, BASE[KINDS[k]], lambda m: _valid(KINDS[k], m))
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), (x["start"] + F.length(x["m"])).alias("end")))
    return F.when(_GATE[KINDS[k]](text), spans).otherwise(F.array().cast(_NONE))


def base_spans(text: Column) -> Column:
    """All base spans as (start, kind's index, end), by start, then kind."""
    return F.array_sort(F.concat(*[_base(text, k) for k in range(len(KINDS))]))


def _features(x: Column) -> Column:
    m, before, after = x["m"], x["a"], x["b"]
    count = lambda pattern: F.length(m) - F.length(F.regexp_replace(m, pattern, ""))
    flag = lambda c, pattern: F.when(c.rlike(pattern), 1).otherwise(0)
    tail = F.regexp_extract(m, r"(?i)(?:@|[\[(]at[\])])(.*?[A-Za-z])$", 1)  # a domain, if it ends with a letter
    values = {
        "chars": F.length(m), "digits": count("[0-9]"), "groups": F.size(F.split(m, "[^0-9]+")), "dots": count(r"\."), "dashes": count("-"), "spaces": count(" "), "parens": count("[()]"),
        "first_group": F.length(F.regexp_extract(m, "[0-9]+", 0)), "last_group": F.length(F.regexp_extract(m, "([0-9]+)[^0-9]*$", 1)), "letters": count("[A-Za-z]"), "joints": F.size(F.split(tail, r"(?i)\.|[\[(]dot[\])]")) - 1,
        "luhn": _valid("card", F.regexp_replace(m, r"[\x20().-]+", "-")).cast("int"), "octets": _valid("ip", F.regexp_replace(m, r"\x20", "")).cast("int"),
        "before_word": flag(before, r"[\p{L}\p{N}_]$"), "before_mark": flag(before, r"[\p{P}\p{S}]$"), "after_word": flag(after, r"^[\p{L}\p{N}_]"), "after_mark": flag(after, r"^[\p{P}\p{S}]"), "hint": flag(F.lower(before), r"(mail|tel|phone|call|card|ip|addr|contact)[^\p{L}]*$"),
    }
    return F.array(*[values[n].cast("int") for n in FEATURES])


def _candidates(text: Column, pattern: str) -> Column:
    found = _located(text, pattern, lambda m: F.length(m) >= 7)
    found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), _features(x).alias("x")))
    gate = text.rlike(r"(?i)@|[\[(]at[\])]") if pattern == AT_LIKE else text.rlike(r"[0-9].{0,2}[0-9]")
    return F.when(gate, found).otherwise(F.array().cast("array<struct<start:int,end:int,x:array<int>>>"))


def fit_trees(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Newton-boosted trees for the logistic loss; a tree is (feature, cut, left, right) or a leaf's value."""

    values, codes = zip(*[np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])])

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        G, H = g[rows].sum(), h[rows].sum()
        leaf = float(round(-RATE * G / (H + 1), 6))
        best = (1e-3, None, None)
        for f in range(x.shape[1]) if depth else ():
            idx = codes[f][rows]
            gs, hs = np.cumsum(np.bincount(idx, g[rows]))[:-1], np.cumsum(np.bincount(idx, h[rows]))[:-1]
            if len(gs):
                gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, int(values[f][k]))
        if best[1] is None:
            return leaf
        _, f, cut = best
        left = x[rows, f] <= cut
        return (f, cut, grow(rows[left], g, h, depth - 1), grow(rows[~left], g, h, depth - 1))

    trees, score = [], np.zeros(len(y))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), DEPTH)
        score += tree_scores(tree, x)
        trees.append(tree)
    return trees


def tree_scores(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, tree_scores(left, x), tree_scores(right, x))


def _tree_column(tree, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, left, right = tree
    return F.when(x[f] <= cut, _tree_column(left, x)).otherwise(_tree_column(right, x))


def _rewritten(k: int, m: Column) -> Column:
    """Array of (pre, m, y): base span ``m`` as its pattern does not allow it (y is 1) and look-alikes (0); pre goes before."""
    d = _digits(m)
    part = lambda at, n: F.substring(d, at, n)
    row = lambda sep, *of: F.concat_ws(sep, *of)
    right: list[tuple] = []
    wrong: list[tuple] = []
    if KINDS[k] == "email":
        name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        label, price = F.substring_index(host, ".", 1), row(".", F.pmod(F.xxhash64(m), F.lit(900)) + 10, F.lit("99"))
        for at, dot in ((" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" (at) ", " (dot) "), (" [at] ", "."), (" @ ", "."), (" @ ", " . "), (" [AT] ", " [DOT] "), ("@", "[dot]")):
            right.append(("", F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))))
        for at in (" [at] ", "[at]", "(at)", " (at) ", " @ ", "@"):
            wrong += [("", F.concat(name, F.lit(at), label)), ("", F.concat(F.length(m) * 10, F.lit(at), price))]
    elif KINDS[k] == "phone":
        a, b, c = part(-10, 3), part(-7, 3), part(-4, 4)
        land = F.when(F.length(d) > 10, F.substring(d, F.lit(1), F.length(d) - 10)).otherwise("1")
        own = F.when(m.rlike(r"[0-9][\x20().-]+[0-9]+[\x20().-]"), F.regexp_replace(m, r"^\+", ""))
        local = F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c)
        right += [("", local), ("", F.concat(F.lit("("), a, F.lit(")"), b, F.lit("-"), c)), ("", row(" ", land, local)), ("", own), ("", F.concat(F.lit("00"), own))]
        right += [("", row(sep, *of)) for sep in "-." for of in ((a, b, c), (land, a, b, c))] + [(hint, row(" ", a, b, c)) for hint in ("tel ", "call ", "phone: ")]
        day, month, year = (F.pmod(F.xxhash64(m, F.lit(i)), F.lit(n)) + lo for i, n, lo in ((1, 19, 10), (2, 3, 10), (3, 130, 1900)))
        wrong += [(pre, row(sep, *[part(i, 4) for i in (1, 5, 3, 7)])) for sep in "-. " for pre in ("", "of ", "card ")]  # four fours
        wrong += [("of ", row(" ", a, b, c)), ("", d), ("", F.concat(F.lit("3."), d)), ("a", local), ("", row("-", F.lit("978-3"), part(1, 2), part(3, 6), part(-1, 1)))]
        wrong += [("of ", row(sep, year, year + 5)) for sep in "- "] + [("of ", row(sep, year, year + 1, year + 2)) for sep in "- "]
        wrong += [("of ", row(sep, *of)) for sep in "-. " for of in ((year, month, day), (day, month, year), (year, month, day, month), (part(1, 1), a, b, part(-3, 3)), (part(1, 4), part(5, 4), part(-4, 4)), (part(1, 5), part(-5, 5)), (part(1, 3), part(4, 4), part(-3, 3)), (part(1, 4), part(5, 3), part(-3, 3)), (a, b, part(-3, 3)))]
    elif KINDS[k] == "card":
        other = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), F.pmod(F.right(d, F.lit(1)).cast("int") + 1 + F.pmod(F.xxhash64(m), F.lit(9)).cast("int"), F.lit(10)).cast("string"))
        fours = lambda x, sep: F.regexp_replace(x, "([0-9]{4})(?=[0-9])", "$1" + sep)
        right += [("", fours(d, sep)) for sep in (".", "  ", "- ", " -", "--")]
        wrong += [("", fours(other, sep)) for sep in (".", "  ", "- ", " -", "--", " ", "-")] + [("", other), ("", F.concat(F.lit("0."), d)), ("", F.concat(F.lit("0."), other)), ("a", fours(d, ".")), ("", fours(part(1, 12), "."))]
    else:
        four, one = F.split(m, r"\."), lambda i: F.pmod(F.xxhash64(m, F.lit(i)), F.lit(9)) + 1
        for sep in (". ", " ."):
            right.append(("", F.array_join(four, sep)))
            wrong += [("", row(sep, *[F.get(four, F.lit(i)) + 300 * (i == j) for i in range(4)])) for j in (0, 3)]
            wrong += [("", row(sep, *[one(i) for i in range(4)])), ("", row(sep, *[F.pmod(one(0), F.lit(5)) + i for i in range(4)])), ("", row(sep, *[one(0) + 9 + i for i in range(4)]))]
            wrong += [("", row(sep, F.array_join(four, sep), one(5))), ("", F.array_join(F.slice(four, 1, 3), sep)), ("a", F.array_join(four, sep))]
    return F.filter(F.array(*[F.struct(F.lit(pre).alias("pre"), w.cast("string").alias("m"), F.lit(y).alias("y")) for y, of in ((1, right), (0, wrong)) for pre, w in of]), lambda r: r["m"].isNotNull())


def _seeds(docs: DataFrame) -> DataFrame:
    """Made-up base spans (h, kind, a, m, b), so that every kind can be learned from any table."""
    num = lambda i, lo, n: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n)) + lo
    near = lambda i, of: F.get(F.array(*[F.lit(w) for w in of]), F.pmod(F.col("id"), F.lit(i)).cast("int"))
    email = F.concat(near(4, ("info", "a.smith", "lee", "jo_w")), num(1, 1, 99), F.lit("@"), near(3, ("mail", "post", "web-1")), F.when(num(2, 0, 2) == 0, "").otherwise(".example"), near(5, (".org", ".com", ".net", ".de", ".io")))
    american = F.concat(F.lit("+1 ("), num(3, 200, 800), F.lit(") "), num(4, 200, 800), F.lit("-"), num(5, 1000, 9000))
    phone = F.when(num(6, 0, 3) > 0, american).otherwise(F.concat(F.lit("+"), num(3, 30, 69), F.lit(" "), num(4, 20, 80), F.lit(" "), num(5, 2000, 8000), F.lit(" "), num(13, 1000, 9000)))
    body = F.concat(num(7, 40000000, 19999999), num(8, 1000000, 8999999))
    card = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(body, i.cast("string"))), _luhn), F.lit(0))
    ip = F.concat_ws(".", num(9, 1, 223), num(10, 0, 256), num(11, 0, 256), num(12, 1, 254))
    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    spans = F.array(*[F.struct(F.lit(k).alias("kind"), made[kind].cast("string").alias("m")) for k, kind in enumerate(KINDS)])
    return docs.sparkSession.range(SEEDS).select(F.xxhash64("id").alias("h"), near(4, ("", "see ", "it was: ", "one, ")).alias("a"), near(5, ("", " and", ".", ", it", " of")).alias("b"), F.explode(spans).alias("s")).select("h", "s.kind", "a", "s.m", "b")


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> dict[str, tuple[list, float]]:
    """Per kind its trees and the score from which a candidate is added (infinite: none is)."""
    docs = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    total = docs.count()
    if not total:
        return {}
    share = max(1, math.ceil(total / TRAIN_DOCS))  # the fit's sample alone; every document is scored
    text = F.col("text")
    sample = docs.filter(F.pmod("h", F.lit(share)) == 0).select("h", "text", base_spans(text).alias("base"), *[_candidates(text, p).alias(f"c{i}") for i, p in enumerate((AT_LIKE, DIGIT_LIKE))])
    sample = materialise(sample, "sample")
    spans = sample.select("h", "text", F.explode(F.slice("base", 1, PER_DOC)).alias("s"))
    cut = lambda at, n: F.substring("text", at, n)
    start, end = F.col("s.start"), F.col("s.end")
    spans = spans.select("h", "s.kind", cut(F.greatest(start - 15, F.lit(1)), F.least(start, F.lit(16))).alias("a"), cut(start + 1, end - start).alias("m"), cut(end + 1, F.lit(8)).alias("b")).filter(F.length("m") <= 80)
    spans = materialise(spans.unionByName(_seeds(docs)), "spans")
    x_of = {n: i for i, n in enumerate(FEATURES)}
    models = {}
    for k, kind in enumerate(KINDS):
        made = spans.filter(F.col("kind") == k).select("h", "a", "b", F.explode(_rewritten(k, F.col("m"))).alias("r"))
        made = made.select("h", F.concat("a", "r.pre").alias("a"), F.col("r.m").alias("m"), "b", F.col("r.y").alias("y"))
        made = made.select("h", "y", F.length("a").alias("start"), F.length("m").alias("n"), _candidates(F.concat("a", "m", "b"), GENERATORS[kind]).alias("c"))
        made = made.select("h", "y", F.explode(F.filter("c", lambda c: (c["start"] == F.col("start")) & (c["end"] == F.col("start") + F.col("n")))).alias("c")).select("h", "c.x", "y")

        get = lambda c, n: c["x"][x_of[n]]
        check = {"email": lambda c: get(c, "joints") > 0, "ip": lambda c: get(c, "octets") == 1, "card": lambda c: get(c, "luhn") == 1, "phone": lambda c: get(c, "digits").between(10, 15)}[kind]
        over = lambda c, same: F.exists("base", lambda b: ((b["kind"] == k) if same else (b["kind"] != k)) & (b["start"] < c["end"]) & (b["end"] > c["start"]))
        sure = lambda c: ~over(c, True) & (over(c, False) | ~check(c) | (get(c, "before_word") == 1) | (get(c, "after_word") == 1))  # noqa: B023, E731
        seen = sample.select("h", "base", F.slice(F.filter(f"c{(AT_LIKE, DIGIT_LIKE).index(GENERATORS[kind])}", sure), 1, PER_DOC).alias("c")).select("h", F.explode("c.x").alias("x"), F.lit(0).alias("y"))
        rows = [r for df in (made, seen) for r in df.select((F.pmod(F.xxhash64("h"), F.lit(3)) == 0).alias("held"), "x", "y", F.xxhash64("h", "x", "y").alias("o")).orderBy("o").limit(MAX_TRAIN).collect()]
        x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
        held = np.array([r.held for r in rows])
        trees = fit_trees(x[~held], y[~held])
        score = sum(tree_scores(t, x[held]) for t in trees)
        order = np.argsort(-score, kind="stable")
        right, seen = np.cumsum(y[held][order]), np.arange(1, held.sum() + 1)
        last = np.append(np.diff(score[order]) != 0, True)
        ok = np.flatnonzero(last & (right >= PRECISION * seen))
        models[kind] = (trees, float(score[order][ok[-1]]) if len(ok) else math.inf)
    return models


def _added(text: Column, k: int, trees: list, least: float) -> Column:
    """Candidates of a kind that score at least ``least`` and overlap no base span."""
    score = lambda c: reduce(lambda a, b: a + b, [_tree_column(t, c["x"]) for t in trees])
    free = lambda c: ~F.exists("_pii_base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    got = F.filter(_candidates(text, GENERATORS[KINDS[k]]), lambda c: free(c) & (score(c) >= least - 1e-9))
    return F.transform(got, lambda c: F.struct(c["start"].alias("start"), F.lit(k).alias("kind"), c["end"].alias("end")))


def _count(k: int) -> Column:
    return F.size(F.filter("_pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")


def find(docs: DataFrame, models: dict | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``_pii_base`` and ``_pii_added``: arrays of (start, kind's index, end), by start, then kind."""
    models = train(docs, text_col, id_col) if models is None else models
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("_pii_base", base_spans(text))
    added = [_added(text, k, *models[kind]) for k, kind in enumerate(KINDS) if kind in models and math.isfinite(models[kind][1])]
    return out.withColumn("_pii_added", F.array_sort(F.concat(*added)) if added else F.array().cast(_NONE))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(name, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = [_count(k) for k in range(len(KINDS))]
    return found.select(id_col, *counts, F.sha2(_joined(F.col("_pii_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("_pii_base", "_pii_added"))).alias("spans"))


def redact(docs: DataFrame, models: dict | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each maximal run of overlapping spans replaced by its first span's kind, as ``[EMAIL]``."""
    clash = [c for c in docs.columns if c.lower() in ("_pii_base", "_pii_added")]
    if clash:  # set such columns aside
        aside = {c: free_name(docs, f"{c}_kept") for c in clash}
        return redact(docs.withColumnsRenamed(aside), models, text_col, id_col).withColumnsRenamed({v: k for k, v in aside.items()})
    found = find(docs, models, text_col, id_col)
    spans, text = F.array_sort(F.concat("_pii_base", "_pii_added")), F.col(text_col)
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(name, s["kind"]))).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    new = F.aggregate(spans, start, step, lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), ""))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, new).otherwise(text)).drop("_pii_base", "_pii_added")
