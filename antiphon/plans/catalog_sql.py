"""DuckDB twins of the catalogue's queries.

``claim_model`` is fitted and ``counterargument_run`` chains most of the others, so they have none."""

from __future__ import annotations

from ..schemas import FRAMES

_W = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '{_W}+', ' ', 'g')"


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z]{{2,}}'))"


def _sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace(coalesce({x}, ''), '([.!?]+[\"'')\]]*)[\s\x{{0b}}]+', '\1' || chr(31), 'g'), chr(31)), lambda s: s <> '')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{_W}+'), lambda w: w <> '')"


_FRAMES = "[" + ", ".join(f"'{f}'" for f in FRAMES) + "]"


def _frame(i: str) -> str:
    return f"list_extract({_FRAMES}, CAST(({i}) + 1 AS BIGINT))"


_LEANING = f"""
s AS (SELECT list_distinct({_tokens("x")}) AS t FROM (SELECT unnest({_sentences("text")}) AS x FROM documents)),
m AS (SELECT t, CAST(list_has_any(t, ['best', 'great', 'good']) AS BIGINT) AS p, CAST(list_has_any(t, ['idiot', 'stupid', 'moron', 'worthless']) AS BIGINT) AS m FROM s),
a AS (SELECT sum(p) AS ap, sum(m) AS am FROM m), w AS (SELECT word, sum(p) AS good, sum(m) AS bad FROM (SELECT unnest(t) AS word, p, m FROM m WHERE p + m > 0) GROUP BY word),
o AS (SELECT word, CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad, ln((good + 0.5) * (am + 0.5) / ((bad + 0.5) * (ap + 0.5))) AS orientation FROM w, a WHERE good + bad >= 3 ORDER BY round(abs(orientation), 9) DESC, word LIMIT 2000)"""
_FRAME_TABLE = f"(SELECT unnest({_FRAMES}) AS frame)"


def _dot(a: str, b: str, n: int = 64) -> str:
    return f"list_dot_product({a}, {b})"


def _top(items: str, source: str, key: str, size: str = "0", k: int = 5) -> str:
    """Counts per key of exploded (keyword, size, spot), the k first by count, then place."""
    return f"""
WITH x AS ({items}), c AS (
  SELECT {key}, keyword, count(*) AS n, min(CAST(size AS BIGINT) * 1000000000 + spot) AS place FROM x GROUP BY {key}, keyword
), r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, place) AS rk FROM c)
SELECT {key}, CAST(rk AS INTEGER) AS rank, keyword, n FROM r WHERE rk <= {k}"""


def _simple(table: str, key: str) -> str:
    return f"SELECT {key}, unnest(t) AS keyword, 0 AS size, unnest(range(len(t))) AS spot FROM (SELECT {key}, {_tokens('text')} AS t FROM {table})"


_NGRAM = " UNION ALL ".join(f"SELECT doc_id, array_to_string(t[i : i + {n - 1}], ' ') AS keyword, {n} AS size, i AS spot FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n} + 2)) AS i FROM tk)" for n in (2, 3))

_SENTS = f"""
s0 AS (SELECT doc_id, list_filter(list_transform({_sentences("text")}, lambda s: {_strip("s")}), lambda s: s <> '') AS ss FROM documents),
s AS (SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS pos, unnest(ss) AS sent FROM s0),
st AS (SELECT doc_id, pos, sent, list_distinct({_tokens("sent")}) AS t, lower({_collapse("sent")}) AS norm FROM s)"""
_PAIRS = f"""
WITH {_SENTS}, p AS (
  SELECT c.doc_id, c.pos AS claim_pos, e.pos AS evidence_pos, c.sent AS claim, e.sent AS evidence, len(list_intersect(c.t, e.t)) AS common, len(c.t) + len(e.t) AS total
  FROM st c JOIN st e USING (doc_id) WHERE least(1.0, len(c.t) / 20.0) >= 0.45 AND c.norm <> e.norm AND least(len(c.t), len(e.t)) >= 0.35 * greatest(len(c.t), len(e.t))
), q AS (SELECT doc_id, claim_pos, evidence_pos, claim, evidence, CASE WHEN total - common > 0 THEN CAST(common AS DOUBLE) / (total - common) ELSE 0 END AS p FROM p)"""

_LINES = r"""list_transform(string_split(
  replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(body, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<form\b[^>]*>.*?</form\s*>|<svg\b[^>]*>.*?</svg\s*>', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(10)), lambda s: """ + _strip("s") + ")"
_GOOD = r"""l <> '' AND NOT starts_with(l, '{') AND NOT starts_with(l, '}') AND NOT starts_with(l, '[') AND NOT starts_with(l, ']') AND NOT starts_with(l, 'function') AND NOT starts_with(l, 'var ')
  AND NOT regexp_full_match(l, 'https?://\S+') AND NOT contains(lower(l), 'cookie') AND NOT contains(lower(l), 'privacy policy') AND NOT contains(lower(l), 'newsletter')
  AND NOT contains(lower(l), 'subscribe') AND NOT contains(lower(l), 'sign up') AND NOT contains(lower(l), 'all rights reserved')"""
_PAGES = rf"""
WITH a AS (SELECT page_id, coalesce(html, '') AS html, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1) AS raw_title,
  regexp_extract(coalesce(html, ''), '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) AS inner_text FROM pages),
b AS (SELECT page_id, {_strip("raw_title")} AS title, CASE WHEN {_strip("inner_text")} <> '' THEN inner_text ELSE html END AS body FROM a),
c AS (SELECT page_id, title, array_to_string(list_filter({_LINES}, lambda l: {_GOOD}), ' ') AS t FROM b),
v AS (SELECT page_id, title, substring(t, 1, 50000) AS text, CASE
  WHEN contains(lower(t), '404 not found') OR contains(lower(t), 'access denied') OR contains(lower(t), 'permission denied') OR contains(lower(t), 'captcha verification') THEN 'unwanted keyword'
  WHEN length(t) < 150 THEN 'too short' WHEN len({_words("substring(t, 1, 50000)")}) < 30 THEN 'too few words' END AS reason FROM c)"""

_TURNS = f"""
t0 AS (SELECT conv_id, turn AS id, role, list_transform(list_filter({_sentences("text")}, lambda s: {_strip("s")} <> ''), lambda s: {_strip("s")}) AS s FROM conversations),
t AS (SELECT conv_id, id, role, s[1] AS claim, array_to_string(s[2:], ' ') AS evidence, list_distinct({_tokens("s[1]")}) AS k, lower({_collapse("s[1]")}) AS norm FROM t0 WHERE len(s) > 0),
a AS (SELECT * FROM t WHERE role = 'user'), b AS (SELECT * FROM t WHERE role = 'assistant')"""
_NEG = "len(list_filter({0}, lambda w: w IN ('no', 'not', 'never', 'none', 'nicht', 'kein', 'pas', 'jamais', 'nunca'))) > 0"
_INFER = f"""
WITH {_TURNS}, ab AS (
  SELECT a.conv_id, a.id AS r_id, b.id AS o_id, a.claim AS r_claim, b.claim AS o_claim, b.evidence, a.norm = b.norm AS eq, ({_NEG.format("a.k")}) <> ({_NEG.format("b.k")}) AS one,
  CASE WHEN len(a.k) + len(b.k) - len(list_intersect(a.k, b.k)) > 0 THEN CAST(len(list_intersect(a.k, b.k)) AS DOUBLE) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) ELSE 0 END AS share
  FROM a JOIN b USING (conv_id)
), inf AS (SELECT *, CASE WHEN eq THEN 1 WHEN one AND share >= 0.3 THEN -1 WHEN share >= 0.6 THEN 1 ELSE 0 END AS result FROM ab),
merged AS (SELECT conv_id, r_id, o_id, CASE WHEN result = 1 THEN r_claim ELSE o_claim END AS claim, evidence, result = 1 AS merged FROM inf)"""

_SEG = f"""
seg AS (SELECT CAST(conv_id AS VARCHAR) AS essay_id_comp, CASE role WHEN 'user' THEN 'claim' WHEN 'assistant' THEN 'evidence' ELSE 'other' END AS kind, CAST(turn AS DOUBLE) AS discourse_start, text AS raw, {_collapse("text")} AS t FROM conversations),
cf0 AS (SELECT *, last_value(CASE WHEN kind = 'claim' THEN t END IGNORE NULLS) OVER (PARTITION BY essay_id_comp ORDER BY discourse_start, raw ROWS UNBOUNDED PRECEDING) AS claim FROM seg WHERE essay_id_comp IS NOT NULL AND t <> ''),
cf AS (SELECT essay_id_comp, discourse_start, raw AS discourse_text, claim, t AS evidence FROM cf0 WHERE kind = 'evidence' AND claim IS NOT NULL),
df AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY claim, evidence ORDER BY essay_id_comp, discourse_start, discourse_text) AS rn FROM cf) WHERE rn = 1)"""


def _split(key: str) -> str:
    u = f"CAST(('0x' || substring(sha256('42:' || {key}), 1, 8)) AS BIGINT) / 4294967296.0"
    return f"CASE WHEN {u} < 0.8 THEN 'training' WHEN {u} < 0.9 THEN 'validation' ELSE 'testing' END"


_ARGS = "SELECT 'c' || CAST(doc_id % 97 AS VARCHAR) AS claim, 'e' || CAST(doc_id % 31 AS VARCHAR) AS evidence FROM labels WHERE {0} = 1"


def _set(keys_p: str, keys_g: str) -> str:
    return f"""
WITH p AS (SELECT DISTINCT k FROM (SELECT {keys_p} AS k FROM ({_ARGS.format("quality")}))), g AS (SELECT DISTINCT k FROM (SELECT {keys_g} AS k FROM ({_ARGS.format("toxic")}))),
c AS (SELECT (SELECT count(*) FROM p JOIN g USING (k)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng),
m AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS pr, CASE WHEN ng > 0 THEN tp / ng ELSE 0.0 END AS re FROM c)
SELECT tp, np AS predicted, ng AS gold, round(CAST(CASE WHEN np + ng - tp > 0 THEN tp / (np + ng - tp) ELSE 0.0 END AS DOUBLE), 6) AS iou, round(CAST(pr AS DOUBLE), 6) AS precision, round(CAST(re AS DOUBLE), 6) AS recall,
  round(CAST(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS DOUBLE), 6) AS f1 FROM m"""


_CELLS = f"""
WITH f AS {_FRAME_TABLE}, e AS (SELECT {_frame("label")} AS y_true, {_frame("CASE WHEN vec_id % 3 = 0 THEN label ELSE vec_id % 12 END")} AS y_pred FROM embeddings),
n AS (SELECT y_true, y_pred, count(*) AS n FROM e GROUP BY ALL),
cells AS (SELECT a.frame AS y_true, b.frame AS y_pred, coalesce(n.n, 0) AS n FROM f a CROSS JOIN f b LEFT JOIN n ON n.y_true = a.frame AND n.y_pred = b.frame),
t AS (SELECT y_true AS class, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp FROM cells GROUP BY 1), pp AS (SELECT y_pred AS class, sum(n) AS predicted FROM cells GROUP BY 1),
cm0 AS (SELECT class, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS recall, CAST(support AS BIGINT) AS support FROM t JOIN pp USING (class)),
cm AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM cm0)"""

_BUCKETS = f"SELECT doc_id, text, list_transform({_tokens('text')}, lambda t: (ascii(t) * 31 + length(t)) % 15) AS b FROM documents"
_PROBS = f"SELECT doc_id, text, list_transform(range(15), lambda f: (len(list_filter(b, lambda x: x = f)) + 1) / CAST(len(b) + 15 AS DOUBLE)) AS p FROM ({_BUCKETS})"
_STYLE = rf"""
i0 AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x{{0b}}]') AS items, {_sentences("text")} AS ss FROM documents),
i1 AS (SELECT *, list_filter(items, lambda t: regexp_matches(t, '^[\p{{L}}\p{{N}}_]')) AS w FROM i0),
i2 AS (SELECT *, list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')), 1)) AS syl,
  len(list_filter(list_transform(ss, lambda s: regexp_extract(s, '^[^\p{{L}}\p{{N}}_]*([\p{{L}}\p{{N}}_]+)', 1)), lambda h: regexp_matches(h, '^\p{{Lu}}'))) AS heads,
  len(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda t: t IN ('good', 'great', 'best', 'better', 'success', 'benefit', 'safe', 'fair', 'happy', 'love'))) AS good,
  len(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda t: t IN ('bad', 'worst', 'worse', 'fail', 'harm', 'danger', 'unfair', 'sad', 'hate', 'wrong'))) AS bad FROM i1),
i3 AS (SELECT doc_id, text, CAST(len(items) AS DOUBLE) AS t, CAST(len(w) AS DOUBLE) AS w, CAST(len(ss) AS DOUBLE) AS n, CAST(length(text) AS DOUBLE) AS chars,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$'))) AS DOUBLE) AS num,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Ll}}+(ing|ed|en|er|ir|ar)$'))) AS DOUBLE) AS verb,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Ll}}+(ous|ful|able|ible|al|ive|ic|lich|ig)$') AND NOT regexp_matches(x, '(ing|ed|en|er|ir|ar)$'))) AS DOUBLE) AS adj,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Ll}}'))) AS DOUBLE) AS lw,
  CAST(greatest(len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) - heads, 0) AS DOUBLE) AS propn,
  CAST(coalesce(list_sum(syl), 0) AS DOUBLE) AS syl, CAST(len(list_filter(syl, lambda x: x >= 3)) AS DOUBLE) AS hard, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS DOUBLE) AS letters,
  CAST(good AS DOUBLE) AS good, CAST(bad AS DOUBLE) AS bad FROM i2 WHERE len(w) > 0),
i4 AS (SELECT *, 0.1579 * 100 * (hard / w) + 0.0496 * (w / n) AS dale, (w + 2 * hard) / n AS lin FROM i3),
i5 AS (SELECT doc_id, text, list_concat(list_transform([w / n / 50.0, chars / w / 16.0, (lw - verb - adj) / t, verb / t, adj / t, (t - w) / t, num / t, propn / t,
  (0.4 * (w / n + 100 * (hard / w)) - 6) / 11.0, (206.835 - 1.015 * (w / n) - 84.6 * (syl / w) - 100) / -90.0, (0.39 * (w / n) + 11.8 * (syl / w) - 15.59 - 6) / 11.0,
  (1.043 * sqrt(30 * hard / n) + 3.1291 - 6) / 11.0, (0.0588 * 100 * letters / w - 0.296 * 100 * n / w - 15.8 - 6) / 11.0, (4.71 * letters / w + 0.5 * (w / n) - 21.43 - 6) / 11.0,
  (CASE WHEN hard / w > 0.05 THEN dale + 3.6365 ELSE dale END - 4.9) / 5.0, (CASE WHEN lin > 20 THEN lin / 2 ELSE (lin - 2) / 2 END - 6) / 11.0, hard / w], lambda v: CAST(greatest(least(v, 1.0), 0.0) AS DOUBLE)),
  [(good - bad) / greatest(good + bad, 1.0) / 2 + 0.5]) AS v FROM i4)"""
_NAMES = ("sentence_length", "word_length", "noun", "verb", "adj", "punct", "num", "propn", "gunning_fog", "flesch_ease", "flesch_kincaid", "smog", "coleman_liau", "automated", "dale_chall", "linsear", "difficult", "positivity")
_ENCODED = f"""
WITH {_STYLE}, fp AS ({_PROBS}),
x AS (SELECT i5.doc_id, list_position(fp.p, list_max(fp.p)) - 1 AS f, list_concat(i5.v, list_transform(range(15), lambda k: CASE WHEN k = list_position(fp.p, list_max(fp.p)) - 1 THEN 1.0 ELSE 0.0 END), fp.p) AS x FROM i5 JOIN fp USING (doc_id)),
y AS (SELECT doc_id, f, x, list_transform(range(10), lambda i: list_sum(list_transform(range(48), lambda j: x[j + 1] * sin((i + 1) * (j + 1)) / sqrt(48.0)))) AS y FROM x)"""

_GOLD = f"""
g0 AS (SELECT conv_id, turn, role, text, conv_id * 1000 + turn + 1 AS id, list_transform(list_filter({_sentences("text")}, lambda s: {_strip("s")} <> ''), lambda s: {_strip("s")}) AS s FROM conversations),
g1 AS (SELECT *, s[1] AS claim, array_to_string(s[2:], ' ') AS evidence FROM g0),
g AS (SELECT *, last_value(CASE WHEN claim <> '' AND evidence <> '' THEN id END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g1)"""
_LETTERS = "[" + ", ".join(f"CAST(length({{0}}) - length(replace({{0}}, '{x}', '')) AS DOUBLE)" for x in "aeionrst") + "]"
_UNCITED = r"""list_transform({0}, lambda p: array_to_string(list_transform(string_split(array_to_string(
  list_transform(list_zip(string_split(p, '['), range(len(string_split(p, '[')))), lambda x: CASE WHEN x[2] = 0 THEN x[1]
    WHEN contains(x[1], ']') AND len(list_filter(string_split_regex(split_part(x[1], ']', 1), '[,;]'), lambda n: NOT regexp_full_match(n, '\s*[0-9]+\s*'))) = 0 THEN substring(x[1], length(split_part(x[1], ']', 1)) + 2)
    ELSE '[' || x[1] END), ''), ' '),
  lambda w: regexp_replace(regexp_replace(w, '^((?:.*[^0-9])?[.!?])[0-9]{{1,3}}$', '\1'), '([A-Za-z])[0-9]{{1,3}}([.,!?;:])', '\1\2', 'g')), ' '))"""
_NORMALISED = rf"""
WITH l AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS ls FROM documents),
m AS (SELECT doc_id, array_to_string(list_transform(list_zip(ls, range(len(ls))), lambda x: CASE WHEN regexp_replace(x[1], '^[ \t]+|[ \t]+$', '', 'g') = '' OR (x[2] > 0 AND regexp_matches(x[1], '^[ \t]{{4,}}[^\s\x0b]')) THEN chr(10) ELSE ' ' END
  || regexp_replace(x[1], '^[ \t]+|[ \t]+$', '', 'g')), '') AS t FROM l),
p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda q: regexp_replace(regexp_replace(q, '[ \t]+', ' ', 'g'), '^ | $', '', 'g')), lambda q: q <> '') AS ps FROM m),
c AS (SELECT doc_id, array_to_string({_UNCITED.format("ps")}, chr(10) || chr(10)) AS t FROM p)
SELECT doc_id, {_strip("t")} || chr(10) AS text FROM c"""

def _fingerprint(table: str, columns: list[str]) -> str:
    told = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in sorted(columns))
    sums = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)), 0) AS VARCHAR)" for k in range(4))
    return f"SELECT count(*) AS n, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {sums})) AS fingerprint, '{table}' AS name FROM (SELECT md5(concat_ws(',', {told})) AS h FROM {table})"


ORACLE_SQL: dict[str, str] = {
    "farthest_topk": """
WITH s AS (SELECT a.label, a.vec_id AS ref_id, b.vec_id AS cand_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label, ref_id ORDER BY s, cand_id) AS rk FROM s)
SELECT label, ref_id, CAST(rk AS INTEGER) AS rank, cand_id, round(s, 6) AS similarity FROM r WHERE rk <= 5""",
    "cosine_pairs": "SELECT a.label, a.vec_id AS vec_id_1, b.vec_id AS vec_id_2, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b USING (label)",
    "expected_distance": """
WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(CAST(0.3 AS DOUBLE) * (1 - list_cosine_similarity(a[33:64], b[33:64])) + CAST(0.7 AS DOUBLE) * CASE WHEN la = lb THEN 0 WHEN (la + lb) % 2 = 0 THEN 1 ELSE list_cosine_similarity(a[1:32], b[1:32]) END, 5) AS distance FROM p""",
    "softmax_scores": f"""
WITH e AS (SELECT vec_id, CAST(embedding[1:15] AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id, list_transform(v, lambda y: exp(y - list_max(v))) AS e FROM e)
SELECT vec_id, {_frame("list_position(e, list_max(e)) - 1")} AS frame, round(list_max(e) / list_sum(e), 6) AS p FROM x""",
    "sentence_split": f"WITH s AS (SELECT doc_id, {_sentences('text')} AS ss FROM documents) SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS pos, unnest(list_transform(ss, lambda s: {_collapse('s')})) AS sentence FROM s",
    "simple_keywords": _top(_simple("documents", "doc_id"), "documents", "doc_id"),
    "ngram_keywords": _top(f"WITH tk AS (SELECT doc_id, {_tokens('text')} AS t FROM documents) {_NGRAM}", "documents", "doc_id"),
    "query_texts": f"WITH k AS ({_top(_simple('documents', 'doc_id'), 'documents', 'doc_id')}) SELECT doc_id, string_agg(keyword, ' ' ORDER BY rank) AS normalized FROM k GROUP BY doc_id",
    "cache_keys": f"SELECT doc_id, sha256('v1:' || {_strip('lower(text)')}) AS cache_key FROM documents",
    "trailer_split": f"SELECT doc_id, length({_strip('text')}) AS body_chars, 'https://example.org/' || CAST(doc_id AS VARCHAR) AS source FROM documents",
    "sanitised_texts": f"WITH s AS (SELECT doc_id, substring({_strip('text')}, 1, 10000) AS t FROM documents WHERE {_strip('text')} <> '') SELECT doc_id, length(t) AS chars, sha256(t) AS sha FROM s",
    "tf_idf": f"""
WITH tk AS (SELECT doc_id, {_tokens("text")} AS t FROM documents),
g AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk UNION ALL SELECT doc_id, array_to_string(t[i : i + 1], ' ') FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM tk)) GROUP BY ALL),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM g GROUP BY term ORDER BY total DESC, term LIMIT 1000),
w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM g JOIN v USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM w""",
    "clean_pages": f"{_PAGES} SELECT page_id, title, text FROM v WHERE reason IS NULL AND text <> ''",
    "reject_reasons": f"{_PAGES} SELECT page_id, coalesce(reason, 'kept') AS reason FROM v",
    "null_clean_pages": f"SELECT page_id, sha256({_strip('coalesce(html, chr(0))')}) AS sha FROM pages",
    "local_results": "SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS url, substring(text, 1, 30) AS title, text AS snippet FROM documents",
    "keyword_results": f"""
WITH k AS ({_top(_simple("benchmark", "item_id"), "benchmark", "item_id")}), q AS (SELECT DISTINCT item_id, keyword AS t FROM k),
d AS (SELECT DISTINCT 'doc:' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS url, unnest({_tokens("text")}) AS t FROM documents),
h AS (SELECT item_id, url, count(*) AS shared FROM q JOIN d USING (t) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, url) - 1 AS rk FROM h)
SELECT item_id, CAST(rk AS INTEGER) AS rank, url, shared FROM r WHERE rk < 5""",
    "table_fingerprints": " UNION ALL ".join(_fingerprint(t, c) for t, c in (("documents", ["doc_id", "text", "lang", "source", "n_chars"]), ("labels", ["doc_id", "quality", "toxic"]), ("benchmark", ["item_id", "text"]), ("conversations", ["conv_id", "turn", "role", "text"]))),
    "readable_pages": r"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*)</article', 1) AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)<br[^>]*>', ' ', 'g'), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS x FROM a),
l AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(x, '(?i)</?(?:h[1-6]|p|ul|ol|li|div|section)\b[^>]*>'), lambda s: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(s, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda s: s <> '') AS ls FROM b)
SELECT page_id, array_to_string(ls, chr(10)) AS text, length(array_to_string(ls, chr(10))) AS n_chars FROM l""".replace("\\\\", "\\"),
    "ranked_results": f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_tokens("text")}) AS t FROM benchmark), d AS (SELECT 'doc:' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS url, {_tokens("text")} AS ts FROM documents),
a AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d), p AS (SELECT t, url, len(ts) AS l, count(*) AS tf FROM (SELECT url, ts, unnest(ts) AS t FROM d) GROUP BY ALL), f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (SELECT item_id, url, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 9) AS s FROM q JOIN p USING (t) JOIN f USING (t), a GROUP BY item_id, url),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, url) - 1 AS rk FROM s)
SELECT item_id, CAST(rk AS INTEGER) AS rank, url, round(s, 6) AS score FROM r WHERE rk < 10""",
    "word_associations": f"""
WITH t AS (SELECT row_number() OVER () AS k, {_tokens("text")} AS l FROM documents), p AS (SELECT k, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM t),
v AS (SELECT w FROM p GROUP BY w ORDER BY count(*) DESC, w LIMIT 500), o AS (SELECT k, i, w FROM p JOIN v USING (w)),
c AS (SELECT x.w AS a_word, y.w AS b_word, count(*) AS n FROM (SELECT k, w, unnest([i - 5, i - 4, i - 3, i - 2, i - 1, i + 1, i + 2, i + 3, i + 4, i + 5]) AS i FROM o) x JOIN o y USING (k, i) GROUP BY ALL),
s AS (SELECT a_word AS w, sum(n) AS own FROM c GROUP BY ALL), r AS (SELECT a_word, b_word, n, ln(CAST(n AS DOUBLE) * CAST((SELECT sum(own) FROM s) AS DOUBLE) / (CAST(x.own AS DOUBLE) * CAST(y.own AS DOUBLE))) AS p FROM c JOIN s x ON x.w = a_word JOIN s y ON y.w = b_word)
SELECT a_word, b_word, n, round(p, 6) AS ppmi FROM r WHERE p > 0""",
    "sentiment_words": f"WITH {_LEANING} SELECT word, good, bad, round(orientation, 6) AS orientation FROM o",
    "text_positivity": f"""
WITH {_LEANING}, k AS (SELECT doc_id, unnest({_tokens("text")}) AS word FROM documents), g AS (SELECT doc_id, avg(orientation) AS v FROM k JOIN o USING (word) GROUP BY doc_id)
SELECT doc_id, round(1 / (1 + exp(-coalesce(v, 0))), 6) AS positivity FROM documents LEFT JOIN g USING (doc_id)""",
    "page_lookup": "WITH p AS (SELECT url, max(html) AS html FROM pages GROUP BY url) SELECT url, length(html) AS chars FROM p UNION ALL SELECT 'missing:' || url, 0 FROM p",
    "claim_candidates": f"WITH {_SENTS} SELECT doc_id, pos, sent AS claim, CAST(least(1.0, len(t) / 20.0) AS DOUBLE) AS p FROM st WHERE least(1.0, len(t) / 20.0) >= 0.45",
    "claim_evidence_pairs": f"{_PAIRS} SELECT doc_id, claim_pos, evidence_pos, claim, evidence, round(p, 6) AS p FROM q WHERE p >= 0.35",
    "grouped_arguments": f"""{_PAIRS}, l AS (SELECT doc_id, count(*) AS n, string_agg(claim || '|' || evidence, chr(10) ORDER BY claim_pos, evidence_pos) AS s FROM q WHERE p >= 0.35 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n, sha256(coalesce(s, '')) AS sha FROM documents d LEFT JOIN l USING (doc_id)""",
    "inference_pairs": f"{_INFER} SELECT conv_id, r_id, o_id, result, round(CAST(CASE WHEN eq THEN 1 WHEN result = 0 THEN 1 - share ELSE share END AS DOUBLE), 6) AS confidence FROM inf",
    "merge_claims": f"{_INFER} SELECT conv_id, r_id, o_id, claim, evidence, merged FROM merged",
    "absorbed_claims": f"""{_INFER}, c AS (SELECT DISTINCT conv_id, claim FROM b WHERE conv_id IN (SELECT conv_id FROM a)), m AS (SELECT DISTINCT conv_id, claim, 1 AS kept FROM merged),
j AS (SELECT conv_id, count(*) AS claims, count(*) - count(kept) AS absorbed FROM c LEFT JOIN m USING (conv_id, claim) GROUP BY conv_id) SELECT conv_id, claims, absorbed, round(CAST(100.0 * absorbed / claims AS DOUBLE), 4) AS percent FROM j""",
    "inference_labels": "SELECT vec_id, CASE label % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS result FROM embeddings",
    "frame_predict": f"WITH fp AS ({_PROBS}) SELECT doc_id, {_frame('list_position(p, list_max(p)) - 1')} AS primary_frame, round(list_max(p), 6) AS p FROM fp",
    "style_features": f"WITH {_STYLE} SELECT d.doc_id, " + ", ".join(f"round(v[{i + 1}], 6) AS {n}" for i, n in enumerate(_NAMES)) + " FROM documents d LEFT JOIN i5 USING (doc_id)",
    "argument_tensor": f"{_ENCODED} SELECT doc_id, len(x) AS n, round(list_sum(x), 5) AS total FROM x",
    "encoded_vectors": f"{_ENCODED} SELECT doc_id, " + ", ".join(f"round(y[{i + 1}], 5) AS y{i}" for i in range(10)) + " FROM y",
    "encode_search": f"""{_ENCODED}, s AS (SELECT {_frame("a.f")} AS primary_frame, a.doc_id AS ref_id, b.doc_id AS cand_id, list_cosine_similarity(a.y, b.y) AS s FROM y a JOIN y b USING (f)),
r AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY s, cand_id) AS rk FROM s) SELECT primary_frame, ref_id, CAST(rk AS INTEGER) AS rank, cand_id, round(s, 4) AS similarity FROM r WHERE rk <= 5""",
    "claim_sentences": f"WITH {_SEG} SELECT essay_id_comp, discourse_start, t AS sentence, CASE WHEN kind = 'claim' THEN 1 ELSE 0 END AS is_claim FROM seg WHERE t <> '' AND len({_words('t')}) >= 4",
    "carry_forward": f"WITH {_SEG} SELECT * FROM cf",
    "dedup_first": f"WITH {_SEG} SELECT essay_id_comp, discourse_start, claim, evidence FROM df",
    "negative_pairs": f"""
WITH {_SEG}, p AS (SELECT *, {_split("essay_id_comp")} AS split, sha256('42:' || essay_id_comp || ':' || CAST(discourse_start AS VARCHAR) || ':' || evidence) AS h FROM df),
n AS (SELECT *, coalesce(lead(claim) OVER w, first_value(claim) OVER w) AS other FROM p WINDOW w AS (PARTITION BY split ORDER BY h, essay_id_comp, discourse_start, evidence))
SELECT split, essay_id_comp, claim, evidence, 1 AS is_evidence FROM p UNION ALL SELECT split, essay_id_comp, other, evidence, 0 FROM n WHERE other <> claim""",
    "group_split": f"SELECT conv_id, turn, {_split('CAST(conv_id AS VARCHAR)')} AS split FROM conversations",
    "split_totals": f"SELECT split, count(*) AS n FROM (SELECT {_split('CAST(doc_id AS VARCHAR)')} AS split FROM documents) GROUP BY ROLLUP (split)",
    "stratified_split": """
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) / 2.0) THEN 'validation' ELSE 'testing' END AS split FROM labels""",
    "seeded_sample": "SELECT doc_id, n_chars FROM documents ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100",
    "nonempty_filter": f"SELECT doc_id, n_chars FROM documents WHERE {_strip('text')} <> '' AND {_strip('lang')} <> '' AND len({_words('text')}) >= 4",
    "rare_class_filter": "WITH d AS (SELECT doc_id, lang || '/' || source AS class FROM documents) SELECT doc_id, class FROM d WHERE class IN (SELECT class FROM d GROUP BY class HAVING count(*) >= 3)",
    "frame_histogram": f"SELECT {_frame('label')} AS frame, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, frame LIMIT 3",
    "label_balance": "SELECT CAST(coalesce(sum(toxic), 0) AS BIGINT) AS positives, CAST(count(*) - coalesce(sum(toxic), 0) AS BIGINT) AS negatives FROM labels",
    "union_corpora": "SELECT 'documents' AS origin, doc_id AS id, sha256(text) AS sha FROM documents UNION ALL SELECT 'benchmark', item_id, sha256(text) FROM benchmark",
    "set_operations": """
WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT 'union' AS op, doc_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', doc_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'difference', doc_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "set_metrics": _set("claim || '|' || evidence", "claim || '|' || evidence"),
    "pair_metrics": _set("least(claim, evidence) || '|' || greatest(claim, evidence)", "least(evidence, claim) || '|' || greatest(evidence, claim)"),
    "confusion": f"{_CELLS} SELECT y_true, y_pred, n FROM cells",
    "class_metrics": f"{_CELLS} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cm",
    "summary_metrics": f"""{_CELLS}, a AS (SELECT CAST(sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM cells)
SELECT round(accuracy, 6) AS accuracy, round(accuracy, 6) AS micro_f1, (SELECT round(avg(f1), 6) FROM cm) AS macro_f1, (SELECT round(avg(precision), 6) FROM cm) AS macro_precision, (SELECT round(avg(recall), 6) FROM cm) AS macro_recall, n FROM a""",
    "corpus_normalise": _NORMALISED,
    "golden_arguments": f"WITH {_GOLD} SELECT id AS arg_id, id AS document_id, CAST(0 AS INTEGER) AS evidence_pos, claim, evidence FROM g WHERE claim IS NOT NULL AND evidence <> ''",
    "golden_texts": "SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS title, sha256(text) AS sha FROM conversations",
    "related_pairs": f"""WITH {_GOLD} SELECT p.id AS a, q.id AS b, p.claim AS claim_a, p.evidence AS evidence_a, q.claim AS claim_b, q.evidence AS evidence_b
FROM g q JOIN g p ON p.id = q.before WHERE q.claim <> '' AND q.evidence <> ''""",
    "record_errors": f"""WITH {_GOLD}, r AS (
  SELECT conv_id, before AS a, CASE WHEN turn % 7 = 3 THEN 'supports' ELSE 'contradicts' END AS type, id AS b, false AS loose FROM g WHERE claim <> '' AND evidence <> '' AND before IS NOT NULL
  UNION ALL SELECT conv_id, id, 'contradicts', id + 500000, true FROM g WHERE turn % 6 = 5
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY a, type, b) - 1 AS place FROM r)
SELECT 'argument' AS kind, id, 'evidence must not be empty' AS error FROM g WHERE claim IS NOT NULL AND evidence = ''
UNION ALL SELECT 'argument', id, 'unknown document' FROM g WHERE claim IS NOT NULL AND turn % 5 = 4
UNION ALL SELECT 'relation', place, 'type must be contradicts' FROM n WHERE type <> 'contradicts'
UNION ALL SELECT 'relation', place, 'unknown argument' FROM n WHERE loose
UNION ALL SELECT 'relation', place, 'unknown argument' FROM n WHERE loose AND a IN (SELECT id FROM g WHERE claim IS NULL)
UNION ALL SELECT 'document', id, 'text is missing' FROM g WHERE text IS NULL""",
    "frame_join": """
WITH s AS (SELECT a.vec_id AS id, a.label, b.vec_id AS cand, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b USING (label) WHERE b.label < 8),
r AS (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY s, cand) AS rk FROM s),
f AS (SELECT id, string_agg('c' || cand || '/e' || cand, ',' ORDER BY rk) AS found FROM r WHERE rk <= 3 GROUP BY id)
SELECT vec_id AS id, label, coalesce(found, '') AS found FROM embeddings LEFT JOIN f ON f.id = vec_id""",
    "vector_lookup": "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, len(embedding) AS n FROM embeddings",
    "probability_lookup": f"""
WITH e AS (SELECT vec_id, CAST(embedding[1:15] AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id, list_transform(v, lambda y: exp(y - list_max(v))) AS e FROM e)
SELECT vec_id, {_frame("list_position(e, list_max(e)) - 1")} AS frame, round(e[1] / list_sum(e), 6) AS p FROM x""",
    "frame_corpus": "SELECT sha256(text) AS sha, doc_id % 15 AS interpretative_frame FROM documents WHERE doc_id % 7 > 0 AND text IS NOT NULL",
    "head_rows": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 50",
    "known_frames": f"SELECT vec_id, {_frame('label')} AS frame FROM embeddings WHERE label < 9",
    "one_frame": f"SELECT vec_id, {_frame('label')} AS primary_frame FROM embeddings WHERE label = 2",
    "frame_table": f"SELECT CAST(unnest(range(15)) AS INTEGER) AS frame_idx, CAST(unnest(range(1, 16)) AS INTEGER) AS label, unnest({_FRAMES}) AS frame",
    "phrase_keywords": f"""
WITH t AS (SELECT item_id, text, {_tokens("text")} AS t FROM benchmark),
g AS (SELECT item_id, text, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM t),
x AS (SELECT item_id, text, unnest(g) AS keyword, unnest(range(len(g))) AS place FROM g), d AS (SELECT item_id, keyword, any_value(text) AS text, min(place) AS place FROM x GROUP BY item_id, keyword),
s AS (SELECT item_id, keyword, place, list_dot_product({_LETTERS.format("text")}, {_LETTERS.format("keyword")}) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, place) AS rk FROM s) SELECT item_id, CAST(rk AS INTEGER) AS rank, keyword, score FROM r WHERE rk <= 5""",
    "split_pairs": f"WITH a AS (SELECT doc_id, quality, {_split('CAST(doc_id AS VARCHAR)')} AS split FROM labels WHERE toxic = 1) SELECT a.split, a.doc_id AS doc_id_1, a.quality AS quality_1, b.doc_id AS doc_id_2, b.quality AS quality_2 FROM a JOIN a b USING (split)",
    "cleaned_pairs": f"WITH {_TURNS} SELECT conv_id, id, claim, evidence FROM a WHERE {_strip('claim')} <> '' AND {_strip('evidence')} <> ''",
    "cosine_distances": "SELECT a.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "positivity": "SELECT doc_id, round(CAST(CASE WHEN toxic = 1 THEN 0.0 WHEN quality = 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) * (doc_id % 10 / CAST(10 AS DOUBLE)), 6) AS positivity FROM labels",
    "style_checks": r"""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '... !' ELSE text END AS t FROM documents), w AS (SELECT doc_id, t, len(regexp_extract_all(coalesce(t, ''), '[\p{L}\p{N}_]+')) AS n FROM t)
SELECT doc_id, n AS words, CASE WHEN t IS NULL OR t = '' THEN 'empty text' WHEN n = 0 THEN 'no words' END AS error, CASE WHEN n > 0 AND n < 100 THEN 'only ' || n || ' words' END AS warning FROM w""",
}
