"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import html.parser
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def near_duplicates(rows):
    """doc_id -> (set size, component)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = Counter((m[b], m[a]) for m in holders.values() for a in range(len(m)) for b in range(a))
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    low = {}
    for i in sets:
        low[find(i)] = min(i, low.get(find(i), i))
    return {i: (len(sets[i]), low[find(i)]) for i in sets}


def repeated_bytes(rows, length=100):
    """(doc_id, bytes, removed, spans, hash of the rest), smaller ids first; null ids come before all."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        hit, names = set(), set()
        for n in sorted({len(k) for k in windows}):
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[g]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v if v < 10 else v - 9
    return total % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and _luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                found.append((m.start(), k, m.end()))
    found.sort()
    counts = tuple(sum(s[1] == k for s in found) for k in range(4))
    return counts, hashlib.sha256(",".join(f"{list(KINDS)[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def top_k(rows, k=10):
    good = [(i, np.floor(np.array(v, float) * 1024).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 100 == 0:
            best = sorted((-int(q @ x), j) for j, x in good if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


BREAKS = set("article blockquote dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre section table td th tr ul".split())
#: Elements and classes whose content is not main text, in the shared pages.
OUT = set("nav footer aside form script style".split())


class _Article(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.now, self.blocks = False, [], [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        self.now = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in BREAKS:
            self.cut()
        if tag == "br":
            self.now.append(" ")
        if self.out and tag == self.out[0]:
            self.out.append(tag)
        elif not self.out and (tag in OUT or any(k == "class" and re.search("comment|advert|^ad$|share|related", v or "") for k, v in attrs)):
            self.out.append(tag)

    def handle_endtag(self, tag):
        if self.out and tag == self.out[0]:
            self.out.pop()
        if tag in BREAKS:
            self.cut()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside and not self.out:
            self.now.append(data)


def article_text(page):
    """The text of a page's article element by the standard library's parser."""
    p = _Article()
    p.feed(page)
    p.close()
    p.cut()
    return "\n".join(p.blocks)
