"""Repeated 100-byte strings over a corpus, after prefix-free parsing.

Parse: a rolling hash over TRIGGER bytes marks triggers; a window of ``length`` bytes belongs to its
smallest rolling hash (leftmost on ties), so equal windows have equal triggers at equal places.  A phrase
is a maximal run of windows with one trigger, and its text runs from the first window's start to the last
window's end: overlapping phrases cover a document, and equal passages are cut alike wherever they stand.

Corpus order: the parse's suffixes, each cut where its phrase's text ends, are sorted by fingerprint:
(trigger, phrase text), then document and place.  All but the first of equal phrase texts repeat wholly.
Only a trigger with several phrase texts (the edge of a repeated passage) needs the dictionary's own
suffixes: there the windows of each phrase text's first place are sorted, again by fingerprint, and all
but the first of equal windows repeat.  Equal neighbours are what both suffix arrays are read for, and any
total order puts equal strings side by side, so fingerprints stand for the strings' own order, and no
phrase or group of copies ever has to be in one task.  Phrases are compared by 96 bits beside the 32 of
their trigger, windows by 128; bytes are not compared again.

Order of places: smaller id, then (for rows of one id with different texts) a hash of the text, then
start.  Rows equal in id and text are one document and get equal results.  A null id sorts first.  Null
and empty texts, and texts shorter than ``length``, lose nothing.  Texts are parsed in parts of CHUNK
bytes that continue each other's phrases, so a very long one takes the memory of a part beside its own
bytes.  A task remembers SEEN phrases, so that of many copies it sends on one.  An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release_shuffles, small_batches

TRIGGER = 24
CHUNK = 1 << 17
#: Bytes of a stretch hashed as one sum.
PLAIN = 512
_NULL = -(1 << 63)
_BASE = 0xD1342543DE82EF95
_RNG = np.random.default_rng(77)
_CODE = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_ROWS = "route long, p binary"
_SPANS = "id long, h long, a int, b int, kind byte"
PLACE, REMOVED, ASK = 0, 1, 2
#: Phrases that a task remembers (a table by hash, the latest stays): a power of two.
SEEN = 1 << 17
#: Big-endian fields of a row's bytes, so that rows sort by kind, e, f, id, h, t: name -> (offset, width).
#: A place's stretch runs from t - back on for ``many`` bytes; a removed one from t on for e bytes.
_FIELDS = {"kind": (0, 1), "e": (1, 8), "f": (9, 4), "id": (13, 8), "h": (21, 8), "t": (29, 5), "back": (34, 2), "many": (36, 2), "left": (38, 2), "right": (40, 2)}
_WIDTH = 42
_TEXT, _FROM = slice(1, 13), slice(13, 34)
_POWER: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWER or len(_POWER[0]) < n:
        _POWER[:] = [np.full(max(n, CHUNK + (1 << 18)), np.uint64(b)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for a in _POWER:
            a[0] = 1
            np.multiply.accumulate(a, out=a)
    return _POWER[0], _POWER[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


class Bytes:
    """Concatenated texts with prefix sums, from which the hash of any stretch follows."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.power, inverse = _powers(len(raw) + 1)
        self.sums = []
        for code in _CODE:
            s = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(code[raw] * inverse[: len(raw)], out=s[1:])
            self.sums.append(s)

    def hash(self, a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
        """Hashes of the stretches a to b.  Sums of powers modulo 2**64 clash for some stretches of a
        thousand bytes, so those of over PLAIN are mixed part by part."""
        s = self.sums[which]
        stop = np.minimum(b, a + PLAIN)
        out = _mix((s[stop] - s[a]) * self.power[a])
        more = np.flatnonzero(b > stop)
        while len(more):
            lo = stop[more]
            stop[more] = hi = np.minimum(b[more], lo + PLAIN)
            out[more] = _mix(out[more] * np.uint64(_BASE) + (s[hi] - s[lo]) * self.power[lo])
            more = more[b[more] > hi]
        return out


def phrases(texts: Bytes, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Document's number, trigger, first window's start and last window's end of each phrase."""
    trigger = min(TRIGGER, length)
    n, wide = len(texts.raw), length - trigger + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if n < length:
        return none
    m = n - trigger + 1
    s = texts.sums[0]
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    v = _mix((s[trigger:] - s[:m]) * texts.power[:m])
    v = (v & ~low) | np.arange(m, dtype=np.uint64)
    step = 1
    while step * 2 <= wide:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if step < wide:
        v = np.minimum(v[: len(v) - (wide - step)], v[wide - step :])
    # v[p]: the least packed hash of window p; windows that leave their document are dropped
    size = end - begin
    many = np.maximum(size - length + 1, 0)
    doc = np.repeat(np.arange(len(begin)), many)
    if not len(doc):
        return none
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    t = (v[at] & low).astype(np.int64)
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(t)) - 1
    return doc[first], t[first], at[first], at[last] + length


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the stretches of each document."""
    by = np.lexsort((a, doc))
    doc, a, b = doc[by], a[by], b[by]
    if not len(doc):
        return doc, a, b
    shift = doc.astype(np.int64) * (1 << 34)  # stretches of different documents never meet
    reach = np.maximum.accumulate(b + shift)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], a[first], reach[np.append(first[1:], len(a)) - 1] - shift[first]


def _pack(n: int, **values: np.ndarray) -> np.ndarray:
    """Rows of bytes."""
    out = np.zeros((n, _WIDTH), np.uint8)
    for name, v in values.items():
        at, wide = _FIELDS[name]
        v = np.asarray(v)
        if name == "id":
            v = v.astype(np.int64) ^ np.int64(_NULL)
        u = v if v.dtype == np.uint64 else v.astype(np.int64).view(np.uint64)
        out[:, at : at + wide] = np.ascontiguousarray(u.astype(">u8")).view(np.uint8).reshape(n, 8)[:, 8 - wide :]
    return out


def _field(rows: np.ndarray, name: str) -> np.ndarray:
    at, wide = _FIELDS[name]
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, 8 - wide :] = rows[:, at : at + wide]
    v = out.view(">u8").reshape(-1).astype(np.uint64).view(np.int64)
    return v ^ np.int64(_NULL) if name == "id" else v


def _record(route: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(0, (len(rows) + 1) * _WIDTH, _WIDTH, dtype=np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])
    return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), binary], names=["route", "p"])


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(1)
    start = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[start[0] : start[-1]]
    return np.asarray(batch.column(0)), data.reshape(-1, _WIDTH)


class Seen:
    """Phrases that a task has sent on, with their places; of a later copy only the removal is sent."""

    def __init__(self):
        self.rows = [np.zeros(SEEN, np.uint64) for _ in range(3)]  # x, e, f; x is 0 where nothing is held
        self.place = [np.zeros(SEEN, np.int64) for _ in range(3)]  # id, h, t

    def again(self, key: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> np.ndarray:
        """Which rows come after a place of the same phrase that has been sent; the others are remembered."""
        slot = ((key[0] ^ key[1]) & np.uint64(SEEN - 1)).astype(np.int64)
        same = key[0] != 0
        for mine, theirs in zip(self.rows, key):
            same &= mine[slot] == theirs
        after, tied = np.zeros(len(slot), bool), np.ones(len(slot), bool)
        for mine, theirs in zip(self.place, place):
            after |= tied & (theirs > mine[slot])
            tied &= theirs == mine[slot]
        out = same & after
        new = np.flatnonzero(~out)
        for mine, theirs in zip([*self.rows, *self.place], [*key, *place]):
            mine[slot[new]] = theirs[new]
        return out


def _local(x, e, f, ids, hs, doc, t, a, b, left=None, right=None, seen: Seen | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of one batch: the first place of each (x, e, f), and what the others remove, merged."""
    x, f = x >> np.uint64(32), f & np.uint64(0xFFFFFFFF)
    by = np.lexsort((t, hs[doc], ids[doc], f, e, x))
    x, e, f, doc, t, a, b = (v[by] for v in (x, e, f, doc, t, a, b))
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (e[1:] != e[:-1]) | (f[1:] != f[:-1])
    group = np.cumsum(first) - 1
    head = np.flatnonzero(first)[group]
    again = ~first & ((ids[doc] != ids[doc[head]]) | (hs[doc] != hs[doc[head]]) | (t != t[head]))
    keep = np.flatnonzero(first)
    if seen is not None and len(keep):
        held = seen.again((x[keep], e[keep], f[keep]), (ids[doc[keep]], hs[doc[keep]], t[keep]))
        again[keep[held]] = True
        keep = keep[~held]
    more = {} if left is None else {"left": left[by][keep], "right": right[by][keep]}
    yield _record(x[keep], _pack(len(keep), e=e[keep], f=f[keep], id=ids[doc[keep]], h=hs[doc[keep]], t=t[keep], back=t[keep] - a[keep], many=b[keep] - a[keep], **more))
    d, a, b = _merged(doc[again], a[again], b[again])
    if len(d):
        with np.errstate(over="ignore"):
            route = (ids[d] * np.int64(-7046029254386353131)) ^ hs[d]
        yield _record(route, _pack(len(d), kind=np.full(len(d), REMOVED), id=ids[d], h=hs[d], t=a, e=b - a))


def _parts(texts: list[bytes], chunk: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text's number, first byte, end) of about ``chunk`` bytes in all; a longer text has the last
    part of a list to itself, which the caller continues."""
    held, n = [], 0
    for k, text in enumerate(texts):
        if held and n + len(text) > chunk:
            yield held
            held, n = [], 0
        held.append((k, 0, len(text)))
        n += len(text)
    if held:
        yield held


def _phrase_rows(texts: list[bytes], part: list[tuple[int, int, int]], length: int) -> tuple[np.ndarray, ...]:
    """Rows (x, e, f, doc, t, a, b, left, right) of the phrases of windows in stretches of texts."""
    width = min(TRIGGER, length)
    half = (length - width) // 2
    doc_of, lo, hi = (np.array(v) for v in zip(*part))
    full = np.array([len(texts[k]) for k in doc_of])
    from_, to = np.maximum(lo - half, 0), np.minimum(hi + half, full)  # with what may stand beside a trigger
    size = to - from_
    base = np.cumsum(size) - size
    data = Bytes(np.frombuffer(b"".join(texts[k][i:j] for k, i, j in zip(doc_of, from_, to)), np.uint8))
    own, t, a, b = phrases(data, base + lo - from_, base + hi - from_, length)
    x = data.hash(t, t + width, 1)
    e = _mix(data.hash(a, b, 0) + (t - a).astype(np.uint64) * np.uint64(_BASE) + (b - a).astype(np.uint64))
    f = data.hash(a, b, 1)
    sides = []
    for lo_at, hi_at in ((t - half, t + width), (t, t + width + half)):
        fits = (lo_at >= base[own]) & (hi_at <= (base + size)[own])
        side = data.hash(np.where(fits, lo_at, base[own]), np.where(fits, hi_at, base[own]), 1) >> np.uint64(48)
        sides.append(np.where(fits, np.maximum(side, np.uint64(1)), np.uint64(0)))
    shift = (from_ - base)[own]
    return (x, e, f, doc_of[own], t + shift, a + shift, b + shift, *sides)


def _parse(length: int, chunk: int):
    def rows_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        for part in _parts(texts, chunk):
            k, lo, end = part[0]
            if end <= chunk:
                yield _phrase_rows(texts, part, length)
                continue
            while lo < end:  # its last phrase may go on: the next part starts with it
                hi = min(end, lo + max(chunk, 8 * length))
                got = _phrase_rows(texts, [(k, lo, hi)], length)
                if hi < end:
                    got = tuple(v[:-1] for v in got) if len(got[0]) > 1 else got
                    lo = int(got[6][-1]) - length + 1  # the window after the last one of the rows
                else:
                    lo = end
                yield got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            ids, hs = (np.asarray(batch.column(k)) for k in (0, 1))
            held: list[tuple[np.ndarray, ...]] = []
            for got in rows_of(batch.column(2).to_pylist()):
                held.append(got)
                if sum(len(g[0]) for g in held) * 30 > 8 * chunk:
                    yield from emit(held, ids, hs, seen)
                    held = []
            if held:
                yield from emit(held, ids, hs, seen)

    def emit(held, ids, hs, seen) -> Iterator[pa.RecordBatch]:
        x, e, f, doc, t, a, b, left, right = (np.concatenate(v) for v in zip(*held))
        if len(x):
            yield from _local(x, e, f, ids, hs, doc, t, a, b, left, right, seen)

    return run


def _stretches(asks: np.ndarray, chunk: int) -> Iterator[np.ndarray]:
    """Rows (a, b), in order of a, that lie within ``chunk`` bytes."""
    i = 0
    while i < len(asks):
        j = max(i + 1, int(np.searchsorted(asks[:, 0], asks[i, 0] + chunk)))
        yield asks[i:j]
        i = j


def _windows(length: int, chunk: int):
    """Windows that start in the asked stretches, as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = (np.asarray(batch.column(k)) for k in (0, 1))
            for i in range(batch.num_rows):
                raw = np.frombuffer(_unzipped(batch.column(2)[i].as_py(), batch.column(3)[i].as_py()), np.uint8)
                asks = batch.column(4)[i].values
                asks = np.stack([np.asarray(asks.field(0)), np.asarray(asks.field(1))], 1).astype(np.int64)
                for part in _stretches(asks[np.argsort(asks[:, 0], kind="stable")], chunk):
                    lo = int(part[0, 0])
                    data = Bytes(raw[lo : int(part[:, 1].max())])
                    wanted = np.zeros(len(data.raw) + 1, np.int64)
                    np.add.at(wanted, part[:, 0] - lo, 1)
                    np.add.at(wanted, part[:, 1] - lo - length + 1, -1)
                    p = np.flatnonzero(np.cumsum(wanted) > 0)
                    x, e = data.hash(p, p + length, 1), data.hash(p, p + length, 0)
                    yield from _local(x, e, x, ids, hs, np.full(len(p), i), p + lo, p + lo, p + lo + length)

    return run


def _shared(route: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Rows whose (route, side) another row has; side 0 is none."""
    by = np.lexsort((side, route))
    r, v = route[by], side[by]
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1]) & (v[1:] != 0)
    out = np.zeros(len(r), bool)
    out[by[1:][same]] = True
    out[by[:-1][same]] = True
    return out


def _read_order(ask: bool, length: int):
    """Read rows in order of (route, kind, e, id, h, t): what is not the first of its (route, e) is removed.

    With ``ask``, the first places of a route with several e are asked about if they share the bytes on the
    left or on the right of the trigger: a window has half of its other bytes on one side, so only windows
    with a shared side are asked for.  (Of a route that runs over a batch's end, all are.)  Keeps one open
    route's state."""

    half = (length - min(TRIGGER, length)) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None  # of the open route: its first row, and the first row of its last e
        asked_open = False
        names = ["id", "h", "a", "b", "kind"]

        def record(rows: np.ndarray, kind: int, sides: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
            t = _field(rows, "t")
            a = t - _field(rows, "back")
            b = a + _field(rows, "e" if kind < 0 else "many")
            if sides is not None:  # windows from t - half on do not hold the left side, those before not the right one
                a = np.where(sides[0], a, np.maximum(a, t - half + 1))
                b = np.where(sides[1], b, np.minimum(b, t - half + length))
                some = b - a >= length
                rows, a, b = rows[some], a[some], b[some]
            return pa.RecordBatch.from_arrays([pa.array(_field(rows, "id")), pa.array(_field(rows, "h")), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.full(len(rows), abs(kind)), pa.int8())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            route, rows = _rows_of(batch)
            local = rows[:, 0] == REMOVED
            if local.any():
                yield record(rows[local], -REMOVED)
                route, rows = route[~local], rows[~local]
            if not len(route):
                continue
            ghosts = 0
            if held is not None and held[0][0] == route[0]:
                ghosts = len(held[0])
                route, rows = np.concatenate([held[0], route]), np.concatenate([held[1], rows])
            else:
                asked_open = False
            n = len(route)
            new_route = np.ones(n, bool)
            new_route[1:] = route[1:] != route[:-1]
            first = new_route.copy()
            first[1:] |= (rows[1:, _TEXT] != rows[:-1, _TEXT]).any(1)
            head = np.flatnonzero(first)[np.cumsum(first) - 1]
            again = np.flatnonzero(~first)
            again = again[(rows[again, _FROM] != rows[head[again], _FROM]).any(1)]
            again = again[again >= ghosts]
            if len(again):
                yield record(rows[again], REMOVED)
            if ask:
                run_at = np.flatnonzero(new_route)
                several = np.add.reduceat(first.astype(np.int64), run_at) > 1
                want = first & np.repeat(several, np.diff(np.append(run_at, n)))
                closed = np.arange(n) < run_at[-1]
                if ghosts:  # a ghost was asked about before if its route had several e then
                    want[:ghosts] &= not asked_open
                    closed[: run_at[1] if len(run_at) > 1 else n] = False
                left, right = want.copy(), want.copy()
                pick = np.flatnonzero(want & closed)
                if len(pick):
                    left[pick] = _shared(route[pick], _field(rows[pick], "left"))
                    right[pick] = _shared(route[pick], _field(rows[pick], "right"))
                    want = left | right
                if want.any():
                    yield record(rows[want], ASK, (left[want], right[want]))
                asked_open = bool(several[-1]) or (asked_open and ghosts > 0 and len(run_at) == 1)
            keep = sorted({int(np.flatnonzero(new_route)[-1]), int(head[-1])})
            held = (route[keep], rows[keep])

    return run


def _ordered(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "route").sortWithinPartitions("route", "p")


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way: (id, h, text) to (id, h, z, n)."""
    codec = pa.Codec("zstd", 1)
    for b in batches:
        texts = b.column(2).to_pylist()
        z = pa.array([codec.compress(t, asbytes=True) if t else b"" for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z, pa.array([len(t) for t in texts], pa.int64())], names=["id", "h", "z", "n"])


def _unzipped(z: bytes, n: int) -> bytes:
    return pa.Codec("zstd").decompress(z, n, asbytes=True) if n else b""


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, z, n, gone) to (id, n_bytes, spans, kept): the stretches merged, and the bytes outside them."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        spans, kept = [], []
        for z, n, gone in zip(batch.column(1), batch.column(2), batch.column(3)):
            text, merged = _unzipped(z.as_py(), n.as_py()), []
            if gone.is_valid:
                v = gone.values
                a, b = np.asarray(v.field(0)), np.asarray(v.field(1))
                _, a, b = _merged(np.zeros(len(a), np.int64), a, b)
                merged = list(zip(a.tolist(), b.tolist()))
            at, out = 0, []
            for a, b in merged:
                out.append(text[at:a])
                at = b
            kept.append(b"".join([*out, text[at:]]))
            spans.append([{"a": a, "b": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def repeated(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: id, n_bytes, spans (array of byte stretches (a, b) to remove: maximal, in order), kept (the other bytes)."""
    if not 2 <= length <= 30_000:
        raise ValueError("length must be 2 to 30000")
    spark = docs.sparkSession
    small_batches(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL).cast("long"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    unique = not docs.groupBy(key.alias("id")).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    src = docs.select(key.alias("id"), (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("h"), text.cast("binary").alias("text"))
    texts = src.mapInArrow(_zipped, "id long, h long, z binary, n long")
    rows = src.filter(F.octet_length("text") >= length).mapInArrow(_parse(length, chunk), _ROWS)
    spans = materialise(_ordered(rows).mapInArrow(_read_order(True, length), _SPANS), "spans")
    release_shuffles(spark)

    asks = spans.filter(F.col("kind") == ASK).groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("asks"))  # a document's own phrases
    edges = texts.filter(F.col("n") >= length).join(asks, ["id", "h"]).select("id", "h", "z", "n", "asks")
    if not unique:
        edges = edges.dropDuplicates(["id", "h"])
    windows = materialise(_ordered(edges.mapInArrow(_windows(length, chunk), _ROWS)).mapInArrow(_read_order(False, length), _SPANS), "windows")
    release_shuffles(spark)
    gone = spans.filter(F.col("kind") == REMOVED).union(windows).groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    out = texts.join(gone, ["id", "h"], "left").select("id", "z", "n", "gone").mapInArrow(_kept, "id long, n_bytes long, spans array<struct<a:int,b:int>>, kept binary")
    own = F.when(F.col("id") != _NULL, F.col("id")).cast(docs.schema[id_col].dataType)
    return out.select(own.alias(id_col), "n_bytes", "spans", "kept")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
