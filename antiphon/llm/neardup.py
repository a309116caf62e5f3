"""Near-duplicate groups: MinHash signatures, a multi-index Hamming join, and full-set confirmation.

A document's set holds its distinct shingles of ``SHINGLE`` words.  Its signature has SYMBOLS b-bit
MinHash values in CHUNKS chunks.  Two signatures whose distance (symbols that differ) is below
CHUNKS * (ERRORS + 1) have a chunk with at most ERRORS errors (pigeonhole), and share the key that leaves
those symbols out; so all pairs under that distance meet.  The same distance is what a pair must keep to
be confirmed: no pair at the similarity threshold misses it but with a probability of 1.2e-7.

Equal sets are one representative, their smallest id.  Keys that only one representative has drop out.
No bucket's or group's pairs are emitted:

1. A bucket's lead is the member with most companions over all of its keys.  Every representative is
   compared with the lead it shares most keys with; pairs within the distance are connected.
2. Buckets that still hold several components are compared by blocks of signatures; a spanning forest of
   the pairs within the distance connects them.  Every pair that could be similar now lies in one cluster.
3. A cluster's texts are dealt into blocks, its smallest id to each of them.  Within each block common
   shingles are counted on full sets, and a spanning forest of the confirmed links is emitted.
4. Of clusters that now have several components all but the largest component are compared, block by
   block, with each other and with the largest: those are the pairs that could still connect two.

Joins on keys, on equal sets and on clusters deal hot values over tasks.  A block holds about TEXT_BLOCK
texts and BLOCK_SHINGLES shingles; one text's set must fit a task.

Null, empty and blank texts have an empty set: linked with nothing, and their own component.  Fewer than
``SHINGLE`` words make one shingle.  A row with a null id takes no part: its component is null and it is
kept.  Rows with equal ids are one document if their texts are, else each links for the id.  An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release_shuffles, salted_join, small_batches
from .components import components

SHINGLE = 5
SYMBOLS, CHUNKS, ERRORS = 96, 24, 1
BITS = 16
#: Least symbols that agree where the distance is below what the pigeonhole guarantees.
AGREE = SYMBOLS - CHUNKS * (ERRORS + 1) + 1
#: Members of a block of signatures, of texts round a lead, and of texts compared with other blocks.
BLOCK, STAR_BLOCK, TEXT_BLOCK = 256, 64, 256
BLOCK_SHINGLES = 400_000
#: Bytes of a text hashed at once.
PART = 1 << 18
#: Words of more bytes are hashed one by one: sums of powers modulo 2**64 clash for some words of a thousand.
LONG_WORD = 64
#: Columns of shingles counted at once.
COLUMNS = 4_096

_RNG = np.random.default_rng(2024)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_FLIP = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        _POWERS[:] = [np.full(size, np.uint64(b)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for a in _POWERS:
            a[0] = 1
            np.multiply.accumulate(a, out=a)
    return _POWERS[0], _POWERS[1]


def _words(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of lower-case bytes, in order."""
    word = ~_SPACE[raw]
    if not word.any():
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * inverse[: len(raw)], out=total[1:])
    out = _mix((total[end] - total[start]) * power[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z as a-z, words by ASCII white space)."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    parts, at = [], 0
    while at < len(raw):
        end = at + PART
        while end < len(raw) and not _SPACE[raw[end]]:  # parts end between words
            gap = np.flatnonzero(_SPACE[raw[end : end + 4096]])
            end = min(len(raw), end + (int(gap[0]) if len(gap) else 4096))
        parts.append(_words(raw[at:end]))
        at = end
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out += words[k : k + n] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return np.unique(_mix(out + np.uint64(min(size, len(words)))))


def signature(s: np.ndarray) -> np.ndarray:
    """The low BITS bits of SYMBOLS minimum hashes."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        v = np.multiply.outer(_ODD, low[k : k + 4096])
        v ^= _FLIP[:, None]
        np.minimum(best, v.min(1), out=best)
    return (_mix(best.astype(np.uint64) + (np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(32))) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def keys(sig: np.ndarray) -> np.ndarray:
    """A row of keys per signature: for each chunk, one for each symbol left out (ERRORS is 1)."""
    per = SYMBOLS // CHUNKS
    term = _mix(sig.astype(np.uint64) + (np.arange(SYMBOLS, dtype=np.uint64)[None] << np.uint64(BITS)))
    total = term.reshape(len(sig), CHUNKS, per).sum(2, dtype=np.uint64)
    left = np.repeat(total, per, axis=1) - term
    return _mix(left + np.arange(SYMBOLS, dtype=np.uint64)[None] * np.uint64(_BASE))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, n, h1, h2, sig): the set's size, a 128-bit hash of it, its signature."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(_mix(s ^ np.uint64(_BASE)).sum(dtype=np.uint64).view(np.int64)))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "h1", "h2", "sig"])

    return src.mapInArrow(run, "id long, n long, h1 long, h2 long, sig binary")


def _key_rows(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(keys(sig).view(np.int64).ravel()), pa.array(np.repeat(np.asarray(part.column(0)), SYMBOLS))], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _under_distance(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose signatures agree enough."""
    side = reps.select("rep", "n", "sig")
    got = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    got = got.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in (2, 3))
                near = pa.array((x == y).sum(1) >= AGREE)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["a", "b"])

    return got.mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` (key, m: its members, rep, ...) with ``own`` block and block pair (lo, hi), ordered within
    tasks by group: a member meets each block of its key once."""
    blocks = rows.withColumn("nb", F.ceil(F.col("m") / size).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb").cast("long")).cast("int"))
    out = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("m", "nb", "other")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "rep")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first three columns, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(3)], 1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        bounds = [0, *cut.tolist(), len(k)]
        for lo, hi in zip(bounds, bounds[1:]):
            now = tuple(k[lo])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _edges(rep: np.ndarray, a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rep[a], pa.int64()), pa.array(rep[b], pa.int64())], names=["a", "b"])


def _signature_forest(members: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the components of a bucket by agreeing signatures."""
    now = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.count("*").alias("m")).filter("first < last").select("key", "m")
    rows = _dealt(salted_join(now, mixed, ["key"], "m", members.count(), "rep").join(reps.select("rep", "sig"), "rep"), "key", BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            rep, comp, own = (t.column(k).to_numpy() for k in (3, 4, 5))
            sig = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            within = t.column(1)[0].as_py() == t.column(2)[0].as_py()
            label, a, b = comp.copy(), [], []
            for i in range(len(rep)):
                j = np.flatnonzero((label != label[i]) if within else (label != label[i]) & (own != own[i]))
                j = j[(sig[j] == sig[i]).sum(1) >= AGREE]
                for x in np.unique(label[j], return_index=True)[1].tolist():
                    a.append(i)
                    b.append(int(j[x]))
                if len(j):
                    label[np.isin(label, label[j])] = label[i]
            if a:
                yield _edges(rep, a, b)

    return rows.select("key", "lo", "hi", "rep", "comp", "own", "sig").mapInArrow(run, "a long, b long").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, counted over the shingles that two sets or more have."""
    n = len(sets)
    every = np.concatenate(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, many = np.unique(every, return_inverse=True, return_counts=True)
    keep = many[column] > 1
    new = np.cumsum(many > 1) - 1
    column, doc = new[column[keep]], doc[keep]
    by = np.argsort(column, kind="stable")
    column, doc = column[by], doc[by]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        part = np.zeros((n, min(COLUMNS, int(column[j - 1]) - lo + 1)), np.float32)
        part[doc[i:j], column[i:j] - lo] = 1
        out += part @ part.T
    return out


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    n = np.array([len(s) for s in sets])
    both = _common(sets)
    return 100 * both >= percent * (n[:, None] + n[None] - both)


def _blocks(rows: str, shingles: str, most: int = TEXT_BLOCK):
    return F.ceil(F.greatest(F.col(rows) / most, F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _grouped(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep")


def _links_within(members: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b), confirmed on full sets, that span what is linked within each block of a cluster and
    its smallest id.  ``members``: (key, rep, m, w, text): a cluster's rows, how many, and their shingles."""
    nb = _blocks("m", "w", STAR_BLOCK)
    own = F.array(F.pmod(F.xxhash64("rep"), nb.cast("long")).cast("int"))
    rows = members.withColumn("lo", F.explode(F.when(F.col("rep") == F.col("key"), F.sequence(F.lit(0), nb - 1)).otherwise(own)))
    rows = _grouped(rows.withColumn("hi", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            rep = t.column(3).to_numpy()
            linked = _linked([shingles(x.as_py(), size) for x in t.column(4)], percent)
            np.fill_diagonal(linked, False)
            free, a, b = np.ones(len(rep), bool), [], []
            for seed in range(len(rep)):
                if not free[seed]:
                    continue
                free[seed], todo = False, [seed]
                while todo:
                    i = todo.pop()
                    near = np.flatnonzero(linked[i] & free).tolist()
                    free[near] = False
                    a += [i] * len(near)
                    b += near
                    todo += near
            if a:
                yield _edges(rep, a, b)

    return rows.select("key", "lo", "hi", "rep", "text").mapInArrow(run, "a long, b long")


def _links_between(members: DataFrame, labels: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) between different components of one cluster; ``members``: (key, rep, n, text, ...), ``labels``: (id, comp)."""
    now = materialise(members.select("key", "rep", "n").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp")), "now")
    parts = now.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    top = parts.groupBy("key").agg(F.max(F.struct("m", "w", "comp")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.count("*").alias("comps")).filter("comps > 1")
    top = top.select("key", "m", F.col("top.comp").alias("most"), F.col("top.m").alias("tm"), F.col("top.w").alias("tw"), (F.col("m") - F.col("top.m")).alias("rm"), (F.col("w") - F.col("top.w")).alias("rw"))
    rest, big = _blocks("rm", "rw"), _blocks("tm", "tw")
    # blocks 0 to rest - 1 hold the other components, those after them the largest one
    rows = salted_join(now, top, ["key"], "m", now.count(), "rep").withColumn("nr", rest).withColumn("nt", big).withColumn("isrest", F.col("comp") != F.col("most"))
    rows = rows.withColumn("own", F.when(F.col("isrest"), F.pmod(F.xxhash64("rep"), F.col("nr").cast("long"))).otherwise(F.col("nr") + F.pmod(F.xxhash64("rep"), F.col("nt").cast("long"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("isrest"), F.col("nr") + F.col("nt")).otherwise(F.col("nr")) - 1)))
    rows = _grouped(rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).join(members.select("rep", "text"), "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            rep, label = t.column(3).to_numpy(), t.column(4).to_numpy().copy()
            if (label == label[0]).all():
                continue
            linked = _linked([shingles(x.as_py(), size) for x in t.column(5)], percent)
            a, b = [], []
            for i in range(len(rep)):
                j = np.flatnonzero(linked[i] & (label != label[i]))
                for x in np.unique(label[j], return_index=True)[1].tolist():
                    a.append(i)
                    b.append(int(j[x]))
                if len(j):
                    label[np.isin(label, label[j])] = label[i]
            if a:
                yield _edges(rep, a, b)

    return rows.select("key", "lo", "hi", "rep", "comp", "text").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = SHINGLE) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    seen = materialise(features(docs, id_col, text_col, size), "features")
    equal = materialise(seen.filter("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "equal")
    placed = salted_join(seen, equal, ["h1", "h2", "n"], "copies", seen.count(), "id", "left")
    placed = materialise(placed.select("id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"), F.when(F.col("id") == F.col("rep"), F.col("sig")).alias("sig")), "placed")
    discard(seen, equal)
    reps = placed.filter("sig is not null").select("rep", "n", "sig")

    rows = _key_rows(reps)
    shared = materialise(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    members = materialise(salted_join(rows, shared, ["key"], "m", SYMBOLS * reps.count(), "rep").select("key", "rep", "m"), "members")
    discard(shared)
    release_shuffles(spark)
    mass = members.groupBy("rep").agg(F.sum("m").alias("mass"))
    weighed = members.join(mass, "rep").select("key", "rep", "m", "mass")
    lead = weighed.groupBy("key").agg(F.max(F.struct("mass", (-F.col("rep")).alias("neg"))).alias("top"), F.max("m").alias("m"))
    near = salted_join(weighed.drop("m"), lead, ["key"], "m", members.count(), "rep").select(F.col("rep").alias("a"), (-F.col("top.neg")).alias("b"), F.col("top.mass").alias("w")).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("w").alias("w"))
    edges = near.groupBy("a").agg(F.max(F.struct("n", "w", (-F.col("b")).alias("neg"))).alias("t")).select("a", (-F.col("t.neg")).alias("b"))
    near = materialise(_under_distance(edges, reps, percent), "near")
    more = materialise(_signature_forest(members, reps, components(near)), "near")
    clusters = components(near.union(more))
    discard(members)

    inside = clusters.select(F.col("comp").alias("key"), F.col("id").alias("rep")).join(reps.select("rep", "n"), "rep")
    total = inside.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    inside = salted_join(inside, total, ["key"], "m", clusters.count(), "rep").select("key", "rep", "n", "m", "w")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    held = materialise(inside.join(texts, "rep"), "inside")  # the only move of all texts
    release_shuffles(spark)
    links = materialise(_links_within(held, percent, size), "links")
    links = links.union(materialise(_links_between(held, components(links), percent, size), "links"))
    discard(held)
    labels = components(links)
    out = placed.select("id", "n", F.coalesce("rep", "id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
