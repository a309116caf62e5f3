"""Token ids as canonical, length-limited Huffman code.

Steps: encode the texts once into the shared folder; count ids over all documents; fit code lengths
(package-merge, at most ``max_bits``) on the driver from at most vocabulary-many counts; deal the
documents out by ranges of their id and write each range, in order, as segments; read the files back
and decode by table.

File format: a folder ``segments`` of Parquet rows and a folder ``codebook`` of (id, bits).  A segment
holds whole documents in ascending id order: ``part`` and ``part_start`` (ids before it in its range),
``doc_ids`` and ``counts`` of its documents, ``payload`` (code words, most significant bit first) and
``checkpoints`` (the bit offset of every ``block``-th id, so that blocks decode independently).  The code
words follow from the lengths (canonical order: length, then id).

Nulls and empty texts: the text counts as empty, so only the end id is written.  A null id sorts first;
rows with equal ids are ordered by their ids' bytes.  An empty table gives an empty file and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shared_dir, small_batches

SEGMENT_IDS = 1 << 17
OUTPUT_BYTES = 4 << 20


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    order = np.argsort(counts[used], kind="stable")
    weight = counts[used][order].astype(np.float64)
    # Level by level: each list merges the leaves with pairs of the list before; remember which are leaves.
    leaf_flags, current = [], weight
    flags = np.ones(n, bool)
    for _ in range(max_bits - 1):
        leaf_flags.append(flags)
        m = len(current) // 2
        pairs = current[0 : 2 * m : 2] + current[1 : 2 * m : 2]
        merged = np.concatenate([weight, pairs])
        by = np.argsort(merged, kind="stable")
        flags, current = by < n, merged[by]
    leaf_flags.append(flags)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used[order]] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words in canonical order: by length, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[i])
        if n:
            code <<= n - before
            codes[i] = code
            code, before = code + 1, n
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
    """The code words of ``ids`` one after another, and the bit offset of every ``block``-th one."""
    n = lengths[ids]
    ends = np.cumsum(n)
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    at = ends - n
    value = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    words = np.zeros(int(ends[-1]) // 32 + 2, np.uint64)
    cut = np.flatnonzero(np.diff(at >> 5, prepend=-1))
    where = at[cut] >> 5
    words[where] += np.add.reduceat(value >> np.uint64(32), cut)
    words[where + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), cut)
    return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::block]


class Decoder:
    """Table-driven decoding: the next ``max_bits`` bits index (id, length); blocks advance together."""

    def __init__(self, lengths: np.ndarray, max_bits: int):
        self.bits = max_bits
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = (1 << (max_bits - lengths[order])).astype(np.int64)
        self.symbol = np.zeros(1 << max_bits, np.int64)
        self.length = np.ones(1 << max_bits, np.int64)
        total = int(span.sum())
        self.symbol[:total] = np.repeat(order, span)
        self.length[:total] = np.repeat(lengths[order], span)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, block: int) -> np.ndarray:
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.int64)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        out = np.zeros((block, len(checkpoints)), np.int64)
        at, last = checkpoints.astype(np.int64), max(0, len(window) - 1)
        mask = (1 << self.bits) - 1
        for k in range(min(block, n)):
            i = np.minimum(at >> 3, last)
            peek = (window[i] >> (32 - self.bits - (at & 7))) & mask
            out[k] = self.symbol[peek]
            at = at + self.length[peek]
        return out.T.reshape(-1)[:n]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, max_bits: int = 18, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` into ``path`` (see the module's text); ``max_bits`` is at most 24."""
    if not 1 <= max_bits <= 24:
        raise ValueError("max_bits must be 1 to 24")
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("wide", T.BooleanType()), T.StructField("ids", T.BinaryType())])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import tokenizer

        tok, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        wide = max(tok.size, end_id + 1) > 1 << 16
        for b in batches:
            ids = [x + end for x in tok.encode_batch(b.column(1).to_pylist())]
            if not wide:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([wide] * len(ids), pa.bool_()), pa.array(ids, pa.binary())], names=schema.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for wide, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.bincount(np.frombuffer(ids, "<u4" if wide else "<u2"), minlength=len(total))
                got[: len(total)] += total
                total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])

    tokens = materialise(src.mapInArrow(tokenise, schema), "tokens")
    counts = tokens.select("wide", "ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # at most one row for each id of the vocabulary
    table = np.zeros(max([r.token for r in rows], default=0) + 1, np.int64)
    for r in rows:
        table[r.token] = r.n
    max_bits = max(max_bits, int(np.count_nonzero(table) - 1).bit_length() if rows else 1)
    lengths = code_lengths(table, max_bits)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "token long, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    segment = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(src.schema["id"].dataType)), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()), T.StructField("checkpoints", T.ArrayType(T.LongType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part = canonical_codes(lengths), TaskContext.get().partitionId()
        docs_now: list = []
        arrays: list[np.ndarray] = []
        size, start, kind = 0, 0, None

        def close() -> pa.RecordBatch:
            nonlocal docs_now, arrays, size, start
            payload, marks = encode_bits(np.concatenate(arrays), lengths, codes, block)
            got = [[part], [start], [size], [docs_now], [[len(a) for a in arrays]], [payload], [marks]]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            start, docs_now, arrays, size = start + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds)], names=segment.names)

        for b in batches:
            kind = b.column(0).type
            for doc, wide, ids in zip(*(b.column(k).to_pylist() for k in range(3))):
                got = np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.int64)
                docs_now.append(doc)
                arrays.append(got)
                size += len(got)
                if size >= SEGMENT_IDS:
                    yield close()
        if arrays:
            yield close()

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(ranges, "id").sortWithinPartitions("id", "ids")
    ordered.mapInArrow(encode, segment).write.parquet(f"{path}/segments")


def read_tokens(spark: SparkSession, path: str, block: int = 256, id_col: str = "doc_id") -> DataFrame:
    """Decode a folder that ``write_tokens`` made: id, start (ids of all documents before), ids (binary)."""
    small_batches(spark)
    segments = spark.read.parquet(f"{path}/segments")
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most one row for each id of the vocabulary
    lengths = np.zeros(max([r.token for r in book], default=0) + 1, np.int64)
    for r in book:
        lengths[r.token] = r.bits
    max_bits = int(lengths.max(initial=1))
    totals = {r.part: r.n for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row for each range
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]
    kind = segments.schema["doc_ids"].dataType.elementType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths, max_bits)
        for b in batches:
            for i in range(b.num_rows):
                part, start, n, docs, counts, payload, marks = (b.column(k)[i] for k in range(7))
                ids = decoder.decode(payload.as_py(), np.array(marks.values), n.as_py(), block).astype("<u4")
                size = np.array(counts.values)
                ends = np.cumsum(size)
                starts = base[part.as_py()] + start.as_py() + ends - size
                for lo in range(0, len(size), 2000):
                    hi = min(lo + 2000, len(size))
                    raw = [ids[e - s : e].tobytes() for e, s in zip(ends[lo:hi], size[lo:hi])]
                    yield pa.RecordBatch.from_arrays([docs.values.slice(lo, hi - lo), pa.array(starts[lo:hi], pa.int64()), pa.array(raw, pa.binary())], names=out.names)

    return segments.select("part", "part_start", "n_ids", "doc_ids", "counts", "payload", "checkpoints").mapInArrow(decode, out)


def new_token_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token_ids"
