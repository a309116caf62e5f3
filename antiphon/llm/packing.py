"""Sum-of-squares packing of documents into fixed token windows.

Every task packs the documents of its own input partition, so no row moves.  A document of more than
``capacity`` ids fills whole windows first; its remainder is placed on line: of all fill levels that
still have room, it goes where the sum over levels of (number of open windows at that level)^2 grows
least (ties: the fullest level).  The level counts live in an array, each placement is one vectorised
scan of it.  When a partition ends, its open windows are refilled from one another by cutting pieces,
and the one window that stays short is cut into sequences whose lengths are powers of two, which need
no padding.

Nulls and empty texts: the text counts as empty, so the document is the end id alone.  Repeated rows
and equal ids are packed once per row.  A null id is carried through.  An empty table gives no rows.
Columns beyond ``id_col`` and ``text_col`` are ignored.  Memory per task: the open windows, of which a
level seldom has more than a few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: A piece in hand: (document's id, start in the document, its ids as bytes, ids of the document).
Piece = tuple[object, int, bytes, int]

OUTPUT_BYTES = 4 << 20


class SumOfSquares:
    """On-line bin packing over fill levels 1..capacity-1."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.gain = np.full(capacity + 1, -(1 << 40), np.int64)  # what leaving a level takes off the sum
        self.cost = np.ones(capacity + 1, np.int64)  # what one more window at a level adds to it
        self.cost[capacity] = 0

    def _count(self, level: int) -> None:
        n = len(self.open[level])
        self.gain[level] = 2 * n - 1 if n else -(1 << 40)
        self.cost[level] = 2 * n + 1

    def place(self, piece: Piece) -> list[Piece] | None:
        """Place a piece of 1..capacity ids; the window that it fills up, if it does."""
        size, cap = len(piece[2]) // 4, self.capacity
        if size == cap:
            return [piece]
        change = self.cost[size + 1 :] - self.gain[1 : cap + 1 - size]
        best = len(change) - 1 - int(change[::-1].argmin())
        if change[best] <= self.cost[size]:
            level = best + 1
            window = self.open[level].pop()
            self._count(level)
        else:
            level, window = 0, []
        window.append(piece)
        if level + size == cap:
            return window
        self.open[level + size].append(window)
        self._count(level + size)
        return None

    def flush(self) -> Iterator[list[Piece]]:
        """Full windows made of the open ones, then the rest in sequences of power-of-two lengths."""
        left = [w for level in range(self.capacity - 1, 0, -1) for w in self.open[level]]
        i, j = 0, len(left) - 1
        while i < j:
            room = self.capacity - sum(len(p[2]) for p in left[i]) // 4
            while room and i < j:
                doc, start, ids, n = left[j].pop()
                take = min(room, len(ids) // 4)
                left[i].append((doc, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    left[j].append((doc, start + take, ids[4 * take :], n))
                room -= take
                if not left[j]:
                    j -= 1
            if not room:
                yield left[i]
                i += 1
        rest = left[i] if i <= j else []
        total = sum(len(p[2]) for p in rest) // 4
        if total == self.capacity:
            yield rest
            return
        for bit in range(total.bit_length() - 1, -1, -1):
            room, window = total & (1 << bit), []
            while room:
                doc, start, ids, n = rest.pop()
                take = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    rest.append((doc, start + take, ids[4 * take :], n))
                room -= take
            if window:
                yield window


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.  Sequences hold at most ``capacity`` ids and no gap."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    small_batches(docs.sparkSession)
    # the parameters' names in the output cannot clash: only these two columns are read
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType
    out = T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, t) for n, t in (("start", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import tokenizer

        tok, packer = tokenizer(tokenizer_path), SumOfSquares(capacity)
        end = np.array([end_id], "<u4").tobytes()
        base, made = TaskContext.get().partitionId() << 33, 0
        rows: list[tuple] = []
        held, arrow = 0, None

        def emit(window: list[Piece]) -> None:
            nonlocal made, held
            at = 0
            for doc, start, ids, n in window:
                rows.append((doc, start, ids, n, base + made, at))
                at += len(ids) // 4
            held += 4 * at
            made += 1

        def batch() -> pa.RecordBatch:
            nonlocal rows, held
            cols = list(zip(*rows))
            rows, held = [], 0
            kinds = (arrow, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=out.names)

        for b in batches:
            arrow = b.column(0).type
            ids_of = tok.encode_batch(b.column(1).to_pylist())
            for doc, ids in zip(b.column(0).to_pylist(), ids_of):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    window = packer.place((doc, start, ids[4 * start : 4 * (start + capacity)], n))
                    if window:
                        emit(window)
                if held > OUTPUT_BYTES:
                    yield batch()
        for window in packer.flush():
            emit(window)
            if held > OUTPUT_BYTES:
                yield batch()
        if rows:
            yield batch()

    return src.mapInArrow(run, out)
