"""Packing token sequences into windows by the sum-of-squares rule.

Each scan partition is packed by itself, in one pass and without a shuffle. A document longer than a window first
fills whole windows; what remains is placed whole, online, into the fill level that leaves the smallest sum of squared
counts of partially filled windows. A level array holds those counts. When the partition ends, the open windows are closed:
their pieces are laid end to end and cut at full windows, the rest at powers of two, which need no padding. No token is dropped.

Open windows are held in memory, so there are `max_open` of them at most, 32 MB. The rule keeps their number near the square root
of the documents, so that a partition needs millions of documents to come there; then the fullest windows are closed until half
of them are left, and the rule goes on with the others.

Defined cases: a null or empty text is its end id alone; repeated rows are packed as separate documents; an empty table
gives no rows; columns other than doc_id and text are ignored; a null doc_id stays null.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import lean, table

WINDOW = 2048
#: Open windows of one partition before the fullest half is closed.
MAX_OPEN = 4096
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class SumOfSquares:
    """Windows of one partition. A piece is (doc_id, start, ids, doc_tokens); add() and close() yield closed windows."""

    def __init__(self, capacity: int = WINDOW, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.count = np.zeros(capacity + 1, np.int64)
        self.at = [deque() for _ in range(capacity + 1)]
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, whose choice minimises the sum of squared counts; ties to the fullest."""
        n, top = self.count, self.capacity
        used = np.flatnonzero(n[1 : top - size + 1]) + 1
        # Moving a window from h to h+size changes the sum by 2*(n[h+size]-n[h])+2, or by 1-2*n[h] if it gets full.
        change = 2 * (n[used + size] - n[used]) + 2
        if len(used) and used[-1] + size == top:
            change[-1] = 1 - 2 * n[used[-1]]
        fresh = 2 * n[size] + 1
        if not len(used):
            return 0
        k = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(used[k]) if change[k] <= fresh else 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        total, whole = len(ids) // 4, len(ids) // 4 // self.capacity
        for k in range(whole):
            at = k * self.capacity
            yield [(doc_id, at, ids[4 * at : 4 * (at + self.capacity)], total)]
        at = whole * self.capacity
        size = total - at
        if not size:
            return
        level = self.level_for(size)
        window = self.at[level].popleft() if level else []
        self.count[level] -= bool(level)
        self.n_open -= bool(level)
        window.append((doc_id, at, ids[4 * at :], total))
        if level + size == self.capacity:
            yield window
            return
        self.at[level + size].append(window)
        self.count[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self.close(self.max_open // 2)

    def close(self, keep: int = 0) -> Iterator[list[tuple]]:
        """Close the fullest windows until `keep` are open: those filled to a power of two as they are, the others laid end to end and cut."""
        loose, left = [], 0
        for level in range(self.capacity - 1, 0, -1):
            while self.at[level] and self.n_open > keep:
                window = self.at[level].pop()
                self.count[level] -= 1
                self.n_open -= 1
                if level & (level - 1) == 0:
                    yield window
                else:
                    loose += window
                    left += level
        window, room = [], min(self.capacity, 1 << max(left.bit_length() - 1, 0))
        for doc_id, start, ids, total in loose:
            while ids:
                part = ids[: 4 * room]
                window.append((doc_id, start, part, total))
                start, ids = start + len(part) // 4, ids[len(part) :]
                room -= len(part) // 4
                left -= len(part) // 4
                if not room:
                    yield window
                    window, room = [], min(self.capacity, 1 << max(left.bit_length() - 1, 0))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """One row a piece, with its ids as little-endian unsigned 32-bit integers in `ids`."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokens.encoder(vocabulary).encode, SumOfSquares(capacity, max_open)
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        def put(windows: Iterator[list[tuple]]) -> None:
            nonlocal sequence, held
            for window in windows:
                at = 0
                for doc_id, start, ids, total in window:
                    rows.append((doc_id, start, len(ids) // 4, ids, total, sequence, at))
                    at += len(ids) // 4
                    held += len(ids)
                sequence += 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                put(packer.add(doc_id, encode(text.as_py()) + end))
                if held > 8_000_000:
                    yield out()
                    rows, held = [], 0
        put(packer.close())
        yield out()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lean(run), SCHEMA)


def op3_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the digest of their ids."""
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
