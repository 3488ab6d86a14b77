"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised, ended by an id, and cut into pieces: whole windows first, then the rest in
pieces of at most `ITEM` ids, so that many small pieces share a window. Full pieces are windows of
their own. The others are dealt, a bounded group at a time, into the fewest windows: the two partial
partitions with the largest imbalance merge with their imbalances opposed until one partition is
left, whose windows are near equal; while a window is above capacity, the window count rises.

A group is packed within the task that read it, so nothing is shuffled and the memory of a task is
bounded whatever a document's length or number of copies.

Defined cases: null or empty text is one end id; repeated rows are packed each on its own; an empty
table gives no rows; columns other than doc_id and text are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fieldpress.llm.pieces import encoder
from fieldpress.llm.shared import bounded_batches, col, slices, texts_of

CAPACITY, ITEM, GROUP, END = 1024, 256, 512, 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers of each of k near-equal windows (Karmarkar-Karp, k-way).

    A partial partition lists its non-empty windows, largest first; the others are 0. Merging two
    lays the largest of one onto the smallest of the other.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    heap = [(-s, i, [(s, i, None)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)  # windows that are non-empty in both
        keep_a, keep_b = len(a) - both, len(b) - both
        laid = [(x[0] + y[0], x, y) for x, y in zip(a[keep_a:], reversed(b[keep_b:]), strict=True)]
        c = sorted(a[:keep_a] + b[:keep_b] + laid, key=lambda w: -w[0])
        low = c[-1][0] if len(c) == k else 0
        heapq.heappush(heap, (low - c[0][0], tick, c))
        tick += 1
    out = []
    for window in heap[0][2]:
        items, todo = [], [window]
        while todo:
            _, x, y = todo.pop()
            if y is None:
                items.append(x)
            else:
                todo += (x, y)
        out.append(sorted(items))
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items of the fewest windows, from the volume bound up, that differencing fills within capacity."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return dealt
        k += 1


def cut(n: int, capacity: int = CAPACITY, item: int = ITEM) -> list[int]:
    """Lengths of the pieces of n ids: full windows, then near-equal pieces of at most `item`."""
    full, rest = divmod(n, capacity)
    parts = -(-rest // item)
    return [capacity] * full + [rest // parts + (i < rest % parts) for i in range(parts)]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, item: int = ITEM, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the window (`sequence_id`) and place (`offset`) of each; `with_ids` adds their ids."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, made = encoder(path), TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []  # doc_id, start, length, crc, doc_tokens, ids
        loose = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, rows, loose
            small = [i for i, r in enumerate(rows) if r[2] < capacity]
            dealt = [[i] for i, r in enumerate(rows) if r[2] == capacity] + [[small[j] for j in w] for w in windows([rows[i][2] for i in small], capacity)]
            out = []
            for w in dealt:
                at = 0
                for i in w:
                    out.append((*rows[i][:5], base + made, at, rows[i][5]))
                    at += rows[i][2]
                made += 1
            rows, loose = [], 0
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            columns = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:7]]
            if with_ids:
                columns.append(pa.array([r[7] for r in out], pa.list_(pa.int32())))
            return pa.record_batch(columns, names + ["ids"] * with_ids)

        for part in slices(batches):
            flat, bounds = enc.ids(col(part, "text"))
            for doc, a, b in zip(col(part, "doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                own = np.append(flat[a:b], enc.dtype.type(END)).astype("<u4")
                at, n = 0, len(own)
                for size in cut(n, capacity, item):
                    crc = zlib.crc32(own[at : at + size])
                    rows.append((doc, at, size, crc, n, own[at : at + size].astype(np.int32) if with_ids else None))
                    at += size
                    loose += size < capacity
                if loose >= group or len(rows) >= 8 * group:
                    yield flush()
        if rows:
            yield flush()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return texts_of(docs, "doc_id").mapInArrow(run, schema)
