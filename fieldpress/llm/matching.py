"""Join keys dealt to parts as packed arrays: which members share a key, without a row per key.

A task holds the (key, member) entries of its texts, and combines them before it sends them on. A key that
several members of the task have is a group already: its entries are ready, and are scattered over all parts
whatever the key; only its first entry goes to the key's own part too, to meet other tasks' entries. So a key
that a third of all rows have sends one entry per flush to its part, and no task gathers its members. An entry may
be given twice: once with its task's group, once with the other tasks' entries.

Rows are (part, kind, blob). They are sorted by part within a task, so `parts_in_order` holds one part's
entries at a time, whose size is set by the number of parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldpress.llm.bytewords import mix
from fieldpress.llm.shared import col, trim

#: Entries that a task holds before it sends them on.
HELD_KEYS = 1 << 18
#: Ready entries in a row.
READY = 1 << 14
#: Bytes of entries that a part has, about.
PART_BYTES = 32 << 20
SENT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
SENT_DDL = "part int, kind int, blob binary"


def parts_of(spark, entry_bytes: int = 0) -> tuple[int, int]:
    """Tasks that match keys, and the finer parts that keys are dealt to, so that tasks even out and a part stays small."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tasks, max(8 * tasks, -(-entry_bytes // PART_BYTES))


def firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def packed(columns: list[np.ndarray]) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def unpacked(blob: bytes, types: list[np.dtype]) -> list[np.ndarray]:
    """The columns of a blob of `packed`."""
    n, out, at = len(blob) // sum(t.itemsize for t in types), [], 0
    for t in types:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * t.itemsize
    return out


def row(part: int, kind: int, blob: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], schema=SENT)


class Entries:
    """Entries that a task holds: a 64-bit key and columns that tell its member. `ready` and `keyed` are the kinds of its rows."""

    def __init__(self, parts: int, types: list[str], ready: int, keyed: int):
        self.parts, self.types, self.ready, self.keyed = parts, [np.dtype(t) for t in types], ready, keyed
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.held.append(columns)
            self.size += len(columns[0])

    def _scattered(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(columns[0]), READY):
            own = [c[a : a + READY] for c in columns]
            yield row(int(mix(own[0][:1].view(np.uint64) + np.uint64(a))[0] % np.uint64(self.parts)), self.ready, packed(own))

    def out(self) -> Iterator[pa.RecordBatch]:
        """The groups of keys, ready; and the first entry of each key, dealt by key."""
        if not self.size:
            return
        columns = [np.concatenate(c).astype(t, copy=False) for c, t in zip(zip(*self.held, strict=True), self.types, strict=True)]
        self.held, self.size = [], 0
        order = np.lexsort((columns[1], columns[0]))
        columns = [c[order] for c in columns]
        again = np.zeros(len(order), bool)
        again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
        columns = [c[~again] for c in columns]
        at = firsts(columns[0])
        size = np.diff(np.append(at, len(columns[0])))
        yield from self._scattered([c[np.repeat(size > 1, size)] for c in columns])
        where = (columns[0][at].view(np.uint64) % np.uint64(self.parts)).astype(np.int32)
        order = np.argsort(where, kind="stable")
        where, single = where[order], [c[at][order] for c in columns]
        cuts = firsts(where)
        blobs = [packed([c[a:b] for c in single]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(where)], strict=True)]
        yield pa.record_batch([pa.array(where[cuts]), pa.array(np.full(len(cuts), self.keyed, np.int32)), pa.array(blobs, pa.binary())], schema=SENT)

    def all(self) -> Iterator[pa.RecordBatch]:
        """All entries, ready."""
        if self.size:
            yield from self._scattered([np.concatenate(c).astype(t, copy=False) for c, t in zip(zip(*self.held, strict=True), self.types, strict=True)])
            self.held, self.size = [], 0

    def unpacked(self, blob: bytes) -> list[np.ndarray]:
        return unpacked(blob, self.types)

    def joined(self, blobs: list[bytes]) -> list[np.ndarray]:
        """Entries of one part whose key several different entries have."""
        columns = [np.concatenate(c) for c in zip(*map(self.unpacked, blobs), strict=True)]
        order = np.lexsort((columns[1], columns[0]))
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        columns = [c[new] for c in columns]
        size = np.diff(np.append(firsts(columns[0]), len(columns[0])))
        return [c[np.repeat(size > 1, size)] for c in columns]


def parts_in_order(batches: Iterator[pa.RecordBatch], keyed: set[int]) -> Iterator[tuple[int, list[bytes]]]:
    """(kind, blobs): a row of another kind alone, and all of a part's rows of each keyed kind together."""
    now, held = -1, {k: [] for k in keyed}
    for b in batches:
        for part, kind, blob in zip(col(b, "part").to_pylist(), col(b, "kind").to_pylist(), col(b, "blob").to_pylist(), strict=True):
            if part != now:
                yield from ((k, x) for k, x in held.items() if x)
                now, held = part, {k: [] for k in keyed}
            if kind in held:
                held[kind].append(blob)
            else:
                yield kind, [blob]
    yield from ((k, x) for k, x in held.items() if x)
    trim()


def dealt(docs: DataFrame, emit: Callable, tasks: int, match: Callable, ddl: str) -> DataFrame:
    """What `match` makes of the rows of `emit`, dealt and sorted by part."""
    return docs.mapInArrow(emit, SENT_DDL).repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(match, ddl)
