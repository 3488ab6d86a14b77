"""Token ids as Arrow stream files of fixed-size lists: equal-length sequences and masks, read in place.

A shard is one Arrow IPC stream of batches with `ids: fixed_size_list<uint16|uint32>[L]` and
`mask: fixed_size_list<bool>[L]` (true: an id, false: padding at the shard's end; a bit each), uncompressed, so a
memory map gives any sequence without a copy. Beside it lies an index stream with one row per
document: doc_id, start (ids before it in its shard) and n_tokens, its end id counted.
Shards follow doc_id order: a range partitioning deals documents to tasks, each task sorts its own.

Files go to a folder that driver and executors share, through `pyarrow.fs`, under a name of the
attempt; only names that a finished task returned are in the manifest, so a lost executor leaves at
most unlisted files. Equal doc_ids may be dealt to one shard only, in order of their text.

Defined cases: null or empty text is one end id; repeated rows are stored each; an empty table has no
shards; columns other than doc_id and text are ignored; null doc_ids come first.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from fieldpress.llm.pieces import encoder
from fieldpress.llm.shared import bounded_batches, checkpointed, col, slices, texts_of

LENGTH, END = 1024, 0
MANIFEST = "shard long, file string, positions string, n_docs long, n_tokens long"
#: Sequences in a record batch.
BATCH = 512


def folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class _Writer:
    """One shard: ids come in any lengths, leave in whole sequences."""

    def __init__(self, fs: pa.fs.FileSystem, stem: str, dtype: np.dtype, length: int):
        self.length, self.dtype, self.rest, self.n_docs, self.n_tokens = length, dtype, np.zeros(0, dtype), 0, 0
        self.file, self.index = f"{stem}.arrows", f"{stem}.index.arrows"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [fs.open_output_stream(p) for p in (self.file, self.index)]
        self.out, self.index_out = (pa.ipc.new_stream(s, c) for s, c in zip(self.sinks, (self.schema, self.index_schema), strict=True))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(lens) - lens
        self.index_out.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(lens)], schema=self.index_schema))
        self.n_docs += len(lens)
        self.n_tokens += len(ids)
        self.rest = np.concatenate((self.rest, ids))
        whole = len(self.rest) // self.length
        for a in range(0, whole, BATCH):
            self._put(self.rest[a * self.length : min(whole, a + BATCH) * self.length])
        self.rest = self.rest[whole * self.length :]

    def _put(self, ids: np.ndarray, filled: int | None = None) -> None:
        mask = np.ones(len(ids), bool)
        mask[len(ids) if filled is None else filled :] = False
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if n := len(self.rest):
            self._put(np.concatenate((self.rest, np.zeros(self.length - n, self.dtype))), n)
        for x in (self.out, self.index_out, *self.sinks):
            x.close()


def write_tokens(docs: DataFrame, path: str, uri: str, length: int = LENGTH) -> DataFrame:
    """Write all documents' ids as shards under `uri`; the manifest has a row per shard, numbered in doc_id order."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, writer = encoder(path), TaskContext.get().partitionId(), None
        fs, base = folder(uri)
        for part in slices(batches):
            if writer is None:
                fs.create_dir(base, recursive=True)
                writer = _Writer(fs, f"{base}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}", enc.dtype, length)
            flat, bounds = enc.ids(col(part, "text"))
            ids = np.insert(flat, bounds[1:], enc.dtype.type(END))
            writer.add(col(part, "doc_id").cast(pa.int64()), ids, np.diff(bounds) + 1)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": writer.file, "positions": writer.index, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}], pa.schema([("shard", pa.int64()), ("file", pa.string()), ("positions", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = texts_of(docs, "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return checkpointed(ordered.mapInArrow(run, MANIFEST))


class Shard:
    """Random access to one written shard; sequences and masks are views of the mapped file."""

    def __init__(self, fs: pa.fs.FileSystem, file: str):
        source = pa.memory_map(file) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(file)
        self.batches = pa.ipc.open_stream(source).read_all().to_batches()
        self.length = self.batches[0].schema.field("ids").type.list_size
        self.firsts = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids as a numpy view, and the mask as a slice of its bits."""
        k = int(np.searchsorted(self.firsts, i, "right")) - 1
        row = i - int(self.firsts[k])
        ids, mask = (self.batches[k].column(c).values.slice(row * self.length, self.length) for c in (0, 1))
        return ids.to_numpy(), mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n: of one batch as a view, else joined."""
        out = []
        while n > 0:
            seq, at = divmod(start, self.length)
            k = int(np.searchsorted(self.firsts, seq, "right")) - 1
            b = self.batches[k].column(0)
            at += (seq - int(self.firsts[k])) * self.length
            out.append(b.values.to_numpy()[at : at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.uint16)])


def read_tokens(spark: SparkSession, manifest: DataFrame, uri: str) -> DataFrame:
    """Per document, from the files alone: its place among all ids, its length, and the crc32 of its ids as 32-bit integers.

    The manifest, a row per shard, is summed on the driver for the ids before each shard.
    """
    shards, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        shards.append((r.shard, r.file, r.positions, base))
        base += r.n_tokens
    placed = spark.createDataFrame(shards, "shard long, file string, positions string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = folder(uri)
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(fs, r["file"])
                with fs.open_input_stream(r["positions"]) as f:
                    for index in pa.ipc.open_stream(f):
                        starts, lens = index.column(1).to_pylist(), index.column(2).to_pylist()
                        crc = [zlib.crc32(shard.ids(s, n).astype("<u4")) for s, n in zip(starts, lens, strict=True)]
                        yield pa.record_batch([index.column(0), pa.array([s + r["base"] for s in starts], pa.int64()), index.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, len(shards)), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
