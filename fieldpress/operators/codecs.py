"""Byte codecs over chunks of a field, in Arrow batches.

Cells become chunk rows (little-endian bytes of one type) by flat position. A task encodes each chunk
with every configuration of its list, sharing what configurations have in common: each filter is
applied once per chunk, its bytes and its errors are made once, and only compressors run for each
configuration. Compressors are lossless, so errors belong to filter and serializer alone, a configuration's
front; with a limit, a first pass (`errors`) finds the fronts whose errors exceed it, and no compressor runs for them.

LZ4 has no acceleration here and Blosc is a byte shuffle before its inner codec, so their sizes are
approximations; `APPROXIMATE` lists them.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpress.operators import serializers
from fieldpress.operators.space import Codec

APPROXIMATE = ("Blosc", "LZ4")
NUMPY = {"float64": "<f8", "float32": "<f4", "int64": "<i8", "int32": "<i4", "int16": "<i2", "int8": "<i1"}
CHUNK_CELLS = 1 << 18


def byte_shuffle(raw: bytes, item: int) -> bytes:
    body = len(raw) // item * item
    return np.frombuffer(raw[:body], np.uint8).reshape(-1, item).T.tobytes() + raw[body:]


def byte_unshuffle(raw: bytes, item: int) -> bytes:
    body = len(raw) // item * item
    return np.frombuffer(raw[:body], np.uint8).reshape(item, -1).T.tobytes() + raw[body:]


def bit_shuffle(raw: bytes, item: int) -> bytes:
    body = len(raw) // (8 * item) * 8 * item
    bits = np.unpackbits(np.frombuffer(raw[:body], np.uint8).reshape(-1, item), axis=1)
    return np.packbits(bits.T).tobytes() + raw[body:]


def bit_unshuffle(raw: bytes, item: int) -> bytes:
    body = len(raw) // (8 * item) * 8 * item
    bits = np.unpackbits(np.frombuffer(raw[:body], np.uint8)).reshape(8 * item, -1)
    return np.packbits(bits.T, axis=1).tobytes() + raw[body:]


def _shuffles(codec: Codec, item: int) -> tuple[Callable, Callable]:
    """Blosc's shuffle modes: 0 none, 1 bytes, 2 bits, -1 bits for one-byte items and bytes for others."""
    mode = codec.get("shuffle")
    mode = (2 if item == 1 else 1) if mode == -1 else mode
    same = lambda raw, item: raw
    return ((same, same), (byte_shuffle, byte_unshuffle), (bit_shuffle, bit_unshuffle))[mode]


def compress(raw: bytes, codec: Codec | None, item: int = 8) -> bytes:
    if codec is None:
        return raw
    if codec.family == "Zlib":
        return zlib.compress(raw, codec.get("level"))
    if codec.family == "GZip":
        return gzip.compress(raw, codec.get("level"), mtime=0)
    if codec.family == "BZ2":
        return bz2.compress(raw, codec.get("level"))
    if codec.family == "LZMA":
        return lzma.compress(raw, preset=codec.get("preset"))
    if codec.family == "Zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=codec.get("level") or 3).compress(raw)
    if codec.family == "LZ4":
        return pa.Codec("lz4_raw").compress(raw, asbytes=True)
    inner, level = codec.get("cname"), codec.get("clevel")
    body = _shuffles(codec, item)[0](raw, item)
    if inner == "zlib":
        return zlib.compress(body, level)
    if inner == "zstd":
        return pa.Codec("zstd", {1: 1, 6: 8, 9: 22}[level]).compress(body, asbytes=True)
    return pa.Codec("lz4_raw").compress(body, asbytes=True)


def decompress(raw: bytes, codec: Codec | None, size: int, item: int = 8) -> bytes:
    if codec is None:
        return raw
    if codec.family in ("Zlib", "GZip", "BZ2", "LZMA"):
        return {"Zlib": zlib, "GZip": gzip, "BZ2": bz2, "LZMA": lzma}[codec.family].decompress(raw)
    if codec.family == "Zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    if codec.family == "LZ4":
        return pa.Codec("lz4_raw").decompress(raw, size, asbytes=True)
    inner = codec.get("cname")
    body = zlib.decompress(raw) if inner == "zlib" else pa.Codec("zstd" if inner == "zstd" else "lz4_raw").decompress(raw, size, asbytes=True)
    return _shuffles(codec, item)[1](body, item)


def bitround(x: np.ndarray, keep: int) -> np.ndarray:
    """Round the mantissa bits to `keep`, halves to even, on the integers of the bits."""
    bits, mantissa = (np.uint64, 52) if x.dtype.itemsize == 8 else (np.uint32, 23)
    drop = mantissa - keep
    if drop <= 0:
        return x
    u = x.view(bits)
    half = (u >> bits(drop)) & bits(1)
    u = u + ((bits(1) << bits(drop - 1)) - bits(1)) + half
    return np.where(np.isfinite(x), (u & ~((bits(1) << bits(drop)) - bits(1))).view(x.dtype), x)


def filter_encode(x: np.ndarray, codec: Codec | None) -> np.ndarray:
    if codec is None:
        return x
    if codec.family == "Delta":
        return np.diff(x, prepend=x.dtype.type(0))
    if codec.family == "BitRound":
        return bitround(x, codec.get("keepbits"))
    if codec.family == "Quantize":
        scale = 2.0 ** np.ceil(np.log2(10.0 ** codec.get("digits")))
        return (np.rint(x.astype(np.float64) * scale) / scale).astype(x.dtype)
    if codec.family == "Asinh":
        w = codec.get("linear_width")
        return (w * np.arcsinh(x / w)).astype(x.dtype) if w else x
    return ((x - codec.get("offset")) / codec.get("scale")).astype(x.dtype)


def filter_decode(c: np.ndarray, codec: Codec | None) -> np.ndarray:
    if codec is None:
        return c
    if codec.family == "Delta":
        return np.cumsum(c, dtype=c.dtype)
    if codec.family == "Asinh":
        w = codec.get("linear_width")
        return (w * np.sinh(c / w)).astype(c.dtype) if w else c
    if codec.family == "FixedOffsetScale":
        return (c * codec.get("scale") + codec.get("offset")).astype(c.dtype)
    return c


def chunked(df: DataFrame, dtype: str, index: str = "idx", value: str = "value", keys: tuple[str, ...] = (), cells: int = CHUNK_CELLS) -> DataFrame:
    """(keys, chunk, n, payload): the field's cells in flat order as bytes, at most `cells` to a chunk."""
    kind = NUMPY[dtype]
    types = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["chunk long", "n long", "payload binary"])

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(index).to_numpy(), kind="stable")
        x = table.column(value).to_numpy()[order].astype(kind)
        return pa.table({**{k: table.column(k)[:1] for k in keys}, "chunk": table.column("chunk")[:1], "n": [len(x)], "payload": pa.array([x.tobytes()], pa.binary())})

    dealt = df.select(*keys, F.floor(F.col(index) / cells).cast("long").alias("chunk"), index, value)
    return dealt.groupBy(*keys, "chunk").applyInArrow(pack, types)


PARTIAL = "ordinal long, raw_bytes long, enc_bytes long, sum_abs_e double, sum_abs_x double, sum_sq_e double, sum_sq_x double, max_abs_e double, max_abs_x double"


ERRORS = PARTIAL.split(", ")[3:]
#: Filter and serializer of a configuration.
Front = tuple[Codec | None, Codec | None]


def front_encode(x: np.ndarray, front: Front) -> bytes:
    filt, ser = front
    c = np.ascontiguousarray(filter_encode(x, filt))
    return c.tobytes() if ser is None else serializers.encode(c, ser)


def front_decode(body: bytes, front: Front, kind: np.dtype) -> np.ndarray:
    filt, ser = front
    return filter_decode(np.frombuffer(body, kind) if ser is None else serializers.decode(body, ser, kind), filt)


def _errors(x: np.ndarray, front: Front) -> tuple[bytes, tuple[float, ...]]:
    """A chunk's bytes before compression, and its sums and maxima of errors and values."""
    body = front_encode(x, front)
    wide = x.astype(np.float64)
    e, wide = np.abs(front_decode(body, front, x.dtype).astype(np.float64) - wide), np.abs(wide)
    return body, (float(e.sum()), float(wide.sum()), float((e**2).sum()), float((wide**2).sum()), float(e.max(initial=0)), float(wide.max(initial=0)))


def errors(chunks: DataFrame, dtype: str, fronts: list[Front]) -> DataFrame:
    """Partial errors of each front, by its number in the list, per chunk."""
    kind = np.dtype(NUMPY[dtype])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_py(), kind)
                rows = [(i, *_errors(x, f)[1]) for i, f in enumerate(fronts)]
                yield pa.record_batch([pa.array(v) for v in zip(*rows, strict=True)], ["front", *(c.split()[0] for c in ERRORS)])

    return chunks.select("payload").mapInArrow(run, ", ".join(["front long", *ERRORS]))


def sweep(chunks: DataFrame, dtype: str, configs: list[tuple[int, Codec | None, Front]], split: int = 1) -> DataFrame:
    """Partial sizes and errors of (ordinal, compressor, front) configurations, per chunk and part of the list.

    A field of fewer chunks than there are tasks to keep busy is dealt out `split` times, each time for
    another part of the list, by front; with more chunks nothing is copied or shuffled.
    """
    kind = np.dtype(NUMPY[dtype])
    by_front: dict[Front, list[tuple[int, Codec | None]]] = {}
    for ordinal, comp, front in configs:
        by_front.setdefault(front, []).append((ordinal, comp))
    work = [(f, own[i::n]) for f, own in by_front.items() for n in [max(1, min(len(own), -(-len(own) // 12)))] for i in range(n)]
    split = max(1, min(split, len(work)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, payload = batch.column(0).to_pylist(), batch.column(1)
            for p, raw in zip(part, payload, strict=True):
                x, rows = np.frombuffer(raw.as_py(), kind), []
                for front, own in work[p::split]:
                    body, found = _errors(x, front)
                    rows += [(ordinal, x.nbytes, len(compress(body, comp, kind.itemsize)), *found) for ordinal, comp in own]
                if rows:
                    yield pa.record_batch([pa.array(v) for v in zip(*rows, strict=True)], [f.split()[0] for f in PARTIAL.split(", ")])

    if split == 1:
        return chunks.select(F.lit(0).alias("part"), "payload").mapInArrow(run, PARTIAL)
    parts = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(split - 1))).alias("part"), "payload", "chunk")
    return parts.repartition(F.col("chunk"), F.col("part")).select("part", "payload").mapInArrow(run, PARTIAL)


def round_trips(chunks: DataFrame, dtype: str, comps: list[Codec | None]) -> DataFrame:
    """(comp_idx, n_cells, n_equal) of each chunk: cells that are the same, bit by bit, after encoding and decoding."""
    kind = np.dtype(NUMPY[dtype])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in (x.as_py() for x in batch.column(0)):
                x = np.frombuffer(raw, f"u{kind.itemsize}")
                back = [np.frombuffer(decompress(compress(raw, c, kind.itemsize), c, len(raw), kind.itemsize), x.dtype) for c in comps]
                equal = [int((y == x).sum()) if len(y) == len(x) else 0 for y in back]
                yield pa.record_batch([pa.array(range(len(comps)), pa.int32()), pa.array([len(x)] * len(comps), pa.int64()), pa.array(equal, pa.int64())], ["comp_idx", "n_cells", "n_equal"])

    return chunks.select("payload").mapInArrow(run, "comp_idx int, n_cells long, n_equal long")


def bounds_kept(chunks: DataFrame, dtype: str, sers: list[Codec]) -> DataFrame:
    """(ser_idx, n_cells, n_within) of each chunk: cells that a serializer gives back within its bound."""
    kind = np.dtype(NUMPY[dtype])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_py(), kind)
                good = [int((np.abs(serializers.decode(serializers.encode(x, c), c, kind) - x) <= serializers.bound(x, c)).sum()) for c in sers]
                yield pa.record_batch([pa.array(range(len(sers)), pa.int32()), pa.array([len(x)] * len(sers), pa.int64()), pa.array(good, pa.int64())], ["ser_idx", "n_cells", "n_within"])

    return chunks.select("payload").mapInArrow(run, "ser_idx int, n_cells long, n_within long")


def split_for(spark, n_chunks: int) -> int:
    """How often to deal out a field of few chunks, so that there are two tasks for each core."""
    return max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, n_chunks)))
