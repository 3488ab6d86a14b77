"""Zarr v3 stores as a source and a sink: directories (`.zarr`) and uncompressed zips (`.zarr.zip`).

`spark.read.format("zarr3").load(path)` gives (var, idx, value), a partition per chunk. Writing encodes chunk
rows in tasks and puts each under its key; metadata are written by the driver once all chunks are there.
A field is written with any filter and compressor of the search space. Codecs whose bytes another reader of
the format understands carry the format's names; LZ4 and Blosc, whose containers differ here, and Asinh carry
`fieldpress.` names and are read by this module alone. Stores are copied in tasks and zipped entry by entry.
Paths are opened through `pyarrow.fs`, so stores may lie wherever driver and executors both reach.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from itertools import product
from math import ceil, prod

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldpress.operators import arrays, codecs, serializers
from fieldpress.operators.space import Codec

# Names of the format.
META = "zarr.json"
TYPES = {"float64": "<f8", "float32": "<f4", "int64": "<i8", "int32": "<i4", "int16": "<i2", "int8": "|i1", "uint8": "|u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8"}
NAMES = {"Zlib": "numcodecs.zlib", "GZip": "gzip", "BZ2": "numcodecs.bz2", "LZMA": "numcodecs.lzma", "Zstd": "zstd", "Delta": "numcodecs.delta", "BitRound": "numcodecs.bitround", "Quantize": "numcodecs.quantize", "FixedOffsetScale": "numcodecs.fixedscaleoffset"}
SERIALIZERS = ("PCodec", "ZFPY", "Zfp", "EBCCZarrFilter")
FAMILIES = {v: k for k, v in NAMES.items()} | {f"fieldpress.{f.lower()}": f for f in ("LZ4", "Blosc", "Asinh", *SERIALIZERS)}


def described(codec: Codec, dtype: str) -> dict:
    """A codec as the metadata name it."""
    own = dict(codec.params)
    if codec.family == "FixedOffsetScale":  # the format multiplies by its scale
        own = {"offset": own["offset"], "scale": 1 / own["scale"], "dtype": TYPES[dtype], "astype": TYPES[dtype]}
    elif codec.family in ("Delta", "Quantize"):
        own["dtype"] = TYPES[dtype]
    elif codec.family == "Zstd":
        own = {"level": own["level"], "checksum": False}
    elif codec.family in SERIALIZERS:
        own["dtype"] = dtype
    return {"name": NAMES.get(codec.family, f"fieldpress.{codec.family.lower()}"), "configuration": own}


def understood(meta: dict) -> Codec:
    """The codec that metadata name."""
    name, own = meta["name"], dict(meta.get("configuration") or {})
    if name == "numcodecs.gzip":
        name = "gzip"
    if name == "numcodecs.zstd":
        name = "zstd"
    if (family := FAMILIES.get(name)) is None:
        raise ValueError(f"no decoder for Zarr codec {meta['name']}")
    if family == "FixedOffsetScale":
        own = {"offset": own["offset"], "scale": 1 / own["scale"]}
    return Codec(family, tuple((k, v) for k, v in own.items() if k not in ("dtype", "astype", "checksum", "sized")))


class Store:
    """Keys to bytes, of a directory or of a zip."""

    def __init__(self, path: str):
        uri = path if "://" in path else f"file://{path}"
        self.fs, self.root = pa.fs.FileSystem.from_uri(uri)
        self.zip = zipfile.ZipFile(self.fs.open_input_file(self.root)) if path.endswith(".zip") else None

    def _read(self, path: str) -> bytes:
        with self.fs.open_input_file(path) as f:
            return f.read()

    def get(self, key: str) -> bytes | None:
        try:
            return self.zip.read(key) if self.zip else self._read(f"{self.root}/{key}")
        except (KeyError, FileNotFoundError):
            return None

    def keys(self) -> list[str]:
        if self.zip:
            return self.zip.namelist()
        found = self.fs.get_file_info(pa.fs.FileSelector(self.root, recursive=True))
        return [f.path[len(self.root) + 1 :] for f in found if f.is_file]

    def put(self, key: str, body: bytes) -> None:
        path = f"{self.root}/{key}"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(path) as f:
            f.write(body)

    def arrays(self) -> dict[str, dict]:
        """Metadata by array name; the root array is named ''."""
        out = {}
        for key in self.keys():
            if key == META or key.endswith(f"/{META}"):
                meta = json.loads(self.get(key))
                if meta.get("node_type") == "array":
                    out[key[: -len(META)].rstrip("/")] = meta
        return out


def chunk_key(meta: dict, at: tuple[int, ...]) -> str:
    sep = meta["chunk_key_encoding"].get("configuration", {}).get("separator", "/")
    return sep.join(["c", *map(str, at)])


def unpack(meta: dict, body: bytes) -> np.ndarray:
    """A chunk's cells in C order, its codecs undone."""
    kind = np.dtype(TYPES[meta["data_type"]])
    size = prod(meta["chunk_grid"]["configuration"]["chunk_shape"]) * kind.itemsize
    x = None
    for described_as in reversed(meta["codecs"]):
        if described_as["name"] == "bytes":
            big = (described_as.get("configuration") or {}).get("endian", "little") != "little"
            x = np.frombuffer(body, kind.newbyteorder(">") if big else kind).astype(kind)
            continue
        codec = understood(described_as)
        if x is not None:
            x = codecs.filter_decode(x, codec)
        elif codec.family in SERIALIZERS:
            x = serializers.decode(body, codec, kind)
        else:
            own = size
            if described_as["configuration"].get("sized"):
                own, body = int.from_bytes(body[:8], "little"), body[8:]
            body = codecs.decompress(body, codec, own, kind.itemsize)
    return x


def fill(meta: dict) -> float:
    v = meta.get("fill_value", 0)
    return float({"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}.get(v, v))


class _Chunk(InputPartition):
    def __init__(self, name: str, meta: dict, at: tuple[int, ...]):
        self.name, self.meta, self.at = name, meta, at


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.field = options["path"], options.get("field")

    def partitions(self) -> list[_Chunk]:
        found = Store(self.path).arrays()
        if self.field is not None and self.field not in found:
            raise ValueError(f"no field {self.field}; there are {', '.join(sorted(found))}")
        out = []
        for name, meta in sorted(found.items()):
            if self.field in (None, name):
                grid = meta["chunk_grid"]["configuration"]["chunk_shape"]
                out += [_Chunk(name, meta, at) for at in product(*(range(ceil(n / c)) for n, c in zip(meta["shape"], grid, strict=True)))]
        return out

    def read(self, part: _Chunk) -> Iterator[pa.RecordBatch]:
        meta = part.meta
        shape, grid = meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"]
        body = Store(self.path).get(f"{part.name}/{chunk_key(meta, part.at)}".lstrip("/"))
        x = np.full(grid, fill(meta)) if body is None else unpack(meta, body).reshape(grid)
        low = [a * c for a, c in zip(part.at, grid, strict=True)]
        high = [min(n, a + c) for n, a, c in zip(shape, low, grid, strict=True)]
        x = x[tuple(slice(0, h - a) for a, h in zip(low, high, strict=True))]
        flat = np.zeros(x.shape, np.int64)
        for d, (a, h) in enumerate(zip(low, high, strict=True)):
            flat += (np.arange(a, h) * prod(shape[d + 1 :])).reshape([-1 if i == d else 1 for i in range(len(shape))])
        flat, values = flat.ravel(), x.ravel().astype(np.float64)
        for a in range(0, len(flat), 65536):
            k = slice(a, a + 65536)
            yield pa.record_batch([pa.array([part.name] * len(flat[k])), pa.array(flat[k]), pa.array(values[k])], ["var", "idx", "value"])


class ZarrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr3"

    def schema(self) -> str:
        return "var string, idx long, value double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def open_dataset(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """Cells (var, idx, value) of a dataset, by its suffix."""
    if path.endswith((".zarr", ".zarr.zip")):
        spark.dataSource.register(ZarrSource)
        reader = spark.read.format("zarr3")
        return (reader.option("field", field) if field is not None else reader).load(path)
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        if "var" in df.columns:
            return df if field is None else df.where(F.col("var") == field)
        if field is None:
            raise ValueError(f"{path} is a wide table: name one of its columns as the field")
        return arrays.select_field(df, field, ["idx"])
    if path.endswith((".nc", ".grib")):
        from fieldpress.sources.netcdf import read_grid

        return read_grid(spark, path, field)
    raise ValueError(f"no reader for {path}; there are .nc, .grib, .zarr, .zarr.zip and .parquet")


def array_meta(shape: tuple[int, ...], chunk: tuple[int, ...], dtype: str, dims: list[str], comp: Codec | None = None, front: codecs.Front = (None, None), attributes: dict | None = None) -> dict:
    """A serializer's bytes differ in number by chunk; a compressor after it is `sized`: it begins a chunk with that number."""
    filt, ser = front
    used = [*([described(filt, dtype)] if filt else []), described(ser, dtype) if ser else {"name": "bytes", "configuration": {"endian": "little"}}, *([described(comp, dtype)] if comp else [])]
    if comp and ser:
        used[-1]["configuration"]["sized"] = True
    return {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": used, "dimension_names": dims, "attributes": attributes or {},
    }


GROUP = {"zarr_format": 3, "node_type": "group", "attributes": {}}
GZIP = Codec("GZip", (("level", 6),))


def rows_of_chunks(shape: tuple[int, ...], cells: int) -> int:
    """Leading entries of a chunk of at most `cells` cells, one at least."""
    return max(1, min(shape[0], cells // max(1, prod(shape[1:]))))


def write_field(chunks: DataFrame, path: str, var: str, shape: tuple[int, ...], chunk_rows: int, dtype: str, dims: list[str], comp: Codec | None = GZIP, front: codecs.Front = (None, None), attributes: dict | None = None) -> int:
    """Write chunk rows (chunk, payload: raw bytes of `chunk_rows` leading entries) as an array with a filter, a serializer and a compressor; how many chunks."""
    kind = np.dtype(TYPES[dtype])
    full = chunk_rows * prod(shape[1:]) * kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, n = Store(path), 0
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                body = codecs.front_encode(np.frombuffer(raw.as_py().ljust(full, b"\0"), kind), front)
                sized = len(body).to_bytes(8, "little") if comp and front[1] else b""
                store.put(f"{var}/c/{'/'.join([str(chunk), *['0'] * (len(shape) - 1)])}", sized + codecs.compress(body, comp, kind.itemsize))
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    n = chunks.select("chunk", "payload").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    store = Store(path)
    store.put(f"{var}/{META}", json.dumps(array_meta(shape, (chunk_rows, *shape[1:]), dtype, dims, comp, front, attributes)).encode())
    store.put(META, json.dumps(GROUP).encode())
    return n


def shape_of(path: str, field: str) -> tuple[tuple[int, ...], list[str], dict] | None:
    """Shape, dimension names and attributes of a store's field; None for other sources."""
    if not path.endswith((".zarr", ".zarr.zip")):
        return None
    meta = Store(path).arrays()[field]
    return tuple(meta["shape"]), meta.get("dimension_names") or [f"d{i}" for i in range(len(meta["shape"]))], meta.get("attributes") or {}


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or where that is unset, on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/stores-{uuid.uuid4().hex[:12]}"
    own = tempfile.mkdtemp(prefix="stores-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def zip_store(path: str, target: str) -> None:
    """A directory store as an uncompressed zip, written entry by entry."""
    store = Store(path)
    fs, to = pa.fs.FileSystem.from_uri(target if "://" in target else f"file://{target}")
    with fs.open_output_stream(to) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
        for key in sorted(store.keys()):
            z.writestr(key, store.get(key))


def unzip_store(path: str, target: str | None = None) -> str:
    """Extract a zip store; the target, by default the path without its last suffix, is replaced."""
    target = target or path.rsplit(".", 1)[0]
    source = Store(path)
    out = Store(target)
    if out.fs.get_file_info(out.root).type != pa.fs.FileType.NotFound:
        out.fs.delete_dir(out.root)
    for key in source.keys():
        out.put(key, source.get(key))
    return target


def copy_store(source: str, target: str) -> None:
    """Merge a store's keys into another, replacing equal ones; tasks copy them."""
    spark = SparkSession.active()
    keys = Store(source).keys()
    tasks = max(1, min(len(keys), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Store(source), Store(target)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                b.put(key, a.get(key))
            yield batch

    spark.createDataFrame([(k,) for k in keys], "key string").repartition(tasks, "key").mapInArrow(run, "key string").count()


def merge_fields(parts: dict[str, str], declared: list[str], target: str) -> None:
    """Stores of single fields as one zip store; every declared field must be there."""
    if gone := sorted(set(declared) - set(parts)):
        raise ValueError(f"no store for {', '.join(gone)}")
    work = target.removesuffix(".zip")
    for path in parts.values():
        copy_store(path, work)
    Store(work).put(META, json.dumps(GROUP).encode())
    zip_store(work, target)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(var, shape, dtype, dims, n_chunks, raw_bytes, stored_bytes, ratio) of each array."""
    store = Store(path)
    keys = store.keys()
    sizes = {i.filename: i.file_size for i in store.zip.infolist()} if store.zip else {k: store.fs.get_file_info(f"{store.root}/{k}").size for k in keys}
    rows = []
    for name, meta in sorted(store.arrays().items()):
        own = [k for k in keys if k.startswith(f"{name}/c/")]
        raw, stored = prod(meta["shape"]) * np.dtype(TYPES[meta["data_type"]]).itemsize, sum(sizes[k] for k in own)
        rows.append((name, meta["shape"], meta["data_type"], meta.get("dimension_names") or [], len(own), raw, stored, raw / stored if stored else None))
    return spark.createDataFrame(rows, "var string, shape array<long>, dtype string, dims array<string>, n_chunks long, raw_bytes long, stored_bytes long, ratio double")


def default_export(path: str, suffix: str = ".parquet") -> str:
    return path.rsplit(".", 1)[0] + suffix


def export(spark: SparkSession, path: str, target: str | None = None) -> str:
    """All arrays of a store as Parquet (var, idx, value); an error if it has none."""
    if not Store(path).arrays():
        raise ValueError(f"{path} has no arrays")
    target = target or default_export(path)
    open_dataset(spark, path).write.mode("overwrite").partitionBy("var").parquet(target)
    return target


def slabs(store: Store, name: str, meta: dict) -> Iterator[np.ndarray]:
    """An array's cells, a leading row of chunks at a time."""
    shape, grid = meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"]
    counts = [ceil(n / c) for n, c in zip(shape, grid, strict=True)]
    for first in range(counts[0]) if counts else ():
        rows = min(shape[0] - first * grid[0], grid[0])
        out = np.full((grid[0], *(n * c for n, c in zip(counts[1:], grid[1:], strict=True))), fill(meta), TYPES[meta["data_type"]])
        for rest in product(*map(range, counts[1:])):
            body = store.get(f"{name}/{chunk_key(meta, (first, *rest))}".lstrip("/"))
            if body is not None:
                out[(slice(None), *(slice(k * c, (k + 1) * c) for k, c in zip(rest, grid[1:], strict=True)))] = unpack(meta, body).reshape(grid)
        yield out[(slice(0, rows), *(slice(0, n) for n in shape[1:]))]


def to_netcdf(path: str, target: str | None = None) -> str:
    """All arrays of a store as a classic netCDF file; an error if it has none."""
    from fieldpress.sources.netcdf import write_grid

    store = Store(path)
    if not (found := store.arrays()):
        raise ValueError(f"{path} has no arrays")
    target = target or default_export(path, ".nc")
    write_grid(target, [(name or "data", tuple(meta["shape"]), TYPES[meta["data_type"]], slabs(store, name, meta)) for name, meta in sorted(found.items())])
    return target


def find_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """A file of that name anywhere below a folder, the first by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return files.where(F.substring_index("path", "/", -1) == name).agg(F.min("path")).first()[0]


def latest_file(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The most recently modified file of a folder whose name has the prefix."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.regexp_count(F.substring_index("path", folder.rstrip("/"), -1), F.lit("/")) == 1)
    return files.select("path", "modificationTime").agg(F.max_by("path", "modificationTime")).first()[0]
