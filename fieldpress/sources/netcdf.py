"""netCDF grids: the classic format (CDF-1, -2 and -5) read and written here; netCDF-4 and GRIB through xarray, where it is installed.

Reading gives (var, idx, value), a task per range of some 2**20 cells, each of which reads its own bytes. A file
is written by one process, slab by slab of leading entries, as the format is one sequence of bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

# Names and numbers of the format.
MAGIC = b"CDF"
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
CELLS = 1 << 20


@dataclass(frozen=True)
class Variable:
    """Where a variable's cells lie: `step` bytes from one leading entry to the next."""

    name: str
    shape: tuple[int, ...]
    dims: tuple[str, ...]
    kind: str
    begin: int
    step: int


class _Header:
    def __init__(self, f):
        self.f = f
        magic = f.read(4)
        if magic[:3] != MAGIC or magic[3] not in (1, 2, 5):
            raise ValueError("not a classic netCDF file")
        self.count, self.offset = {1: (">I", ">I"), 2: (">I", ">Q"), 5: (">Q", ">Q")}[magic[3]]
        self.records = self.number()
        if self.records == (1 << 8 * struct.calcsize(self.count)) - 1:
            raise ValueError("a file that is still being written has no number of records")

    def number(self, form: str | None = None) -> int:
        form = form or self.count
        return struct.unpack(form, self.f.read(struct.calcsize(form)))[0]

    def name(self) -> str:
        n = self.number()
        return self.f.read(n + -n % 4)[:n].decode()

    def items(self, read) -> list:
        self.number(">I")
        return [read() for _ in range(self.number())]

    def attribute(self) -> None:
        self.name()
        kind = self.number(">I")
        n = self.number() * np.dtype(TYPES[kind]).itemsize
        self.f.read(n + -n % 4)


def variables(path: str) -> list[Variable]:
    """The variables of a classic file."""
    fs, at = _opened(path)
    with fs.open_input_file(at) as f:
        h = _Header(f)
        dims = h.items(lambda: (h.name(), h.number()))
        h.items(h.attribute)

        def variable() -> tuple:
            name, own = h.name(), [dims[h.number()] for _ in range(h.number())]
            h.items(h.attribute)
            kind, _ = h.number(">I"), h.number()
            return name, own, TYPES[kind], h.number(h.offset)

        raw = h.items(variable)
    size = lambda own, kind: prod(n for _, n in own[1:]) * np.dtype(kind).itemsize
    moving = [size(own, kind) for _, own, kind, _ in raw if own and own[0][1] == 0]
    record = moving[0] if len(moving) == 1 else sum(n + -n % 4 for n in moving)  # one record variable alone is not padded
    out = []
    for name, own, kind, begin in raw:
        if kind == "S1":
            continue
        grows = bool(own) and own[0][1] == 0
        shape = tuple(h.records if grows and i == 0 else n for i, (_, n) in enumerate(own))
        out.append(Variable(name, shape, tuple(d for d, _ in own), kind, begin, record if grows else size(own, kind)))
    return out


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _classic(path: str) -> bool:
    fs, at = _opened(path)
    with fs.open_input_stream(at) as f:
        return f.read(3) == MAGIC


def _rows(name: str, first: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(x), 65536):
        k = x[a : a + 65536]
        yield pa.record_batch([pa.array([name] * len(k)), pa.array(first + a + np.arange(len(k))), pa.array(k.astype(np.float64))], ["var", "idx", "value"])


def read_grid(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """(var, idx, value) of a grid file."""
    classic = path.endswith(".nc") and _classic(path)
    if classic:
        found = variables(path)
    else:
        try:
            import xarray
        except ImportError as e:
            raise ImportError(f"{path} needs xarray with a netCDF-4 or GRIB engine, which is not installed") from e
        engine = {"engine": "cfgrib", "backend_kwargs": {"indexpath": ""}} if path.endswith(".grib") else {}
        with xarray.open_dataset(path, **engine) as ds:
            found = [Variable(str(v), tuple(ds[v].shape), tuple(map(str, ds[v].dims)), "", 0, 0) for v in ds.data_vars]
    if field is not None and field not in [v.name for v in found]:
        raise ValueError(f"no field {field}; there are {', '.join(v.name for v in found)}")
    parts = []
    for i, v in enumerate(found):
        if field in (None, v.name):
            lead = v.shape[0] if v.shape else 1
            step = max(1, CELLS // max(1, prod(v.shape[1:])))
            parts += [(i, a, min(lead, a + step)) for a in range(0, lead, step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                v, low, high = found[r["var"]], r["low"], r["high"]
                rest = prod(v.shape[1:])
                if classic:
                    fs, at = _opened(path)
                    size = rest * np.dtype(v.kind).itemsize
                    with fs.open_input_file(at) as f:
                        spans = [(v.begin + low * v.step, (high - low) * size)] if v.step == size else [(v.begin + k * v.step, size) for k in range(low, high)]
                        x = np.frombuffer(b"".join(f.read_at(n, start) for start, n in spans), v.kind)
                else:
                    with xarray.open_dataset(path, **engine) as ds:
                        x = np.asarray(ds[v.name][low:high] if v.shape else ds[v.name]).ravel()
                yield from _rows(v.name, low * rest, x)

    todo = spark.createDataFrame(parts, "var int, low long, high long").repartition(max(1, len(parts)))
    return todo.mapInArrow(run, "var string, idx long, value double")


def write_grid(path: str, arrays: list[tuple[str, tuple[int, ...], str, Iterator[np.ndarray]]]) -> None:
    """Write (name, shape, numpy type, slabs of leading entries in order) as a classic file of 64-bit sizes; dimensions are named `{name}_d{i}`."""
    codes = {np.dtype(t): k for k, t in TYPES.items()}
    number = lambda n: struct.pack(">Q", n)
    name = lambda s: number(len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    dims = [(f"{n}_d{i}", size) for n, shape, _, _ in arrays for i, size in enumerate(shape)]
    places = {d: i for i, (d, _) in enumerate(dims)}
    listed = lambda tag, items: struct.pack(">I", tag if items else 0) + number(len(items)) + b"".join(items)
    none = listed(0, [])

    def header(begins: list[int]) -> bytes:
        own = []
        for (n, shape, kind, _), begin in zip(arrays, begins, strict=True):
            big = np.dtype(kind).newbyteorder(">")
            size = prod(shape) * big.itemsize
            own.append(name(n) + number(len(shape)) + b"".join(number(places[f"{n}_d{i}"]) for i in range(len(shape))) + none + struct.pack(">I", codes[big]) + number(size + -size % 4) + number(begin))
        return MAGIC + b"\x05" + number(0) + listed(DIMENSION, [name(d) + number(n) for d, n in dims]) + none + listed(VARIABLE, own)

    at, begins = len(header([0] * len(arrays))), []
    for _, shape, kind, _ in arrays:
        begins.append(at)
        size = prod(shape) * np.dtype(kind).itemsize
        at += size + -size % 4
    fs, to = _opened(path)
    with fs.open_output_stream(to) as f:
        f.write(header(begins))
        for n, shape, kind, slabs in arrays:
            size = 0
            for slab in slabs:
                size += f.write(slab.astype(np.dtype(kind).newbyteorder(">")).tobytes())
            if size != prod(shape) * np.dtype(kind).itemsize:
                raise ValueError(f"{n} has {size} bytes of cells, not those of its shape {shape}")
            f.write(b"\0" * (-size % 4))
