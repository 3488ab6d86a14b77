"""Fields as tables of cells: selection, slicing, flattening, rolling, squeezing.

A field is a DataFrame of index columns (0-based longs) and a value column; sizes are metadata that the
caller has. All operators here are projections or filters: none shuffles.
"""

from __future__ import annotations

import re
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GUARD_BYTES = 2.5 * 2**30
ITEM = {"float64": 8, "float32": 4, "int64": 8, "int32": 4, "int16": 2, "int8": 1}


def select_field(df: DataFrame, field: str, dims: list[str]) -> DataFrame:
    """One field of a wide table: only its columns are read."""
    if field not in df.columns:
        raise ValueError(f"no field {field}; there are {', '.join(df.columns)}")
    return df.select(*dims, F.col(field).alias("value"))


def kept(size: int, percent: float) -> int:
    """How many leading entries of a dimension a percentage keeps: one at least."""
    return max(1, int(size * percent / 100))


def validate_percentage(percent: float | None) -> float | None:
    if percent is not None and not 1 <= percent <= 99:
        raise ValueError("a percentage must be between 1 and 99")
    return percent


def percent_slice(df: DataFrame, sizes: dict[str, int], percent: float | None) -> DataFrame:
    """The leading percentage of every dimension, as index predicates that reach the scan."""
    if validate_percentage(percent) is None:
        return df
    for dim, size in sizes.items():
        df = df.where(F.col(dim) < kept(size, percent))
    return df


def resized(df: DataFrame, sizes: dict[str, int], n_bytes: int, most: int = 10_000_000) -> DataFrame:
    """Dimensions longer than 1 cut by most / n_bytes where the field is larger than `most` bytes."""
    if n_bytes <= most:
        return df
    for dim, size in sizes.items():
        if size > 1:
            df = df.where(F.col(dim) < int(size * most / n_bytes))
    return df


def flat_index(dims: list[str], sizes: list[int]) -> Column:
    """C-order position."""
    out = F.lit(0).cast("long")
    for dim, size in zip(dims, sizes, strict=True):
        out = out * size + F.col(dim)
    return out


def unflatten(flat: Column, dims: list[str], sizes: list[int]) -> list[Column]:
    out, stride = [], prod(sizes)
    for dim, size in zip(dims, sizes, strict=True):
        stride //= size
        out.append(F.pmod(F.floor(flat / stride), F.lit(size)).cast("long").alias(dim))
    return out


def roll(df: DataFrame, dim: str, size: int, shift: int) -> DataFrame:
    """new[i] = old[(i - shift) mod size]."""
    return df.withColumn(dim, F.pmod(F.col(dim) + shift, F.lit(size)).cast("long"))


def squeeze(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    return df.drop(*[d for d, n in sizes.items() if n == 1])


def is_lat_lon(dims: list[str]) -> bool:
    return len(dims) == 2 and bool(re.search("lat", dims[0])) and bool(re.search("lon", dims[1]))


def n_bytes(sizes: list[int], dtype: str) -> int:
    return prod(sizes) * ITEM[dtype]


def guard(sizes: list[int], dtype: str) -> None:
    if (n := n_bytes(sizes, dtype)) > GUARD_BYTES:
        raise ValueError(f"a field of {n} bytes is too large for this diagnostic ({GUARD_BYTES:.0f} at most)")


def array_cells(df: DataFrame, row: str, array: str, names: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """A table of rows with an array as a two-dimensional field."""
    return df.select(F.col(row).cast("long").alias(names[0]), F.posexplode(array).alias("__at", "value")).select(names[0], F.col("__at").cast("long").alias(names[1]), "value")
