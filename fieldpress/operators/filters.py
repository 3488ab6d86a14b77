"""Filters as expressions, their statistics, and the order-dependent Delta filter.

Delta differs each cell from the one before in flat order. Cells are dealt to chunks of flat positions,
so windows are bounded; what crosses chunks (a chunk's last value, or its sum) is one row per chunk.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpress.functions import numeric as N
from fieldpress.operators.space import Codec, FieldInfo

CHUNK = 1 << 20
#: Values that are fetched and sorted once a quantile is bracketed.
HELD = 1 << 16


def field_stats(df: DataFrame, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population deviation, minimum and maximum without NaN, and the count of cells, in one pass."""
    x = N.known(F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(F.lit(1)).alias("n"))


def ranked(x: DataFrame, rank: int, n: int, held: int | None = None) -> float:
    """The value of a 0-based rank among the `n` values of x, exact, without gathering them.

    Approximate percentiles bracket the rank and a count tells how many values lie below, until few lie
    inside; what an aggregation holds is bounded by the accuracy asked for, not by the values.
    """
    held = HELD if held is None else held
    low, high, below, inside, accuracy = -math.inf, math.inf, 0, n, 10_000
    while inside > held and low < high:
        part = x.where(F.col("x").between(low, high))
        at, off = (rank - below) / inside, 2 / accuracy
        a, b = part.agg(F.percentile_approx("x", [max(0.0, at - off), min(1.0, at + off)], accuracy)).first()[0]
        under, upto = part.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x") <= b)).first()
        if not under <= rank - below < upto:
            a, b, under, upto = low, high, 0, inside
        if (a, b) == (low, high):  # very many equal values at the lower end: past them, or one of them
            a = part.agg(F.min("x")).first()[0]
            upto = part.agg(F.count_if(F.col("x") == a)).first()[0]
            if rank - below < upto:
                return a
            a, under, upto = math.nextafter(a, math.inf), upto, inside
        low, high, below, inside = a, b, below + under, upto - under
    if low == high:
        return low
    values = np.sort(x.where(F.col("x").between(low, high)).toArrow().column(0).to_numpy())
    return float(values[rank - below])


def quantile(df: DataFrame, column: Column, q: float) -> float | None:
    """The interpolated quantile of a column's values, nulls left out; None if there are none."""
    x = df.select(column.alias("x")).where("x IS NOT NULL")
    n = x.count()
    if not n:
        return None
    at = q * (n - 1)
    low = ranked(x, math.floor(at), n)
    upto, above = x.agg(F.count_if(F.col("x") <= low), F.min(F.when(F.col("x") > low, F.col("x")))).first()
    high = low if upto > math.floor(at) + 1 or above is None else above
    return low + (high - low) * (at - math.floor(at))


def linear_width(df: DataFrame, value: str = "value", q: float = 0.01, floor: float | None = None, cap: float | None = None) -> DataFrame:
    """The quantile of |x| over finite cells, interpolated, clipped if asked; one row."""
    x = F.col(value).cast("double")
    width = quantile(df, F.when(N.finite(x), F.abs(x)), q)
    return df.sparkSession.createDataFrame([(width,)], "w double").select(N.clip(F.col("w"), floor, cap).alias("linear_width"))


def field_info(df: DataFrame, dtype: str, value: str = "value", shape: tuple[int, ...] = ()) -> FieldInfo:
    """The statistics that the filter space needs, computed once per field."""
    if dtype.startswith("int"):
        return FieldInfo(dtype, shape=shape)
    x = F.col(value).cast("double")
    k = N.known(x)
    r = df.agg(F.avg(k).alias("mean"), F.stddev_pop(k).alias("std"), F.min(k).alias("low"), F.max(k).alias("high")).first()
    return FieldInfo(dtype, r.mean, r.std, r.low, r.high, quantile(df, F.when(N.finite(x), F.abs(x)), 0.01), shape)


def _chunked(df: DataFrame, index: str, chunk: int) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(index) / chunk).cast("long"))


def delta_encode(df: DataFrame, index: str, value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """Adds `delta`: the first value, then differences. `index` is the dense flat position."""
    cells = _chunked(df, index, chunk)
    ends = cells.groupBy((F.col("__chunk") + 1).alias("__chunk")).agg(F.max_by(value, index).alias("__end"))
    before = F.lag(value).over(Window.partitionBy("__chunk").orderBy(index))
    zero = F.lit(0).cast(df.schema[value].dataType)
    return cells.join(ends, "__chunk", "left").withColumn("delta", F.col(value) - F.coalesce(before, F.col("__end"), zero)).drop("__chunk", "__end")


def delta_decode(df: DataFrame, index: str, delta: str = "delta", chunk: int = CHUNK) -> DataFrame:
    """Adds `decoded`: running sums within chunks on top of the sums of the chunks before."""
    cells = _chunked(df, index, chunk)
    sums = cells.groupBy("__chunk").agg(F.sum(delta).alias("__sum"))
    upto = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__chunk", F.sum("__sum").over(upto).alias("__base"))  # one row per chunk
    running = F.sum(delta).over(Window.partitionBy("__chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    return cells.join(base, "__chunk").withColumn("decoded", running + F.coalesce(F.col("__base"), F.lit(0))).drop("__chunk", "__base")


def encode(x: Column, codec: Codec | None, dtype: str = "float64") -> Column:
    """A row-wise filter's encoded value."""
    if codec is None or codec.family == "Delta":
        return x
    if codec.family == "BitRound":
        return N.bitround(x, codec.get("keepbits"), 52 if dtype == "float64" else 23)
    if codec.family == "Quantize":
        return N.quantize(x, codec.get("digits"))
    if codec.family == "Asinh":
        return N.asinh_encode(x, F.lit(codec.get("linear_width")))
    return N.scale_encode(x, F.lit(codec.get("offset")), F.lit(codec.get("scale")))


def decode(c: Column, codec: Codec | None) -> Column:
    if codec is not None and codec.family == "Asinh":
        return N.asinh_decode(c, F.lit(codec.get("linear_width")))
    if codec is not None and codec.family == "FixedOffsetScale":
        return N.scale_decode(c, F.lit(codec.get("offset")), F.lit(codec.get("scale")))
    return c
