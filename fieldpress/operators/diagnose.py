"""The periodicity diagnostic of a latitude-longitude field: does encoding notice a half turn?"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpress.functions.numeric import relative_error
from fieldpress.operators.arrays import guard, is_lat_lon, roll


def by_position(codec: Callable[[np.ndarray], np.ndarray], sizes: dict[str, int], dtype: str = "float64", rows: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A codec of arrays, as one of cells: applied to chunks of `rows` whole latitudes in flat order, as a store would."""
    lat, lon = sizes

    def apply(cells: DataFrame) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([(lat, "ascending"), (lon, "ascending")])
            x = codec(table.column("value").to_numpy().astype(dtype))
            return table.select([lat, lon]).append_column("value", pa.array(x.astype(np.float64)))

        own = cells.select(F.floor(F.col(lat) / rows).alias("chunk"), F.col(lat).cast("long"), F.col(lon).cast("long"), F.col("value").cast("double"))
        return own.groupBy("chunk").applyInArrow(run, f"{lat} long, {lon} long, value double")

    return apply


def periodicity_errors(cells: DataFrame, sizes: dict[str, int], codec: Callable[[DataFrame], DataFrame] | Callable[[Column], Column], dtype: str = "float64", columnwise: bool = True) -> DataFrame:
    """(lat, lon) with the field, its decoded and half-turned forms, and the errors between them.

    A row-wise codec (`columnwise`) is an expression: the half turn and its inverse are projections and
    nothing is joined. Any other codec maps cells to cells, and the half-turned result is joined back.
    """
    dims = list(sizes)
    if not is_lat_lon(dims):
        raise ValueError(f"the diagnostic needs dimensions (lat, lon), not {dims}")
    guard(list(sizes.values()), dtype)
    lat, lon = dims
    n = sizes[lon]
    half = n // 2
    if columnwise:
        both = cells.select(lat, lon, F.col("value").alias("original"), codec(F.col("value")).alias("decoded"))
        turned = both.withColumn("shifted", F.col("original")).withColumn("shifted_decoded", codec(F.col("shifted")))
    else:
        there = roll(cells, lon, n, half)
        back = roll(there.withColumnRenamed("value", "shifted").join(codec(there).withColumnRenamed("value", "shifted_decoded"), [lat, lon]), lon, n, -half)
        own = cells.withColumnRenamed("value", "original").join(codec(cells).withColumnRenamed("value", "decoded"), [lat, lon])
        turned = own.join(back, [lat, lon])
    c = F.col
    return turned.select(
        lat, lon, F.pmod(c(lon) + half, F.lit(n)).cast("long").alias("shifted_lon"), "original", "decoded", F.abs(c("original") - c("decoded")).alias("err"),
        "shifted", "shifted_decoded", F.abs(c("shifted") - c("shifted_decoded")).alias("shifted_err"), relative_error(c("original"), c("shifted")).alias("roll_err"),
        F.abs(c("decoded") - c("shifted_decoded")).alias("periodicity_err"), F.abs(c("original") - c("shifted_decoded")).alias("unshifted_err"),
    )
