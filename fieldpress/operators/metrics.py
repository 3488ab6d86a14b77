"""Errors, ratios, thresholds and rankings of configurations."""

from __future__ import annotations

import math
import time
from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldpress.functions.numeric import decimal_comma, finite, safe_div, scientific

# The rule for how many clusters a result has.
CLUSTERS_MOST, RESULTS_MOST = 6, 42_976
ERRORS = {"L1": "rel_l1", "L2": "rel_l2", "LInf": "rel_linf"}


def partial_errors(original: Column, decoded: Column) -> list[Column]:
    """The six reductions that all norms need, made in one aggregation."""
    x, e = original.cast("double"), decoded.cast("double") - original.cast("double")
    return [F.sum(F.abs(e)).alias("sum_abs_e"), F.sum(F.abs(x)).alias("sum_abs_x"), F.sum(e * e).alias("sum_sq_e"), F.sum(x * x).alias("sum_sq_x"), F.max(F.abs(e)).alias("max_abs_e"), F.max(F.abs(x)).alias("max_abs_x")]


def norms() -> list[Column]:
    """Relative L1, L2 and L-infinity errors and the Euclidean distance, of the partial sums."""
    c = F.col
    return [
        safe_div(c("sum_abs_e"), c("sum_abs_x")).alias("rel_l1"), safe_div(F.sqrt("sum_sq_e"), F.sqrt("sum_sq_x")).alias("rel_l2"),
        safe_div(c("max_abs_e"), c("max_abs_x")).alias("rel_linf"), F.sqrt("sum_sq_e").alias("euclid"),
    ]


def error_norms(df: DataFrame, original: str, decoded: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*partial_errors(F.col(original), F.col(decoded))).select(*keys, *norms())


def threshold_gate(scored: DataFrame, limit: float | None = None, column: str | None = None) -> DataFrame:
    """Rows within the L1 limit; no limit, and a limit of 0, keep all. NaN errors never pass a limit."""
    t = F.col(column) if column else F.lit(limit).cast("double")
    return scored.where(t.isNull() | (t == 0) | (F.col("rel_l1") <= t))


def threshold_lookup(fields: DataFrame, thresholds: DataFrame) -> DataFrame:
    """`fields` (var, unit) with `limit`: the first row of the variable's name, if its unit agrees and its number isn't blank.

    `thresholds`: short_name, unit, existing_l1_error (decimal comma), and `line`, the order of rows.
    """
    first = thresholds.groupBy("short_name").agg(F.min_by(F.struct("unit", "existing_l1_error"), "line").alias("row"))
    both = fields.join(first, fields["var"] == first["short_name"], "left")
    return both.select(*fields.columns, F.when(F.col("row.unit") == fields["unit"], decimal_comma(F.col("row.existing_l1_error"))).alias("limit"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """The table that `threshold_lookup` takes, from a CSV file with the columns Short Name, Unit and Existing L1 error."""
    names = {"Short Name": "short_name", "Unit": "unit", "Existing L1 error": "existing_l1_error"}
    table = spark.read.option("header", True).csv(path)
    if gone := [c for c in names if c not in table.columns]:
        raise ValueError(f"no column {', '.join(gone)} in {path}")
    return table.select(F.monotonically_increasing_id().alias("line"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in names.items()])


def best_combo(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The row of the highest ratio; among equals, the lowest ordinal. Empty stays empty."""
    if not keys:
        return scored.orderBy(F.desc("ratio"), "ordinal").limit(1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ratio"), "ordinal"))
    return scored.withColumn("__place", place).where("__place = 1").drop("__place")


def described(scored: DataFrame) -> DataFrame:
    """Ratio, errors and distance as text."""
    names = [c for c in scored.columns if c not in ("ratio", "rel_l1", "rel_l2", "rel_linf", "euclid")]
    return scored.select(*names, F.format_string("%.3f", "ratio").alias("ratio"), *[scientific(F.col(c)).alias(c) for c in ("rel_l1", "rel_l2", "rel_linf", "euclid")])


def single_cluster(points: DataFrame, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Whether all points, or those of each key, are in one cluster: `single`."""
    return points.groupBy(*keys).agg((F.min(label) == F.max(label)).alias("single"))


def finite_rows(df: DataFrame) -> DataFrame:
    """Rows whose numeric columns are all finite."""
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.where(finite(F.col(name)))
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            df = df.where(F.col(name).isNotNull())
    return df


def error_column(name: str) -> str:
    if name not in ERRORS:
        raise ValueError(f"no error {name}; there are {', '.join(ERRORS)}")
    return ERRORS[name]


def cluster_count(n: int) -> int:
    return math.ceil(CLUSTERS_MOST * n / RESULTS_MOST)


class Profile:
    """Calls, average and total seconds by label."""

    def __init__(self):
        self.times: dict[str, list[float]] = defaultdict(list)

    @contextmanager
    def timer(self, label: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.times[label].append(time.perf_counter() - began)

    def summary(self) -> list[tuple[str, int, float, float]]:
        return [(k, len(v), sum(v) / len(v), sum(v)) for k, v in sorted(self.times.items())]
