"""Commands: sweep a field, encode with chosen indices, merge, inspect, export, cluster, diagnose.

    python -m fieldpress.cli evaluate_combos DATASET OUT --field t --l1 0.002 --compressor-class Zlib
"""

from __future__ import annotations

import argparse
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpress.operators import arrays, clustering, codecs, filters, metrics
from fieldpress.operators.diagnose import by_position, periodicity_errors
from fieldpress.operators.space import Flags, check_index, config_frame, filter_space, get_indexes
from fieldpress.plans import sweep
from fieldpress.sources import zarr


def _field(spark: SparkSession, path: str, field: str) -> DataFrame:
    return zarr.open_dataset(spark, path, field).select("idx", "value")


def _flags(a: argparse.Namespace) -> Flags:
    return Flags(not a.without_lossy, not a.without_numcodecs_wasm, not a.without_ebcc, a.compressor_class, a.filter_class, a.serializer_class)


def evaluate_combos(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Scores of every runnable configuration of one field, or of all, within its L1 limit, written to `out`; shows the best of each.

    The limit is --l1, or else the field's row in the --thresholds table. The configurations that were searched go
    to `out`-space, seconds by phase are printed.
    """
    names = [a.field] if a.field else [r["var"] for r in zarr.open_dataset(spark, a.dataset).select("var").distinct().collect()]
    limits = dict.fromkeys(names, a.l1)
    if a.l1 is None and a.thresholds:
        units = [(n, ((zarr.shape_of(a.dataset, n) or ((), [], {}))[2]).get("units")) for n in names]
        found = metrics.threshold_lookup(spark.createDataFrame(units, "var string, unit string"), metrics.read_thresholds(spark, a.thresholds))
        limits = {r["var"]: r.limit for r in found.collect()}
    profile = metrics.Profile()
    for i, field in enumerate(names):
        cells = _field(spark, a.dataset, field)
        sizes = {"idx": cells.count()} if arrays.validate_percentage(a.percentage) or a.most_bytes else None
        if a.most_bytes:
            cells = arrays.resized(cells, sizes, arrays.n_bytes(list(sizes.values()), a.dtype), a.most_bytes)
        with profile.timer("evaluate_combos"):
            scored = sweep.evaluate_combos(cells, a.dtype, limits[field], _flags(a), sizes, a.percentage).select(F.lit(field).alias("var"), "*")
            scored.write.mode("append" if i else "overwrite").partitionBy("var").parquet(a.out)
        with profile.timer("config_space"):
            space = config_frame(spark, filters.field_info(cells, a.dtype), _flags(a)).select(F.lit(field).alias("var"), "*")
            space.write.mode("append" if i else "overwrite").partitionBy("var").parquet(f"{a.out}-space")
    for label, calls, mean, total in profile.summary():
        print(f"{label}: {calls} calls, {mean:.3f} s on average, {total:.3f} s in all")
    return metrics.best_combo(spark.read.parquet(a.out), ("var",))


def best(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The best configuration of each field in a table of scores, its figures as text."""
    return metrics.described(metrics.best_combo(spark.read.parquet(a.scores), ("var",)))


def indexes(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Indices of codecs by name, from a table of configurations that evaluate_combos wrote."""
    return get_indexes(spark.read.parquet(a.space), a.compressor, a.filter, a.serializer)


def compress_with_optimal(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """One field as a Zarr store `out`, with the codecs of these indices; shows its ratio and errors."""
    cells = _field(spark, a.dataset, a.field)
    shape, dims, attributes = zarr.shape_of(a.dataset, a.field) or ((cells.count(),), ["idx"], {})
    rows = zarr.rows_of_chunks(shape, codecs.CHUNK_CELLS)
    comp, front = sweep.chosen(cells, a.dtype, a.comp_idx, a.filt_idx, a.ser_idx, _flags(a))
    chunks = codecs.chunked(cells, a.dtype, cells=rows * prod(shape[1:]))
    zarr.write_field(chunks, a.out, a.field, shape, rows, a.dtype, dims, comp, front, attributes)
    return sweep.scores(chunks, a.dtype, comp, front)


def merge_compressed_fields(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    declared = [r["var"] for r in zarr.open_dataset(spark, a.dataset).select("var").distinct().collect()]
    parts = {p.rstrip("/").rsplit("/", 1)[-1].split(".zarr")[0]: p for p in a.stores}
    zarr.merge_fields(parts, declared, a.out)
    return zarr.inspect(spark, a.out)


def inspect(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return zarr.inspect(spark, a.store)


def export(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.read.parquet(zarr.export(spark, a.store, a.out))


def from_zarr_zip_to_netcdf(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A store's arrays as one netCDF file; shows them."""
    zarr.to_netcdf(a.store, a.out)
    return zarr.inspect(spark, a.store)


def perform_clustering(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return clustering.elbow(spark.read.parquet(a.scores), a.l_error)


def analyze_clustering(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    points, centres = clustering.cluster_scored(spark.read.parquet(a.scores))
    centres.show(100, False)
    return points


def periodicity(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Errors of a filter and of its half-turned field."""
    flat = _field(spark, a.dataset, a.field)
    codec = check_index(a.filt_idx, filter_space(filters.field_info(flat, a.dtype), _flags(a)), "filter")
    lat, lon = arrays.unflatten(F.col("idx"), ["lat", "lon"], [a.lat, a.lon])
    cells, sizes = flat.select(lat, lon, "value"), {"lat": a.lat, "lon": a.lon}
    if codec is None or codec.family != "Delta":
        return periodicity_errors(cells, sizes, lambda x: filters.decode(filters.encode(x, codec, a.dtype), codec), a.dtype)
    return periodicity_errors(cells, sizes, by_position(lambda x: codecs.filter_decode(codecs.filter_encode(x, codec), codec), sizes, a.dtype), a.dtype, columnwise=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fieldpress", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, *positional: str, space: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        for name in positional:
            p.add_argument(name, type=int if name.endswith("_idx") or name in ("lat", "lon") else str)
        if space:
            p.add_argument("--dtype", default="float64")
            for name in ("compressor", "filter"):
                p.add_argument(f"--{name}-class", default="all")
            p.add_argument("--serializer-class", default="none")
            for name in ("lossy", "numcodecs-wasm", "ebcc"):
                p.add_argument(f"--without-{name}", action="store_true")
        return p

    p = command(evaluate_combos, "dataset", "out", space=True)
    p.add_argument("--field")
    p.add_argument("--percentage", type=float)
    p.add_argument("--l1", type=float)
    p.add_argument("--most-bytes", type=int, help="cut a larger field to this size, leading entries first")
    p.add_argument("--thresholds", help="CSV of Short Name, Unit and Existing L1 error")
    command(best, "scores")
    command(indexes, "space", "compressor", "filter", "serializer")
    command(compress_with_optimal, "dataset", "out", "field", "comp_idx", "filt_idx", "ser_idx", space=True)
    command(merge_compressed_fields, "dataset", "out").add_argument("stores", nargs="+")
    command(inspect, "store")
    command(export, "store").add_argument("--out")
    command(from_zarr_zip_to_netcdf, "store").add_argument("--out")
    command(perform_clustering, "scores").add_argument("l_error", choices=list(metrics.ERRORS))
    command(analyze_clustering, "scores")
    command(periodicity, "dataset", "field", "lat", "lon", "filt_idx", space=True)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"fieldpress {a.command}").getOrCreate()
    a.run(spark, a).show(50, False)


if __name__ == "__main__":
    main()
