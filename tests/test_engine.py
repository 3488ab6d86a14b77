import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldpress import cli
from fieldpress.functions import numeric as N
from fieldpress.operators import arrays, clustering, codecs, filters, metrics, serializers, space
from fieldpress.operators.diagnose import periodicity_errors
from fieldpress.operators.space import Codec, Flags
from fieldpress.plans import sweep
from fieldpress.sources import netcdf, zarr


def cells(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, value double")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, width=64), min_size=1, max_size=60), st.sampled_from([c for _, c in space.compressor_space()]))
def test_compressors_are_lossless(values, codec):
    raw = np.array(values).tobytes()
    assert codecs.decompress(codecs.compress(raw, codec), codec, len(raw)) == raw


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(1e-300, 1e300), min_size=1, max_size=60), st.integers(1, 52))
def test_bitround_bound(values, keep):
    x = np.array(values)
    assert (np.abs(codecs.bitround(x, keep) - x) <= np.abs(x) * 2.0 ** -(keep + 1)).all()


def test_expression_equals_bits(spark):
    x = np.random.default_rng(1).normal(size=3000) * 10.0 ** np.random.default_rng(2).integers(-6, 6, 3000)
    for keep in (1, 10, 19, 46):
        got = [r[0] for r in cells(spark, x).select(N.bitround(F.col("value"), keep), "idx").orderBy("idx").collect()]
        assert np.array_equal(got, codecs.bitround(x, keep))


def test_delta_across_chunks(spark):
    x = list(range(50, 0, -3)) + [7, 7, 0]
    df = filters.delta_encode(cells(spark, x), "idx", chunk=4)
    assert [r.delta for r in df.orderBy("idx").collect()] == np.diff(x, prepend=0).tolist()
    assert [r.decoded for r in filters.delta_decode(df, "idx", chunk=4).orderBy("idx").collect()] == x


def test_norms_of_zero_nan_and_empty(spark):
    zero = cells(spark, [0.0] * 5)
    r = metrics.error_norms(zero.withColumn("d", F.lit(0.0)), "value", "d").first()
    assert math.isnan(r.rel_l1) and metrics.threshold_gate(spark.createDataFrame([(r.rel_l1,)], "rel_l1 double"), 0.1).count() == 0
    r = metrics.error_norms(zero.withColumn("d", F.lit(1.0)), "value", "d").first()
    assert r.rel_l1 == math.inf
    nan = cells(spark, [1.0, math.nan, 3.0, -math.inf])
    s = filters.field_stats(nan.where("idx < 3")).first()
    assert (s["mean"], s["std"], s["low"], s["high"]) == (2.0, 1.0, 1.0, 3.0)
    assert filters.linear_width(nan).first()[0] == pytest.approx(1.02)
    assert metrics.finite_rows(nan).count() == 2
    assert metrics.best_combo(spark.createDataFrame([], "ratio double, ordinal long")).count() == 0


def test_ties_take_the_lowest_ordinal(spark):
    df = spark.createDataFrame([(5, 2.0), (3, 2.0), (1, 1.0)], "ordinal long, ratio double")
    assert metrics.best_combo(df).first().ordinal == 3


def test_sweep_partials_equal_whole(spark):
    x = np.random.default_rng(0).normal(280, 10, 3000)
    flags = Flags(compressor="Zlib", serializer="none")
    scored = sweep.evaluate_combos(cells(spark, x), "float64", None, flags, chunk_cells=1 << 20).collect()
    assert len(scored) == 3 * 16
    split = {r.ordinal: r for r in sweep.evaluate_combos(cells(spark, x), "float64", None, flags, chunk_cells=700).collect()}
    for r in scored:
        if r.filter.startswith(("BitRound", "Quantize", "None")):
            assert r.rel_l1 == pytest.approx(split[r.ordinal].rel_l1, rel=1e-9)
            codec = space.filter_space(filters.field_info(cells(spark, x), "float64"), flags)[r.filt_idx][1]
            d = codecs.filter_decode(codecs.filter_encode(x, codec), codec)
            assert r.rel_l1 == pytest.approx(np.abs(d - x).sum() / np.abs(x).sum(), rel=1e-9)
    by_filter = {}
    for r in scored:
        by_filter.setdefault(r.filt_idx, set()).add(r.rel_l2)
    assert all(len(v) == 1 for v in by_filter.values())


def test_compress_by_index_round_trip(spark):
    x = np.arange(1000.0)
    chunks, scores = sweep.compress(cells(spark, x), "float64", 67, -1)
    assert scores.first().rel_l1 == 0 and scores.first().ratio > 1
    comp = space.compressor_space()[67][1]
    back = sweep.cells_of(sweep.decoded(chunks, "float64", comp, (None, None)), "float64").orderBy("idx").collect()
    assert [r.value for r in back] == x.tolist()
    with pytest.raises(IndexError):
        sweep.compress(cells(spark, x), "float64", 99, -1)
    comp, front = sweep.chosen(cells(spark, x), "float64", 67, 0, 1)
    chunks, scores = sweep.compress(cells(spark, x), "float64", 67, 0, 1)
    assert front[1].family == "PCodec" and scores.first().rel_l1 == 0
    assert [r.value for r in sweep.cells_of(sweep.decoded(chunks, "float64", comp, front), "float64").orderBy("idx").collect()] == x.tolist()
    assert sweep.chosen(cells(spark, x), "float64", 0, 3, 33)[1] == (None, space.serializer_space(space.FieldInfo("float64"))[33][1])  # Zfp takes the field as it is


def test_gate_before_compressors_changes_no_result(spark):
    x = np.random.default_rng(0).normal(280, 10, 2000)
    flags = Flags(compressor="Zlib", serializer="PCodec")
    every = {r.ordinal: r.ratio for r in metrics.threshold_gate(sweep.evaluate_combos(cells(spark, x), "float64", None, flags, chunk_cells=600), 1e-3).collect()}
    assert {r.ordinal: r.ratio for r in sweep.evaluate_combos(cells(spark, x), "float64", 1e-3, flags, chunk_cells=600).collect()} == every
    kept = sweep.within(codecs.chunked(cells(spark, x), "float64"), "float64", sweep.runnable(filters.field_info(cells(spark, x), "float64"), flags), 1e-3)
    assert 0 < len(kept) < 3 * 16 * 12 and sweep.evaluate_combos(cells(spark, x), "float64", 1e-300, Flags(compressor="Zlib", filter="BitRound", serializer="ZFPY")).count() == 0


KINDS = [(d, np.dtype(k)) for d, k in codecs.NUMPY.items()]


@settings(max_examples=80, deadline=None)
@given(st.sampled_from(KINDS), st.data())
def test_serializers_keep_their_bounds(kind, data):
    dtype, k = kind
    values = st.floats(-(2.0**100), 2.0**100, width=32) if k.kind == "f" else st.integers(np.iinfo(k).min, np.iinfo(k).max)
    x = np.array(data.draw(st.lists(values, max_size=200)), k)
    codec = data.draw(st.sampled_from([c for _, c in space.serializer_space(space.FieldInfo(dtype))]))
    y = serializers.decode(serializers.encode(x, codec), codec, k)
    assert y.dtype == k and len(y) == len(x)
    if codec.family == "PCodec":
        assert y.tobytes() == x.tobytes()
    else:
        rounding = np.spacing(np.abs(x)).astype(np.float64) if k.kind == "f" else 0.5 + np.abs(x.astype(np.float64)) * 2.0**-52
        assert (np.abs(y.astype(np.float64) - x.astype(np.float64)) <= serializers.bound(x, codec) + rounding).all()


def test_serializers_of_what_is_not_finite():
    x = np.array([0.0, -0.0, np.nan, np.inf, -np.inf, 1e308, 5e-324])
    for _, c in space.serializer_space(space.FieldInfo("float64")):
        y = serializers.decode(serializers.encode(x, c), c, "<f8")
        assert y.tobytes() == x.tobytes() if c.family == "PCodec" else np.isfinite(y).all() and (y[2:5] == 0).all()


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(filters, "HELD", 20)
    r = np.random.default_rng(4)
    for x in (r.normal(size=3000), np.repeat([0.0, 1.0], [700, 300]), np.zeros(500), r.integers(0, 4, 900).astype(float), np.array([3.5]), np.sort(r.pareto(0.3, 2000))):
        df = cells(spark, r.permutation(x)).repartition(3).cache()
        for q in (0.0, 0.01, 0.5, 0.7, 0.9, 1.0):
            assert filters.quantile(df, F.col("value"), q) == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-15)
    assert filters.quantile(cells(spark, []), F.col("value"), 0.5) is None
    assert "percentile(" not in filters.linear_width(cells(spark, [1.0, 2.0]))._jdf.queryExecution().toString().lower()


def test_roll_of_odd_size_inverts(spark):
    df = spark.createDataFrame([(i, j, float(i * 9 + j)) for i in range(7) for j in range(9)], "lat long, lon long, value double")
    there = arrays.roll(df, "lon", 9, 4)
    assert there.where("lat = 0 AND lon = 4").first().value == 0.0
    assert sorted(arrays.roll(there, "lon", 9, -4).collect()) == sorted(df.collect())
    p = periodicity_errors(df, {"lat": 7, "lon": 9}, lambda x: N.quantize(x, 1))
    assert p.agg(F.max("roll_err"), F.max("periodicity_err")).first() == (0.0, 0.0)
    delta = lambda c: c.withColumn("value", F.rint(F.col("value") / 4 + F.col("lon") % 2))
    q = periodicity_errors(df, {"lat": 7, "lon": 9}, delta, columnwise=False)
    assert q.count() == 63 and q.agg(F.max("periodicity_err")).first()[0] > 0
    with pytest.raises(ValueError):
        periodicity_errors(df, {"lon": 7, "lat": 9}, lambda x: x)


def test_clusters(spark):
    df = spark.createDataFrame([(float(i % 2) * 100 + i * 0.01, float(i), float(i), float(i)) for i in range(40)], "ratio double, rel_l1 double, rel_l2 double, rel_linf double")
    assert {r.cluster for r in clustering.cluster_scored(df)[0].collect()} == {0}
    e = {r.k: r for r in clustering.elbow(df, "L1", (1, 2)).collect()}
    assert e[1].inertia > e[2].inertia and e[2].silhouette > 0.5 and e[1].silhouette == 0


def test_zarr_round_trip_merge_and_inspect(spark, tmp_path):
    x = np.arange(10 * 6, dtype=np.float64).reshape(10, 6)
    rows = [(c, x[4 * c : 4 * c + 4].tobytes()) for c in range(3)]
    chunks = spark.createDataFrame(rows, "chunk long, payload binary")
    parts = {}
    for var in ("t", "q"):
        parts[var] = f"{tmp_path}/{var}.zarr"
        assert zarr.write_field(chunks, parts[var], var, (10, 6), 4, "float64", ["lat", "lon"]) == 3
    got = zarr.open_dataset(spark, parts["t"], "t").orderBy("idx").collect()
    assert [r.value for r in got] == x.ravel().tolist()
    whole = f"{tmp_path}/all.zarr.zip"
    zarr.merge_fields(parts, ["t", "q"], whole)
    assert zarr.open_dataset(spark, whole).groupBy("var").count().count() == 2
    info = {r["var"]: r for r in zarr.inspect(spark, whole).collect()}
    assert info["t"].n_chunks == 3 and info["t"].dims == ["lat", "lon"] and info["t"].ratio > 1
    with pytest.raises(ValueError):
        zarr.merge_fields({"t": parts["t"]}, ["t", "q"], whole)
    out = zarr.export(spark, whole)
    assert out.endswith("all.zarr.parquet") and spark.read.parquet(out).count() == 120
    again = zarr.unzip_store(whole, f"{tmp_path}/again.zarr")
    assert json.loads((tmp_path / "again.zarr" / "t" / "zarr.json").read_text())["shape"] == [10, 6] and again
    with pytest.raises(Exception, match="no field"):
        zarr.open_dataset(spark, whole, "z").count()
    with pytest.raises(ValueError, match="no reader"):
        zarr.open_dataset(spark, "x.csv")
    assert zarr.latest_file(spark, str(tmp_path), "all").endswith("all.zarr.zip")


FRONTS = [(f, None) for _, f in space.filter_space(space.FieldInfo("float64", 5.0, 2.0, 0.0, 10.0, 0.5))][::3] + [(None, None)] + [(None, s) for _, s in space.serializer_space(space.FieldInfo("float64"))][::9]


@pytest.mark.parametrize("comp", [None, *[c for _, c in space.compressor_space()][::11]], ids=str)
def test_zarr_with_every_kind_of_codec(spark, tmp_path, comp):
    x = np.random.default_rng(1).uniform(0, 10, (9, 5))
    chunks = spark.createDataFrame([(c, x[2 * c : 2 * c + 2].tobytes()) for c in range(5)], "chunk long, payload binary")
    for i, front in enumerate(FRONTS):
        path = f"{tmp_path}/{i}.zarr"
        assert zarr.write_field(chunks, path, "t", (9, 5), 2, "float64", ["lat", "lon"], comp, front) == 5
        want = np.concatenate([codecs.front_decode(codecs.front_encode(y, front), front, y.dtype) for y in np.pad(x, ((0, 1), (0, 0))).reshape(5, 10)])[:45]
        store = zarr.Store(path)
        meta = store.arrays()["t"]
        got = np.concatenate([zarr.unpack(meta, store.get(f"t/{zarr.chunk_key(meta, (c, 0))}")) for c in range(5)])[:45]
        assert got.tolist() == pytest.approx(want.tolist(), rel=1e-12, abs=1e-12), front
    assert [r.value for r in zarr.open_dataset(spark, path, "t").orderBy("idx").collect()] == pytest.approx(want.tolist())


def test_netcdf(spark, tmp_path):
    r = np.random.default_rng(3)
    whole = {"t": r.normal(size=(7, 4, 3)), "n": r.integers(-9, 9, (5,)).astype("<i4"), "h": r.integers(-9, 9, (3, 3)).astype("<i2")}
    netcdf.write_grid(f"{tmp_path}/a.nc", [(k, x.shape, x.dtype.str, iter(np.array_split(x, 3))) for k, x in whole.items()])
    got = zarr.open_dataset(spark, f"{tmp_path}/a.nc").collect()
    for k, x in whole.items():
        assert [r.value for r in sorted((r for r in got if r["var"] == k), key=lambda r: r.idx)] == x.ravel().tolist()
    assert [v.dims for v in netcdf.variables(f"{tmp_path}/a.nc")] == [("t_d0", "t_d1", "t_d2"), ("n_d0",), ("h_d0", "h_d1")]
    with pytest.raises(ValueError, match="no field"):
        zarr.open_dataset(spark, f"{tmp_path}/a.nc", "z")
    word = lambda s: len(s).to_bytes(4, "big") + s + b"\0" * (-len(s) % 4)
    i4 = lambda *n: b"".join(x.to_bytes(4, "big") for x in n)
    head = lambda begins: b"CDF\x01" + i4(2, 10, 2) + word(b"time") + i4(0) + word(b"x") + i4(3) + i4(12, 1) + word(b"by") + i4(2, 3) + b"me!\0" + i4(11, 2) + b"".join(word(n) + i4(2, 0, 1, 0, 0, kind, 12, b) for n, kind, b in zip((b"u", b"w"), (5, 3), begins, strict=True))
    n = len(head((0, 0)))
    records = [np.arange(3, dtype=">f4").tobytes() + np.arange(3, dtype=">i2").tobytes() + b"\0\0", (np.arange(3, dtype=">f4") + 10).astype(">f4").tobytes() + (np.arange(3) + 20).astype(">i2").tobytes() + b"\0\0"]
    (tmp_path / "r.nc").write_bytes(head((n, n + 12)) + b"".join(records))
    got = {(r["var"], r.idx): r.value for r in zarr.open_dataset(spark, f"{tmp_path}/r.nc").collect()}
    assert [got["u", i] for i in range(6)] == [0, 1, 2, 10, 11, 12] and [got["w", i] for i in range(6)] == [0, 1, 2, 20, 21, 22]
    (tmp_path / "b.nc").write_bytes(b"\x89HDF....")
    with pytest.raises(ImportError, match="xarray"):
        zarr.open_dataset(spark, f"{tmp_path}/b.nc")


def test_find_file_and_wide_tables(spark, tmp_path):
    spark.createDataFrame([(0, 1.5, 2.5), (1, 3.5, 4.5)], "idx long, t double, q double").write.parquet(f"{tmp_path}/deep/wide.parquet")
    assert sorted(r.value for r in zarr.open_dataset(spark, f"{tmp_path}/deep/wide.parquet", "q").collect()) == [2.5, 4.5]
    (tmp_path / "deep" / "x.txt").write_text("x")
    assert zarr.find_file(spark, str(tmp_path), "x.txt").endswith("deep/x.txt") and zarr.find_file(spark, str(tmp_path), "y.txt") is None


def run(spark, *argv):
    a = cli.parser().parse_args([str(x) for x in argv])
    return a.run(spark, a).collect()


def test_commands_end_to_end(spark, tmp_path, capsys):
    x = np.random.default_rng(2).normal(280, 5, (8, 12))
    source = f"{tmp_path}/source.zarr"
    for var, scale in (("t", 1.0), ("q", 0.01)):
        chunks = spark.createDataFrame([(c, (x * scale)[4 * c : 4 * c + 4].tobytes()) for c in range(2)], "chunk long, payload binary")
        zarr.write_field(chunks, source, var, (8, 12), 4, "float64", ["lat", "lon"], attributes={"units": "K"})
    (tmp_path / "limits.csv").write_text('Short Name,Unit,Existing L1 error\nt,K,"0,001"\nq,kg,"0,5"\n')
    scored = f"{tmp_path}/scored"
    best = {r["var"]: r for r in run(spark, "evaluate_combos", source, scored, "--thresholds", tmp_path / "limits.csv", "--compressor-class", "Zlib", "--serializer-class", "PCodec")}
    every = spark.read.parquet(scored)
    assert set(best) == {"t", "q"} and every.where("var = 't'").agg(F.max("rel_l1")).first()[0] <= 0.001 and every.where("var = 'q'").count() == 3 * 16 * 12
    assert "evaluate_combos: 2 calls" in capsys.readouterr().out
    b = best["t"]
    (found,) = run(spark, "indexes", f"{scored}-space", b.compressor, b.filter, b.serializer)
    assert (found.comp_idx, found.filt_idx, found.ser_idx) == (b.comp_idx, b.filt_idx, b.ser_idx)
    stores = {}
    for var in ("t", "q"):
        stores[var] = f"{tmp_path}/{var}.zarr"
        (s,) = run(spark, "compress_with_optimal", source, stores[var], var, b.comp_idx, b.filt_idx, b.ser_idx, "--compressor-class", "Zlib", "--serializer-class", "PCodec")
        assert s.rel_l1 <= 0.001 or var == "q"
    whole = f"{tmp_path}/all.zarr.zip"
    info = {r["var"]: r for r in run(spark, "merge_compressed_fields", source, whole, *stores.values())}
    assert set(info) == {"t", "q"} and info["t"]["shape"] == [8, 12] and info["t"].dims == ["lat", "lon"]
    assert {r["var"] for r in run(spark, "inspect", whole)} == {"t", "q"}
    cells_out = run(spark, "export", whole, "--out", f"{tmp_path}/all.parquet")
    t = np.array([r.value for r in sorted((r for r in cells_out if r["var"] == "t"), key=lambda r: r.idx)])
    assert len(cells_out) == 192 and np.abs(t - x.ravel()).sum() / np.abs(x).sum() <= 0.001
    (nc,) = {run(spark, "from_zarr_zip_to_netcdf", whole) and f"{tmp_path}/all.zarr.nc"}
    assert zarr.open_dataset(spark, nc).count() == 192
    for filt in (0, 4):  # Delta, by position; Bit rounding, by value
        found = run(spark, "periodicity", source, "t", 8, 12, filt)
        assert len(found) == 96 and max(r.err for r in found) < 1e-3 and all(r.shifted_lon == (r.lon + 6) % 12 for r in found)
    assert {r.k for r in run(spark, "perform_clustering", scored, "L1")} == set(range(3, 10))
    assert len(run(spark, "analyze_clustering", scored)) == 3 * every.count()  # of three errors


def test_threshold_table_must_have_its_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Short Name,Unit\nt,K\n")
    with pytest.raises(ValueError, match="Existing L1 error"):
        metrics.read_thresholds(spark, str(tmp_path / "t.csv"))


def test_thresholds(spark):
    fields = spark.createDataFrame([("t", "K"), ("q", "g")], "var string, unit string")
    table = spark.createDataFrame([(0, "t", "K", "0,002"), (1, "t", "K", "0,5"), (2, "q", "kg", "1")], "line int, short_name string, unit string, existing_l1_error string")
    assert {r["var"]: r.limit for r in metrics.threshold_lookup(fields, table).collect()} == {"t": 0.002, "q": None}


def test_profile():
    p = metrics.Profile()
    for _ in range(2):
        with p.timer("b"):
            pass
    with p.timer("a"):
        pass
    assert [(x[0], x[1]) for x in p.summary()] == [("a", 1), ("b", 2)]


def test_jitter_and_codec_names(spark):
    df = spark.range(100).select(N.jittered(F.lit(1.0), 7).alias("x"))
    assert df.agg(F.max(F.abs(F.col("x") - 1))).first()[0] < 1e-3
    assert Codec("A", (("x", 1), ("y", 2))).name == "A(x=1, y=2)"
