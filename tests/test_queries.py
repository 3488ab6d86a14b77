"""Every registered query of the analytics engine against its SQL at the smallest size."""

import duckdb
import numpy as np
import pytest

from fieldpress.operators import clustering, codecs, filters
from fieldpress.operators.space import Codec, Flags
from fieldpress.plans import registry, sweep

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert got
    if sql := registry.oracle_sql().get(name):
        found = duck.sql(sql)
        want = [tuple(dict(zip(found.columns, r, strict=True))[c] for c in sorted(found.columns)) for r in found.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_elbow_has_every_k(spark):
    got = registry.queries()["kmeans_elbow"](spark, DIR).orderBy("k").collect()
    assert [r.k for r in got] == [3, 4, 5, 6, 7, 8, 9]
    assert all(r.inertia >= 0 and -1 <= r.silhouette <= 1 for r in got)


def test_sweep_has_every_compressor(spark):
    got = registry.evaluate_combos(spark, DIR).collect()
    assert {r.comp_idx for r in got} == set(range(79))
    assert {r.compressor.split("(")[0] for r in got} == {"Blosc", "LZ4", "Zstd", "Zlib", "GZip", "BZ2", "LZMA"}
    best = registry.flagship(spark, DIR).collect()
    assert [(r.ratio, r.ordinal) for r in best] == [max(((r.ratio, r.ordinal) for r in got), key=lambda x: (x[0], -x[1]))]


FAMILIES = {"zlib": ("Zlib", "level"), "gzip": ("GZip", "level"), "bz2": ("BZ2", "level"), "lzma": ("LZMA", "preset"), "zstd": ("Zstd", "level"), "lz4": ("LZ4", "acceleration")}


@pytest.fixture(scope="module")
def values(duck):
    return np.array([r[0] for r in duck.sql("SELECT value FROM events ORDER BY event_id").fetchall()])


@pytest.mark.parametrize("family", FAMILIES)
def test_sizes_are_those_of_the_compressors(spark, values, family):
    name, key = FAMILIES[family]
    for r in registry.queries()[f"compression_ratio_{family}"](spark, DIR).collect():
        level = int(r.compressor.split("=")[1].rstrip(")"))
        sizes = [len(codecs.compress(values[a : a + codecs.CHUNK_CELLS].tobytes(), Codec(name, ((key, level),)))) for a in range(0, len(values), codecs.CHUNK_CELLS)]
        assert (r.raw_bytes, r.enc_bytes, r.max_abs_e) == (8 * len(values), sum(sizes), 0.0) and r.ratio == r.raw_bytes / r.enc_bytes


@pytest.mark.parametrize("query", ["evaluate_combos", "evaluate_serializers"])
def test_scores_against_one_array(spark, values, query):
    info = filters.field_info(registry.events(spark, DIR), "float64")
    flags = Flags(serializer="none") if query == "evaluate_combos" else Flags(compressor="LZ4")
    fronts = {o: (c, f) for o, c, f in sweep.runnable(info, flags)}
    got = {r.ordinal: r for r in registry.queries()[query](spark, DIR).collect()}
    errors = {}
    for ordinal, (comp, front) in fronts.items():
        if front not in errors:
            body = codecs.front_encode(values, front)
            e = np.abs(codecs.front_decode(body, front, values.dtype) - values)
            errors[front] = len(values) <= codecs.CHUNK_CELLS and body, e.sum() / np.abs(values).sum(), np.sqrt((e**2).sum()), e.max() / np.abs(values).max()
        body, l1, euclid, most = errors[front]
        assert (ordinal in got) == (l1 <= 0.002)
        if ordinal in got:
            r = got[ordinal]
            assert (r.rel_l1, r.euclid, r.rel_linf) == pytest.approx((l1, euclid, most), rel=1e-9, abs=1e-18)
            if ordinal % 37 == 0:
                assert r.ratio == values.nbytes / len(codecs.compress(body, comp))


def test_clusters_are_nearest_centres(spark):
    points, centres = clustering.cluster_scored(registry._synthetic_scores(spark, DIR))
    at = {(r.metric, r.cluster): (r.ratio, r.error) for r in centres.collect()}
    for r in points.collect():
        away = {k: (r.ratio - x) ** 2 + (r.error - y) ** 2 for (m, k), (x, y) in at.items() if m == r.metric}
        assert away[r.cluster] == pytest.approx(min(away.values()))
    elbow = registry.queries()["kmeans_elbow"](spark, DIR).collect()
    data = np.array([(r.ratio, r.rel_l1) for r in registry._synthetic_scores(spark, DIR).collect()])
    assert all(0 <= r.inertia <= ((data - data.mean(axis=0)) ** 2).sum() for r in elbow)
