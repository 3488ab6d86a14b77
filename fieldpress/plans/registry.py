"""Named queries over the driver's tables, and their DuckDB SQL.

`events.value` is a float64 field of one dimension (event_id is its dense flat index), `orders.o_totalprice`
another; `embeddings` is a float32 field of (lat = vec_id, lon = position); `part.p_size` an int32 field.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpress.functions import numeric as N
from fieldpress.operators import arrays, clustering, codecs, filters, metrics, space
from fieldpress.operators.diagnose import by_position, periodicity_errors
from fieldpress.operators.space import Codec, FieldInfo, Flags
from fieldpress.plans import sweep
from fieldpress.sources import zarr

KEEPBITS = (1, 10, 19, 28, 37, 46, 52)
DIGITS = (1, 5, 9)
WIDTH = 64  # positions of an embedding

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event values as cells (idx, value)."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "value")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.array_cells(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def r9(c: Column, name: str, digits: int = 9) -> Column:
    return F.round(c, digits).alias(name)


@query("SELECT round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, min(value) AS low, max(value) AS high, count(*) AS n FROM events")
def field_stats(spark, sf_dir):
    s = filters.field_stats(events(spark, sf_dir))
    return s.select(r9(F.col("mean"), "mean"), r9(F.col("std"), "std"), "low", "high", "n")


@query("SELECT round(quantile_cont(abs(value), 0.01), 9) AS linear_width FROM events")
def linear_width(spark, sf_dir):
    return filters.linear_width(events(spark, sf_dir)).select(r9(F.col("linear_width"), "linear_width"))


@query("SELECT event_id AS idx, value - coalesce(lag(value) OVER (ORDER BY event_id), 0.0::double) AS delta FROM events")
def filter_delta(spark, sf_dir):
    return filters.delta_encode(events(spark, sf_dir), "idx").select("idx", "delta")


@query("SELECT event_id AS idx, round(value, 6) AS decoded FROM events")
def filter_delta_decode(spark, sf_dir):
    return filters.delta_decode(filters.delta_encode(events(spark, sf_dir), "idx"), "idx").select("idx", r9(F.col("decoded"), "decoded", 6))


@query("""SELECT event_id AS idx, CASE WHEN value = 0 THEN value ELSE round_even(value / pow(2.0::double, floor(log2(abs(value))) - 10), 0) * pow(2.0::double, floor(log2(abs(value))) - 10) END AS rounded FROM events""")
def filter_bitround(spark, sf_dir):
    return events(spark, sf_dir).select("idx", N.bitround(F.col("value"), 10).alias("rounded"))


@query("SELECT event_id AS idx, round_even(value * 16.0::double, 0) / 16.0::double AS quantized FROM events")
def filter_quantize(spark, sf_dir):
    return events(spark, sf_dir).select("idx", N.quantize(F.col("value"), 1).alias("quantized"))


ASINH = "WITH w AS (SELECT quantile_cont(abs(value), 0.01) AS w FROM events) "


@query(ASINH + "SELECT event_id AS idx, round(w * asinh(value / w), 9) AS encoded, round(value, 6) AS decoded FROM events, w")
def filter_asinh(spark, sf_dir):
    cells = events(spark, sf_dir)
    x = cells.crossJoin(F.broadcast(filters.linear_width(cells)))  # one row
    w = F.col("linear_width")
    return x.withColumn("c", N.asinh_encode(F.col("value"), w)).select("idx", r9(F.col("c"), "encoded"), r9(N.asinh_decode(F.col("c"), w), "decoded", 6))


def _scaled(spark, sf_dir, offset: Column, scale: Column) -> DataFrame:
    cells = events(spark, sf_dir)
    x = cells.crossJoin(F.broadcast(filters.field_stats(cells).select(offset.alias("o"), N.safe_scale(scale).alias("s"))))  # one row
    c = x.withColumn("c", N.scale_encode(F.col("value"), F.col("o"), F.col("s")))
    return c.select("idx", r9(F.col("c"), "encoded"), r9(N.scale_decode(F.col("c"), F.col("o"), F.col("s")), "decoded", 6))


@query("SELECT event_id AS idx, round((value - o) / s, 9) AS encoded, round(value, 6) AS decoded FROM events, (SELECT avg(value) AS o, stddev_pop(value) AS s FROM events)")
def filter_fixed_offset_scale_meanstd(spark, sf_dir):
    return _scaled(spark, sf_dir, F.col("mean"), F.col("std"))


@query("SELECT event_id AS idx, round((value - o) / s, 9) AS encoded, round(value, 6) AS decoded FROM events, (SELECT min(value) AS o, max(value) - min(value) AS s FROM events)")
def filter_fixed_offset_scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, F.col("low"), F.col("high") - F.col("low"))


def _duck_norms(e: str, x: str = "value") -> str:
    return f"round(sum(abs({e})) / sum(abs({x})), 9) AS rel_l1, round(sqrt(sum(({e}) * ({e}))) / sqrt(sum({x} * {x})), 9) AS rel_l2, round(max(abs({e})) / max(abs({x})), 9) AS rel_linf, round(sqrt(sum(({e}) * ({e}))), 6) AS euclid"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, r9(F.col("rel_l1"), "rel_l1"), r9(F.col("rel_l2"), "rel_l2"), r9(F.col("rel_linf"), "rel_linf"), r9(F.col("euclid"), "euclid", 6))


@query(f"SELECT {_duck_norms('round_even(value * 16.0::double, 0) / 16.0::double - value')} FROM events")
def error_norms(spark, sf_dir):
    cells = events(spark, sf_dir).withColumn("decoded", N.quantize(F.col("value"), 1))
    return _rounded(metrics.error_norms(cells, "value", "decoded"))


def _bits(keeps: tuple[int, ...]) -> str:
    unit = "pow(2.0::double, floor(log2(abs(value))) - k)"
    return f"SELECT k, value, CASE WHEN value = 0 OR k >= 52 THEN value ELSE round_even(value / {unit}, 0) * {unit} END AS d FROM events, (VALUES {', '.join(f'({k})' for k in keeps)}) t(k)"


def bitround_scores(spark, sf_dir, keeps: tuple[int, ...] = KEEPBITS) -> DataFrame:
    """Errors of each keepbits, from one scan: configurations are an array exploded in the row's projection."""
    each = events(spark, sf_dir).select("value", F.explode(F.array(*map(F.lit, keeps))).alias("keepbits"))
    return metrics.error_norms(each.withColumn("decoded", N.bitround(F.col("value"), F.col("keepbits"))), "value", "decoded", ("keepbits",))


@query(f"SELECT * FROM (SELECT k AS keepbits, {_duck_norms('d - value')} FROM ({_bits(KEEPBITS)}) GROUP BY k) WHERE rel_l1 <= 0.002")
def bitround_sweep(spark, sf_dir):
    return _rounded(metrics.threshold_gate(bitround_scores(spark, sf_dir), 0.002), "keepbits")


@query(f"SELECT digits, {_duck_norms('round_even(value * s, 0) / s - value')} FROM events, (VALUES {', '.join(f'({d}, {N.quantize_scale(d)}::double)' for d in DIGITS)}) t(digits, s) GROUP BY digits")
def quantize_sweep(spark, sf_dir):
    each = events(spark, sf_dir).select("value", F.explode(F.array(*map(F.lit, DIGITS))).alias("digits"))
    return _rounded(metrics.error_norms(each.withColumn("decoded", N.quantize(F.col("value"), F.col("digits"))), "value", "decoded", ("digits",)), "digits")


@query(f"""WITH s AS (SELECT k AS keepbits, sum(abs(d - value)) / sum(abs(value)) AS l1 FROM ({_bits((1, 10, 19))}) GROUP BY k)
SELECT lim AS limit_id, keepbits FROM s, (VALUES (0, NULL), (1, 0.0::double), (2, 0.001::double), (3, 1e-9::double)) t(lim, v) WHERE v IS NULL OR v = 0 OR l1 <= v""")
def threshold_gate(spark, sf_dir):
    scored = bitround_scores(spark, sf_dir, (1, 10, 19))
    limits = spark.createDataFrame([(0, None), (1, 0.0), (2, 0.001), (3, 1e-9)], "limit_id int, v double")
    return metrics.threshold_gate(scored.crossJoin(F.broadcast(limits)), column="v").select("limit_id", "keepbits")  # four rows


THRESHOLDS = [(0, "t", "K", "0,002"), (1, "t", "K", "0,5"), (2, "q", "kg", "0,01"), (3, "u", "m/s", " "), (4, "v", "m/s", "0,25")]
FIELDS = [("t", "K"), ("q", "g"), ("u", "m/s"), ("v", "m/s"), ("w", "Pa")]


@query("""WITH t(line, short_name, unit, e) AS (VALUES (0, 't', 'K', '0,002'), (1, 't', 'K', '0,5'), (2, 'q', 'kg', '0,01'), (3, 'u', 'm/s', ' '), (4, 'v', 'm/s', '0,25')),
f("var", unit) AS (VALUES ('t', 'K'), ('q', 'g'), ('u', 'm/s'), ('v', 'm/s'), ('w', 'Pa'))
SELECT f."var", f.unit, CASE WHEN t.unit = f.unit AND trim(e) <> '' THEN CAST(replace(trim(e), ',', '.') AS DOUBLE) END AS "limit"
FROM f LEFT JOIN (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY short_name ORDER BY line) = 1) t ON t.short_name = f."var" """)
def threshold_lookup(spark, sf_dir):
    fields = spark.createDataFrame(FIELDS, "var string, unit string")
    return metrics.threshold_lookup(fields, spark.createDataFrame(THRESHOLDS, "line int, short_name string, unit string, existing_l1_error string"))


@query(f"SELECT keepbits, ratio FROM (SELECT k AS keepbits, 64.0::double / (12 + least(k, 37)) AS ratio, sum(abs(d - value)) / sum(abs(value)) AS l1 FROM ({_bits(KEEPBITS)}) GROUP BY k) WHERE l1 <= 1e-12 ORDER BY ratio DESC, keepbits LIMIT 1")
def best_combo(spark, sf_dir):
    """Among equal ratios the lowest ordinal wins."""
    scored = bitround_scores(spark, sf_dir).select(F.col("keepbits").cast("long").alias("ordinal"), "keepbits", (F.lit(64.0) / (12 + F.least("keepbits", F.lit(37)))).alias("ratio"), "rel_l1")
    return metrics.best_combo(metrics.threshold_gate(scored, 1e-12)).select("keepbits", "ratio")


INFO = {"f64": FieldInfo("float64", 1.0, 2.0, 0.0, 4.0, 0.5), "f32": FieldInfo("float32", 1.0, 2.0, 0.0, 4.0, 0.5), "int": FieldInfo("int32")}
_COMP_SQL = f"""SELECT row_number() OVER (ORDER BY o) - 1 AS i, n FROM (
SELECT 'Blosc(cname=' || c || ', clevel=' || l || ', shuffle=' || s || ')' AS n, row_number() OVER (ORDER BY ci, li, si) AS o
FROM (SELECT unnest({list(space.BLOSC_NAMES)}) AS c, generate_subscripts({list(space.BLOSC_NAMES)}, 1) AS ci), (SELECT unnest([1, 6, 9]) AS l, generate_subscripts([1, 6, 9], 1) AS li), (SELECT unnest([-1, 0, 1, 2]) AS s, generate_subscripts([-1, 0, 1, 2], 1) AS si)
UNION ALL SELECT n, 100 + row_number() OVER () FROM (VALUES {', '.join(f"('{f}({k}={v})')" for f, k, vs in (('LZ4', 'acceleration', (1, 10, 100)), ('Zstd', 'level', (0, 1, 9, 22)), ('Zlib', 'level', (1, 6, 9)), ('GZip', 'level', (1, 6, 9)), ('BZ2', 'level', (1, 6, 9)), ('LZMA', 'preset', (1, 6, 9))) for v in vs)}) t(n))"""
_FLOAT_MODES = "('tolerance=0.5'), ('tolerance=0.25'), ('tolerance=0.0625'), ('precision=8'), ('precision=16'), ('precision=32'), ('rate=8'), ('rate=16'), ('rate=32')"
_INT_MODES = "('rate=8'), ('rate=16'), ('rate=32')"
_FILTERS = {
    "f64": ["Delta()", *(f"BitRound(keepbits={k})" for k in KEEPBITS), *(f"Quantize(digits={d})" for d in (1, 5, 9, 13, 15))],
    "f32": ["Delta()", *(f"BitRound(keepbits={k})" for k in (1, 10, 19, 23)), *(f"Quantize(digits={d})" for d in (1, 5, 7))],
    "int": ["Delta()"],
}
_SCALES = ["Asinh(linear_width=0.5)", "FixedOffsetScale(offset=1.0, scale=2.0)", "FixedOffsetScale(offset=0.0, scale=4.0)"]


def _config_sql(kind: str) -> str:
    filt = _FILTERS[kind] + (_SCALES if kind != "int" else [])
    modes = _INT_MODES if kind == "int" else _FLOAT_MODES
    ser = f"""SELECT row_number() OVER (ORDER BY o) - 1 AS i, n FROM (
SELECT 'PCodec(level=' || l || ', delta_encoding_order=' || d || ')' AS n, l * 10 + d AS o FROM (VALUES (0), (4), (8), (12)) a(l), (VALUES (0), (3), (7)) b(d)
UNION ALL SELECT 'ZFPY(' || m || ')', 1000 + row_number() OVER () FROM (VALUES {modes}) t(m)
UNION ALL SELECT 'EBCCZarrFilter(base_cr=2, atol=' || a || ')', 2000 + row_number() OVER () FROM (VALUES ('0.01'), ('0.001'), ('1e-06'), ('1e-09')) t(a)
UNION ALL SELECT 'Zfp(' || m || ')', 3000 + row_number() OVER () FROM (VALUES {modes}) t(m))"""
    n_ser = 22 if kind == "int" else 34
    return f"""SELECT CAST((c.i * {len(filt)} + f.i) * {n_ser} + s.i AS BIGINT) AS ordinal, CAST(c.i AS INT) AS comp_idx, c.n AS comp_name,
CAST(f.i AS INT) AS filt_idx, f.n AS filt_name, CAST(s.i AS INT) AS ser_idx, s.n AS ser_name,
CASE WHEN s.n LIKE 'Zfp(%' OR s.n LIKE 'EBCC%' THEN 'None' ELSE f.n END AS eff_filt_name
FROM ({_COMP_SQL}) c, (SELECT unnest({filt}) AS n, generate_subscripts({filt}, 1) - 1 AS i) f, ({ser}) s"""


CONFIG_COLUMNS = ("ordinal", "comp_idx", "comp_name", "filt_idx", "filt_name", "ser_idx", "ser_name", "eff_filt_name")


@query(_config_sql("f64"))
def config_space_f64(spark, sf_dir):
    return space.config_frame(spark, INFO["f64"]).select(*CONFIG_COLUMNS)


@query(_config_sql("f32"))
def config_space_f32(spark, sf_dir):
    return space.config_frame(spark, INFO["f32"]).select(*CONFIG_COLUMNS)


@query(_config_sql("int"))
def config_space_int(spark, sf_dir):
    return space.config_frame(spark, INFO["int"]).select(*CONFIG_COLUMNS)


@query(f"SELECT comp_idx, eff_filt_name, ser_idx, min(ordinal) AS ordinal, count(*) AS n_configs FROM ({_config_sql('f64')}) GROUP BY ALL")
def effective_pipelines(spark, sf_dir):
    config = space.config_frame(spark, INFO["f64"])
    names = config.select("ordinal", "eff_filt_name")
    return space.effective(config).join(names, "ordinal").select("comp_idx", "eff_filt_name", "ser_idx", "ordinal", "n_configs")


@query("SELECT 2::int AS comp_idx, 0::int AS filt_idx, (-1)::int AS ser_idx")
def index_lookup(spark, sf_dir):
    config = space.config_frame(spark, INFO["f64"], Flags(lossy=False, compressor="Zlib", serializer="PCodec"))
    return space.get_indexes(config, "Zlib(level=9)", "Delta()", "None")


@query(f"SELECT vec_id AS lat, p - 1 AS lon, CAST(embedding[p] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(1, 7)) AS p) WHERE vec_id < greatest(1, (SELECT count(*) FROM embeddings) * 10 // 100)")
def percent_slice(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").count()  # Parquet metadata
    return arrays.percent_slice(grid(spark, sf_dir), {"lat": rows, "lon": WIDTH}, 10).select("lat", "lon", F.col("value").cast("double").alias("value"))


@query(f"SELECT vec_id AS lat, (p - 1 + {WIDTH // 2}) % {WIDTH} AS lon, CAST(embedding[p] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(1, {WIDTH + 1})) AS p)")
def roll_half(spark, sf_dir):
    return arrays.roll(grid(spark, sf_dir), "lon", WIDTH, WIDTH // 2).select("lat", "lon", F.col("value").cast("double").alias("value"))


@query(f"SELECT vec_id AS lat, p - 1 AS lon, CAST(embedding[p] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(1, {WIDTH + 1})) AS p)")
def roll_identity(spark, sf_dir):
    there = arrays.roll(grid(spark, sf_dir), "lon", WIDTH, WIDTH // 2)
    return arrays.roll(there, "lon", WIDTH, -(WIDTH // 2)).select("lat", "lon", F.col("value").cast("double").alias("value"))


@query(f"SELECT vec_id * {WIDTH} + p - 1 AS flat, vec_id AS lat, p - 1 AS lon FROM embeddings, (SELECT unnest(range(1, {WIDTH + 1})) AS p)")
def flatten_unflatten(spark, sf_dir):
    sizes = [1 << 40, WIDTH]
    flat = grid(spark, sf_dir).select(arrays.flat_index(["lat", "lon"], sizes).alias("flat"))
    return flat.select("flat", *arrays.unflatten(F.col("flat"), ["lat", "lon"], sizes))


@query("SELECT event_id AS lon, value FROM events")
def squeezed(spark, sf_dir):
    cells = events(spark, sf_dir).select(F.lit(0).alias("lat"), F.col("idx").alias("lon"), "value")
    return arrays.squeeze(cells, {"lat": 1, "lon": 2})


_U = "pow(2.0::double, floor(log2(abs(v))) - 4)"


@query(f"""SELECT lat, lon, round(d, 9) AS decoded, round(abs(v - d), 9) AS err, 0.0::double AS roll_err, 0.0::double AS periodicity_err FROM (
SELECT lat, lon, v, CASE WHEN v = 0 THEN v ELSE round_even(v / {_U}, 0) * {_U} END AS d FROM (SELECT vec_id AS lat, p - 1 AS lon, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, {WIDTH + 1})) AS p)))""")
def periodicity_error(spark, sf_dir):
    cells = grid(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    found = periodicity_errors(cells, {"lat": 1 << 20, "lon": WIDTH}, lambda x: N.bitround(x, 4))
    return found.select("lat", "lon", r9(F.col("decoded"), "decoded"), r9(F.col("err"), "err"), "roll_err", "periodicity_err")


@query(f"""WITH c AS (SELECT vec_id AS lat, p - 1 AS lon, CAST(embedding[p] AS DOUBLE) AS v, round_even(CAST(embedding[p] AS DOUBLE) * 16.0::double, 0) / 16.0::double AS q, (p - 1 + {WIDTH // 2}) % {WIDTH} AS turned FROM embeddings, (SELECT unnest(range(1, {WIDTH + 1})) AS p)),
d AS (SELECT lat, lon, v, lag(q) OVER (PARTITION BY lat ORDER BY lon) AS b, lag(q) OVER (PARTITION BY lat ORDER BY turned) AS tb, q FROM c)
SELECT lat, lon, round(q - coalesce(b, 0.0::double), 9) + 0.0::double AS decoded, round(abs(v - (q - coalesce(b, 0.0::double))), 9) AS err, round(abs((q - coalesce(b, 0.0::double)) - (q - coalesce(tb, 0.0::double))), 9) AS periodicity_err FROM d""")
def periodicity_of_differences(spark, sf_dir):
    """A codec that sees positions, differences along a latitude: the half turn moves where they begin, and the diagnostic sees that."""
    cells, sizes = grid(spark, sf_dir).withColumn("value", F.col("value").cast("double")), {"lat": 1 << 20, "lon": WIDTH}
    found = periodicity_errors(cells, sizes, by_position(lambda x: np.diff(np.rint(x * 16) / 16, prepend=0.0), sizes), columnwise=False)
    return found.select("lat", "lon", r9(F.col("decoded"), "decoded"), r9(F.col("err"), "err"), r9(F.col("periodicity_err"), "periodicity_err"))


@query(f"SELECT vec_id AS lat, p - 1 AS lon, round(CAST(embedding[p] AS DOUBLE), 9) AS decoded, 0.0::double AS err, 0.0::double AS periodicity_err FROM embeddings, (SELECT unnest(range(1, {WIDTH + 1})) AS p)")
def periodicity_of_delta(spark, sf_dir):
    """Delta along a latitude, encoded and decoded, gives both the field and the turned field back but for rounding."""
    cells, sizes = grid(spark, sf_dir).withColumn("value", F.col("value").cast("double")), {"lat": 1 << 20, "lon": WIDTH}
    delta = Codec("Delta")
    found = periodicity_errors(cells, sizes, by_position(lambda x: codecs.filter_decode(codecs.filter_encode(x, delta), delta), sizes), columnwise=False)
    return found.select("lat", "lon", r9(F.col("decoded"), "decoded"), r9(F.col("err"), "err"), r9(F.col("periodicity_err"), "periodicity_err"))


@query("SELECT p_partkey AS idx, p_size - coalesce(lag(p_size) OVER (ORDER BY p_partkey), 0) AS delta FROM part")
def int_delta(spark, sf_dir):
    cells = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").alias("value"))
    return filters.delta_encode(cells, "idx").select("idx", "delta")


@query("""WITH p AS (SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS c FROM embeddings),
s AS (SELECT a.i, a.c, b.c AS o, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS s FROM p a, p b GROUP BY ALL),
n AS (SELECT c, count(*) AS n FROM p GROUP BY c),
m AS (SELECT i, max(CASE WHEN s.c = o AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN s.c <> o THEN s / n END) AS b FROM s JOIN n ON n.c = o GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette FROM m""")
def silhouette_by_label(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings").select(F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"), "label")
    return clustering.silhouette(points, "x", "y", "label").select(r9(F.col("silhouette"), "silhouette"))


COUNTS = (36, 7162, 7163, 29546, 42976)


@query(f"SELECT n, CAST(ceil(6 * n / 42976.0) AS INT) AS k FROM (VALUES {', '.join(f'({n})' for n in COUNTS)}) t(n)")
def cluster_count_rule(spark, sf_dir):
    return spark.createDataFrame([(n, metrics.cluster_count(n)) for n in COUNTS], "n int, k int")


@query("SELECT event_id AS idx, round(abs(value - round_even(value * 16.0::double, 0) / 16.0::double) / (abs(value) + 1e-20), 12) AS rel FROM events")
def relative_error_eps(spark, sf_dir):
    return events(spark, sf_dir).select("idx", r9(N.relative_error(F.col("value"), N.quantize(F.col("value"), 1)), "rel", 12))


@query("SELECT 'value' AS var, event_id AS idx, value FROM events UNION ALL SELECT 'o_totalprice', o_orderkey, o_totalprice FROM orders")
def merge_fields(spark, sf_dir):
    a = events(spark, sf_dir).select(F.lit("value").alias("var"), "idx", "value")
    b = read(spark, sf_dir, "orders").select(F.lit("o_totalprice").alias("var"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("value"))
    return a.unionByName(b)


SIZES = (0, 1, 1023, 1024, 1536, 10_000_000, 2_684_354_560, 1 << 40)


@query(f"""SELECT n, CASE WHEN n < 1024 THEN printf('%.0f Bytes', n::double) WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0::double) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0::double)
WHEN n < 1099511627776 THEN printf('%.1f GiB', n / 1073741824.0::double) ELSE printf('%.1f TiB', n / 1099511627776.0::double) END AS size FROM (VALUES {', '.join(f'({n}::bigint)' for n in SIZES)}) t(n)""")
def binary_sizes(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in SIZES], "n long").select("n", N.binary_size(F.col("n")).alias("size"))


@query(f"SELECT keepbits, printf('%.3f', 64.0::double / (12 + keepbits)) AS ratio, printf('%.3e', rel_l1) AS rel_l1, printf('%.3e', rel_l2) AS rel_l2, printf('%.3e', rel_linf) AS rel_linf, printf('%.3e', euclid) AS euclid FROM (SELECT k AS keepbits, {_duck_norms('d - value').replace('round(', '(').replace(', 9)', ')').replace(', 6)', ')')} FROM ({_bits((1, 10, 19))}) GROUP BY k)")
def scores_as_text(spark, sf_dir):
    return metrics.described(bitround_scores(spark, sf_dir, (1, 10, 19)).withColumn("ratio", F.lit(64.0) / (12 + F.col("keepbits"))))


@query(f"SELECT CAST(i AS INT) AS idx, n AS name FROM ({_COMP_SQL})")
def config_pairs(spark, sf_dir):
    """Compressors through the text form in which tables of configurations list them."""
    texts = space.config_frame(spark, INFO["int"], Flags(serializer="none")).select(space.pair_text(F.col("comp_idx"), F.col("comp_name")).alias("pair"))
    return texts.select(space.pair_of(F.col("pair")).alias("p")).select("p.idx", "p.name")


@query("SELECT event_type, min(event_id % 2) = max(event_id % 2) AS single FROM events GROUP BY event_type")
def single_cluster(spark, sf_dir):
    return metrics.single_cluster(read(spark, sf_dir, "events").withColumn("cluster", F.col("event_id") % 2), "cluster", ("event_type",))


@query("SELECT CAST(quantile_disc(value, 0.5) AS DOUBLE) AS middle, (SELECT round(avg(value), 9) FROM events WHERE event_id < 1000000 // 8) AS head FROM events")
def resized_field(spark, sf_dir):
    """The mean of a field cut to a number of bytes, beside an exact rank of all its values."""
    cells = events(spark, sf_dir)
    n = cells.count()
    x = cells.select(F.col("value").alias("x"))
    head = arrays.resized(cells, {"idx": n}, 8 * n, 1_000_000).agg(r9(F.avg("value"), "head"))
    return head.select(F.lit(filters.ranked(x, -(-n // 2) - 1, n)).alias("middle"), "head")


RANGES = ((1, 52, 9), (1, 23, 9), (1, 15, 4), (1, 7, 4), (5, 1, -2))


@query("""SELECT r, v FROM (VALUES (0, [1, 10, 19, 28, 37, 46, 52]), (1, [1, 10, 19, 23]), (2, [1, 5, 9, 13, 15]), (3, [1, 5, 7]), (4, [5, 3, 1])) t(r, l), unnest(l) u(v)""")
def inclusive_ranges(spark, sf_dir):
    return spark.createDataFrame([(i, v) for i, r in enumerate(RANGES) for v in space.inclusive_range(*r)], "r int, v int")


@query("SELECT event_id AS idx, value FROM events WHERE isfinite(value)")
def finite_filter(spark, sf_dir):
    return metrics.finite_rows(events(spark, sf_dir))


def _ratio(family: str, key: str, values: tuple) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = [Codec(family, ((key, v),)) for v in values]
        chunks = codecs.chunked(events(spark, sf_dir), "float64")
        partial = codecs.sweep(chunks, "float64", [(i, c, (None, None)) for i, c in enumerate(own)])
        names = spark.createDataFrame([(i, c.name) for i, c in enumerate(own)], "ordinal long, compressor string")
        return partial.groupBy("ordinal").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("enc_bytes").alias("enc_bytes"), F.max("max_abs_e").alias("max_abs_e")).join(names, "ordinal").select("compressor", "raw_bytes", "enc_bytes", (F.col("raw_bytes") / F.col("enc_bytes")).alias("ratio"), "max_abs_e")

    f.__name__ = f"compression_ratio_{family.lower()}"
    return f


for _args in (("Zlib", "level", (1, 6, 9)), ("GZip", "level", (1, 6, 9)), ("BZ2", "level", (1, 6, 9)), ("LZMA", "preset", (1, 6, 9)), ("Zstd", "level", (0, 1, 9, 22)), ("LZ4", "acceleration", (1, 10, 100))):
    query(None)(_ratio(*_args))


N_COMPRESSORS = len(space.compressor_space())


@query(f"SELECT CAST(i AS INT) AS comp_idx, count(*) AS n_cells, count(*) AS n_equal FROM events, (SELECT unnest(range({N_COMPRESSORS})) AS i) GROUP BY i")
def compressors_round_trip(spark, sf_dir):
    """Every compressor of the space gives every cell back: cells, and those that are equal, bit by bit."""
    found = codecs.round_trips(codecs.chunked(events(spark, sf_dir), "float64"), "float64", [c for _, c in space.compressor_space()])
    return found.groupBy("comp_idx").agg(F.sum("n_cells").alias("n_cells"), F.sum("n_equal").alias("n_equal"))


@query(f"SELECT CAST(i AS INT) AS comp_idx, count(*) * 8 AS raw_bytes, true AS smaller FROM events, (SELECT unnest(range({N_COMPRESSORS})) AS i) GROUP BY i")
def compressors_shrink(spark, sf_dir):
    """Every compressor of the space makes the field of values rounded to four mantissa bits smaller."""
    cells = events(spark, sf_dir).withColumn("value", N.bitround(F.col("value"), 4))
    partial = codecs.sweep(codecs.chunked(cells, "float64"), "float64", [(i, c, (None, None)) for i, c in space.compressor_space()])
    return partial.groupBy("ordinal").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("enc_bytes").alias("enc")).select(F.col("ordinal").cast("int").alias("comp_idx"), "raw_bytes", (F.col("enc") < F.col("raw_bytes")).alias("smaller"))


def _store(spark: SparkSession, cells: DataFrame, folder: str, var: str, comp: Codec, filt: Codec | None, ser: Codec | None = None) -> str:
    """A field of cells (idx, value) as a Zarr store."""
    n = cells.agg(F.max("idx")).first()[0] + 1
    rows = zarr.rows_of_chunks((n,), 1 << 14)
    path = f"{folder}/{var}.zarr"
    zarr.write_field(codecs.chunked(cells, "float64", cells=rows), path, var, (n,), rows, "float64", ["idx"], comp, (filt, ser))
    return path


@query("SELECT event_id AS idx, round_even(value * 16.0::double, 0) / 16.0::double AS value FROM events")
def zarr_round_trip(spark, sf_dir):
    """The event field written as a Zarr store with a filter and a compressor, and read back."""
    path = _store(spark, events(spark, sf_dir), zarr.work_folder(spark), "value", Codec("Zlib", (("level", 6),)), Codec("Quantize", (("digits", 1),)))
    return zarr.open_dataset(spark, path, "value").select("idx", "value")


def _merged(spark: SparkSession, sf_dir: str) -> str:
    folder = zarr.work_folder(spark)
    prices = read(spark, sf_dir, "orders").select((F.col("o_orderkey") - F.lit(read(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0])).alias("idx"), F.col("o_totalprice").alias("value"))
    parts = {"value": _store(spark, events(spark, sf_dir), folder, "value", Codec("BZ2", (("level", 9),)), None), "price": _store(spark, prices, folder, "price", Codec("Zstd", (("level", 9),)), Codec("BitRound", (("keepbits", 10),)))}
    target = f"{folder}/merged.zarr.zip"
    zarr.merge_fields(parts, ["value", "price"], target)
    return target


_ROUNDED_PRICE = "round_even(o_totalprice / pow(2.0::double, floor(log2(abs(o_totalprice))) - 10), 0) * pow(2.0::double, floor(log2(abs(o_totalprice))) - 10)"


@query(f"SELECT 'value' AS var, event_id AS idx, value FROM events UNION ALL SELECT 'price', o_orderkey - (SELECT min(o_orderkey) FROM orders), {_ROUNDED_PRICE} FROM orders")
def zarr_merge_export(spark, sf_dir):
    """Two stores merged into a zip, exported as Parquet, and read again."""
    path = _merged(spark, sf_dir)
    return spark.read.parquet(zarr.export(spark, path)).select(F.col("var").cast("string").alias("var"), "idx", "value")


@query(f"SELECT 'value' AS var, event_id AS idx, value FROM events UNION ALL SELECT 'price', o_orderkey - (SELECT min(o_orderkey) FROM orders), {_ROUNDED_PRICE} FROM orders")
def netcdf_round_trip(spark, sf_dir):
    """Two stores merged into a zip, written as a netCDF file, and read again."""
    return zarr.open_dataset(spark, zarr.to_netcdf(_merged(spark, sf_dir)))


@query("""SELECT var, n AS cells, 'float64' AS dtype, CAST(ceil(n / 16384.0) AS BIGINT) AS n_chunks, 8 * n AS raw_bytes, true AS smaller
FROM (SELECT 'value' AS var, max(event_id) + 1 AS n FROM events UNION ALL SELECT 'price', max(o_orderkey) - min(o_orderkey) + 1 FROM orders)""")
def zarr_inspect(spark, sf_dir):
    found = zarr.inspect(spark, _merged(spark, sf_dir))
    return found.select("var", F.col("shape")[0].alias("cells"), "dtype", "n_chunks", "raw_bytes", (F.col("ratio") > 1).alias("smaller"))


@query()
def evaluate_combos(spark, sf_dir):
    """The whole sweep of one field: every compressor with every filter and plain bytes, gated."""
    return sweep.evaluate_combos(events(spark, sf_dir), "float64", limit=0.002, flags=Flags(serializer="none"))


@query()
def evaluate_serializers(spark, sf_dir):
    """Every serializer with every filter and one compressor, gated."""
    return sweep.evaluate_combos(events(spark, sf_dir), "float64", limit=0.002, flags=Flags(compressor="LZ4", serializer="all"))


SERIALIZERS = [c for _, c in space.serializer_space(INFO["f64"])]


@query(f"""SELECT CAST(i AS INT) AS ser_idx, count(*) AS n_cells, count(*) AS n_within FROM events, (SELECT unnest(range({len(SERIALIZERS)})) AS i) GROUP BY i""")
def serializers_keep_their_bounds(spark, sf_dir):
    """Each serializer's cells, and those that are off by no more than it promises (none at all for PCodec)."""
    return codecs.bounds_kept(codecs.chunked(events(spark, sf_dir), "float64"), "float64", SERIALIZERS).groupBy("ser_idx").agg(F.sum("n_cells").alias("n_cells"), F.sum("n_within").alias("n_within"))


@query("SELECT event_id AS idx, value FROM events")
def zarr_round_trip_serializer(spark, sf_dir):
    """A store with a serializer between filter and compressor, read back."""
    path = _store(spark, events(spark, sf_dir), zarr.work_folder(spark), "value", Codec("Zstd", (("level", 9),)), None, SERIALIZERS[4])
    return zarr.open_dataset(spark, path, "value").select("idx", "value")


def _synthetic_scores(spark, sf_dir) -> DataFrame:
    """A result table to cluster: errors of bit rounding per event type, with nominal ratios."""
    each = read(spark, sf_dir, "events").select("event_type", "value", F.explode(F.array(*map(F.lit, KEEPBITS))).alias("keepbits"))
    s = metrics.error_norms(each.withColumn("decoded", N.bitround(F.col("value"), F.col("keepbits"))), "value", "decoded", ("event_type", "keepbits"))
    return s.select(F.col("keepbits").cast("long").alias("ordinal"), (F.lit(64.0) / (12 + F.col("keepbits"))).alias("ratio"), "rel_l1", "rel_l2", "rel_linf", "euclid")


@query()
def kmeans_elbow(spark, sf_dir):
    return clustering.elbow(_synthetic_scores(spark, sf_dir), "L1")


@query()
def cluster_scored(spark, sf_dir):
    return clustering.cluster_scored(_synthetic_scores(spark, sf_dir))[0]


@query("SELECT event_id AS idx, value FROM events")
def codec_round_trip(spark, sf_dir):
    """Cells to chunks, delta-free zlib with byte shuffle, and back."""
    comp = Codec("Blosc", (("cname", "zlib"), ("clevel", 6), ("shuffle", 1)))
    chunks = codecs.chunked(events(spark, sf_dir), "float64")
    return sweep.cells_of(sweep.decoded(sweep.encoded(chunks, "float64", comp, (None, None)), "float64", comp, (None, None)), "float64")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best configuration of the event field under its L1 limit."""
    return metrics.best_combo(evaluate_combos(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
