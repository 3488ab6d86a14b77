"""Families of configurations: K-Means over (ratio, error), elbow and silhouette.

K-Means runs on the cluster. One cluster is the global mean, which the library refuses to fit. The
mean silhouette uses Euclidean distances; it is made of blocks of pairs, so no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpress.functions.numeric import jittered
from fieldpress.operators.metrics import ERRORS, cluster_count, error_column, finite_rows

SEED, ELBOW = 0, range(3, 10)
BLOCK_ROWS = 4096
#: Points whose distances are all made; a search space has 42,976 results.
SILHOUETTE_MOST = 1 << 18


def fit(points: DataFrame, x: str, y: str, k: int, seed: int = SEED) -> tuple[DataFrame, list[tuple[float, ...]], float]:
    """(points with `cluster`, centres, inertia)."""
    if k == 1:
        r = points.agg(F.avg(x).alias("x"), F.avg(y).alias("y")).first()
        away = points.agg(F.sum((F.col(x) - r.x) ** 2 + (F.col(y) - r.y) ** 2).alias("s")).first().s
        return points.withColumn("cluster", F.lit(0)), [(r.x, r.y)], away or 0.0
    vectors = VectorAssembler(inputCols=[x, y], outputCol="__v").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("__v"), [tuple(map(float, c)) for c in model.clusterCenters()], float(model.summary.trainingCost)


def silhouette(points: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """One row, `silhouette`: the mean of (b - a) / max(a, b); a point alone in its cluster counts 0. Every pair is made, so the points are bounded."""
    n = points.count()
    if n > SILHOUETTE_MOST:
        raise ValueError(f"the silhouette of {n} points needs all pairs of them; {SILHOUETTE_MOST} at most")
    blocks = max(1, -(-n // BLOCK_ROWS))
    own = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(label).cast("int").alias("c"), F.monotonically_increasing_id().alias("i"))
    own = own.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    size = own.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    left = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def sums(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "c": pa.array([], pa.int32()), "of": pa.array([], pa.int32()), "s": pa.array([], pa.float64())})
        ax, ay, bx, by, bc = (t.column(c).to_numpy() for t, c in ((a, "x"), (a, "y"), (b, "x"), (b, "y"), (b, "c")))
        kinds, code = np.unique(bc, return_inverse=True)
        hot = np.zeros((len(bc), len(kinds)))
        hot[np.arange(len(bc)), code] = 1
        s = np.sqrt((ax[:, None] - bx) ** 2 + (ay[:, None] - by) ** 2) @ hot
        rep = lambda c: np.repeat(a.column(c).to_numpy(), len(kinds))
        return pa.table({"i": rep("i"), "c": rep("c").astype(np.int32), "of": np.tile(kinds, len(ax)).astype(np.int32), "s": s.ravel()})

    pairs = left.groupBy("b", "other").cogroup(own.withColumn("other", F.col("b")).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("first", "other"))
    each = pairs.applyInArrow(sums, "i long, c int, of int, s double").groupBy("i", "c", "of").agg(F.sum("s").alias("s"))
    each = each.join(F.broadcast(size.withColumnRenamed("c", "of")), "of")  # one row per cluster
    inner = F.max(F.when(F.col("c") == F.col("of"), F.when(F.col("size") > 1, F.col("s") / (F.col("size") - 1))))
    outer = F.min(F.when(F.col("c") != F.col("of"), F.col("s") / F.col("size")))
    by_point = each.groupBy("i").agg(inner.alias("a"), outer.alias("b"))
    top = F.greatest("a", "b")
    score = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return by_point.agg(F.avg(score).alias("silhouette"))


def elbow(scored: DataFrame, error: str, ks: Iterable[int] = ELBOW) -> DataFrame:
    """(k, inertia, silhouette) of the finite (ratio, error) points."""
    y = error_column(error)
    points = finite_rows(scored.select("ratio", y)).cache()
    rows = []
    for k in ks:
        labelled, _, inertia = fit(points, "ratio", y, k)
        rows.append((k, inertia, silhouette(labelled, "ratio", y, "cluster").first().silhouette))
    return scored.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def cluster_scored(scored: DataFrame, jitter_seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with their cluster per error, centres): three clusterings of the ratio with each error."""
    spark = scored.sparkSession
    clean = finite_rows(scored).cache()
    k = max(1, cluster_count(clean.count()))
    parts, centres = [], []
    for name, y in ERRORS.items():
        ratio = F.col("ratio") if jitter_seed is None else jittered(F.col("ratio"), jitter_seed)
        names = [c for c in ("ordinal", "compressor", "filter", "serializer") if c in clean.columns]
        points, own, _ = fit(clean.select(*names, ratio.alias("ratio"), F.col(y).alias("error")), "ratio", "error", k)
        parts.append(points.withColumn("metric", F.lit(name)))
        centres += [(name, i, *c) for i, c in enumerate(own)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, spark.createDataFrame(centres, "metric string, cluster int, ratio double, error double")


