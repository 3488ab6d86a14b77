"""Connected components of a link table by alternating large and small stars, distributed.

Each task first replaces its links by those of its own spanning stars, so links within large groups
shrink to one per member. If at most `HELD` links are left, one more task does the same to them all, and
its stars are the components. Otherwise rounds of joins on small rows follow, each checkpointed, until no
link changes; a hub's rows are split by adaptive execution, its minimum is combined on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpress.llm.shared import checkpointed

#: Links that a task contracts at a time.
HELD = 500_000


def stars(u: list[int], v: list[int]) -> dict[int, int]:
    """Node to the smallest node that it reaches, roots left out."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = x = root.get(p, p)
        return x

    for a, b in zip(u, v, strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def contracted(links: DataFrame, held: int) -> DataFrame:
    """Fewer links with the same components: each task's stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []

        def out() -> pa.RecordBatch:
            star = stars(u, v)
            u.clear()
            v.clear()
            return pa.record_batch([pa.array(list(star), pa.int64()), pa.array(list(star.values()), pa.int64())], ["u", "v"])

        for b in batches:
            u += b.column(0).to_pylist()
            v += b.column(1).to_pylist()
            if len(u) >= held:
                yield out()
        if u:
            yield out()

    return links.mapInArrow(run, "u long, v long")


def named(edges: DataFrame) -> DataFrame:
    """(node, component) of stars (u, v), the roots included."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def components(links: DataFrame, held: int = HELD) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; nodes without links are left out.

    `links` has two long columns; self-links and repeats are fine.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    edges = checkpointed(contracted(pairs, held))

    def shape(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    before = shape(edges)
    if before[0] <= held:
        return named(checkpointed(contracted(edges.coalesce(1), held + 1)))
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").union(low.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        edges = checkpointed(small)
        after = shape(edges)
        if after == before:
            break
        before = after
    return named(edges)
