"""Connected components of an edge table, with bounded state per task.

Union-find inside every partition turns edges into stars (its size is the
partition's, whatever the degree of a vertex). A partial minimum gives each
vertex its smallest root; roots that share a vertex, or are vertices
themselves, are linked, and the much smaller graph of roots is solved the same
way, by one task once its links are few. No task holds a component, and
nothing goes to the driver but counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: So few links are one task's work.
LAST_LINKS = 200_000
_SHAPE = "v long, root long"


def _stars(batches):
    up: dict[int, int] = {}

    def find(x):
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                up.setdefault(min(x, y), min(x, y))
    v = [x for x in up if find(x) != x]
    for i in range(0, len(v), 50_000):
        part = v[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["v", "root"])


def attach(frame: DataFrame, column: str, stars: DataFrame, name: str) -> DataFrame:
    """frame with ``name``: the root of the vertex in ``column``, or that vertex itself."""
    s = stars.select(F.col("v").alias("__v"), F.col("root").alias("__root"))
    return frame.join(s, F.col(column) == F.col("__v"), "left").withColumn(name, F.coalesce("__root", column)).drop("__v", "__root")


def components(edges: DataFrame, last_links: int = LAST_LINKS) -> DataFrame:
    """(v, root) for every vertex of edges(a, b) that isn't itself the smallest of its component."""
    spark = edges.sparkSession
    pairs = edges.select(F.col("a").cast("long").alias("v"), F.col("b").cast("long").alias("root"))
    stars = common.cut(spark, pairs.mapInArrow(_stars, _SHAPE))
    low = common.cut(spark, stars.groupBy("v").agg(F.min("root").alias("root")))
    over = stars.join(low.withColumnRenamed("root", "low"), "v").where("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b"))
    chains = stars.select(F.col("root").alias("v")).distinct().join(low, "v").select(F.col("v").alias("a"), F.col("root").alias("b"))
    links = common.cut(spark, over.unionByName(chains).distinct())
    n = links.count()
    if not n:
        return low
    if n <= last_links:
        top = common.cut(spark, links.coalesce(1).mapInArrow(_stars, _SHAPE))
    else:
        top = components(links, last_links)
    to = top.select(F.col("v").alias("old"), F.col("root").alias("top"))
    moved = common.hot_left(low, "root", to, "old", low.count()).select("v", F.coalesce("top", "root").alias("root"))
    return common.cut(spark, moved.unionByName(top).distinct())
