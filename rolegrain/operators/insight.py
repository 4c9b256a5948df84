"""Summaries, importances and partial dependence as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from .categorical import unpivot


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    rows = []
    for c in cols:
        v = F.col(c).cast("double")
        ok = F.when(~X.is_missing(v), v)
        p = F.percentile(ok, [0.25, 0.5, 0.75])
        rows.append(F.struct(F.lit(c).alias("col"), F.avg(X.is_missing(v).cast("double")).alias("nan_rate"), F.min(ok).alias("min"), F.get(p, F.lit(0)).alias("p25"), F.avg(ok).alias("mean"), F.get(p, F.lit(1)).alias("p50"), F.get(p, F.lit(2)).alias("p75"), F.max(ok).alias("max")))
    return df.agg(F.array(*rows).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def category_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    g = unpivot(df, cols).groupBy("col", "val").agg(F.count("*").alias("cnt"))
    there = F.col("val").isNotNull()
    n = F.sum("cnt")
    most = F.max_by("val", F.when(there, F.struct(F.col("cnt"), F.col("val"))))
    least = F.min_by("val", F.when(there, F.struct(F.col("cnt"), F.col("val"))))
    return g.groupBy("col").agg((F.coalesce(F.sum(F.when(~there, F.col("cnt"))), F.lit(0)) / n).alias("nan_rate"), F.count_if(there).alias("n_unique"), most.alias("most"), (F.max(F.when(there, F.col("cnt"))) / n).alias("most_share"), least.alias("least"), (F.min(F.when(there, F.col("cnt"))) / n).alias("least_share"))


def datetime_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("col"), F.avg(F.col(c).isNull().cast("double")).alias("nan_rate"), F.min(c).alias("min"), F.max(c).alias("max")) for c in cols]
    return df.agg(F.array(*rows).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, lo, hi, cnt) of equal widths from min to max, the last bin closed."""
    ends = df.agg(F.min(col).cast("double").alias("a"), F.max(col).cast("double").alias("z"))
    d = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x")).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("z") - F.col("a")) / bins
    b = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("a"), width), F.lit(0.0)))).cast("int")
    return d.groupBy(b.alias("bin"), "a", "z").agg(F.count("*").alias("cnt")).select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "cnt")


def pdp(df: DataFrame, col: str, grid: list, score: Callable[[DataFrame], DataFrame], prediction: str = "prediction") -> DataFrame:
    """(value, mean): the column is set to each grid value in turn in all rows; the grid is a literal array."""
    g = df.withColumn("__v", F.explode(F.array(*map(F.lit, grid)))).withColumn(col, F.col("__v"))
    return score(g).groupBy(F.col("__v").alias("value")).agg(F.avg(prediction).alias("mean"))


def pdp_datetime(df: DataFrame, col: str, part: str, values: list[int], score, prediction: str = "prediction") -> DataFrame:
    change = {"year": X.replace_year, "month": X.replace_month, "weekday": X.replace_weekday}[part]
    g = df.withColumn("__v", F.explode(F.array(*map(F.lit, values)))).withColumn(col, change(F.col(col), F.col("__v")))
    return score(g).groupBy(F.col("__v").alias("value")).agg(F.avg(prediction).alias("mean"))


def permute(df: DataFrame, col: str, key: str, seed: int = 42) -> DataFrame:
    """The column's values dealt out anew over all rows: row numbers by key meet row numbers by hash.

    Numbers come from a range sort, zipWithIndex-free: partition sizes are summed on the driver (a number per partition).
    """
    def numbered(d, order):
        s = d.orderBy(*order).withColumn("__p", F.spark_partition_id())
        sizes = {r["__p"]: r["count"] for r in s.groupBy("__p").count().collect()}
        before, at = [], 0
        for p in range(max(sizes, default=-1) + 1):
            before.append(F.lit(at))
            at += sizes.get(p, 0)
        w = Window.partitionBy("__p").orderBy(*order)
        return s.withColumn("__n", F.row_number().over(w) + F.get(F.array(*(before or [F.lit(0)])), F.col("__p"))).drop("__p")

    a = numbered(df, [key])
    b = numbered(df.select(F.col(col).alias("__other"), F.xxhash64(key, F.lit(seed)).alias("__h"), F.col(key).alias("__k")), ["__h", "__k"]).select("__n", "__other")
    return a.join(b, "__n").withColumn(col, F.col("__other")).drop("__other", "__n")


def permutation_importance(df: DataFrame, cols: list[str], key: str, score: Callable[[DataFrame], float], seed: int = 42) -> dict[str, float]:
    base = score(df)
    return {c: base - score(permute(df, c, key, seed)) for c in cols}
