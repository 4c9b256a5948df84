"""Joins, unions and validation plumbing of role frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat(frames: list[DataFrame], key: str) -> DataFrame:
    """Left joins on the key; service columns of later frames are dropped. Bucketed or pre-partitioned sides don't shuffle."""
    def add(a, b):
        return a.join(b.drop(*[c for c in b.columns if c != key and c in a.columns]), key, "left")

    return reduce(add, frames)


def stitch_folds(service: DataFrame, predictions: list[DataFrame], key: str) -> DataFrame:
    """The folds' disjoint predictions in one union and one join, not a join per fold."""
    return service.join(reduce(DataFrame.unionByName, predictions), key, "left")


def union_train_valid(train: DataFrame, valid: DataFrame) -> DataFrame:
    return train.withColumn("is_val", F.lit(0)).unionByName(valid.withColumn("is_val", F.lit(1)))


def mark_validation(df: DataFrame, fold: str, k: int) -> DataFrame:
    """1 on fold k, and where the fold is NULL."""
    return df.withColumn("is_val", F.when(F.col(fold) != k, 0).otherwise(1))


def folds(df: DataFrame, fold: str, n: int | None = None):
    """(train, valid) of every fold."""
    n = n or df.agg(F.max(fold)).first()[0] + 1
    for k in range(n):
        m = mark_validation(df, fold, k)
        yield m.where("is_val = 0").drop("is_val"), m.where("is_val = 1").drop("is_val")


def thin_validation(df: DataFrame, most: int, seed: int = 42) -> DataFrame:
    n = df.where("is_val = 1").count()
    return df if n <= most else df.where((F.col("is_val") != 1) | (F.rand(seed) < most / n))


def expand_vector(df: DataFrame, col: str, size: int, names: str = "{col}_{i}") -> DataFrame:
    return df.withColumns({names.format(col=col, i=i): F.get(F.col(col), F.lit(i)) for i in range(size)})


def select_columns(df: DataFrame, cols: list[str], optional: list[str] = ()) -> DataFrame:
    """A name ending in * stands for every column with that beginning."""
    out: list[str] = []
    for c in [*cols, *[c for c in optional if c in df.columns or c.endswith("*")]]:
        out += [x for x in (filter(lambda x, p=c[:-1]: x.startswith(p), df.columns) if c.endswith("*") else [c]) if x not in out]
    return df.select(*[f"`{c}`" for c in out])


def probability_columns(df: DataFrame, col: str, classes: int) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(col, array_to_vector(F.array(*[F.get(F.col(col), F.lit(i)) for i in range(classes)])))


def spread(df: DataFrame, n: int, key: Column) -> DataFrame:
    """n partitions, each with a like mix of all parents' rows."""
    return df.repartition(n, F.pmod(key, F.lit(n)))
