"""Encoders of categories. fit_* returns a small relational model; apply_* joins it.

Model of labels: (col, val, cnt, idx). All columns of a fit share one unpivoted
aggregate, so the number of jobs doesn't grow with the number of columns.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.jobs import cut

#: A column's part of a model is looked up by broadcast up to so many rows and bytes of values.
SMALL_ROWS, SMALL_BYTES = 10_000, 1_000_000


def unpivot(df: DataFrame, cols: list[str], extra: list[str] = ()) -> DataFrame:
    """(extra..., col, val): one row per cell, values as strings, NaN as 'NaN'."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("val")) for c in cols]))
    return df.select(*extra, cells.alias("__c")).select("*", "__c.col", "__c.val").drop("__c")


ORDERS = {
    "frequencyDesc": lambda: [F.desc("cnt"), F.asc("val")],
    "frequencyAsc": lambda: [F.asc("cnt"), F.asc("val")],
    "alphabetAsc": lambda: [F.asc("val")],
    "alphabetDesc": lambda: [F.desc("val")],
}


def fit_labels(df: DataFrame, cols: list[str], min_freq: int = 0, order: str = "frequencyDesc", nan_last: bool = False) -> DataFrame:
    """Values with more than min_freq rows, numbered from 1 in the order."""
    counts = unpivot(df, cols).where("val is not null").groupBy("col", "val").agg(F.count("*").alias("cnt"))
    kept = counts.where((F.col("cnt") > min_freq) & ((F.col("val") != "NaN") if nan_last else F.lit(True)))
    idx = F.row_number().over(Window.partitionBy("col").orderBy(*ORDERS[order]()))
    model = kept.select("col", "val", "cnt", idx.cast("long").alias("idx"))
    if nan_last:
        tail = model.groupBy("col").agg((F.max("idx") + 1).alias("idx")).select("col", F.lit("NaN").alias("val"), F.lit(0).cast("long").alias("cnt"), "idx")
        model = model.unionByName(tail)
    return model


def fit_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, val, cnt): frequencies need no numbering."""
    return unpivot(df, cols).where("val is not null").groupBy("col", "val").agg(F.count("*").alias("cnt"))


def small_parts(model: DataFrame, key: str = "val") -> list[str]:
    """The columns whose parts of a model(col, key, ...), made once, are small."""
    of = model.groupBy("col").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(key)), F.lit(0)).alias("bytes"))
    return sorted(r["col"] for r in of.where((F.col("n") <= SMALL_ROWS) & (F.col("bytes") <= SMALL_BYTES)).select("col").collect())


def sized(model: DataFrame, small: list[str] | None, key: str = "val") -> tuple[DataFrame, list[str]]:
    """The model and its small parts; one whose small parts aren't known is made once to count them."""
    if small is not None:
        return model, small
    model = cut(model)
    return model, small_parts(model, key)


def hinted(part: DataFrame, small: bool) -> DataFrame:
    """A small part is broadcast: by a shuffle, a few values would bring all rows to as few tasks. A large one is the planner's to judge, and Spark splits its hot values."""
    return F.broadcast(part) if small else part


def lookup(df: DataFrame, model: DataFrame, col: str, value: str, out: str, default, dtype: str = "int", small: bool = False) -> DataFrame:
    """Left join of one column's part of the model."""
    part = model.where(F.col("col") == col).select(F.col("val").alias("__val"), F.col(value).alias("__idx"))
    joined = df.join(hinted(part, small), F.col(f"`{col}`").cast("string") == F.col("__val"), "left")
    return joined.withColumn(out, F.coalesce(F.col("__idx"), F.lit(default)).cast(dtype)).drop("__val", "__idx")


def label_encode(df: DataFrame, model: DataFrame, cols: list[str], default: int = 0, small: list[str] | None = None) -> DataFrame:
    model, small = sized(model, small)
    for c in cols:
        df = lookup(df, model, c, "idx", f"le__{c}", default, small=c in small)
    return df


def ordinal_encode(df: DataFrame, model: DataFrame | None, cols: list[str], small: list[str] | None = None) -> DataFrame:
    """Strings by alphabetical number, NaN last, unseen 0; numeric columns pass as they are."""
    kinds = dict(df.dtypes)
    if model is not None:
        model, small = sized(model, small)
    for c in cols:
        if kinds[c] == "string":
            df = lookup(df, model, c, "idx", f"ord__{c}", 0, "double", c in small)
        else:
            df = df.withColumn(f"ord__{c}", F.col(f"`{c}`").cast("double"))
    return df


def freq_encode(df: DataFrame, model: DataFrame, cols: list[str], small: list[str] | None = None) -> DataFrame:
    """Rows with the value in the fitted data; 1 for unseen and NULL."""
    model, small = sized(model, small)
    for c in cols:
        df = lookup(df, model, c, "cnt", f"freq__{c}", 1, small=c in small)
    return df


def intersection_name(cols) -> str:
    return f"inter__({'__'.join(cols)})"


def with_intersections(df: DataFrame, cols: list[str], max_depth: int = 2, intersections: list[tuple[str, ...]] | None = None) -> tuple[DataFrame, list[str]]:
    """Joined strings of every combination of 2..max_depth columns; NULL if any part is NULL."""
    sets = intersections or [c for d in range(2, max_depth + 1) for c in combinations(cols, d)]
    made = {}
    for s in sets:
        parts: list[Column] = []
        for i, c in enumerate(s):
            parts += [F.lit("_")] * bool(i) + [F.col(f"`{c}`").cast("string")]
        made[intersection_name(s)] = F.concat(*parts)
    return df.withColumns(made), list(made)


def one_hot(df: DataFrame, col: str, size: int, first: int = 0) -> DataFrame:
    """Columns ohe_0__col .. of 0/1 for codes first .. first + size - 1."""
    return df.withColumns({f"ohe_{k}__{col}": F.coalesce((F.col(col) == first + k).cast("int"), F.lit(0)) for k in range(size)})


def top_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), F.asc(col)).limit(n)
