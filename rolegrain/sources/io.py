"""Reading tables by path, and frames and models as tables."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..plans.roles import Role, RoleFrame


def read(spark: SparkSession, data, columns: list[str] | None = None, **options) -> DataFrame:
    """A DataFrame as it is, or a path by its suffix (parquet, csv, orc, json)."""
    if isinstance(data, DataFrame):
        df = data
    elif isinstance(data, str) and (kind := data.rstrip("/").rsplit(".", 1)[-1]) in ("parquet", "csv", "orc", "json"):
        reader = spark.read
        if "schema" in options:
            reader = reader.schema(options.pop("schema"))
        if kind == "csv":
            options = {"header": True, **options}
        df = reader.format(kind).options(**options).load(data)
    else:
        raise ValueError(f"can't read {data!r}")
    return df.select(*columns) if columns else df


def load(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def save_frame(frame: RoleFrame, path: str, mode: str = "error", kind: str = "parquet", partitions: int | None = None) -> None:
    """metadata (a JSON row) and data side by side; parentheses in names become brackets."""
    spark = frame.df.sparkSession
    spark.createDataFrame([(frame.metadata(),)], "metadata string").coalesce(1).write.mode(mode).json(f"{path}/metadata.json")
    df = frame.df.repartition(partitions) if partitions else frame.df
    df.toDF(*[c.replace("(", "[").replace(")", "]") for c in df.columns]).write.mode(mode).format(kind).save(f"{path}/data.{kind}")


def load_frame(spark: SparkSession, path: str, kind: str = "parquet", partitions: int | None = None) -> RoleFrame:
    meta = json.loads(spark.read.schema("metadata string").json(f"{path}/metadata.json").first()[0])
    df = spark.read.format(kind).load(f"{path}/data.{kind}")
    df = df.toDF(*[c.replace("[", "(").replace("]", ")") for c in df.columns])
    df = df.repartition(partitions) if partitions else df
    return RoleFrame(df, meta["key"], {c: Role.from_json(r) for c, r in meta["roles"].items()}, meta["target"], meta["fold"], meta["task"])


def save_model(tables: dict[str, DataFrame], path: str, about: dict | None = None) -> None:
    """A fitted model: its tables as parquet and a JSON row, no pickles."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"tables": sorted(tables), **(about or {})}),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    about = json.loads(spark.read.schema("about string").json(f"{path}/about").first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in about["tables"]}, about


def materialize(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def to_pandas(frame: RoleFrame, key: str | None = None):
    """Ordered by key: (features, target, fold); for small frames."""
    pdf = frame.df.orderBy(key or frame.key).toPandas()
    return pdf[[frame.key, *frame.features]], pdf[frame.target] if frame.target else None, pdf[frame.fold] if frame.fold else None


@contextmanager
def session(app: str = "rolegrain", stop: bool = True, **conf):
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    try:
        yield spark
    finally:
        if stop:
            spark.stop()
