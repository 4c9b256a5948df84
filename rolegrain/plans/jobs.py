"""Parallel Spark jobs over a bounded number of slots, deadlines and persistence levels."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame

PROFILES = {"no_parallelism": 1, "mlpipe_level": 2, "intra_mlpipe": 4}


def run_parallel(tasks: list[Callable], slots: int = 1) -> list:
    """Results in the tasks' order; the first exception is raised. Threads inherit Spark's local properties."""
    if slots <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(slots) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(t)) for t in tasks]]


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the folder that all executors share (spark.checkpoint.dir) and cuts its lineage.

    Only a local session may do without that setting; it gets a temporary folder.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="rolegrain-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def pinned(df: DataFrame) -> DataFrame:
    """A table of a row per column or class, as literal rows."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


class Deadline:
    def __init__(self, seconds: float):
        self.end = time.monotonic() + seconds

    def left(self) -> float:
        return max(0.0, self.end - time.monotonic())

    def over(self) -> bool:
        return self.left() == 0.0


class Persistence:
    """Named materialisations: cache, checkpoint (shared folder), bucketed table or none, by level."""

    def __init__(self, levels: dict[str, str] | None = None, buckets: int = 16):
        self.levels = {"reader": "cache", "regular": "cache", "checkpoint": "checkpoint", **(levels or {})}
        self.buckets, self.kept = buckets, {}

    def persist(self, name: str, df: DataFrame, level: str = "regular", key: str | None = None) -> DataFrame:
        how = self.levels[level]
        if how == "cache":
            out = df.cache()
        elif how == "checkpoint":
            out = df.checkpoint(eager=True)
        elif how == "bucketed":
            df.write.bucketBy(self.buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
            out = df.sparkSession.table(name)
        elif how == "none":
            out = df
        else:
            raise ValueError(f"no way to persist by {how}")
        self.kept[name] = (how, out)
        return out

    def unpersist(self, name: str) -> None:
        how, df = self.kept.pop(name)
        if how == "cache":
            df.unpersist()
        elif how == "bucketed":
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")

    def unpersist_all(self) -> None:
        for name in list(self.kept):
            self.unpersist(name)

    @contextmanager
    def scope(self):
        before = set(self.kept)
        try:
            yield self
        finally:
            for name in set(self.kept) - before:
                self.unpersist(name)
