"""Fitted plans over streams: transforms are projections and static joins, so a stream runs through them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.pipelines import Plan


def transform_stream(plan: Plan, stream: DataFrame, keep: list[str]) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return plan.transform(stream, keep)
