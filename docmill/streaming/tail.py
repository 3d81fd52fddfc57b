"""Collections and tables as streams (an extension: the model itself has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.predicate import compile_query


def follow(spark: SparkSession, folder: str, schema, form: str = "parquet") -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.format(form).schema(schema).load(folder)


def windowed(events: DataFrame, query: dict | None, *, time: str, length: str, late: str, by: list[str], **aggs) -> DataFrame:
    """Matching events, aggregated by time windows; late events count until the watermark passes."""
    df = events.filter(compile_query(events, query)) if query else events
    grouped = df.withWatermark(time, late).groupBy(F.window(time, length), *by)
    return grouped.agg(*[c.alias(k) for k, c in aggs.items()])
