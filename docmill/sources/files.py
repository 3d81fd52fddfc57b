"""Tables in files as collections of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.values import SEQ


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON, each in a variant column doc that keeps absent and null apart."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("doc"))


def with_order(df: DataFrame) -> DataFrame:
    """An order number that follows the partitions as they are; unique, increasing, with gaps."""
    return df if SEQ in df.columns else df.withColumn(SEQ, F.monotonically_increasing_id())


def write(df: DataFrame, path: str, form: str = "parquet", **options: str) -> None:
    df.drop(SEQ).write.format(form).options(**options).save(path)
