"""Delimited text without header, as `.tbl` and `.csv` files are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", trailing: bool = False, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """trailing: lines end with a separator, which Spark would read as a further empty column."""
    full = T.StructType([*schema.fields, T.StructField("_end", T.StringType())]) if trailing else schema
    reader = (spark.readStream if streaming else spark.read).schema(full).option("sep", sep).option("header", "false")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.csv(path)
    return df.drop("_end") if trailing else df
