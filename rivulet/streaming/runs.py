"""Structured Streaming: bounded runs over files, windows with watermarks, interval joins, and running results.

State lives in the state store and its checkpoints in the shared folder, so a
run goes on after an executor or the driver is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rivulet.shared import passing_path


def events_stream(spark: SparkSession, path: str, ts: str, late: str | None = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; ts becomes an instant with a watermark of the given lateness."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", jpath.getName()), jpath.getParent().toString()
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if late else df


def window_totals(events: DataFrame, ts: str, seconds: int, *aggs: Column, slide: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    w = F.window(ts, f"{seconds} seconds", f"{slide or seconds} seconds")
    out = events.groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def interval_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs with equal keys at most so many seconds apart; both watermarks and the interval bound the state."""
    gap = F.expr(f"INTERVAL {seconds} SECONDS")
    cond = (F.col(left_ts) >= F.col(right_ts) - gap) & (F.col(left_ts) <= F.col(right_ts) + gap)
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    return left.join(right, cond)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there now, and gives its output as a table.

    append: every output row. complete: the last state of the result. update:
    every change, with the number of its batch in ``batch``.
    """
    spark = stream.sparkSession
    base = passing_path(spark, "stream")
    out, schema = f"{base}/out", stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    elif mode == "complete":
        query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(out)).start()
    else:
        # a batch that is run again after a failure overwrites its own folder only
        query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start()
    query.awaitTermination()
    if mode == "update":
        schema = stream.schema.add("batch", T.IntegerType())
        return spark.read.schema(schema).option("basePath", out).parquet(out)
    return spark.read.schema(schema).parquet(out)


def live(stream: DataFrame, name: str, mode: str = "complete", every: str | None = None) -> StreamingQuery:
    """Keeps the current result as a table ``name`` that SQL can ask while the stream runs, renewed every so often.

    The table is held by the driver, so this is for small results such as totals.
    """
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode)
    return (writer.trigger(processingTime=every) if every else writer).start()


def latest_by_key(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The result that a stream of updates ends with."""
    w = W.partitionBy(*keys).orderBy(F.col("batch").desc())
    return updates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "batch")


def changes_of(updates: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys.., batch, value, multiplicity): each update as a retraction of the old value and the new one."""
    w = W.partitionBy(*keys).orderBy("batch")
    old = updates.select(*keys, "batch", F.col(value), F.lag(value).over(w).alias("__old"))
    pair = F.array(F.struct(F.col("__old").alias(value), F.lit(-1).alias("multiplicity")), F.struct(F.col(value).alias(value), F.lit(1).alias("multiplicity")))
    return old.select(*keys, "batch", F.inline(pair)).where(F.col(value).isNotNull())
