"""Tables written part-way through a job, in the folder all executors share.

Lineage is cut by writing a parquet table (or by ``DataFrame.checkpoint``),
never by keeping blocks on executors, so a lost executor costs a re-read only.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is made only where it is unset and all runs on this machine, elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="rivulet-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def passing_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for what this session needs only while it runs; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/rivulet/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster, for the Python workers of operators that need it there."""
    sc = spark.sparkContext
    if _is_local(spark) or sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rivulet-"), "rivulet.zip")  # on the driver, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("rivulet", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def staged(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` once and reads it back; later branches read the files instead of repeating the work."""
    path = passing_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` once, one file for each bucket of ``key`` and partition, and reads it back: joins and groupings by ``key`` of any parts of it need no further shuffle."""
    spark = df.sparkSession
    path, name = passing_path(spark, label), f"spark_catalog.default.rivulet_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    """Takes the entry out of a catalogue that outlives the session."""
    try:
        if spark.conf.get("spark.sql.catalogImplementation") != "in-memory":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001 - the session has ended, and its catalogue with it
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """The session's number of shuffle partitions, more (up to Spark's limit of buckets) if the size of the files behind ``df`` calls for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # not known, as of rows that come from no file
        size = 0
    return max(shuffle_partitions(df.sparkSession), min(100_000, -(-size // bytes_each)))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only when a count proves the bound; otherwise the optimizer's shuffle join is left alone."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
