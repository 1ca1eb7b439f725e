"""Sinks that pass their input on, so that they can stand anywhere in a chain."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

from pyspark.sql import DataFrame

from rivulet.operators.rows import Operator


def print_to(path: str, sep: str = "|") -> Operator:
    """Every row to a folder of text files, which is emptied first."""

    def run(df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("sep", sep).csv(path)
        return df

    return run


def store(view: str) -> Operator:
    """A view of the current result that SQL can ask."""

    def run(df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(view)
        return df

    return run


def publish(send: Callable[[Iterable], None], every: int = 1) -> Operator:
    """Rows to an outside channel: ``send`` gets an iterator over the rows of each partition, where they are; with ``every``, over the first of each so many."""

    def run(df: DataFrame) -> DataFrame:
        df.foreachPartition(lambda rows: send(islice(rows, 0, None, every)))
        return df

    return run


def materialize(path: str, sep: str = "|", rows_per_file: int = 1_000_000) -> Operator:
    """Delimited text files of bounded length, as on a distributed file system."""

    def run(df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("sep", sep).option("maxRecordsPerFile", rows_per_file).csv(path)
        return df

    return run


def key_values(df: DataFrame, n_keys: int) -> list[str]:
    """A small result as lines ``k1|k2 = value``; a single value without key for a global one. It is brought to the driver."""
    lines = []
    for row in df.collect():
        vals = ["" if x is None else str(x) for x in row]
        lines.append(f"{'|'.join(vals[:n_keys])} = {':'.join(vals[n_keys:])}" if n_keys else ":".join(vals))
    return sorted(lines)
