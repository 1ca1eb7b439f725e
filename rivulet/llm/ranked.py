"""Exact positions under a global range-partitioned sort.

Rows are range-partitioned and sorted by group and order, numbered within their
partition, and written once. Since ranges don't respect groups, a group with
millions of rows is spread over as many partitions as it needs; only the first
and last group of a partition can go on in another one, so the offsets to add
come from at most two summary rows a partition, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.shared import staged


def _numbering(group: list[str], weight: str | None, keep: int | None, every_group: bool):
    """A function for mapInArrow over partitions sorted by group: adds __pid, __pos (running weight in the group within the partition) and the summary rows."""

    def number(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        opened, open_keys, total, is_first, edges, schema = None, None, 0, True, [], None  # the group that is open at the end of a batch

        for batch in batches:
            n = batch.num_rows
            schema = batch.schema
            if not n:
                continue
            key = lambda k: tuple(batch.column(g)[int(k)].as_py() for g in group)  # noqa: B023, E731
            keys = lambda rows: [batch.column(g).take(pa.array(rows)) for g in group]  # noqa: B023, E731
            new = np.zeros(n, dtype=bool)
            for g in group:
                codes = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = opened is None or key(0) != opened
            w = np.ones(n, dtype=np.int64) if weight is None else batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(w)
            which = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            pos = run - np.where(which >= 0, (run - w)[which], -total)
            starts = np.flatnonzero(new)
            if len(starts):
                if opened is not None and (every_group or is_first):
                    edges.append((open_keys, [int(pos[starts[0] - 1]) if starts[0] else total]))
                inner = len(starts) - 1 if every_group else min(1, len(starts) - 1) if opened is None else 0
                if inner:
                    edges.append((keys(starts[:inner]), pos[starts[1 : inner + 1] - 1]))
                is_first = opened is None and len(starts) == 1
                opened, open_keys = key(starts[-1]), keys(starts[-1:])
            total = int(pos[-1])
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, pid, dtype=np.int32)), pa.array(pos), pa.array(np.zeros(n, dtype=bool))],
                names=[*schema.names, "__pid", "__pos", "__summary"],
            )
            yield out.filter(pa.array(pos <= keep)) if keep is not None else out
        if opened is not None:
            edges.append((open_keys, [total]))
            ends = np.concatenate([np.asarray(p, dtype=np.int64) for _, p in edges])
            cols = []
            for f in schema:
                k = group.index(f.name) if f.name in group else None
                cols.append(pa.nulls(len(ends), f.type) if k is None else pa.concat_arrays([e[k] for e, _ in edges]))
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.full(len(ends), pid, dtype=np.int32)), pa.array(ends), pa.array(np.ones(len(ends), dtype=bool))],
                names=[*schema.names, "__pid", "__pos", "__summary"],
            )

    return number


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: str | None = None, keep: int | None = None, every_group: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with __pid and __pos, and the offsets (group, __pid, __before) to add to __pos for the position in the whole group.

    weight: a bigint column to sum instead of counting rows. keep: rows beyond
    this position within their partition are dropped, as their position in the
    whole group is beyond it too. every_group: offsets hold each group of each
    partition (with its total there, ``__total``), else only those at the edges.
    """
    group = list(group)
    df = staged(df, "unranked")  # read twice: for the bounds of the ranges, and for the sort
    sorted_rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "__pid int", "__pos bigint", "__summary boolean"])
    numbered = staged(sorted_rows.mapInArrow(_numbering(group, weight, keep, every_group), schema), "ranked")
    summary = numbered.where("__summary").groupBy(*group, "__pid").agg(F.max("__pos").alias("__total"))
    before = F.sum("__total").over(W.partitionBy(*group).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1))
    offsets = summary.select(*group, "__pid", "__total", F.coalesce(before, F.lit(0)).alias("__before"))
    return numbered.where("not __summary").drop("__summary"), offsets


def placed(rows: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds ``__place``, the position in the whole group."""
    o = offsets.where("__before > 0").select(*[F.col(g).alias(f"__o_{g}") for g in group], F.col("__pid").alias("__o_pid"), "__before")
    on = F.col("__pid") == F.col("__o_pid")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    return rows.join(o, on, "left").withColumn("__place", F.col("__pos") + F.coalesce("__before", F.lit(0))).drop("__o_pid", "__before", *[f"__o_{g}" for g in group])
