"""Imperative front end: components with operators, put together one by one; the last one added is the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from rivulet.operators import joins
from rivulet.operators.rows import Operator, union
from rivulet.sources.registry import Sources


class Component:
    """A stage of a plan. Operators added to it run on its output, in their order."""

    def __init__(self, name: str, df: DataFrame):
        self.name, self._df, self._key, self._print = name, df, (), False

    def add(self, *operators: Operator) -> Component:
        for op in operators:
            self._df = op(self._df)
        return self

    def output_key(self, *key: int | str) -> Component:
        """The columns the next component joins on, by position or name."""
        self._key = key
        return self

    @property
    def key(self) -> list[str]:
        return [self._df.columns[k] if isinstance(k, int) else k for k in self._key]

    def partitioned(self) -> Component:
        """Shuffles by the output key at once, for several uses of one partitioning."""
        self._df = self._df.repartition(*self.key)
        return self

    def to_df(self) -> DataFrame:
        return self._df


class Plan:
    def __init__(self, sources: Sources):
        self.sources = sources
        self.components: list[Component] = []

    def _add(self, c: Component) -> Component:
        self.components.append(c)
        return c

    def source(self, name: str, table: str | None = None) -> Component:
        return self._add(Component(name, self.sources.load(table or name)))

    def stage(self, name: str, *parents: Component) -> Component:
        """The rows of all parents, one after the other."""
        return self._add(Component(name, union(*[p.to_df() for p in parents])))

    def equi_join(self, left: Component, right: Component, keep_right: bool = False, residual: Column | None = None) -> Component:
        return self._add(Component(f"{left.name}_{right.name}", joins.equi_join(left.to_df(), right.to_df(), left.key, right.key, keep_right, residual)))

    def theta_join(self, left: Component, right: Component, condition: Column | None = None) -> Component:
        df = joins.cross_join(left.to_df(), right.to_df()) if condition is None else joins.theta_join(left.to_df(), right.to_df(), condition)
        return self._add(Component(f"{left.name}_{right.name}", df))

    def nway_join(self, parents: Sequence[Component], predicates: Sequence[tuple[set[str], Column]]) -> Component:
        return self._add(Component("_".join(p.name for p in parents), joins.nway_join({p.name: p.to_df() for p in parents}, predicates)))

    def result(self) -> DataFrame:
        return self.components[-1].to_df()


def options(text: str) -> dict[str, str]:
    """Lines of a key and a value; blank lines and those that begin with # are left out, a key given again counts as given last."""
    pairs = (line.split(None, 1) for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#"))
    return {k: (rest[0].strip() if rest else "") for k, *rest in pairs}


class Context:
    """A session with its sources and the queries that run in it.

    Of the options, DIP_DATA_PATH names a folder whose parquet tables become
    sources, and the largest of those that end in _PAR is the number of shuffle
    partitions. All others (placement, cardinalities, acknowledgements) are kept
    to be asked for, but the optimizer has no need of them.
    """

    def __init__(self, spark: SparkSession, settings: Mapping[str, str] | None = None):
        self.spark, self.sources, self.settings = spark, Sources(spark), dict(settings or {})
        if path := self.settings.get("DIP_DATA_PATH"):
            self.sources.register_parquet(path)
        parallel = [int(v) for k, v in self.settings.items() if k.endswith("_PAR")]
        if parallel:
            spark.conf.set("spark.sql.shuffle.partitions", str(max(parallel)))

    def plan(self) -> Plan:
        return Plan(self.sources)

    def queries(self) -> dict[str, str]:
        """Running streams and what they are doing."""
        return {q.name or q.id: q.status["message"] for q in self.spark.streams.active}

    def stop(self, name: str) -> bool:
        for q in self.spark.streams.active:
            if name in (q.name, q.id):
                q.stop()
                return True
        return False
