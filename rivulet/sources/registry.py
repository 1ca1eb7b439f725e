"""Tables by name, from providers that can be added; the one registered last is asked first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Loader = Callable[[SparkSession, str], "DataFrame | None"]


class Sources:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._providers: list[tuple[str, Loader]] = []

    def register(self, label: str, loader: Loader) -> Sources:
        """loader gives the table of a name, or None if it has none."""
        self._providers.insert(0, (label, loader))
        return self

    def register_parquet(self, folder: str) -> Sources:
        def load(spark: SparkSession, name: str) -> DataFrame | None:
            path = f"{folder}/{name}.parquet"
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            return spark.read.parquet(path) if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath) else None

        return self.register(f"parquet in {folder}", load)

    def register_table(self, name: str, df: DataFrame) -> Sources:
        return self.register(f"table {name}", lambda spark, n: df if n == name else None)

    def load(self, name: str, extension: str = "") -> DataFrame:
        """By name with the extension, else by the bare name."""
        for n in dict.fromkeys([name + extension, name]):
            for _, loader in self._providers:
                if (df := loader(self.spark, n)) is not None:
                    return df
        raise LookupError(f"no provider has {name}; asked: {', '.join(label for label, _ in self._providers) or 'none'}")

    def views(self, *names: str) -> None:
        """Temporary views, for SQL."""
        for n in names:
            self.load(n).createOrReplaceTempView(n)
