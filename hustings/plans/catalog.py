"""A catalog of lazily built tables: records, the minute grid and whatever operators derive from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hustings.config import Config
from hustings.plans.graph import shared_folder


class Catalog:
    """Tables by name, each built once as a plan when first asked for.

    `records` is the canonical frame (one row a submission); `registry` and `frequencies` are
    optional dimensions. Nothing runs before an action.
    """

    def __init__(self, spark: SparkSession, records: DataFrame, config: Config | None = None, registry: DataFrame | None = None, frequencies: tuple[DataFrame, DataFrame] | None = None) -> None:
        self.spark, self.records, self.config = spark, records, config or Config()
        self.registry, self.frequencies = registry, frequencies
        self._built: dict[str, DataFrame] = {}
        self._stored: dict[str, DataFrame] = {}
        self._kept = False

    def get(self, build: Callable[[Catalog], DataFrame]) -> DataFrame:
        name = f"{build.__module__}.{build.__qualname__}"
        if name in self._stored:
            return self._stored[name]
        if name not in self._built:
            self._built[name] = build(self)
        return self._built[name]

    def stored(self, build: Callable[[Catalog], DataFrame]) -> DataFrame:
        """As get, but written once to the shared folder and read from there, from then on by get too: for tables that several branches of a query need."""
        name = f"{build.__module__}.{build.__qualname__}"
        if name not in self._stored:
            self._stored[name] = self._written(self.get(build), build.__name__)
        return self._stored[name]

    def keep_records(self) -> None:
        """Write the records once, for queries that go over them several times: else each pass would read, join and clean them again.

        Tables that were asked for before stay as they are built.
        """
        if not self._kept:
            self.records, self._kept = self._written(self.records, "records"), True

    def _written(self, plan: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}"
        plan.write.parquet(path)
        return self.spark.read.schema(plan.schema).parquet(path)
