"""Named queries: an operator bound to the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafworks.sources.views import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The driver tables and catalogue views of one directory, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from leafworks.sources.views import SOURCES

        return view(self.spark, self.sf_dir, name) if name in SOURCES else table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), extra: str = "", recursive: bool = False):
    """Registers a function of Inputs; sql may use the named views, and extra, more common table expressions (recursive ones if so said)."""

    def add(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            head = with_views(*views, query="") if views else ""
            if extra:
                head = f"{head.rstrip()}, {extra} " if head else f"WITH {extra} "
                if recursive:
                    head = head.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLES[name] = head + sql
        return build

    return add
