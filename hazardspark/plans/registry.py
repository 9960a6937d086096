"""Registry of queries and their SQL counterparts, plus the fixture views."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazardspark.plans.views import VIEWS
from hazardspark.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

MODULES = (
    "tables quality dates spatial terrain rainfall grid risk forecast alerts "
    "modeling attribution feeds dashboard streams"
).split()


class Tables:
    """The tables and fixture views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            used = [t for t in BASE_TABLES if f" {t}" in VIEWS[name].replace("\n", " ")]
            for table in used:
                getattr(self, table).createOrReplaceTempView(table)
            return self.spark.sql(VIEWS[name])
        raise AttributeError(name)


def with_views(names: str, sql: str) -> str:
    """Prefix ``sql`` with the fixture views it reads."""
    ctes = [f"{n} AS ({VIEWS[n]})" for n in names.split()]
    return "WITH " + ",\n".join(ctes) + ("\n" if sql.lstrip().upper().startswith(",") else "\n") + sql


def query(name: str, views: str = "", sql: str | None = None, recursive: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            text = with_views(views, sql) if views else sql
            ORACLES[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text
        return fn

    return wrap


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"hazardspark.plans.{module}")
