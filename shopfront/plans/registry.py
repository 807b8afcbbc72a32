"""Registry of named queries: a Spark callable and, where SQL can say it, the DuckDB equivalent."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import leads as L
from . import fixtures as fx


class Inputs:
    """The given tables and fixtures of one folder, read lazily by attribute name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fx.GIVEN:
            return fx.table(self.spark, self.sf_dir, name)
        return fx.table(self.spark, self.sf_dir, "fx_" + name)

    def denorm(self) -> DataFrame:
        return L.denorm(self.business, self.phone, self.email, self.social)

    def leads(self) -> DataFrame:
        return L.scored(self.denorm())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers fn(inputs) under a name, with the SQL that must give the same rows."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, str(sf_dir).rstrip("/")))

        run.__name__ = name
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = fx.duck(oracle)
        return fn

    return wrap


def load() -> None:
    from . import queries_contacts, queries_feed, queries_ingest, queries_pages, queries_stats, queries_stream  # noqa: F401
