"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fraudloom.fixtures import view, with_views
from fraudloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Derived views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.dir, name)


def sql(views: str, body: str, **ctes: str) -> str:
    """Checking SQL: the views, then named steps, then the body."""
    text = with_views(*views.split())
    for name, step in ctes.items():
        text += f",\n{name} AS ({step})"
    return f"{text}\n{body}"


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(prepare(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return build

    return register
