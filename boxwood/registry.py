"""Where queries register themselves, with the DuckDB SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
MODULES = ("relational", "analytics", "texts", "trees", "corpus", "vectors", "changes", "governed", "streams", "files", "evidence", "joins", "grounding", "shapes", "focus", "decisions")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name; ``oracle`` is None where SQL can't express it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """Register a Spark SQL text over the tables; without ``oracle`` DuckDB runs the same text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in sql:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    query(name, oracle or sql)(run)


def load() -> None:
    """Import every module of queries."""
    for m in MODULES:
        import_module(f"boxwood.plans.{m}")
