"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.plans.compiler import Catalog
from trustmill.sources import testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def at_the_edge(df: DataFrame) -> DataFrame:
    """Exact decimals leave as doubles, whole numbers as longs."""
    kinds = {"timestamp_ntz": "timestamp", "int": "long", "smallint": "long", "tinyint": "long"}
    return df.select(*(F.col(f"`{c}`").cast("double" if t.startswith("decimal") else kinds.get(t, t)).alias(c) for c, t in df.dtypes))


def query(sql: str | None = None, facts: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its name; `facts` puts the rules of the fact store before the SQL."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return at_the_edge(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {testdata.SQL.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}" if facts else sql
        return f

    return register


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(testdata.facts(spark, sf_dir), testdata.sources(spark, sf_dir), testdata.companies(spark, sf_dir))
