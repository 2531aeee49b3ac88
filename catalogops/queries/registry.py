"""Registration of queries: a Spark callable and, where SQL can state it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from catalogops.plans.fixtures import duckdb_sql
from catalogops.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir.rstrip("/"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = duckdb_sql(oracle)
        return run

    return register
