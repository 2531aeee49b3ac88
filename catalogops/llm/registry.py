"""Queries over the training-text operators, with their DuckDB twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from catalogops.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "minhash", "quality", "neighbours", "packing", "bpe", "urls", "chat", "licenses", "language", "fingerprints",
    "negatives", "slots", "periodic",
)


def query(name: str, oracle: str | None = None):
    def register(build):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir.rstrip("/"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def registered() -> tuple[dict, dict]:
    for module in MODULES:
        import_module(f"catalogops.llm.{module}")
    return dict(QUERIES), dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: 0 is the held-out fifth. Null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row is in the held-out fifth; a row without an id is not, and is never learned from."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def extended(df: DataFrame, **fields: str) -> StructType:
    """The schema of ``df`` with further fields, given as name=type; the frame's own is left alone."""
    schema = StructType(list(df.schema.fields))
    for name, kind in fields.items():
        schema = schema.add(name, DataType.fromDDL(kind))
    return schema


def free(names: list[str], taken: list[str]) -> list[str]:
    """The names, with underscores appended to those that a given column has (case is ignored)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
