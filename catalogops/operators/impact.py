"""What a change would lose in the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.functions.casting import tried
from catalogops.functions.opkinds import destructive
from catalogops.plans.skew import skew_join

# From this many rows or values on a loss is destructive.
RISKY_BELOW = 1000


def level(count: Column) -> Column:
    return (
        F.when(count.isNull(), "UNKNOWN")
        .when(count == 0, "SAFE")
        .when(count < RISKY_BELOW, "RISKY")
        .otherwise("DESTRUCTIVE")
    )


def _reason(count: Column, what: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {what}"))


def rows_at_risk(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(object, data_at_risk, level, reason) by row count; a count reads no column."""
    result = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("data_at_risk")).select(
            F.lit(name).alias("object"), "data_at_risk", level(F.col("data_at_risk")).alias("level"),
            _reason(F.col("data_at_risk"), "rows").alias("reason"),
        )
        result = one if result is None else result.unionByName(one)
    return result


def values_at_risk(name: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same per column by non-null count: all columns in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("object"), F.col(c).alias("data_at_risk")) for c in columns]))
    return counts.select(each.alias("c")).select(
        "c.object", "c.data_at_risk", level(F.col("c.data_at_risk")).alias("level"),
        _reason(F.col("c.data_at_risk"), "values").alias("reason"),
    )


def container_risk(objects: DataFrame) -> DataFrame:
    """Catalogs by their schemas (any is destructive), schemas by their tables (three levels)."""
    held = objects.where(F.col("object_type").isin("schema", "table")).groupBy("parent_id", "object_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    boxes = objects.where(F.col("object_type").isin("catalog", "schema")).select(
        F.col("object_id").alias("parent_id"), F.col("object_type").alias("box"),
        F.when(F.col("object_type") == "catalog", "schema").otherwise("table").alias("object_type"),
    )
    found = boxes.join(held, ["parent_id", "object_type"], "left").withColumn("data_at_risk", F.coalesce("n", F.lit(0)))
    return found.select(
        F.col("parent_id").alias("object"), "data_at_risk",
        F.when((F.col("box") == "catalog") & (F.col("data_at_risk") > 0), "DESTRUCTIVE").otherwise(level(F.col("data_at_risk"))).alias("level"),
        F.concat(F.col("data_at_risk").cast("string"), F.lit(" "), F.col("object_type"), F.lit("s")).alias("reason"),
    )


def risk_sample(df: DataFrame, order: Sequence[str], risk: str) -> DataFrame:
    """The rows a report shows: first 3 by key when risky, first 5 when destructive."""
    return df.orderBy(*order).limit({"RISKY": 3, "DESTRUCTIVE": 5}.get(risk, 0))


def lossy_casts(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """(column, to_type, checked, failed, changed) for each column and new type, in one pass.

    failed: the value does not cast; changed: it casts, but not back to what it was.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs, rows = [], []
    for i, (c, to) in enumerate(casts.items()):
        there = tried(F.col(c), types[c], to)
        back = there.try_cast(types[c])
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count_if(F.col(c).isNotNull() & there.isNull()).alias(f"f{i}"),
            F.count_if(F.col(c).isNotNull() & there.isNotNull() & ~back.eqNullSafe(F.col(c))).alias(f"c{i}"),
        ]
        rows.append(
            F.struct(F.lit(c).alias("column"), F.lit(to).alias("to_type"), F.col(f"n{i}").alias("checked"), F.col(f"f{i}").alias("failed"), F.col(f"c{i}").alias("changed"))
        )
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def assess_ops(ops: DataFrame, counts: DataFrame) -> DataFrame:
    """Add data_at_risk and level to ops (op_id, op, target); ``counts`` is (target, n).

    Kinds that lose nothing are safe; a destructive op on an object that was not counted is
    unknown, never safe.
    """
    found = skew_join(ops, counts.select("target", F.col("n").alias("_n")), ["target"], "left")
    loses = destructive(F.col("op"))
    risk = F.when(loses, F.col("_n")).otherwise(F.lit(0)).cast("long")
    return found.select(*ops.columns, risk.alias("data_at_risk"), level(risk).alias("level"))
