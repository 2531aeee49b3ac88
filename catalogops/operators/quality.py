"""Declared constraints checked on the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.operators.impact import level
from catalogops.plans.durable import durable
from catalogops.plans.ordered import BITS, last_before


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def _all_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])


def pk_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(key columns, violation, n): keys with a null, keys held by more than one row.

    One aggregation that combines before the shuffle; a hot key is one row per task.
    """
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.withColumn("violation", F.when(_any_null(columns), "null_key").when(F.col("n") > 1, "duplicate"))
        .where("violation IS NOT NULL")
        .select(*columns, "violation", "n")
    )


def fk_violations(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str], match_full: bool = False
) -> DataFrame:
    """(key columns, violation, n): orphans; with ``match_full`` also partly null keys.

    The child is counted per key first, so what meets the parent has one row per key.
    """
    counts = child.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    partly = _any_null(columns) & ~_all_null(columns)
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns)]).distinct()
    orphans = counts.where(~_any_null(columns)).join(keys, list(columns), "left_anti").withColumn("violation", F.lit("orphan"))
    result = orphans.select(*columns, "violation", "n")
    if match_full:
        broken = counts.where(partly).withColumn("violation", F.lit("partly_null"))
        result = result.unionByName(broken.select(*columns, "violation", "n"))
    return result


def check_violations(df: DataFrame, expression: str) -> DataFrame:
    """Rows where the expression is false; null passes."""
    return df.where(~F.coalesce(F.expr(expression), F.lit(True)))


def not_null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, violation, n) for every column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns]))
    return counts.select(each.alias("c")).select("c.column", F.lit("null").alias("violation"), "c.n")


def pk_timeseries(df: DataFrame, key: str, ts: str, *, bits: int = BITS) -> DataFrame:
    """Per key of a time series: rows, duplicate instants, and the gaps between instants in micros.

    A row without its time, or without its key, breaks the key too: ``null_times`` counts the former of
    each key, and the rows without a key are the row whose key is null.
    """
    instants = durable(
        df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("at", F.unix_micros(F.col(ts).cast("timestamp"))),
        "instants",
    )
    before = last_before(instants.where(f"{key} IS NOT NULL AND at IS NOT NULL"), [key], "at", F.col("at"), "previous", bits=bits, levels=2)
    gap = F.col("at") - F.col("previous")
    gaps = before.groupBy(key).agg(
        F.count_if(F.col("n") > 1).alias("duplicate_instants"), F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap")
    )
    missing = F.sum(F.when(F.col(ts).isNull(), F.col("n")).otherwise(0))
    return instants.groupBy(key).agg(F.sum("n").alias("rows"), missing.alias("null_times")).join(gaps, key, "left").select(
        key, "rows", "null_times", F.coalesce("duplicate_instants", F.lit(0)).alias("duplicate_instants"), "min_gap", "max_gap"
    )


def constraint_report(tables: Mapping[str, DataFrame], constraints: Sequence[Mapping]) -> DataFrame:
    """(table, constraint, rows, violations, level), one row per declared constraint.

    ``constraints`` are dicts: table, name, type and columns, expression or parent, parent_columns.
    """
    result = None
    for c in constraints:
        df = tables[c["table"]]
        kind = c["type"]
        if kind == "primary_key":
            counts = df.groupBy(*c["columns"]).agg(F.count(F.lit(1)).alias("n"))
            bad = F.when(_any_null(c["columns"]), F.col("n")).otherwise(F.col("n") - 1)
            one = counts.agg(F.sum("n").alias("rows"), F.sum(bad).alias("violations"))
        elif kind == "foreign_key":
            counts = df.groupBy(*c["columns"]).agg(F.count(F.lit(1)).alias("n"))
            keys = (
                tables[c["parent"]].select(*[F.col(p).alias(k) for k, p in zip(c["columns"], c["parent_columns"])]).distinct()
                .withColumn("_hit", F.lit(1))
            )
            met = counts.join(keys, list(c["columns"]), "left")
            bad = F.when(F.col("_hit").isNull() & ~_any_null(c["columns"]), F.col("n")).otherwise(0)
            one = met.agg(F.sum("n").alias("rows"), F.sum(bad).alias("violations"))
        elif kind == "check":
            one = df.agg(
                F.count(F.lit(1)).alias("rows"),
                F.count_if(~F.coalesce(F.expr(c["expression"]), F.lit(True))).alias("violations"),
            )
        else:
            one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(_any_null(c["columns"])).alias("violations"))
        row = one.select(
            F.lit(c["table"]).alias("table"), F.lit(c["name"]).alias("constraint"), F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("violations", F.lit(0)).alias("violations"),
        ).withColumn("level", level(F.col("violations")))
        result = row if result is None else result.unionByName(row)
    return result


def tag_coverage(columns: DataFrame, tags: DataFrame, pii_key: str = "pii") -> DataFrame:
    """Share of columns with a comment, any tag, and a PII tag, per table and over all.

    ``columns`` is (table_id, column_id, comment), ``tags`` (column_id, key).
    """
    tagged = tags.groupBy("column_id").agg(
        F.lit(True).alias("tagged"), F.bool_or(F.col("key") == pii_key).alias("pii")
    )
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return columns.join(tagged, "column_id", "left").rollup("table_id").agg(
        F.count(F.lit(1)).alias("columns"),
        share(F.coalesce(F.col("comment"), F.lit("")) != "").alias("commented"),
        share(F.coalesce("tagged", F.lit(False))).alias("tagged"),
        share(F.coalesce("pii", F.lit(False))).alias("pii"),
    )


def schema_coverage(tables: DataFrame, columns: DataFrame, tags: DataFrame, pii_key: str = "pii") -> DataFrame:
    """Shares of tables and of columns with a comment, any tag and a PII tag, per schema and over all.

    ``tables`` is (schema_id, table_id, comment), ``columns`` (table_id, column_id, comment), ``tags``
    (object_id, key) of both. A table has a tag if it or one of its columns has. Blank comments are none;
    columns of unknown tables do not count; shares of nothing are null.
    """
    tagged = tags.groupBy("object_id").agg(F.lit(True).alias("_tagged"), F.bool_or(F.coalesce(F.col("key") == pii_key, F.lit(False))).alias("_pii"))
    noted = F.coalesce(F.trim("comment"), F.lit("")) != ""
    per_table = (
        columns.join(tagged.withColumnRenamed("object_id", "column_id"), "column_id", "left")
        .groupBy("table_id")
        .agg(
            F.count(F.lit(1)).alias("_columns"), F.count_if(noted).alias("_columns_commented"),
            F.count_if("_tagged").alias("_columns_tagged"), F.count_if("_pii").alias("_columns_pii"),
        )
    )
    rows = tables.join(tagged.withColumnRenamed("object_id", "table_id"), "table_id", "left").join(per_table, "table_id", "left")
    some = lambda own, inner: F.coalesce(F.col(own), F.lit(False)) | (F.coalesce(F.col(inner), F.lit(0)) > 0)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    part = lambda c: F.round(F.try_divide(F.sum(c).cast("double"), F.sum("_columns")), 4)
    return rows.rollup("schema_id").agg(
        F.count(F.lit(1)).alias("tables"), share(noted).alias("tables_commented"),
        share(some("_tagged", "_columns_tagged")).alias("tables_tagged"), share(some("_pii", "_columns_pii")).alias("tables_pii"),
        F.coalesce(F.sum("_columns"), F.lit(0).cast("long")).alias("columns"),
        *[part(f"_columns_{n}").alias(f"columns_{n}") for n in ("commented", "tagged", "pii")],
    )
