"""Views, stored results and functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.operators.graph import extract_table_refs, newest_upstream, topo_depth


def register_views(spark: SparkSession, defs: Mapping[str, str]) -> list[str]:
    """Create temp views from name -> SQL, those they read first; gives the order used.

    Each view is one statement of the session, so their names are a short list.
    """
    rows = spark.createDataFrame(list(defs.items()), "view_id STRING, definition STRING")
    refs = extract_table_refs(rows)
    nodes = rows.select(F.col("view_id").alias("node_id"))
    edges = refs.select(F.col("ref").alias("from_id"), F.col("view_id").alias("to_id")).join(
        nodes.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi"
    )
    depths = topo_depth(nodes, edges).orderBy("depth", "node_id").collect()
    cyclic = [r.node_id for r in depths if r.depth is None]
    if cyclic:
        raise ValueError("views read each other in a circle: " + ", ".join(sorted(cyclic)))
    for row in depths:
        spark.sql(defs[row.node_id]).createOrReplaceTempView(row.node_id)
    return [r.node_id for r in depths]


def orders_enriched(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their customer's name and country."""
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey", "o_custkey", "c_name", "c_nationkey", "o_orderdate", "o_totalprice", "o_orderstatus"
    )


def orders_by_country(orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Order count and amount per country; orders are summed per customer before they meet it."""
    per_customer = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("amount"))
    per_nation = (
        per_customer.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum("n").alias("order_count"), F.sum("amount").alias("amount"))
    )
    return per_nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country"), "order_count", F.round("amount", 2).alias("total_amount")
    )


def _committed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("version LONG, mark LONG").parquet(f"{target}/committed")


def refresh_mv(result: DataFrame, target: str, version: int, mark: int | None = None) -> DataFrame:
    """Write a full result as a new version, then commit it in one small append.

    Readers (``current_mv``) see the old version until the commit is there. ``mark`` is the last
    log position the result covers.
    """
    spark = result.sparkSession
    result.write.mode("overwrite").parquet(f"{target}/v{version}")
    row = spark.createDataFrame([(version, mark)], "version LONG, mark LONG")
    row.coalesce(1).write.mode("append").parquet(f"{target}/committed")
    return current_mv(spark, target, result.schema)


def current_mv(spark: SparkSession, target: str, schema) -> DataFrame:
    version = _committed(spark, target).agg(F.max("version")).first()[0]
    return spark.read.schema(schema).parquet(f"{target}/v{version}")


def refresh_mv_incremental(
    source: DataFrame, order: str, target: str, keys: Sequence[str], partial: Mapping[str, Column], merge: Mapping[str, Column]
) -> DataFrame:
    """Bring a stored aggregate up to date reading only rows beyond its mark.

    ``partial`` aggregates new rows, ``merge`` combines stored and new partial results.
    """
    spark = source.sparkSession
    last = _committed(spark, target).agg(F.max(F.struct("version", "mark")).alias("l")).first().l
    end = source.where(F.col(order) > last.mark).agg(F.max(order)).first()[0]
    # Rows that come in between the two reads are beyond the mark that is committed, so they wait for the next.
    fresh = source.where((F.col(order) > last.mark) & (F.col(order) <= F.lit(end)))
    news = fresh.groupBy(*keys).agg(*[c.alias(n) for n, c in partial.items()])
    stored = current_mv(spark, target, news.schema)
    if end is None:
        return stored
    merged = stored.unionByName(news).groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
    return refresh_mv(merged, target, last.version + 1, end)


def mv_due(mvs: DataFrame, edges: DataFrame, changes: DataFrame, now) -> DataFrame:
    """(mv_id, due, reason) for stored views (mv_id, last_refresh, every_seconds).

    Due when the schedule has run out, or when anything they are built on, over any number of
    steps, changed since. ``changes`` is (node_id, changed_at).
    """
    newest = newest_upstream(edges, changes).withColumnRenamed("node_id", "mv_id")
    late = F.col("every_seconds").isNotNull() & (
        F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_refresh") >= F.col("every_seconds") * 1_000_000
    )
    reason = F.when(late, "schedule").when(F.col("newest") > F.col("last_refresh"), "upstream")
    return mvs.join(newest, "mv_id", "left").select("mv_id", reason.isNotNull().alias("due"), reason.alias("reason"))


def register_sql_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A scalar SQL function: inlined into the plan, so it stays in generated code."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def register_table_function(spark: SparkSession, name: str, parameters: str, columns: str, query: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")


def register_python_function(spark: SparkSession, name: str, function, returns: str):
    """A Python function over Arrow batches: ``function`` takes and gives pandas Series."""
    batched = F.pandas_udf(function, returns)
    spark.udf.register(name, batched)
    return batched


def bmi(weight_kg: pd.Series, height_m: pd.Series) -> pd.Series:
    return weight_kg / (height_m * height_m)
