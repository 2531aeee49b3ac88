"""Deployment history and rollback analysis.

An environment may hold a third of all deployments and a deployment a third of all op rows, so
everything is an aggregate that combines before the shuffle, or a bucketed ordered lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.functions.versions import parsed
from catalogops.plans.durable import durable
from catalogops.plans.ordered import BITS, last_before, rank_within, running_sum
from catalogops.plans.skew import skew_join


def most_recent(deployments: DataFrame) -> DataFrame:
    """Newest deployment of any status per environment (environment, id, version)."""
    return deployments.groupBy("environment").agg(
        F.max(F.struct("deployed_at", "id", "snapshot_version")).alias("l")
    ).select("environment", "l.id", F.col("l.snapshot_version").alias("version"))


def latest_success(deployments: DataFrame) -> DataFrame:
    return most_recent(deployments.where("status = 'success'"))


def previous_deployment(deployments: DataFrame, *, bits: int = BITS) -> DataFrame:
    """(id, previous_id): the newest deployment strictly earlier in the same environment.

    Deployments of one instant are first reduced to one row, so ties are skipped and the order
    value is unique.
    """
    instants = durable(
        deployments.groupBy("environment", "deployed_at").agg(F.max("id").alias("last_id"))
        .withColumn("at", F.unix_micros(F.col("deployed_at").cast("timestamp"))),
        "instants",
    )
    before = last_before(instants, ["environment"], "at", F.col("last_id"), "previous_id", bits=bits, levels=2)
    return skew_join(
        deployments.select("environment", "deployed_at", "id"),
        before.select("environment", "deployed_at", "previous_id"),
        ["environment", "deployed_at"],
    ).select("id", "previous_id")


def deployment_record(deployments: DataFrame, ops: DataFrame) -> DataFrame:
    """(id, ops, successful, failed_index): counts and the 0-based place of the first failure.

    Deployments without ops have 0 of them."""
    counted = ops.groupBy("deployment_id").agg(
        F.count(F.lit(1)).alias("ops"),
        F.count_if(F.col("status") == "success").alias("successful"),
        (F.min(F.when(F.col("status") == "failed", F.col("execution_order"))) - 1).cast("long").alias("failed_index"),
    )
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return deployments.select("id").join(counted.withColumnRenamed("deployment_id", "id"), "id", "left").select(
        "id", none("ops"), none("successful"), "failed_index"
    )


def record_steps(ops: DataFrame, *, bits: int = BITS) -> DataFrame:
    """(deployment_id, position, op_type, op_target, status): ops in order, places from 0."""
    placed = rank_within(ops, ["deployment_id"], "execution_order", "_r", bits=bits)
    return placed.select("deployment_id", (F.col("_r") - 1).alias("position"), "op_type", "op_target", "status")


def deployment_status(ops: DataFrame) -> DataFrame:
    """(id, ops, successful, failed_index, status) when execution stops at the first failure."""
    counted = ops.groupBy("deployment_id").agg(
        F.count(F.lit(1)).alias("ops"),
        (F.min(F.when(F.col("status") == "failed", F.col("execution_order"))) - 1).cast("long").alias("failed_index"),
    )
    return counted.select(
        F.col("deployment_id").alias("id"), "ops",
        F.coalesce("failed_index", "ops").alias("successful"), "failed_index",
        F.when(F.col("failed_index").isNull(), "success").when(F.col("failed_index") == 0, "failed").otherwise("partial").alias("status"),
    )


def cut_after_failure(ops: DataFrame) -> DataFrame:
    """Op rows with ``ran``: success, failed (the first failure) or skipped (all after it)."""
    first = ops.where("status = 'failed'").groupBy("deployment_id").agg(F.min("execution_order").alias("_first"))
    return skew_join(ops, first, ["deployment_id"], "left").withColumn(
        "ran",
        F.when(F.col("_first").isNull() | (F.col("execution_order") < F.col("_first")), "success")
        .when(F.col("execution_order") == F.col("_first"), "failed")
        .otherwise("skipped"),
    ).drop("_first")


def ops_before_failure(statements: DataFrame) -> DataFrame:
    """(deployment_id, op_id) of statements before the failed one, without ops it also carries.

    ``statements`` is (deployment_id, execution_order, status, op_ids ARRAY).
    """
    failed = statements.where("status = 'failed'").groupBy("deployment_id").agg(
        F.min(F.struct("execution_order", "op_ids")).alias("_f")
    )
    before = skew_join(statements, failed, ["deployment_id"]).where("execution_order < _f.execution_order")
    return (
        before.select("deployment_id", F.explode("op_ids").alias("op_id"), F.col("_f.op_ids").alias("_also"))
        .where(~F.array_contains("_also", F.col("op_id")))
        .select("deployment_id", "op_id")
        .distinct()
    )


def match_ops(recorded: DataFrame, regenerated: DataFrame, *, bits: int = BITS) -> DataFrame:
    """(recorded_id, regenerated_id) paired by signature, each regenerated op used once.

    Both are (signature, id). The n-th of a signature meets the n-th; a signature may be hot, so
    places come from bucketed ranks.
    """
    left = rank_within(recorded, ["signature"], "id", "n", bits=bits).withColumnRenamed("id", "recorded_id")
    right = rank_within(regenerated, ["signature"], "id", "n", bits=bits).withColumnRenamed("id", "regenerated_id")
    return left.join(right, ["signature", "n"]).select("recorded_id", "regenerated_id")


def pre_deployment_ops(deployments: DataFrame, ops: DataFrame, target_id: int) -> DataFrame:
    """Successful ops, in order, of the deployment before ``target_id`` in its environment."""
    before = previous_deployment(deployments).where(F.col("id") == target_id)
    return ops.where("status = 'success'").join(
        before.select(F.col("previous_id").alias("deployment_id")), "deployment_id", "left_semi"
    )


def rollback_safety(assessed: DataFrame) -> DataFrame:
    """(level, n, data_at_risk) over assessed ops."""
    return assessed.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("data_at_risk"), F.lit(0)).alias("data_at_risk")
    )


def safe_only(assessed: DataFrame) -> DataFrame:
    return assessed.where("level = 'SAFE'")


def baseline_guard(targets: DataFrame, baselines: DataFrame) -> DataFrame:
    """Targets (environment, version, ...) older than their environment's import baseline.

    Versions that do not parse are let through, as are environments without a baseline.
    """
    base = baselines.select("environment", F.col("version").alias("baseline"))
    return skew_join(targets, base, ["environment"]).where(
        parsed(F.col("version")) < parsed(F.col("baseline"))
    )


def already_at(deployments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Environments (environment, id, version) whose latest success is at the wanted version."""
    return latest_success(deployments).join(wanted.select("environment", "version"), ["environment", "version"], "left_semi")


def cascade_drops(drops: DataFrame, objects: DataFrame, levels) -> DataFrame:
    """(dropped_id, object_type, n): what is lost below each dropped container, by kind."""
    reached = drops.select(F.col("object_id").alias("dropped_id"), "object_id")
    result = None
    for kinds in levels:
        under = objects.where(F.col("object_type").isin(list(kinds)))
        below = skew_join(
            under.select("object_id", "object_type", "parent_id"),
            reached.select("dropped_id", F.col("object_id").alias("parent_id")),
            ["parent_id"],
        )
        found = durable(below.select("dropped_id", "object_id", "object_type"), "lost")
        counts = found.groupBy("dropped_id", "object_type").agg(F.count(F.lit(1)).alias("n"))
        result = counts if result is None else result.unionByName(counts)
        reached = reached.unionByName(found.select("dropped_id", "object_id"))
    return result.groupBy("dropped_id", "object_type").agg(F.sum("n").alias("n"))


def deployment_stats(deployments: DataFrame, period: Column, ops: DataFrame | None = None) -> DataFrame:
    """Counts and times per environment and period, with totals by environment and over all; with ``ops``
    (deployment_id, status) also how many ops there were and how many of them failed.

    The 95th percentile is exact: values are counted first, and the counts of each group are summed
    up in order of the value, in stretches, to the place asked for. Null times are left out of it.
    """
    rows = deployments.withColumn("period", period)
    sums = []
    if ops is not None:
        per = ops.groupBy(F.col("deployment_id").alias("id")).agg(
            F.count(F.lit(1)).alias("_ops"), F.count_if(F.col("status") == "failed").alias("_failed")
        )
        rows = skew_join(rows, per, ["id"], "left")
        sums = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(n) for c, n in (("_ops", "ops"), ("_failed", "ops_failed"))]
    counted = rows.rollup("environment", "period").agg(
        F.grouping_id().alias("_level"),
        F.count(F.lit(1)).alias("deployments"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "partial").alias("partial"),
        F.round(F.avg("execution_time_ms"), 4).alias("mean_ms"),
        *sums,
    )
    key = lambda level: F.to_json(F.struct(level.alias("l"), F.col("environment"), F.col("period")), {"ignoreNullFields": "false"})
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType)
    times = rows.where("execution_time_ms IS NOT NULL").groupBy("environment", "period", "execution_time_ms").agg(F.count(F.lit(1)).alias("_n"))
    levels = [
        times.select(key(F.lit(0)).alias("_key"), "execution_time_ms", "_n"),
        times.withColumn("period", none("period")).select(key(F.lit(1)).alias("_key"), "execution_time_ms", "_n"),
        times.withColumns({"environment": none("environment"), "period": none("period")}).select(key(F.lit(3)).alias("_key"), "execution_time_ms", "_n"),
    ]
    values = levels[0].union(levels[1]).union(levels[2]).groupBy("_key", "execution_time_ms").agg(F.sum("_n").alias("_n"))
    summed = durable(running_sum(values, ["_key"], "execution_time_ms", "_n", "_upto"), "times")
    total = summed.groupBy("_key").agg(F.sum("_n").alias("_all"))
    place = F.ceil(F.col("_all").cast("decimal(38,0)") * F.lit("0.95").cast("decimal(3,2)"))
    found = summed.join(total, "_key").where(F.col("_upto") >= place).groupBy("_key").agg(F.min("execution_time_ms").alias("p95_ms"))
    return counted.withColumn("_key", key(F.col("_level").cast("int"))).join(found, "_key", "left").drop("_key", "_level")
