"""Checks and selections over change logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.functions.opkinds import category_of, required_of
from catalogops.plans.skew import skew_join


def op_errors(log: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per problem (op_id, field, code). A required field must be present, non-null
    and non-empty; an unknown kind is one problem and is not looked into further."""
    held = log.withColumns(
        {"_need": required_of(F.col("op")), "_p": F.from_json(payload, "MAP<STRING,STRING>")}
    )
    missing = F.filter("_need", lambda f: F.coalesce(F.col("_p")[f], F.lit("")) == "")
    problems = F.when(
        F.col("_need").isNull(),
        F.array(F.struct(F.lit("op").alias("field"), F.lit("UNSUPPORTED_OPERATION").alias("code"))),
    ).otherwise(
        F.transform(
            missing,
            lambda f: F.struct(
                F.concat(F.lit("payload."), f).alias("field"), F.lit("MISSING_REQUIRED_FIELD").alias("code")
            ),
        )
    )
    return held.select("op_id", F.explode(problems).alias("_e")).select("op_id", "_e.field", "_e.code")


def is_valid(payload: str = "payload"):
    """Column: the op is of a known kind and has every required field. No join, no shuffle."""
    fields = F.from_json(payload, "MAP<STRING,STRING>")
    return F.coalesce(
        F.forall(required_of(F.col("op")), lambda f: F.coalesce(fields[f], F.lit("")) != ""), F.lit(False)
    )


def _managed(managed: Sequence[str], existing_catalogs: Sequence[str | None], name: str) -> Column:
    category = category_of(F.col("op"))
    kept = category.isNull() | category.isin(list(managed)) if managed else F.lit(True)
    there = [c.strip() for c in existing_catalogs if c and c.strip()]
    if there:
        kept = kept & ~(F.col("op").endswith("add_catalog") & F.coalesce(F.trim(F.col(name)).isin(there), F.lit(False)))
    return kept


def filter_managed_scope(
    log: DataFrame, managed: Sequence[str] | None, existing_catalogs: Sequence[str | None] = (), name: str = "name"
) -> DataFrame:
    """Ops an environment manages: all when ``managed`` is empty, unknown kinds always; without
    the creation of catalogs that already exist there."""
    return log.where(_managed(managed or [], existing_catalogs, name))


def managed_by_environment(log: DataFrame, managed: DataFrame, environments: Sequence[str]) -> DataFrame:
    """``filter_managed_scope`` for several environments in one pass: op rows with ``environment``."""
    listed = {e: [] for e in environments}
    # Categories are a fixed list, so the configuration has few rows per environment.
    for row in managed.where(F.col("environment").isin(list(environments))).distinct().collect():
        listed[row.environment].append(row.managed_category)
    keeping = F.array(*[F.when(_managed(cats, (), "op"), F.lit(e)) for e, cats in listed.items()])
    return log.withColumn("environment", F.explode(F.array_compact(keeping)))


def undo_ops(log: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining ops, summary) after removing ops by id; ids are trimmed and de-duplicated."""
    wanted = ids.select(F.trim(F.col("op_id").cast("string")).alias("_id")).where("_id <> ''").distinct()
    keyed = log.withColumn("_id", F.col("op_id").cast("string"))
    remaining = keyed.join(wanted, "_id", "left_anti").drop("_id")
    flagged = wanted.join(keyed.select("_id", F.lit(1).alias("_hit")).distinct(), "_id", "left")
    counted = flagged.select(
        F.coalesce("_hit", F.lit(0)).alias("removed"), F.when(F.col("_hit").isNull(), 1).otherwise(0).alias("missing"), F.lit(0).alias("left")
    ).unionByName(remaining.select(F.lit(0).alias("removed"), F.lit(0).alias("missing"), F.lit(1).alias("left")))
    return remaining, counted.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("removed", "removed_count"), ("missing", "missing_count"), ("left", "remaining_count"))]
    )


def normalize_op_ids(log: DataFrame, index: str) -> DataFrame:
    made = F.concat_ws("_", F.lit("op"), F.col(index).cast("string"), F.col("ts").cast("string"), F.col("target").cast("string"))
    return log.withColumn("op_id", F.coalesce(F.col("op_id").cast("string"), made))


def op_signature(log: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``signature``: kind, target and the payload as JSON with its keys in order at every depth.

    Each part stands behind its length, and a null behind none, so no two ops that differ in a part
    are alike. A payload that is no JSON counts as it is written.
    """
    # A variant holds the keys of an object in order.
    canonical = F.coalesce(F.concat(F.lit("j"), F.to_json(F.try_parse_json(payload))), F.concat(F.lit("t"), F.col(payload)))
    part = lambda value: F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("null"))
    parts = [part(F.col("op")), part(F.col("target").cast("string")), part(canonical)]
    return log.withColumn("signature", F.sha2(F.concat_ws("|", *parts), 256))


def without(log: DataFrame, keys: Sequence[str], dropped: DataFrame) -> DataFrame:
    """Ops whose key is not in ``dropped`` (one row per key); the log may be hot on the key."""
    return skew_join(log, dropped, keys, "left_anti")
