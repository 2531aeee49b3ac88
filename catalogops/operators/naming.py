"""Logical and physical names, locations, grants spelled out, statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.functions.names import joined_path
from catalogops.functions.privileges import legal_privileges
from catalogops.functions.sqltext import name_parts
from catalogops.functions.statements import filled, template_of
from catalogops.plans.durable import durable
from catalogops.plans.ordered import global_position
from catalogops.plans.skew import heavy_keys, skew_join


def map_catalog_names(objects: DataFrame, mapping: DataFrame) -> DataFrame:
    """(object_id, physical, error) for catalogs (object_id, environment, name). The mapping has
    one row per (environment, logical)."""
    found = objects.join(
        mapping.select("environment", F.col("logical").alias("name"), "physical"), ["environment", "name"], "left"
    )
    return found.select(
        "object_id", "physical", F.when(F.col("physical").isNull(), F.lit("UNMAPPED")).alias("error")
    )


def mapping_conflicts(mapping: DataFrame) -> DataFrame:
    """(environment, kind, name, n): a physical name with several logical ones, or the reverse."""
    pairs = mapping.select("environment", "logical", "physical").distinct()
    shared = pairs.groupBy("environment", F.col("physical").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    moved = pairs.groupBy("environment", F.col("logical").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return (
        shared.withColumn("kind", F.lit("physical_shared"))
        .unionByName(moved.withColumn("kind", F.lit("logical_remapped")))
        .where("n > 1")
        .select("environment", "kind", "name", "n")
    )


def single_mapping(mapping: DataFrame) -> DataFrame:
    """The first physical name (in name order) of each (environment, logical)."""
    return mapping.groupBy("environment", "logical").agg(F.min("physical").alias("physical"))


def resolve_locations(objects: DataFrame, locations: DataFrame) -> DataFrame:
    """(object_id, path, error) for objects that name a location; others are not external.

    ``locations`` is (location_name, environment, base_path).
    """
    known = locations.select("location_name", F.lit(True).alias("_known")).distinct()
    held = (
        objects.where("location_name IS NOT NULL AND location_name <> ''")
        .join(known, "location_name", "left")
        .join(locations, ["location_name", "environment"], "left")
    )
    error = (
        F.when(F.col("_known").isNull(), "LOCATION_NOT_FOUND")
        .when(F.col("environment").isNull(), "ENVIRONMENT_NOT_PROVIDED")
        .when(F.col("base_path").isNull(), "NO_PATH_FOR_ENVIRONMENT")
    )
    return held.select(
        "object_id", F.when(error.isNull(), joined_path(F.col("base_path"), F.col("path"))).alias("path"), error.alias("error")
    )


def qualified_names(objects: DataFrame, levels: Sequence[Sequence[str]] = (("catalog",), ("schema",), ("table", "view", "volume", "function", "materialized_view"), ("column",))) -> DataFrame:
    """(object_type, object_id, full_name) by joining each level to the one above; one container
    may hold most of the objects."""
    result = above = None
    heavy = durable(heavy_keys(objects, ["parent_id"]), "heavy")
    for kinds in levels:
        here = objects.where(F.col("object_type").isin(list(kinds)))
        if above is None:
            named = here.select("object_type", "object_id", F.col("name").alias("full_name"))
        else:
            named = skew_join(
                here, above.select(F.col("object_id").alias("parent_id"), F.col("full_name").alias("_up")), ["parent_id"], heavy=heavy
            ).select("object_type", "object_id", F.concat_ws(".", "_up", "name").alias("full_name"))
        result = named if result is None else result.unionByName(named)
        above = named
    return result


def split_privileges(raw: Column) -> Column:
    """A comma list as typed: trimmed, blanks removed, inner spaces kept."""
    return F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != "")


def illegal_privileges(grants: DataFrame) -> DataFrame:
    """Rows (object_type, target_id, principal, privilege) not legal for the kind of object."""
    return grants.join(legal_privileges(grants.sparkSession), ["object_type", "privilege"], "left_anti")


def import_scope_filter(
    objects: DataFrame, catalog: str | None = None, schema: str | None = None, table: str | None = None
) -> DataFrame:
    """Objects to import: never system-managed ones, and only those in the given scope.

    ``objects`` is (catalog_name, schema_name, table_name, ...).
    """
    if (catalog or "").strip().lower() == "system" or (schema or "").strip().lower() == "information_schema":
        raise ValueError("system-managed objects cannot be imported")
    kept = objects.where(
        (F.lower(F.trim("catalog_name")) != "system") & (F.lower(F.trim("schema_name")) != "information_schema")
    )
    for column, wanted in (("catalog_name", catalog), ("schema_name", schema), ("table_name", table)):
        if wanted is not None:
            kept = kept.where(F.lower(F.trim(column)) == wanted.strip().lower())
    return kept


def render_statements(ops: DataFrame, names: DataFrame) -> DataFrame:
    """(execution_order, op_id, statement, error): one SQL line for each op of any of the kinds, in order.

    ``ops`` is (seq, op_id, op, target, payload MAP<STRING, STRING>), ``names`` (target, full_name). No op
    is lost: one that cannot be written has a null statement and says why, UNKNOWN_KIND, UNKNOWN_NAME or
    MISSING_FIELD. An export for people to read or run elsewhere.
    """
    held = skew_join(ops.select("seq", "op_id", "op", "target", "payload"), names.select("target", "full_name"), ["target"], "left")
    template = template_of(F.col("op"))
    lines = held.withColumn("statement", filled(template, name_parts(F.col("full_name")), F.col("payload")))
    error = (
        F.when(template.isNull(), "UNKNOWN_KIND").when(F.col("full_name").isNull(), "UNKNOWN_NAME").when(F.col("statement").isNull(), "MISSING_FIELD")
    )
    lines = lines.select("seq", "op_id", "statement", error.alias("error"))
    return global_position(lines, ["seq"], "execution_order").select("execution_order", "op_id", "statement", "error")
