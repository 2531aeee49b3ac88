"""Inventories from metadata tables: keys, checks, tags, ids, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.plans.durable import durable


def adopt_ids(discovered: DataFrame, local: DataFrame, path: Sequence[str], made: Column) -> DataFrame:
    """Add ``object_id`` and ``source``: the local id where the name path matches, else ``made``.

    ``local`` is (id, path columns); the least id wins where a path repeats.
    """
    known = local.groupBy(*path).agg(F.min("id").alias("_local"))
    return (
        discovered.join(known, list(path), "left")
        .withColumns(
            {
                "object_id": F.coalesce("_local", made),
                "source": F.when(F.col("_local").isNotNull(), "local").otherwise("stable"),
            }
        )
        .drop("_local")
    )


# Where a constraint lives: names repeat between tables, schemas and catalogs.
PLACE = ["catalog_name", "schema_name", "table_name", "constraint_name"]


def assemble_keys(constraints: DataFrame, key_columns: DataFrame, referential: DataFrame) -> DataFrame:
    """Primary and foreign keys (catalog_name, schema_name, table_name, constraint_name, type, columns,
    parent_catalog, parent_schema, parent_table, parent_columns) from an information schema's tables.

    Rows meet by whole place, so a name used in two tables, schemas or catalogs never doubles a key.
    ``key_columns`` has ordinal_position and, for foreign keys, position_in_unique_constraint: the parent
    column of each column is the one at that place of the key referred to (its own place, where null).
    ``referential`` is (place, unique_catalog, unique_schema, unique_table, unique_constraint_name); with
    a null table the key of that name in the schema is meant, the least table's if several have it.
    """
    cols = durable(
        key_columns.groupBy(*PLACE, "ordinal_position").agg(
            F.min(F.struct("column_name", "position_in_unique_constraint")).alias("c")
        ).select(*PLACE, "ordinal_position", "c.*"),
        "keys",
    )
    key = F.struct(*[F.col(c) for c in PLACE])
    parents = cols.where("position_in_unique_constraint IS NULL").select(key.alias("_p"), F.col("ordinal_position").alias("_at"), F.col("column_name").alias("_parent"))
    named = parents.groupBy(
        F.col("_p.catalog_name").alias("unique_catalog"), F.col("_p.schema_name").alias("unique_schema"), F.col("_p.constraint_name").alias("unique_constraint_name")
    ).agg(F.min("_p.table_name").alias("_least"))
    refers = (
        referential.join(named, ["unique_catalog", "unique_schema", "unique_constraint_name"], "left")
        .withColumn("unique_table", F.coalesce("unique_table", "_least"))
        .groupBy(*PLACE)
        .agg(F.min(F.struct("unique_catalog", "unique_schema", "unique_table", "unique_constraint_name")).alias("u"))
        .select(*PLACE, F.when(F.col("u.unique_table").isNotNull(), F.struct(
            F.col("u.unique_catalog").alias("catalog_name"), F.col("u.unique_schema").alias("schema_name"),
            F.col("u.unique_table").alias("table_name"), F.col("u.unique_constraint_name").alias("constraint_name"))).alias("_p"))
    )
    both = (
        cols.join(refers, PLACE, "left")
        .withColumn("_at", F.coalesce("position_in_unique_constraint", "ordinal_position"))
        .join(parents, ["_p", "_at"], "left")
    )
    # A key has few columns.
    held = both.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "_parent"))).alias("_k"))

    def listed(field):
        return F.coalesce(F.array_join(F.transform("_k", lambda k: k[field]), ","), F.lit(""))

    return (
        constraints.where(F.upper("constraint_type").isin("PRIMARY KEY", "FOREIGN KEY")).select(*PLACE, F.upper("constraint_type").alias("type")).distinct()
        .join(held, PLACE, "left").join(refers, PLACE, "left")
        .select(
            *PLACE, "type", listed("column_name").alias("columns"), F.col("_p.catalog_name").alias("parent_catalog"),
            F.col("_p.schema_name").alias("parent_schema"), F.col("_p.table_name").alias("parent_table"), listed("_parent").alias("parent_columns"),
        )
    )


def assemble_checks(constraints: DataFrame, clauses: DataFrame, properties: DataFrame) -> DataFrame:
    """CHECK constraints (catalog_name, schema_name, table_name, constraint_name, type, expression),
    from the constraint tables and from ``delta.constraints.*`` properties not already named.

    A clause has no table, so a name that several tables of a schema use gives each its clause.
    """
    schema = [c for c in PLACE if c != "table_name"]
    declared = (
        constraints.where(F.upper("constraint_type") == "CHECK").select(*PLACE).distinct()
        .join(clauses.where("check_clause <> ''").groupBy(*schema).agg(F.min("check_clause").alias("expression")), schema)
        .select(*PLACE, "expression")
    )
    prefix = "delta.constraints."
    from_properties = properties.where(F.col("key").startswith(prefix)).select(
        "catalog_name", "schema_name", "table_name", F.substr(F.col("key"), F.lit(len(prefix) + 1)).alias("constraint_name"), F.col("value").alias("expression")
    )
    extra = from_properties.where("constraint_name <> ''").join(declared.select(*PLACE), PLACE, "left_anti")
    return declared.unionByName(extra).withColumn("type", F.lit("CHECK")).select(*PLACE, "type", "expression")


def pivot_tags(tags: DataFrame) -> DataFrame:
    """One value per (object_type, object_id, key), the last row winning; a null value is ''."""
    return tags.groupBy("object_type", "object_id", "key").agg(
        F.coalesce(F.max(F.struct("seq", "value"))["value"], F.lit("")).alias("value")
    )


# Declared kinds of discovered objects, and the table formats that import.
VIEW_KINDS = ["VIEW"]
MV_KINDS = ["MATERIALIZED VIEW", "MATERIALIZED_VIEW"]
SKIPPED_KINDS = ["STREAMING TABLE", "STREAMING_TABLE"]
FORMATS = ["delta", "iceberg"]


def classify_objects(found: DataFrame) -> DataFrame:
    """Add ``kind`` (table, view, materialized_view, skipped), ``external`` and ``warning``."""
    declared = F.upper(F.coalesce("table_type", F.lit("BASE TABLE")))
    good_format = F.lower("data_source_format").isin(FORMATS)
    kind = (
        F.when(declared.isin(SKIPPED_KINDS), "skipped")
        .when(declared.isin(MV_KINDS), "materialized_view")
        .when(declared.isin(VIEW_KINDS), "view")
        .when(good_format, "table")
        .otherwise("skipped")
    )
    path = F.concat_ws(".", "catalog_name", "schema_name", "table_name")
    warning = F.when(
        declared.isin(SKIPPED_KINDS), F.concat(F.lit("unsupported kind: "), path, F.lit(" ("), declared, F.lit(")"))
    ).when(kind == "skipped", F.concat(F.lit("unsupported format: "), path, F.lit(" ("), F.lower("data_source_format"), F.lit(")")))
    external = F.when(kind == "table", F.when(declared == "EXTERNAL", True).when(declared.isin("MANAGED", "BASE TABLE", "BASE_TABLE"), False))
    return found.withColumns({"kind": kind, "external": external, "warning": warning})


def stable_ids(found: DataFrame, prefix: Column, parts: Sequence[str]) -> DataFrame:
    from catalogops.functions.names import stable_id

    return found.withColumn("object_id", stable_id(prefix, *[F.col(p) for p in parts]))


def logical_names(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """(physical, environment, logical, error): the logical name of each discovered catalog.

    A physical name without a mapping is its own logical name; one with several is a conflict.
    """
    reverse = mapping.groupBy("environment", "physical").agg(
        F.min("logical").alias("logical"), F.count_distinct("logical").alias("_n")
    )
    return found.join(reverse, ["environment", "physical"], "left").select(
        "physical", "environment",
        F.when(F.col("_n") > 1, F.lit(None)).otherwise(F.coalesce("logical", "physical")).alias("logical"),
        F.when(F.col("_n") > 1, F.lit("CONFLICT")).alias("error"),
    )


def count_objects(paths: DataFrame) -> DataFrame:
    """(catalog, schema, object_type, n) with totals per catalog and over all.

    ``paths`` is (catalog, schema, object_type), one row per object.
    """
    return (
        paths.groupBy("catalog", "schema", "object_type").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_levels", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            F.when(F.col("_levels") >= 1, F.col("catalog")).alias("catalog"),
            F.when(F.col("_levels") >= 2, F.col("schema")).alias("schema"), "object_type", "n", "_levels",
        )
        .groupBy("catalog", "schema", "object_type", "_levels")
        .agg(F.sum("n").alias("n"))
        .drop("_levels")
    )


def objects_in_scope(objects: DataFrame, scopes: DataFrame, levels) -> DataFrame:
    """(scope_id, object_type, object_id): each scope object and all below it."""
    from catalogops.plans.durable import durable
    from catalogops.plans.skew import heavy_keys, skew_join

    heavy = durable(heavy_keys(objects, ["parent_id"]), "heavy")
    found = durable(
        objects.join(scopes.select("scope_id"), F.col("object_id") == F.col("scope_id")).select("scope_id", "object_type", "object_id"),
        "scope",
    )
    result = found
    for kinds in levels:
        here = objects.where(F.col("object_type").isin(list(kinds))).select("object_type", "object_id", "parent_id")
        below = skew_join(
            here, result.select("scope_id", F.col("object_id").alias("parent_id")), ["parent_id"], heavy=heavy
        ).select("scope_id", "object_type", "object_id")
        result = durable(result.unionByName(below), "scope")
    return result


def bulk_ops(scope: DataFrame, kind: str, op: str, listed: Sequence[str]) -> DataFrame:
    """One op per in-scope object of the kind and entry of a short given list (principals or tags)."""
    return scope.where(F.col("object_type") == kind).select(
        "scope_id", "object_type", "object_id", F.lit(op).alias("op"), F.explode(F.array(*[F.lit(x) for x in listed])).alias("entry")
    )


def validate_state(objects: DataFrame, columns: DataFrame) -> DataFrame:
    """(code, object_id, detail): objects without id or name, repeated column names in a table."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    broken = objects.where(F.col("object_type").isin("catalog", "schema") & (blank("object_id") | blank("name"))).select(
        F.concat(F.lit("INVALID_"), F.upper("object_type")).alias("code"), "object_id", F.col("name").alias("detail")
    )
    repeated = (
        columns.where(~blank("name")).groupBy("table_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.lit("DUPLICATE_COLUMN_NAME").alias("code"), F.col("table_id").alias("object_id"), F.col("name").alias("detail"))
    )
    return broken.unionByName(repeated)


def dedupe_warnings(warnings: DataFrame) -> DataFrame:
    """(message, first_seq): distinct messages in the order they first came."""
    return warnings.groupBy("message").agg(F.min("seq").alias("first_seq")).orderBy("first_seq")


def profile_columns(name: str, df: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(column, observed_type, rows, nulls, distinct_about, min, max[, declared_type, declared_nullable])
    in one pass over the table."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    rows = []
    for field in df.schema.fields:
        c = field.name
        aggs += [
            F.count(c).alias(f"n_{c}"), F.approx_count_distinct(c).alias(f"d_{c}"),
            F.min(c).cast("string").alias(f"lo_{c}"), F.max(c).cast("string").alias(f"hi_{c}"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(field.dataType.simpleString()).alias("observed_type"),
                F.col("_rows").alias("rows"), (F.col("_rows") - F.col(f"n_{c}")).alias("nulls"), F.col(f"d_{c}").alias("distinct_about"),
                F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"),
            )
        )
    profile = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if declared is None:
        return profile
    return profile.join(declared, ["table", "column"], "left")


# Base types a table can hold here, and those carried as another type.
TYPES = """
TINYINT SMALLINT INT BIGINT FLOAT DOUBLE DECIMAL STRING BINARY BOOLEAN DATE TIMESTAMP TIMESTAMP_NTZ
INTERVAL ARRAY MAP STRUCT VARIANT
""".split()
CARRIED = {"GEOGRAPHY": "STRING", "GEOMETRY": "STRING", "OBJECT": "VARIANT"}


def type_inventory(columns: DataFrame) -> DataFrame:
    """(base_type, n, supported) over declared column types."""
    base = F.upper(F.regexp_extract(F.trim("type"), r"^\w+", 0))
    return columns.groupBy(base.alias("base_type")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "supported", F.col("base_type").isin(TYPES)
    )
