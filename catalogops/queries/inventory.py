"""Metadata inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.operators import inventory, naming
from catalogops.plans.fixtures import fixture, table
from catalogops.queries.diff import LEVELS
from catalogops.queries.registry import query
from catalogops.queries.selection import NAMES_SQL


_PLACE_SQL = "catalog_name, schema_name, table_name, constraint_name"


@query(
    "I01_assemble_keys",
    f"""WITH k AS (SELECT * FROM [fxc_key_columns]), least AS (SELECT catalog_name, schema_name, constraint_name, min(table_name) AS t FROM k WHERE constraint_name = 'pk' GROUP BY 1, 2, 3),
    r AS (SELECT x.*, coalesce(unique_table, t) AS parent FROM ([fxc_referential]) x LEFT JOIN least l ON l.catalog_name = unique_catalog AND l.schema_name = unique_schema AND l.constraint_name = unique_constraint_name),
    j AS (SELECT tc.*, k.column_name, k.ordinal_position AS o, CASE WHEN parent IS NOT NULL THEN unique_catalog END AS parent_catalog, CASE WHEN parent IS NOT NULL THEN unique_schema END AS parent_schema, r.parent AS parent_table, p.column_name AS parent_column
      FROM ([fxc_table_constraints]) tc LEFT JOIN k USING ({_PLACE_SQL}) LEFT JOIN r USING ({_PLACE_SQL})
      LEFT JOIN k p ON p.catalog_name = unique_catalog AND p.schema_name = unique_schema AND p.table_name = parent AND p.constraint_name = unique_constraint_name AND p.ordinal_position = k.position_in_unique_constraint
      WHERE constraint_type <> 'CHECK')
    SELECT {_PLACE_SQL}, upper(constraint_type) AS type, coalesce(string_agg(column_name, ',' ORDER BY o), '') AS columns, parent_catalog, parent_schema, parent_table, coalesce(string_agg(parent_column, ',' ORDER BY o), '') AS parent_columns
    FROM j GROUP BY ALL""",
)
def assemble_keys(spark, sf_dir):
    return inventory.assemble_keys(
        fixture(spark, sf_dir, "fxc_table_constraints"), fixture(spark, sf_dir, "fxc_key_columns"), fixture(spark, sf_dir, "fxc_referential")
    )


@query(
    "I02_assemble_checks",
    f"""WITH c AS (SELECT {_PLACE_SQL}, check_clause AS expression FROM [fxc_table_constraints] JOIN [fxc_check_clauses] USING (catalog_name, schema_name, constraint_name) WHERE constraint_type = 'CHECK' AND check_clause <> ''),
    p AS (SELECT catalog_name, schema_name, table_name, substr(key, 19) AS constraint_name, value AS expression FROM [fxc_properties] WHERE key LIKE 'delta.constraints.%')
    SELECT {_PLACE_SQL}, 'CHECK' AS type, expression FROM c
    UNION ALL SELECT {_PLACE_SQL}, 'CHECK', expression FROM p WHERE constraint_name <> '' AND ({_PLACE_SQL}) NOT IN (SELECT ({_PLACE_SQL}) FROM c)""",
)
def assemble_checks(spark, sf_dir):
    return inventory.assemble_checks(
        fixture(spark, sf_dir, "fxc_table_constraints"), fixture(spark, sf_dir, "fxc_check_clauses"), fixture(spark, sf_dir, "fxc_properties")
    )


@query("I03_pivot_tags", "SELECT object_type, object_id, key, coalesce(arg_max_null(value, seq), '') AS value FROM [fx3_tagrows] GROUP BY 1, 2, 3")
def pivot_tags(spark, sf_dir):
    return inventory.pivot_tags(fixture(spark, sf_dir, "fx3_tagrows"))


@query(
    "I04_classify_objects",
    """WITH d AS (SELECT *, upper(coalesce(table_type, 'BASE TABLE')) AS t, lower(data_source_format) AS f, concat_ws('.', catalog_name, schema_name, table_name) AS path FROM [fx2_discovered]),
    k AS (SELECT *, CASE WHEN t = 'STREAMING TABLE' THEN 'skipped' WHEN t = 'MATERIALIZED_VIEW' THEN 'materialized_view' WHEN t = 'VIEW' THEN 'view' WHEN f IN ('delta', 'iceberg') THEN 'table' ELSE 'skipped' END AS kind FROM d)
    SELECT path, kind, CASE WHEN kind = 'table' THEN t = 'EXTERNAL' END AS external, CASE WHEN t = 'STREAMING TABLE' THEN 'unsupported kind: ' || path || ' (' || t || ')'
      WHEN kind = 'skipped' THEN 'unsupported format: ' || path || ' (' || f || ')' END AS warning FROM k""",
)
def classify_objects(spark, sf_dir):
    rows = inventory.classify_objects(fixture(spark, sf_dir, "fx2_discovered"))
    return rows.select(F.concat_ws(".", "catalog_name", "schema_name", "table_name").alias("path"), "kind", "external", "warning")


@query(
    "I05_stable_ids",
    "SELECT catalog_name, schema_name, table_name, 'tbl_' || substr(sha1(lower(concat_ws('||', catalog_name, schema_name, table_name))), 1, 12) AS object_id FROM [fx2_discovered]",
)
def stable_ids(spark, sf_dir):
    parts = ["catalog_name", "schema_name", "table_name"]
    rows = inventory.stable_ids(fixture(spark, sf_dir, "fx2_discovered"), F.lit("tbl"), parts)
    return rows.select(*parts, "object_id")


_LOCAL = f"WITH {NAMES_SQL}, local AS (SELECT object_id, full_name FROM names WHERE object_type = 'table' AND full_name LIKE '%a%.%i%.%')"


@query(
    "I06_adopt_ids",
    _LOCAL + """, d AS (SELECT catalog_name || '.' || schema_name || '.' || lower(table_name) AS path FROM [fx2_discovered])
    SELECT path, coalesce(object_id, 'tbl_' || substr(sha1(path), 1, 12)) AS object_id, CASE WHEN object_id IS NULL THEN 'stable' ELSE 'local' END AS source FROM d LEFT JOIN local ON full_name = path""",
)
def adopt_ids(spark, sf_dir):
    from catalogops.functions.names import stable_id

    names = naming.qualified_names(fixture(spark, sf_dir, "fx2_objects"))
    local = names.where("object_type = 'table' AND full_name LIKE '%a%.%i%.%'").select(
        F.col("object_id").alias("id"), F.col("full_name").alias("path")
    )
    found = fixture(spark, sf_dir, "fx2_discovered").select(
        F.concat_ws(".", "catalog_name", "schema_name", F.lower("table_name")).alias("path")
    )
    return inventory.adopt_ids(found, local, ["path"], stable_id(F.lit("tbl"), F.col("path"))).select("path", "object_id", "source")


@query(
    "I07_logical_names",
    """WITH m AS (SELECT environment, physical, min(logical) AS logical, count(DISTINCT logical) AS n FROM [fx9_mapping] GROUP BY 1, 2),
    f AS (SELECT DISTINCT CASE c_nationkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'prod' END AS environment, concat('p_', CAST(c_custkey AS STRING)) AS physical FROM customer)
    SELECT f.physical, f.environment, CASE WHEN n > 1 THEN NULL ELSE coalesce(m.logical, f.physical) END AS logical, CASE WHEN n > 1 THEN 'CONFLICT' END AS error
    FROM f LEFT JOIN m ON m.environment = f.environment AND m.physical = f.physical""",
)
def logical_names(spark, sf_dir):
    found = fixture(spark, sf_dir, "fx9_catalogs").select("environment", F.regexp_replace("name", "^cat_", "p_").alias("physical")).distinct()
    return inventory.logical_names(found, fixture(spark, sf_dir, "fx9_mapping"))


_PATHS = f"""WITH {NAMES_SQL}, p AS (SELECT object_type, string_split(full_name, '.')[1] AS catalog, string_split(full_name, '.')[2] AS schema FROM names)"""


@query(
    "I08_count_objects",
    _PATHS + """ SELECT catalog, schema, object_type, count(*) AS n FROM p GROUP BY GROUPING SETS ((object_type), (catalog, object_type), (catalog, schema, object_type))""",
)
def count_objects(spark, sf_dir):
    names = naming.qualified_names(fixture(spark, sf_dir, "fx2_objects"))
    p = F.split("full_name", r"\.")
    return inventory.count_objects(names.select(F.get(p, F.lit(0)).alias("catalog"), F.get(p, F.lit(1)).alias("schema"), "object_type"))


_SCOPE = """WITH RECURSIVE o AS (SELECT * FROM [fx2_objects]), r AS (SELECT object_id AS scope_id, object_type, object_id FROM o WHERE object_id IN ('cat_1', 'sch_3', 'sch_8')
  UNION ALL SELECT r.scope_id, c.object_type, c.object_id FROM o c JOIN r ON r.object_id = c.parent_id)"""


def _scope(spark, sf_dir):
    objects = fixture(spark, sf_dir, "fx2_objects")
    scopes = objects.where("object_id IN ('cat_1', 'sch_3', 'sch_8')").select(F.col("object_id").alias("scope_id"))
    return inventory.objects_in_scope(objects, scopes, LEVELS[1:])


@query("I09_objects_in_scope", _SCOPE + " SELECT scope_id, object_type, object_id FROM r")
def objects_in_scope(spark, sf_dir):
    return _scope(spark, sf_dir)


@query(
    "I10_bulk_grant_ops",
    _SCOPE + " SELECT scope_id, object_type, object_id, 'add_grant' AS op, unnest(['analysts', 'engineers']) AS principal FROM r WHERE object_type = 'table'",
)
def bulk_grant_ops(spark, sf_dir):
    return inventory.bulk_ops(_scope(spark, sf_dir), "table", "add_grant", ["analysts", "engineers"]).withColumnRenamed("entry", "principal")


@query(
    "I10_bulk_tag_ops",
    _SCOPE + " SELECT scope_id, object_type, object_id, 'set_view_tag' AS op, unnest(['tier', 'owner']) AS tag FROM r WHERE object_type = 'view'",
)
def bulk_tag_ops(spark, sf_dir):
    return inventory.bulk_ops(_scope(spark, sf_dir), "view", "set_view_tag", ["tier", "owner"]).withColumnRenamed("entry", "tag")


@query(
    "I11_validate_state",
    """SELECT 'INVALID_' || upper(object_type) AS code, object_id, name AS detail FROM (SELECT object_type, object_id, CASE WHEN object_id LIKE '%_3' THEN '' ELSE name END AS name FROM [fx2_objects])
      WHERE object_type IN ('catalog', 'schema') AND name = ''
    UNION ALL SELECT 'DUPLICATE_COLUMN_NAME', table_id, name FROM [fx2_columns] WHERE name IS NOT NULL GROUP BY 2, 3 HAVING count(*) > 1""",
)
def validate_state(spark, sf_dir):
    objects = fixture(spark, sf_dir, "fx2_objects").withColumn(
        "name", F.when(F.col("object_id").like("%_3"), "").otherwise(F.col("name"))
    )
    return inventory.validate_state(objects, fixture(spark, sf_dir, "fx2_columns"))


@query(
    "I12_dedupe_warnings",
    "SELECT op || ' on ' || tag_name AS message, min(seq) AS first_seq FROM [fx1_oplog] GROUP BY 1",
)
def dedupe_warnings(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1_oplog").select("seq", F.concat("op", F.lit(" on "), "tag_name").alias("message"))
    return inventory.dedupe_warnings(log)


def _profile_sql(t, columns):
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{typ}' AS observed_type, count(*) AS rows, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS \"min\", CAST(max({c}) AS VARCHAR) AS \"max\" FROM {t}"
        for c, typ in columns
    )


@query(
    "I13_profile_columns",
    _profile_sql("customer", [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")])
    + " UNION ALL " + _profile_sql("events", [("event_id", "bigint"), ("user_id", "bigint"), ("ts", "timestamp_ntz"), ("event_type", "string"), ("value", "double"), ("props", "string")]),
)
def profile_columns(spark, sf_dir):
    both = inventory.profile_columns("customer", table(spark, sf_dir, "customer")).unionByName(
        inventory.profile_columns("events", table(spark, sf_dir, "events"))
    )
    return both.drop("distinct_about")


@query(
    "I14_type_inventory",
    "SELECT base_type, count(*) AS n, base_type NOT IN ('GEOGRAPHY', 'OBJECT') AS supported FROM (SELECT upper(regexp_extract(type, '^\\w+', 0)) AS base_type FROM [fx2_columns]) GROUP BY 1, 3",
)
def type_inventory(spark, sf_dir):
    return inventory.type_inventory(fixture(spark, sf_dir, "fx2_columns"))
