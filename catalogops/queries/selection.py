"""Validation, scope, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.functions.opkinds import FIELDS
from catalogops.functions.privileges import legal_values_sql
from catalogops.operators import fold, naming, validate
from catalogops.plans.fixtures import fixture
from catalogops.queries.registry import query

_REQUIRED = ", ".join(f"('{k}', '{f}')" for k, req, *_ in FIELDS for f in req.split())
_KIND = ", ".join(f"('{k}', '{cat}')" for k, _, cat, *_ in FIELDS)
ERRORS_SQL = f"""
WITH need(op, field) AS (VALUES {_REQUIRED}), known(op, category) AS (VALUES {_KIND}), p AS (SELECT * FROM [fx1p_payloadlog])
SELECT op_id, 'op' AS field, 'UNSUPPORTED_OPERATION' AS code FROM p WHERE op NOT IN (SELECT op FROM known)
UNION ALL SELECT op_id, 'payload.' || field, 'MISSING_REQUIRED_FIELD' FROM p JOIN need USING (op)
  WHERE coalesce(json_extract_string(payload, '$.' || field), '') = ''
"""


@query("P01_validate_ops", ERRORS_SQL)
def validate_ops(spark, sf_dir):
    return validate.op_errors(fixture(spark, sf_dir, "fx1p_payloadlog"))


@query(
    "P02_filter_managed_scope",
    f"""WITH known(op, category) AS (VALUES {_KIND}),
    env(environment) AS (VALUES ('dev'), ('test'), ('prod')), m AS (SELECT * FROM [fx9_env])
    SELECT e.environment, l.op_id, l.seq FROM [fx1_oplog] l, env e WHERE
      NOT EXISTS (SELECT 1 FROM m WHERE m.environment = e.environment) OR l.op NOT IN (SELECT op FROM known)
      OR EXISTS (SELECT 1 FROM m JOIN known k ON k.category = m.managed_category WHERE m.environment = e.environment AND k.op = l.op)""",
)
def filter_managed_scope(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1_oplog")
    kept = validate.managed_by_environment(log, fixture(spark, sf_dir, "fx9_env"), ["dev", "test", "prod"])
    return kept.select("environment", "op_id", "seq")


_UNDO_IDS = """SELECT concat(' ', CAST(o_orderkey AS STRING), ' ') AS op_id FROM «orders» WHERE o_orderstatus = 'F'
UNION ALL SELECT CAST(o_orderkey AS STRING) FROM «orders» WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'"""
_UNDO_SQL = f"""WITH ids AS (SELECT DISTINCT trim(op_id) AS id FROM ({_UNDO_IDS})), l AS (SELECT * FROM [fx1_oplog])"""


def _undo(spark, sf_dir):
    from catalogops.plans.fixtures import spark_text

    return validate.undo_ops(fixture(spark, sf_dir, "fx1_oplog"), spark.sql(spark_text(_UNDO_IDS, sf_dir)))


@query("P03_undo_ops", _UNDO_SQL + " SELECT op_id, seq FROM l WHERE CAST(op_id AS VARCHAR) NOT IN (SELECT id FROM ids)")
def undo_ops(spark, sf_dir):
    return _undo(spark, sf_dir)[0].select("op_id", "seq")


@query(
    "P03_undo_summary",
    _UNDO_SQL + """ SELECT (SELECT count(*) FROM ids WHERE id IN (SELECT CAST(op_id AS VARCHAR) FROM l)) AS removed_count,
    (SELECT count(*) FROM ids WHERE id NOT IN (SELECT CAST(op_id AS VARCHAR) FROM l)) AS missing_count,
    (SELECT count(*) FROM l WHERE CAST(op_id AS VARCHAR) NOT IN (SELECT id FROM ids)) AS remaining_count""",
)
def undo_summary(spark, sf_dir):
    return _undo(spark, sf_dir)[1]


@query(
    "P04_normalize_op_ids",
    """SELECT CASE WHEN op_id % 3 = 0 THEN concat_ws('_', 'op', seq, strftime(ts, '%Y-%m-%d'), target) ELSE CAST(op_id AS VARCHAR) END AS op_id, seq FROM [fx1_oplog]""",
)
def normalize_op_ids(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1_oplog").select(
        F.when(F.col("op_id") % 3 != 0, F.col("op_id")).alias("op_id"), "seq", F.to_date("ts").alias("ts"), "target"
    )
    return validate.normalize_op_ids(log, "seq").select("op_id", "seq")


@query(
    "P05_op_signature",
    """WITH c AS (SELECT op_id, op, CAST(target AS VARCHAR) AS target, 'j{' || concat_ws(',',
        CASE WHEN payload LIKE '%"comment"%' THEN '"comment":' || coalesce('"' || json_extract_string(payload, '$.comment') || '"', 'null') END,
        '"tableId":"' || json_extract_string(payload, '$.tableId') || '"',
        CASE WHEN payload LIKE '%"tagName"%' THEN '"tagName":"' || json_extract_string(payload, '$.tagName') || '"' END) || '}' AS body FROM [fx1p_payloadlog])
    SELECT op_id, sha256(concat_ws('|', length(op) || ':' || op, length(target) || ':' || target, length(body) || ':' || body)) AS signature FROM c""",
)
def op_signature(spark, sf_dir):
    return validate.op_signature(fixture(spark, sf_dir, "fx1p_payloadlog")).select("op_id", "signature")


_SINGLE = "m AS (SELECT environment, logical, min(physical) AS physical FROM [fx9_mapping] GROUP BY 1, 2)"


@query(
    "P06_map_catalog_names",
    f"""WITH {_SINGLE} SELECT o.object_id, m.physical, CASE WHEN m.physical IS NULL THEN 'UNMAPPED' END AS error
    FROM [fx9_catalogs] o LEFT JOIN m ON m.environment = o.environment AND m.logical = o.name""",
)
def map_catalog_names(spark, sf_dir):
    mapping = naming.single_mapping(fixture(spark, sf_dir, "fx9_mapping"))
    return naming.map_catalog_names(fixture(spark, sf_dir, "fx9_catalogs"), mapping)


@query(
    "P07_mapping_conflicts",
    """WITH m AS (SELECT DISTINCT environment, logical, physical FROM [fx9_mapping])
    SELECT environment, 'physical_shared' AS kind, physical AS name, count(*) AS n FROM m GROUP BY 1, 2, 3 HAVING count(*) > 1
    UNION ALL SELECT environment, 'logical_remapped', logical, count(*) FROM m GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def mapping_conflicts(spark, sf_dir):
    return naming.mapping_conflicts(fixture(spark, sf_dir, "fx9_mapping"))


@query(
    "P08_resolve_locations",
    """WITH o AS (SELECT * FROM [fx9_external] WHERE location_name IS NOT NULL), l AS (SELECT * FROM [fx9_locations]),
    j AS (SELECT o.*, l.base_path, CASE WHEN o.location_name NOT IN (SELECT location_name FROM l) THEN 'LOCATION_NOT_FOUND'
      WHEN o.environment IS NULL THEN 'ENVIRONMENT_NOT_PROVIDED' WHEN l.base_path IS NULL THEN 'NO_PATH_FOR_ENVIRONMENT' END AS error
      FROM o LEFT JOIN l ON l.location_name = o.location_name AND l.environment = o.environment)
    SELECT object_id, CASE WHEN error IS NULL THEN rtrim(base_path, '/') || CASE WHEN path = '' THEN '' ELSE '/' || ltrim(path, '/') END END AS path, error FROM j""",
)
def resolve_locations(spark, sf_dir):
    return naming.resolve_locations(fixture(spark, sf_dir, "fx9_external"), fixture(spark, sf_dir, "fx9_locations"))


NAMES_SQL = """o AS (SELECT * FROM [fx2_objects]),
n1 AS (SELECT object_type, object_id, name AS full_name FROM o WHERE object_type = 'catalog'),
n2 AS (SELECT o.object_type, o.object_id, n1.full_name || '.' || o.name AS full_name FROM o JOIN n1 ON n1.object_id = o.parent_id WHERE o.object_type = 'schema'),
n3 AS (SELECT o.object_type, o.object_id, n2.full_name || '.' || o.name AS full_name FROM o JOIN n2 ON n2.object_id = o.parent_id WHERE o.object_type IN ('table', 'view')),
n4 AS (SELECT o.object_type, o.object_id, n3.full_name || '.' || o.name AS full_name FROM o JOIN n3 ON n3.object_id = o.parent_id WHERE o.object_type = 'column'),
names AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3 UNION ALL SELECT * FROM n4)"""


@query("P09_qualified_names", f"WITH {NAMES_SQL} SELECT * FROM names")
def qualified_names(spark, sf_dir):
    return naming.qualified_names(fixture(spark, sf_dir, "fx2_objects"))


# The raw lists of the grant log, as a function's grants: SELECT and MODIFY are not legal there.
@query(
    "P10_illegal_privileges",
    f"""WITH legal(object_type, privilege) AS (VALUES {legal_values_sql()}),
    g AS (SELECT seq, target_id, principal, trim(unnest(string_split(concat(' ', privileges, ' , '), ','))) AS privilege,
      CASE target_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'table' ELSE 'volume' END AS object_type FROM [fx1g_grantlog] WHERE privileges IS NOT NULL)
    SELECT seq, object_type, target_id, principal, privilege FROM g WHERE privilege <> ''
      AND NOT EXISTS (SELECT 1 FROM legal l WHERE l.object_type = g.object_type AND l.privilege = g.privilege)""",
)
def illegal_privileges(spark, sf_dir):
    raw = fixture(spark, sf_dir, "fx1g_grantlog").where("privileges IS NOT NULL")
    grants = raw.select(
        "seq",
        F.when(F.col("target_id") % 3 == 0, "function").when(F.col("target_id") % 3 == 1, "table").otherwise("volume").alias("object_type"),
        "target_id", "principal",
        F.explode(naming.split_privileges(F.concat(F.lit(" "), "privileges", F.lit(" , ")))).alias("privilege"),
    )
    return naming.illegal_privileges(grants).select("seq", "object_type", "target_id", "principal", "privilege")


@query(
    "P11_import_scope_filter",
    "SELECT catalog_name, schema_name, table_name FROM [fx2_discovered] WHERE catalog_name = 'asia'",
)
def import_scope_filter(spark, sf_dir):
    kept = naming.import_scope_filter(fixture(spark, sf_dir, "fx2_discovered"), catalog=" ASIA ")
    return kept.select("catalog_name", "schema_name", "table_name")


_PATHS_SQL = f"""WITH {NAMES_SQL}, t AS (SELECT CAST(substr(object_id, 5) AS BIGINT) AS target, '`' || replace(full_name, '.', '`.`') || '`' AS path FROM names WHERE object_type = 'table')"""


@query(
    "P12_render_statements",
    _PATHS_SQL + """, lines AS (SELECT seq, op_id, CASE WHEN path IS NULL THEN 'UNKNOWN_NAME' END AS error, CASE op WHEN 'add_table' THEN 'CREATE TABLE IF NOT EXISTS ' || path || ' ()' WHEN 'drop_table' THEN 'DROP TABLE IF EXISTS ' || path
      WHEN 'rename_table' THEN 'ALTER TABLE ' || path || ' RENAME TO `' || new_name || '`'
      WHEN 'set_table_tag' THEN 'ALTER TABLE ' || path || ' SET TAGS (''' || tag_name || ''' = ''' || tag_value || ''')'
      WHEN 'unset_table_tag' THEN 'ALTER TABLE ' || path || ' UNSET TAGS (''' || tag_name || ''')' END AS statement FROM [fx1_oplog] l LEFT JOIN t USING (target))
    SELECT row_number() OVER (ORDER BY seq) AS execution_order, op_id, statement, error FROM lines""",
)
def render_statements(spark, sf_dir):
    payload = F.create_map(*[c for n, f in (("newName", "new_name"), ("tagName", "tag_name"), ("tagValue", "tag_value")) for c in (F.lit(n), F.col(f))])
    return naming.render_statements(fixture(spark, sf_dir, "fx1_oplog").withColumn("payload", payload), _table_names(spark, sf_dir))


def _table_names(spark, sf_dir):
    names = naming.qualified_names(fixture(spark, sf_dir, "fx2_objects")).where("object_type = 'table'")
    return names.select(F.substring_index("object_id", "_", -1).cast("long").alias("target"), "full_name")


@query(
    "P12_render_payloads",
    _PATHS_SQL + """, l AS (SELECT seq, op_id, op, path, payload->>'$.comment' AS said FROM [fx1p_payloadlog] LEFT JOIN t USING (target)),
    lines AS (SELECT *, CASE WHEN path IS NOT NULL AND op = 'add_table' THEN 'CREATE TABLE IF NOT EXISTS ' || path || ' ()' || coalesce(' COMMENT ''' || said || '''', '') END AS statement FROM l)
    SELECT row_number() OVER (ORDER BY seq) AS execution_order, op_id, statement, CASE WHEN op = 'unknown_kind' THEN 'UNKNOWN_KIND' WHEN path IS NULL THEN 'UNKNOWN_NAME' WHEN statement IS NULL THEN 'MISSING_FIELD' END AS error FROM lines""",
)
def render_payloads(spark, sf_dir):
    """A log as it is read: tags without a value and functions without a body cannot be written."""
    log = fixture(spark, sf_dir, "fx1p_payloadlog").withColumn("payload", F.from_json("payload", "MAP<STRING, STRING>"))
    return naming.render_statements(log, _table_names(spark, sf_dir))
