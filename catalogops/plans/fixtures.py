"""Input frames derived from the given tables, as SQL text that Spark and DuckDB both run.

``{table}`` marks a given table, ``[fixture]`` another fixture.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TEXTS: dict[str, str] = {}

TEXTS["fx1_oplog"] = """
SELECT event_id AS op_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
  CASE event_type WHEN 'signup' THEN 'add_table' WHEN 'error' THEN 'drop_table'
       WHEN 'view' THEN 'set_table_tag' WHEN 'click' THEN 'unset_table_tag' ELSE 'rename_table' END AS op,
  user_id AS target, concat('t', CAST(k % 5 AS STRING)) AS tag_name, CAST(k AS STRING) AS tag_value,
  concat('n_', CAST(k AS STRING)) AS new_name
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM «events»)
"""

TEXTS["fx1h_hierlog"] = """
SELECT event_id AS seq, CASE WHEN k < 6 THEN 'catalog' WHEN k < 25 THEN 'schema' ELSE 'table' END AS level,
  CASE WHEN k < 6 THEN user_id % 5 WHEN k < 25 THEN user_id % 25 ELSE user_id END AS id,
  CASE WHEN k < 6 THEN NULL WHEN k < 25 THEN user_id % 5 ELSE user_id % 25 END AS parent_id,
  CASE event_type WHEN 'error' THEN 'drop' ELSE 'add' END AS op
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM «events») WHERE event_type IN ('signup', 'view', 'error')
"""

TEXTS["fx1p_payloadlog"] = """
SELECT event_id AS op_id, event_id AS seq, user_id AS target, k,
  CASE WHEN k = 99 THEN 'unknown_kind' WHEN event_type IN ('view', 'purchase') THEN 'set_table_tag' WHEN event_type = 'signup' THEN 'add_table' ELSE 'update_function' END AS op,
  concat('{"tableId":"', CAST(user_id AS STRING), '"',
    CASE WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN ',"tagName":""' ELSE concat(',"tagName":"t', CAST(k % 5 AS STRING), '"') END,
    CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN ',"comment":null' ELSE concat(',"comment":"c', CAST(k AS STRING), '"') END, '}') AS payload
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM «events»)
"""

TEXTS["fx1g_grantlog"] = """
SELECT event_id AS seq, user_id AS target_id, concat('p', CAST(k % 4 AS STRING)) AS principal,
  CASE event_type WHEN 'purchase' THEN 'add_grant' ELSE 'revoke_grant' END AS op,
  CASE event_type WHEN 'error' THEN NULL ELSE concat_ws(',', CASE WHEN k % 2 = 1 THEN 'SELECT' END,
    CASE WHEN k % 3 = 0 THEN 'MODIFY' END, CASE WHEN k % 5 < 2 THEN 'APPLY TAG' END) END AS privileges
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM «events»)
WHERE event_type IN ('purchase', 'error', 'click')
"""

TEXTS["fx1c_columnlog"] = """
SELECT event_id AS seq, user_id AS table_id, k AS column_id,
  CASE event_type WHEN 'signup' THEN 'add_column' WHEN 'error' THEN 'drop_column' WHEN 'view' THEN 'change_column_type'
       WHEN 'click' THEN 'set_nullable' ELSE 'reorder_columns' END AS op,
  CASE k % 3 WHEN 0 THEN 'INT' WHEN 1 THEN 'BIGINT' ELSE 'STRING' END AS new_type, k % 2 = 0 AS nullable,
  concat_ws(',', CAST(k AS STRING), CAST((k * 7 + 1) % 100 AS STRING), CAST((k * 13 + 2) % 100 AS STRING)) AS order_list
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM «events»)
"""

TEXTS["fx1k_constraintlog"] = """
SELECT event_id AS seq, user_id AS table_id, k % 20 AS constraint_id,
  CASE event_type WHEN 'error' THEN 'drop_constraint' ELSE 'add_constraint' END AS op,
  CASE k % 3 WHEN 0 THEN 'primary_key' WHEN 1 THEN 'foreign_key' ELSE 'check' END AS type,
  CASE WHEN k % 2 = 0 THEN k % 4 END AS insert_at, concat('x > ', CAST(k AS STRING)) AS expression
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM «events») WHERE event_type IN ('signup', 'error')
"""

TEXTS["fx1r_rulelog"] = """
SELECT seq, table_id, rule_id, kind, op, column_id, present, CASE WHEN k % 8 = 0 THEN NULL ELSE concat('r_', CAST(k AS STRING)) END AS name,
  CASE WHEN k % 9 = 0 THEN NULL ELSE k % 3 <> 0 END AS enabled, concat('v > ', CAST(k AS STRING)) AS expression,
  CASE WHEN k % 4 = 0 THEN NULL ELSE concat('d ', CAST(k AS STRING)) END AS description
FROM (SELECT event_id AS seq, user_id AS table_id, k, k % 10 AS rule_id, CASE WHEN k % 2 = 0 THEN 'row_filter' ELSE 'column_mask' END AS kind,
    CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'update' END AS op, k % 5 AS column_id,
    CASE WHEN event_type = 'signup' THEN 'name,enabled,expression,description' ELSE concat_ws(',', CASE WHEN k % 3 = 1 THEN 'name' END,
      CASE WHEN k % 2 = 0 THEN 'enabled' END, CASE WHEN k % 5 < 2 THEN 'expression' END, CASE WHEN k % 7 < 3 THEN 'description' END) END AS present
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM «events») WHERE event_type IN ('signup', 'error', 'view'))
"""
# Adds and drops of the targets that the grant, column, constraint and rule logs act on; most are there from the start.
TEXTS["fx1t_targetlog"] = """
SELECT event_id AS seq, user_id AS target, event_type AS source, CASE WHEN k < 50 THEN 'add' ELSE 'drop' END AS kind
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM «events»)
WHERE event_type IN ('view', 'click') AND (k < 50 OR k >= 88)
UNION ALL SELECT DISTINCT CAST(-1 AS BIGINT), user_id, 'start', 'add' FROM «events» WHERE user_id % 10 <> 3
"""
TEXTS["fx2_objects"] = """
SELECT 'catalog' AS object_type, concat('cat_', CAST(r_regionkey AS STRING)) AS object_id, CAST(NULL AS STRING) AS parent_id, lower(r_name) AS name FROM «region»
UNION ALL SELECT 'schema', concat('sch_', CAST(n_nationkey AS STRING)), concat('cat_', CAST(n_regionkey AS STRING)), lower(n_name) FROM «nation»
UNION ALL SELECT 'table', concat('tbl_', CAST(c_custkey AS STRING)), concat('sch_', CAST(c_nationkey AS STRING)), concat('t_', CAST(c_custkey AS STRING)) FROM «customer»
UNION ALL SELECT 'view', concat('vw_', CAST(s_suppkey AS STRING)), concat('sch_', CAST(s_nationkey AS STRING)), concat('v_', CAST(s_suppkey AS STRING)) FROM «supplier»
UNION ALL SELECT 'column', concat('col_', CAST(o_orderkey AS STRING)), concat('tbl_', CAST(o_custkey AS STRING)), concat('c_', CAST(o_orderkey % 50 AS STRING)) FROM «orders»
"""

TEXTS["fx3_old"] = """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS comment, c_nationkey AS nation, c_acctbal AS bal FROM «customer»
"""

TEXTS["fx3_new"] = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 5 THEN concat(c_name, '_x') ELSE c_name END AS name,
  CASE WHEN c_custkey % 7 = 3 THEN 'CHANGED' WHEN c_custkey % 19 = 4 THEN NULL ELSE c_mktsegment END AS comment,
  c_nationkey AS nation, CASE WHEN c_custkey % 23 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS bal
FROM «customer» WHERE c_custkey % 10 <> 0
UNION ALL SELECT c_custkey + 1000000, c_name, c_mktsegment, c_nationkey, c_acctbal FROM «customer» WHERE c_custkey % 13 = 1
"""

TEXTS["fx4_deployments"] = """
SELECT o_orderkey AS id, o_orderpriority AS environment, CAST(o_orderdate AS TIMESTAMP) AS deployed_at,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'partial' END AS status,
  concat('v', CAST(o_orderkey % 4 AS STRING), '.', CAST(o_orderkey % 10 AS STRING), '.0') AS snapshot_version,
  CAST(floor(o_totalprice) AS BIGINT) AS execution_time_ms FROM «orders»
"""

TEXTS["fx4_ops"] = """
SELECT l_orderkey AS deployment_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS execution_order,
  CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'success' END AS status,
  CASE l_linestatus WHEN 'F' THEN 'add_table' ELSE 'drop_table' END AS op_type, l_partkey AS op_target FROM «lineitem»
"""

TEXTS["fx5_edges"] = """
SELECT concat('tbl_', CAST(o_custkey AS STRING)) AS from_id, concat('vw_', CAST(o_orderkey AS STRING)) AS to_id, 'view_to_table' AS dep_type FROM «orders»
UNION ALL SELECT concat('vw_', CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING)), concat('vw_', CAST(o_orderkey AS STRING)), 'view_to_view' FROM «orders» WHERE o_orderkey > 0
"""

TEXTS["fx5x_edges"] = """
SELECT from_id, to_id, dep_type FROM [fx5_edges]
UNION ALL SELECT concat('vw_', CAST(o_orderkey AS STRING)), concat('vw_', CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING)), 'view_to_view' FROM «orders» WHERE o_orderkey % 1000 = 3
UNION ALL SELECT 'tbl_missing', concat('vw_', CAST(o_orderkey AS STRING)), 'view_to_table' FROM «orders» WHERE o_orderkey % 500 = 7
"""


def viewdefs(ticked: str, short: str) -> str:
    """One stored view per order, in four forms: joins, back-ticks, comma lists with comments, sub-queries.

    ``ticked`` and ``short`` spell the first and second table in the places where names count;
    those in literals and comments are always spelled alike.
    """
    return f"""
SELECT view_id, concat('WITH z AS (SELECT 1 AS one) SELECT a.x, b.y, amount + 1 AS more, extract(year FROM a.d) AS yr, ', chr(39), 'FROM ', brief, chr(39), ' AS note FROM ',
  CASE WHEN k % 9 = 0 THEN 'nowhere.t_0 q, ' ELSE '' END,
  CASE k % 4 WHEN 0 THEN concat(path, ' a JOIN ', {short}, ' b ON a.k = b.k JOIN z ON true')
    WHEN 1 THEN concat({ticked}, ' a JOIN ', {short}, ' b ON a.k IS NOT DISTINCT FROM b.k JOIN z ON true')
    WHEN 2 THEN concat(path, ' a, ', {short}, ' b, z -- FROM ', brief, chr(10), ' WHERE a.k = b.k')
    ELSE concat(path, ' a /* JOIN ', brief, ' */ JOIN (SELECT k, y FROM ', {short}, ') b ON a.k = b.k JOIN z ON true') END) AS definition
FROM (SELECT o_orderkey AS k, concat('vw_', CAST(o_orderkey AS STRING)) AS view_id, concat(CASE WHEN r_name LIKE '% %' THEN concat('`', lower(r_name), '`') ELSE lower(r_name) END, '.', lower(n_name), '.t_', CAST(c_custkey AS STRING)) AS path,
    concat(lower(n_name), '.t_', CAST(c_custkey AS STRING)) AS brief, lower(r_name) AS region
  FROM «orders» JOIN «customer» ON o_custkey = c_custkey JOIN «nation» ON c_nationkey = n_nationkey JOIN «region» ON n_regionkey = r_regionkey)
"""


TEXTS["fx6_viewdefs"] = viewdefs("concat('`', replace(replace(path, '`', ''), '.', '`.`'), '`')", "brief")

TEXTS["fx7_versions"] = """
SELECT p_partkey AS id, p_brand AS branch, CASE WHEN p_partkey % 17 = 0 THEN concat('bad-', CAST(p_partkey AS STRING))
  ELSE concat(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'v' END, CAST(p_size % 4 AS STRING), '.', CAST(p_partkey % 10 AS STRING), '.', CAST(p_partkey % 7 AS STRING)) END AS version FROM «part»
"""

# Catalog names per environment; some physical names collide and some logical names are remapped.
TEXTS["fx9_mapping"] = """
SELECT CASE c_nationkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'prod' END AS environment,
  concat('cat_', CAST(c_custkey AS STRING)) AS logical, concat('p_', CAST(c_custkey % 1000 AS STRING)) AS physical
FROM «customer» WHERE c_custkey % 7 <> 0
UNION ALL SELECT CASE c_nationkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'prod' END,
  concat('cat_', CAST(c_custkey AS STRING)), concat('q_', CAST(c_custkey AS STRING)) FROM «customer» WHERE c_custkey % 50 = 1
"""

# Catalogs as discovered: one per customer, with the environment they live in.
TEXTS["fx9_catalogs"] = """
SELECT concat('cat_', CAST(c_custkey AS STRING)) AS object_id, concat('cat_', CAST(c_custkey AS STRING)) AS name,
  CASE c_nationkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'prod' END AS environment FROM «customer»
"""

# One DDL script per customer: quotes in comments, a deep type, a rule of the table, and some statements that are wrong.
TEXTS["fx8_scripts"] = """
SELECT c_custkey AS script_id, concat('-- it', chr(39), 's a script', chr(10), 'CREATE SCHEMA s_', CAST(c_nationkey AS STRING), ' COMMENT ''a;b''; -- don', chr(39), 't cut; here', chr(10),
  'CREATE TABLE s.t_', CAST(c_custkey AS STRING), ' (id BIGINT NOT NULL, amt DECIMAL(12, 2) COMMENT ''net, of tax -- NOT NULL'', /* old, gone; */ m MAP<STRING, INT>,', chr(10),
  ' `deep one` ARRAY<STRUCT<a: MAP<STRING, ARRAY<STRUCT<b: INT, c: DECIMAL(3, 1)>>>>> NOT NULL, CHECK (id > 0), CONSTRAINT pk PRIMARY KEY (id, amt)) USING delta TBLPROPERTIES (''k'' = ''v'');', chr(10),
  CASE c_custkey % 4 WHEN 0 THEN 'VACUUM s.t;' WHEN 1 THEN 'COMMENT ON TABLE s.`t` IS ''x;y'';' ELSE 'ALTER TABLE s.t ADD COLUMN c INT;' END,
  CASE c_custkey % 10 WHEN 0 THEN ' CREATE TABLE (id INT);' WHEN 1 THEN concat(' CREATE VIEW s.v AS SELECT ', chr(39), 'open; DROP TABLE x;') ELSE '' END) AS script FROM «customer»
"""

# Managed categories per environment (no row for an environment = everything is managed).
TEXTS["fx9_env"] = """
SELECT * FROM (VALUES ('prod', 'governance'), ('test', 'table_structure'), ('test', 'governance')) AS t(environment, managed_category)
"""

# Key metadata in the four-table shape of an information schema: each customer is a table with a key over
# its orders; names of constraints repeat: all keys of a schema are 'pk', and each schema is in two catalogs.
_PLACED = """concat('cat_', CAST({0} % 2 AS STRING)) AS catalog_name, concat('s_', CAST(CAST(floor({0} / 2) AS BIGINT) % 7 AS STRING)) AS schema_name,
  concat('t_', CAST(CAST(floor({0} / 14) AS BIGINT) AS STRING)) AS table_name"""
TEXTS["fxc_table_constraints"] = " UNION ALL ".join(
    f"SELECT {_PLACED.format('c_custkey')}, '{name}' AS constraint_name, '{kind}' AS constraint_type FROM «customer» WHERE c_custkey % {by} = {at}"
    for name, kind, by, at in (("pk", "PRIMARY KEY", 1, 0), ("fk", "Foreign Key", 3, 1), ("ck", "CHECK", 5, 2))
)
TEXTS["fxc_key_columns"] = f"""
SELECT {_PLACED.format('o_custkey')}, 'pk' AS constraint_name, concat('c_', CAST(o_orderkey AS STRING)) AS column_name,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS ordinal_position, CAST(NULL AS INT) AS position_in_unique_constraint FROM «orders»
UNION ALL SELECT {_PLACED.format('o_custkey')}, 'fk', concat('c_', CAST(o_orderkey AS STRING)), row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey),
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) FROM «orders» WHERE o_custkey % 3 = 1
"""
TEXTS["fxc_referential"] = f"""
SELECT {_PLACED.format('c_custkey')}, 'fk' AS constraint_name, concat('cat_', CAST((c_custkey - 1) % 2 AS STRING)) AS unique_catalog,
  concat('s_', CAST(CAST(floor((c_custkey - 1) / 2) AS BIGINT) % 7 AS STRING)) AS unique_schema,
  CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE concat('t_', CAST(CAST(floor((c_custkey - 1) / 14) AS BIGINT) AS STRING)) END AS unique_table, 'pk' AS unique_constraint_name
FROM «customer» WHERE c_custkey % 3 = 1
"""
TEXTS["fxc_check_clauses"] = """
SELECT DISTINCT concat('cat_', CAST(c_custkey % 2 AS STRING)) AS catalog_name, concat('s_', CAST(CAST(floor(c_custkey / 2) AS BIGINT) % 7 AS STRING)) AS schema_name, 'ck' AS constraint_name,
  CASE WHEN CAST(floor(c_custkey / 2) AS BIGINT) % 7 = 3 THEN '' ELSE concat('amt > ', CAST(CAST(floor(c_custkey / 2) AS BIGINT) % 7 AS STRING)) END AS check_clause FROM «customer»
"""
TEXTS["fxc_properties"] = f"""
SELECT {_PLACED.format('c_custkey')}, CASE c_custkey % 4 WHEN 0 THEN 'delta.constraints.ck' WHEN 1 THEN 'delta.constraints.extra' WHEN 2 THEN 'delta.constraints.' ELSE 'owner' END AS key,
  'x > 0' AS value FROM «customer»
"""

# Tags as read from a catalog: repeated keys, null values.
TEXTS["fx3_tagrows"] = """
SELECT event_id AS seq, user_id AS object_id, CASE WHEN k % 2 = 0 THEN 'table' ELSE 'column' END AS object_type,
  concat('k', CAST(k % 6 AS STRING)) AS key, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k AS STRING) END AS value
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM «events»)
"""

# Discovered objects with their declared kind.
TEXTS["fx2_discovered"] = """
SELECT lower(r_name) AS catalog_name, lower(n_name) AS schema_name, concat('T_', CAST(c_custkey AS STRING)) AS table_name,
  CASE c_custkey % 6 WHEN 0 THEN 'view' WHEN 1 THEN 'MATERIALIZED_VIEW' WHEN 2 THEN 'STREAMING TABLE' WHEN 3 THEN NULL WHEN 4 THEN 'EXTERNAL' ELSE 'BASE TABLE' END AS table_type,
  CASE WHEN c_custkey % 13 = 0 THEN 'CSV' WHEN c_custkey % 2 = 0 THEN 'DELTA' ELSE 'iceberg' END AS data_source_format
FROM «customer» JOIN «nation» ON c_nationkey = n_nationkey JOIN «region» ON n_regionkey = r_regionkey
"""

# External tables with a location name and a relative path.
TEXTS["fx9_external"] = """
SELECT concat('tbl_', CAST(c_custkey AS STRING)) AS object_id,
  CASE c_custkey % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'curated' WHEN 2 THEN 'nowhere' WHEN 3 THEN NULL ELSE 'raw' END AS location_name,
  CASE c_custkey % 3 WHEN 0 THEN concat('/t/', CAST(c_custkey AS STRING)) WHEN 1 THEN '' ELSE concat('t/', CAST(c_custkey AS STRING)) END AS path,
  CASE c_nationkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE NULL END AS environment FROM «customer»
"""
TEXTS["fx9_locations"] = """
SELECT * FROM (VALUES ('raw','dev','s3://dev/raw//'), ('raw','test','s3://test/raw'), ('curated','dev','s3://dev/cur/')) AS t(location_name, environment, base_path)
"""

# Columns with a declared type, one per order; the table is the customer.
TEXTS["fx2_columns"] = """
SELECT concat('tbl_', CAST(o_custkey AS STRING)) AS table_id, concat('col_', CAST(o_orderkey AS STRING)) AS column_id,
  CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE concat('c_', CAST(o_orderkey % 50 AS STRING)) END AS name,
  CASE o_orderkey % 8 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'DECIMAL(12,2)' WHEN 2 THEN 'ARRAY<INT>' WHEN 3 THEN 'GEOGRAPHY(4326)'
    WHEN 4 THEN 'OBJECT' WHEN 5 THEN 'map<string,int>' WHEN 6 THEN 'TIMESTAMP_NTZ' ELSE 'VARIANT' END AS type,
  o_orderstatus <> 'P' AS nullable, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('note ', o_orderpriority) END AS comment FROM «orders»
"""
TEXTS["fx2_columntags"] = """
SELECT concat('col_', CAST(o_orderkey AS STRING)) AS column_id, CASE WHEN o_orderkey % 4 = 0 THEN 'pii' ELSE 'tier' END AS key,
  CAST(o_orderkey % 7 AS STRING) AS value FROM «orders» WHERE o_orderkey % 2 = 0
"""


def _hierarchy(schemas: str, nation: str, tables: str, columns: str, rename: str, comment: str) -> str:
    """Objects of one of two states of a hierarchy: regions, nations, customers, suppliers and orders."""
    held = f"SELECT c_custkey, c_name, c_mktsegment, {nation} AS nat FROM «customer» WHERE {tables}"
    under = schemas.replace("n_nationkey", "nat")
    return f"""
SELECT 'catalog' AS object_type, concat('cat_', CAST(r_regionkey AS STRING)) AS object_id, CAST(NULL AS STRING) AS parent_id, lower(r_name) AS name, CAST(NULL AS STRING) AS comment FROM «region»
UNION ALL SELECT 'schema', concat('sch_', CAST(n_nationkey AS STRING)), concat('cat_', CAST(n_regionkey AS STRING)), concat(lower(n_name), '{rename}'), 'a nation' FROM «nation» WHERE {schemas}
UNION ALL SELECT 'table', concat('tbl_', CAST(c_custkey AS STRING)), concat('sch_', CAST(nat AS STRING)),
  CASE WHEN c_custkey % 11 = 5 THEN concat('t_', CAST(c_custkey AS STRING), '{rename}') ELSE concat('t_', CAST(c_custkey AS STRING)) END,
  CASE WHEN c_custkey % 7 = 3 THEN {comment} ELSE c_mktsegment END FROM ({held}) WHERE {under}
UNION ALL SELECT 'view', concat('vw_', CAST(s_suppkey AS STRING)), concat('sch_', CAST(s_nationkey AS STRING)), concat('v_', CAST(s_suppkey AS STRING)), NULL
  FROM «supplier» WHERE {schemas.replace('n_nationkey', 's_nationkey')}
UNION ALL SELECT 'column', concat('col_', CAST(o_orderkey AS STRING)), concat('tbl_', CAST(o_custkey AS STRING)), concat('c_', CAST(o_orderkey AS STRING)), NULL
  FROM «orders» JOIN ({held}) ON c_custkey = o_custkey WHERE {under} AND {columns}
"""


TEXTS["fx3w_old"] = _hierarchy("n_nationkey % 9 <> 4", "c_nationkey", "c_custkey % 10 <> 3", "o_orderkey % 17 <> 5", "", "c_mktsegment")
TEXTS["fx3w_new"] = _hierarchy(
    "n_nationkey % 9 <> 7", "CASE WHEN c_custkey % 29 = 4 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END", "c_custkey % 10 <> 6", "o_orderkey % 13 <> 2", "_x", "NULL"
)


def _expand(text: str) -> str:
    return re.sub(r"\[(fx\w+)\]", lambda m: f"({_expand(TEXTS[m[1]])})", text)


def duckdb_sql(text: str) -> str:
    """The text with every fixture spelled out over the plain table names."""
    return re.sub(r"«(\w+)»", r"\1", _expand(text))


def spark_text(text: str, sf_dir: str) -> str:
    return re.sub(r"«(\w+)»", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", _expand(text))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_text(TEXTS[name], sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
