"""Impact and constraints, on the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.operators import impact, quality
from catalogops.plans.fixtures import fixture, spark_text, table
from catalogops.queries.registry import query

_LEVEL = "CASE WHEN {n} IS NULL THEN 'UNKNOWN' WHEN {n} = 0 THEN 'SAFE' WHEN {n} < 1000 THEN 'RISKY' ELSE 'DESTRUCTIVE' END"
_TABLES = ["region", "nation", "supplier", "customer", "orders", "lineitem"]


@query(
    "A01_rows_at_risk",
    "SELECT object, data_at_risk, " + _LEVEL.format(n="data_at_risk") + " AS level, data_at_risk || ' rows' AS reason FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS object, count(*) AS data_at_risk FROM {t}" for t in _TABLES)
    + " UNION ALL SELECT 'no_orders', count(*) FROM orders WHERE o_orderkey < 0)",
)
def rows_at_risk(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in _TABLES}
    tables["no_orders"] = table(spark, sf_dir, "orders").where("o_orderkey < 0")
    return impact.rows_at_risk(tables)


_VALUES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


@query(
    "A02_values_at_risk",
    "SELECT object, data_at_risk, " + _LEVEL.format(n="data_at_risk") + " AS level, data_at_risk || ' values' AS reason FROM ("
    + " UNION ALL ".join(f"SELECT '{t}.{c}' AS object, count({c}) AS data_at_risk FROM {t}" for t, cs in _VALUES.items() for c in cs) + ")",
)
def values_at_risk(spark, sf_dir):
    parts = [impact.values_at_risk(t, table(spark, sf_dir, t), cs) for t, cs in _VALUES.items()]
    return parts[0].unionByName(parts[1])


@query(
    "A03_container_risk",
    """WITH o AS (SELECT * FROM [fx2_objects]), c AS (SELECT b.object_id AS object, b.object_type AS box, count(x.object_id) AS data_at_risk FROM o b LEFT JOIN o x
      ON x.parent_id = b.object_id AND x.object_type = CASE b.object_type WHEN 'catalog' THEN 'schema' ELSE 'table' END WHERE b.object_type IN ('catalog', 'schema') GROUP BY 1, 2)
    SELECT object, data_at_risk, CASE WHEN box = 'catalog' AND data_at_risk > 0 THEN 'DESTRUCTIVE' ELSE """ + _LEVEL.format(n="data_at_risk") + """ END AS level,
      data_at_risk || CASE box WHEN 'catalog' THEN ' schemas' ELSE ' tables' END AS reason FROM c""",
)
def container_risk(spark, sf_dir):
    return impact.container_risk(fixture(spark, sf_dir, "fx2_objects"))


@query("A04_risk_sample", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def risk_sample(spark, sf_dir):
    return impact.risk_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], "DESTRUCTIVE")


@query(
    "A05_lossy_casts",
    """SELECT 'l_quantity' AS "column", 'int' AS to_type, count(l_quantity) AS checked, 0::BIGINT AS failed, count(*) FILTER (l_quantity <> trunc(l_quantity)) AS changed FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'int', count(l_extendedprice), 0, count(*) FILTER (l_extendedprice <> trunc(l_extendedprice)) FROM lineitem
    UNION ALL SELECT 'l_orderkey', 'smallint', count(l_orderkey), count(*) FILTER (l_orderkey NOT BETWEEN -32768 AND 32767), 0 FROM lineitem
    UNION ALL SELECT 'l_returnflag', 'int', count(l_returnflag), count(l_returnflag), 0 FROM lineitem
    UNION ALL SELECT 'l_discount', 'decimal(12,1)', count(l_discount), 0, count(*) FILTER (abs(l_discount * 10 - round(l_discount * 10)) > 1e-9) FROM lineitem""",
)
def lossy_casts(spark, sf_dir):
    return impact.lossy_casts(
        table(spark, sf_dir, "lineitem"),
        {"l_quantity": "int", "l_extendedprice": "int", "l_orderkey": "smallint", "l_returnflag": "int", "l_discount": "decimal(12,1)"},
    )


@query(
    "A06_assess_ops",
    """WITH c AS (SELECT o_custkey AS target, count(*) * 100 AS n FROM orders GROUP BY 1),
    a AS (SELECT l.op_id, l.op, l.target, CASE WHEN l.op = 'drop_table' THEN c.n ELSE 0 END AS data_at_risk FROM [fx1_oplog] l LEFT JOIN c ON c.target = l.target)
    SELECT *, """ + _LEVEL.format(n="data_at_risk") + " AS level FROM a",
)
def assess_ops(spark, sf_dir):
    ops = fixture(spark, sf_dir, "fx1_oplog").select("op_id", "op", "target")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("target")).agg(
        (F.count(F.lit(1)) * 100).alias("n")
    )
    return impact.assess_ops(ops, counts)


@query(
    "Q01_pk_violations",
    "SELECT l_orderkey, l_linenumber, 'duplicate' AS violation, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def pk_violations(spark, sf_dir):
    return quality.pk_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "Q02_fk_violations",
    "SELECT doc_id, 'orphan' AS violation, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
)
def fk_violations(spark, sf_dir):
    return quality.fk_violations(table(spark, sf_dir, "documents"), ["doc_id"], table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "Q02_fk_match_full",
    """WITH c AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 2000 END AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders),
    p AS (SELECT DISTINCT c_custkey AS a, CASE c_nationkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS b FROM customer)
    SELECT a, b, 'orphan' AS violation, count(*) AS n FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.a = c.a AND p.b = c.b) GROUP BY 1, 2
    UNION ALL SELECT a, b, 'partly_null', count(*) FROM c WHERE (a IS NULL) <> (b IS NULL) GROUP BY 1, 2""",
)
def fk_match_full(spark, sf_dir):
    child = table(spark, sf_dir, "orders").select(
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 2000 END").alias("a"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END").alias("b"),
    )
    parent = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END").alias("flag")
    )
    return quality.fk_violations(child, ["a", "b"], parent, ["c_custkey", "flag"], match_full=True)


@query("Q03_check_violations", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0)")
def check_violations(spark, sf_dir):
    return quality.check_violations(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal >= 0")


_DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@query(
    "Q04_not_null_violations",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'null' AS violation, count(*) FILTER ({c} IS NULL) AS n FROM documents" for c in _DOC_COLUMNS),
)
def not_null_violations(spark, sf_dir):
    return quality.not_null_violations(table(spark, sf_dir, "documents"), _DOC_COLUMNS)


@query(
    "Q05_pk_timeseries",
    """WITH i AS (SELECT user_id, epoch_us(ts) AS t, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM i)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (t IS NULL), 0) AS BIGINT) AS null_times, count(*) FILTER (n > 1) AS duplicate_instants, min(gap) AS min_gap, max(gap) AS max_gap FROM g GROUP BY 1""",
)
def pk_timeseries(spark, sf_dir):
    return quality.pk_timeseries(table(spark, sf_dir, "events"), "user_id", "ts")


_CONSTRAINTS = [
    {"table": "customer", "name": "pk_customer", "type": "primary_key", "columns": ["c_custkey"]},
    {"table": "lineitem", "name": "pk_lineitem", "type": "primary_key", "columns": ["l_orderkey", "l_linenumber"]},
    {"table": "orders", "name": "fk_customer", "type": "foreign_key", "columns": ["o_custkey"], "parent": "customer", "parent_columns": ["c_custkey"]},
    {"table": "documents", "name": "fk_labels", "type": "foreign_key", "columns": ["doc_id"], "parent": "labels", "parent_columns": ["doc_id"]},
    {"table": "customer", "name": "ck_balance", "type": "check", "expression": "c_acctbal >= 0"},
    {"table": "orders", "name": "nn_priority", "type": "not_null", "columns": ["o_orderpriority"]},
]


@query(
    "Q06_constraint_report",
    'SELECT "table", "constraint", rows, violations, ' + _LEVEL.format(n="violations") + """ AS level FROM (
    SELECT 'customer' AS "table", 'pk_customer' AS "constraint", count(*) AS rows, count(*) - count(DISTINCT c_custkey) AS violations FROM customer
    UNION ALL SELECT 'lineitem', 'pk_lineitem', count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
    UNION ALL SELECT 'orders', 'fk_customer', count(*), count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders
    UNION ALL SELECT 'documents', 'fk_labels', count(*), count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) FROM documents
    UNION ALL SELECT 'customer', 'ck_balance', count(*), count(*) FILTER (c_acctbal < 0) FROM customer
    UNION ALL SELECT 'orders', 'nn_priority', count(*), count(*) FILTER (o_orderpriority IS NULL) FROM orders)""",
)
def constraint_report(spark, sf_dir):
    names = {c["table"] for c in _CONSTRAINTS} | {c["parent"] for c in _CONSTRAINTS if "parent" in c}
    return quality.constraint_report({t: table(spark, sf_dir, t) for t in sorted(names)}, _CONSTRAINTS)


@query(
    "Q07_tag_coverage",
    """WITH c AS (SELECT * FROM [fx2_columns]), t AS (SELECT column_id, bool_or(key = 'pii') AS pii FROM [fx2_columntags] GROUP BY 1),
    j AS (SELECT c.table_id, coalesce(c.comment, '') <> '' AS noted, t.column_id IS NOT NULL AS tagged, coalesce(t.pii, false) AS pii FROM c LEFT JOIN t ON t.column_id = c.column_id)
    SELECT table_id, count(*) AS columns, round(avg(CASE WHEN noted THEN 1.0 ELSE 0.0 END), 4) AS commented, round(avg(CASE WHEN tagged THEN 1.0 ELSE 0.0 END), 4) AS tagged,
      round(avg(CASE WHEN pii THEN 1.0 ELSE 0.0 END), 4) AS pii FROM j GROUP BY ROLLUP (table_id)""",
)
def tag_coverage(spark, sf_dir):
    return quality.tag_coverage(fixture(spark, sf_dir, "fx2_columns"), fixture(spark, sf_dir, "fx2_columntags"))


_OWN_TAGS = "SELECT object_id, comment AS key FROM [fx3w_old] WHERE object_type = 'table' AND comment = 'BUILDING' UNION ALL SELECT column_id, key FROM [fx2_columntags]"


@query(
    "Q07_schema_coverage",
    f"""WITH tag AS (SELECT object_id, bool_or(key = 'pii') AS pii FROM ({_OWN_TAGS}) GROUP BY 1),
    t AS (SELECT parent_id AS schema_id, x.object_id AS table_id, coalesce(comment, '') <> '' AS noted, tag.object_id IS NOT NULL AS tagged, coalesce(pii, false) AS pii
      FROM ([fx3w_old]) x LEFT JOIN tag ON tag.object_id = x.object_id WHERE object_type = 'table'),
    c AS (SELECT table_id, count(*) AS n, count(*) FILTER (coalesce(comment, '') <> '') AS noted, count(tag.object_id) AS tagged, count(*) FILTER (pii) AS pii
      FROM ([fx2_columns]) x LEFT JOIN tag ON tag.object_id = x.column_id GROUP BY 1)
    SELECT schema_id, count(*) AS tables, round(avg(CASE WHEN t.noted THEN 1.0 ELSE 0.0 END), 4) AS tables_commented,
      round(avg(CASE WHEN t.tagged OR c.tagged > 0 THEN 1.0 ELSE 0.0 END), 4) AS tables_tagged, round(avg(CASE WHEN t.pii OR c.pii > 0 THEN 1.0 ELSE 0.0 END), 4) AS tables_pii,
      CAST(coalesce(sum(n), 0) AS BIGINT) AS columns, round(CAST(sum(c.noted) AS DOUBLE) / sum(n), 4) AS columns_commented,
      round(CAST(sum(c.tagged) AS DOUBLE) / sum(n), 4) AS columns_tagged, round(CAST(sum(c.pii) AS DOUBLE) / sum(n), 4) AS columns_pii
    FROM t LEFT JOIN c ON c.table_id = t.table_id GROUP BY ROLLUP (schema_id)""",
)
def schema_coverage(spark, sf_dir):
    objects = fixture(spark, sf_dir, "fx3w_old").where("object_type = 'table'")
    tables = objects.select(F.col("parent_id").alias("schema_id"), F.col("object_id").alias("table_id"), "comment")
    return quality.schema_coverage(tables, fixture(spark, sf_dir, "fx2_columns"), spark.sql(spark_text(_OWN_TAGS, sf_dir)))
