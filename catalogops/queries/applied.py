"""Rules, schema changes, views and functions on data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalogops.functions.privileges import legal_values_sql
from catalogops.operators import evolve, fold, secure, views
from catalogops.plans.fixtures import fixture, spark_text, table
from catalogops.queries.fold import grants_at, grants_sql
from catalogops.queries.registry import query
from catalogops.session import fresh_path

_ALLOWED = "SELECT concat('user_', CAST(n_regionkey AS STRING)) AS user, n_nationkey AS c_nationkey FROM «nation»"


@query(
    "R01_apply_row_filter",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND (c_mktsegment <> 'MACHINERY')
    AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE concat('user_', n_regionkey) = 'user_2')""",
)
def apply_row_filter(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    seen = secure.apply_row_filter(customer, ["c_acctbal > 0", "c_mktsegment <> 'MACHINERY' OR current_user() = 'admin'"], "user_2")
    return secure.restrict_by_map(seen, spark.sql(spark_text(_ALLOWED, sf_dir)), ["c_nationkey"], "user_2").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal"
    )


@query(
    "R02_apply_column_masks",
    """SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, round(c_acctbal / 1000) * 1000 AS c_acctbal, CASE WHEN c_nationkey < 10 THEN c_mktsegment ELSE '***' END AS c_mktsegment FROM customer""",
)
def apply_column_masks(spark, sf_dir):
    return secure.apply_column_masks(
        table(spark, sf_dir, "customer"),
        {"c_name": "sha2(c_name, 256)", "c_acctbal": "round(c_acctbal / 1000) * 1000", "c_mktsegment": "CASE WHEN c_nationkey < 10 THEN c_mktsegment ELSE '***' END"},
    )


@query("R02_mask_documents", r"SELECT * REPLACE (regexp_replace(text, '[0-9]', '#', 'g') AS text) FROM documents")
def mask_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secure.apply_column_masks(docs, {"text": "regexp_replace(text, '[0-9]', '#')"})


# The first principal and target, in order, that may and may not read.
_READERS = f"g AS ({grants_sql()}), t AS (SELECT min(target_id) AS target_id FROM g WHERE principal = 'p1' AND privilege = 'SELECT')"


@query(
    "R03_secure_view",
    f"""WITH {_READERS} SELECT c_custkey, concat(substr(c_name, 1, 1), '***') AS c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 12
    AND EXISTS (SELECT 1 FROM g JOIN t ON t.target_id = g.target_id WHERE g.principal = 'p1' AND g.privilege = 'SELECT')""",
)
def secure_view(spark, sf_dir):
    grants = grants_at(spark, sf_dir)
    target = grants.where("principal = 'p1' AND privilege = 'SELECT'").agg(F.min("target_id")).first()[0]
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return secure.secure_view(customer, ["c_nationkey < 12"], {"c_name": "concat(left(c_name, 1), '***')"}, grants, "p1", target)


@query(
    "R04_access_matrix",
    f"""WITH legal(object_type, privilege) AS (VALUES {legal_values_sql()}), g AS ({grants_sql()}),
    k AS (SELECT target_id, principal, CASE target_id % 2 WHEN 0 THEN 'table' ELSE 'view' END AS object_type, CASE privilege WHEN 'MODIFY' THEN 'ALL PRIVILEGES' ELSE privilege END AS privilege FROM g),
    x AS (SELECT * FROM k WHERE privilege <> 'ALL PRIVILEGES' UNION SELECT k.target_id, k.principal, k.object_type, l.privilege FROM k JOIN legal l ON l.object_type = k.object_type
      WHERE k.privilege = 'ALL PRIVILEGES' AND l.privilege <> 'ALL PRIVILEGES')
    SELECT principal, object_type, privilege, count(*) AS n FROM x GROUP BY 1, 2, 3""",
)
def access_matrix(spark, sf_dir):
    grants = grants_at(spark, sf_dir).select(
        "target_id", "principal", F.when(F.col("target_id") % 2 == 0, "table").otherwise("view").alias("object_type"),
        F.when(F.col("privilege") == "MODIFY", "ALL PRIVILEGES").otherwise(F.col("privilege")).alias("privilege"),
    )
    return secure.access_matrix(grants)


# The tag a column of customer carries is told by the column tags of the log's first objects.
@query("R05_mask_by_tag", "SELECT c_custkey, sha256(c_name) AS c_name, c_mktsegment FROM customer")
def mask_by_tag(spark, sf_dir):
    tags = fixture(spark, sf_dir, "fx2_columntags").groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("key") == "pii", "c_name").otherwise("c_mktsegment").alias("column"), "key"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return secure.mask_by_tag(customer, tags, "pii", "sha2({column}, 256)")


@query("E01_add_column", "SELECT *, NULL::VARCHAR AS note, 'std' AS tier FROM customer")
def add_column(spark, sf_dir):
    return evolve.add_column(
        evolve.add_column(table(spark, sf_dir, "customer"), "note", "string"), "tier", "string", nullable=False, default="std"
    )


@query("E02_drop_column", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def drop_column(spark, sf_dir):
    return evolve.drop_column(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("E03_rename_column", "SELECT c_custkey AS id, c_name AS c_mktsegment, c_nationkey, c_acctbal, c_mktsegment AS c_name FROM customer")
def rename_column(spark, sf_dir):
    ops = [
        {"op": "rename_column", "column_id": "c_name", "newName": "tmp"},
        {"op": "rename_column", "column_id": "c_mktsegment", "newName": "c_name"},
        {"op": "rename_column", "column_id": "c_name", "newName": "c_mktsegment"},
        {"op": "rename_column", "column_id": "c_custkey", "newName": "id"},
    ]
    return evolve.evolve(table(spark, sf_dir, "customer"), ops)


@query("E04_change_type", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INT) AS l_quantity, NULL::INT AS l_returnflag FROM lineitem")
def change_type(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return evolve.change_type(evolve.change_type(rows, "l_quantity", "int"), "l_returnflag", "int")


@query("E05_set_nullable", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def set_nullable(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return evolve.set_not_null(rows, ["o_orderkey", "o_orderpriority"])


@query("E06_reorder_columns", "SELECT p_retailprice, p_partkey, p_name, p_brand, p_size, p_type FROM part")
def reorder_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return evolve.reorder_columns(evolve.reorder_columns(part, "p_retailprice", first=True), "p_type", after="p_size")


@query(
    "E07_evolve",
    "SELECT 'std' AS tier, c_custkey AS id, c_name AS full_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal FROM customer",
)
def evolve_(spark, sf_dir):
    ops = [
        {"op": "add_column", "column_id": "t", "name": "level", "type": "string", "nullable": False, "default": "std"},
        {"op": "rename_column", "column_id": "c_custkey", "newName": "id"},
        {"op": "rename_column", "column_id": "c_name", "newName": "name"},
        {"op": "rename_column", "column_id": "c_name", "newName": "full_name"},
        {"op": "change_column_type", "column_id": "c_nationkey", "newType": "string"},
        {"op": "drop_column", "column_id": "c_mktsegment"},
        {"op": "rename_column", "column_id": "t", "newName": "tier"},
        {"op": "reorder_columns", "order": ["t", "c_custkey"]},
    ]
    return evolve.evolve(table(spark, sf_dir, "customer"), ops)


_DECLARED = [("event_id", "BIGINT"), ("user_id", "INT"), ("event_type", "STRING"), ("value", "INT"), ("country", "STRING")]


@query(
    "E08_conform",
    """SELECT event_id, CAST(user_id AS INT) AS user_id, event_type, CAST(trunc(value) AS INT) AS value, NULL::VARCHAR AS country,
    CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, epoch_us(CAST(ts AS TIMESTAMP)) AS micros FROM events""",
)
def conform(spark, sf_dir):
    rows = evolve.conform(table(spark, sf_dir, "events"), _DECLARED, extras="rest")
    rest = lambda name: F.variant_get("rest", f"$.{name}", "string")
    told = rows.withColumns({"k": F.get_json_object(rest("props"), "$.k").cast("int"), "micros": F.unix_micros(rest("ts").cast("timestamp"))})
    return told.drop("rest")


@query(
    "E08_conform_problems",
    """SELECT 'country' AS "column", 'missing' AS problem, 0::BIGINT AS n UNION ALL SELECT 'ts', 'extra', 0 UNION ALL SELECT 'props', 'extra', 0
    UNION ALL SELECT 'event_type', 'not_castable', count(*) FROM events""",
)
def conform_problems(spark, sf_dir):
    declared = [(n, "INT" if n == "event_type" else t) for n, t in _DECLARED]
    return evolve.conform_problems(table(spark, sf_dir, "events"), declared)


@query(
    "E09_merge_versions",
    "SELECT c_custkey AS id, c_name AS full_name, c_nationkey AS nation, CASE WHEN c_custkey % 3 = 2 THEN c_acctbal END AS balance FROM customer",
)
def merge_versions(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    first = customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"))
    second = customer.where("c_custkey % 3 = 1").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    third = customer.where("c_custkey % 3 = 2").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")
    )
    renames = [
        {"op": "rename_column", "column_id": "1", "newName": "id"}, {"op": "rename_column", "column_id": "2", "newName": "full_name"},
        {"op": "change_column_type", "column_id": "3", "newType": "int"},
    ]
    old = {"1": "key", "2": "name", "3": "nation"}
    return evolve.merge_versions(
        [(first, renames, old), (second, renames, old), (third, [], {"1": "id", "2": "full_name", "3": "nation", "4": "balance"})]
    )


_ENRICHED = """SELECT o_orderkey, o_custkey, c_name, c_nationkey, o_totalprice, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey"""


@query("V01_register_views", f"SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM ({_ENRICHED}) GROUP BY 1")
def register_views(spark, sf_dir):
    views.register_views(
        spark,
        {
            "by_nation_view": "SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM enriched_view GROUP BY c_nationkey",
            "enriched_view": f"SELECT o.*, c.c_nationkey FROM parquet.`{sf_dir}/orders.parquet` o JOIN parquet.`{sf_dir}/customer.parquet` c ON o.o_custkey = c.c_custkey",
        },
    )
    return spark.table("by_nation_view")


@query("V02_orders_enriched", _ENRICHED)
def orders_enriched(spark, sf_dir):
    return views.orders_enriched(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")).drop("o_orderdate")


@query(
    "V03_orders_by_country",
    "SELECT n_name AS country, count(*) AS order_count, round(sum(o_totalprice), 2) AS total_amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def orders_by_country(spark, sf_dir):
    return views.orders_by_country(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"))


_DAILY = "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS cnt, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _daily(events):
    return events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("V04_refresh_mv", _DAILY)
def refresh_mv(spark, sf_dir):
    result = _daily(table(spark, sf_dir, "events")).agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("value"), 4).alias("total"))
    return views.refresh_mv(result, fresh_path(spark, "mv"), 1)


@query("V05_refresh_mv_incremental", _DAILY)
def refresh_mv_incremental(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    half = events.agg(F.max("event_id")).first()[0] // 2
    target = fresh_path(spark, "mv")
    partial = {"cnt": F.count(F.lit(1)), "total": F.sum("value")}
    first = events.where(F.col("event_id") <= half).groupBy("event_type", "day").agg(*[c.alias(n) for n, c in partial.items()])
    views.refresh_mv(first, target, 1, half)
    now = views.refresh_mv_incremental(
        events, "event_id", target, ["event_type", "day"], partial, {"cnt": F.sum("cnt"), "total": F.sum("total")}
    )
    return now.withColumn("total", F.round("total", 4))


_MVS = """SELECT concat('vw_', CAST(o_orderkey AS STRING)) AS mv_id, CAST(o_orderdate AS TIMESTAMP) AS last_refresh,
CASE WHEN o_orderkey % 2 = 1 THEN 86400 * (o_orderkey % 3000) END AS every_seconds FROM «orders»"""
_CHANGED = "SELECT concat('vw_', CAST(o_orderkey AS STRING)) AS node_id, CAST(o_orderdate AS TIMESTAMP) AS changed_at FROM «orders»"


@query(
    "V06_mv_due",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT from_id, to_id FROM [fx5_edges]), m AS ({_MVS}), ch AS ({_CHANGED}),
    r AS (SELECT mv_id AS root_id, mv_id AS node_id, 0 AS d FROM m UNION SELECT r.root_id, e.from_id, 1 FROM r JOIN e ON e.to_id = r.node_id),
    newest AS (SELECT root_id, max(changed_at) AS newest FROM r JOIN ch ON ch.node_id = r.node_id WHERE d > 0 GROUP BY 1),
    x AS (SELECT mv_id, CASE WHEN every_seconds IS NOT NULL AND epoch_us(TIMESTAMP '2000-01-01 00:00:00') - epoch_us(last_refresh) >= every_seconds * 1000000 THEN 'schedule' WHEN newest > last_refresh THEN 'upstream' END AS reason
      FROM m LEFT JOIN newest ON root_id = mv_id)
    SELECT mv_id, reason IS NOT NULL AS due, reason FROM x""",
)
def mv_due(spark, sf_dir):
    return views.mv_due(
        spark.sql(spark_text(_MVS, sf_dir)), fixture(spark, sf_dir, "fx5_edges"), spark.sql(spark_text(_CHANGED, sf_dir)),
        dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc),
    )


@query("V07_register_sql_function", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def register_sql_function(spark, sf_dir):
    views.register_sql_function(spark, "net_price", "price DOUBLE, discount DOUBLE, tax DOUBLE DEFAULT 0.0", "DOUBLE", "price * (1 - discount) * (1 + tax)")
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "net_price(l_extendedprice, l_discount) AS net", "net_price(l_extendedprice, l_discount, l_tax) AS gross"
    )


@query("V08_register_python_function", "SELECT l_orderkey, l_linenumber, round(l_quantity / ((1 + l_tax) * (1 + l_tax)), 4) AS bmi FROM lineitem")
def register_python_function(spark, sf_dir):
    views.register_python_function(spark, "bmi", views.bmi, "double")
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "round(bmi(l_quantity, 1 + l_tax), 4) AS bmi")


@query("V09_register_table_function", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def register_table_function(spark, sf_dir):
    views.register_table_function(
        spark, "orders_with", "wanted STRING, least DOUBLE DEFAULT 1000.0", "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE",
        f"SELECT o_orderkey, o_custkey, o_totalprice FROM parquet.`{sf_dir}/orders.parquet` WHERE o_orderstatus = wanted AND o_totalprice >= least",
    )
    return spark.sql("SELECT * FROM orders_with('F')")
