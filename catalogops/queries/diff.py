"""Change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.operators import diff, fold
from catalogops.plans.durable import durable
from catalogops.plans.fixtures import fixture
from catalogops.plans.ordered import position_within
from catalogops.queries.fold import (
    COLUMNS_SQL, column_log, grants_at, grants_sql, log_end, table_events, table_tags,
)
from catalogops.queries.registry import query


def versions(spark, sf_dir):
    return fixture(spark, sf_dir, "fx3_old"), fixture(spark, sf_dir, "fx3_new")


@query(
    "D01_diff_keys",
    """SELECT coalesce(o.id, n.id) AS object_id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'dropped' ELSE 'kept' END AS change
    FROM [fx3_old] o FULL JOIN [fx3_new] n ON n.id = o.id""",
)
def diff_keys(spark, sf_dir):
    return diff.diff_keys(*versions(spark, sf_dir), ["id"]).withColumnRenamed("id", "object_id")


def _fields_sql(fields, key="object_id"):
    return " UNION ALL ".join(
        f"SELECT o.id AS {key}, '{f}' AS field, CAST(o.{f} AS VARCHAR) AS old_value, CAST(n.{f} AS VARCHAR) AS new_value "
        f"FROM o JOIN n ON n.id = o.id WHERE o.{f} IS DISTINCT FROM n.{f}"
        for f in fields
    )


_BOTH = "WITH o AS (SELECT * FROM [fx3_old]), n AS (SELECT * FROM [fx3_new]) "


@query("D02_diff_fields", _BOTH + _fields_sql(["name", "comment", "nation"]))
def diff_fields(spark, sf_dir):
    rows = diff.diff_fields(*versions(spark, sf_dir), ["id"], ["name", "comment", "nation"])
    return rows.withColumnRenamed("id", "object_id")


# Rename records: two of three renamed customers have one, some with another new name.
_RENAMES = """SELECT c_custkey AS object_id, c_name AS old_name, concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN '_x' ELSE '_y' END) AS new_name
FROM «customer» WHERE c_custkey % 11 = 5 AND c_custkey % 3 <> 0"""


@query(
    "D03_detect_renames",
    _BOTH + f""", r AS ({_RENAMES}) SELECT o.id AS object_id, o.name AS old_name, n.name AS new_name,
    EXISTS (SELECT 1 FROM r WHERE r.object_id = o.id AND r.old_name = o.name AND r.new_name = n.name) AS in_history
    FROM o JOIN n ON n.id = o.id WHERE o.name <> n.name""",
)
def detect_renames(spark, sf_dir):
    from catalogops.plans.fixtures import spark_text

    return diff.detect_renames(*versions(spark, sf_dir), "id", spark.sql(spark_text(_RENAMES, sf_dir)))


def tags_at(spark, sf_dir, at):
    events, tags = table_events(spark, sf_dir), table_tags(spark, sf_dir)
    return fold.snapshot_of(events, tags, at)[1]


def _tags_at_sql(name, at):
    return f"""
    {name}_ev AS (SELECT target AS object_id, seq, op FROM [fx1_oplog] WHERE seq <= {at}),
    {name}_drop AS (SELECT object_id, max(seq) AS last FROM {name}_ev WHERE op = 'drop_table' GROUP BY 1),
    {name}_alive AS (SELECT e.object_id, min(e.seq) AS start_seq FROM {name}_ev e LEFT JOIN {name}_drop d ON d.object_id = e.object_id
      WHERE op = 'add_table' AND e.seq > coalesce(d.last, -1) GROUP BY 1),
    {name} AS (SELECT t.object_id, key, value FROM (SELECT target AS object_id, tag_name AS key, arg_max(tag_value, seq) AS value, arg_max(op, seq) AS op, max(seq) AS last
      FROM [fx1_oplog] WHERE seq <= {at} AND op IN ('set_table_tag', 'unset_table_tag') GROUP BY 1, 2) t
      JOIN {name}_alive a ON a.object_id = t.object_id WHERE op = 'set_table_tag' AND last > start_seq)"""


_END = "(SELECT max(seq) FROM [fx1_oplog])"


@query(
    "D04_diff_map",
    f"""WITH {_tags_at_sql('o', f'{_END} // 2')}, {_tags_at_sql('n', _END)}
    SELECT coalesce(o.object_id, n.object_id) AS object_id, 'tag' AS kind, coalesce(o.key, n.key) AS key,
      CASE WHEN n.object_id IS NULL THEN 'unset' ELSE 'set' END AS action, n.value
    FROM o FULL JOIN n ON n.object_id = o.object_id AND n.key = o.key WHERE o.value IS DISTINCT FROM n.value""",
)
def diff_map(spark, sf_dir):
    end = log_end(spark, sf_dir)
    rows = diff.diff_map(tags_at(spark, sf_dir, end // 2), tags_at(spark, sf_dir, end), "object_id")
    return rows.select("object_id", F.lit("tag").alias("kind"), "key", "action", "value")


@query(
    "D05_diff_container_meta",
    _BOTH + """, c AS (SELECT o.id, o.comment IS DISTINCT FROM n.comment AS dc, o.name IS DISTINCT FROM n.name AS dn, n.comment, n.name FROM o JOIN n ON n.id = o.id)
    SELECT id AS object_id, '{' || concat_ws(',', CASE WHEN dc THEN '"comment":"' || coalesce(comment, '') || '"' END, CASE WHEN dn THEN '"name":"' || name || '"' END) || '}' AS payload
    FROM c WHERE dc OR dn""",
)
def diff_container_meta(spark, sf_dir):
    rows = diff.diff_container_meta(*versions(spark, sf_dir), "id", ["comment", "name"])
    return rows.withColumnRenamed("id", "object_id")


def _last_constraints_sql(name, at):
    """Live constraints by the last event per id; an add over a live one is ignored."""
    return f"""
    {name}_t AS (SELECT * FROM (SELECT *, lag(op) OVER (PARTITION BY table_id, constraint_id ORDER BY seq) AS before FROM [fx1k_constraintlog] WHERE seq <= {at})
      WHERE op <> coalesce(before, 'drop_constraint')),
    {name} AS (SELECT table_id, constraint_id, arg_max(type, seq) AS type, arg_max(expression, seq) AS expression, arg_max(op, seq) AS op FROM {name}_t GROUP BY 1, 2 HAVING arg_max(op, seq) = 'add_constraint')"""


def live_constraints(spark, sf_dir, at):
    log = fixture(spark, sf_dir, "fx1k_constraintlog").where(F.col("seq") <= at)
    events = log.select(
        "table_id", "constraint_id", "seq", F.when(F.col("op") == "add_constraint", "add").otherwise("drop").alias("kind"), "type", "expression"
    )
    return fold.live(fold.lifetimes(events, ["table_id", "constraint_id"])).drop("start_seq")


@query(
    "D06_diff_constraints",
    f"""WITH {_last_constraints_sql('o', f'{_END} // 2')}, {_last_constraints_sql('n', _END)},
    j AS (SELECT coalesce(o.table_id, n.table_id) AS table_id, coalesce(o.constraint_id, n.constraint_id) AS constraint_id, o.table_id IS NULL AS added, n.table_id IS NULL AS dropped,
      o.type <> n.type OR (o.type = 'check' AND o.expression <> n.expression) AS changed
      FROM o FULL JOIN n ON n.table_id = o.table_id AND n.constraint_id = o.constraint_id)
    SELECT table_id, constraint_id, 'add_constraint' AS action, 0 AS step FROM j WHERE added
    UNION ALL SELECT table_id, constraint_id, 'drop_constraint', 0 FROM j WHERE dropped OR changed
    UNION ALL SELECT table_id, constraint_id, 'add_constraint', 1 FROM j WHERE changed""",
)
def diff_constraints(spark, sf_dir):
    end = log_end(spark, sf_dir)
    return diff.diff_constraints(live_constraints(spark, sf_dir, end // 2), live_constraints(spark, sf_dir, end))


_GRANT_SIDES = f"""o AS ({grants_sql(f'{_END} // 2')}), n AS ({grants_sql()})"""


@query(
    "D07_diff_grants",
    f"""WITH {_GRANT_SIDES},
    finals AS (SELECT target_id, principal, string_agg(privilege, ',' ORDER BY privilege) AS privileges FROM n GROUP BY 1, 2),
    lost AS (SELECT target_id, principal, string_agg(privilege, ',' ORDER BY privilege) AS delta FROM (SELECT * FROM o EXCEPT SELECT * FROM n) GROUP BY 1, 2),
    won AS (SELECT target_id, principal, string_agg(privilege, ',' ORDER BY privilege) AS delta FROM (SELECT * FROM n EXCEPT SELECT * FROM o) GROUP BY 1, 2)
    SELECT l.target_id, l.principal, 'revoke_grant' AS action, delta, coalesce(privileges, '') AS privileges FROM lost l LEFT JOIN finals f ON f.target_id = l.target_id AND f.principal = l.principal
    UNION ALL SELECT w.target_id, w.principal, 'add_grant', delta, privileges FROM won w JOIN finals f ON f.target_id = w.target_id AND f.principal = w.principal""",
)
def diff_grants(spark, sf_dir):
    return diff.diff_grants(grants_at(spark, sf_dir, log_end(spark, sf_dir) // 2), grants_at(spark, sf_dir))


# Two column orders over the same columns: the live order now, and an older one in which one table
# in four has its first column second, and one in four stands by column id.
ORDER_PAIR_SQL = "WITH " + COLUMNS_SQL.format(where="") + """,
newo AS (SELECT table_id, list(column_id ORDER BY position) AS new_cols FROM placed GROUP BY 1),
oldo AS (SELECT table_id, list(column_id ORDER BY CASE WHEN table_id % 4 = 1 AND position = 0 THEN 1.5 WHEN table_id % 4 = 2 THEN column_id ELSE position END) AS old_cols FROM placed GROUP BY 1),
pairs AS (SELECT table_id, old_cols, new_cols FROM oldo JOIN newo USING (table_id))
"""


def order_pair(spark, sf_dir):
    new = durable(fold.fold_column_order(column_log(spark, sf_dir)), "order")
    place = (
        F.when((F.col("table_id") % 4 == 1) & (F.col("position") == 0), F.lit(1.5))
        .when(F.col("table_id") % 4 == 2, F.col("column_id").cast("double"))
        .otherwise(F.col("position").cast("double"))
    )
    moved = new.select("table_id", "column_id", place.alias("_place"))
    old = position_within(moved, ["table_id"], ["_place"], "position").drop("_place")
    return old, new


@query(
    "D08_diff_column_order",
    ORDER_PAIR_SQL + """, e AS (SELECT table_id, unnest(old_cols) AS o, unnest(new_cols) AS n FROM pairs)
    SELECT table_id, count(*) FILTER (o <> n) AS moved FROM e GROUP BY 1 HAVING count(*) FILTER (o <> n) > 0""",
)
def diff_column_order(spark, sf_dir):
    return diff.diff_column_order(*order_pair(spark, sf_dir))


LEVELS = (("catalog",), ("schema",), ("table", "view"), ("column",))
_ADDED = "SELECT object_id FROM [fx2_objects] WHERE object_type = 'schema' AND name LIKE 'i%' OR object_type = 'table' AND name LIKE 't_1%'"


@query(
    "D09_expand_added",
    f"""WITH RECURSIVE o AS (SELECT * FROM [fx2_objects]), r AS (SELECT o.* FROM o WHERE object_id IN ({_ADDED})
      UNION SELECT c.* FROM o c JOIN r ON r.object_id = c.parent_id)
    SELECT CASE object_type WHEN 'catalog' THEN 0 WHEN 'schema' THEN 1 WHEN 'column' THEN 3 ELSE 2 END AS depth, 'add_' || object_type AS op, object_id AS target, name AS detail FROM r""",
)
def expand_added(spark, sf_dir):
    objects = fixture(spark, sf_dir, "fx2_objects")
    added = objects.where(
        "(object_type = 'schema' AND name LIKE 'i%') OR (object_type = 'table' AND name LIKE 't_1%')"
    ).select("object_id")
    return diff.expand_added(added, objects, LEVELS)


_OPS = _BOTH + """, ops AS (
  SELECT 0 AS r, 'add_table' AS op, CAST(n.id AS VARCHAR) AS target, n.name AS detail, 0 AS phase FROM n WHERE id NOT IN (SELECT id FROM o)
  UNION ALL SELECT 0, CASE field WHEN 'name' THEN 'rename_table' ELSE 'set_table_' || field END, CAST(object_id AS VARCHAR), new_value, 1 FROM (""" + _fields_sql(["name", "comment"]) + """)
  UNION ALL SELECT 2, 'drop_table', CAST(o.id AS VARCHAR), NULL, 2 FROM o WHERE id NOT IN (SELECT id FROM n)),
placed AS (SELECT row_number() OVER (ORDER BY r, phase, target, op) AS seq, op, target, detail FROM ops) """


def fx3_ops(spark, sf_dir, swap=False):
    old, new = versions(spark, sf_dir)
    if swap:
        old, new = new, old
    return diff.diff_to_ops([diff.row_ops(old, new, "id", "table", ["comment"])])


@query("D10_diff_to_ops", _OPS + "SELECT seq, op, target, detail FROM placed")
def diff_to_ops(spark, sf_dir):
    return fx3_ops(spark, sf_dir)


@query("D11_diff_summary", _OPS + "SELECT op, count(*) AS n FROM placed GROUP BY 1")
def diff_summary(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return diff.diff_summary(diff.row_ops(old, new, "id", "table", ["comment"]))


@query(
    "D12_diff_versions",
    _BOTH + """SELECT row_number() OVER (ORDER BY CAST(id AS VARCHAR)) AS seq, 'add_table' AS op, CAST(id AS VARCHAR) AS target, name AS detail, 'v0.1.0' AS to_version FROM o
    UNION ALL SELECT seq, op, target, detail, 'v0.2.0' FROM (""" + _OPS.replace("WITH", "WITH", 1) + "SELECT seq, op, target, detail FROM placed)",
)
def diff_versions(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    snapshots = old.withColumn("version", F.lit("v0.1.0")).unionByName(new.withColumn("version", F.lit("v0.2.0")))
    first = diff.diff_versions(snapshots, None, "v0.1.0", "id", "table", ["comment"])
    second = diff.diff_versions(snapshots, "v0.1.0", "v0.2.0", "id", "table", ["comment"])
    return first.withColumn("to_version", F.lit("v0.1.0")).unionByName(second.withColumn("to_version", F.lit("v0.2.0")))


@query(
    "D13_diff_tables",
    _BOTH + "SELECT field, count(*) AS n FROM (" + _fields_sql(["name", "comment", "nation", "bal"]) + ") GROUP BY 1",
)
def diff_tables(spark, sf_dir):
    return diff.change_counts(diff.diff_tables(*versions(spark, sf_dir), ["id"]))


@query("D13_changed_cells", _BOTH + _fields_sql(["name", "comment", "nation", "bal"]))
def changed_cells(spark, sf_dir):
    return diff.diff_tables(*versions(spark, sf_dir), ["id"]).withColumnRenamed("id", "object_id")


_DISCOVERED = "SELECT id + 5000000 AS id, name, comment FROM [fx3_new] WHERE name NOT LIKE '%_x'"


@query(
    "D14_drift_report",
    f"""WITH o AS (SELECT id, name, comment FROM [fx3_old]), found AS ({_DISCOVERED}),
    n AS (SELECT coalesce(o.id, f.id) AS id, f.name, f.comment FROM found f LEFT JOIN (SELECT name, min(id) AS id FROM o GROUP BY 1) o ON o.name = f.name)
    SELECT 'add_table' AS op, n.id AS target, name AS detail FROM n WHERE id NOT IN (SELECT id FROM o)
    UNION ALL SELECT 'set_table_comment', object_id, new_value FROM ({_fields_sql(['comment'])})
    UNION ALL SELECT 'drop_table', id, NULL FROM o WHERE id NOT IN (SELECT id FROM n)""",
)
def drift_report(spark, sf_dir):
    from catalogops.operators.inventory import adopt_ids

    old, new = versions(spark, sf_dir)
    found = new.where("name NOT LIKE '%_x'").select((F.col("id") + 5000000).alias("id"), "name", "comment").distinct()
    known = old.select("id", "name")
    adopted = adopt_ids(found.withColumnRenamed("id", "found_id"), known, ["name"], F.col("found_id"))
    return diff.row_ops(
        old.select("id", "name", "comment"), adopted.select(F.col("object_id").alias("id"), "name", "comment"), "id", "table", ["comment"]
    ).select("op", "target", "detail")


@query(
    "D15_diff_two_level",
    """WITH o AS (SELECT DISTINCT nation AS id FROM [fx3_old] WHERE nation < 20), n AS (SELECT DISTINCT nation AS id FROM [fx3_new] WHERE nation > 3)
    SELECT coalesce(o.id, n.id) AS object_id, CASE WHEN o.id IS NULL THEN 'add_database' ELSE 'drop_database' END AS op
    FROM o FULL JOIN n ON n.id = o.id WHERE o.id IS NULL OR n.id IS NULL""",
)
def diff_two_level(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    before = old.where("nation < 20").select(F.col("nation").alias("object_id")).distinct()
    after = new.where("nation > 3").select(F.col("nation").alias("object_id")).distinct()
    rows = diff.diff_keys(before, after, ["object_id"]).where("change <> 'kept'")
    return rows.select("object_id", F.when(F.col("change") == "added", "add_database").otherwise("drop_database").alias("op"))
