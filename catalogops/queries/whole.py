"""The whole difference of two states of a hierarchy with all that its objects carry."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from catalogops.operators import whole
from catalogops.plans.durable import durable
from catalogops.plans.fixtures import fixture
from catalogops.plans.ordered import position_within
from catalogops.queries.diff import _END, _last_constraints_sql, _tags_at_sql, live_constraints, tags_at
from catalogops.queries.fold import grants_at, grants_sql, log_end
from catalogops.queries.registry import query

_SIDES = {"old": ("o", f"{_END} // 2"), "new": ("n", _END)}
# The new state's tables of one in four have their columns the other way round.
_TURNED = {"old": "", "new": "CASE WHEN CAST(substr(parent_id, 5) AS BIGINT) % 4 = 1 THEN -1 ELSE 1 END * "}


def state(spark, sf_dir, name) -> whole.State:
    """One of the two states: objects and orders by rule, tags, constraints and grants from the logs at a point."""
    end = log_end(spark, sf_dir)
    at = end // 2 if name == "old" else end
    objects = durable(fixture(spark, sf_dir, f"fx3w_{name}"), "objects")
    table_of = lambda key: F.concat(F.lit("tbl_"), F.col(key).cast("string"))
    tags = tags_at(spark, sf_dir, at).select(table_of("object_id").alias("object_id"), F.lit("tag").alias("kind"), "key", "value")
    owned = objects.where("object_type IN ('schema', 'table')").select(
        "object_id", F.lit("property").alias("kind"), F.lit("owner").alias("key"), F.expr(f"CASE WHEN length(object_id) % 2 = 0 THEN 'all' ELSE '{name}' END").alias("value")
    )
    constraints = live_constraints(spark, sf_dir, at).select(table_of("table_id").alias("table_id"), F.col("constraint_id").cast("string").alias("constraint_id"), "type", "expression")
    columns = objects.where("object_type = 'column'").select(
        F.col("parent_id").alias("table_id"), F.col("object_id").alias("column_id"), F.expr(f"{_TURNED[name]}CAST(substr(object_id, 5) AS BIGINT)").alias("_at")
    )
    places = position_within(columns, ["table_id"], ["_at"], "position").drop("_at")
    grants = grants_at(spark, sf_dir, at).withColumn("target_id", table_of("target_id"))
    return whole.State(objects, tags.unionByName(owned), constraints, places, grants).consistent()


def _state_sql(name):
    s, at = _SIDES[name]
    has = lambda key: f"'tbl_' || {key} IN (SELECT object_id FROM {s})"
    return f"""{s} AS (SELECT * FROM [fx3w_{name}]), {_tags_at_sql(f'{s}_rawtag', at)}, {_last_constraints_sql(f'{s}_rawcon', at)},
    {s}_rawgrant AS ({grants_sql(at)}),
    {s}_entry AS (SELECT 'tbl_' || object_id AS object_id, 'tag' AS kind, key, value FROM {s}_rawtag WHERE {has('object_id')}
      UNION ALL SELECT object_id, 'property', 'owner', CASE WHEN length(object_id) % 2 = 0 THEN 'all' ELSE '{name}' END FROM {s} WHERE object_type IN ('schema', 'table')),
    {s}_con AS (SELECT 'tbl_' || table_id AS table_id, CAST(constraint_id AS VARCHAR) AS constraint_id, type, expression FROM {s}_rawcon WHERE {has('table_id')}),
    {s}_grant AS (SELECT 'tbl_' || target_id AS target_id, principal, string_agg(privilege, ',' ORDER BY privilege) AS list FROM {s}_rawgrant WHERE {has('target_id')} GROUP BY 1, 2),
    {s}_place AS (SELECT parent_id AS table_id, object_id AS column_id, row_number() OVER (PARTITION BY parent_id ORDER BY {_TURNED[name]}CAST(substr(object_id, 5) AS BIGINT)) - 1 AS position
      FROM {s} WHERE object_type = 'column')"""


_LEVEL = "CASE object_type WHEN 'catalog' THEN 0 WHEN 'schema' THEN 1 WHEN 'column' THEN 3 ELSE 2 END"
_NO_OBJECT = "SELECT * FROM [fx3w_old] WHERE false"


@cache
def diff_sql(a: str, b: str) -> str:
    """The log from side ``a`` to side ``b``, both ``o``, ``n`` or ``e`` (nothing), as common table expressions that end in ``placed``."""
    empty = f""", e AS ({_NO_OBJECT}), e_entry AS (SELECT * FROM o_entry WHERE false), e_con AS (SELECT * FROM o_con WHERE false),
      e_grant AS (SELECT * FROM o_grant WHERE false), e_place AS (SELECT * FROM o_place WHERE false)"""
    split = lambda x: f"string_split({x}, ',')"
    less = lambda x, y: f"array_to_string(list_sort(list_filter({split(x)}, lambda v: NOT list_contains({split(y)}, v))), ',')"
    return f"""WITH RECURSIVE {_state_sql('old')}, {_state_sql('new')}{empty},
    kept AS (SELECT n.object_id FROM {b} n JOIN {a} o ON o.object_id = n.object_id WHERE n.parent_id IS NULL AND o.parent_id IS NULL
      UNION ALL SELECT n.object_id FROM {b} n JOIN {a} o ON o.object_id = n.object_id AND o.parent_id = n.parent_id JOIN kept k ON k.object_id = n.parent_id),
    was_entry AS (SELECT * FROM {a}_entry WHERE object_id IN (FROM kept)), was_con AS (SELECT * FROM {a}_con WHERE table_id IN (FROM kept)),
    was_grant AS (SELECT * FROM {a}_grant WHERE target_id IN (FROM kept)), was_place AS (SELECT * FROM {a}_place WHERE column_id IN (FROM kept)),
    con AS (SELECT coalesce(o.table_id, n.table_id) AS t, coalesce(o.constraint_id, n.constraint_id) AS c, o.table_id IS NULL AS added, n.table_id IS NULL AS dropped,
      o.type <> n.type OR (o.type = 'check' AND o.expression <> n.expression) AS changed, n.type || ': ' || n.expression AS body
      FROM was_con o FULL JOIN {b}_con n ON n.table_id = o.table_id AND n.constraint_id = o.constraint_id),
    due AS (SELECT p.*, row_number() OVER (PARTITION BY p.table_id ORDER BY w.position IS NULL, coalesce(w.position, p.position), p.column_id) - 1 AS due
      FROM {b}_place p LEFT JOIN was_place w ON w.column_id = p.column_id AND w.table_id = p.table_id),
    g AS (SELECT coalesce(o.target_id, n.target_id) AS t, coalesce(o.principal, n.principal) AS p, coalesce(o.list, '') AS was, coalesce(n.list, '') AS now
      FROM was_grant o FULL JOIN {b}_grant n ON n.target_id = o.target_id AND n.principal = o.principal),
    ops AS (
      SELECT 0 AS phase, -{_LEVEL} AS level, 0 AS place, 'drop_' || object_type AS op, object_id AS target, NULL AS key, NULL AS value FROM {a}
        WHERE object_id NOT IN (FROM kept) AND (parent_id IS NULL OR parent_id IN (FROM kept))
      UNION ALL SELECT 1, {_LEVEL}, coalesce(p.position, 0), 'add_' || object_type, x.object_id, parent_id, name FROM {b} x LEFT JOIN {b}_place p ON p.column_id = x.object_id WHERE x.object_id NOT IN (FROM kept)
      UNION ALL SELECT 2, {_LEVEL}, 0, 'set_' || object_type || '_comment', object_id, NULL, comment FROM {b} WHERE object_id NOT IN (FROM kept) AND comment IS NOT NULL
      UNION ALL SELECT 2, {_LEVEL.replace('object_type', 'n.object_type')}, 0, 'rename_' || n.object_type, n.object_id, NULL, n.name FROM {b} n JOIN {a} o ON o.object_id = n.object_id
        WHERE n.object_id IN (FROM kept) AND n.name IS DISTINCT FROM o.name
      UNION ALL SELECT 2, {_LEVEL.replace('object_type', 'n.object_type')}, 0, 'set_' || n.object_type || '_comment', n.object_id, NULL, n.comment FROM {b} n JOIN {a} o ON o.object_id = n.object_id
        WHERE n.object_id IN (FROM kept) AND n.comment IS DISTINCT FROM o.comment
      UNION ALL SELECT 3, 0, 0, CASE WHEN n.object_id IS NULL THEN 'unset_' ELSE 'set_' END || coalesce(o.kind, n.kind), coalesce(o.object_id, n.object_id), coalesce(o.key, n.key), n.value
        FROM was_entry o FULL JOIN {b}_entry n ON n.object_id = o.object_id AND n.kind = o.kind AND n.key = o.key WHERE o.object_id IS NULL OR n.object_id IS NULL OR o.value IS DISTINCT FROM n.value
      UNION ALL SELECT 4, 0, 0, 'drop_constraint', t, c, NULL FROM con WHERE dropped OR changed
      UNION ALL SELECT 4, 0, 1, 'add_constraint', t, c, body FROM con WHERE added OR changed
      UNION ALL SELECT 5, 0, position, 'place_column', table_id, column_id, CAST(position AS VARCHAR) FROM due WHERE table_id IN (SELECT table_id FROM due WHERE due <> position)
      UNION ALL SELECT 6, 0, 0, 'revoke_grant', t, p, {less('was', 'now')} FROM g WHERE {less('was', 'now')} <> ''
      UNION ALL SELECT 6, 0, 1, 'add_grant', t, p, now FROM g WHERE {less('now', 'was')} <> ''),
    placed AS (SELECT row_number() OVER (ORDER BY phase, level, place, target, op, coalesce(key, '')) AS seq, op, target, key, value FROM ops) """


@query("D10_whole_diff", diff_sql("o", "n") + "SELECT * FROM placed")
def whole_diff(spark, sf_dir):
    return whole.whole_diff(state(spark, sf_dir, "old"), state(spark, sf_dir, "new"))


@query("D11_whole_summary", diff_sql("o", "n") + "SELECT op, count(*) AS n FROM placed GROUP BY 1")
def whole_summary(spark, sf_dir):
    return whole_diff(spark, sf_dir).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("D12_whole_first_version", diff_sql("e", "o") + "SELECT * FROM placed")
def first_version(spark, sf_dir):
    """The first version has nothing before it: every object is added with all it carries."""
    first = state(spark, sf_dir, "old")
    return whole.whole_diff(first.nothing(), first)


@query("H09_whole_rollback", diff_sql("n", "o") + "SELECT * FROM placed")
def whole_rollback(spark, sf_dir):
    return whole.whole_diff(state(spark, sf_dir, "new"), state(spark, sf_dir, "old"))
