"""Folds of the change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.operators import fold
from catalogops.plans.durable import durable
from catalogops.plans.fixtures import fixture
from catalogops.queries.registry import query


def table_events(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1_oplog")
    return log.where(F.col("op").isin("add_table", "drop_table")).select(
        F.col("target").alias("object_id"), "seq",
        F.when(F.col("op") == "add_table", "add").otherwise("drop").alias("kind"),
    )


def table_tags(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1_oplog")
    return log.where(F.col("op").isin("set_table_tag", "unset_table_tag")).select(
        F.col("target").alias("object_id"), F.col("tag_name").alias("key"), F.col("tag_value").alias("value"),
        F.when(F.col("op") == "set_table_tag", "set").otherwise("unset").alias("action"), "seq",
    )


# DuckDB: alive intervals of tables, shared by several twins.
SPANS = """
ev AS (SELECT target AS object_id, seq, CASE op WHEN 'add_table' THEN 'add' ELSE 'drop' END AS kind
       FROM [fx1_oplog] WHERE op IN ('add_table', 'drop_table')),
turns AS (SELECT * FROM (SELECT *, lag(kind) OVER (PARTITION BY object_id ORDER BY seq) AS before FROM ev)
          WHERE kind <> coalesce(before, 'drop')),
spans AS (SELECT object_id, seq AS start_seq, end_seq FROM
          (SELECT *, lead(seq) OVER (PARTITION BY object_id ORDER BY seq) AS end_seq FROM turns) WHERE kind = 'add'),
alive AS (SELECT object_id, start_seq FROM spans WHERE end_seq IS NULL)
"""


@query("F01_lifetimes", f"WITH {SPANS} SELECT 'table' AS object_type, object_id, start_seq, end_seq FROM spans")
def lifetimes(spark, sf_dir):
    spans = fold.lifetimes(table_events(spark, sf_dir), ["object_id"])
    return spans.select(F.lit("table").alias("object_type"), "object_id", "start_seq", "end_seq")


def _level_sql(level, parent):
    """One level by the plain rule: own adds under a live parent, own drops, a drop at parent ends."""
    return f"""
    e_{level} AS (
      SELECT c.id, c.seq, 'add' AS kind FROM h c JOIN s_{parent} p ON p.id = c.parent_id AND c.seq > p.start_seq
        AND (p.end_seq IS NULL OR c.seq < p.end_seq) WHERE c.level = '{level}' AND c.op = 'add'
      UNION ALL SELECT id, seq, 'drop' FROM h WHERE level = '{level}' AND op = 'drop'
      UNION ALL SELECT DISTINCT c.id, p.end_seq, 'drop' FROM h c JOIN s_{parent} p ON p.id = c.parent_id
        WHERE c.level = '{level}' AND p.end_seq IS NOT NULL),
    t_{level} AS (SELECT * FROM (SELECT *, lag(kind) OVER (PARTITION BY id ORDER BY seq) AS before FROM e_{level})
      WHERE kind <> coalesce(before, 'drop')),
    s_{level} AS (SELECT id, seq AS start_seq, end_seq FROM
      (SELECT *, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS end_seq FROM t_{level}) WHERE kind = 'add')
    """


_HIER = f"""
WITH h AS (SELECT * FROM [fx1h_hierlog]),
t_catalog AS (SELECT * FROM (SELECT id, seq, op AS kind, lag(op) OVER (PARTITION BY id ORDER BY seq) AS before FROM h WHERE level = 'catalog')
  WHERE kind <> coalesce(before, 'drop')),
s_catalog AS (SELECT id, seq AS start_seq, end_seq FROM
  (SELECT *, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS end_seq FROM t_catalog) WHERE kind = 'add'),
{_level_sql('schema', 'catalog')},
{_level_sql('table', 'schema')}
"""


@query(
    "F02_cascade_lifetimes",
    _HIER + " ".join(
        f"{'UNION ALL ' if i else ''}SELECT '{lv}' AS object_type, id AS object_id, start_seq, end_seq FROM s_{lv}"
        for i, lv in enumerate(["catalog", "schema", "table"])
    ),
)
def cascade_lifetimes(spark, sf_dir):
    return fold.cascade_lifetimes(fixture(spark, sf_dir, "fx1h_hierlog"), ["catalog", "schema", "table"])


@query(
    "F03_latest_value",
    f"""WITH {SPANS},
    named AS (SELECT l.target AS object_id, arg_max_null(l.new_name, l.seq) AS value, max(l.seq) AS value_seq
      FROM [fx1_oplog] l JOIN alive a ON a.object_id = l.target AND l.seq > a.start_seq
      WHERE l.op = 'rename_table' GROUP BY 1)
    SELECT object_id, 'name' AS field, value, value_seq FROM named""",
)
def latest_value(spark, sf_dir):
    alive = fold.live(fold.lifetimes(table_events(spark, sf_dir), ["object_id"]))
    log = fixture(spark, sf_dir, "fx1_oplog").withColumnRenamed("target", "object_id")
    return fold.latest_values(
        log, ["object_id"], alive, {"name": (F.col("op") == "rename_table", F.col("new_name"))}
    )


_PAYLOAD_ALIVE = """
p AS (SELECT *, json_extract_string(payload, '$.tagName') AS tag, json_extract_string(payload, '$.comment') AS note FROM [fx1p_payloadlog]),
alive AS (SELECT target AS object_id, min(seq) AS start_seq FROM p WHERE op = 'add_table' GROUP BY 1)
"""


@query(
    "F04_partial_update",
    f"""WITH {_PAYLOAD_ALIVE},
    upd AS (SELECT p.* FROM p JOIN alive a ON a.object_id = p.target AND p.seq > a.start_seq WHERE op = 'update_function')
    SELECT target AS object_id, 'tagName' AS field, arg_max_null(tag, seq) AS value, max(seq) AS value_seq
      FROM upd WHERE payload LIKE '%"tagName"%' GROUP BY 1
    UNION ALL SELECT target, 'comment', arg_max_null(note, seq), max(seq) FROM upd WHERE payload LIKE '%"comment"%' GROUP BY 1""",
)
def partial_update(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1p_payloadlog").withColumnRenamed("target", "object_id")
    events = log.where("op = 'add_table'").select("object_id", "seq", F.lit("add").alias("kind"))
    alive = fold.live(fold.lifetimes(events, ["object_id"]))
    return fold.partial_update(
        log.where("op = 'update_function'"), ["object_id"], alive, "payload", ["tagName", "comment"]
    )


TAGS_NOW = f"""WITH {SPANS},
tag AS (SELECT target AS object_id, tag_name AS key, arg_max(tag_value, seq) AS value, arg_max(op, seq) AS op, max(seq) AS value_seq
  FROM [fx1_oplog] WHERE op IN ('set_table_tag', 'unset_table_tag') GROUP BY 1, 2)
SELECT t.object_id, 'tag' AS kind, key, value FROM tag t JOIN alive a ON a.object_id = t.object_id
WHERE op = 'set_table_tag' AND value_seq > start_seq"""


@query("F05_fold_map", TAGS_NOW)
def fold_map(spark, sf_dir):
    alive = fold.live(fold.lifetimes(table_events(spark, sf_dir), ["object_id"]))
    tags = fold.fold_map(table_tags(spark, sf_dir), "object_id", alive)
    return tags.select("object_id", F.lit("tag").alias("kind"), "key", "value")


def target_lives(spark, sf_dir, source, key, at=None):
    """Lifetimes of the targets as the ``source`` events of the target log tell them, up to ``at``."""
    log = fixture(spark, sf_dir, "fx1t_targetlog").where(F.col("source").isin("start", source))
    if at is not None:
        log = log.where(F.col("seq") <= at)
    return fold.lifetimes(log.select(F.col("target").alias(key), "seq", "kind"), [key])


def lived_sql(source, key, at=None):
    """DuckDB: the condition that a row falls in its target's present life."""
    upto = f" AND seq <= {at}" if at else ""
    turns = f"SELECT *, lag(kind) OVER (PARTITION BY target ORDER BY seq) AS before FROM [fx1t_targetlog] WHERE source IN ('start', '{source}'){upto}"
    lives = f"SELECT target, max(seq) AS start_seq FROM ({turns}) WHERE kind <> coalesce(before, 'drop') GROUP BY 1 HAVING arg_max(kind, seq) = 'add'"
    return f"seq > (SELECT life.start_seq FROM ({lives}) life WHERE life.target = {key})"


GRANTS_SQL = """
WITH g AS (SELECT * FROM [fx1g_grantlog] {where}),
reset AS (SELECT target_id, principal, max(seq) AS at FROM g WHERE op = 'add_grant' OR privileges IS NULL OR privileges = '' GROUP BY 1, 2),
base AS (SELECT g.target_id, g.principal, g.seq, unnest(string_split(g.privileges, ',')) AS privilege
  FROM g JOIN reset r ON r.target_id = g.target_id AND r.principal = g.principal AND r.at = g.seq WHERE g.op = 'add_grant' AND g.privileges <> ''),
gone AS (SELECT target_id, principal, seq, unnest(string_split(privileges, ',')) AS privilege FROM g WHERE op = 'revoke_grant' AND privileges <> '')
SELECT DISTINCT target_id, principal, privilege FROM base b WHERE NOT EXISTS
  (SELECT 1 FROM gone x WHERE x.target_id = b.target_id AND x.principal = b.principal AND x.privilege = b.privilege AND x.seq > b.seq)
"""


def grant_log(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1g_grantlog")
    listed = F.when(F.col("privileges") == "", F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.split("privileges", ","))
    return log.withColumn("privileges", F.when(F.col("privileges").isNotNull(), listed))


def grants_sql(at=None):
    return GRANTS_SQL.format(where="WHERE " + (f"seq <= {at} AND " if at else "") + lived_sql("view", "target_id", at))


def grants_at(spark, sf_dir, at=None):
    """Live grants on the targets that are there, at a point of the log or its end."""
    log = grant_log(spark, sf_dir)
    return fold.fold_grants(log if at is None else log.where(F.col("seq") <= at), target_lives(spark, sf_dir, "view", "target_id", at))


@query("F06_fold_grants", grants_sql())
def fold_grants(spark, sf_dir):
    return grants_at(spark, sf_dir)


def column_log(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1c_columnlog")
    return log.withColumn("listed", F.transform(F.split("order_list", ","), lambda c: c.cast("int")))


COLUMNS_SQL = """
c AS (SELECT * FROM [fx1c_columnlog] {where}),
cev AS (SELECT table_id, column_id, seq, CASE op WHEN 'add_column' THEN 'add' ELSE 'drop' END AS kind FROM c WHERE op IN ('add_column', 'drop_column')),
cturns AS (SELECT * FROM (SELECT *, lag(kind) OVER (PARTITION BY table_id, column_id ORDER BY seq) AS before FROM cev) WHERE kind <> coalesce(before, 'drop')),
cols AS (SELECT table_id, column_id, max(seq) AS start_seq FROM cturns GROUP BY 1, 2 HAVING arg_max(kind, seq) = 'add'),
lists AS (SELECT seq, table_id, string_split(order_list, ',') AS l FROM c WHERE op = 'reorder_columns'),
hits AS (SELECT k.table_id, k.column_id, k.start_seq, r.seq, list_position(r.l, CAST(k.column_id AS VARCHAR)) AS idx
  FROM cols k JOIN lists r ON r.table_id = k.table_id AND r.seq > k.start_seq AND list_contains(r.l, CAST(k.column_id AS VARCHAR))),
best AS (SELECT table_id, column_id, max(seq) AS seq, arg_max(idx, seq) AS idx FROM hits GROUP BY 1, 2),
placed AS (SELECT k.table_id, k.column_id, row_number() OVER (PARTITION BY k.table_id
  ORDER BY b.seq DESC NULLS LAST, b.idx NULLS LAST, k.start_seq) - 1 AS position
  FROM cols k LEFT JOIN best b ON b.table_id = k.table_id AND b.column_id = k.column_id)
"""


@query(
    "F07_fold_column_order",
    "WITH " + COLUMNS_SQL.format(where="WHERE " + lived_sql("view", "table_id")) + "SELECT table_id, column_id AS member_id, position FROM placed",
)
def fold_column_order(spark, sf_dir):
    return fold.fold_column_order(column_log(spark, sf_dir), target_lives(spark, sf_dir, "view", "table_id")).withColumnRenamed("column_id", "member_id")


@query(
    "F08_fold_constraints",
    "WITH RECURSIVE o AS (SELECT table_id, constraint_id AS id, op, insert_at AS k, row_number() OVER (PARTITION BY table_id ORDER BY seq) AS rn FROM [fx1k_constraintlog] WHERE "
    + lived_sql("view", "table_id") + """),
    r AS (SELECT DISTINCT table_id, CAST(0 AS BIGINT) AS rn, CAST([] AS INT[]) AS l FROM o
      UNION ALL SELECT r.table_id, o.rn, CASE WHEN o.op = 'drop_constraint' THEN list_filter(r.l, lambda x: x <> o.id) WHEN list_contains(r.l, o.id) THEN r.l
        WHEN o.k IS NULL THEN list_append(r.l, o.id) ELSE list_concat(list_concat(r.l[1:o.k], [o.id]), r.l[o.k + 1:]) END
      FROM r JOIN o ON o.table_id = r.table_id AND o.rn = r.rn + 1),
    ends AS (SELECT table_id, arg_max(l, rn) AS l FROM r GROUP BY 1)
    SELECT table_id, unnest(l) AS member_id, unnest(range(len(l))) AS position FROM ends""",
)
def fold_constraints(spark, sf_dir):
    return fold.fold_constraints(fixture(spark, sf_dir, "fx1k_constraintlog"), target_lives(spark, sf_dir, "view", "table_id"))


_RULES = f"""WITH r AS (SELECT * FROM [fx1r_rulelog] WHERE {lived_sql('click', 'table_id')}),
    ev AS (SELECT *, CASE op WHEN 'add' THEN 'add' ELSE 'drop' END AS k FROM r WHERE op IN ('add', 'remove')),
    turns AS (SELECT * FROM (SELECT *, lag(k) OVER (PARTITION BY table_id, rule_id, kind ORDER BY seq) AS before FROM ev) WHERE k <> coalesce(before, 'drop')),
    alive AS (SELECT * FROM (SELECT *, lead(seq) OVER (PARTITION BY table_id, rule_id, kind ORDER BY seq) AS end_seq FROM turns) WHERE k = 'add' AND end_seq IS NULL)"""


def _last_rule_field(field):
    """The field of the last row since the rule was added that carries it, a null as any other value."""
    return f"""(SELECT u.{field} FROM r u WHERE u.table_id = a.table_id AND u.rule_id = a.rule_id AND u.kind = a.kind AND u.seq >= a.seq
      AND (u.seq = a.seq OR u.op = 'update' AND list_contains(string_split(u.present, ','), '{field}')) ORDER BY u.seq DESC LIMIT 1) AS {field}"""


def rule_log(spark, sf_dir):
    return fixture(spark, sf_dir, "fx1r_rulelog").withColumn("present", F.split("present", ","))


@query("F09_fold_rules", _RULES + " SELECT a.table_id, a.rule_id, a.kind, a.column_id, " + ", ".join(map(_last_rule_field, fold.RULE_FIELDS)) + " FROM alive a")
def fold_rules(spark, sf_dir):
    return fold.fold_rules(rule_log(spark, sf_dir), target_lives(spark, sf_dir, "click", "table_id"))


@query(
    "F09_mask_links",
    _RULES + """, changes AS (SELECT t.table_id, CASE WHEN t.k = 'add' THEN t.column_id ELSE lag(t.column_id) OVER (PARTITION BY t.table_id, t.rule_id ORDER BY t.seq) END AS column_id,
      t.seq, CASE WHEN t.k = 'add' THEN t.rule_id END AS rule_id FROM turns t WHERE t.kind = 'column_mask')
    SELECT * FROM (SELECT table_id, column_id, arg_max_null(rule_id, seq) AS rule_id FROM changes GROUP BY 1, 2) WHERE rule_id IS NOT NULL""",
)
def mask_links(spark, sf_dir):
    return fold.mask_links(fold.rule_lives(rule_log(spark, sf_dir), target_lives(spark, sf_dir, "click", "table_id")))


def log_end(spark, sf_dir) -> int:
    return fixture(spark, sf_dir, "fx1_oplog").agg(F.max("seq")).first()[0]


@query(
    "F10_state_as_of",
    """WITH points AS (SELECT unnest([m // 4, m // 2, m]) AS as_of_seq FROM (SELECT max(seq) AS m FROM [fx1_oplog])),
    ev AS (SELECT p.as_of_seq, target AS object_id, seq, op FROM [fx1_oplog], points p WHERE seq <= p.as_of_seq),
    lastdrop AS (SELECT as_of_seq, object_id, max(seq) AS at FROM ev WHERE op = 'drop_table' GROUP BY 1, 2),
    alive AS (SELECT e.as_of_seq, e.object_id, min(e.seq) AS start_seq FROM ev e LEFT JOIN lastdrop d
      ON d.as_of_seq = e.as_of_seq AND d.object_id = e.object_id WHERE op = 'add_table' AND e.seq > coalesce(d.at, -1) GROUP BY 1, 2),
    tag AS (SELECT p.as_of_seq, target AS object_id, tag_name AS key, arg_max(tag_value, seq) AS value, arg_max(op, seq) AS op, max(seq) AS at
      FROM [fx1_oplog], points p WHERE seq <= p.as_of_seq AND op IN ('set_table_tag', 'unset_table_tag') GROUP BY 1, 2, 3)
    SELECT t.object_id, t.key, t.value, t.as_of_seq FROM tag t JOIN alive a ON a.object_id = t.object_id AND a.as_of_seq = t.as_of_seq
    WHERE t.op = 'set_table_tag' AND t.at > a.start_seq""",
)
def state_as_of(spark, sf_dir):
    end = log_end(spark, sf_dir)
    return fold.states_at(
        table_events(spark, sf_dir), table_tags(spark, sf_dir), [end // 4, end // 2, end]
    )


@query(
    "F11_snapshot_plus_delta",
    "SELECT object_id, key, value, (SELECT max(seq) FROM [fx1_oplog]) AS as_of_seq FROM (" + TAGS_NOW + ")",
)
def snapshot_plus_delta(spark, sf_dir):
    events, tags = table_events(spark, sf_dir), table_tags(spark, sf_dir)
    end = log_end(spark, sf_dir)
    alive, held = fold.snapshot_of(events, tags, end // 2)
    now = fold.snapshot_plus_delta(alive, held, events, tags, end // 2)
    return now.select("object_id", "key", "value", F.lit(end).cast("long").alias("as_of_seq"))


def _digest_sql(name):
    # Text as Spark writes it: a double always has a fraction or an exponent.
    text = {c: f"CAST({c} AS VARCHAR)" for c in ["bal", "comment", "id", "name", "nation"]}
    cells = ", ".join(f"'{c}=' || coalesce(length({t}) || ':' || {t}, 'null')" for c, t in text.items())
    part = ", ".join(
        f"coalesce(sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS UBIGINT) AS HUGEINT)), 0) AS s{i}" for i in range(4)
    )
    return f"""SELECT '{name}' AS version, n AS rows, sha256(concat_ws('|', n, s0, s1, s2, s3)) AS digest FROM
    (SELECT count(*) AS n, {part} FROM (SELECT sha256(concat_ws('|', {cells})) AS h FROM [fx3_{name}]))"""


@query("F12_state_digest", _digest_sql("old") + " UNION ALL " + _digest_sql("new"))
def state_digest(spark, sf_dir):
    each = [
        fold.state_digest(fixture(spark, sf_dir, f"fx3_{v}")).select(F.lit(v).alias("version"), "rows", "digest")
        for v in ("old", "new")
    ]
    return each[0].unionByName(each[1])


@query(
    "F13_fold_two_level",
    f"""WITH h AS (SELECT * FROM [fx1h_hierlog] WHERE level <> 'catalog'),
    t_schema AS (SELECT * FROM (SELECT id, seq, op AS kind, lag(op) OVER (PARTITION BY id ORDER BY seq) AS before FROM h WHERE level = 'schema')
      WHERE kind <> coalesce(before, 'drop')),
    s_schema AS (SELECT id, seq AS start_seq, end_seq FROM
      (SELECT *, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS end_seq FROM t_schema) WHERE kind = 'add'),
    {_level_sql('table', 'schema')}
    SELECT 'database' AS object_type, id AS object_id, start_seq, end_seq FROM s_schema
    UNION ALL SELECT 'table', id, start_seq, end_seq FROM s_table""",
)
def fold_two_level(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1h_hierlog").where("level <> 'catalog'")
    log = log.withColumn("level", F.when(F.col("level") == "schema", "database").otherwise(F.col("level")))
    return fold.cascade_lifetimes(log, ["database", "table"])
