"""Deployment history and rollback."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.operators import diff, fold, history, impact
from catalogops.plans.fixtures import fixture, table
from catalogops.queries.diff import LEVELS, _fields_sql, _tags_at_sql, fx3_ops, versions
from catalogops.queries.fold import log_end, table_events, table_tags
from catalogops.queries.registry import query

_DEP = "d AS (SELECT * FROM [fx4_deployments])"


def deployments(spark, sf_dir):
    return fixture(spark, sf_dir, "fx4_deployments")


def deployment_ops(spark, sf_dir):
    """Op rows numbered per deployment. Line items of an order are few by the table's key."""
    return fixture(spark, sf_dir, "fx4_ops")


def _newest(where=""):
    return f"""SELECT environment, id, snapshot_version AS version FROM (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY deployed_at DESC, id DESC) AS r FROM d {where}) WHERE r = 1"""


@query("H01_latest_success", f"WITH {_DEP} " + _newest("WHERE status = 'success'"))
def latest_success(spark, sf_dir):
    return history.latest_success(deployments(spark, sf_dir))


@query("H02_most_recent", f"WITH {_DEP} " + _newest())
def most_recent(spark, sf_dir):
    return history.most_recent(deployments(spark, sf_dir))


PREVIOUS = f"""WITH {_DEP}, t AS (SELECT environment, deployed_at, max(id) AS last_id FROM d GROUP BY 1, 2),
b AS (SELECT *, lag(last_id) OVER (PARTITION BY environment ORDER BY deployed_at) AS previous_id FROM t)
SELECT d.id, b.previous_id FROM d JOIN b ON b.environment = d.environment AND b.deployed_at = d.deployed_at"""


@query("H03_previous_deployment", PREVIOUS)
def previous_deployment(spark, sf_dir):
    return history.previous_deployment(deployments(spark, sf_dir))


@query(
    "H04_deployment_record",
    """SELECT d.id, count(o.deployment_id) AS ops, count(*) FILTER (o.status = 'success') AS successful, min(execution_order) FILTER (o.status = 'failed') - 1 AS failed_index
    FROM [fx4_deployments] d LEFT JOIN [fx4_ops] o ON o.deployment_id = d.id GROUP BY 1""",
)
def deployment_record(spark, sf_dir):
    return history.deployment_record(deployments(spark, sf_dir), deployment_ops(spark, sf_dir))


@query("H04_record_steps", "SELECT deployment_id, execution_order - 1 AS position, op_type, op_target, status FROM [fx4_ops]")
def record_steps(spark, sf_dir):
    return history.record_steps(deployment_ops(spark, sf_dir))


@query(
    "H05_deployment_status",
    """WITH o AS (SELECT deployment_id AS id, count(*) AS ops, min(execution_order) FILTER (status = 'failed') - 1 AS failed_index FROM [fx4_ops] GROUP BY 1)
    SELECT id, ops, coalesce(failed_index, ops) AS successful, failed_index, CASE WHEN failed_index IS NULL THEN 'success' WHEN failed_index = 0 THEN 'failed' ELSE 'partial' END AS status FROM o""",
)
def deployment_status(spark, sf_dir):
    return history.deployment_status(deployment_ops(spark, sf_dir))


@query(
    "H05_cut_after_failure",
    """SELECT deployment_id, CAST(execution_order AS BIGINT) AS execution_order, CASE WHEN f IS NULL OR execution_order < f THEN 'success' WHEN execution_order = f THEN 'failed' ELSE 'skipped' END AS ran
    FROM (SELECT *, min(execution_order) FILTER (status = 'failed') OVER (PARTITION BY deployment_id) AS f FROM [fx4_ops])""",
)
def cut_after_failure(spark, sf_dir):
    return history.cut_after_failure(deployment_ops(spark, sf_dir)).select(
        "deployment_id", F.col("execution_order").cast("long").alias("execution_order"), "ran"
    )


# A statement of a deployment carries its own op and, in one of three, the next one's.
@query(
    "H06_ops_before_failure",
    """WITH o AS (SELECT *, min(execution_order) FILTER (status = 'failed') OVER (PARTITION BY deployment_id) AS f FROM [fx4_ops]),
    s AS (SELECT deployment_id, execution_order, f, unnest(CASE WHEN execution_order % 3 = 1 THEN [execution_order, execution_order + 1] ELSE [execution_order] END) AS op_id FROM o)
    SELECT DISTINCT deployment_id, CAST(op_id AS BIGINT) AS op_id FROM s WHERE execution_order < f AND NOT (op_id = f OR (f % 3 = 1 AND op_id = f + 1))""",
)
def ops_before_failure(spark, sf_dir):
    order = F.col("execution_order").cast("long")
    statements = deployment_ops(spark, sf_dir).select(
        "deployment_id", "execution_order", "status",
        F.when(order % 3 == 1, F.array(order, order + 1)).otherwise(F.array(order)).alias("op_ids"),
    )
    return history.ops_before_failure(statements)


@query(
    "H07_match_ops",
    """WITH a AS (SELECT concat(tag_name, op) AS s, op_id, row_number() OVER (PARTITION BY concat(tag_name, op) ORDER BY op_id) AS n FROM [fx1_oplog]),
    b AS (SELECT concat(tag_name, op) AS s, 10000000 - op_id AS op_id, row_number() OVER (PARTITION BY concat(tag_name, op) ORDER BY 10000000 - op_id) AS n FROM [fx1_oplog] WHERE op <> 'rename_table')
    SELECT a.op_id AS recorded_id, b.op_id AS regenerated_id FROM a JOIN b ON a.s = b.s AND a.n = b.n""",
)
def match_ops(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1_oplog").withColumn("signature", F.concat("tag_name", "op"))
    recorded = log.select("signature", F.col("op_id").alias("id"))
    regenerated = log.where("op <> 'rename_table'").select("signature", (F.lit(10_000_000) - F.col("op_id")).alias("id"))
    return history.match_ops(recorded, regenerated)


# Every deployment brought the ops of one stretch of the log: id is the last op of the stretch.


@query(
    "H08_pre_deployment_state",
    f"""WITH prev AS ({PREVIOUS}), pick AS (SELECT max(id) AS id FROM prev WHERE previous_id IS NOT NULL AND id <= {'(SELECT max(seq) FROM [fx1_oplog])'}),
    {_tags_at_sql('o', '(SELECT least(previous_id, (SELECT max(seq) FROM [fx1_oplog])) FROM prev JOIN pick ON pick.id = prev.id)')}
    SELECT object_id, key, value FROM o""",
)
def pre_deployment_state(spark, sf_dir):
    end = log_end(spark, sf_dir)
    found = history.previous_deployment(deployments(spark, sf_dir)).where(
        (F.col("id") <= end) & F.col("previous_id").isNotNull()
    )
    before = min(found.agg(F.max_by("previous_id", "id")).first()[0], end)
    events, tags = table_events(spark, sf_dir), table_tags(spark, sf_dir)
    alive, held = fold.snapshot_of(events, tags, before // 2)
    upto = lambda df: df.where(F.col("seq") <= before)
    return fold.snapshot_plus_delta(alive, held, upto(events), upto(tags), before // 2).select("object_id", "key", "value")


_UNDO = """WITH o AS (SELECT * FROM [fx3_new]), n AS (SELECT * FROM [fx3_old]), ops AS (
  SELECT 0 AS r, 'add_table' AS op, CAST(n.id AS VARCHAR) AS target, n.name AS detail, 0 AS phase FROM n WHERE id NOT IN (SELECT id FROM o)
  UNION ALL SELECT 0, CASE field WHEN 'name' THEN 'rename_table' ELSE 'set_table_' || field END, CAST(object_id AS VARCHAR), new_value, 1 FROM (""" + _fields_sql(["name", "comment"]) + """)
  UNION ALL SELECT 2, 'drop_table', CAST(o.id AS VARCHAR), NULL, 2 FROM o WHERE id NOT IN (SELECT id FROM n))
"""


@query("H09_rollback_ops", _UNDO + "SELECT row_number() OVER (ORDER BY r, phase, target, op) AS seq, op, target, detail FROM ops")
def rollback_ops(spark, sf_dir):
    return fx3_ops(spark, sf_dir, swap=True)


# Rows of a customer's orders are what dropping its table would lose.
_ASSESSED = _UNDO + """, c AS (SELECT CAST(o_custkey AS VARCHAR) AS target, count(*) * 100 AS n FROM orders GROUP BY 1),
a AS (SELECT op, ops.target, CASE WHEN op LIKE 'drop%' THEN c.n ELSE 0 END AS data_at_risk FROM ops LEFT JOIN c ON c.target = ops.target),
g AS (SELECT *, CASE WHEN data_at_risk IS NULL THEN 'UNKNOWN' WHEN data_at_risk = 0 THEN 'SAFE' WHEN data_at_risk < 1000 THEN 'RISKY' ELSE 'DESTRUCTIVE' END AS level FROM a)
"""


def _assessed(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    ops = diff.row_ops(new, old, "id", "table", ["comment"]).select("op", F.col("target").cast("string").alias("target"))
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("target")).agg(
        (F.count(F.lit(1)) * 100).alias("n")
    )
    return impact.assess_ops(ops, counts)


@query("H10_rollback_safety", _ASSESSED + "SELECT level, count(*) AS n, CAST(coalesce(sum(data_at_risk), 0) AS BIGINT) AS data_at_risk FROM g GROUP BY 1")
def rollback_safety(spark, sf_dir):
    return history.rollback_safety(_assessed(spark, sf_dir))


@query("H10_safe_only", _ASSESSED + "SELECT op, target FROM g WHERE level = 'SAFE'")
def safe_only(spark, sf_dir):
    return history.safe_only(_assessed(spark, sf_dir)).select("op", "target")


_PATTERN = r"'^v?([0-9]+)\.([0-9]+)\.([0-9]+)$'"


def _triple(column):
    return "(" + ", ".join(f"CAST(nullif(regexp_extract({column}, {_PATTERN}, {i}), '') AS INT)" for i in (1, 2, 3)) + ")"


# The baseline of a branch is the version of its first snapshot.
@query(
    "H11_baseline_guard",
    f"""WITH v AS (SELECT id, branch AS environment, version FROM [fx7_versions]), b AS (SELECT environment, arg_min(version, id) AS baseline FROM v GROUP BY 1)
    SELECT v.id, v.environment, v.version, b.baseline FROM v JOIN b ON b.environment = v.environment
    WHERE regexp_matches(v.version, {_PATTERN}) AND regexp_matches(b.baseline, {_PATTERN}) AND {_triple('v.version')} < {_triple('b.baseline')}""",
)
def baseline_guard(spark, sf_dir):
    targets = fixture(spark, sf_dir, "fx7_versions").withColumnRenamed("branch", "environment")
    baselines = targets.groupBy("environment").agg(F.min_by("version", "id").alias("version"))
    return history.baseline_guard(targets, baselines).select("id", "environment", "version", "baseline")


@query(
    "H12_already_at",
    f"WITH {_DEP}, l AS (" + _newest("WHERE status = 'success'") + """), w AS (SELECT environment, max(snapshot_version) AS version FROM d GROUP BY 1
    UNION SELECT environment, arg_max(snapshot_version, (deployed_at, id)) FROM d WHERE status = 'success' AND environment < '3' GROUP BY 1)
    SELECT * FROM l WHERE EXISTS (SELECT 1 FROM w WHERE w.environment = l.environment AND w.version = l.version)""",
)
def already_at(spark, sf_dir):
    d = deployments(spark, sf_dir)
    top = d.groupBy("environment").agg(F.max("snapshot_version").alias("version"))
    same = history.latest_success(d).where("environment < '3'").select("environment", "version")
    return history.already_at(d, top.unionByName(same).distinct())


@query(
    "H13_cascade_drops",
    """WITH RECURSIVE o AS (SELECT * FROM [fx2_objects]), r AS (SELECT object_id AS dropped_id, object_id, object_type FROM o
      WHERE object_type = 'catalog' AND name LIKE 'a%' OR object_type = 'schema' AND name LIKE 'i%'
      UNION ALL SELECT r.dropped_id, c.object_id, c.object_type FROM o c JOIN r ON r.object_id = c.parent_id)
    SELECT dropped_id, object_type, count(*) AS n FROM r WHERE dropped_id <> object_id GROUP BY 1, 2""",
)
def cascade_drops(spark, sf_dir):
    objects = fixture(spark, sf_dir, "fx2_objects")
    drops = objects.where("(object_type = 'catalog' AND name LIKE 'a%') OR (object_type = 'schema' AND name LIKE 'i%')")
    return history.cascade_drops(drops, objects, LEVELS[1:])


@query(
    "H14_deployment_stats",
    f"""WITH {_DEP}, o AS (SELECT deployment_id, count(*) AS n, count(*) FILTER (status = 'failed') AS bad FROM [fx4_ops] GROUP BY 1)
    SELECT environment, CAST(year(deployed_at) AS INT) AS period, CAST(coalesce(sum(n), 0) AS BIGINT) AS ops, CAST(coalesce(sum(bad), 0) AS BIGINT) AS ops_failed, count(*) AS deployments, count(*) FILTER (status = 'success') AS succeeded,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'partial') AS partial, round(avg(execution_time_ms), 4) AS mean_ms, quantile_disc(execution_time_ms, 0.95) AS p95_ms
    FROM d LEFT JOIN o ON o.deployment_id = d.id GROUP BY ROLLUP (environment, CAST(year(deployed_at) AS INT))""",
)
def deployment_stats(spark, sf_dir):
    return history.deployment_stats(deployments(spark, sf_dir), F.year("deployed_at"), deployment_ops(spark, sf_dir))
