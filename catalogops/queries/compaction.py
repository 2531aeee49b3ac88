"""Rebase, compaction, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.operators import compact, fold, merge
from catalogops.plans.fixtures import fixture
from catalogops.plans.skew import skew_join
from catalogops.queries.diff import ORDER_PAIR_SQL, order_pair, versions
from catalogops.queries.fold import SPANS
from catalogops.queries.registry import query

# Branches: one op in three is the base's. Targets are the parts of an object that the ops name, so that not all meet.
_PARTS = "SELECT * REPLACE (target * 100 + CAST(tag_value AS BIGINT) AS target) FROM [fx1_oplog]"
_SPLIT = f"""l AS ({_PARTS}),
base AS (SELECT * FROM l WHERE seq % 3 = 0),
feature AS (SELECT *, target // 100 % 7 AS branch FROM l WHERE seq % 3 <> 0)"""


def _parts(spark, sf_dir):
    return fixture(spark, sf_dir, "fx1_oplog").withColumn("target", F.col("target") * 100 + F.col("tag_value").cast("long"))


def _branches(spark, sf_dir):
    log = _parts(spark, sf_dir)
    return log.where("seq % 3 <> 0").withColumn("branch", F.floor(F.col("target") / 100) % 7), log.where("seq % 3 = 0")


@query("M01_rebase_conflicts", f"WITH {_SPLIT} SELECT op_id, seq FROM feature WHERE target IN (SELECT target FROM base)")
def rebase_conflicts(spark, sf_dir):
    return merge.rebase_conflicts(*_branches(spark, sf_dir)).select("op_id", "seq")


@query(
    "M02_rebase_plan",
    f"""WITH {_SPLIT}, c AS (SELECT *, CASE WHEN target IN (SELECT target FROM base) THEN 1 ELSE 0 END AS hit FROM feature),
    r AS (SELECT *, max(hit) OVER (PARTITION BY branch ORDER BY seq) AS upto, coalesce(max(hit) OVER (PARTITION BY branch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT seq, op_id, branch, CASE WHEN upto = 0 THEN 'applied' WHEN before = 0 THEN 'conflict' ELSE 'blocked' END AS state FROM r""",
)
def rebase_plan(spark, sf_dir):
    return merge.rebase_plan(*_branches(spark, sf_dir)).select("seq", "op_id", "branch", "state")


def _adds():
    return F.col("op") == "add_table"


@query(
    "M03_cancel_pairs",
    f"""WITH {SPANS} SELECT op_id, seq FROM [fx1_oplog] l
    WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.object_id = l.target AND l.seq BETWEEN s.start_seq AND s.end_seq)""",
)
def cancel_pairs(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1_oplog")
    return compact.cancel_pairs(log, "target", _adds(), F.col("op") == "drop_table").select("op_id", "seq")


_LEVELS = ("catalog", "schema", "table")


@query(
    "M03_cancel_below",
    """WITH h AS (SELECT * FROM [fx1h_hierlog]),
    turns AS (SELECT * FROM (SELECT *, lag(op) OVER (PARTITION BY level, id ORDER BY seq) AS before FROM h) WHERE op <> coalesce(before, 'drop')),
    spans AS (SELECT level, id, seq AS a, b FROM (SELECT *, lead(seq) OVER (PARTITION BY level, id ORDER BY seq) AS b FROM turns) WHERE op = 'add' AND b IS NOT NULL),
    up AS (SELECT level, id, min(parent_id) AS parent FROM h GROUP BY 1, 2),
    path AS (SELECT h.*, p.parent AS p1, q.parent AS p2 FROM h JOIN up p ON p.level = h.level AND p.id = h.id
      LEFT JOIN up q ON q.level = CASE h.level WHEN 'table' THEN 'schema' WHEN 'schema' THEN 'catalog' END AND q.id = p.parent)
    SELECT seq, level, id, op FROM path x WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.level = x.level AND s.id = x.id AND x.seq BETWEEN a AND b)
      AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.level = CASE x.level WHEN 'table' THEN 'schema' WHEN 'schema' THEN 'catalog' END AND s.id = x.p1 AND x.seq BETWEEN a AND b)
      AND NOT EXISTS (SELECT 1 FROM spans s WHERE x.level = 'table' AND s.level = 'catalog' AND s.id = x.p2 AND x.seq BETWEEN a AND b)""",
)
def cancel_below(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1h_hierlog")
    return compact.cancel_below(log, _LEVELS, F.col("op") == "add", F.col("op") == "drop").select("seq", "level", "id", "op")


@query(
    "M04_batch_by_target",
    """SELECT target, bool_or(op = 'add_table') AS is_new, arg_max(op_id, seq) FILTER (op = 'add_table') AS create_op_id, count(*) FILTER (op <> 'add_table') AS modify_count,
    min(seq) AS first_seq, max(seq) AS last_seq, string_agg(DISTINCT op, ',' ORDER BY op) AS kinds FROM [fx1_oplog] GROUP BY 1""",
)
def batch_by_target(spark, sf_dir):
    return compact.batch_by_target(fixture(spark, sf_dir, "fx1_oplog"), _adds())


@query("M04_batch_members", "SELECT target, row_number() OVER (PARTITION BY target ORDER BY seq) AS position, op_id FROM [fx1_oplog]")
def batch_members(spark, sf_dir):
    return compact.batch_members(fixture(spark, sf_dir, "fx1_oplog"))


@query(
    "M05_batch_stats",
    """WITH b AS (SELECT target, count(*) AS n, bool_or(op = 'add_table') AS is_new FROM [fx1_oplog] GROUP BY 1)
    SELECT count(*) AS total_batches, CAST(sum(n) AS BIGINT) AS total_operations, count(*) FILTER (is_new) AS new_objects, count(*) FILTER (NOT is_new) AS modified_objects,
    round(avg(n), 4) AS average_ops_per_batch, max(n) AS max_ops_in_batch, min(n) AS min_ops_in_batch FROM b""",
)
def batch_stats(spark, sf_dir):
    return compact.batch_stats(compact.batch_sizes(fixture(spark, sf_dir, "fx1_oplog"), _adds()))


@query(
    "M06_squash_creates",
    """WITH c AS (SELECT target, max(seq) AS made, arg_max(op_id, seq) AS create_op_id FROM [fx1_oplog] WHERE op = 'add_table' GROUP BY 1),
    v AS (SELECT c.target, arg_max(new_name, seq) FILTER (op = 'rename_table') AS name, arg_max(tag_value, seq) FILTER (op = 'set_table_tag' AND tag_name = 't1') AS tier
      FROM c JOIN [fx1_oplog] l ON l.target = c.target AND l.seq > c.made GROUP BY 1)
    SELECT c.target, c.create_op_id, v.name, v.tier FROM c LEFT JOIN v ON v.target = c.target""",
)
def squash_creates(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1_oplog")
    tier = (F.col("op") == "set_table_tag") & (F.col("tag_name") == "t1")
    return compact.squash_creates(
        log, _adds(), {"name": (F.col("op") == "rename_table", F.col("new_name")), "tier": (tier, F.col("tag_value"))}
    )


@query(
    "M07_net_tags",
    """SELECT target AS object_id, tag_name AS key, CASE arg_max(op, seq) WHEN 'set_table_tag' THEN 'set' ELSE 'unset' END AS action,
    CASE arg_max(op, seq) WHEN 'set_table_tag' THEN arg_max(tag_value, seq) END AS value FROM [fx1_oplog] WHERE op IN ('set_table_tag', 'unset_table_tag') GROUP BY 1, 2""",
)
def net_tags(spark, sf_dir):
    from catalogops.queries.fold import table_tags

    return compact.net_tags(table_tags(spark, sf_dir), "object_id")


@query(
    "M08_net_reorder",
    """WITH c AS (SELECT * FROM [fx1c_columnlog]),
    r AS (SELECT table_id, arg_min(order_list, seq) AS first_list, arg_max(order_list, seq) AS last_list, min(seq) AS first_at FROM c WHERE op = 'reorder_columns' GROUP BY 1),
    t AS (SELECT * FROM (SELECT c.table_id, column_id, seq, op, lag(op) OVER (PARTITION BY c.table_id, column_id ORDER BY seq) AS before FROM c JOIN r ON r.table_id = c.table_id AND seq < first_at
      WHERE op IN ('add_column', 'drop_column')) WHERE op <> coalesce(before, 'drop_column')),
    a AS (SELECT table_id, column_id, max(seq) AS start FROM t GROUP BY 1, 2 HAVING arg_max(op, seq) = 'add_column'),
    l AS (SELECT table_id, string_agg(CAST(column_id AS VARCHAR), ',' ORDER BY start) AS old_list FROM a GROUP BY 1)
    SELECT r.table_id, first_list, last_list, old_list FROM r LEFT JOIN l ON l.table_id = r.table_id""",
)
def net_reorder(spark, sf_dir):
    """Old order: the columns there before the first reorder, as they were added."""
    log = fixture(spark, sf_dir, "fx1c_columnlog")
    reorders = log.where("op = 'reorder_columns'")
    first = reorders.groupBy("table_id").agg(F.min("seq").alias("first"))
    early = skew_join(log.where("op IN ('add_column', 'drop_column')"), first, ["table_id"]).where("seq < first")
    listed = F.lit(None).cast("array<int>")
    before = fold.fold_column_order(early.select("seq", "table_id", "column_id", "op", listed.alias("listed")))
    return compact.net_reorder(reorders, before)


@query(
    "M09_single_column_move",
    ORDER_PAIR_SQL + """, e AS (SELECT table_id, old_cols, new_cols, unnest(new_cols) AS column_id, unnest(range(len(new_cols))) AS to_pos FROM pairs WHERE old_cols <> new_cols),
    m AS (SELECT table_id, column_id, list_position(old_cols, column_id) - 1 AS from_pos, to_pos FROM e
      WHERE list_filter(old_cols, lambda x: x <> column_id) = list_filter(new_cols, lambda x: x <> column_id) AND list_position(old_cols, column_id) - 1 <> to_pos)
    SELECT table_id, arg_min(column_id, to_pos) AS column_id, CAST(arg_min(from_pos, to_pos) AS BIGINT) AS from_pos, min(to_pos) AS to_pos FROM m GROUP BY 1""",
)
def single_column_move(spark, sf_dir):
    return compact.single_column_move(*order_pair(spark, sf_dir))


@query(
    "M10_reorder_distance",
    ORDER_PAIR_SQL + """, e AS (SELECT table_id, old_cols, unnest(new_cols) AS c, unnest(range(len(new_cols))) AS i FROM pairs),
    p AS (SELECT table_id, i, list_position(old_cols, c) AS o FROM e),
    d AS (SELECT table_id, (SELECT count(*) FROM p a JOIN p b ON a.i < b.i AND a.o > b.o AND a.table_id = b.table_id WHERE a.table_id = t.table_id) AS distance FROM pairs t)
    SELECT table_id, distance, distance <= 2 AS is_simple FROM d""",
)
def reorder_distance(spark, sf_dir):
    return compact.reorder_distance(*order_pair(spark, sf_dir))


@query(
    "M11_scoped_merge",
    """WITH o AS (SELECT name, comment, nation FROM [fx3_old]), f AS (SELECT name, 'found ' || comment AS comment, nation FROM [fx3_new] WHERE id < 1000000 AND nation < 12)
    SELECT coalesce(f.name, o.name) AS name, CASE WHEN f.name IS NOT NULL THEN f.comment ELSE o.comment END AS comment, coalesce(f.nation, o.nation) AS nation FROM o FULL JOIN f ON f.name = o.name""",
)
def scoped_merge(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    found = new.where("id < 1000000").select("name", F.concat(F.lit("found "), "comment").alias("comment"), "nation")
    return merge.scoped_merge(old.select("name", "comment", "nation"), found, ["name"], F.col("nation") < 12)


_V = r"'^v?([0-9]+)\.([0-9]+)\.([0-9]+)$'"
_PARSED = f"""v AS (SELECT id, branch, version, CASE WHEN regexp_matches(version, {_V}) THEN CAST(regexp_extract(version, {_V}, 1) AS BIGINT) END AS major,
CASE WHEN regexp_matches(version, {_V}) THEN CAST(regexp_extract(version, {_V}, 2) AS BIGINT) END AS minor,
CASE WHEN regexp_matches(version, {_V}) THEN CAST(regexp_extract(version, {_V}, 3) AS BIGINT) END AS patch FROM [fx7_versions])"""


@query("M12_parse_versions", f"WITH {_PARSED} SELECT id, version, major, minor, patch FROM v")
def parse_versions(spark, sf_dir):
    rows = merge.parse_versions(fixture(spark, sf_dir, "fx7_versions"))
    return rows.select("id", "version", "parsed.major", "parsed.minor", "parsed.patch")


@query(
    "M13_next_version",
    f"""WITH {_PARSED}, m AS (SELECT branch, max((major, minor, patch)) AS t FROM v WHERE major IS NOT NULL GROUP BY 1)
    SELECT b.branch, CASE WHEN t IS NULL THEN 'v0.1.0' ELSE concat('v', t[1], '.', t[2] + 1, '.0') END AS next_version
    FROM (SELECT DISTINCT branch FROM v) b LEFT JOIN m ON m.branch = b.branch""",
)
def next_version(spark, sf_dir):
    return merge.next_version(fixture(spark, sf_dir, "fx7_versions"), "branch")


_KEYED = f"""{_PARSED}, k AS (SELECT id, branch, version, major * 1000000 + minor * 1000 + patch AS key FROM v WHERE major IS NOT NULL),
u AS (SELECT branch, key, min(version) AS version FROM k GROUP BY 1, 2),
s AS (SELECT id, branch, version, key, lag(version) OVER (PARTITION BY branch ORDER BY id) AS previous, lag(key) OVER (PARTITION BY branch ORDER BY id) AS low FROM k)"""


def _chain(spark, sf_dir):
    """Snapshots with the previously made one of their branch as base."""
    from catalogops.functions.versions import parsed
    from catalogops.plans.ordered import last_before

    valid = fixture(spark, sf_dir, "fx7_versions").where(parsed(F.col("version")).isNotNull())
    return last_before(valid, ["branch"], "id", F.col("version"), "previous")


@query(
    "M14_versions_between",
    f"""WITH {_KEYED}, pairs AS (SELECT DISTINCT branch, previous AS from_version, version AS to_version, low, key FROM s WHERE previous IS NOT NULL)
    SELECT p.branch, from_version, to_version, u.version AS missing FROM pairs p JOIN u ON u.branch = p.branch AND u.key > p.low AND u.key < p.key""",
)
def versions_between(spark, sf_dir):
    chain = _chain(spark, sf_dir)
    pairs = chain.where("previous IS NOT NULL").select(
        "branch", F.col("previous").alias("from_version"), F.col("version").alias("to_version")
    )
    return merge.versions_between(pairs, fixture(spark, sf_dir, "fx7_versions"))


@query(
    "M15_stale_snapshots",
    f"""WITH {_KEYED} SELECT s.branch, s.version, s.previous AS current_base, arg_max(u.version, u.key) AS should_be_base, count(*) AS missing
    FROM s JOIN u ON u.branch = s.branch AND u.key > s.low AND u.key < s.key GROUP BY s.id, 1, 2, 3""",
)
def stale_snapshots(spark, sf_dir):
    return merge.stale_snapshots(_chain(spark, sf_dir).select("branch", "version", "previous"))


# Base versions v0.0.0 to v0.4.0 brought the base's ops in fifths; the feature started at v0.1.0.
_REBASE = f"""l AS ({_PARTS}),
ops AS (SELECT *, CASE WHEN seq % 3 = 0 THEN concat('v0.', seq * 5 // ((SELECT max(seq) FROM l) + 1), '.0') END AS version FROM l)"""


@query(
    "M16_rebase_snapshot",
    f"""WITH {_REBASE}, hit AS (SELECT DISTINCT target FROM ops WHERE version IN ('v0.2.0', 'v0.3.0')),
    f AS (SELECT *, target IN (SELECT target FROM hit) AS c FROM ops WHERE version IS NULL), first AS (SELECT min(seq) AS s FROM f WHERE c)
    SELECT op_id, seq, CASE WHEN s IS NULL OR seq < s THEN 'applied' WHEN seq = s THEN 'conflict' ELSE 'blocked' END AS state FROM f, first""",
)
def rebase_snapshot(spark, sf_dir):
    log = _parts(spark, sf_dir)
    end = log.agg(F.max("seq")).first()[0]
    of_base = F.col("seq") % 3 == 0
    fifth = F.floor(F.col("seq") * 5 / (end + 1)).cast("string")
    ops = log.withColumn("version", F.when(of_base, F.concat(F.lit("v0."), fifth, F.lit(".0"))))
    snapshots = ops.where("version IS NOT NULL").select("version").distinct()
    return merge.rebase_ops(ops, snapshots, "v0.1.0", "v0.3.0").select("op_id", "seq", "state")
