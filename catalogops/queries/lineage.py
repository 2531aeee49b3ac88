"""Dependency and lineage graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.functions.opkinds import level_of
from catalogops.operators import graph, naming
from catalogops.plans.fixtures import fixture, spark_text, table, viewdefs
from catalogops.queries.registry import query
from catalogops.queries.selection import NAMES_SQL

_LEVEL_SQL = "CASE WHEN op = 'add_table' THEN 2 ELSE 3 END"

# What stands in the stored views, from how the views are made.
_REFS_SQL = """found AS (SELECT DISTINCT concat('vw_', CAST(o_orderkey AS STRING)) AS view_id, unnest(list_concat([concat(CASE WHEN r_name LIKE '% %' THEN concat('`', lower(r_name), '`') ELSE lower(r_name) END, '.', lower(n_name), '.t_', CAST(c_custkey AS STRING)),
  concat(lower(n_name), '.t_', CAST(c_custkey AS STRING))], CASE WHEN o_orderkey % 9 = 0 THEN ['nowhere.t_0'] ELSE [] END)) AS ref FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("G01_extract_table_refs", f"WITH {_REFS_SQL} SELECT view_id, ref FROM found")
def extract_table_refs(spark, sf_dir):
    return graph.extract_table_refs(fixture(spark, sf_dir, "fx6_viewdefs"))


def path_names(spark, sf_dir):
    """Tables and views with the three parts of their names."""
    names = naming.qualified_names(fixture(spark, sf_dir, "fx2_objects")).where(F.col("object_type").isin("table", "view"))
    p = F.split("full_name", r"\.")
    return names.select("object_type", "object_id", p[0].alias("catalog"), p[1].alias("schema"), p[2].alias("name"), "full_name")


_NAMED = f"""{NAMES_SQL}, t AS (SELECT object_type, object_id, string_split(full_name, '.') AS p, full_name FROM names WHERE object_type IN ('table', 'view')),
r AS (SELECT view_id, ref, CASE WHEN len(string_split(ref, '.')) = 3 THEN replace(ref, '`', '') ELSE 'asia.' || ref END AS path FROM found),
resolved AS (SELECT r.view_id, r.ref, t.object_type, t.object_id FROM r LEFT JOIN t ON t.full_name = r.path)"""


def resolved_refs(spark, sf_dir):
    refs = graph.extract_table_refs(fixture(spark, sf_dir, "fx6_viewdefs"))
    return graph.resolve_refs(refs, path_names(spark, sf_dir), "asia")


@query("G02_resolve_refs", f"WITH {_REFS_SQL}, {_NAMED} SELECT * FROM resolved")
def resolve_refs(spark, sf_dir):
    return resolved_refs(spark, sf_dir)


_FK = "SELECT concat('tbl_', CAST(c_custkey AS STRING)) AS table_id, concat('tbl_', CAST(c_custkey * 2 AS STRING)) AS parent_table FROM «customer» WHERE c_custkey % 3 = 1"
_EDGES_SQL = f"""WITH {_REFS_SQL}, {_NAMED}, fk AS ({_FK}),
nodes AS (SELECT object_id AS node_id FROM [fx2_objects] UNION SELECT view_id FROM [fx6_viewdefs]),
c AS (SELECT DISTINCT object_id AS from_id, view_id AS to_id, CASE object_type WHEN 'view' THEN 'view_to_view' ELSE 'view_to_table' END AS dep_type FROM resolved WHERE object_id IS NOT NULL
  UNION SELECT parent_table, table_id, 'foreign_key' FROM fk)"""


def _candidates(spark, sf_dir):
    fk = spark.sql(spark_text(_FK, sf_dir))
    nodes = (
        fixture(spark, sf_dir, "fx2_objects").select(F.col("object_id").alias("node_id"))
        .union(fixture(spark, sf_dir, "fx6_viewdefs").select("view_id")).distinct()
    )
    return resolved_refs(spark, sf_dir), fk, nodes


@query(
    "G03_build_edges",
    _EDGES_SQL + " SELECT c.*, 'enforced' AS enforcement FROM c WHERE from_id IN (SELECT node_id FROM nodes) AND to_id IN (SELECT node_id FROM nodes)",
)
def build_edges(spark, sf_dir):
    return graph.build_edges(*_candidates(spark, sf_dir))


@query("G03_missing_edges", _EDGES_SQL + " SELECT c.*, 'enforced' AS enforcement FROM c WHERE from_id NOT IN (SELECT node_id FROM nodes)")
def missing_edges(spark, sf_dir):
    resolved, fk, nodes = _candidates(spark, sf_dir)
    return graph.missing_edges(graph.candidate_edges(resolved, fk), nodes)


_ORDERED = "SELECT concat('op_', CAST(seq AS STRING)) AS op_id, concat('tbl_', CAST(table_id AS STRING)) AS table_id, op FROM [fx1k_constraintlog]"


@query(
    "G03_constraint_order_edges",
    f"""WITH o AS ({_ORDERED}), d AS (SELECT DISTINCT table_id AS t FROM o WHERE op = 'drop_constraint'), e AS (
      SELECT table_id AS from_id, op_id AS to_id FROM o WHERE op = 'drop_constraint' UNION ALL SELECT op_id, 'drops:' || table_id FROM o WHERE op = 'drop_constraint'
      UNION ALL SELECT CASE WHEN t IS NULL THEN table_id ELSE 'drops:' || table_id END, op_id FROM o LEFT JOIN d ON t = table_id WHERE op = 'add_constraint')
    SELECT *, 'constraint_ordering' AS dep_type, 'enforced' AS enforcement FROM e""",
)
def constraint_order_edges(spark, sf_dir):
    return graph.constraint_order_edges(spark.sql(spark_text(_ORDERED, sf_dir)))


@query(
    "G03_location_edges",
    """SELECT DISTINCT 'loc_' || location_name AS from_id, object_id AS to_id, 'location' AS dep_type,
      CASE WHEN location_name IN (SELECT location_name FROM [fx9_locations]) THEN 'enforced' ELSE 'warning' END AS enforcement FROM [fx9_external] WHERE location_name IS NOT NULL""",
)
def location_edges(spark, sf_dir):
    return graph.location_edges(fixture(spark, sf_dir, "fx9_external"), fixture(spark, sf_dir, "fx9_locations"))


@query(
    "G04_nodes_from_ops",
    f"SELECT target AS node_id, CAST(arg_min({_LEVEL_SQL}, seq) AS INT) AS level, min(seq) AS first_seq, arg_min(op, seq) AS first_op, count(*) AS op_count FROM [fx1_oplog] GROUP BY 1",
)
def nodes_from_ops(spark, sf_dir):
    return graph.nodes_from_ops(fixture(spark, sf_dir, "fx1_oplog"), level_of(F.col("op")))


def edges(spark, sf_dir):
    return fixture(spark, sf_dir, "fx5_edges")


_VIEWS = "SELECT concat('vw_', CAST(o_orderkey AS STRING)) AS node_id FROM «orders»"


def _views(spark, sf_dir):
    return spark.sql(spark_text(_VIEWS, sf_dir))


@query("G05_dependencies_of", f"SELECT from_id, to_id, dep_type, 'enforced' AS enforcement FROM [fx5_edges] WHERE to_id IN ({_VIEWS})")
def dependencies_of(spark, sf_dir):
    rows = graph.dependencies_of(edges(spark, sf_dir), _views(spark, sf_dir))
    return rows.select("from_id", "to_id", "dep_type", F.lit("enforced").alias("enforcement"))


@query("G05_dependents_of", f"SELECT from_id, to_id, dep_type, 'enforced' AS enforcement FROM [fx5_edges] WHERE from_id IN ({_VIEWS})")
def dependents_of(spark, sf_dir):
    rows = graph.dependents_of(edges(spark, sf_dir), _views(spark, sf_dir))
    return rows.select("from_id", "to_id", "dep_type", F.lit("enforced").alias("enforcement"))


def _closure_sql(roots, columns):
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT from_id, to_id FROM [fx5_edges]), r AS (
      SELECT node_id AS root_id, node_id, CAST(0 AS BIGINT) AS hops FROM ({roots})
      UNION SELECT r.root_id, e.to_id, r.hops + 1 FROM r JOIN e ON e.from_id = r.node_id)
    SELECT {columns} FROM (SELECT root_id, node_id, min(hops) AS hops FROM r GROUP BY 1, 2) WHERE hops > 0"""


_ROOTS = "SELECT concat('tbl_', CAST(c_custkey AS STRING)) AS node_id FROM «customer»"


@query("G06_closure", _closure_sql(_ROOTS, "*"))
def closure(spark, sf_dir):
    roots = spark.sql(spark_text(_ROOTS, sf_dir)).select(F.col("node_id").alias("root_id"))
    return graph.closure(edges(spark, sf_dir), roots)


_ANCESTORS = f"""WITH RECURSIVE e AS (SELECT DISTINCT from_id, to_id FROM [fx5_edges]), r AS (
  SELECT node_id AS root_id, node_id, CAST(0 AS BIGINT) AS hops FROM ({_VIEWS}) UNION SELECT r.root_id, e.from_id, r.hops + 1 FROM r JOIN e ON e.to_id = r.node_id)
SELECT * FROM (SELECT root_id, node_id, min(hops) AS hops FROM r GROUP BY 1, 2) WHERE hops > 0"""


@query("G06_ancestors", _ANCESTORS)
def ancestors(spark, sf_dir):
    turned = edges(spark, sf_dir).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return graph.closure(turned, _views(spark, sf_dir).select(F.col("node_id").alias("root_id")))


_DROPS = "SELECT DISTINCT concat('tbl_', CAST(target AS STRING)) AS node_id FROM [fx1_oplog] WHERE op = 'drop_table'"


@query("G07_breaking_changes", _closure_sql(_DROPS, "root_id AS dropped_id, node_id AS dependent_id, hops"))
def breaking_changes(spark, sf_dir):
    return graph.breaking_changes(spark.sql(spark_text(_DROPS, sf_dir)), edges(spark, sf_dir))


@query(
    "G08_topo_depth",
    """WITH RECURSIVE e AS (SELECT DISTINCT from_id, to_id FROM [fx5_edges]), n AS (SELECT from_id AS node_id FROM e UNION SELECT to_id FROM e),
    r AS (SELECT node_id, CAST(0 AS BIGINT) AS d FROM n UNION SELECT e.to_id, r.d + 1 FROM r JOIN e ON e.from_id = r.node_id)
    SELECT node_id, max(d) AS depth FROM r GROUP BY 1""",
)
def topo_depth(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.topo_depth(graph._ends(e), e)


_TREE = "SELECT DISTINCT CAST(floor(user_id / 2) AS BIGINT) AS from_id, user_id AS to_id FROM «events» WHERE user_id > 0"


@query(
    "G09_order_ops",
    f"""WITH RECURSIVE l AS (SELECT * FROM [fx1_oplog]), n AS (SELECT target AS node_id, arg_min({_LEVEL_SQL}, seq) AS level, min(seq) AS first_seq FROM l GROUP BY 1),
    e AS ({_TREE}), r AS (SELECT node_id, CAST(0 AS BIGINT) AS d FROM n UNION SELECT e.to_id, r.d + 1 FROM r JOIN e ON e.from_id = r.node_id),
    depth AS (SELECT node_id, max(d) AS depth FROM r GROUP BY 1)
    SELECT row_number() OVER (ORDER BY depth, level, first_seq, target, seq) AS position, op_id FROM l JOIN n ON n.node_id = l.target JOIN depth d ON d.node_id = l.target""",
)
def order_ops(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx1_oplog")
    return graph.order_ops(log, spark.sql(spark_text(_TREE, sf_dir)), level_of(F.col("op")))


@query(
    "G10_order_by_level",
    f"SELECT row_number() OVER (ORDER BY {_LEVEL_SQL}, seq) AS position, op_id, CAST({_LEVEL_SQL} AS INT) AS level FROM [fx1_oplog]",
)
def order_by_level(spark, sf_dir):
    return graph.order_by_level(fixture(spark, sf_dir, "fx1_oplog"), level_of(F.col("op")))


@query(
    "G11_cyclic_core",
    """WITH RECURSIVE e AS (SELECT DISTINCT from_id, to_id FROM [fx5x_edges]), r AS (SELECT from_id AS a, to_id AS b FROM e UNION SELECT r.a, e.to_id FROM r JOIN e ON e.from_id = r.b),
    cyc AS (SELECT a AS n FROM r WHERE a = b),
    core AS (SELECT DISTINCT b AS n FROM r WHERE a IN (SELECT n FROM cyc) INTERSECT SELECT DISTINCT a FROM r WHERE b IN (SELECT n FROM cyc))
    SELECT n AS node_id, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = core.n), n) AS cycle_id FROM core""",
)
def cyclic_core(spark, sf_dir):
    return graph.cyclic_core(fixture(spark, sf_dir, "fx5x_edges"))


_NODES = """SELECT object_id AS node_id, CASE object_type WHEN 'column' THEN 3 ELSE 2 END AS level FROM [fx2_objects] WHERE object_type IN ('table', 'column')
UNION ALL SELECT concat('vw_', CAST(o_orderkey AS STRING)), CASE WHEN o_orderkey % 40 = 9 THEN 3 ELSE 2 END FROM «orders»"""


@query(
    "G12_graph_warnings",
    f"""WITH n AS ({_NODES}), e AS (SELECT * FROM [fx5x_edges]), j AS (SELECT e.from_id, e.to_id, a.level AS l, b.level AS d FROM e JOIN n a ON a.node_id = e.to_id LEFT JOIN n b ON b.node_id = e.from_id)
    SELECT CASE WHEN d IS NULL THEN 'MISSING_DEPENDENCY' ELSE 'INVALID_HIERARCHY' END AS code, to_id AS node_id, from_id AS dep_id FROM j WHERE d IS NULL OR l < d""",
)
def graph_warnings(spark, sf_dir):
    return graph.graph_warnings(spark.sql(spark_text(_NODES, sf_dir)), fixture(spark, sf_dir, "fx5x_edges"))


@query("G13_qualify_refs", viewdefs("path", "concat(CASE region WHEN 'asia' THEN 'asia.' ELSE '' END, brief)"))
def qualify_refs(spark, sf_dir):
    defs = fixture(spark, sf_dir, "fx6_viewdefs")
    spelled = F.regexp_replace("full_name", r"(?<![^.])(\w+ [\w ]+)(?![^.])", "`$1`")
    return graph.qualify_refs(defs, resolved_refs(spark, sf_dir), path_names(spark, sf_dir).withColumn("full_name", spelled))


_COLUMNS_SQL = "SELECT concat('vw_', CAST(o_orderkey AS STRING)) AS view_id, unnest(list_concat([{}], CASE WHEN o_orderkey % 4 = 3 THEN [{}] ELSE [] END)) AS ref FROM orders JOIN customer ON o_custkey = c_custkey"


@query("G14_column_refs", _COLUMNS_SQL.format("'a.x', 'b.y', 'amount', 'a.d', 'a.k', 'b.k'", "'k', 'y'"))
def column_refs(spark, sf_dir):
    return graph.column_refs(fixture(spark, sf_dir, "fx6_viewdefs"))


@query("G14_known_column_refs", _COLUMNS_SQL.format("'amount', 'a.k', 'b.k'", "'k'"))
def known_column_refs(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, "AMOUNT").otherwise("K").alias("column"))
    return graph.column_refs(fixture(spark, sf_dir, "fx6_viewdefs"), known)


@query(
    "G15_drop_before_add",
    "SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY CASE op WHEN 'drop_constraint' THEN 0 ELSE 1 END, seq) AS position, constraint_id, op FROM [fx1k_constraintlog]",
)
def drop_before_add(spark, sf_dir):
    return graph.drop_before_add(fixture(spark, sf_dir, "fx1k_constraintlog"))
