"""Lineage graphs: edges run from a dependency to its dependent.

Loops run one join per round over the edges that are still open, write the result to the shared
folder, and stop when it no longer changes. Hub nodes (hot ``from_id``) are found once and
salted in every round.
"""

from __future__ import annotations

from itertools import count

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.functions.sqltext import column_names, name_parts, rewritten, table_names
from catalogops.plans.durable import Bucketed, durable
from catalogops.plans.ordered import BITS, global_position, rank_within
from catalogops.plans.skew import dealt, heavy_keys, skew_join


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


class _Edges:
    """Edges cut to a table once; the hub nodes of an end are looked for once, when first needed."""

    def __init__(self, edges: DataFrame):
        self.rows = durable(edges, "edges")
        self.hubs = {}

    def _hubs(self, end: str) -> DataFrame | None:
        if end not in self.hubs:
            heavy = durable(heavy_keys(self.rows, [end]), "hubs")
            self.hubs[end] = None if heavy.isEmpty() else heavy
        return self.hubs[end]

    def meet(self, rows: DataFrame, small: DataFrame, end: str, how: str = "inner") -> DataFrame:
        """``rows`` (these edges or fewer) joined on one end with few rows per node."""
        hubs = self._hubs(end)
        if hubs is None:
            return rows.join(small, end, how)
        return skew_join(rows, small, [end], how, heavy=hubs)

    def lay_out(self) -> None:
        """Put the edges between named nodes in buckets by ``from_id`` once, those of hubs beside them, for ``onward``."""
        rows, hubs = self.rows.where("from_id IS NOT NULL AND to_id IS NOT NULL"), self._hubs("from_id")
        self.of_hubs = None
        if hubs is not None:
            self.of_hubs = durable(rows.join(F.broadcast(hubs), "from_id", "left_semi"), "hubs")
            rows = rows.join(F.broadcast(hubs), "from_id", "left_anti")
        self.laid = Bucketed(rows.sparkSession, "edges", "from_id")
        self.laid.add(rows.repartition(self.laid.buckets, "from_id"), 0)

    def onward(self, news: DataFrame) -> DataFrame:
        """The edges that leave ``news`` (from_id, each once, in the same buckets), with its columns: no edge is sent over."""
        met = self.laid.rows().drop("step").join(news.hint("shuffle_hash"), "from_id")
        if self.of_hubs is None:
            return met
        few = news.join(F.broadcast(self.hubs["from_id"]), "from_id", "left_semi")
        return met.unionByName(self.of_hubs.join(F.broadcast(few), "from_id"))


def _each_name(defs: DataFrame, names) -> DataFrame:
    """(view_id, ref): one row for each name found in a text. Texts are dealt anew first: a file that one
    task reads would otherwise be one task's to walk."""
    return dealt(defs.select("view_id", "definition"), "view_id", "definition").select("view_id", F.explode(names(F.col("definition"))).alias("ref"))


def extract_table_refs(defs: DataFrame) -> DataFrame:
    """(view_id, ref) from (view_id, definition): tables of FROM and JOIN, comma lists, MERGE and INSERT,
    plain or in back-ticks, each once a text; no names of common table expressions."""
    return _each_name(defs, table_names)


def column_refs(defs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(view_id, ref): columns a stored text uses, with or without a qualifier, each once.

    With ``known``, (column), only references whose last part is one of these names, in any case.
    """
    found = _each_name(defs, column_names)
    if known is None:
        return found
    # Cut here, since the join reads its rows twice and the walk over the texts is the dear part.
    last = durable(found, "columns").withColumn("_c", F.lower(F.element_at(name_parts(F.col("ref")), -1)))
    return skew_join(last, known.select(F.lower("column").alias("_c")).distinct(), ["_c"], "left_semi").drop("_c")


def resolve_refs(refs: DataFrame, names: DataFrame, default_catalog: str | Column | None = None) -> DataFrame:
    """(view_id, ref, object_type, object_id); unresolved refs keep null ids.

    ``names`` is (object_type, object_id, catalog, schema, name). Shorter refs are read in the
    default catalog; a bare name matches any schema there. Tables win over views.
    """
    refs = durable(refs, "refs")
    parts = name_parts(F.col("ref"))
    default = default_catalog if isinstance(default_catalog, Column) else F.lit(default_catalog)
    asked = (
        refs.select("ref").distinct() if not isinstance(default_catalog, Column) else refs.select("ref", default.alias("_d")).distinct()
    )
    asked = asked.withColumns(
        {
            "_catalog": F.when(F.size(parts) == 3, parts[0]).otherwise(default if not isinstance(default_catalog, Column) else F.col("_d")),
            "_schema": F.when(F.size(parts) == 3, parts[1]).when(F.size(parts) == 2, parts[0]),
            "_name": F.element_at(parts, -1),
        }
    )
    best = F.min(F.struct(F.when(F.col("object_type") == "table", 0).otherwise(1).alias("r"), "object_id", "object_type"))
    full = names.groupBy("catalog", "schema", "name").agg(best.alias("hit"))
    bare = names.groupBy("catalog", "name").agg(best.alias("hit"))
    keys = [c for c in ("ref", "_d") if c in asked.columns]
    with_schema = asked.where("_schema IS NOT NULL").join(
        full.select(F.col("catalog").alias("_catalog"), F.col("schema").alias("_schema"), F.col("name").alias("_name"), "hit"),
        ["_catalog", "_schema", "_name"], "left",
    )
    without = asked.where("_schema IS NULL").join(
        bare.select(F.col("catalog").alias("_catalog"), F.col("name").alias("_name"), "hit"), ["_catalog", "_name"], "left"
    )
    answers = with_schema.select(*keys, "hit").unionByName(without.select(*keys, "hit"))
    asking = refs if "_d" not in keys else refs.withColumn("_d", default)
    return skew_join(asking, answers, keys, "left").select(
        "view_id", "ref", F.col("hit.object_type").alias("object_type"), F.col("hit.object_id").alias("object_id")
    )


def build_edges(resolved: DataFrame, foreign_keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, to_id, dep_type, enforcement) between known nodes.

    ``resolved`` is from ``resolve_refs``, ``foreign_keys`` is (table_id, parent_table). Edges to
    unknown nodes are in ``missing_edges``.
    """
    edges = durable(candidate_edges(resolved, foreign_keys), "edges")
    known = nodes.select("node_id").distinct()
    for end in ("from_id", "to_id"):
        edges = skew_join(edges, known.withColumnRenamed("node_id", end), [end], "left_semi")
    return edges


def candidate_edges(resolved: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    views = resolved.where("object_id IS NOT NULL").select(
        F.col("object_id").alias("from_id"), F.col("view_id").alias("to_id"),
        F.when(F.col("object_type").isin("view", "materialized_view"), "view_to_view").otherwise("view_to_table").alias("dep_type"),
    )
    keys = foreign_keys.select(
        F.col("parent_table").alias("from_id"), F.col("table_id").alias("to_id"), F.lit("foreign_key").alias("dep_type")
    )
    return views.unionByName(keys).distinct().withColumn("enforcement", F.lit("enforced"))


def constraint_order_edges(ops: DataFrame) -> DataFrame:
    """(from_id, to_id, dep_type, enforcement): a table before its constraint drops, its drops before its adds.

    ``ops`` is (op_id, table_id, op), ids as text. The drops of a table meet its adds in one node
    ``drops:<table_id>``, so there are as many edges as ops and never one for every drop and add.
    """
    table = F.col("table_id")
    gate = F.concat(F.lit("drops:"), table)
    dropped = ops.where("op = 'drop_constraint'").select("table_id").distinct().withColumn("_gate", F.lit(True))
    each = skew_join(ops.where("op IN ('drop_constraint', 'add_constraint') AND table_id IS NOT NULL"), dropped, ["table_id"], "left")
    drops = F.col("op") == "drop_constraint"
    pair = lambda a, b: F.struct(a.alias("from_id"), b.alias("to_id"))
    steps = F.when(drops, F.array(pair(table, F.col("op_id")), pair(F.col("op_id"), gate))).otherwise(
        F.array(pair(F.when(F.col("_gate"), gate).otherwise(table), F.col("op_id")))
    )
    return each.select(F.inline(steps)).select(
        "from_id", "to_id", F.lit("constraint_ordering").alias("dep_type"), F.lit("enforced").alias("enforcement")
    )


def location_edges(objects: DataFrame, locations: DataFrame) -> DataFrame:
    """(from_id, to_id, dep_type, enforcement): objects (object_id, location_name) on the locations they
    name, ``enforced`` where the location is one of ``locations`` (location_name), else a ``warning``."""
    known = locations.select("location_name").distinct().withColumn("_known", F.lit(True))
    return skew_join(objects.where("location_name IS NOT NULL"), known, ["location_name"], "left").select(
        F.concat(F.lit("loc_"), "location_name").alias("from_id"), F.col("object_id").alias("to_id"), F.lit("location").alias("dep_type"),
        F.when(F.col("_known"), "enforced").otherwise("warning").alias("enforcement"),
    ).distinct()


def missing_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select(F.col("node_id").alias("from_id")).distinct()
    return skew_join(edges, known, ["from_id"], "left_anti")


def nodes_from_ops(ops: DataFrame, level: Column) -> DataFrame:
    """(node_id, level, first_seq, first_op, op_count): one node per object, told by its first op."""
    return ops.withColumn("_l", level).groupBy("target").agg(
        F.min(F.struct("seq", F.col("_l").alias("level"), "op")).alias("f"), F.count(F.lit(1)).alias("op_count")
    ).select(F.col("target").alias("node_id"), "f.level", F.col("f.seq").alias("first_seq"), F.col("f.op").alias("first_op"), "op_count")


def dependencies_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return skew_join(edges, nodes.select(F.col("node_id").alias("to_id")).distinct(), ["to_id"], "left_semi")


def dependents_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return skew_join(edges, nodes.select(F.col("node_id").alias("from_id")).distinct(), ["from_id"], "left_semi")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, node_id, hops): everything that depends on each root, by fewest hops.

    ``roots`` is (root_id). For ancestors pass the edges turned round. Pairs of up to 1, 2, 4, 8, ... hops are found
    by ``_by_jumps``, each end of many held in one row; what it leaves, for sets too large for a row, by ``_by_steps``.
    """
    graph = _Edges(edges.select("from_id", "to_id").distinct())
    starts = durable(roots.select("root_id").where("root_id IS NOT NULL").distinct(), "roots")
    none = starts.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).cast("long").alias("hops"))
    found, hops = _by_jumps(graph.rows.where("from_id <> to_id"), starts)
    if hops is not None:
        found = _by_steps(graph, none if found is None else none.unionByName(found), hops)
    nameless = graph.rows.where("to_id IS NULL").select(F.col("from_id").alias("node_id"))
    if nameless.isEmpty():
        return found
    # An end without a name equals no other, so a root has one for each number of hops at which it is met first.
    found = durable(found, "reached")
    met = none.unionByName(found).join(nameless, "node_id")
    ends = met.select("root_id", F.lit(None).cast(found.schema["node_id"].dataType).alias("node_id"), (F.col("hops") + 1).alias("hops"))
    return found.unionByName(ends.distinct())


def _by_steps(graph: _Edges, known: DataFrame, hops: int) -> DataFrame:
    """(root_id, node_id, hops): the pairs of ``known``, which has all of up to ``hops`` hops, and all beyond them, one hop a round.

    A round's pairs are those that a path of just so many edges joins. What was reached before is taken from
    them only in rounds 1, 2, 4, 8, ..., as that reads all pairs so far; in between a pair may come again, but
    never in a round less than its first, and a circle is left by the next such round.
    """
    reached = [durable(known, "reached")]
    frontier = reached[0].where(F.col("hops") == hops)
    for hops in count(hops + 1):
        # Few frontier rows may meet a node, or most of them (all roots below one top): AQE splits either side.
        step = graph.meet(graph.rows.where("to_id IS NOT NULL"), frontier.select("root_id", F.col("node_id").alias("from_id")), "from_id")
        met = step.select("root_id", F.col("to_id").alias("node_id")).distinct()
        if hops & (hops - 1) == 0:
            met = met.join(_union(reached).select("root_id", "node_id"), ["root_id", "node_id"], "left_anti")
        frontier = durable(met.withColumn("hops", F.lit(hops).cast("long")), "reached")
        if frontier.isEmpty():
            break
        reached.append(frontier)
    return _union(reached).groupBy("root_id", "node_id").agg(F.min("hops").alias("hops")).where("hops > 0")


# Nodes a row may hold, and how many times the nodes held and the edges a jump may bring, before steps take over.
HELD = 1 << 16
BROUGHT = 32


def _by_jumps(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame | None, int | None]:
    """The pairs (root_id, node_id, hops) of up to so many hops, and that number: None when these are all.

    A row holds all that one node meets within 1, 2, 4, 8, ... hops, and ``far``, from which more is met at the end
    of just so many. A jump adds what those hold, which doubles the hops; so there are as many rounds as the
    number of hops has bits, and a pair is sent as part of a row, not by itself. Circles end when a jump adds nothing.
    A row is for a node that roots meet, and holds roots only, or for a root, if most nodes with edges are one and the
    edges branch less that way. Rows stay bounded: before one would hold more than ``HELD``, steps take over.
    """
    degree = lambda end, n: edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias(n))
    ends = degree("from_id", "leaving").join(degree("to_id", "entering"), "node", "full")
    ends = durable(ends.join(roots.select(F.col("root_id").alias("node"), F.lit(True).alias("root")), "node", "left"), "ends")
    rooted = F.count_if(F.col("root") & F.col("leaving").isNotNull())
    leaving, entering, size, left, rooted = ends.agg(F.max("leaving"), F.max("entering"), F.sum("leaving"), F.count("leaving"), rooted).first()
    if not left:
        return None, 0
    onward = left <= 2 * rooted and leaving < entering
    if (leaving if onward else entering) > HELD:
        return None, 0
    marks = ends.select(F.col("node").alias("_met"), F.lit(True).alias("_kept") if onward else F.col("root").alias("_kept"), F.col("leaving" if onward else "entering").alias("_more"))
    node, met = ("from_id", "to_id") if onward else ("to_id", "from_id")
    listed = edges.select(F.col(node).alias("node"), F.col(met).alias("_met")).join(marks, "_met").groupBy("node").agg(
        F.collect_list(F.when(F.col("_kept"), F.col("_met"))).alias("nodes"), F.collect_list(F.when(F.col("_more") > 0, F.col("_met"))).alias("far")
    )
    sets = durable(_sized(listed.withColumn("hops", F.array_repeat(F.lit(1), F.size("nodes"))).withColumn("again", F.lit(False))), "sets")
    keys = roots if onward and rooted < left else None
    before = None
    for hops in (1 << k for k in count()):
        if sets.where("again").isEmpty():
            plain = sets
        else:
            plain = sets.where("NOT again").unionByName(durable(_least(sets.where("again")), "sets"))
        held, longest, farthest = plain.agg(F.sum("n"), F.max("n"), F.max("f")).first()
        if held == before:
            return _pairs(plain, keys, onward), None
        if not _bounded(plain, longest, farthest, BROUGHT * (held + size)):
            return _pairs(plain, keys, onward), hops
        before = held
        wanted = durable(plain.select(F.explode("far").alias("node")).distinct(), "wanted")
        given = durable(plain.join(wanted, "node", "left_semi"), "given")
        jumped = _jumped(plain, given, hops)
        # The last jump is not written: its rows are the answer's.
        if given.where("f > 0").isEmpty():
            return _pairs(jumped, keys, onward), None
        sets = durable(jumped, "sets")


def _sized(sets: DataFrame) -> DataFrame:
    return sets.select("node", "nodes", "hops", "far", "again", F.size("nodes").alias("n"), F.size("far").alias("f"))


def _bounded(sets: DataFrame, longest: int, farthest: int, most: int) -> bool:
    """Whether the next jump brings no row more than ``HELD`` nodes, nor all rows together more than ``most``."""
    if farthest <= 1:
        return 2 * longest <= HELD
    theirs = sets.select(F.col("node").alias("_x"), (F.col("n") + F.col("f")).cast("long").alias("_n"))
    asked = sets.select("node", "n", F.explode("far").alias("_x")).join(theirs, "_x")
    rows = asked.groupBy("node").agg(F.sum("_n").alias("_n"), F.max("n").alias("n"))
    row, brought = rows.agg(F.max(F.col("_n") + F.col("n")), F.sum("_n")).first()
    return row <= HELD and brought <= most


def _jumped(sets: DataFrame, given: DataFrame, hops: int) -> DataFrame:
    """``sets`` of up to ``hops`` hops with what their ``far`` hold (``given``), which is ``hops`` further: up to twice as many.

    ``again`` marks rows that hold a node twice, where paths meet again, or their own, where a circle closes.
    """
    more = given.select(
        F.col("node").alias("_x"), F.col("nodes").alias("_nodes"), F.transform("hops", lambda h: h + F.lit(hops)).alias("_hops"), F.col("far").alias("_far")
    )
    one = sets.where("f = 1").withColumn("_x", F.element_at("far", 1)).join(more, "_x").withColumn("_twice", F.lit(False))
    many = sets.where("f > 1").select("node", "nodes", "hops", "far")
    each = many.select("node", F.explode("far").alias("_x")).join(more, "_x").groupBy("node").agg(F.collect_list(F.struct("_nodes", "_hops", "_far")).alias("_all"))
    each = each.select("node", *(F.flatten(f"_all.{c}").alias(c) for c in ("_nodes", "_hops", "_far")))
    each = each.withColumn("_far", F.array_distinct("_far")).withColumn("_twice", F.size(F.array_distinct("_nodes")) < F.size("_nodes"))
    columns = ["node", "nodes", "hops", "_nodes", "_hops", "_far", "_twice"]
    grown = one.select(columns).unionByName(many.join(each, "node").select(columns))
    again = F.col("_twice") | F.arrays_overlap("nodes", "_nodes") | F.array_contains("_nodes", F.col("node"))
    grown = grown.select("node", F.concat("nodes", "_nodes").alias("nodes"), F.concat("hops", "_hops").alias("hops"), F.col("_far").alias("far"), again.alias("again"))
    return sets.where("f = 0").unionByName(_sized(grown))


def _by_node(sets: DataFrame) -> DataFrame:
    """``sets`` with the rows marked ``again`` sorted by node, the fewest hops of each first."""
    both = sets.withColumn("_both", F.when(F.col("again"), F.sort_array(F.arrays_zip("nodes", "hops"))))
    return both.withColumns({c: F.when(F.col("again"), F.col(f"_both.{c}")).otherwise(F.col(c)) for c in ("nodes", "hops")}).drop("_both")


def _least(sets: DataFrame) -> DataFrame:
    """``sets``, all marked ``again``, with the fewest hops of each node, and none to a row's own."""
    first = lambda x, i: ~F.get("nodes", i - 1).eqNullSafe(x["nodes"]) & (x["nodes"] != F.col("node"))
    kept = _by_node(sets).withColumn("_kept", F.filter(F.arrays_zip("nodes", "hops"), first))
    return _sized(kept.withColumns({"nodes": F.col("_kept.nodes"), "hops": F.col("_kept.hops"), "again": F.lit(False)}))


def _pairs(sets: DataFrame, keys: DataFrame | None, onward: bool) -> DataFrame:
    """(root_id, node_id, hops) of ``sets``, whose rows are for roots if ``onward``, of those in ``keys`` if given."""
    if keys is not None:
        sets = sets.join(keys.withColumnRenamed("root_id", "node"), "node", "left_semi")
    each = _by_node(sets).select("node", "nodes", "hops", "again", F.posexplode("nodes").alias("_at", "_met"))
    each = each.where(~F.col("again") | ~F.get("nodes", F.col("_at") - 1).eqNullSafe(F.col("_met")) & (F.col("_met") != F.col("node")))
    root, node = ("node", "_met") if onward else ("_met", "node")
    return each.select(F.col(root).alias("root_id"), F.col(node).alias("node_id"), F.get("hops", F.col("_at")).cast("long").alias("hops"))


def newest_upstream(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """(node_id, newest): the latest ``changed_at`` of all that a node depends on, over any number of steps.

    ``changes`` is (node_id, changed_at). One value a node is sent on, and only where it rose, so there are
    no pairs of nodes, and cycles come to rest (there a node is upstream of itself). A round adds the values
    that rose in it to a table in buckets by node; neither edges nor older values are sent or written again.
    Nodes with nothing changed upstream have no row.
    """
    graph = _Edges(edges.select("from_id", "to_id").distinct())
    graph.lay_out()
    told = Bucketed(edges.sparkSession, "newest", "node_id")
    known = changes.where("node_id IS NOT NULL AND changed_at IS NOT NULL").groupBy("node_id").agg(F.max("changed_at").alias("sends"))
    told.add(known.select("node_id", "sends", F.lit(None).cast(known.schema["sends"].dataType).alias("newest"), F.lit(True).alias("rose")), 0)
    for step in count(1):
        news = told.rows(step - 1).where("rose").select(F.col("node_id").alias("from_id"), "sends")
        if news.isEmpty():
            break
        met = graph.onward(news).groupBy(F.col("to_id").alias("node_id")).agg(F.max("sends").alias("_met"))
        so_far = told.rows().select("node_id", "sends", "newest")
        both = met.hint("shuffle_hash").join(so_far, "node_id", "left").groupBy("node_id").agg(
            F.max("_met").alias("_met"), F.max("sends").alias("_sends"), F.max("newest").alias("_newest")
        )
        higher = lambda than: F.col(than).isNull() | (F.col("_met") > F.col(than))
        told.add(both.where(higher("_newest")).select("node_id", F.greatest("_sends", "_met").alias("sends"), F.col("_met").alias("newest"), higher("_sends").alias("rose")), step)
    found = durable(told.rows().where("newest IS NOT NULL").groupBy("node_id").agg(F.max("newest").alias("newest")), "newest")
    graph.laid.forget()
    told.forget()
    return found


def breaking_changes(drops: DataFrame, edges: DataFrame) -> DataFrame:
    """(dropped_id, dependent_id, hops): direct (1 hop) and transitive dependents of dropped objects."""
    found = closure(edges, drops.select(F.col("node_id").alias("root_id")))
    return found.select(F.col("root_id").alias("dropped_id"), F.col("node_id").alias("dependent_id"), "hops")


def topo_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, depth): edges on the longest path into each node; null on and after a cycle.

    A node is done in the round in which the last of its edges enters it, which is its depth, and then
    sends its own edges on; so each edge is sent once. A table in buckets by node counts the edges still due.
    """
    graph = _Edges(edges.select("from_id", "to_id").distinct())
    graph.lay_out()
    into = graph.rows.where("to_id IS NOT NULL").groupBy(F.col("to_id").alias("node_id"))
    due = Bucketed(edges.sparkSession, "due", "node_id")
    due.add(into.agg(F.count(F.lit(1)).alias("left"), F.lit(False).alias("done")), 0)
    # What nothing enters sends first; an edge from a node without a name is there from the start.
    ends = due.rows(0).select(F.col("node_id").alias("from_id"))
    first = Bucketed(edges.sparkSession, "first", "from_id")
    first.add(graph.rows.where("from_id IS NOT NULL").select("from_id").distinct().join(ends, "from_id", "left_anti"), 0)
    nameless = graph.rows.where("from_id IS NULL AND to_id IS NOT NULL").select("to_id")
    for step in count(1):
        news = first.rows().drop("step") if step == 1 else due.rows(step - 1).where("done").select(F.col("node_id").alias("from_id"))
        sent = graph.onward(news).select("to_id")
        if step == 1:
            sent = sent.unionByName(nameless)
        elif news.isEmpty():
            break
        met = sent.groupBy(F.col("to_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_met"))
        both = due.rows().join(met.hint("shuffle_hash"), "node_id").groupBy("node_id").agg(F.max("_met").alias("_met"), F.sum("left").alias("_left"))
        due.add(both.select("node_id", (-F.col("_met")).alias("left"), (F.col("_left") == F.col("_met")).alias("done")), step)
    deepest = due.rows().groupBy("node_id").agg(F.max(F.when(F.col("done"), F.col("step"))).cast("long").alias("depth"), F.lit(True).alias("_seen"))
    depths = nodes.select("node_id").distinct().join(deepest, "node_id", "left").select(
        "node_id", F.when(F.col("_seen"), F.col("depth")).otherwise(F.lit(0).cast("long")).alias("depth")
    )
    found = durable(depths, "depths")
    for table in (graph.laid, due, first):
        table.forget()
    return found


def order_ops(ops: DataFrame, edges: DataFrame, level: Column) -> DataFrame:
    """(position, op_id): every object after what it depends on, then by level and age; all ops of
    an object together in log order; ops without a target last."""
    nodes = nodes_from_ops(ops.where("target IS NOT NULL"), level)
    depths = topo_depth(nodes, edges)
    placed = durable(nodes.join(depths, "node_id").select(F.col("node_id").alias("target"), "depth", "level", "first_seq"), "placed")
    rows = skew_join(ops.select("op_id", "seq", "target"), placed, ["target"], "left")
    order = [F.asc_nulls_last("depth"), F.asc_nulls_last("level"), F.asc_nulls_last("first_seq"), F.asc_nulls_last("target"), F.asc("seq")]
    return global_position(rows, order, "position").select("position", "op_id")


def order_by_level(ops: DataFrame, level: Column) -> DataFrame:
    """(position, op_id, level) when no graph is wanted: by level, then log order."""
    return global_position(ops.select("op_id", "seq", level.alias("level")), ["level", "seq"], "position").select(
        "position", "op_id", "level"
    )


def _trim(graph: _Edges, rows: DataFrame) -> DataFrame:
    """Edges left when nodes without an in-edge or without an out-edge are taken off in turn."""
    size = rows.count()
    while size > 0:
        heads = rows.select(F.col("to_id").alias("from_id")).distinct()
        tails = rows.select(F.col("from_id").alias("to_id")).distinct()
        rows = durable(
            graph.meet(graph.meet(rows, heads, "from_id", "left_semi"), tails, "to_id", "left_semi"), "core"
        )
        left = rows.count()
        if left == size:
            break
        size = left
    return rows


def _ends(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("from_id").alias("node_id")).union(rows.select("to_id")).distinct()


def cyclic_core(edges: DataFrame) -> DataFrame:
    """(node_id, cycle_id) for nodes on cycles or between two of them.

    ``cycle_id`` is the least node of the strong component. Each pass spreads the least label
    forward; a node that keeps its own label roots a component, which is what reaches it back
    inside its label. Found components are taken off and the rest goes round again.
    """
    graph = _Edges(edges.select("from_id", "to_id").distinct())
    rows = _trim(graph, graph.rows)
    nodes = durable(_ends(rows), "nodes")
    rows = rows.where("from_id <> to_id")
    found = []
    while not nodes.isEmpty():
        labels = _least_ancestor(graph, rows, nodes)
        with_from = graph.meet(rows, labels.select(F.col("node_id").alias("from_id"), F.col("label").alias("_f")), "from_id")
        inner = durable(
            graph.meet(with_from, labels.select(F.col("node_id").alias("to_id"), F.col("label").alias("_t")), "to_id")
            .where("_f = _t")
            .select("from_id", "to_id"),
            "inner",
        )
        frontier = durable(labels.where("node_id = label").withColumnRenamed("label", "cycle_id"), "component")
        members = [frontier]
        while not frontier.isEmpty():
            back = graph.meet(inner, frontier.withColumnRenamed("node_id", "to_id"), "to_id")
            frontier = durable(
                back.select(F.col("from_id").alias("node_id"), "cycle_id").distinct()
                .join(_union(members).select("node_id"), "node_id", "left_anti"),
                "component",
            )
            members.append(frontier)
        taken = durable(_union(members), "component")
        found.append(taken)
        gone = taken.select("node_id")
        nodes = durable(nodes.join(gone, "node_id", "left_anti"), "nodes")
        rows = graph.meet(rows, gone.withColumnRenamed("node_id", "from_id"), "from_id", "left_anti")
        rows = durable(graph.meet(rows, gone.withColumnRenamed("node_id", "to_id"), "to_id", "left_anti"), "core")
        # What trimming takes off now lies between cycles: a component of its own.
        rows = _trim(graph, rows)
        still = durable(_ends(rows), "nodes")
        found.append(nodes.join(still, "node_id", "left_anti").withColumn("cycle_id", F.col("node_id")))
        nodes = still
    if not found:
        return nodes.withColumn("cycle_id", F.col("node_id"))
    return _union(found)


def _least_ancestor(graph: _Edges, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, label): the least of a node and all nodes it can be reached from.

    Only labels that fell in the last round are sent on.
    """
    labels = durable(nodes.withColumn("label", F.col("node_id")).withColumn("fell", F.lit(True)), "labels")
    while True:
        news = labels.where("fell").select(F.col("node_id").alias("from_id"), "label")
        sent = graph.meet(rows, news, "from_id").groupBy(F.col("to_id").alias("node_id")).agg(F.min("label").alias("least"))
        labels = durable(
            labels.join(sent, "node_id", "left").select(
                "node_id", F.least("label", "least").alias("label"), F.coalesce(F.col("least") < F.col("label"), F.lit(False)).alias("fell")
            ),
            "labels",
        )
        if labels.where("fell").isEmpty():
            return labels.drop("fell")


def graph_warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, node_id, dep_id): dependencies that do not exist, and ones on a deeper level.

    ``nodes`` is (node_id, level).
    """
    known = nodes.select("node_id", "level")
    both = skew_join(
        skew_join(edges, known.select(F.col("node_id").alias("to_id"), F.col("level").alias("_l")), ["to_id"]),
        known.select(F.col("node_id").alias("from_id"), F.col("level").alias("_d")), ["from_id"], "left",
    )
    code = F.when(F.col("_d").isNull(), "MISSING_DEPENDENCY").when(F.col("_l") < F.col("_d"), "INVALID_HIERARCHY")
    return both.select(code.alias("code"), F.col("to_id").alias("node_id"), F.col("from_id").alias("dep_id")).where(
        "code IS NOT NULL"
    )


def qualify_refs(defs: DataFrame, resolved: DataFrame, names: DataFrame) -> DataFrame:
    """(view_id, definition) with every resolved reference written as its full name, but not in
    literals or comments.

    ``names`` is (object_id, full_name). The references of one text are at most its words.
    """
    spelled = (
        skew_join(resolved.where("object_id IS NOT NULL"), names.select("object_id", "full_name"), ["object_id"])
        .groupBy("view_id")
        .agg(F.array_sort(F.collect_set(F.struct("ref", "full_name"))).alias("refs"))
    )
    text = F.when(F.col("refs").isNull(), F.col("definition")).otherwise(rewritten(F.col("definition"), F.col("refs")))
    return defs.join(spelled, "view_id", "left").select("view_id", text.alias("definition"))


def drop_before_add(ops: DataFrame, *, bits: int = BITS) -> DataFrame:
    """(table_id, position, constraint_id, op): a table's constraint drops first, then its adds.

    Places come from counts, not from an edge between every drop and every add.
    """
    phased = ops.withColumn("phase", F.when(F.col("op") == "drop_constraint", 0).otherwise(1))
    ranked = rank_within(phased, ["table_id", "phase"], "seq", "_r", bits=bits)
    drops = ops.groupBy("table_id").agg(F.count_if(F.col("op") == "drop_constraint").alias("_drops"))
    return skew_join(ranked, drops, ["table_id"]).select(
        "table_id", (F.col("_r") + F.when(F.col("phase") == 1, F.col("_drops")).otherwise(0)).alias("position"), "constraint_id", "op"
    )
