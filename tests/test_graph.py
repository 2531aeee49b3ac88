"""Graph loops against brute force on small random graphs."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from catalogops.operators import graph
from catalogops.plans import skew
from catalogops.session import work_folder


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    far = {}
    for n in nodes:
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        far[n] = seen
    return nodes, far


def frame(spark, edges):
    return spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "from_id STRING, to_id STRING")


@pytest.mark.parametrize("seed", [1, 2])
def test_cyclic_core(spark, seed, monkeypatch):
    if seed == 2:
        # Also walk the salted path.
        monkeypatch.setattr(skew, "HEAVY_ROWS", 2)
        monkeypatch.setattr(skew, "SALTS", 4)
    rng = random.Random(seed)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(17)} | {(20, 20)}
    nodes, far = reach(edges)
    cyc = {n for n in nodes if n in far[n]}
    core = {n for n in nodes if (n in cyc or any(n in far[c] for c in cyc)) and (n in cyc or far[n] & cyc)}
    want = {f"n{n}": min([f"n{m}" for m in far[n] if n in far[m]] + [f"n{n}"]) for n in core}
    got = {r.node_id: r.cycle_id for r in graph.cyclic_core(frame(spark, edges)).collect()}
    assert got == want


def test_depth_order_closure(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(16), 2))) for _ in range(26)}
    df = frame(spark, edges)
    nodes, far = reach(edges)
    depth = {}
    for n in sorted(nodes):
        depth[n] = max([depth[a] + 1 for a, b in edges if b == n], default=0)
    got = {r.node_id: r.depth for r in graph.topo_depth(graph._ends(df), df).collect()}
    assert got == {f"n{n}": d for n, d in depth.items()}
    roots = spark.createDataFrame([("n0",), ("n3",)], "root_id STRING")
    found = {(r.root_id, r.node_id) for r in graph.closure(df, roots).collect()}
    assert found == {(f"n{r}", f"n{x}") for r in (0, 3) if r in far for x in far[r]}
    ops = spark.createDataFrame([(s, f"o{s}", f"n{rng.randrange(16)}", "rename_table") for s in range(80)], "seq LONG, op_id STRING, target STRING, op STRING")
    placed = graph.order_ops(ops, df, F.lit(3)).join(ops, "op_id").orderBy("position").collect()
    assert [r.position for r in placed] == list(range(1, 81))
    first = {}
    last = {}
    for r in placed:
        first.setdefault(r.target, r.position)
        last[r.target] = r.position
    assert all(last[f"n{a}"] < first[f"n{b}"] for a, b in edges if f"n{a}" in last and f"n{b}" in first)


def test_depth_marks_cycles(spark):
    df = frame(spark, {(0, 1), (1, 2), (2, 1), (2, 3)})
    got = {r.node_id: r.depth for r in graph.topo_depth(graph._ends(df), df).collect()}
    assert got == {"n0": 0, "n1": None, "n2": None, "n3": None}


def test_references(spark):
    text = """WITH recent AS (SELECT * FROM main.sales.orders), other AS (SELECT 1)
      SELECT r.id, c.name FROM recent r JOIN sales.customers c ON r.cid = c.id
      LEFT JOIN Other o ON true WHERE r.id IN (SELECT x.id FROM sales.customers x)"""
    defs = spark.createDataFrame([("v", text)], "view_id STRING, definition STRING")
    assert {r.ref for r in graph.extract_table_refs(defs).collect()} == {"main.sales.orders", "sales.customers"}
    assert {r.ref for r in graph.column_refs(defs).collect()} == {"r.id", "c.name", "r.cid", "c.id", "x.id"}


def test_newest_upstream(spark):
    rng = random.Random(9)
    edges = {(rng.randrange(18), rng.randrange(18)) for _ in range(24)}
    nodes, far = reach(edges)
    changed = {n: rng.randrange(50) for n in nodes if n % 3}
    changes = spark.createDataFrame([(f"n{n}", v) for n, v in changed.items()] + [("n0", None), ("gone", 99)], "node_id STRING, changed_at INT")
    got = {r.node_id: r.newest for r in graph.newest_upstream(frame(spark, edges), changes).collect()}
    above = {n: [changed[a] for a in nodes if a in changed and n in far[a]] for n in nodes}
    assert got == {f"n{n}": max(v) for n, v in above.items() if v}
    assert graph.newest_upstream(frame(spark, {(1, 2)}).where("false"), changes).count() == 0


def test_constraint_order_edges(spark):
    ops = spark.createDataFrame(
        [("a1", "t", "add_constraint"), ("d1", "t", "drop_constraint"), ("d2", "t", "drop_constraint"), ("a2", "t", "add_constraint"), ("a3", "u", "add_constraint"), ("x", "t", "add_table"), ("n", None, "add_constraint")],
        "op_id STRING, table_id STRING, op STRING",
    )
    rows = graph.constraint_order_edges(ops)
    got = {(r.from_id, r.to_id) for r in rows.collect()}
    assert got == {("t", "d1"), ("t", "d2"), ("d1", "drops:t"), ("d2", "drops:t"), ("drops:t", "a1"), ("drops:t", "a2"), ("u", "a3")}
    depth = {r.node_id: r.depth for r in graph.topo_depth(graph._ends(rows), rows).collect()}
    assert max(depth["d1"], depth["d2"]) < min(depth["a1"], depth["a2"]) and depth["u"] < depth["a3"]


def test_closure_reads_what_it_reached_seldom(spark, monkeypatch):
    """Fewest hops with circles and short cuts; pairs reached before are read in rounds 1, 2, 4, 8, ... only."""
    read, union = [], graph._union
    monkeypatch.setattr(graph, "_union", lambda frames: read.append(len(frames)) or union(frames))
    edges = [(i, i + 1) for i in range(11)] + [(0, 6), (2, 5), (9, 7), (11, 11)]
    hops = {}
    for root in (0, 3, 99):
        front, step = {root}, 0
        while front:
            step += 1
            front = {b for a, b in edges if a in front} - {n for r, n in hops if r == root} - {root}
            hops |= {(root, n): step for n in front}
    roots = spark.createDataFrame([("n0",), ("n3",), ("n99",)], "root_id STRING")
    got = {(r.root_id, r.node_id): r.hops for r in graph.closure(frame(spark, edges), roots).collect()}
    assert got == {(f"n{r}", f"n{n}"): h for (r, n), h in hops.items()}
    assert len(read) <= 6


def test_closure_keeps_ends_without_a_name(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", None), ("b", None), (None, "a")], "from_id STRING, to_id STRING")
    got = {(r.root_id, r.node_id, r.hops) for r in graph.closure(edges, spark.createDataFrame([("a",)], "root_id STRING")).collect()}
    assert got == {("a", "b", 1), ("a", "c", 1), ("a", None, 2)}


def written_rows(spark, run):
    """Rows of all tables that a call writes to the shared folder."""
    folder = work_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    run()
    return sum(spark.read.parquet(f"{folder}/{name}").count() for name in set(os.listdir(folder)) - before)


def test_loops_write_each_edge_and_node_a_few_times_however_many_rounds(spark):
    # A chain of 12 with 300 leaves below its end: many rounds, in most of which the leaves have nothing new.
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 100 + i) for i in range(300)], "from_id INT, to_id INT")
    changes = spark.createDataFrame([(0, dt.datetime(2025, 1, 1))], "node_id INT, changed_at TIMESTAMP")
    found = {}
    newest = written_rows(spark, lambda: found.update(newest={r.node_id for r in graph.newest_upstream(edges, changes).collect()}))
    depth = written_rows(spark, lambda: found.update(depth={r.node_id: r.depth for r in graph.topo_depth(graph._ends(edges), edges).collect()}))
    assert found["newest"] == {*range(1, 13), *range(100, 400)}
    assert found["depth"] == {i: i for i in range(13)} | {100 + i: 13 for i in range(300)}
    assert newest < 5 * 320 and depth < 6 * 320


def test_hub_edges_lie_beside_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 5)
    df = spark.createDataFrame([(0, 1), (10, 50), (50, 51), (0, 51)] + [(1, 10 + i) for i in range(20)], "from_id INT, to_id INT")
    assert {r.node_id: r.depth for r in graph.topo_depth(graph._ends(df), df).collect()} == {0: 0, 1: 1, **{10 + i: 2 for i in range(20)}, 50: 3, 51: 4}
    at = lambda day: dt.datetime(2025, 1, day)
    changes = spark.createDataFrame([(0, at(1)), (10, at(3)), (51, at(9))], "node_id INT, changed_at TIMESTAMP")
    got = {r.node_id: r.newest for r in graph.newest_upstream(df, changes).collect()}
    assert got == {1: at(1), **{10 + i: at(1) for i in range(20)}, 50: at(3), 51: at(3)}


def test_nameless_ends_in_depth_and_newest(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (2, None), (None, None), (5, 5), (5, 6)], "from_id INT, to_id INT")
    got = {r.node_id: r.depth for r in graph.topo_depth(graph._ends(df), df).collect()}
    assert got == {None: 0, 1: 1, 2: 2, 5: None, 6: None}
    changes = spark.createDataFrame([(None, dt.datetime(2025, 1, 2)), (1, dt.datetime(2025, 1, 1)), (5, None)], "node_id INT, changed_at TIMESTAMP")
    assert [tuple(r) for r in graph.newest_upstream(df, changes).collect()] == [(2, dt.datetime(2025, 1, 1))]


def fewest(edges, roots):
    """Brute force: (root, node) -> hops."""
    hops = {}
    for root in roots:
        seen, front, step = {root}, {root}, 0
        while front:
            step += 1
            front = {b for a, b in edges if a in front} - seen
            seen |= front
            hops |= {(root, n): step for n in front}
    return hops


def closed(spark, edges, roots):
    named = spark.createDataFrame([(f"n{r}",) for r in roots], "root_id STRING")
    rows = graph.closure(frame(spark, edges), named).collect()
    got = {(int(r.root_id[1:]), int(r.node_id[1:])): r.hops for r in rows}
    assert len(got) == len(rows)
    return got


def test_closure_takes_rounds_by_the_bits_of_its_hops(spark, monkeypatch):
    """A chain of 70 with short cuts, from its top and from all of its nodes: few tables are written, and few rows."""
    written, durable = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, label="cut": written.append(label) or durable(df, label))
    edges = {(i, i + 1) for i in range(70)} | {(3, 9), (20, 41), (22, 40)} | {(i, 100 + i) for i in range(0, 70, 7)}
    for roots in ([0, 30], [*range(71)]):
        written.clear()
        assert closed(spark, edges, roots) == fewest(edges, roots)
        assert len(written) < 35 and "reached" not in written
    rows = written_rows(spark, lambda: closed(spark, edges, [*range(71)]))
    assert rows < 20 * len(edges) < len(fewest(edges, range(71)))


@pytest.mark.parametrize("held", [1 << 16, 6, 1])
def test_closure_by_jumps_and_steps(spark, monkeypatch, held):
    """Random graphs with circles, from few roots and from all, turned round too; rows that would hold too much leave the rest to steps."""
    monkeypatch.setattr(graph, "HELD", held)
    stepped, by_steps = [], graph._by_steps
    monkeypatch.setattr(graph, "_by_steps", lambda *a: stepped.append(a[2]) or by_steps(*a))
    rng = random.Random(4)
    edges = {(rng.randrange(15), rng.randrange(15)) for _ in range(16)} | {(20, i) for i in range(5)}
    for way, roots in ((edges, [2, 20, 99]), ({(b, a) for a, b in edges}, [*range(21)])):
        assert closed(spark, way, roots) == fewest(way, roots)
    assert bool(stepped) == (held < 1 << 16)
    assert held != 6 or max(stepped) > 0


def test_closure_holds_rows_for_the_ends_that_branch_less(spark):
    # One top above a tree: from all nodes up, rows are for roots; from the top down, they are for the nodes met.
    edges = {(i // 2, i) for i in range(1, 300)}
    up = {(b, a) for a, b in edges}
    assert closed(spark, up, [*range(300)]) == fewest(up, range(300))
    assert closed(spark, edges, [0, 5]) == fewest(edges, [0, 5])
    longest, pairs = [], graph._pairs
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(graph, "_pairs", lambda sets, *a: longest.append(sets.agg(F.max("n")).first()[0]) or pairs(sets, *a))
        closed(spark, up, [*range(300)])
        closed(spark, edges, [0, 5])
    assert longest[0] <= 10 and longest[1] <= 2


def test_closure_of_no_edges_or_no_roots(spark):
    assert closed(spark, {(1, 2)}, [7]) == {}
    none = frame(spark, {(1, 2)}).where("false")
    assert graph.closure(none, spark.createDataFrame([("n1",)], "root_id STRING")).count() == 0
    assert graph.closure(frame(spark, {(1, 2)}), spark.createDataFrame([], "root_id STRING")).count() == 0
    assert graph.closure(frame(spark, {(1, 2)}), spark.createDataFrame([(None,)], "root_id STRING")).count() == 0
