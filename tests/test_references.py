"""Names in stored SQL: which words are tables, which are columns, and what hides them."""

import pytest
from pyspark.sql import functions as F

from catalogops.operators import graph

# text, tables, columns
CASES = {
    "ticks": ("SELECT * FROM `cat`.`sch`.`tbl`", {"cat.sch.tbl"}, set()),
    "odd ticks": ("SELECT `a b`.x FROM `my cat` . s.`t.1` `a b`", {"`my cat`.s.`t.1`"}, {"`a b`.x"}),
    "commas": ("SELECT id, name FROM a.t x, b.u AS y, v WHERE x.id IN (1, 2) ORDER BY name, y.k", {"a.t", "b.u", "v"}, {"id", "name", "x.id", "y.k"}),
    "expressions": ("select x, y+1, a.z from t a", {"t"}, {"x", "y", "a.z"}),
    "aliases": ("SELECT x one, f(y) two, 'l' three, CASE WHEN b THEN 1 END four, 5 AS five FROM t", {"t"}, {"x", "y", "b"}),
    "literals": ("SELECT 'from lost.a' AS s, \"from lost.b\" AS d, 'it''s from lost.c' FROM t -- join lost.d\n/* join lost.e */ WHERE t.k > 0", {"t"}, {"t.k"}),
    "escape": (r"SELECT 'a\' from lost.a' FROM t", {"t"}, set()),
    "functions": ("SELECT extract(year FROM d), trim(BOTH ' ' FROM upper(n)), substring(upper(q) FROM 2) FROM t", {"t"}, {"d", "n", "q"}),
    "distinct from": ("SELECT a IS DISTINCT FROM b AS e FROM t JOIN u ON t.k IS NOT DISTINCT FROM u.k", {"t", "u"}, {"a", "b", "t.k", "u.k"}),
    "nested": ("SELECT k FROM (SELECT k, extract(day from d) FROM (a.t JOIN b.u USING (k))) q, v WHERE EXISTS (SELECT 1 FROM w WHERE w.k = q.k)", {"a.t", "b.u", "v", "w"}, {"k", "d", "w.k", "q.k"}),
    "cte": ("WITH RECURSIVE r (n) AS (SELECT 1), `o` AS (SELECT * FROM s.r) SELECT r.n FROM r, O, x.o", {"s.r", "x.o"}, {"r.n"}),
    "merge": ("MERGE INTO c.s.t a USING s.src b ON a.id = b.id WHEN MATCHED THEN UPDATE SET a.v = b.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (b.id, b.v)", {"c.s.t", "s.src"}, {"a.id", "b.id", "a.v", "b.v", "id", "v"}),
    "merge query": ("MERGE INTO t USING (SELECT id FROM src) b ON t.id = b.id WHEN MATCHED THEN DELETE", {"t", "src"}, {"id", "t.id", "b.id"}),
    "insert": ("INSERT INTO s.t (a, b) SELECT a, b FROM u UNION ALL SELECT a, c FROM v", {"s.t", "u", "v"}, {"a", "b", "c"}),
    "table functions": ("SELECT id FROM range(10) r JOIN LATERAL (SELECT 1 FROM t) q LATERAL VIEW explode(arr) e AS z", {"t"}, {"id", "arr"}),
    "values": ("SELECT col1 FROM VALUES (1, 2), (3, 4)", set(), {"col1"}),
    "window": ("SELECT a.*, sum(x) OVER (PARTITION BY g ORDER BY h ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t a", {"t"}, {"x", "g", "h"}),
    "casts": ("SELECT CAST(x AS INT), y::bigint, j:a.b FROM t", {"t"}, {"x", "y", "j"}),
    "unclosed": ("SELECT a FROM t WHERE b = 'from lost.a", {"t"}, {"a", "b"}),
    "empty": ("", set(), set()),
    "no sql": ("NOT SQL ;;; ///", set(), None),
}


@pytest.fixture(scope="module")
def found(spark):
    defs = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [("null", None)], "view_id STRING, definition STRING")
    tables, columns = {}, {}
    for r in graph.extract_table_refs(defs).collect():
        tables.setdefault(r.view_id, []).append(r.ref)
    for r in graph.column_refs(defs).collect():
        columns.setdefault(r.view_id, []).append(r.ref)
    return tables, columns


@pytest.mark.parametrize("case", CASES)
def test_names(found, case):
    tables, columns = (sorted(side.get(case, [])) for side in found)
    assert tables == sorted(CASES[case][1])
    if CASES[case][2] is not None:
        assert columns == sorted(CASES[case][2])


def test_null_text_has_no_names(found):
    assert "null" not in found[0] and "null" not in found[1]


def test_known_columns(spark):
    defs = spark.createDataFrame([("v", "SELECT ID, b.other, unknown FROM t")], "view_id STRING, definition STRING")
    known = spark.createDataFrame([("id",), ("other",)], "column STRING")
    assert {r.ref for r in graph.column_refs(defs, known).collect()} == {"ID", "b.other"}


def test_qualify_outside_literals(spark):
    text = "SELECT 's.t', t FROM `s`.`t` a JOIN s . t b ON true /* s.t */ JOIN t -- s.t\n JOIN `s.t` JOIN x.s.t JOIN nowhere.u"
    defs = spark.createDataFrame([("v", text), ("w", "SELECT 1")], "view_id STRING, definition STRING")
    names = spark.createDataFrame([("table", "i1", "c", "s", "t"), ("table", "i2", "c", "z", "s.t")], "object_type STRING, object_id STRING, catalog STRING, schema STRING, name STRING")
    resolved = graph.resolve_refs(graph.extract_table_refs(defs), names, "c")
    assert {r.ref: r.object_id for r in resolved.collect()} == {"s.t": "i1", "t": "i1", "`s.t`": "i2", "x.s.t": None, "nowhere.u": None}
    full = spark.createDataFrame([("i1", "c.s.t"), ("i2", "c.z.`s.t`")], "object_id STRING, full_name STRING")
    got = {r.view_id: r.definition for r in graph.qualify_refs(defs, resolved, full).collect()}
    assert got["v"] == "SELECT 's.t', t FROM c.s.t a JOIN c.s.t b ON true /* s.t */ JOIN c.s.t -- s.t\n JOIN c.z.`s.t` JOIN x.s.t JOIN nowhere.u"
    assert got["w"] == "SELECT 1"


def test_long_text(spark):
    text = "SELECT " + ", ".join(f"a.c{i % 50} AS n{i}" for i in range(5_000)) + " FROM s.t a WHERE x IN (" + ",".join(["'from u'"] * 5_000) + ")"
    defs = spark.createDataFrame([("v", text)], "view_id STRING, definition STRING")
    assert [r.ref for r in graph.extract_table_refs(defs).collect()] == ["s.t"]
    assert graph.column_refs(defs).count() == 51


def test_texts_are_dealt_and_walked_once(spark):
    """One file of texts is not one task's to walk, and the join with known columns walks none again."""
    defs = spark.createDataFrame([(f"v{i}", f"SELECT a, b FROM t{i}") for i in range(64)], "view_id STRING, definition STRING").coalesce(1)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert all("RepartitionByExpression" in plan(rows) for rows in (graph.extract_table_refs(defs), graph.column_refs(defs)))
    known = graph.column_refs(defs, spark.createDataFrame([("A",)], "column STRING"))
    assert "RepartitionByExpression" not in plan(known) and "aggregate(" not in plan(known) and "column_names" not in plan(known)
    assert known.count() == 64 and {r.ref for r in known.collect()} == {"a"}


def test_odd_letters(spark):
    text = "SELECT é, x², FROM١ FROM 日本.表 JOIN `x y` ON is\n.n"
    defs = spark.createDataFrame([("v", text)], "view_id STRING, definition STRING")
    assert {r.ref for r in graph.extract_table_refs(defs).collect()} == {"日本.表", "`x y`"}
    assert {"é", "x"} <= {r.ref for r in graph.column_refs(defs).collect()}
