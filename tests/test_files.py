"""Readers of change log, snapshot and configuration files; script scans."""

import json

from catalogops.operators import evolve, quality, secure
from catalogops.sources import corpus, files


def test_pretty_printed_changelog(spark, tmp_path):
    doc = {
        "version": 1, "sinceSnapshot": "v0.1.0",
        "ops": [
            {"id": "op_1", "ts": "2025-01-01T00:00:00.000Z", "provider": "p", "op": "add_column", "target": "c1", "payload": {"tableId": "t", "nullable": True, "order": ["a", "b"]}},
            {"ts": "2025-01-01T00:00:00.000Z", "provider": "p", "op": "drop_column", "target": "c1", "payload": {}},
        ],
    }
    (tmp_path / "changelog.json").write_text(json.dumps(doc, indent=2))
    rows = files.read_changelog(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r.op_id, r.op, r["index"]) for r in rows] == [("op_1", "add_column", 0), (None, "drop_column", 1)]
    payload = dict(rows[0].payload)
    # Nested values stay JSON text.
    assert json.loads(payload.pop("order")) == ["a", "b"]
    assert payload == {"tableId": "t", "nullable": "true"}


def test_snapshot_and_config(spark, tmp_path):
    state = {"catalogs": [{"id": "c", "name": "main", "schemas": [{"id": "s", "name": "raw", "tables": [{"id": "t", "name": "users", "columns": [{"id": "k", "name": "id", "type": "BIGINT", "nullable": False}]}], "views": [{"id": "v", "name": "all_users"}]}]}]}
    (tmp_path / "a.json").write_text(json.dumps({"version": "v0.1.0", "state": state}, indent=1))
    got = files.read_snapshots(spark, str(tmp_path / "a.json"))
    assert {(r.object_type, r.object_id, r.parent_id) for r in got["objects"].collect()} == {("catalog", "c", None), ("schema", "s", "c"), ("table", "t", "s"), ("view", "v", "s")}
    assert [(r.column_id, r.type, r.position) for r in got["columns"].collect()] == [("k", "BIGINT", 0)]
    config = {"environments": {"dev": {"catalogMappings": {"main": "dev_main"}, "managedCategories": ["governance"], "existingObjects": {"catalog": ["main"]}}}, "externalLocations": {"raw": {"paths": {"dev": "s3://d"}}}}
    (tmp_path / "b.json").write_text(json.dumps(config, indent=1))
    rows = files.read_env_config(spark, str(tmp_path / "b.json"))
    assert [tuple(r) for r in rows["mappings"].collect()] == [("dev", "main", "dev_main")]
    assert [tuple(r) for r in rows["managed"].collect()] == [("dev", "governance")]
    assert [tuple(r) for r in rows["existing"].collect()] == [("dev", "catalog", "main")]
    assert [tuple(r) for r in rows["locations"].collect()] == [("raw", "dev", "s3://d")]


def test_scripts(spark, tmp_path):
    text = """-- head; not a statement
CREATE TABLE IF NOT EXISTS a.b (id BIGINT NOT NULL COMMENT 'x; y, z', m MAP<STRING, ARRAY<INT>>, `d` DECIMAL(10, 2) DEFAULT 1,
  CONSTRAINT pk PRIMARY KEY (id));
   -- another
INSERT INTO t VALUES ('a;b', "c;d"); CREATE OR REPLACE VIEW `a`.`v` AS SELECT ';' AS s
"""
    (tmp_path / "one.sql").write_text(text)
    rows = corpus.statements(corpus.read_scripts(spark, str(tmp_path)))
    got = [(r.idx, r.kind, r.name) for r in rows.orderBy("idx").collect()]
    assert got == [(0, "create_table", "a.b"), (1, "unsupported", None), (2, "create_view", "a.v")]
    columns = corpus.columns_from_ddl(rows).orderBy("position").collect()
    assert [(c.column, c.type, c.nullable, c.comment) for c in columns] == [
        ("id", "BIGINT", False, "x; y, z"), ("m", "MAP<STRING, ARRAY<INT>>", True, None), ("d", "DECIMAL(10, 2)", True, None),
    ]


def test_script_edges(spark):
    texts = {
        "apostrophes": ("SELECT 1; -- it's\nDROP TABLE a; -- don't\nDROP TABLE b; /* that's; */ DROP TABLE c", ["skipped"] * 4),
        "unclosed literal": ("CREATE TABLE a.b (x INT); CREATE VIEW v AS SELECT 'x; DROP TABLE t", ["created", "error"]),
        "escaped quote": (r"CREATE VIEW v AS SELECT 'it\'s; fine'; ALTER TABLE t ADD c", ["created", "changed"]),
        "open escape": (r"CREATE VIEW v AS SELECT 'it\'", ["error"]),
        "unclosed comment": ("DROP TABLE a; /* left open; DROP TABLE b", ["skipped", "error"]),
        "no name": ("CREATE TABLE (x INT); COMMENT ON TABLE t IS 'x'", ["error", "changed"]),
        "ticks": ("CREATE TABLE `a;b`.`c d` (x INT)", ["created"]),
        "blank": (" ;; -- nothing\n", []),
        "null": (None, []),
    }
    rows = corpus.statements(spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "script_id STRING, script STRING"))
    got = {}
    for r in rows.orderBy("script_id", "idx").collect():
        got.setdefault(r.script_id, []).append(r.status)
    assert got == {k: v[1] for k, v in texts.items() if v[1]}
    report = {r.kind: tuple(r)[1:] for r in corpus.scan_report(rows).collect()}
    assert report["create_view"] == (3, 1, 0, 2) and report["create_table"] == (3, 2, 0, 1)


def test_column_lists_of_any_depth(spark):
    deep = "INT"
    for i in range(12):
        deep = f"STRUCT<f{i}: ARRAY<{deep}>, g: MAP<STRING, DECIMAL(4, 2)>>"
    text = f"""CREATE TABLE t (a {deep} NOT NULL COMMENT 'it''s, NOT NULL', `check` INT CHECK (`check` > 1 AND a < 2), "primary" STRING DEFAULT ')',
      constraint INT, CONSTRAINT c CHECK (a > 0), FOREIGN KEY (a) REFERENCES u (b)) PARTITIONED BY (a); CREATE TABLE u AS SELECT (1) AS x; CREATE TABLE v ()"""
    rows = corpus.statements(spark.createDataFrame([("s", text)], "script_id STRING, script STRING"))
    got = [(r.table_name, r.column, r.type, r.nullable, r.comment) for r in corpus.columns_from_ddl(rows).orderBy("position").collect()]
    assert got == [
        ("t", "a", deep, False, "it's, NOT NULL"), ("t", "check", "INT", True, None), ("t", '"primary"', "STRING", True, None), ("t", "constraint", "INT", True, None),
    ]


def test_long_script(spark):
    text = "INSERT INTO t VALUES " + ",".join("('v;%d')" % i for i in range(50_000)) + "; DROP TABLE t"
    rows = corpus.statements(spark.createDataFrame([("s", text)], "script_id STRING, script STRING"))
    assert rows.count() == 2


def test_latest_version_is_semantic(spark, tmp_path):
    state = spark.range(3)
    for v in ("v0.9.0", "v0.10.0"):
        files.write_snapshot(state, str(tmp_path / "s"), v)
    latest = files.read_latest_snapshot(spark, str(tmp_path / "s"), "id LONG, version STRING")
    assert {r.version for r in latest.collect()} == {"v0.10.0"}


def test_not_null_and_masks(spark):
    df = spark.createDataFrame([(1, "ann"), (None, "bob")], "id INT, name STRING")
    try:
        evolve.set_not_null(df, ["id"])
        raise AssertionError("nulls went unseen")
    except ValueError as e:
        assert "id (1)" in str(e)
    assert {r.name for r in evolve.set_not_null(df, ["name"]).collect()} == {"ann", "bob"}
    masked = secure.apply_column_masks(df, {"name": "CASE WHEN current_user() = 'o''neil' THEN name ELSE '*' END"}, "eve")
    assert {r.name for r in masked.collect()} == {"*"}
    assert secure.apply_row_filter(df, ["name = current_user()"], "bob").count() == 1
    report = quality.constraint_report(
        {"t": df, "none": df.where("false")},
        [{"table": "t", "name": "pk", "type": "primary_key", "columns": ["id"]}, {"table": "none", "name": "ck", "type": "check", "expression": "id > 0"}],
    )
    assert {(r["constraint"], r.violations, r.level) for r in report.collect()} == {("pk", 1, "RISKY"), ("ck", 0, "SAFE")}


def test_scripts_are_dealt(spark):
    scripts = spark.createDataFrame([(i, f"CREATE TABLE t{i} (a INT);") for i in range(64)], "script_id INT, script STRING").coalesce(1)
    rows = corpus.statements(scripts)
    assert "RepartitionByExpression" in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == 64
