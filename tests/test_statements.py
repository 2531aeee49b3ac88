"""Statements of the change log's kinds."""

import json

from catalogops.functions.opkinds import FIELDS
from catalogops.operators import naming

ALL = dict(
    newName="new`x", comment="it's", managedLocation="s3://m", format="delta", location="s3://l", definition="SELECT {'comment} FROM t", volumeType="MANAGED",
    parameters="x INT", returnType="INT", language="SQL", body="x + 1", key="k", value="v", tagName="t", tagValue="", type="INT", newType="BIGINT", column="c",
    first="FIRST", nullable=False, name="n", expression="a > 0", udfExpression="f ON (a)", maskFunction="g", privileges=["SELECT", "MODIFY"], targetType="TABLE", principal="a b",
)


def rendered(spark, ops, names):
    rows = [(i, f"o{i}", op, target, {k: v if isinstance(v, str) else json.dumps(v) for k, v in payload.items()} if payload is not None else None) for i, (op, target, payload) in enumerate(ops)]
    frame = spark.createDataFrame(rows, "seq LONG, op_id STRING, op STRING, target STRING, payload MAP<STRING, STRING>")
    out = naming.render_statements(frame, spark.createDataFrame(names, "target STRING, full_name STRING"))
    return {r.op_id: (r.statement, r.error) for r in out.collect()}


def test_every_kind_is_written(spark):
    got = rendered(spark, [(kind, "x", ALL) for kind, *_ in FIELDS], [("x", "c.s.`t.1`.col")])
    assert len(got) == len(FIELDS) and all(s and e is None and "{path}" not in s and "[[" not in s for s, e in got.values())
    by_kind = {kind: got[f"o{i}"][0] for i, (kind, *_) in enumerate(FIELDS)}
    assert by_kind["rename_table"] == "ALTER TABLE `c`.`s`.`t.1`.`col` RENAME TO `new``x`"
    assert by_kind["add_view"] == "CREATE VIEW IF NOT EXISTS `c`.`s`.`t.1`.`col` COMMENT 'it''s' AS SELECT {'comment} FROM t"
    assert by_kind["set_nullable"] == "ALTER TABLE `c`.`s`.`t.1` ALTER COLUMN `col` SET NOT NULL"
    assert by_kind["set_column_tag"] == "ALTER TABLE `c`.`s`.`t.1` ALTER COLUMN `col` SET TAGS ('t' = '')"
    assert by_kind["add_grant"] == "GRANT SELECT, MODIFY ON TABLE `c`.`s`.`t.1`.`col` TO `a b`"
    assert by_kind["unset_view_property"] == "ALTER VIEW `c`.`s`.`t.1`.`col` UNSET TBLPROPERTIES IF EXISTS ('k')"


def test_no_op_is_lost(spark):
    ops = [("drop_table", "t", None), ("drop_table", "gone", {}), ("paint_table", "t", {}), (None, "t", {}), ("drop_table", None, {}), ("rename_table", "t", {"newName": ""}),
           ("set_table_comment", "t", {"comment": ""}), ("drop_column", "top", {}), ("add_constraint", "t", {"name": "pk", "type": "PRIMARY", "columns": ["a", "b"]})]
    got = rendered(spark, ops, [("t", "c.s.t"), ("top", "c")])
    assert [got[f"o{i}"] for i in range(len(ops))] == [
        ("DROP TABLE IF EXISTS `c`.`s`.`t`", None), (None, "UNKNOWN_NAME"), (None, "UNKNOWN_KIND"), (None, "UNKNOWN_KIND"), (None, "UNKNOWN_NAME"), (None, "MISSING_FIELD"),
        ("COMMENT ON TABLE `c`.`s`.`t` IS ''", None), (None, "MISSING_FIELD"), ("ALTER TABLE `c`.`s`.`t` ADD CONSTRAINT `pk` PRIMARY KEY (`a`, `b`)", None),
    ]
