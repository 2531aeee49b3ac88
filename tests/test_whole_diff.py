"""The whole difference: applying it gives the other state, both ways, for every kind of object and attribute."""

import random

import pytest
from test_fold import rows_of

from catalogops.operators import whole
from catalogops.plans import ordered, skew

REAL = skew.heavy_keys

FRAMES = {
    "objects": "object_type STRING, object_id STRING, parent_id STRING, name STRING, comment STRING",
    "entries": "object_id STRING, kind STRING, key STRING, value STRING",
    "constraints": "table_id STRING, constraint_id STRING, type STRING, expression STRING",
    "places": "table_id STRING, column_id STRING, position LONG",
    "grants": "target_id STRING, principal STRING, privilege STRING",
}


def random_state(rng):
    """A small hierarchy in which ids often meet those of another state, sometimes in another container."""
    objects = [("catalog", f"c{i}", None) for i in range(3) if rng.random() < 0.8]
    for kind, mark, n in (("schema", "s", 6), ("table", "t", 14), ("column", "k", 40)):
        above = {"schema": "catalog", "table": "schema", "column": "table"}[kind]
        parents = [o[1] for o in objects if o[0] == above]
        for i in range(n):
            if parents and rng.random() < 0.8:
                usual = parents[i % len(parents)]
                objects.append((kind, f"{mark}{i}", usual if rng.random() < 0.9 else rng.choice(parents)))
    rows = [(*o, o[1] + rng.choice(["", "", "x"]), rng.choice([None, "a", "b"])) for o in objects]
    ids = [o[1] for o in objects]
    tables = [o[1] for o in objects if o[0] == "table"]
    entries = [(i, kind, key, rng.choice([None, "1", "2"])) for i in ids for kind in ("tag", "property") for key in "pq" if rng.random() < 0.4]
    constraints = [(t, f"u{i}", rng.choice(["check", "primary_key"]), rng.choice(["x > 1", "y: 2"])) for t in tables for i in range(3) if rng.random() < 0.5]
    places = []
    for t in tables:
        own = [o[1] for o in objects if o[2] == t]
        if rng.random() < 0.4:
            rng.shuffle(own)
        places += [(t, c, i) for i, c in enumerate(own)]
    grants = [(i, p, x) for i in ids for p in "mn" for x in ("MODIFY", "SELECT") if rng.random() < 0.3]
    return rows, entries, constraints, places, grants


def frames(spark, rows):
    return whole.State(*(spark.createDataFrame(r, s) for r, s in zip(rows, FRAMES.values(), strict=True)))


@pytest.mark.parametrize("seed", range(3))
def test_the_diff_applied_gives_the_other_state(spark, seed):
    rng = random.Random(seed)
    a, b = random_state(rng), random_state(rng)
    old, new = frames(spark, a), frames(spark, b)
    ops = whole.whole_diff(old, new)
    kinds = {r["op"] for r in ops.collect()}
    assert {"drop_table", "add_column", "set_tag", "set_property", "add_constraint", "add_grant"} <= kinds
    for got, want in zip(whole.applied(old, ops), b, strict=True):
        assert rows_of(got.select(*got.columns)) == sorted(set(want), key=repr)


def test_back_again_and_no_difference(spark):
    rng = random.Random(9)
    a, b = random_state(rng), random_state(rng)
    old, new = frames(spark, a), frames(spark, b)
    back = whole.applied(whole.applied(old, whole.whole_diff(old, new)), whole.whole_diff(new, old))
    for got, want in zip(back, a, strict=True):
        assert rows_of(got) == sorted(set(want), key=repr)
    assert whole.whole_diff(old, old).count() == 0
    assert all(f.count() == 0 for f in whole.applied(old, whole.whole_diff(old, old.nothing())))


def test_a_dropped_container_is_one_op_and_a_moved_one_is_added_whole(spark):
    tree = lambda schema: [("catalog", "c", None, "c", None), ("schema", "s", "c", "s", None), ("schema", "r", "c", "r", None), ("table", "t", schema, "t", "note"), ("column", "k", "t", "k", None)]
    rest = ([("t", "tag", "p", "1")], [("t", "u", "check", "x")], [("t", "k", 0)], [("t", "m", "SELECT")])
    old, new = frames(spark, (tree("s"), *rest)), frames(spark, (tree("r"), *rest))
    assert [tuple(r)[1:] for r in whole.whole_diff(old, new).orderBy("seq").collect()] == [
        ("drop_table", "t", None, None), ("add_table", "t", "r", "t"), ("add_column", "k", "t", "k"), ("set_table_comment", "t", None, "note"),
        ("set_tag", "t", "p", "1"), ("add_constraint", "t", "u", "check: x"), ("add_grant", "t", "m", "SELECT"),
    ]
    gone = frames(spark, ([("catalog", "c", None, "c", None)], [], [], [], []))
    assert [r["op"] for r in whole.whole_diff(old, gone).orderBy("seq").collect()] == ["drop_schema", "drop_schema"]


def test_joins_of_the_diff_read_each_frame_without_looking_for_hot_keys_first(spark, monkeypatch):
    """A look for hot keys before a join reads and sends its frame again: only places are looked through, by hash."""
    looked = []
    monkeypatch.setattr(skew, "heavy_keys", lambda df, keys, share=0: looked.append(keys) or REAL(df, keys))
    rng = random.Random(4)
    old, new = frames(spark, random_state(rng)), frames(spark, random_state(rng))
    ops = whole.whole_diff(old.consistent(), new.consistent())
    assert ops.count() > 0 and looked == []


def test_places_of_heavy_and_other_keys(spark, monkeypatch):
    rows = [("a", i * 7 % 40) for i in range(40)] + [("b", 3), ("b", 1), (None, 5)]
    df = spark.createDataFrame(rows, "k STRING, v INT")
    want = sorted([("a", i, i) for i in range(40)] + [("b", 1, 0), ("b", 3, 1)])
    for least in (skew.HEAVY_ROWS, 10):
        monkeypatch.setattr(skew, "HEAVY_ROWS", least)
        got = ordered.position_within(df, ["k"], ["v"], "at")
        assert got.schema["at"].dataType.typeName() == "long"
        assert sorted(map(tuple, got.collect())) == want
