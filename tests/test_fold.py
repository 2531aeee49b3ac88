"""Folds against a literal op-by-op replay, on random logs cut into tiny buckets."""

import random

from pyspark.sql import functions as F

from catalogops.operators import diff, fold

BITS = 3


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lifetimes(spark):
    rng = random.Random(1)
    log = [(rng.choice([1, 1, 1, 2, 3]), s, rng.choice(["add", "add", "drop"])) for s in range(300)]
    want, alive = [], {}
    for i, s, kind in log:
        if kind == "add" and i not in alive:
            alive[i] = s
        elif kind == "drop" and i in alive:
            want.append((i, alive.pop(i), s))
    want += [(i, s, None) for i, s in alive.items()]
    events = spark.createDataFrame(log, "object_id INT, seq LONG, kind STRING")
    assert rows_of(fold.lifetimes(events, ["object_id"], bits=BITS)) == sorted(want, key=repr)


def test_cascade(spark):
    rng = random.Random(2)
    log = []
    for s in range(600):
        level = rng.choice(["catalog", "schema", "schema", "table", "table", "table", "table"])
        i = rng.randrange({"catalog": 2, "schema": 4, "table": 8}[level])
        parent = None if level == "catalog" else i % {"schema": 2, "table": 4}[level]
        log.append((s, level, i, parent, rng.choice(["add", "add", "add", "drop"])))
    done, alive = [], {}

    def close(level, i, s):
        start = alive.pop((level, i), None)
        if start is None:
            return
        done.append((level, i, start, s))
        child = {"catalog": "schema", "schema": "table"}.get(level)
        for (lv, j) in [k for k in alive if k[0] == child and j_parent(k, child) == i]:
            close(lv, j, s)

    def j_parent(k, child):
        return k[1] % {"schema": 2, "table": 4}[child]

    up = {"schema": "catalog", "table": "schema"}
    for s, level, i, parent, op in log:
        if op == "add":
            if (level, i) not in alive and (level == "catalog" or (up[level], parent) in alive):
                alive[(level, i)] = s
        else:
            close(level, i, s)
    want = done + [(lv, i, s, None) for (lv, i), s in alive.items()]
    df = spark.createDataFrame(log, "seq LONG, level STRING, id INT, parent_id INT, op STRING")
    got = fold.cascade_lifetimes(df, ["catalog", "schema", "table"], bits=BITS)
    assert rows_of(got) == sorted(want, key=repr)


def grant_log(seed, n):
    rng = random.Random(seed)
    log = []
    for s in range(n):
        listed = [p for p in ("SELECT", "MODIFY", "APPLY TAG") if rng.random() < 0.5]
        op = rng.choice(["add_grant", "revoke_grant", "revoke_grant"])
        if op == "revoke_grant" and rng.random() < 0.2:
            listed = None
        log.append((s, rng.randrange(3), rng.choice("ab"), op, listed))
    return log


def replay_grants(log):
    state = {}
    for _, t, p, op, listed in log:
        if op == "add_grant":
            state[(t, p)] = set(listed)
        elif listed is None:
            state.pop((t, p), None)
        elif (t, p) in state:
            state[(t, p)] -= set(listed)
    return sorted((t, p, x) for (t, p), held in state.items() for x in held)


GRANTS = "seq LONG, target_id INT, principal STRING, op STRING, privileges ARRAY<STRING>"


def test_grants_and_their_diff(spark):
    log = grant_log(3, 120)
    whole = fold.fold_grants(spark.createDataFrame(log, GRANTS))
    assert rows_of(whole) == replay_grants(log)
    old = fold.fold_grants(spark.createDataFrame(log[:50], GRANTS))
    changes = diff.diff_grants(old, whole).collect()
    # fold(old, diff(old, new)) = new: revokes first, then adds that carry the whole list.
    ops, seq = log[:50], 1000
    for c in sorted(changes, key=lambda c: c.action != "revoke_grant"):
        listed = (c.delta if c.action == "revoke_grant" else c.privileges).split(",")
        ops.append((seq, c.target_id, c.principal, c.action, listed))
        seq += 1
    assert replay_grants(ops) == replay_grants(log)
    assert diff.diff_grants(whole, whole).count() == 0


def test_column_order(spark):
    rng = random.Random(4)
    log = []
    for s in range(300):
        op = rng.choice(["add_column", "add_column", "drop_column", "reorder_columns"])
        log.append((s, rng.randrange(2), rng.randrange(8), op, [rng.randrange(8) for _ in range(4)]))
    tables = {0: [], 1: []}
    for _, t, c, op, listed in log:
        cols = tables[t]
        if op == "add_column" and c not in cols:
            cols.append(c)
        elif op == "drop_column" and c in cols:
            cols.remove(c)
        elif op == "reorder_columns":
            cols.sort(key=lambda x: listed.index(x) if x in listed else len(listed))
    want = sorted((t, c, i) for t, cols in tables.items() for i, c in enumerate(cols))
    df = spark.createDataFrame(log, "seq LONG, table_id INT, column_id INT, op STRING, listed ARRAY<INT>")
    assert rows_of(fold.fold_column_order(df, bits=BITS)) == sorted(want, key=repr)


def test_constraints(spark):
    rng = random.Random(5)
    log = [
        (s, rng.choice([0, 0, 0, 1]), rng.randrange(6), rng.choice(["add_constraint", "drop_constraint"]), rng.choice([None, 0, 1, 2, -1]))
        for s in range(400)
    ]
    lists = {0: [], 1: []}
    for _, t, c, op, at in log:
        l = lists[t]
        if op == "drop_constraint":
            if c in l:
                l.remove(c)
        elif c not in l:
            l.append(c) if at is None or at < 0 else l.insert(at, c)
    want = sorted(((t, c, i) for t, l in lists.items() for i, c in enumerate(l)), key=repr)
    df = spark.createDataFrame(log, "seq LONG, table_id INT, constraint_id INT, op STRING, insert_at INT")
    assert rows_of(fold.fold_constraints(df, bits=BITS)) == want


def tag_log(spark, seed=6, n=400):
    rng = random.Random(seed)
    log = [(s, rng.choice([0, 0, 1, 2]), rng.choice(["add", "drop", "set", "set", "unset"]), rng.choice("xyz"), str(s)) for s in range(n)]
    df = spark.createDataFrame(log, "seq LONG, object_id INT, op STRING, key STRING, value STRING")
    events = df.where("op IN ('add', 'drop')").select("object_id", "seq", F.col("op").alias("kind"))
    tags = df.where("op IN ('set', 'unset')").select("object_id", "key", "value", F.col("op").alias("action"), "seq")
    return log, events, tags


def replay_tags(log, upto):
    state = {}
    for s, i, op, k, v in log:
        if s > upto:
            break
        if op == "add":
            state.setdefault(i, {})
        elif op == "drop":
            state.pop(i, None)
        elif i in state:
            state[i].update({k: v}) if op == "set" else state[i].pop(k, None)
    return sorted((i, k, v) for i, held in state.items() for k, v in held.items())


def test_tags_snapshot_law_and_points(spark):
    log, events, tags = tag_log(spark)
    alive = fold.live(fold.lifetimes(events, ["object_id"], bits=BITS))
    full = fold.fold_map(tags, "object_id", alive).drop("value_seq")
    assert rows_of(full) == sorted(replay_tags(log, 10**9), key=repr)
    for at in (0, 57, 200):
        snap = fold.snapshot_of(events, tags, at, bits=BITS)
        again = fold.snapshot_plus_delta(*snap, events, tags, at, bits=BITS).drop("value_seq")
        assert rows_of(again) == rows_of(full)
    points = [10, 57, 200, 399]
    got = fold.states_at(events, tags, points, bits=BITS)
    want = [(*row, p) for p in points for row in replay_tags(log, p)]
    assert rows_of(got) == sorted(want, key=repr)


def test_map_diff_law(spark):
    log, events, tags = tag_log(spark, seed=8)
    old, new = fold.snapshot_of(events, tags, 150, bits=BITS)[1], fold.snapshot_of(events, tags, 399, bits=BITS)[1]
    state = {(r.object_id, r.key): r.value for r in old.collect()}
    for r in diff.diff_map(old, new, "object_id").collect():
        if r.action == "set":
            state[(r.object_id, r.key)] = r.value
        else:
            state.pop((r.object_id, r.key))
    assert state == {(r.object_id, r.key): r.value for r in new.collect()}
    assert diff.diff_map(new, new, "object_id").count() == 0


def test_undo_law(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], "id LONG, name STRING, comment STRING")
    new = spark.createDataFrame([(2, "bb", "y"), (3, "c", None), (4, "d", "w")], "id LONG, name STRING, comment STRING")

    def play(start, ops):
        state = {r.id: [r.name, r.comment] for r in start.collect()}
        for o in ops.orderBy("seq").collect():
            i = int(o.target)
            if o.op == "add_table":
                state[i] = [o.detail, None]
            elif o.op == "drop_table":
                state.pop(i)
            elif o.op == "rename_table":
                state[i][0] = o.detail
            else:
                state[i][1] = o.detail
        return {i: v[0] for i, v in state.items()}

    forward = diff.diff_to_ops([diff.row_ops(old, new, "id", "table", ["comment"])])
    back = diff.diff_to_ops([diff.row_ops(new, old, "id", "table", ["comment"])])
    assert play(old, forward) == {2: "bb", 3: "c", 4: "d"}
    assert play(new, back) == {1: "a", 2: "b", 3: "c"}


def test_rules(spark):
    log = [
        (1, 1, 1, "row_filter", "add", 0, True, "a"),
        (2, 1, 1, "row_filter", "update", None, None, "b"),
        (3, 1, 1, "row_filter", "update", None, False, None),
        (4, 1, 2, "column_mask", "add", 5, True, "m"),
        (5, 1, 2, "column_mask", "remove", None, None, None),
        (6, 1, 2, "column_mask", "update", None, None, "late"),
        (7, 1, 2, "column_mask", "add", 6, True, "n"),
    ]
    df = spark.createDataFrame(
        log, "seq LONG, table_id INT, rule_id INT, kind STRING, op STRING, column_id INT, enabled BOOLEAN, expression STRING"
    )
    assert rows_of(fold.fold_rules(df, bits=1)) == [
        (1, 1, "row_filter", 0, False, "b"), (1, 2, "column_mask", 6, True, "n"),
    ]


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id INT, name STRING")
    b = spark.createDataFrame([(None, 2), ("x", 1), (None, 2)], "name STRING, id INT")
    c = spark.createDataFrame([(1, "x"), (2, None)], "id INT, name STRING")
    digest = lambda df: fold.state_digest(df).first().digest
    assert digest(a) == digest(b) != digest(c)


def test_single_move_by_counts(spark):
    """Every order of four columns, against taking each column out of both lists."""
    from itertools import permutations

    from catalogops.operators import compact

    start = ["a", "b", "c", "d"]
    old, new, want = [], [], set()
    for t, order in enumerate(permutations(start)):
        old += [(t, c, i) for i, c in enumerate(start)]
        new += [(t, c, i) for i, c in enumerate(order)]
        for i, c in enumerate(order):
            rest = lambda cols: [x for x in cols if x != c]  # noqa: B023, E731
            if list(order) != start and rest(start) == rest(order) and start.index(c) != i:
                want.add((t, c, start.index(c), i))
                break
    side = lambda rows: spark.createDataFrame(rows, "table_id INT, column_id STRING, position LONG")
    got = compact.single_column_move(side(old), side(new))
    assert {tuple(r) for r in got.collect()} == want
