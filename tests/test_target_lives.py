"""Nested folds against an op-by-op replay in which targets are dropped and added again."""

import random

import pytest
from pyspark.sql import functions as F
from test_fold import GRANTS, rows_of

from catalogops.operators import fold

BITS = 3


def target_log(rng, n, targets=3):
    """(seq, target, kind) at every fourth seq, so that the ops between have seqs of their own."""
    return [(4 * s, rng.randrange(targets), rng.choice(["add", "add", "drop"])) for s in range(n)]


def lives(spark, log, key):
    return fold.lifetimes(spark.createDataFrame(log, f"seq LONG, {key} INT, kind STRING"), [key], bits=BITS)


def replayed(targets, ops, act):
    """{target: state} at the end; ``act(state, op)`` changes the state of a target that is there."""
    state = {}
    for row in sorted([(s, 0, t, k) for s, t, k in targets] + [(o[0], 1, o[1], o) for o in ops], key=lambda r: r[0]):
        seq, is_op, target, what = row
        if is_op:
            if target in state:
                act(state[target], what)
        elif what == "add":
            state.setdefault(target, {})
        else:
            state.pop(target, None)
    return state


def ops(rng, n, make):
    return [(4 * rng.randrange(n) + 1 + i % 3, *make()) for i in range(2 * n)]


def unique(rows):
    return list({r[0]: r for r in rows}.values())


def test_lives_split_a_log(spark):
    rng = random.Random(1)
    targets = target_log(rng, 120)
    log = unique(ops(rng, 120, lambda: (rng.randrange(3), rng.randrange(9))))
    want, start, ends = [], {}, {}
    for seq, is_op, target, value in sorted([(s, 0, t, k) for s, t, k in targets] + [(s, 1, t, v) for s, t, v in log]):
        if is_op and target in start:
            want.append((seq, target, value, start[target]))
        elif not is_op and value == "add":
            start.setdefault(target, seq)
        elif not is_op and target in start:
            ends[(target, start.pop(target))] = seq
    frame = spark.createDataFrame(log, "seq LONG, target INT, value INT")
    spans = lives(spark, targets, "target")
    assert rows_of(fold.in_lives(frame, spans, "target", bits=BITS)) == sorted([(*w, ends.get((w[1], w[3]))) for w in want], key=repr)
    now = fold.in_current_lives(frame, spans, "target", bits=BITS)
    assert rows_of(now) == sorted([w[:3] for w in want if (w[1], w[3]) not in ends], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_grants_of_present_lives(spark, seed):
    rng = random.Random(seed)
    targets = target_log(rng, 90)

    def make():
        op = rng.choice(["add_grant", "revoke_grant"])
        listed = [p for p in ("SELECT", "MODIFY", "APPLY TAG") if rng.random() < 0.5]
        return rng.randrange(3), rng.choice("ab"), op, listed if op == "add_grant" or rng.random() < 0.8 else None

    def act(state, o):
        _, _, who, op, listed = o
        state[who] = set(listed) if op == "add_grant" else state.get(who, set()) - set(listed) if listed else set()

    log = unique(ops(rng, 90, make))
    want = sorted(((t, who, p) for t, held in replayed(targets, log, act).items() for who, ps in held.items() for p in ps), key=repr)
    frame = spark.createDataFrame(log, GRANTS)
    assert rows_of(fold.fold_grants(frame, lives(spark, targets, "target_id"), bits=BITS)) == want
    # fold(full) = fold(snapshot + delta): the state at a point, as adds at that point, and what came after.
    at = 180
    early = lives(spark, [t for t in targets if t[0] <= at], "target_id")
    held = fold.fold_grants(frame.where(F.col("seq") <= at), early, bits=BITS)
    whole = held.groupBy("target_id", "principal").agg(F.collect_set("privilege").alias("privileges"))
    delta = whole.select(F.lit(at).cast("long").alias("seq"), "target_id", "principal", F.lit("add_grant").alias("op"), "privileges").unionByName(frame.where(F.col("seq") > at))
    assert rows_of(fold.fold_grants(delta, lives(spark, targets, "target_id"), bits=BITS)) == want


@pytest.mark.parametrize("seed", range(3))
def test_columns_and_constraints_of_present_lives(spark, seed):
    rng = random.Random(10 + seed)
    targets = target_log(rng, 90)
    spans = lives(spark, targets, "table_id")

    def make_column():
        op = rng.choice(["add_column", "add_column", "drop_column", "reorder_columns"])
        return rng.randrange(3), rng.randrange(6), op, rng.sample(range(6), 3)

    def act_column(state, o):
        order = state.setdefault("order", [])
        _, _, column, op, listed = o
        if op == "add_column" and column not in order:
            order.append(column)
        elif op == "drop_column" and column in order:
            order.remove(column)
        elif op == "reorder_columns":
            first = [c for c in listed if c in order]
            order[:] = first + [c for c in order if c not in first]

    log = unique(ops(rng, 90, make_column))
    want = sorted(((t, c, i) for t, s in replayed(targets, log, act_column).items() for i, c in enumerate(s.get("order", []))), key=repr)
    frame = spark.createDataFrame(log, "seq LONG, table_id INT, column_id INT, op STRING, listed ARRAY<INT>")
    assert rows_of(fold.fold_column_order(frame, spans, bits=BITS)) == want

    def make_constraint():
        return rng.randrange(3), rng.randrange(6), rng.choice(["add_constraint", "add_constraint", "drop_constraint"]), rng.choice([None, 0, 1, 2])

    def act_constraint(state, o):
        held = state.setdefault("list", [])
        _, _, constraint, op, at = o
        if op == "drop_constraint" and constraint in held:
            held.remove(constraint)
        elif op == "add_constraint" and constraint not in held:
            held.insert(len(held) if at is None else at, constraint)

    log = unique(ops(rng, 90, make_constraint))
    want = sorted(((t, c, i) for t, s in replayed(targets, log, act_constraint).items() for i, c in enumerate(s.get("list", []))), key=repr)
    frame = spark.createDataFrame(log, "seq LONG, table_id INT, constraint_id INT, op STRING, insert_at INT")
    assert rows_of(fold.fold_constraints(frame, spans, bits=BITS)) == want


@pytest.mark.parametrize("seed", range(3))
def test_rules_and_mask_links_of_present_lives(spark, seed):
    rng = random.Random(20 + seed)
    targets = target_log(rng, 90)

    def make():
        op = rng.choice(["add", "remove", "update", "update"])
        present = list(fold.RULE_FIELDS) if op == "add" else [f for f in fold.RULE_FIELDS if rng.random() < 0.4]
        rule = rng.randrange(4)
        kind = "row_filter" if rule == 0 else "column_mask"
        return rng.randrange(3), rule, kind, op, rule % 2, present, rng.choice([None, "n", "m"]), rng.choice([None, True, False]), rng.choice("xy"), rng.choice([None, "d"])

    def act(state, o):
        _, _, rule, kind, op, column, present, *values = o
        rules, links = state.setdefault("rules", {}), state.setdefault("links", {})
        if op == "add" and rule not in rules:
            rules[rule] = [kind, column, *values]
            if kind == "column_mask":
                links[column] = rule
        elif op == "remove" and rule in rules:
            if kind == "column_mask":
                links.pop(rules[rule][1], None)
            del rules[rule]
        elif op == "update" and rule in rules:
            for i, f in enumerate(fold.RULE_FIELDS):
                if f in present:
                    rules[rule][2 + i] = values[i]

    log = unique(ops(rng, 90, make))
    end = replayed(targets, log, act)
    frame = spark.createDataFrame(
        log,
        "seq LONG, table_id INT, rule_id INT, kind STRING, op STRING, column_id INT, present ARRAY<STRING>, name STRING, enabled BOOLEAN, expression STRING, description STRING",
    )
    spans = lives(spark, targets, "table_id")
    assert rows_of(fold.fold_rules(frame, spans, bits=BITS)) == sorted(((t, r, *v) for t, s in end.items() for r, v in s.get("rules", {}).items()), key=repr)
    links = fold.mask_links(fold.rule_lives(frame, spans, bits=BITS))
    assert rows_of(links) == sorted(((t, c, r) for t, s in end.items() for c, r in s.get("links", {}).items()), key=repr)
