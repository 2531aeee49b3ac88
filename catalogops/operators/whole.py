"""The whole difference of two states of a catalog as one ordered log, and back.

A state is five flat frames (``State``); nothing is nested, so a container may hold most of the
objects. An object stays if it is on both sides, in the same container, and its container stays:
one pass down the levels decides that. What does not stay is dropped once, at the top of each dropped
subtree, and whatever is new, or lies in or under something new, is added with all it carries:
fields, tags, properties, constraints, column order and grants. So attributes meet only the old ones
of objects that stay, and the same joins give both expansion and change.

Joins here are plain ones, whose long partitions the session's skew joins split: to look for hot keys before each
would read and send each frame again.

The log's order is by phase (drops deepest first, adds from the outermost level on, fields, tags and
properties, constraints, column places, grants), then level, place, target, op and key, so it is
the same on every run. The difference the other way round takes it back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.operators.diff import diff_constraints, diff_grants
from catalogops.plans.durable import durable
from catalogops.plans.ordered import global_position, position_within

LEVELS = (("catalog",), ("schema",), ("table", "view"), ("column",))
DROPS, ADDS, FIELDS, ENTRIES, CONSTRAINTS, PLACES, GRANTS = range(7)


class State(NamedTuple):
    """objects (object_type, object_id, parent_id, name, comment); entries (object_id, kind: tag or
    property, key, value); constraints (table_id, constraint_id, type, expression); places (table_id,
    column_id, position: gapless from 0); grants (target_id, principal, privilege)."""

    objects: DataFrame
    entries: DataFrame
    constraints: DataFrame
    places: DataFrame
    grants: DataFrame

    def nothing(self) -> State:
        """The empty state, to compare a first version with."""
        return State(*(frame.where(F.lit(False)) for frame in self))

    def consistent(self) -> State:
        """Without attributes of objects that are not there."""
        there = lambda frame, key: frame.join(self.objects.select(F.col("object_id").alias(key)), key, "left_semi")
        return State(
            self.objects, there(self.entries, "object_id"), there(self.constraints, "table_id"), there(self.places, "table_id"),
            there(self.grants, "target_id"),
        )


def kept_objects(old: DataFrame, new: DataFrame, levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """(object_id) of what stays: on both sides, in the same container, which stays too."""
    kept = above = None
    was = old.select(F.col("object_id").alias("_id"), F.col("parent_id").alias("_parent"))
    # Met once for all levels, since a level takes few of the old objects but each would be sent over.
    at_both = durable(
        new.select("object_type", "object_id", "parent_id")
        .join(was, (F.col("object_id") == F.col("_id")) & F.col("parent_id").eqNullSafe(F.col("_parent")), "left_semi"), "both",
    )
    for kinds in levels:
        same = at_both.where(F.col("object_type").isin(list(kinds)))
        if above is None:
            same = same.where("parent_id IS NULL")
        else:
            same = same.join(above.select(F.col("object_id").alias("parent_id")), "parent_id", "left_semi")
        above = durable(same.select("object_id"), "kept")
        kept = above if kept is None else kept.unionByName(above)
    return kept


def _level(levels: Sequence[Sequence[str]]) -> Column:
    return F.coalesce(*[F.when(F.col("object_type").isin(list(kinds)), F.lit(i)) for i, kinds in enumerate(levels)])


def _ops(frame: DataFrame, phase: int, op: Column, target: str, key: Column, value: Column, level: Column | None = None, place: Column | None = None) -> DataFrame:
    return frame.select(
        F.lit(phase).alias("phase"), (F.lit(0) if level is None else level).cast("int").alias("level"),
        (F.lit(0) if place is None else place).cast("long").alias("place"), op.alias("op"), F.col(target).cast("string").alias("target"),
        key.cast("string").alias("key"), value.cast("string").alias("value"),
    )


def _objects(old: State, new: State, kept: DataFrame, levels: Sequence[Sequence[str]]) -> list[DataFrame]:
    none = F.lit(None)
    kind, level = F.col("object_type"), _level(levels)
    gone = old.objects.join(kept, "object_id", "left_anti")
    tops = gone.where("parent_id IS NULL").unionByName(
        gone.where("parent_id IS NOT NULL").join(kept.select(F.col("object_id").alias("parent_id")), "parent_id", "left_semi").select(*gone.columns)
    )
    fresh = durable(new.objects.join(kept, "object_id", "left_anti"), "fresh")
    # A column is added at its place, so that adds alone give the order of a new table.
    placed = fresh.join(new.places.select(F.col("column_id").alias("object_id"), "position"), "object_id", "left")
    stay = new.objects.join(kept, "object_id", "left_semi").join(
        old.objects.select("object_id", F.col("name").alias("_name"), F.col("comment").alias("_comment")), "object_id"
    )
    return [
        _ops(tops, DROPS, F.concat(F.lit("drop_"), kind), "object_id", none, none, level=-level),
        _ops(placed, ADDS, F.concat(F.lit("add_"), kind), "object_id", F.col("parent_id"), F.col("name"), level=level, place=F.coalesce("position", F.lit(0))),
        _ops(fresh.where("comment IS NOT NULL"), FIELDS, F.concat(F.lit("set_"), kind, F.lit("_comment")), "object_id", none, F.col("comment"), level=level),
        _ops(stay.where("NOT (name <=> _name)"), FIELDS, F.concat(F.lit("rename_"), kind), "object_id", none, F.col("name"), level=level),
        _ops(stay.where("NOT (comment <=> _comment)"), FIELDS, F.concat(F.lit("set_"), kind, F.lit("_comment")), "object_id", none, F.col("comment"), level=level),
    ]


def _entries(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["object_id", "kind", "key"]
    both = old.select(*keys, F.struct("value").alias("o")).join(new.select(*keys, F.struct("value").alias("n")), keys, "full_outer")
    changed = both.where("o IS NULL OR n IS NULL OR NOT (o.value <=> n.value)")
    op = F.concat(F.when(F.col("n").isNull(), "unset_").otherwise("set_"), F.col("kind"))
    return _ops(changed, ENTRIES, op, "object_id", F.col("key"), F.col("n.value"))


def _constraints(old: DataFrame, new: DataFrame) -> DataFrame:
    steps = diff_constraints(old, new).join(
        new.select("table_id", "constraint_id", F.concat_ws(": ", "type", "expression").alias("body")), ["table_id", "constraint_id"], "left"
    )
    added = F.col("action") == "add_constraint"
    return _ops(steps, CONSTRAINTS, F.col("action"), "table_id", F.col("constraint_id"), F.when(added, F.col("body")), place=added.cast("int"))


def _places(old: DataFrame, new: DataFrame, kept: DataFrame) -> DataFrame:
    """Places of all columns of the tables whose order is not that of the kept columns with the new ones behind."""
    stays = kept.select(F.col("object_id").alias("column_id"), F.lit(True).alias("_stays"))
    was = old.select("table_id", "column_id", F.col("position").alias("_was"))
    columns = new.join(stays, "column_id", "left").join(was, ["table_id", "column_id"], "left")
    fresh = F.col("_stays").isNull() | F.col("_was").isNull()
    ordered = columns.select("table_id", "column_id", "position", fresh.alias("_fresh"), F.when(fresh, F.col("position")).otherwise(F.col("_was")).alias("_at"))
    due = durable(position_within(ordered, ["table_id"], ["_fresh", "_at", "column_id"], "_due"), "due")
    moved = due.where("_due <> position").select("table_id").distinct()
    rows = due.join(moved, "table_id", "left_semi")
    return _ops(rows, PLACES, F.lit("place_column"), "table_id", F.col("column_id"), F.col("position"), place=F.col("position"))


def _grants(old: DataFrame, new: DataFrame) -> DataFrame:
    steps = diff_grants(old, new)
    added = F.col("action") == "add_grant"
    # An add replaces what was there, so it carries the whole list.
    return _ops(steps, GRANTS, F.col("action"), "target_id", F.col("principal"), F.when(added, F.col("privileges")).otherwise(F.col("delta")), place=added.cast("int"))


def whole_diff(old: State, new: State, levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """(seq, op, target, key, value): the log that turns one state into the other."""
    kept = kept_objects(old.objects, new.objects, levels)
    stay = lambda frame, key: frame.join(kept.select(F.col("object_id").alias(key)), key, "left_semi")
    parts = [
        *_objects(old, new, kept, levels),
        _entries(stay(old.entries, "object_id"), new.entries),
        _constraints(stay(old.constraints, "table_id"), new.constraints),
        _places(stay(old.places, "table_id"), new.places, kept),
        _grants(stay(old.grants, "target_id"), new.grants),
    ]
    merged = reduce(DataFrame.unionByName, parts)
    placed = global_position(merged, ["phase", "level", "place", "target", "op", F.coalesce("key", F.lit(""))], "seq")
    return placed.select("seq", "op", "target", "key", "value")


def applied(state: State, ops: DataFrame, levels: Sequence[Sequence[str]] = LEVELS) -> State:
    """The state that the log leaves, with folds over its rows; a drop takes all below it along."""
    is_op = lambda text: F.col("op").startswith(text)
    gone = above = None
    dropped = ops.where(is_op("drop_") & (F.col("op") != "drop_constraint")).select(F.col("target").alias("object_id"))
    for kinds in levels:
        here = state.objects.where(F.col("object_type").isin(list(kinds)))
        own = here.join(dropped, "object_id", "left_semi").select("object_id")
        if above is not None:
            own = own.unionByName(here.join(above.select(F.col("object_id").alias("parent_id")), "parent_id", "left_semi").select("object_id")).distinct()
        above = durable(own, "gone")
        gone = above if gone is None else gone.unionByName(above)
    left = lambda frame, key: frame.join(gone.select(F.col("object_id").alias(key)), key, "left_anti")
    added = ops.where(is_op("add_") & ~F.col("op").isin("add_constraint", "add_grant")).select(
        F.substring("op", 5, 99).alias("object_type"), F.col("target").alias("object_id"), F.col("key").alias("parent_id"), F.col("value").alias("name"),
        F.lit(None).cast("string").alias("comment"),
    )
    edits = ops.where(is_op("rename_") | F.col("op").endswith("_comment")).groupBy(F.col("target").alias("object_id")).agg(
        F.max(F.when(is_op("rename_"), F.struct("seq", "value"))).alias("_n"), F.max(F.when(~is_op("rename_"), F.struct("seq", "value"))).alias("_c")
    )
    newer = lambda last, field: F.when(F.col(last).isNotNull(), F.col(f"{last}.value")).otherwise(F.col(field)).alias(field)
    objects = left(state.objects, "object_id").select(*added.columns).unionByName(added).join(edits, "object_id", "left").select(
        "object_type", "object_id", "parent_id", newer("_n", "name"), newer("_c", "comment")
    )

    def merged(held: DataFrame, keys: list[str], values: list[str], changes: DataFrame) -> DataFrame:
        """The last row of each key, older rows as of before the log, where it is not an unset."""
        rows = held.select(*keys, F.lit(0).cast("long").alias("seq"), F.lit(True).alias("set"), *values).unionByName(changes)
        last = rows.groupBy(*keys).agg(F.max(F.struct("seq", "set", *values)).alias("last"))
        return last.where("last.set").select(*keys, *[f"last.{v}" for v in values])

    tagged = ops.where(F.col("op").rlike("^(un)?set_(tag|property)$")).select(
        F.col("target").alias("object_id"), F.regexp_extract("op", "_(.*)$", 1).alias("kind"), "key", "seq", is_op("set_").alias("set"), "value"
    )
    bound = ops.where(F.col("op").isin("add_constraint", "drop_constraint")).select(
        F.col("target").alias("table_id"), F.col("key").alias("constraint_id"), "seq", is_op("add_").alias("set"),
        F.regexp_extract("value", "^([^:]*)", 1).alias("type"), F.regexp_extract("value", "(?s)^[^:]*: (.*)$", 1).alias("expression"),
    )
    # Kept columns stand as they did and added ones behind, unless the log places all of the table's.
    columns = objects.where("object_type = 'column'").select(F.col("parent_id").alias("table_id"), F.col("object_id").alias("column_id"))
    told = ops.where("op = 'place_column'").select(F.col("target").alias("table_id"), F.col("key").alias("column_id"), F.col("value").cast("long").alias("_told"))
    born = ops.where("op = 'add_column'").select(F.col("target").alias("column_id"), F.col("seq").alias("_born"))
    stood = left(left(state.places, "table_id"), "column_id").select("table_id", "column_id", F.col("position").alias("_stood"))
    places = columns.join(told, ["table_id", "column_id"], "left").join(stood, ["table_id", "column_id"], "left").join(born, "column_id", "left")
    order = ["_told", F.col("_born").isNotNull(), "_stood", "_born", "column_id"]
    listed = ops.where("op IN ('add_grant', 'revoke_grant')").select(
        F.col("target").alias("target_id"), F.col("key").alias("principal"), F.explode(F.split("value", ",")).alias("privilege"), "seq", is_op("add_").alias("set")
    )
    return State(
        objects, merged(left(state.entries, "object_id"), ["object_id", "kind", "key"], ["value"], tagged),
        merged(left(state.constraints, "table_id"), ["table_id", "constraint_id"], ["type", "expression"], bound),
        position_within(places, ["table_id"], order, "position").select("table_id", "column_id", "position"),
        merged(left(state.grants, "target_id"), ["target_id", "principal", "privilege"], [], listed),
    )
