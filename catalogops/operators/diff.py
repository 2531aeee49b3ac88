"""Change feeds from two states of keyed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.plans.durable import durable
from catalogops.plans.ordered import global_position
from catalogops.plans.skew import heavy_keys, skew_join


def _sides(old: DataFrame, new: DataFrame, keys: Sequence[str], how: str = "full_outer") -> DataFrame:
    """Both states side by side as structs ``o`` and ``n``; a missing side is null."""
    left = old.select(*keys, F.struct(*old.columns).alias("o"))
    right = new.select(*keys, F.struct(*new.columns).alias("n"))
    return left.join(right, list(keys), how)


def _change() -> Column:
    return F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "dropped").otherwise("kept")


def diff_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change): added, dropped or kept."""
    left = old.select(*keys, F.lit(1).alias("o"))
    right = new.select(*keys, F.lit(1).alias("n"))
    return left.join(right, list(keys), "full_outer").select(*keys, _change().alias("change"))


def diff_fields(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, field, old_value, new_value) for kept rows whose field differs; null equals null."""
    wanted = [*keys, *fields]
    both = _sides(old.select(*wanted), new.select(*wanted), keys, "inner")
    changes = F.array(
        *[
            F.when(
                ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")),
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"o.{f}").cast("string").alias("old_value"),
                    F.col(f"n.{f}").cast("string").alias("new_value"),
                ),
            )
            for f in fields
        ]
    )
    return both.select(*keys, F.explode(F.array_compact(changes)).alias("c")).select(*keys, "c.*")


def detect_renames(old: DataFrame, new: DataFrame, key: str, renames: DataFrame) -> DataFrame:
    """(object_id, old_name, new_name, in_history). ``renames`` is (object_id, old_name, new_name)."""
    changed = diff_fields(old, new, [key], ["name"]).select(
        F.col(key).alias("object_id"), F.col("old_value").alias("old_name"), F.col("new_value").alias("new_name")
    )
    said = renames.select("object_id", "old_name", "new_name").distinct().withColumn("_hit", F.lit(True))
    return changed.join(said, ["object_id", "old_name", "new_name"], "left").select(
        "object_id", "old_name", "new_name", F.coalesce("_hit", F.lit(False)).alias("in_history")
    )


def diff_map(old: DataFrame, new: DataFrame, object_key: str) -> DataFrame:
    """Set and unset rows between two frames of live (object, key, value)."""
    both = _sides(old.select(object_key, "key", "value"), new.select(object_key, "key", "value"), [object_key, "key"])
    return both.where(
        "o IS NULL OR n IS NULL OR NOT (o.value <=> n.value)"
    ).select(
        object_key, "key",
        F.when(F.col("n").isNull(), "unset").otherwise("set").alias("action"),
        F.col("n.value").alias("value"),
    )


def map_entries_of(df: DataFrame, object_key: str, column: str) -> DataFrame:
    """A MAP column as (object, key, value) rows."""
    return df.select(object_key, F.explode(column).alias("key", "value"))


def diff_container_meta(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per changed container (key, payload): JSON of only the changed fields, a null
    comment written as an empty text."""
    wanted = [key, *fields]
    both = _sides(old.select(*wanted), new.select(*wanted), [key], "inner")
    entries = [
        F.when(
            ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")),
            F.struct(
                F.lit(f).alias("k"),
                (F.coalesce(F.col(f"n.{f}").cast("string"), F.lit("")) if f == "comment" else F.col(f"n.{f}").cast("string")).alias("v"),
            ),
        )
        for f in sorted(fields)
    ]
    changed = F.array_compact(F.array(*entries))
    return both.where(F.size(changed) > 0).select(
        key, F.to_json(F.map_from_entries(changed), {"ignoreNullFields": "false"}).alias("payload")
    )


# What decides that a constraint changed, by its type.
CONSTRAINT_FIELDS: Mapping[str, Sequence[str]] = {
    "primary_key": ["timeseries"],
    "foreign_key": ["parent_table", "parent_columns"],
    "check": ["expression"],
}


def diff_constraints(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_id, constraint_id, action, step): adds, drops, and drop-then-add when changed."""
    keys = ["table_id", "constraint_id"]
    both = _sides(old, new, keys)
    have = set(old.columns)
    differs = lambda f: ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    changed = F.lit(False)
    for f in ("type", "name", "columns"):
        if f in have:
            changed = changed | differs(f)
    for kind, fields in CONSTRAINT_FIELDS.items():
        for f in fields:
            if f in have:
                changed = changed | ((F.col("o.type") == kind) & differs(f))
    actions = (
        F.when(F.col("o").isNull(), F.array(F.lit("add_constraint")))
        .when(F.col("n").isNull(), F.array(F.lit("drop_constraint")))
        .when(changed, F.array(F.lit("drop_constraint"), F.lit("add_constraint")))
    )
    return both.select(*keys, F.posexplode(actions).alias("step", "action")).select(*keys, "action", "step")


def diff_grants(old: DataFrame, new: DataFrame) -> DataFrame:
    """(target_id, principal, action, delta, privileges) from live privilege rows.

    A principal that keeps some privileges gets a revoke of the lost ones, then an add. The add
    carries the whole new list, because an add replaces what was there; ``delta`` is what is new.
    """
    who = ["target_id", "principal"]

    def lists(side: DataFrame) -> DataFrame:
        return (
            side.withColumn("principal", F.trim("principal"))
            .where("principal <> ''")
            .groupBy(*who)
            # A privilege list is at most the fixed list of legal privileges.
            .agg(F.array_sort(F.collect_set("privilege")).alias("privileges"))
        )

    both = _sides(lists(old), lists(new), who)
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    before, after = F.coalesce("o.privileges", none), F.coalesce("n.privileges", none)
    lost, gained = F.array_except(before, after), F.array_except(after, before)
    row = lambda action, delta: F.struct(
        F.lit(action).alias("action"), F.array_join(delta, ",").alias("delta"), F.array_join(after, ",").alias("privileges")
    )
    steps = F.array(
        F.when(F.size(lost) > 0, row("revoke_grant", lost)), F.when(F.size(gained) > 0, row("add_grant", gained))
    )
    return both.select(*who, F.explode(F.array_compact(steps)).alias("s")).select(*who, "s.*")


def diff_column_order(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_id, moved) where the same columns stand in another order, and how many moved.

    Both sides are (table_id, column_id, position); columns meet one by one, no list is built.
    """
    both = _sides(old.select("table_id", "column_id", "position"), new.select("table_id", "column_id", "position"), ["table_id", "column_id"])
    return (
        both.groupBy("table_id")
        .agg(
            F.count_if(F.col("o").isNull() | F.col("n").isNull()).alias("_other"),
            F.count_if(F.col("o.position") != F.col("n.position")).alias("moved"),
        )
        .where("_other = 0 AND moved > 0")
        .select("table_id", "moved")
    )


def expand_added(added: DataFrame, objects: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Adds (depth, op, target, detail) for every added container and all it contains.

    ``added`` is (object_id). One join per level takes the ids reached so far to their children;
    a container may hold most of the objects.
    """
    heavy = durable(heavy_keys(objects, ["parent_id"]), "heavy")
    started = objects.join(added.select("object_id"), "object_id", "left_semi")
    result = above = None
    for depth, kinds in enumerate(levels):
        here = started.where(F.col("object_type").isin(list(kinds))).select("object_id", "object_type", "name")
        if above is not None:
            under = objects.where(F.col("object_type").isin(list(kinds)))
            below = skew_join(
                under, above.select(F.col("object_id").alias("parent_id")), ["parent_id"], "left_semi", heavy=heavy
            )
            here = here.unionByName(below.select(*here.columns)).distinct()
        above = durable(here, "level")
        rows = above.select(
            F.lit(depth).alias("depth"), F.concat(F.lit("add_"), "object_type").alias("op"),
            F.col("object_id").alias("target"), F.col("name").alias("detail"),
        )
        result = rows if result is None else result.unionByName(rows)
    return result


def row_ops(old: DataFrame, new: DataFrame, key: str, kind: str, fields: Sequence[str]) -> DataFrame:
    """Ops (phase, op, target, detail) that turn one object table into another: adds (phase 0),
    changed fields (1), drops (2). One join; an unchanged object gives no row."""
    wanted = [key, "name", *fields]
    both = _sides(old.select(*wanted), new.select(*wanted), [key])
    row = lambda phase, op, detail: F.struct(
        F.lit(phase).alias("phase"), F.lit(op).alias("op"), detail.cast("string").alias("detail")
    )
    kept = F.col("o").isNotNull() & F.col("n").isNotNull()
    edit = lambda f: F.when(
        kept & ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")),
        row(1, f"rename_{kind}" if f == "name" else f"set_{kind}_{f}", F.col(f"n.{f}")),
    )
    ops = F.array(
        F.when(F.col("o").isNull(), row(0, f"add_{kind}", F.col("n.name"))),
        *[edit(f) for f in ("name", *fields)],
        F.when(F.col("n").isNull(), row(2, f"drop_{kind}", F.lit(None))),
    )
    return both.select(F.col(key).alias("target"), F.explode(F.array_compact(ops)).alias("c")).select(
        "c.phase", "c.op", "target", "c.detail"
    )


def diff_to_ops(parts: Sequence[DataFrame]) -> DataFrame:
    """One ordered log (seq, op, target, detail) from per-level ops, outermost level first:
    adds and changes level by level going down, then drops going up."""
    merged = None
    for depth, part in enumerate(parts):
        rank = F.when(F.col("phase") < 2, F.lit(depth)).otherwise(F.lit(2 * len(parts) - depth))
        rows = part.select(rank.alias("_rank"), "phase", "op", F.col("target").cast("string").alias("target"), "detail")
        merged = rows if merged is None else merged.unionByName(rows)
    placed = global_position(merged, ["_rank", "phase", "target", "op", "detail"], "seq")
    return placed.select("seq", "op", "target", "detail")


def diff_summary(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n")).orderBy("op")


def diff_versions(snapshots: DataFrame, before: str | None, after: str, key: str, kind: str, fields: Sequence[str]) -> DataFrame:
    """The op log between two named versions of one table of snapshots; ``before`` None = empty."""
    old = snapshots.where(F.col("version") == before) if before is not None else snapshots.where(F.lit(False))
    new = snapshots.where(F.col("version") == after)
    return diff_to_ops([row_ops(old, new, key, kind, fields)])


def diff_tables(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed cells of two versions of a data table (keys, field, old_value, new_value).

    First only keys and a 128-bit row hash meet; whole rows are read again for the changed keys
    alone. The written keys tell the optimizer their size, so a small set of them is broadcast
    and wide rows never move.
    """
    # A column of one side alone is null on the other.
    for column in new.columns:
        old = old if column in old.columns else old.withColumn(column, F.lit(None).cast(new.schema[column].dataType))
    for column in old.columns:
        new = new if column in new.columns else new.withColumn(column, F.lit(None).cast(old.schema[column].dataType))
    fields = [c for c in old.columns if c not in keys]
    # The hash passes over nulls, so where they stand is hashed too.
    nulls = [F.col(c).isNull() for c in fields]
    mark = F.struct(F.xxhash64(*fields, *nulls).alias("a"), F.xxhash64(F.lit(1), *fields, *nulls).alias("b"))
    left = old.select(*keys, mark.alias("_o"))
    right = new.select(*keys, mark.alias("_n"))
    changed = durable(left.join(right, list(keys)).where("_o <> _n").select(*keys), "changed")
    return diff_fields(
        old.join(changed, list(keys), "left_semi"), new.join(changed, list(keys), "left_semi"), keys, fields
    )


def change_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
