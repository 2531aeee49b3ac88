"""Fold a change log into state.

No log is replayed row by row. Every family is the last value after the last reset, taken
with aggregates that combine before the shuffle, or with the bucketed windows of
``plans.ordered``; a single object may hold any share of the log. ``seq`` is unique and is the
only order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.plans.durable import durable
from catalogops.plans.ordered import BITS, last_before, position_within, running_sum
from catalogops.plans.skew import skew_join


def lifetimes(events: DataFrame, keys: Sequence[str], *, bits: int = BITS) -> DataFrame:
    """Alive intervals from rows (keys, seq, kind 'add' or 'drop', ...).

    The first add after a drop opens, the next drop closes; adds while alive are ignored.
    Further columns keep the value of the opening row. ``end_seq`` is null while alive.
    """
    seen = last_before(events, keys, "seq", F.col("kind"), "_before", bits=bits)
    turns = durable(
        seen.where(F.col("kind") != F.coalesce("_before", F.lit("drop"))).drop("_before"), "turns"
    )
    closed = last_before(
        turns, keys, "seq", F.when(F.col("kind") == "drop", F.col("seq")), "end_seq",
        reverse=True, bits=bits,
    )
    rest = [c for c in events.columns if c not in (*keys, "seq", "kind")]
    return closed.where("kind = 'add'").select(*keys, F.col("seq").alias("start_seq"), "end_seq", *rest)


def child_lifetimes(
    events: DataFrame, parents: DataFrame, *, bits: int = BITS
) -> DataFrame:
    """Alive intervals of children (id, parent_id, seq, kind), bounded by their parents'.

    ``parents`` is (id, start_seq, end_seq). An add counts only while the parent is alive; the
    end of the parent's interval ends the child. Each id keeps one parent.
    """
    opened = parents.select(
        F.col("id").alias("parent_id"),
        F.col("start_seq").alias("seq"),
        F.lit(None).cast(events.schema["id"].dataType).alias("id"),
        F.lit("parent").alias("kind"),
        F.struct("start_seq", "end_seq").alias("interval"),
    )
    both = opened.unionByName(
        events.select(
            "parent_id", "seq", "id", "kind",
            F.lit(None).cast(opened.schema["interval"].dataType).alias("interval"),
        )
    )
    # Which parent interval covers each child event: the last one opened before it.
    under = last_before(both, ["parent_id"], "seq", F.col("interval"), "_in", bits=bits)
    alive = F.col("_in").isNotNull() & (
        F.col("_in.end_seq").isNull() | (F.col("_in.end_seq") > F.col("seq"))
    )
    own = durable(
        under.where("kind <> 'parent'")
        .where((F.col("kind") == "drop") | alive)
        .select("id", "parent_id", "seq", "kind",
                F.when(F.col("kind") == "add", F.col("_in")).alias("within")),
        "child",
    )
    seen = last_before(
        own, ["id"], "seq", F.struct("kind", F.col("within.start_seq").alias("at")), "_before", bits=bits
    )
    opens = (F.col("kind") == "add") & (
        F.col("_before").isNull()
        | (F.col("_before.kind") == "drop")
        | (F.col("_before.at") != F.col("within.start_seq"))
    )
    turns = durable(seen.where(opens | (F.col("kind") == "drop")).drop("_before"), "child")
    closed = last_before(
        turns, ["id"], "seq", F.when(F.col("kind") == "drop", F.col("seq")), "_dropped",
        reverse=True, bits=bits,
    )
    return closed.where("kind = 'add'").select(
        "id", "parent_id",
        F.col("seq").alias("start_seq"),
        F.least("_dropped", "within.end_seq").alias("end_seq"),
    )


def cascade_lifetimes(log: DataFrame, levels: Sequence[str], *, bits: int = BITS) -> DataFrame:
    """Lifetimes over a hierarchy log (seq, level, id, parent_id, op), outermost level first."""
    result = None
    alive = None
    for level in levels:
        rows = log.where(F.col("level") == level).select("id", "parent_id", "seq", F.col("op").alias("kind"))
        if alive is None:
            alive = lifetimes(rows.drop("parent_id"), ["id"], bits=bits)
        else:
            alive = child_lifetimes(rows, alive, bits=bits)
        alive = durable(alive, "alive")
        shaped = alive.select(
            F.lit(level).alias("object_type"), F.col("id").alias("object_id"), "start_seq", "end_seq"
        )
        result = shaped if result is None else result.unionByName(shaped)
    return result


def live(spans: DataFrame) -> DataFrame:
    return spans.where("end_seq IS NULL").drop("end_seq")


def in_lives(log: DataFrame, spans: DataFrame, key: str, *, bits: int = BITS) -> DataFrame:
    """The rows of ``log`` (key, seq, ...) that fall in a life of their target, with ``life`` (its start) and ``life_end``.

    ``spans`` is (key, start_seq, end_seq). Starts and rows are one stream in which each row takes the
    last start before it, so a target that owns most of the log is cut into stretches like any other.
    """
    shape = log.select(F.struct(*log.columns).alias("_row")).schema["_row"].dataType
    opened = spans.select(
        key, F.col("start_seq").alias("seq"), F.struct("start_seq", "end_seq").alias("_life"), F.lit(None).cast(shape).alias("_row")
    )
    rows = log.where(F.col(key).isNotNull()).select(
        key, "seq", F.lit(None).cast(opened.schema["_life"].dataType).alias("_life"), F.struct(*log.columns).alias("_row")
    )
    within = last_before(opened.unionByName(rows), [key], "seq", F.col("_life"), "_within", bits=bits)
    return within.where("_row IS NOT NULL AND _within IS NOT NULL AND (_within.end_seq IS NULL OR seq < _within.end_seq)").select(
        "_row.*", F.col("_within.start_seq").alias("life"), F.col("_within.end_seq").alias("life_end")
    )


def in_current_lives(log: DataFrame, spans: DataFrame | None, key: str, *, bits: int = BITS) -> DataFrame:
    """The rows that act on what the target is now: after the start of the life it still has.

    What a dropped target held is gone, and a target added again starts with nothing, so these rows
    alone make its state. Without ``spans`` every target has always been there.
    """
    if spans is None:
        return log
    return in_lives(log, spans.where("end_seq IS NULL"), key, bits=bits).drop("life", "life_end")


def latest_values(
    log: DataFrame,
    keys: Sequence[str],
    alive: DataFrame,
    fields: Mapping[str, tuple[Column, Column]],
) -> DataFrame:
    """Last value of each field set while the object is alive: (keys, field, value, value_seq).

    ``fields`` maps a field to (rows that set it, its value). A null value counts. The overall
    last value of a dead life is recognised by its seq, so one pass over the log is enough.
    """
    last = log.groupBy(*keys).agg(
        *[
            F.max(F.when(sets, F.struct("seq", value.cast("string").alias("value")))).alias(name)
            for name, (sets, value) in fields.items()
        ]
    )
    each = F.explode(
        F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("last")) for n in fields])
    )
    return (
        last.select(*keys, each.alias("_f"))
        .where("_f.last IS NOT NULL")
        .join(alive.select(*keys, "start_seq"), list(keys))
        .where("_f.last.seq > start_seq")
        .select(*keys, "_f.field", "_f.last.value", F.col("_f.last.seq").alias("value_seq"))
    )


def partial_update(
    log: DataFrame, keys: Sequence[str], alive: DataFrame, payload: str, names: Iterable[str]
) -> DataFrame:
    """Fields overwritten only when their key is present in the JSON payload; null counts."""
    entries = F.from_json(payload, "MAP<STRING,STRING>")
    held = log.withColumn("_p", entries)
    return latest_values(
        held, keys, alive,
        {n: (F.map_contains_key("_p", F.lit(n)), F.col("_p")[n]) for n in names},
    )


def fold_map(log: DataFrame, object_key: str, alive: DataFrame) -> DataFrame:
    """Live tags or properties from rows (object, key, value, action 'set'/'unset', seq)."""
    last = log.groupBy(object_key, "key").agg(
        F.max(F.struct("seq", "action", "value")).alias("last")
    )
    return (
        last.where("last.action = 'set'")
        .join(alive.select(object_key, "start_seq"), object_key)
        .where("last.seq > start_seq")
        .select(object_key, "key", "last.value", F.col("last.seq").alias("value_seq"))
    )


def as_map(entries: DataFrame, object_key: str) -> DataFrame:
    """The rows of ``fold_map`` as one MAP per object (for objects with few keys)."""
    return entries.groupBy(object_key).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("entries")
    )


def fold_grants(log: DataFrame, targets: DataFrame | None = None, *, bits: int = BITS) -> DataFrame:
    """Live privileges from (seq, target_id, principal, op, privileges ARRAY).

    ``targets`` is the lifetimes (target_id, start_seq, end_seq) of what is granted on.

    add_grant replaces, revoke_grant without a list (null or empty) clears, with a list subtracts. A
    privilege of the last add lives unless a later revoke lists it, so no revoke list is collected.
    """
    log = in_current_lives(log, targets, "target_id", bits=bits)
    who = ["target_id", "principal"]
    unlisted = F.coalesce(F.size("privileges"), F.lit(0)) <= 0
    resets = (F.col("op") == "add_grant") | unlisted
    last = log.where(resets).groupBy(*who).agg(
        F.max(F.struct("seq", "op", "privileges")).alias("last")
    )
    base = (
        last.where("last.op = 'add_grant'")
        .select(*who, F.col("last.seq").alias("reset_seq"),
                F.explode(F.array_distinct("last.privileges")).alias("privilege"))
    )
    revoked = (
        log.where((F.col("op") == "revoke_grant") & ~unlisted)
        .select(*who, "seq", F.explode("privileges").alias("privilege"))
        .groupBy(*who, "privilege")
        .agg(F.max("seq").alias("revoked_seq"))
    )
    return (
        base.join(revoked, [*who, "privilege"], "left")
        .where("revoked_seq IS NULL OR revoked_seq < reset_seq")
        .select(*who, "privilege")
    )


def fold_column_order(log: DataFrame, tables: DataFrame | None = None, *, bits: int = BITS) -> DataFrame:
    """Position of every live column from (seq, table_id, column_id, op, listed ARRAY).

    ``tables`` is the lifetimes (table_id, start_seq, end_seq) of the tables: a table dropped and
    added again has the columns, and the orders, of its present life only.

    A reorder puts the listed columns first and leaves the others in their old order, so a
    column stands by the last reorder that lists it, later reorders first, then by its place
    in that list; columns never listed follow in the order they were added.
    """
    log = in_current_lives(log, tables, "table_id", bits=bits)
    who = ["table_id", "column_id"]
    events = log.where(F.col("op").isin("add_column", "drop_column")).select(
        *who, "seq", F.when(F.col("op") == "add_column", "add").otherwise("drop").alias("kind")
    )
    columns = live(lifetimes(events, who, bits=bits))
    listed = (
        log.where(F.col("op") == "reorder_columns")
        .select("table_id", "seq", F.posexplode("listed").alias("at", "column_id"))
        .groupBy(*who)
        .agg(F.max(F.struct("seq", (-F.col("at")).alias("front"))).alias("listed"))
    )
    placed = columns.join(listed, who, "left").withColumn(
        "_l", F.when(F.col("listed.seq") > F.col("start_seq"), F.col("listed"))
    )
    order = [F.desc_nulls_last("_by"), F.desc_nulls_last("_front"), F.asc("start_seq")]
    flat = placed.select(*who, "start_seq", F.col("_l.seq").alias("_by"), F.col("_l.front").alias("_front"))
    return position_within(flat, ["table_id"], order, "position").select(*who, "position")


def fold_constraints(log: DataFrame, tables: DataFrame | None = None, *, bits: int = BITS) -> DataFrame:
    """Constraint lists from (seq, table_id, constraint_id, op, insert_at).

    ``tables`` is the lifetimes (table_id, start_seq, end_seq) of the tables; a list starts empty in each.

    Where a constraint stands depends on the list at the moment it was inserted, so one
    table's list is replayed in order. Only what can matter is replayed: effective adds and
    drops (bucketed lifetimes) since the table's list was last empty. Rows stream through a
    task in batches and only the live list is held.
    """
    log = in_current_lives(log, tables, "table_id", bits=bits)
    who = ["table_id", "constraint_id"]
    events = log.select(
        *who, "seq", F.when(F.col("op") == "add_constraint", "add").otherwise("drop").alias("kind"),
        "insert_at",
    )
    spans = durable(lifetimes(events, who, bits=bits), "constraints")
    steps = spans.select(
        "table_id", "constraint_id", F.col("start_seq").alias("seq"), "insert_at", F.lit(1).alias("step")
    ).unionByName(
        spans.where("end_seq IS NOT NULL").select(
            "table_id", "constraint_id", F.col("end_seq").alias("seq"),
            F.lit(None).cast("int").alias("insert_at"), F.lit(-1).alias("step"),
        )
    )
    sized = durable(running_sum(steps, ["table_id"], "seq", "step", "size", bits=bits), "constraints")
    emptied = sized.where("size = 0").groupBy("table_id").agg(F.max("seq").alias("emptied"))
    needed = (
        skew_join(sized, emptied, ["table_id"], "left")
        .where("emptied IS NULL OR seq > emptied")
        .select("table_id", "seq", "constraint_id", "insert_at", "step")
    )

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, members = None, []

        def listed():
            return pd.DataFrame(
                {"table_id": table, "member_id": members, "position": range(len(members))}
            )

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.table_id != table:
                    if members:
                        yield listed()
                    table, members = row.table_id, []
                if row.step < 0:
                    members.remove(row.constraint_id)
                elif pd.isna(row.insert_at) or row.insert_at < 0:
                    members.append(row.constraint_id)
                else:
                    members.insert(int(row.insert_at), row.constraint_id)
        if members:
            yield listed()

    types = dict(log.dtypes)
    return (
        needed.repartition("table_id")
        .sortWithinPartitions("table_id", "seq")
        .mapInPandas(
            replay,
            f"table_id {types['table_id']}, member_id {types['constraint_id']}, position long",
        )
    )


RULE_FIELDS = ("name", "enabled", "expression", "description")


def rule_lives(log: DataFrame, tables: DataFrame | None = None, *, bits: int = BITS) -> DataFrame:
    """Lives of row filters and column masks inside their table's present life, with what they were added as."""
    log = in_current_lives(log, tables, "table_id", bits=bits)
    events = log.where(F.col("op").isin("add", "remove")).select(
        "table_id", "rule_id", F.col("kind").alias("rule_kind"), "seq",
        F.when(F.col("op") == "add", "add").otherwise("drop").alias("kind"), "column_id", *[f for f in RULE_FIELDS if f in log.columns],
    )
    return lifetimes(events, ["table_id", "rule_id", "rule_kind"], bits=bits).withColumnRenamed("rule_kind", "kind")


def fold_rules(log: DataFrame, tables: DataFrame | None = None, *, bits: int = BITS) -> DataFrame:
    """Live row filters and column masks from (seq, table_id, rule_id, kind, op, column_id, present ARRAY,
    name, enabled, expression, description).

    An update overwrites the fields that ``present`` names, with null if that is what it carries; a log
    without that column carries what is not null. Fields that the log lacks are left out. ``tables`` is
    the lifetimes (table_id, start_seq, end_seq) of the tables.
    """
    who = ["table_id", "rule_id", "kind"]
    fields = [f for f in RULE_FIELDS if f in log.columns]
    carried = lambda f: F.array_contains("present", f) if "present" in log.columns else F.col(f).isNotNull()
    alive = live(rule_lives(log, tables, bits=bits))
    last = [F.max(F.when(carried(f), F.struct("seq", F.col(f).alias("value")))).alias(f"_{f}") for f in fields]
    changed = log.where("op = 'update'").groupBy(*who).agg(*last)
    # An update of an earlier life is older than the present one's start.
    newer = lambda f: F.when(F.col(f"_{f}.seq") > F.col("start_seq"), F.col(f"_{f}.value")).otherwise(F.col(f)).alias(f)
    return alive.join(changed, who, "left").select(*who, "column_id", *[newer(f) for f in fields])


def mask_links(lives: DataFrame) -> DataFrame:
    """(table_id, column_id, rule_id): the mask each column points at, from ``rule_lives``.

    Adding a mask points its column at it, and removing any mask of the column clears that, so the
    last of these decides.
    """
    masks = lives.where("kind = 'column_mask'")
    turns = masks.select("table_id", "column_id", F.col("start_seq").alias("seq"), "rule_id").unionByName(
        masks.where("end_seq IS NOT NULL").select("table_id", "column_id", F.col("end_seq").alias("seq"), F.lit(None).cast(lives.schema["rule_id"].dataType).alias("rule_id"))
    )
    last = turns.groupBy("table_id", "column_id").agg(F.max(F.struct("seq", "rule_id")).alias("last"))
    return last.where("last.rule_id IS NOT NULL").select("table_id", "column_id", "last.rule_id")


def states_at(events: DataFrame, tags: DataFrame, points: Sequence[int], *, bits: int = BITS) -> DataFrame:
    """Tags of live objects at several points of the log at once.

    ``events`` is (object_id, seq, kind), ``tags`` is (object_id, key, action, value, seq). Each
    row is filed under the first point at or after it and combined there, so what is carried
    to later points is one row per (object, key), not the log.
    """
    known = F.array(*[F.lit(p).cast("long") for p in sorted(points)])
    later = lambda seq: F.filter(known, lambda p: p >= seq)
    spans = lifetimes(events, ["object_id"], bits=bits)
    alive = (
        spans.withColumn("as_of_seq", F.explode(later(F.col("start_seq"))))
        .where("end_seq IS NULL OR end_seq > as_of_seq")
        .select("object_id", "start_seq", "as_of_seq")
    )
    filed = (
        tags.withColumn("_first", F.element_at(F.concat(later(F.col("seq")), F.array(F.lit(None).cast("long"))), 1))
        .where("_first IS NOT NULL")
        .groupBy("object_id", "key", "_first")
        .agg(F.max(F.struct("seq", "action", "value")).alias("last"))
    )
    carried = (
        filed.withColumn("as_of_seq", F.explode(later(F.col("_first"))))
        .groupBy("object_id", "key", "as_of_seq")
        .agg(F.max("last").alias("last"))
    )
    return (
        carried.where("last.action = 'set'")
        .join(alive, ["object_id", "as_of_seq"])
        .where("last.seq > start_seq")
        .select("object_id", "key", "last.value", "as_of_seq")
    )


def snapshot_of(events: DataFrame, tags: DataFrame, at_seq: int, *, bits: int = BITS):
    """(live objects, live tags) at a point, each row keeping the seq that made it."""
    alive = live(lifetimes(events.where(F.col("seq") <= at_seq), ["object_id"], bits=bits))
    alive = durable(alive, "snapshot")
    held = durable(fold_map(tags.where(F.col("seq") <= at_seq), "object_id", alive), "snapshot")
    return alive, held


def snapshot_plus_delta(alive, held, events, tags, at_seq: int, *, bits: int = BITS) -> DataFrame:
    """Fold the snapshot's rows, as ops at their own seq, with only the newer part of the log."""
    all_events = alive.select("object_id", F.col("start_seq").alias("seq"), F.lit("add").alias("kind")).unionByName(
        events.where(F.col("seq") > at_seq).select("object_id", "seq", "kind")
    )
    all_tags = held.select(
        "object_id", "key", F.lit("set").alias("action"), "value", F.col("value_seq").alias("seq")
    ).unionByName(tags.where(F.col("seq") > at_seq).select("object_id", "key", "action", "value", "seq"))
    now = live(lifetimes(all_events, ["object_id"], bits=bits))
    return fold_map(all_tags, "object_id", now)


def state_digest(state: DataFrame) -> DataFrame:
    """One order-free SHA-256 digest of a whole frame: (rows, digest).

    Each row is hashed over its columns by name, every value behind its length, so that no text can
    look like another cell or like a null; the hashes are added as numbers in four parts, which
    combines before the shuffle, and the sums are hashed.
    """
    def cell(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("null")))

    hashed = state.select(F.sha2(F.concat_ws("|", *[cell(c) for c in sorted(state.columns)]), 256).alias("h"))
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    sums = hashed.agg(
        F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(4)]
    )
    text = F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.select("rows", F.sha2(text, 256).alias("digest"))
