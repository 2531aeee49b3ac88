"""Compaction of change logs: cancelled pairs, batches, net effect, reorders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.operators.fold import lifetimes
from catalogops.plans.durable import durable
from catalogops.plans.ordered import BITS, last_before, rank_within, running_sum
from catalogops.plans.skew import skew_join


def cancelled_lives(ops: DataFrame, key: str, creates: Column, drops: Column, *, bits: int = BITS) -> DataFrame:
    """Lives (key, start_seq, end_seq) that begin with a create and end with a drop inside the set.

    A drop of what was there before the set ends no such life, so it is not cancelled.
    """
    events = ops.where(F.coalesce(creates | drops, F.lit(False)) & F.col(key).isNotNull()).select(
        key, "seq", F.when(creates, "add").otherwise("drop").alias("kind")
    )
    return lifetimes(events, [key], bits=bits).where("end_seq IS NOT NULL")


def outside(ops: DataFrame, spans: DataFrame, key: str, *, bits: int = BITS) -> DataFrame:
    """The ops that are in none of the spans (key, start_seq, end_seq) of their key, ends included.

    Spans of one key do not overlap, so the last one begun decides; a null key is in none.
    """
    # A span begins just before the op of its first seq.
    shape = ops.select(F.struct(*ops.columns).alias("_row")).schema["_row"].dataType
    begun = spans.select(key, (2 * F.col("start_seq") - 1).alias("_at"), F.col("end_seq").alias("_end"), F.lit(None).cast(shape).alias("_row"))
    rows = ops.where(F.col(key).isNotNull()).select(
        key, (2 * F.col("seq")).alias("_at"), F.lit(None).cast(spans.schema["end_seq"].dataType).alias("_end"), F.struct(*ops.columns).alias("_row")
    )
    seen = last_before(begun.unionByName(rows), [key], "_at", F.col("_end"), "_until", bits=bits)
    kept = seen.where("_row IS NOT NULL AND (_until IS NULL OR _row.seq > _until)").select("_row.*")
    return kept.unionByName(ops.where(F.col(key).isNull()))


def cancel_pairs(ops: DataFrame, key: str, creates: Column, drops: Column, *, bits: int = BITS) -> DataFrame:
    """Without the ops of lives that begin and end in the set: each create, its drop and all between.

    What comes before or after stays, such as the drop of an older object of the same id, or a new
    create.
    """
    return outside(ops, cancelled_lives(ops, key, creates, drops, bits=bits), key, bits=bits)


def cancel_below(log: DataFrame, levels: Sequence[str], creates: Column, drops: Column, *, bits: int = BITS) -> DataFrame:
    """``cancel_pairs`` over a hierarchy log (seq, level, id, parent_id, ...), outermost level first.

    An op goes if its object, or any container above it, is in a cancelled life at that moment: what
    was made inside a container that the set made and dropped is gone with it. Each id keeps one
    parent, the least that the log names.
    """
    spans = {}
    above = {}
    for level in levels:
        rows = log.where(F.col("level") == level)
        spans[level] = durable(cancelled_lives(rows, "id", creates, drops, bits=bits), "cancelled")
        above[level] = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("parent_id").alias("_up"))
    result = None
    for depth, level in enumerate(levels):
        rows = outside(log.where(F.col("level") == level), spans[level], "id", bits=bits)
        rows = rows.join(above[level], "id", "left") if depth else rows
        for upper in reversed(levels[:depth]):
            rows = outside(rows, spans[upper].withColumnRenamed("id", "_up"), "_up", bits=bits)
            if upper != levels[0]:
                parents = above[upper].toDF("_up", "_next")
                rows = skew_join(rows, parents, ["_up"], "left").drop("_up").withColumnRenamed("_next", "_up")
        rows = rows.select(*log.columns)
        result = rows if result is None else result.unionByName(rows)
    return result


def batch_by_target(ops: DataFrame, creates: Column) -> DataFrame:
    """One row per target (target, is_new, create_op_id, modify_count, first_seq, last_seq, kinds).

    An object may own most of the log, so its op ids are not gathered into one row: their order
    is given as rows by ``batch_members``. ``kinds`` holds only names of op kinds.
    """
    return ops.groupBy("target").agg(
        F.coalesce(F.bool_or(creates), F.lit(False)).alias("is_new"),
        F.max_by(F.when(creates, F.col("op_id")), F.when(creates, F.col("seq"))).alias("create_op_id"),
        F.count_if(~creates).alias("modify_count"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.array_join(F.array_sort(F.collect_set("op")), ",").alias("kinds"),
    )


def batch_members(ops: DataFrame, *, bits: int = BITS) -> DataFrame:
    """(target, position, op_id): the ops of each batch in order, from 1."""
    return rank_within(ops.select("target", "seq", "op_id"), ["target"], "seq", "position", bits=bits).select(
        "target", "position", "op_id"
    )


def batch_stats(batches: DataFrame) -> DataFrame:
    size = F.col("modify_count") + F.when(F.col("create_op_id").isNotNull(), F.col("create_count")).otherwise(0)
    return batches.agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_operations"),
        F.count_if("is_new").alias("new_objects"),
        F.count_if(~F.col("is_new")).alias("modified_objects"),
        F.coalesce(F.round(F.avg(size), 4), F.lit(0.0)).alias("average_ops_per_batch"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_ops_in_batch"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_ops_in_batch"),
    )


def batch_sizes(ops: DataFrame, creates: Column) -> DataFrame:
    """``batch_by_target`` with the number of create ops, as ``batch_stats`` needs it."""
    return ops.groupBy("target").agg(
        F.coalesce(F.bool_or(creates), F.lit(False)).alias("is_new"),
        F.max(F.when(creates, F.col("op_id"))).alias("create_op_id"),
        F.count_if(creates).alias("create_count"),
        F.count_if(~creates).alias("modify_count"),
    )


def squash_creates(ops: DataFrame, creates: Column, last: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per created target with the final value of each field set in the batch.

    ``last`` maps a field to (rows that set it, its value). Only what follows the create counts.
    """
    merged = ops.groupBy("target").agg(
        F.max(F.when(creates, F.struct("seq", "op_id"))).alias("_c"),
        *[
            F.max(F.when(sets, F.struct("seq", value.alias("value")))).alias(name)
            for name, (sets, value) in last.items()
        ],
    )
    return merged.where("_c IS NOT NULL").select(
        "target", F.col("_c.op_id").alias("create_op_id"),
        *[F.when(F.col(f"{n}.seq") > F.col("_c.seq"), F.col(f"{n}.value")).alias(n) for n in last],
    )


def net_tags(ops: DataFrame, object_key: str) -> DataFrame:
    """(object, key, action, value): the last set or unset per key wins."""
    return ops.groupBy(object_key, "key").agg(F.max(F.struct("seq", "action", "value")).alias("l")).select(
        object_key, "key", "l.action", F.when(F.col("l.action") == "set", F.col("l.value")).alias("value")
    )


def net_reorder(ops: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(table_id, first_list, last_list): of many reorders of a table only the last one counts.

    With ``before``, (table_id, column_id, position) as it was before any of the ops, also that order:
    old_list, in order (a table has few columns).
    """
    net = ops.groupBy("table_id").agg(
        F.min_by("order_list", "seq").alias("first_list"), F.max_by("order_list", "seq").alias("last_list")
    )
    if before is None:
        return net
    lists = column_lists(before).select("table_id", F.array_join("cols", ",").alias("old_list"))
    return net.join(lists, "table_id", "left")


def single_column_move(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_id, column_id, from_pos, to_pos) where moving one column turns one order to the other.

    Both sides are (table_id, column_id, position). If one column moved, it jumped over all
    places that changed and every other changed column shifted by one the other way; both facts
    are counts per table. Of two neighbours that changed places the later one moved up.
    """
    before = old.select("table_id", "column_id", F.col("position").alias("o"))
    after = new.select("table_id", "column_id", F.col("position").alias("n"))
    both = before.join(after, ["table_id", "column_id"], "full_outer").withColumn("by", F.col("n") - F.col("o"))
    moved = F.col("by") != 0
    facts = both.groupBy("table_id").agg(
        F.count_if(F.col("by").isNull()).alias("other"),
        F.count_if(moved).alias("changed"),
        (F.max(F.when(moved, F.col("o"))) - F.min(F.when(moved, F.col("o")))).alias("span"),
        F.count_if(F.col("by") == 1).alias("down"),
        F.count_if(F.col("by") == -1).alias("up"),
        F.min(F.when(moved, F.struct("by", "column_id", "o", "n"))).alias("most_up"),
        F.max(F.when(moved, F.struct("by", "column_id", "o", "n"))).alias("most_down"),
    ).where("other = 0 AND changed > 0 AND changed = span + 1")
    jumped_up = (F.col("most_up.by") == -F.col("span")) & (F.col("down") == F.col("span"))
    jumped_down = (F.col("most_down.by") == F.col("span")) & (F.col("up") == F.col("span"))
    pick = F.when(jumped_up, F.col("most_up")).when(jumped_down, F.col("most_down"))
    return facts.withColumn("m", pick).where("m IS NOT NULL").select(
        "table_id", "m.column_id", F.col("m.o").alias("from_pos"), F.col("m.n").alias("to_pos")
    )


def column_lists(positions: DataFrame) -> DataFrame:
    """(table_id, cols ARRAY) from (table_id, column_id, position): as long as a table is wide."""
    return positions.groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "column_id"))), lambda s: s["column_id"]).alias("cols")
    )


def reorder_distance(old: DataFrame, new: DataFrame, threshold: int = 2, *, bits: int = BITS) -> DataFrame:
    """(table_id, distance, is_simple): pairs of columns whose order is turned round, for tables on both sides.

    Both sides are (table_id, column_id, position), positions whole, not negative and unique in a table;
    columns of one side only do not count. Two columns differ in a highest bit of their new positions: the
    pair is turned if the one with that bit set stood first. So each bit is a running count in old order
    within the columns that share the bits above it: no pairs, and no table is one row or one task.
    """
    both = durable(
        old.select("table_id", "column_id", F.col("position").cast("long").alias("o")).join(
            new.select("table_id", "column_id", F.col("position").cast("long").alias("n")), ["table_id", "column_id"]
        ),
        "places",
    )
    widest = both.groupBy("table_id").agg(F.max("n").alias("_widest"))
    # Columns that stand alone within a bit's group meet nobody, so a table needs only its own bits.
    planes = (
        skew_join(both, widest, ["table_id"])
        .withColumn("bit", F.explode(F.expr("filter(sequence(0, 62), b -> shiftright(_widest, b) > 0)")))
        .select(
            "table_id", "bit", F.expr("shiftright(shiftright(n, bit), 1)").alias("above"), "o",
            F.expr("shiftright(n, bit) & 1").alias("set"),
        )
    )
    counted = running_sum(planes, ["table_id", "bit", "above"], "o", "set", "_ahead", bits=bits)
    turned = counted.groupBy("table_id").agg(F.sum(F.when(F.col("set") == 0, F.col("_ahead")).otherwise(0)).alias("distance"))
    tables = old.select("table_id").distinct().join(new.select("table_id").distinct(), "table_id", "left_semi")
    distance = F.coalesce("distance", F.lit(0).cast("long"))
    return tables.join(turned, "table_id", "left").select("table_id", distance.alias("distance"), (distance <= threshold).alias("is_simple"))
