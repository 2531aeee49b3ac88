"""Ordered (per-key) computations whose tasks stay bounded however hot a key is.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts a whole key in one task. Here each key
is cut into buckets of ``2**bits`` consecutive order values. As the order value is unique
within a key, no bucket can hold more than ``2**bits`` rows. Only one summary row per bucket
crosses buckets: for a dense sequence of a million million rows that is a million rows per
key. For sparse order values such as microseconds pass ``levels=2``, which cuts the summaries
the same way.

Key columns must not be null. A source frame is read twice; cut an expensive one with
``durable`` first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.plans.durable import durable
from catalogops.plans.skew import has_heavy, heavy_keys

BITS = 20


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    *,
    reverse: bool = False,
    bits: int = BITS,
    levels: int = 1,
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` among rows of the key strictly before this one.

    With ``reverse`` the nearest one strictly after. ``order`` is an integer column.
    """
    # Working names carry the level, since a level's summaries are the next level's rows.
    o, b, v, tail, carry, inner = (f"_{name}{levels}" for name in ("o", "b", "v", "tail", "carry", "in"))
    position = F.col(order).cast("long")
    if reverse:
        position = -position
    marked = df.withColumns({o: position, v: value}).withColumn(b, F.shiftright(o, bits))
    inside = Window.partitionBy(*keys, b).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    tails = marked.groupBy(*keys, b).agg(
        F.max_by(v, F.when(F.col(v).isNotNull(), F.col(o))).alias(tail)
    )
    if levels > 1:
        carried = last_before(tails, keys, b, F.col(tail), carry, bits=bits, levels=levels - 1)
    else:
        across = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        carried = tails.withColumn(carry, F.last(tail, ignorenulls=True).over(across))
    carried = carried.where(F.col(carry).isNotNull()).select(*keys, b, carry)
    return (
        marked.withColumn(inner, F.last(v, ignorenulls=True).over(inside))
        .join(carried, [*keys, b], "left")
        .withColumn(out, F.coalesce(inner, carry))
        .select(*df.columns, out)
    )


def rank_within(
    df: DataFrame, keys: Sequence[str], order: str, out: str, *, bits: int = BITS
) -> DataFrame:
    """Add ``out``: 1-based rank of the row inside its key by a unique integer ``order``."""
    marked = df.withColumn("_b", F.shiftright(F.col(order).cast("long"), bits))
    counts = marked.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_skip", F.sum("_n").over(before)).where("_skip > 0")
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    return (
        marked.withColumn("_r", F.row_number().over(inside).cast("long"))
        .join(offsets.select(*keys, "_b", "_skip"), [*keys, "_b"], "left")
        .withColumn(out, F.col("_r") + F.coalesce("_skip", F.lit(0)))
        .select(*df.columns, out)
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, *, bits: int = BITS
) -> DataFrame:
    """Add ``out``: sum of ``value`` over the key's rows up to and including this one."""
    marked = df.withColumn("_b", F.shiftright(F.col(order).cast("long"), bits))
    sums = marked.groupBy(*keys, "_b").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_skip", F.sum("_n").over(before))
    inside = (
        Window.partitionBy(*keys, "_b")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.withColumn("_r", F.sum(value).over(inside))
        .join(offsets.select(*keys, "_b", "_skip"), [*keys, "_b"], "left")
        .withColumn(out, F.col("_r") + F.coalesce("_skip", F.lit(0)))
        .select(*df.columns, out)
    )


def global_position(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """Add ``out``: 1-based position in one total order over the whole frame.

    Range partitions are sorted side by side and written once; each row's place is its place
    in the partition plus the rows of the partitions before it. Only the per-partition counts
    (as many rows as there are partitions) are broadcast. ``order`` must be a total order.
    """
    placed = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "order",
    )
    part = F.shiftright("_mid", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_p",
        F.coalesce(
            F.sum("_n").over(
                Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_skip"),
    )
    return (
        placed.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn(
            out, F.col("_skip") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        )
        .select(*df.columns, out)
    )


def position_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Add ``out``: 0-based place of the row inside its key, for any total order; rows with a null key are left out.

    A window, since a key that is not heavy fits a task. Rows of heavy keys are placed in the whole frame,
    minus the first place of the key, so no such key is one task's.
    """
    named = df.dropna(subset=list(keys))
    inside = Window.partitionBy(*keys).orderBy(*order)
    counted = lambda rows: rows.withColumn(out, F.row_number().over(inside).cast("long") - 1)
    if not has_heavy(named, keys):
        return counted(named)
    heavy = durable(heavy_keys(named, keys), "heavy")
    placed = global_position(named.join(F.broadcast(heavy), list(keys), "left_semi"), [*keys, *order], "_at")
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    spread = placed.join(F.broadcast(first), list(keys)).withColumn(out, F.col("_at") - F.col("_first"))
    return counted(named.join(F.broadcast(heavy), list(keys), "left_anti")).select(*df.columns, out).unionByName(spread.select(*df.columns, out))
