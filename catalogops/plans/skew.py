"""Joins of a large frame that may be hot on the key with a frame of few rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Never more than SHARE heavy keys, so their frame is safe to broadcast by construction.
SHARE = 1000
HEAVY_ROWS = 1_000_000
SALTS = 512
HASHES = 1 << 16


def heavy_keys(df: DataFrame, keys: Sequence[str], share: int = SHARE) -> DataFrame:
    """The ``share`` keys with the most rows; any other key has at most 1/share of the rows.

    Keys below a million rows are left out: a group that small never hurts.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= HEAVY_ROWS)
        .orderBy(F.desc("_n"), *keys)
        .limit(share)
        .select(*keys)
    )


def has_heavy(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a key may have ``HEAVY_ROWS`` rows: keys are counted by hash, so a few rows a task are sent over."""
    by_hash = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(HASHES)).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return not by_hash.where(F.col("_n") >= HEAVY_ROWS).isEmpty()


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt by these columns over as many tasks as a shuffle has, for dear work on each row.

    The number is given, so that rows which compress well are not put together in a few tasks again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def skew_join(
    large: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    salts: int = SALTS,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """``large.join(small, keys, how)`` for inner, left, left_semi and left_anti.

    Rows of heavy keys are spread over ``salts`` partitions and the matching rows of
    ``small`` are repeated once per salt; all other keys join as usual.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join keeps the large side, so it cannot do {how}")
    keys = list(keys)
    heavy = heavy_keys(large, keys) if heavy is None else heavy
    flag = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    # Spread by the row's own content, so a task that runs again sends rows the same way.
    hashable = [f.name for f in large.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")
    left = large.join(flag, keys, "left").withColumn(
        "_salt", F.when(F.col("_heavy"), spread).otherwise(F.lit(0))
    )
    right = small.join(flag, keys, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    return left.drop("_heavy").join(right.drop("_heavy"), [*keys, "_salt"], how).drop("_salt")
