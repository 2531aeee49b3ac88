"""Rebase, scoped merge and version arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.functions.versions import parsed, shown
from catalogops.plans.durable import durable
from catalogops.plans.ordered import BITS, last_before, position_within
from catalogops.plans.skew import skew_join


def rebase_conflicts(feature: DataFrame, base: DataFrame) -> DataFrame:
    """Feature ops on a target the base also changed."""
    return skew_join(feature, base.select("target").distinct(), ["target"], "left_semi")


def rebase_plan(feature: DataFrame, base: DataFrame, branch: str | None = "branch") -> DataFrame:
    """Add ``state``: ops before the branch's first conflict are applied, that op is the conflict,
    the rest is blocked. The first conflict is one aggregate per branch, not a running scan.

    With ``branch`` None all ops are one branch, whose first conflict is a single number.
    """
    hits = skew_join(feature, base.select("target").distinct(), ["target"], "left_semi")
    if branch is None:
        first = hits.agg(F.min("seq")).first()[0]
        marked = feature.withColumn("_first", F.lit(first).cast("long"))
    else:
        marked = skew_join(feature, hits.groupBy(branch).agg(F.min("seq").alias("_first")), [branch], "left")
    return marked.withColumn(
        "state",
        F.when(F.col("_first").isNull() | (F.col("seq") < F.col("_first")), "applied")
        .when(F.col("seq") == F.col("_first"), "conflict")
        .otherwise("blocked"),
    ).drop("_first")


def scoped_merge(local: DataFrame, found: DataFrame, keys: Sequence[str], in_scope: Column) -> DataFrame:
    """Local rows with those in scope replaced or joined by the found ones of the same name path.

    Local rows outside the scope, and in scope but not found, stay as they are.
    """
    kept = local.join(found.where(in_scope).select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*local.columns).unionByName(found.where(in_scope).select(*local.columns))


def parse_versions(df: DataFrame, column: str = "version") -> DataFrame:
    return df.withColumn("parsed", parsed(F.col(column)))


def next_version(df: DataFrame, group: str, column: str = "version", bump: str = "minor") -> DataFrame:
    """(group, next_version) after the greatest valid version; ``v0.1.0`` where there is none."""
    top = df.groupBy(group).agg(F.max(parsed(F.col(column))).alias("v"))
    major, minor, patch = F.col("v.major"), F.col("v.minor"), F.col("v.patch")
    zero = F.lit(0)
    bumped = {
        "major": shown(major + 1, zero, zero),
        "minor": shown(major, minor + 1, zero),
        "patch": shown(major, minor, patch + 1),
    }[bump]
    return top.select(group, F.when(F.col("v").isNull(), "v0.1.0").otherwise(bumped).alias("next_version"))


def ranked_versions(versions: DataFrame, branch: str) -> DataFrame:
    """Distinct valid versions (branch, key, version, rank) ranked from 1 inside their branch."""
    distinct = (
        versions.select(branch, parsed(F.col("version")).alias("key"), "version")
        .where("key IS NOT NULL")
        .groupBy(branch, "key")
        .agg(F.min("version").alias("version"))
    )
    return position_within(distinct, [branch], ["key"], "_at").withColumn("rank", F.col("_at") + 1).drop("_at")


def _rank_below(ends: DataFrame, ranked: DataFrame, branch: str, bits: int) -> DataFrame:
    """Each distinct end (branch, key, inclusive) with the rank of the last version before it,
    or at it when inclusive."""
    # Places of versions and ends in one order; an end stands just before or (inclusive) after its key.
    marks = ranked.select(branch, "key", F.lit(1).alias("side"), "rank").unionByName(
        ends.select(branch, "key", F.when(F.col("inclusive"), 2).otherwise(0).alias("side"), F.lit(None).cast("long").alias("rank")).distinct()
    )
    marks = durable(position_within(marks, [branch], ["key", "side"], "at"), "marks")
    held = last_before(marks, [branch], "at", F.col("rank"), "below", bits=bits)
    return held.where("rank IS NULL").select(branch, "key", (F.col("side") == 2).alias("inclusive"), F.coalesce("below", F.lit(0)).alias("below"))


def _placed(pairs: DataFrame, ranked: DataFrame, branch: str, bits: int) -> DataFrame:
    """Distinct pairs (branch, from_version, to_version) with versions between their ends, as the
    ranks ``after`` < rank <= ``until`` of what lies between."""
    wanted = durable(
        pairs.select(
            branch, "from_version", "to_version",
            parsed(F.col("from_version")).alias("lo"), parsed(F.col("to_version")).alias("hi"),
        ).where("lo IS NOT NULL AND hi IS NOT NULL").distinct(),
        "pairs",
    )
    ends = wanted.select(branch, F.col("lo").alias("key"), F.lit(True).alias("inclusive")).unionByName(
        wanted.select(branch, F.col("hi").alias("key"), F.lit(False).alias("inclusive"))
    )
    below = durable(_rank_below(ends, ranked, branch, bits), "below")
    lows = below.where("inclusive").select(branch, F.col("key").alias("lo"), F.col("below").alias("after"))
    highs = below.where("NOT inclusive").select(branch, F.col("key").alias("hi"), F.col("below").alias("until"))
    return wanted.join(lows, [branch, "lo"]).join(highs, [branch, "hi"]).where("until > after")


def versions_between(pairs: DataFrame, versions: DataFrame, branch: str = "branch", *, bits: int = BITS) -> DataFrame:
    """(branch, from_version, to_version, missing): the versions strictly between each pair.

    Ends are placed among the ranked versions first; then each pair is joined by rank to just the
    versions it misses, so the work is the size of the answer.
    """
    ranked = durable(ranked_versions(versions, branch), "ranked")
    each = _placed(pairs, ranked, branch, bits).withColumn(
        "rank", F.explode(F.sequence(F.col("after") + 1, F.col("until")))
    )
    return each.join(ranked.select(branch, "rank", F.col("version").alias("missing")), [branch, "rank"]).select(
        branch, "from_version", "to_version", "missing"
    )


def stale_snapshots(snapshots: DataFrame, branch: str = "branch", *, bits: int = BITS) -> DataFrame:
    """(branch, version, current_base, should_be_base, missing) for snapshots (branch, version,
    previous) with versions between them and their base; ``missing`` is their number, the rows
    of ``versions_between`` are their names."""
    ranked = durable(ranked_versions(snapshots, branch), "ranked")
    pairs = snapshots.where("previous IS NOT NULL").select(
        branch, F.col("previous").alias("from_version"), F.col("version").alias("to_version")
    )
    stale = _placed(pairs, ranked, branch, bits).join(
        ranked.select(branch, F.col("rank").alias("until"), F.col("version").alias("should_be_base")), [branch, "until"]
    )
    return skew_join(
        pairs,
        stale.select(branch, "from_version", "to_version", "should_be_base", (F.col("until") - F.col("after")).alias("missing")),
        [branch, "from_version", "to_version"],
    ).select(branch, F.col("to_version").alias("version"), F.col("from_version").alias("current_base"), "should_be_base", "missing")


def rebase_ops(ops: DataFrame, snapshots: DataFrame, old_base: str, new_base: str, base_only: bool = False) -> DataFrame:
    """Plan of the feature ops against all base ops in (old_base, new_base].

    ``ops`` is (version, seq, op_id, target, ...): the ops each base version brought, and the
    feature's with a null version. ``base_only`` looks at the new base's own ops alone.
    """
    key, low, high = parsed(F.col("version")), parsed(F.lit(old_base)), parsed(F.lit(new_base))
    known = snapshots.where(F.col("version").isin(old_base, new_base)).select("version").distinct().count()
    within = (key == high) if base_only else (key > low) & (key <= high)
    base = ops.where(within & F.lit(known == len({old_base, new_base})))
    return rebase_plan(ops.where("version IS NULL"), base, branch=None).drop("version")
