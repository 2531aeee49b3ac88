"""Bucketed windows, positions and salted joins against plain computations."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalogops.plans import skew
from catalogops.plans.ordered import global_position, last_before, rank_within, running_sum


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # Key 0 holds most rows, and order values are sparse.
    data = [
        (0 if rng.random() < 0.6 else rng.randrange(1, 6), seq * rng.choice([1, 1, 1, 1]) * 5 + 3, rng.randrange(10) if rng.random() < 0.5 else None)
        for seq in range(800)
    ]
    return spark.createDataFrame(data, "k INT, seq LONG, v INT").cache()


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("reverse", [False, True])
def test_last_before(rows, levels, reverse):
    order = F.desc("seq") if reverse else F.asc("seq")
    plain = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("p", F.last("v", ignorenulls=True).over(plain))
    got = last_before(rows, ["k"], "seq", F.col("v"), "p", reverse=reverse, bits=4, levels=levels)
    assert same(got, want)


def test_rank_and_sum(rows):
    plain = Window.partitionBy("k").orderBy("seq")
    want = rows.withColumn("r", F.row_number().over(plain).cast("long"))
    assert same(rank_within(rows, ["k"], "seq", "r", bits=5), want)
    ones = rows.withColumn("one", F.coalesce("v", F.lit(1)))
    want = ones.withColumn("s", F.sum("one").over(plain))
    assert same(running_sum(ones, ["k"], "seq", "one", "s", bits=5), want)


def test_global_position(rows):
    want = rows.withColumn("p", F.row_number().over(Window.orderBy("k", "seq")).cast("long"))
    assert same(global_position(rows, ["k", "seq"], "p"), want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, rows, how, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 100)
    small = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c"), (9, "d")], "k INT, name STRING")
    assert [r.k for r in skew.heavy_keys(rows, ["k"]).collect()] == [0]
    got = skew.skew_join(rows, small, ["k"], how, salts=8)
    assert same(got, rows.join(small, "k", how))
    assert got.columns == rows.join(small, "k", how).columns
