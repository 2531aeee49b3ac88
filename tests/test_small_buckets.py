"""Operators that use bucketed order, with buckets small enough to be crossed all the time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from catalogops.operators import compact, graph, history, merge, quality, views


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions(spark):
    rng = random.Random(11)
    made = [("a" if rng.random() < 0.7 else "b", f"{rng.choice(['', 'v'])}{rng.randrange(2)}.{rng.randrange(4)}.{rng.randrange(3)}") for _ in range(60)]
    made.append(("a", "not a version"))
    key = lambda v: tuple(int(x) for x in v.lstrip("v").split("."))
    rows, last = [], {}
    for branch, v in made:
        rows.append((branch, v, last.get(branch)))
        if v[0] != "n":
            last[branch] = v
    df = spark.createDataFrame(rows, "branch STRING, version STRING, previous STRING")
    spelled = {}
    for branch, v in made:
        if v[0] != "n":
            spelled.setdefault((branch, key(v)), []).append(v)
    name = {k: min(vs) for k, vs in spelled.items()}

    def between(branch, lo, hi):
        return sorted(k for b, k in name if b == branch and key(lo) < k < key(hi))

    pairs = df.where("previous IS NOT NULL AND version NOT LIKE 'not%'").select(
        "branch", F.col("previous").alias("from_version"), F.col("version").alias("to_version")
    )
    want = {
        (b, p, v, name[(b, k)]) for b, v, p in rows if p and v[0] != "n" for k in between(b, p, v)
    }
    got = merge.versions_between(pairs, df, bits=2)
    assert {tuple(r) for r in got.collect()} == want
    stale = [
        (b, v, p, name[(b, between(b, p, v)[-1])], len(between(b, p, v)))
        for b, v, p in rows if p and v[0] != "n" and between(b, p, v)
    ]
    assert rows_of(merge.stale_snapshots(df, bits=2)) == sorted(stale, key=repr)
    nxt = {r.branch: r.next_version for r in merge.next_version(df, "branch").collect()}
    for b in ("a", "b"):
        top = max(k for br, k in name if br == b)
        assert nxt[b] == f"v{top[0]}.{top[1] + 1}.0"


def test_previous_deployment_skips_ties(spark):
    rng = random.Random(12)
    start = dt.datetime(2025, 1, 1)
    rows = [(i, rng.choice("xxy"), start + dt.timedelta(microseconds=rng.randrange(40) * 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "id LONG, environment STRING, deployed_at TIMESTAMP")
    want = []
    for i, e, t in rows:
        earlier = [(u, j) for j, f, u in rows if f == e and u < t]
        want.append((i, max(earlier)[1] if earlier else None))
    assert rows_of(history.previous_deployment(df, bits=3)) == sorted(want, key=repr)


def test_match_ops_uses_each_once(spark):
    left = spark.createDataFrame([("s", i) for i in range(20)] + [("t", 50)], "signature STRING, id LONG")
    right = spark.createDataFrame([("s", 100 + i) for i in range(7)] + [("u", 200)], "signature STRING, id LONG")
    got = history.match_ops(left, right, bits=2)
    assert rows_of(got) == [(i, 100 + i) for i in range(7)]


def test_batches_and_drop_first(spark):
    rng = random.Random(13)
    ops = [(s, f"o{s}", rng.choice([1, 1, 2]), rng.choice(["add_constraint", "drop_constraint"])) for s in range(60)]
    df = spark.createDataFrame(ops, "seq LONG, op_id STRING, target INT, op STRING")
    want = []
    for t in (1, 2):
        want += [(t, i + 1, o[1]) for i, o in enumerate([o for o in ops if o[2] == t])]
    assert rows_of(compact.batch_members(df, bits=2)) == sorted(want, key=repr)
    named = df.select("seq", F.col("target").alias("table_id"), F.col("op_id").alias("constraint_id"), "op")
    want = []
    for t in (1, 2):
        ordered = sorted([o for o in ops if o[2] == t], key=lambda o: (o[3] != "drop_constraint", o[0]))
        want += [(t, i + 1, o[1], o[3]) for i, o in enumerate(ordered)]
    assert rows_of(graph.drop_before_add(named, bits=2)) == sorted(want, key=repr)


def test_timeseries_gaps(spark):
    start = dt.datetime(2025, 1, 1)
    at = lambda us: start + dt.timedelta(microseconds=us)
    df = spark.createDataFrame([(1, at(u)) for u in (0, 5, 5, 90, 1000)] + [(2, at(3))], "k INT, ts TIMESTAMP")
    assert rows_of(quality.pk_timeseries(df, "k", "ts", bits=2)) == [(1, 5, 1, 5, 910), (2, 1, 0, None, None)]


def test_rebase_plan(spark):
    feature = spark.createDataFrame([(s, f"o{s}", s % 4, s % 2) for s in range(12)], "seq LONG, op_id STRING, target INT, branch INT")
    base = spark.createDataFrame([(3,), (3,), (9,)], "target INT")
    got = {r.seq: r.state for r in merge.rebase_plan(feature, base).collect()}
    assert got == {s: "applied" if s % 2 == 0 or s < 3 else "conflict" if s == 3 else "blocked" for s in range(12)}


def test_views_in_order_and_in_circles(spark):
    order = views.register_views(
        spark, {"a_top": "SELECT count(*) AS n FROM m_mid JOIN z_base", "m_mid": "SELECT * FROM z_base WHERE id > 1", "z_base": "SELECT id FROM range(5)"}
    )
    assert order == ["z_base", "m_mid", "a_top"] and spark.table("a_top").first().n == 15
    with pytest.raises(ValueError, match="circle"):
        views.register_views(spark, {"p": "SELECT * FROM q", "q": "SELECT * FROM p"})


def test_stored_view(spark, tmp_path):
    source = spark.range(100).withColumn("k", F.col("id") % 3)
    partial, merged = {"n": F.count(F.lit(1))}, {"n": F.sum("n")}
    target = str(tmp_path / "mv")
    views.refresh_mv(source.where("id <= 40").groupBy("k").agg(F.count(F.lit(1)).alias("n")), target, 1, 40)
    now = views.refresh_mv_incremental(source, "id", target, ["k"], partial, merged)
    assert rows_of(now) == [(0, 34), (1, 33), (2, 33)]
    again = views.refresh_mv_incremental(source, "id", target, ["k"], partial, merged)
    assert rows_of(again) == rows_of(now)
