"""Cancellation and other results that once lost or mixed up rows."""

import random

import pytest
from pyspark.sql import functions as F
from test_fold import rows_of

from catalogops.operators import compact, evolve, fold, quality, validate, views

BITS = 3
UP = {"schema": "catalog", "table": "schema"}
MARKS = {"add": "op = 'add'", "drop": "op = 'drop'"}


def plain_lives(events):
    """[(start, end)] of the lives that end, from [(seq, op)] in order."""
    lives, start = [], None
    for seq, op in sorted(events):
        if op == "add" and start is None:
            start = seq
        elif op == "drop" and start is not None:
            lives.append((start, seq))
            start = None
    return lives


def test_drop_create_drop_keeps_the_first_drop(spark):
    log = [(1, "t", "tag"), (2, "t", "drop"), (3, "t", "add"), (4, "t", "tag"), (5, "t", "drop"), (6, "t", "drop"), (7, None, "tag"), (8, "u", "add"), (9, "t", "add")]
    frame = spark.createDataFrame(log, "seq LONG, target STRING, op STRING")
    kept = compact.cancel_pairs(frame, "target", *map(F.expr, MARKS.values()), bits=BITS)
    assert sorted(r["seq"] for r in kept.collect()) == [1, 2, 6, 7, 8, 9]


def hierarchy_log(rng, n):
    log = []
    for s in range(n):
        level = rng.choice(["catalog", "schema", "schema", "table", "table", "table"])
        i = rng.randrange({"catalog": 2, "schema": 4, "table": 8}[level])
        parent = None if level == "catalog" else i % {"schema": 2, "table": 4}[level]
        log.append((s, level, i, parent, rng.choice(["add", "add", "drop", "tag"])))
    return log


@pytest.mark.parametrize("seed", range(2))
def test_cancelled_containers_take_what_is_below(spark, seed):
    log = hierarchy_log(random.Random(seed), 300)
    lives = {}
    for level in ("catalog", "schema", "table"):
        for i in range(8):
            lives[level, i] = plain_lives([(s, op) for s, lv, j, _, op in log if (lv, j) == (level, i)])

    def gone(seq, level, i):
        if any(a <= seq <= b for a, b in lives[level, i]):
            return True
        return level in UP and gone(seq, UP[level], i % {"schema": 2, "table": 4}[level])

    frame = spark.createDataFrame(log, "seq LONG, level STRING, id INT, parent_id INT, op STRING")
    kept = compact.cancel_below(frame, ("catalog", "schema", "table"), *map(F.expr, MARKS.values()), bits=BITS)
    assert rows_of(kept) == sorted([r for r in log if not gone(r[0], r[1], r[2])], key=repr)
    # fold(compact(log)) = fold(log): the same objects live, since the same ops.
    alive = lambda df: rows_of(fold.live(fold.cascade_lifetimes(df.where("op <> 'tag'"), ["catalog", "schema", "table"], bits=BITS)))
    assert alive(kept) == alive(frame)


def test_fold_of_the_compacted_log_is_that_of_the_log(spark):
    rng = random.Random(4)
    log = [(s, rng.randrange(3), rng.choice(["add", "drop", "set", "set", "unset"]), rng.choice("pq"), str(s)) for s in range(200)]
    frame = spark.createDataFrame(log, "seq LONG, object_id INT, op STRING, key STRING, value STRING")

    def state(df):
        events = df.where("op IN ('add', 'drop')").select("object_id", "seq", F.col("op").alias("kind"))
        tags = df.where("op IN ('set', 'unset')").withColumnRenamed("op", "action")
        return rows_of(fold.fold_map(tags, "object_id", fold.live(fold.lifetimes(events, ["object_id"], bits=BITS))))

    kept = compact.cancel_pairs(frame, "object_id", *map(F.expr, MARKS.values()), bits=BITS)
    assert kept.count() < frame.count() and state(kept) == state(frame)


def test_signatures_differ_where_payloads_do(spark):
    payloads = ['{"a":"1,b=2"}', '{"a":"1","b":"2"}', '{"a":null}', '{"a":"\\\\N"}', '{"a":"null"}', "{}", None, "null", "not json", '"not json"', '{"a":{"y":1,"x":2}}', '{"a":[2,1]}', '{"a":[1,2]}']
    frame = spark.createDataFrame([("k", 1, p) for p in payloads], "op STRING, target LONG, payload STRING")
    assert validate.op_signature(frame).select("signature").distinct().count() == len(payloads)
    same = spark.createDataFrame([("k", 1, '{"a":{"y":1,"x":2},"b":1}'), ("k", 1, ' {"b": 1, "a": {"x": 2, "y": 1}}')], "op STRING, target LONG, payload STRING")
    assert validate.op_signature(same).select("signature").distinct().count() == 1


def test_time_series_rows_without_key_or_time_are_counted(spark):
    rows = [("a", 1), ("a", 1), ("a", 4), ("a", None), (None, 2), (None, None), ("b", None)]
    frame = spark.createDataFrame(rows, "k STRING, s LONG").select("k", F.timestamp_seconds("s").alias("at"))
    assert rows_of(quality.pk_timeseries(frame, "k", "at", bits=BITS)) == sorted(
        [("a", 4, 1, 1, 3_000_000, 3_000_000), ("b", 1, 1, 0, None, None), (None, 2, 1, 0, None, None)], key=repr
    )


def test_refresh_leaves_rows_beyond_its_mark(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "mv")
    views.refresh_mv(spark.createDataFrame([("x", 2)], "k STRING, n LONG"), target, 1, 2)
    source = spark.createDataFrame([(i, "x") for i in range(1, 6)], "at LONG, k STRING")
    count, total = {"n": F.count(F.lit(1))}, {"n": F.sum("n")}
    # A row that arrives after the mark was taken: the mark says 5, the second read sees 6.
    grown = source.unionByName(spark.createDataFrame([(6, "x")], "at LONG, k STRING"))
    reads = iter([source, grown])

    class Growing:
        sparkSession = spark

        def where(self, condition):
            return next(reads).where(condition)

    now = views.refresh_mv_incremental(Growing(), "at", target, ["k"], count, total)
    assert rows_of(now) == [("x", 5)]
    assert rows_of(views.refresh_mv_incremental(grown, "at", target, ["k"], count, total)) == [("x", 6)]


def test_extras_keep_microseconds(spark):
    frame = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-02 03:04:05.678901' AS at, TIMESTAMP_NTZ '2024-01-02 03:04:05.678901' AS local")
    rest = evolve.conform(frame, [("id", "INT")], extras="rest")
    told = rest.select(F.variant_get("rest", "$.at", "string").cast("timestamp").alias("at"), F.variant_get("rest", "$.local", "string").cast("timestamp_ntz").alias("local"))
    assert rows_of(told) == rows_of(frame.select("at", "local"))


def test_reorder_distance_counts_all_turned_pairs(spark):
    rng = random.Random(11)
    sides, want = ([], []), {}
    for table in range(12):
        width = rng.choice([1, 2, 3, 9, 40])
        orders = [rng.sample(range(90), width) for _ in range(2)]
        columns = [[c for c in range(width) if rng.random() < 0.8] for _ in range(2)]
        for side, order, held in zip(sides, orders, columns):
            side += [(table, c, order[c]) for c in held]
        shared = sorted(set(columns[0]) & set(columns[1]))
        if columns[0] and columns[1]:
            want[table] = sum((orders[0][a] < orders[0][b]) != (orders[1][a] < orders[1][b]) for a in shared for b in shared if a < b)
    old, new = (spark.createDataFrame(s, "table_id INT, column_id INT, position INT") for s in sides)
    for bits in (1, 20):
        got = {r.table_id: (r.distance, r.is_simple) for r in compact.reorder_distance(old, new, bits=bits).collect()}
        assert got == {t: (d, d <= 2) for t, d in want.items()}


def test_reorder_distance_of_a_wide_table(spark):
    width = 100_000
    old = spark.range(width).selectExpr("1 AS table_id", "id AS column_id", "id AS position")
    new = spark.range(width).selectExpr("1 AS table_id", "id AS column_id", f"{width - 1} - id AS position")
    assert compact.reorder_distance(old, new).first().distance == width * (width - 1) // 2
