"""Streams over several files, one batch each, against the batch folds."""

import random

import pytest
from pyspark.sql import functions as F

from catalogops.operators import fold
from catalogops.streaming import streams

GRANT = "seq LONG, target_id LONG, principal STRING, op STRING, privileges STRING"


@pytest.fixture(scope="module")
def grant_rows(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = []
    for s in range(240):
        op = rng.choice(["add_grant", "revoke_grant", "revoke_grant"])
        listed = ",".join(p for p in ("SELECT", "MODIFY", "APPLY TAG") if rng.random() < 0.5)
        rows.append((s, rng.randrange(3), rng.choice("ab"), op, None if op == "revoke_grant" and rng.random() < 0.2 else listed))
    folder = str(tmp_path_factory.mktemp("grants"))
    # Files arrive out of log order.
    for part in (rows[80:160], rows[:80], rows[160:]):
        spark.createDataFrame(part, GRANT).coalesce(1).write.mode("append").parquet(folder)
    return rows, folder


def test_grants_over_batches(spark, grant_rows):
    rows, folder = grant_rows
    stream = spark.readStream.schema(GRANT).option("maxFilesPerTrigger", 1).parquet(folder)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.ROCKSDB)
    try:
        target, check = streams.folders(spark, "grants")
        streams.run_to_folder(streams.fold_grants_stream(stream), target, "update", check)
    finally:
        spark.conf.set(key, before)
    updates = spark.read.option("basePath", target).schema("target_id LONG, principal STRING, privileges STRING, batch LONG").parquet(target)
    assert updates.select("batch").distinct().count() == 3
    last = updates.groupBy("target_id", "principal").agg(F.max_by("privileges", "batch").alias("p")).collect()
    got = sorted((r.target_id, r.principal, p) for r in last for p in r.p.split(",") if p)
    listed = F.filter(F.split("privileges", ","), lambda p: p != "")
    log = spark.createDataFrame(rows, GRANT).withColumn("privileges", F.when(F.col("privileges").isNotNull(), listed))
    assert got == sorted(map(tuple, fold.fold_grants(log).collect()))


def test_latest_over_batches(spark, grant_rows):
    rows, folder = grant_rows
    stream = spark.readStream.schema(GRANT).option("maxFilesPerTrigger", 1).parquet(folder)
    folded = streams.fold_latest(stream, ["target_id"], ["op"])
    target, check = streams.folders(spark, "latest")
    streams.run_to_folder(folded, target, "update", check)
    got = {r.target_id: r.last.op for r in streams.latest_of(streams.batches(spark, target, folded.schema), ["target_id"]).collect()}
    want = {}
    for s, t, _, op, _ in rows:
        want[t] = op
    assert got == want
    # Running again finds nothing new and changes nothing.
    streams.run_to_folder(folded, target, "update", check)
    assert streams.batches(spark, target, folded.schema).count() == streams.batches(spark, target, folded.schema).distinct().count()
