"""How often near-duplicate detection sends whole texts, and how many at a time."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalogops.llm import minhash
from catalogops.plans.durable import Bucketed, durable
from catalogops.session import BATCH, small_batches


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture
def rows():
    """Families of edits, exact copies, rows that come twice, null ids and null texts."""
    rng = random.Random(11)
    made = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        made += [edited(rng, words, rng.randrange(6)) for _ in range(5)] + [" ".join(words)] * 2
    told = list(enumerate(made))
    return told + told[:9] + [(None, made[3]), (None, made[3]), (7, made[20]), (900, None), (None, None), (901, ""), (902, "")]


def carried(df):
    """The columns that each exchange of the plan is given."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = [part for part in plan.split("\n\n") if ") Exchange\n" in part]
    return [line for part in parts for line in part.splitlines() if line.startswith("Input")]


def test_texts_are_sent_packed_and_once(spark, rows, monkeypatch):
    sent, laid = [], []

    def seen(df, label):
        sent.extend(carried(df))
        return durable(df, label)

    class Seen(Bucketed):
        def add(self, df, step):
            laid.extend(carried(df))
            super().add(df, step)

    monkeypatch.setattr(minhash, "durable", seen)
    monkeypatch.setattr(minhash, "Bucketed", Seen, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        frame = durable(frame, "rows")
        kept = minhash.deduplicated(frame)
        last = carried(kept)
        got = [tuple(r) for r in kept.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sent and not any("text#" in line or "packed#" in line for line in sent)
    assert sum("packed#" in line for line in laid) == 1 and not any("text#" in line for line in laid)
    assert sum("text#" in line for line in last) == 1
    # One row of each class that all pairs give.
    data = sorted({t for _, t in rows if t})
    sets = {t: set(minhash._distinct(*minhash.text_bytes(pa.array([t])), minhash.SHINGLE)[1].tolist()) for t in data}
    pairs = [(x, y) for x in data for y in data if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    root = {t: t for t in data}

    def top(t):
        return t if root[t] == t else top(root[t])

    for x, y in pairs:
        root[top(x)] = top(y)
    want = Counter(top(t) if t else t for _, t in rows)
    assert Counter(top(t) if t else t for _, t in got) == Counter({t: 1 for t in want if t is not None}) + Counter({None: want[None]})
    for _, t in got:
        if t:
            least = min((d for d, x in rows if x and top(x) == top(t) and d is not None), default=None)
            assert (least, t) in got and (least, t) in rows


def test_batches_of_texts_are_bounded_by_bytes(spark, rows):
    before = spark.conf.get(BATCH, None)
    try:
        spark.conf.unset(BATCH)
        docs = spark.createDataFrame(rows[:20], "doc_id long, text string")
        corpus_pipeline.one_of_each(spark, docs, "").count()

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64()), pa.array([batch.num_rows], pa.int64())], names=["bytes", "n"])

        texts = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("text "), 1000).alias("text"))
        found = texts.mapInArrow(sizes, "bytes long, n long").collect()
        assert sum(r["n"] for r in found) == 4000 and max(r["bytes"] for r in found) < 9 << 20
        spark.conf.set(BATCH, "1m")
        small_batches(spark)
        assert spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)
