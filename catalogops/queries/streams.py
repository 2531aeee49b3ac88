"""The folds as streams over the event files, equal to their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogops.plans.fixtures import TEXTS, fixture
from catalogops.queries.fold import GRANTS_SQL
from catalogops.queries.registry import query
from catalogops.queries.selection import ERRORS_SQL
from catalogops.session import fresh_path
from catalogops.streaming import streams


def derived_stream(spark, sf_dir, name: str):
    """A fixture's text over the stream of events instead of the table."""
    view = f"events_stream_{name}"
    streams.table_stream(spark, sf_dir, "events").createOrReplaceTempView(view)
    return spark.sql(TEXTS[name].replace("«events»", view))


@query(
    "T01_stream_fold_latest",
    """SELECT target AS object_id, tag_name AS key, CASE arg_max(op, seq) WHEN 'set_table_tag' THEN 'set' ELSE 'unset' END AS action, arg_max(tag_value, seq) AS value
    FROM [fx1_oplog] WHERE op IN ('set_table_tag', 'unset_table_tag') GROUP BY 1, 2""",
)
def stream_fold_latest(spark, sf_dir):
    log = derived_stream(spark, sf_dir, "fx1_oplog").where(F.col("op").isin("set_table_tag", "unset_table_tag"))
    rows = log.select(
        F.col("target").alias("object_id"), F.col("tag_name").alias("key"), "seq",
        F.when(F.col("op") == "set_table_tag", "set").otherwise("unset").alias("action"), F.col("tag_value").alias("value"),
    )
    keys = ["object_id", "key"]
    folded = streams.fold_latest(rows, keys, ["action", "value"])
    target, check = streams.folders(spark, "latest")
    streams.run_to_folder(folded, target, "update", check)
    return streams.latest_of(streams.batches(spark, target, folded.schema), keys).select(*keys, "last.action", "last.value")


@query("T02_stream_fold_grants", GRANTS_SQL.format(where=""))
def stream_fold_grants(spark, sf_dir):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.ROCKSDB)
    try:
        folded = streams.fold_grants_stream(derived_stream(spark, sf_dir, "fx1g_grantlog"))
        target, check = streams.folders(spark, "grants")
        streams.run_to_folder(folded, target, "update", check)
    finally:
        spark.conf.set(key, before)
    updates = spark.read.option("basePath", target).schema("target_id LONG, principal STRING, privileges STRING, batch LONG").parquet(target)
    last = updates.groupBy("target_id", "principal").agg(F.max_by("privileges", "batch").alias("p"))
    return last.where("p <> ''").select("target_id", "principal", F.explode(F.split("p", ",")).alias("privilege"))


@query("T03_stream_mv", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS cnt, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_mv(spark, sf_dir):
    rows = streams.table_stream(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    target, check = streams.folders(spark, "mv")
    streams.stream_mv(rows, target, ["event_type", "day"], {"cnt": F.count(F.lit(1)), "total": F.sum("value")}, check)
    partials = streams.batches(spark, target, "event_type STRING, day STRING, cnt LONG, total DOUBLE")
    return streams.merge_partials(
        partials, ["event_type", "day"], {"cnt": F.sum("cnt"), "total": F.round(F.sum("total"), 4)}
    )


def _validated(spark, sf_dir):
    log = derived_stream(spark, sf_dir, "fx1p_payloadlog")
    good, bad, check = (fresh_path(spark, f"validate-{x}") for x in ("good", "bad", "check"))
    streams.stream_validate(log, good, bad, check)
    return good, bad, log.schema


@query("T04_stream_validate", ERRORS_SQL)
def stream_validate(spark, sf_dir):
    _, bad, _ = _validated(spark, sf_dir)
    return streams.batches(spark, bad, "op_id LONG, field STRING, code STRING").drop("batch")


@query("T04_stream_valid_ops", f"WITH bad AS ({ERRORS_SQL}) SELECT op_id, op FROM [fx1p_payloadlog] WHERE op_id NOT IN (SELECT op_id FROM bad)")
def stream_valid_ops(spark, sf_dir):
    good, _, schema = _validated(spark, sf_dir)
    return streams.batches(spark, good, schema).select("op_id", "op")


@query("T05_stream_dedup_ops", "SELECT event_id, event_type FROM events")
def stream_dedup_ops(spark, sf_dir):
    events = streams.table_stream(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    twice = events.union(streams.table_stream(spark, sf_dir, "events").where("event_id % 3 = 0").select("event_id", "event_type", "ts"))
    kept = streams.dedup_ops(twice, "event_id", "ts", "1 hour")
    target, check = streams.folders(spark, "dedup")
    streams.run_to_folder(kept, target, "append", check)
    return streams.batches(spark, target, kept.schema).select("event_id", "event_type")


def _windows_sql(length, slide):
    """Each event in every window of ``length`` hours, one starting every ``slide`` hours."""
    starts = ", ".join(f"date_trunc('hour', ts) - INTERVAL {h} HOUR" for h in range(0, length, slide))
    return f"""SELECT event_type AS op, strftime(s, '%Y-%m-%d %H:%M') AS window_start, strftime(s + INTERVAL {length} HOUR, '%Y-%m-%d %H:%M') AS window_end, count(*) AS n
    FROM (SELECT event_type, unnest([{starts}]) AS s FROM events) GROUP BY 1, 2, 3"""


def _shown(df, *names):
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) if c in names else F.col(c) for c in df.columns])


def _counted(spark, sf_dir, counts):
    target, check = streams.folders(spark, "counts")
    streams.run_to_folder(counts, target, "update", check)
    # Counts of a window only grow, so the newest is the largest.
    every = streams.batches(spark, target, counts.schema).groupBy("op", "window_start", "window_end").agg(F.max("n").alias("n"))
    return _shown(every, "window_start", "window_end")


@query("T06_stream_change_counts", _windows_sql(1, 1))
def stream_change_counts(spark, sf_dir):
    return _counted(spark, sf_dir, streams.change_counts(streams.table_stream(spark, sf_dir, "events"), "event_type", "ts", "1 hour"))


@query("T06_stream_sliding_counts", _windows_sql(2, 1))
def stream_sliding_counts(spark, sf_dir):
    return _counted(spark, sf_dir, streams.change_counts(streams.table_stream(spark, sf_dir, "events"), "event_type", "ts", "2 hours", "1 hour"))


@query(
    "T06_stream_session_counts",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 7200000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_session_counts(spark, sf_dir):
    counts = streams.session_counts(streams.table_stream(spark, sf_dir, "events"), "user_id", "ts", "2 hours")
    target, check = streams.folders(spark, "sessions")
    streams.run_to_folder(counts, target, "complete", check)
    every = spark.read.option("basePath", target).schema("user_id LONG, session_start TIMESTAMP, session_end TIMESTAMP, n LONG, batch LONG").parquet(target)
    newest = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == newest).select(
        "user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n"
    )
