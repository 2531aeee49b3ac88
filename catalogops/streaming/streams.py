"""The folds kept current over streams.

Every sink is a folder with one sub-folder per batch id, overwritten when a batch runs again, so
a restarted query leaves no doubled rows. State lives in the state store or in those folders.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catalogops.operators.validate import is_valid, op_errors
from catalogops.session import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_folder(stream: DataFrame, target: str, mode: str, checkpoint: str) -> None:
    """Run over everything available now; each batch writes its rows once under its id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).foreachBatch(write).start()
    )
    query.awaitTermination()


def batches(spark: SparkSession, target: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", target).parquet(f"{target}/batch=*")


def fold_latest(stream: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Last values per key; partial aggregates combine before the shuffle, so hot keys are safe."""
    return stream.groupBy(*keys).agg(F.max(F.struct("seq", *fields)).alias("last"))


def latest_of(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest of the updates each batch gave for a key."""
    return updates.groupBy(*keys).agg(F.max("last").alias("last"))


def _before_shuffle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keep per Arrow batch only the last reset of a principal and the last of equal revokes."""
    for part in parts:
        reset = (part["op"] == "add_grant") | part["privileges"].isna() | (part["privileges"] == "")
        listed = part["privileges"].where(~reset, "")
        part = part.assign(_r=reset, _l=listed).sort_values("seq")
        yield part.drop_duplicates(["target_id", "principal", "_r", "_l"], keep="last").drop(columns=["_r", "_l"])


class GrantState(StatefulProcessor):
    """Per (target, principal): the last reset and the last revoke of each privilege.

    Both only grow by seq, so the order in which rows arrive does not matter. A privilege of the
    last add lives unless its last revoke is newer. All of a key is one value, read once and written once a
    batch: each call to the state store goes to the JVM and back, which took most of a key's time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("grants", "seq LONG, listed STRING, names ARRAY<STRING>, seqs ARRAY<LONG>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, listed, names, seqs = self.state.get() or (-1, "", [], [])
        revoked = dict(zip(names, seqs, strict=True))
        for part in rows:
            for at, op, privileges in zip(part["seq"], part["op"], part["privileges"], strict=True):
                if op == "add_grant" or not privileges:
                    if at > seq:
                        seq, listed = int(at), (privileges or "") if op == "add_grant" else ""
                else:
                    for privilege in filter(None, privileges.split(",")):
                        if at > revoked.get(privilege, -1):
                            revoked[privilege] = int(at)
        self.state.update((seq, listed, list(revoked), list(revoked.values())))
        alive = sorted(p for p in set(filter(None, listed.split(","))) if revoked.get(p, -1) < seq)
        yield pd.DataFrame({"target_id": [key[0]], "principal": [key[1]], "privileges": [",".join(alive)]})

    def close(self) -> None:
        pass


def fold_grants_stream(stream: DataFrame) -> DataFrame:
    """Live privileges per (target_id, principal) from (target_id, principal, seq, op, privileges
    as text). The session's state store provider must be RocksDB."""
    thinned = stream.select("target_id", "principal", "seq", "op", "privileges").mapInPandas(
        _before_shuffle, "target_id LONG, principal STRING, seq LONG, op STRING, privileges STRING"
    )
    return thinned.groupBy("target_id", "principal").transformWithStateInPandas(
        statefulProcessor=GrantState(), outputStructType="target_id LONG, principal STRING, privileges STRING",
        outputMode="Update", timeMode="None",
    )


def stream_mv(stream: DataFrame, target: str, keys: Sequence[str], partial: Mapping[str, Column], checkpoint: str) -> None:
    """Each batch stores its partial aggregate under its id; ``merge_partials`` reads the whole."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(*[c.alias(n) for n, c in partial.items()]).write.mode("overwrite").parquet(
            f"{target}/batch={batch_id}"
        )

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(store).start().awaitTermination()


def merge_partials(partials: DataFrame, keys: Sequence[str], merge: Mapping[str, Column]) -> DataFrame:
    return partials.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def stream_validate(stream: DataFrame, good: str, bad: str, checkpoint: str) -> None:
    """Good ops to one folder, problems of the rejected to another, by batch id."""

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.where(is_valid()).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        op_errors(batch).write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(split).start().awaitTermination()


def dedup_ops(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Rows without repeated ids; an id is remembered for ``late`` past the newest time seen."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def change_counts(stream: DataFrame, op: str, ts: str, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Ops per kind and time window (tumbling, or sliding with ``slide``)."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark(ts, late)
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return timed.groupBy(F.col(op).alias("op"), span.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "op", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )


def session_counts(stream: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """Ops per key and session: a session ends when nothing comes for ``gap``."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )


def folders(spark: SparkSession, label: str) -> tuple[str, str]:
    """A fresh (target, checkpoint) pair in the shared folder."""
    return fresh_path(spark, f"{label}-out"), fresh_path(spark, f"{label}-check")
