"""Cut a plan by writing it to the shared folder and reading it back.

A written table survives lost executors, keeps columns prunable, and gives the next
join real sizes to choose from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.session import fresh_path


def durable(df: DataFrame, label: str = "cut") -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Bucketed:
    """A written table in buckets by one column, to which each round of a loop adds its rows under a step.

    Rows of equal keys meet in joins and aggregates without being sent again, so a round shuffles only what is
    new in it. There are as many buckets as shuffle partitions. No key may be hot: its rows lie in one bucket.
    """

    def __init__(self, spark: SparkSession, label: str, key: str):
        self.spark, self.key = spark, key
        self.name, self.path = f"{label}_{uuid.uuid4().hex}", fresh_path(spark, label)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, df: DataFrame, step: int) -> None:
        """``df`` should come dealt by the key, or each of its tasks writes a file for each bucket."""
        stepped = df.withColumn("step", F.lit(step))
        stepped.write.mode("append").partitionBy("step").bucketBy(self.buckets, self.key).option("path", self.path).saveAsTable(self.name)

    def rows(self, step: int | None = None) -> DataFrame:
        table = self.spark.table(self.name)
        return table if step is None else table.where(F.col("step") == step)

    def forget(self) -> None:
        """Take the name from the session's list of tables, once nothing reads it any more; the files stay. Without rows added there is none."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
