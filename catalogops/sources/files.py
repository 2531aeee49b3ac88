"""Change logs, snapshots, configuration and history kept as files and tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.functions.versions import parsed
from catalogops.operators.validate import is_valid, op_errors

OP = (
    "id STRING, ts STRING, provider STRING, op STRING, target STRING, payload MAP<STRING,STRING>, scope STRING"
)
CHANGELOG = f"version LONG, sinceSnapshot STRING, lastModified STRING, ops ARRAY<STRUCT<{OP.replace(' STRING', ': STRING').replace(' MAP', ': MAP')}>>"
COLUMN = "STRUCT<id: STRING, name: STRING, type: STRING, nullable: BOOLEAN, comment: STRING>"
TABLE = f"STRUCT<id: STRING, name: STRING, comment: STRING, columns: ARRAY<{COLUMN}>>"
NAMED = "STRUCT<id: STRING, name: STRING, comment: STRING>"
SCHEMA = f"STRUCT<id: STRING, name: STRING, tables: ARRAY<{TABLE}>, views: ARRAY<{NAMED}>, volumes: ARRAY<{NAMED}>, functions: ARRAY<{NAMED}>>"
SNAPSHOT = (
    "id STRING, version STRING, name STRING, ts STRING, createdBy STRING, previousSnapshot STRING, hash STRING, tags ARRAY<STRING>, comment STRING, "
    f"state STRUCT<catalogs: ARRAY<STRUCT<id: STRING, name: STRING, schemas: ARRAY<{SCHEMA}>>>>"
)
ENVIRONMENT = (
    "STRUCT<topLevelName: STRING, catalogMappings: MAP<STRING,STRING>, managedCategories: ARRAY<STRING>, "
    "existingObjects: MAP<STRING,ARRAY<STRING>>, importBaselineSnapshot: STRING, allowDrift: BOOLEAN>"
)
CONFIG = f"environments MAP<STRING,{ENVIRONMENT}>, externalLocations MAP<STRING,STRUCT<paths: MAP<STRING,STRING>>>"


def read_changelog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Op rows (op_id, index, ts, provider, op, target, payload, scope, file) of change log files.

    Schemas are fixed, never inferred. Keep the log as parquet afterwards: a multi-line JSON
    file is read by one task.
    """
    docs = spark.read.schema(CHANGELOG).json(path, multiLine=multi_line)
    return docs.select(F.col("_metadata.file_path").alias("file"), "sinceSnapshot", F.posexplode("ops").alias("index", "o")).select(
        F.col("o.id").alias("op_id"), "index", "o.ts",
        # Kinds are written with their provider in front; operators know them without.
        F.coalesce("o.provider", F.nullif(F.regexp_extract("o.op", r"^([^.]+)\.", 1), F.lit(""))).alias("provider"),
        F.regexp_replace("o.op", r"^[^.]*\.", "").alias("op"), "o.target", "o.payload", "o.scope", "file"
    )


def read_snapshots(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Snapshot files as tables: ``snapshots``, ``objects`` and ``columns``, each with ``version``."""
    docs = spark.read.schema(SNAPSHOT).json(path, multiLine=multi_line)
    catalogs = docs.select("version", F.explode("state.catalogs").alias("c"))
    schemas = catalogs.select("version", F.col("c.id").alias("parent"), F.explode("c.schemas").alias("s"))
    tables = schemas.select("version", F.col("s.id").alias("parent"), F.explode("s.tables").alias("t"))
    columns = tables.select("version", F.col("t.id").alias("table_id"), F.posexplode("t.columns").alias("position", "k"))

    def objects(frame: DataFrame, kind: str, item: str, parent: Column) -> DataFrame:
        return frame.select(
            "version", F.lit(kind).alias("object_type"), F.col(f"{item}.id").alias("object_id"), parent.alias("parent_id"), F.col(f"{item}.name").alias("name")
        )

    found = objects(catalogs, "catalog", "c", F.lit(None).cast("string"))
    found = found.unionByName(objects(schemas, "schema", "s", F.col("parent"))).unionByName(objects(tables, "table", "t", F.col("parent")))
    for field, kind in (("views", "view"), ("volumes", "volume"), ("functions", "function")):
        items = schemas.select("version", F.col("s.id").alias("parent"), F.explode(f"s.{field}").alias("x"))
        found = found.unionByName(objects(items, kind, "x", F.col("parent")))
    return {
        "snapshots": docs.drop("state"),
        "objects": found,
        "columns": columns.select("version", "table_id", F.col("k.id").alias("column_id"), "k.name", "k.type", "k.nullable", "k.comment", F.col("position").cast("long").alias("position")),
    }


def read_env_config(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Configuration files as rows: ``mappings``, ``managed``, ``existing``, ``locations``."""
    docs = spark.read.schema(CONFIG).json(path, multiLine=multi_line)
    envs = docs.select(F.explode("environments").alias("environment", "e"))
    places = docs.select(F.explode("externalLocations").alias("location_name", "l"))
    return {
        "mappings": envs.select("environment", F.explode("e.catalogMappings").alias("logical", "physical")),
        "managed": envs.select("environment", F.explode("e.managedCategories").alias("managed_category")),
        "existing": envs.select("environment", F.explode("e.existingObjects").alias("kind", "names")).select("environment", "kind", F.explode("names").alias("name")),
        "locations": places.select("location_name", F.explode("l.paths").alias("environment", "base_path")),
    }


def read_information_schema(
    objects: DataFrame, columns: Sequence[str], order: Sequence[str], catalog=None, schema=None, table=None
) -> DataFrame:
    """A metadata scan: only the asked columns and scope, in a stable order.

    Equality on plain columns, so the filters reach the scan.
    """
    for column, wanted in (("catalog_name", catalog), ("schema_name", schema), ("table_name", table)):
        if wanted is not None:
            objects = objects.where(F.col(column) == wanted)
    return objects.select(*columns).orderBy(*order)


def write_snapshot(state: DataFrame, path: str, version: str) -> None:
    """Persist one version; other versions in the same place stay."""
    state.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_latest_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the greatest version; the partition filter prunes the others."""
    every = spark.read.schema(schema).option("basePath", path).parquet(path)
    latest = every.select("version").distinct().agg(F.max_by("version", parsed(F.col("version")))).first()[0]
    return every.where(F.col("version") == latest)


def append_ops(log: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Append the valid ops to the log at ``path``; gives (the log, problems of the rejected)."""
    log.where(is_valid()).write.mode("append").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path), op_errors(log)


def append_deployment(events: DataFrame, path: str) -> DataFrame:
    """Append status events (id, environment, status, at, ...) of deployments; gives the log."""
    events.write.mode("append").parquet(path)
    return events.sparkSession.read.schema(events.schema).parquet(path)


def latest_status(events: DataFrame) -> DataFrame:
    """Each deployment as of its newest status event; a table without updates reads as if it had them."""
    rest = [c for c in events.columns if c not in ("id", "at")]
    return events.groupBy("id").agg(F.max(F.struct("at", *rest)).alias("l")).select("id", "l.*")


def append_deployment_ops(ops: DataFrame, path: str) -> DataFrame:
    """Append op rows of deployments, the payload MAP as JSON with sorted keys."""
    sorted_payload = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload"))))
    rows = ops.withColumn("payload", sorted_payload)
    rows.write.mode("append").parquet(path)
    return ops.sparkSession.read.schema(rows.schema).parquet(path)


def volume_inventory(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder (path, size, modified, ext) from their metadata, contents unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))


def rows_by_file(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, file_name, rows) for frames read from files; a file without rows has no line."""
    counted = [
        df.select("_metadata.file_name").groupBy("file_name").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "file_name", "rows")
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counted)


def inventory_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = (), format_: str = "parquet", options: dict | None = None, rows_per_file: int = 5_000_000
) -> None:
    """Write a table with its layout; clustering wins over partitioning where both are given.

    Rows meet by their layout columns before the write; a large partition is split by AQE's
    rebalance, so a hot value does not end in one task. Files keep ``rows_per_file``.
    """
    layout = list(cluster_by) or list(partition_by)
    if layout:
        df = df.hint("rebalance", *layout)
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    writer = df.write.mode("overwrite").format(format_).options(**(options or {})).option("maxRecordsPerFile", rows_per_file)
    if partition_by and not cluster_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
