"""Legal privileges per kind of object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Object kind | legal privileges
LEGAL = """
catalog | ALL PRIVILEGES, USE CATALOG, USE SCHEMA, CREATE SCHEMA, CREATE TABLE, CREATE VIEW, CREATE FUNCTION, CREATE VOLUME, CREATE EXTERNAL LOCATION, CREATE STORAGE CREDENTIAL, CREATE CONNECTION, CREATE SHARING, CREATE RECIPIENT, CREATE PROVIDER, CREATE CATALOG, CREATE MODEL, CREATE MATERIALIZED VIEW, CREATE PIPELINE, EXECUTE, MODIFY, SELECT, READ VOLUME, WRITE VOLUME, APPLY TAG, USE MARKETPLACE ASSETS
schema | ALL PRIVILEGES, USE SCHEMA, CREATE TABLE, CREATE VIEW, CREATE FUNCTION, CREATE VOLUME, CREATE MODEL, CREATE MATERIALIZED VIEW, CREATE PIPELINE, EXECUTE, MODIFY, SELECT, READ VOLUME, WRITE VOLUME, APPLY TAG
table | ALL PRIVILEGES, SELECT, MODIFY, READ VOLUME, WRITE VOLUME, APPLY TAG
view | ALL PRIVILEGES, SELECT, MODIFY, READ VOLUME, WRITE VOLUME, APPLY TAG
volume | ALL PRIVILEGES, READ VOLUME, WRITE VOLUME, MANAGE, APPLY TAG
function | ALL PRIVILEGES, EXECUTE, APPLY TAG, MANAGE
materialized_view | ALL PRIVILEGES, SELECT, REFRESH, APPLY TAG
"""

BY_KIND = {
    kind.strip(): [p.strip() for p in listed.split(",")]
    for kind, listed in (line.split("|") for line in LEGAL.strip().splitlines())
}


def legal_privileges(spark: SparkSession) -> DataFrame:
    """(object_type, privilege): fixed in the source, well under a hundred rows."""
    rows = [(kind, p) for kind, listed in BY_KIND.items() for p in listed]
    return spark.createDataFrame(rows, "object_type STRING, privilege STRING")


def legal_values_sql() -> str:
    """The same pairs as a SQL VALUES list."""
    return ", ".join(f"('{k}', '{p}')" for k, listed in BY_KIND.items() for p in listed)
