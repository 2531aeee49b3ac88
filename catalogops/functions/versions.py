"""Version strings ``v?MAJOR.MINOR.PATCH``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the grammar of a version.
PATTERN = r"^v?(\d+)\.(\d+)\.(\d+)$"


def parsed(version: Column) -> Column:
    """Struct (major, minor, patch) that orders like the version; null when invalid.

    A part that no long can hold makes a version invalid.
    """
    part = lambda i: F.regexp_extract(version, PATTERN, i).try_cast("long")
    return F.when(
        version.rlike(PATTERN) & part(1).isNotNull() & part(2).isNotNull() & part(3).isNotNull(),
        F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")),
    )


def shown(major: Column, minor: Column, patch: Column) -> Column:
    return F.format_string("v%d.%d.%d", major, minor, patch)
