"""Row filters, column masks and grants applied to data.

The rules of one table are a short list; what they do to the rows is plain column expressions,
so filters reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.functions.privileges import BY_KIND, legal_privileges


# Literals and quoted names are passed over; the second group is whoever runs the statement.
_USER = re.compile(
    r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|(\b(?:(?:current_user|session_user|user)\s*\(\s*\)|(?:current_user|session_user)\b(?!\s*\()))""",
    re.IGNORECASE | re.DOTALL,
)
_GROUPS = re.compile(r"\b(?:is_account_group_member|is_member)\s*\(", re.IGNORECASE)


def _for_user(expression: str, user: str) -> str:
    """The expression with the functions for the current user standing for the given one.

    Group membership cannot be told from a user's name, so it is refused, not evaluated for
    whoever runs the job.
    """
    literal = "'" + user.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if _GROUPS.search(_USER.sub(lambda m: "" if m[1] else literal, expression)):
        raise ValueError("group membership is not known here")
    return _USER.sub(lambda m: m[1] or literal, expression)


def rules_of(rules: DataFrame, table_id) -> list[dict]:
    """The enabled rules of one table (kind, column, expression), in rule order: a short list."""
    rows = rules.where((F.col("table_id") == table_id) & F.col("enabled")).orderBy("rule_id")
    return [row.asDict() for row in rows.select("rule_id", "kind", "column", "expression").collect()]


def apply_row_filter(df: DataFrame, predicates: Sequence[str], user: str = "") -> DataFrame:
    """Rows for which every predicate is true."""
    for predicate in predicates:
        df = df.where(F.expr(_for_user(predicate, user)))
    return df


def restrict_by_map(df: DataFrame, allowed: DataFrame, keys: Sequence[str], user: str) -> DataFrame:
    """Rows whose key is allowed to the user; ``allowed`` is (user, keys)."""
    mine = allowed.where(F.col("user") == user).select(*keys).distinct()
    return df.join(mine, list(keys), "left_semi")


def apply_column_masks(df: DataFrame, masks: Mapping[str, str], user: str = "") -> DataFrame:
    """Columns replaced by their masking expressions over the unmasked row, types kept."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            F.expr(_for_user(masks[c], user)).cast(types[c]).alias(c) if c in masks else F.col(c)
            for c in df.columns
        ]
    )


def secure_view(
    df: DataFrame, predicates: Sequence[str], masks: Mapping[str, str], grants: DataFrame, user: str, target_id
) -> DataFrame:
    """What one principal sees of a table: nothing without SELECT, else filtered and masked rows.

    ``grants`` is live (target_id, principal, privilege).
    """
    may_read = not grants.where(
        (F.col("target_id") == target_id) & (F.col("principal") == user) & F.col("privilege").isin("SELECT", "ALL PRIVILEGES")
    ).isEmpty()
    if not may_read:
        return df.where(F.lit(False))
    return apply_column_masks(apply_row_filter(df, predicates, user), masks, user)


def access_matrix(grants: DataFrame) -> DataFrame:
    """(principal, object_type, privilege, n): objects each principal may use so, with ALL
    PRIVILEGES spelled out. ``grants`` is (target_id, principal, object_type, privilege)."""
    legal = legal_privileges(grants.sparkSession).where("privilege <> 'ALL PRIVILEGES'")
    every = grants.where("privilege = 'ALL PRIVILEGES'").drop("privilege").join(legal, "object_type")
    single = grants.where("privilege <> 'ALL PRIVILEGES'")
    return (
        single.unionByName(every).select("target_id", "principal", "object_type", "privilege").distinct()
        .groupBy("principal", "object_type", "privilege").agg(F.count(F.lit(1)).alias("n"))
    )


def access_pivot(matrix: DataFrame) -> DataFrame:
    """The matrix with one column per privilege of the fixed list."""
    listed = sorted({p for ps in BY_KIND.values() for p in ps if p != "ALL PRIVILEGES"})
    return matrix.groupBy("principal", "object_type").pivot("privilege", listed).agg(F.sum("n"))


def mask_by_tag(df: DataFrame, tags: DataFrame, key: str, mask: str) -> DataFrame:
    """Mask the columns that carry a tag; ``{column}`` in ``mask`` is the column's name.

    ``tags`` is (column, key): the tags of one table's columns, a short list.
    """
    tagged = [row[0] for row in tags.where(F.col("key") == key).select("column").distinct().collect()]
    return apply_column_masks(df, {c: mask.replace("{column}", f"`{c}`") for c in tagged if c in df.columns})
