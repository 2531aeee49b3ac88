"""Names: quoting, stable ids, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: Column) -> Column:
    """A name in back-ticks, inner back-ticks doubled."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def text_literal(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def stable_id(prefix: Column, *parts: Column) -> Column:
    """``prefix_`` and 12 hex digits of the SHA-1 over the lower-cased, trimmed parts."""
    joined = F.concat_ws("||", *[F.lower(F.trim(p)) for p in parts])
    return F.concat(prefix, F.lit("_"), F.substring(F.sha1(joined), 1, 12))


def joined_path(base: Column, relative: Column) -> Column:
    root = F.regexp_replace(base, "/+$", "")
    return F.when(
        F.coalesce(relative, F.lit("")) == "", root
    ).otherwise(F.concat(root, F.lit("/"), F.regexp_replace(relative, "^/+", "")))
