"""Schema changes applied to DataFrames: a list of column ops becomes one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.functions.casting import tried
from catalogops.operators.quality import not_null_violations


def add_column(df: DataFrame, name: str, type_: str, nullable: bool = True, default=None) -> DataFrame:
    if not nullable and default is None:
        raise ValueError(f"column {name} is not null and needs a default")
    return df.withColumn(name, F.lit(default).cast(type_))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def change_type(df: DataFrame, name: str, type_: str) -> DataFrame:
    """Values that do not cast become null; ``impact.lossy_casts`` counts them first."""
    return df.withColumn(name, tried(F.col(name), df.schema[name].dataType.simpleString(), type_))


def set_not_null(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame with the columns held to be not null, once a check finds no null in them: a null
    that turns up later stops the job. (Spark has no expression that drops the nullable flag.)"""
    bad = not_null_violations(df, names).where("n > 0").collect()  # one row per named column
    if bad:
        raise ValueError("null values in " + ", ".join(f"{r.column} ({r.n})" for r in bad))
    return df.select(*[F.coalesce(c, F.raise_error(F.lit(f"null in {c}"))).alias(c) if c in names else F.col(c) for c in df.columns])


def reorder_columns(df: DataFrame, name: str, first: bool = False, after: str | None = None) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    at = 0 if first else rest.index(after) + 1
    return df.select(*rest[:at], name, *rest[at:])


def evolve(df: DataFrame, ops: Sequence[Mapping], ids: Mapping[str, str] | None = None) -> DataFrame:
    """Apply ordered column ops in one ``select``.

    Columns are followed by id through renames: ``ids`` maps id to present name (by default a
    column is its own id). Ops: add_column (column_id, name, type, nullable, default),
    drop_column, rename_column (newName), change_column_type (newType), reorder_columns (order).
    """
    names = dict(ids) if ids else {c: c for c in df.columns}
    columns = {i: [n, F.col(n), df.schema[n].dataType.simpleString()] for i, n in names.items()}
    order = list(columns)
    for op in ops:
        kind, target = op["op"], op.get("column_id")
        if kind == "add_column":
            if not op.get("nullable", True) and op.get("default") is None:
                raise ValueError(f"column {op['name']} is not null and needs a default")
            if target not in columns:
                columns[target] = [op["name"], F.lit(op.get("default")).cast(op["type"]), op["type"]]
                order.append(target)
        elif kind == "reorder_columns":
            listed = op["order"]
            order.sort(key=lambda i: listed.index(i) if i in listed else len(listed))
        elif target in columns:
            if kind == "drop_column":
                columns.pop(target)
                order.remove(target)
            elif kind == "rename_column":
                columns[target][0] = op["newName"]
            elif kind == "change_column_type":
                _, value, source = columns[target]
                columns[target][1:] = [tried(value, source, op["newType"]), op["newType"].lower()]
    return df.select(*[columns[i][1].alias(columns[i][0]) for i in order])


def conform(df: DataFrame, declared: Sequence[tuple[str, str]], extras: str | None = None) -> DataFrame:
    """The frame with just the declared (name, type) columns: missing ones null, others cast.

    With ``extras`` the undeclared columns are kept in one VARIANT column of that name.
    """
    have = {c.lower(): c for c in df.columns}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = [
        tried(F.col(have[n.lower()]), types[have[n.lower()]], t).alias(n) if n.lower() in have else F.lit(None).cast(t).alias(n) for n, t in declared
    ]
    if extras:
        wanted = {n.lower() for n, _ in declared}
        rest = [c for c in df.columns if c.lower() not in wanted]
        # Written to the microsecond, as they are held.
        formats = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
        kept = F.parse_json(F.to_json(F.struct(*rest), formats)) if rest else F.lit(None).cast("variant")
        columns.append(kept.alias(extras))
    return df.select(*columns)


def conform_problems(df: DataFrame, declared: Sequence[tuple[str, str]]) -> DataFrame:
    """(column, problem, n): missing and extra columns, and values that do not cast, in one pass."""
    have = {c.lower(): c for c in df.columns}
    wanted = {n.lower() for n, _ in declared}
    rows = [(n, "missing", F.lit(0).cast("long")) for n, _ in declared if n.lower() not in have]
    rows += [(c, "extra", F.lit(0).cast("long")) for c in df.columns if c.lower() not in wanted]
    aggs = []
    for n, t in declared:
        if n.lower() in have:
            c = F.col(have[n.lower()])
            source = df.schema[have[n.lower()]].dataType.simpleString()
            aggs.append(F.count_if(c.isNotNull() & tried(c, source, t).isNull()).alias(f"bad_{n}"))
            rows.append((n, "not_castable", F.col(f"bad_{n}")))
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"), n.alias("n")) for c, p, n in rows])
    return counted.select(F.explode(each).alias("r")).select("r.*").where("problem <> 'not_castable' OR n > 0")


def merge_versions(parts: Sequence[tuple[DataFrame, Sequence[Mapping], Mapping[str, str]]]) -> DataFrame:
    """Files written under several schema versions as one table: each part with the ops that
    bring it up to date, and its column ids."""
    result = None
    for df, ops, ids in parts:
        now = evolve(df, ops, ids)
        result = now if result is None else result.unionByName(now, allowMissingColumns=True)
    return result
