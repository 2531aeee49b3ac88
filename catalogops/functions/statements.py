"""SQL statements of the change log's kinds, filled in from rows by column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogops.functions.names import quoted, text_literal
from catalogops.functions.opkinds import FIELDS

# A statement per kind. {path} is the object's whole name, {up} its container's, {last} its own;
# {`f} a payload field as a name, {'f} as text, {=f} as it is, {,f} a list of names, {*f} a list of words,
# {?f|a|b} a if true, else b. What stands in [[ ]] is left out where a field of it is missing.
STATEMENTS = {
    "add_catalog": "CREATE CATALOG IF NOT EXISTS {path}[[ MANAGED LOCATION {'managedLocation}]][[ COMMENT {'comment}]]",
    "rename_catalog": "ALTER CATALOG {path} RENAME TO {`newName}",
    "update_catalog": "COMMENT ON CATALOG {path} IS {'comment}",
    "drop_catalog": "DROP CATALOG IF EXISTS {path} CASCADE",
    "add_schema": "CREATE SCHEMA IF NOT EXISTS {path}[[ MANAGED LOCATION {'managedLocation}]][[ COMMENT {'comment}]]",
    "rename_schema": "ALTER SCHEMA {path} RENAME TO {`newName}",
    "update_schema": "COMMENT ON SCHEMA {path} IS {'comment}",
    "drop_schema": "DROP SCHEMA IF EXISTS {path} CASCADE",
    "add_table": "CREATE TABLE IF NOT EXISTS {path} ()[[ USING {=format}]][[ LOCATION {'location}]][[ COMMENT {'comment}]]",
    "rename_table": "ALTER TABLE {path} RENAME TO {`newName}",
    "drop_table": "DROP TABLE IF EXISTS {path}",
    "set_table_comment": "COMMENT ON TABLE {path} IS {'comment}",
    "add_view": "CREATE VIEW IF NOT EXISTS {path}[[ COMMENT {'comment}]] AS {=definition}",
    "rename_view": "ALTER VIEW {path} RENAME TO {`newName}",
    "drop_view": "DROP VIEW IF EXISTS {path}",
    "update_view": "CREATE OR REPLACE VIEW {path}[[ COMMENT {'comment}]] AS {=definition}",
    "set_view_comment": "COMMENT ON VIEW {path} IS {'comment}",
    "add_volume": "CREATE [[{=volumeType} ]]VOLUME IF NOT EXISTS {path}[[ LOCATION {'location}]][[ COMMENT {'comment}]]",
    "rename_volume": "ALTER VOLUME {path} RENAME TO {`newName}",
    "update_volume": "COMMENT ON VOLUME {path} IS {'comment}",
    "drop_volume": "DROP VOLUME IF EXISTS {path}",
    "add_function": "CREATE FUNCTION IF NOT EXISTS {path}([[{=parameters}]])[[ RETURNS {=returnType}]][[ LANGUAGE {=language}]][[ COMMENT {'comment}]] RETURN {=body}",
    "rename_function": "ALTER FUNCTION {path} RENAME TO {`newName}",
    "update_function": "CREATE OR REPLACE FUNCTION {path}([[{=parameters}]])[[ RETURNS {=returnType}]][[ LANGUAGE {=language}]][[ COMMENT {'comment}]] RETURN {=body}",
    "drop_function": "DROP FUNCTION IF EXISTS {path}",
    "set_function_comment": "COMMENT ON FUNCTION {path} IS {'comment}",
    "add_materialized_view": "CREATE MATERIALIZED VIEW IF NOT EXISTS {path}[[ COMMENT {'comment}]][[ SCHEDULE {=schedule}]] AS {=definition}",
    "rename_materialized_view": "ALTER MATERIALIZED VIEW {path} RENAME TO {`newName}",
    "update_materialized_view": "CREATE OR REPLACE MATERIALIZED VIEW {path}[[ COMMENT {'comment}]][[ SCHEDULE {=schedule}]] AS {=definition}",
    "drop_materialized_view": "DROP MATERIALIZED VIEW IF EXISTS {path}",
    "set_materialized_view_comment": "COMMENT ON MATERIALIZED VIEW {path} IS {'comment}",
    "add_column": "ALTER TABLE {up} ADD COLUMN {last} {=type}[[ COMMENT {'comment}]]",
    "rename_column": "ALTER TABLE {up} RENAME COLUMN {last} TO {`newName}",
    "drop_column": "ALTER TABLE {up} DROP COLUMN {last}",
    "reorder_columns": "ALTER TABLE {path} ALTER COLUMN {`column} [[AFTER {`after}]][[{=first}]]",
    "change_column_type": "ALTER TABLE {up} ALTER COLUMN {last} TYPE {=newType}",
    "set_nullable": "ALTER TABLE {up} ALTER COLUMN {last} {?nullable|DROP NOT NULL|SET NOT NULL}",
    "set_column_comment": "ALTER TABLE {up} ALTER COLUMN {last} COMMENT {'comment}",
    "set_column_tag": "ALTER TABLE {up} ALTER COLUMN {last} SET TAGS ({'tagName} = {'tagValue})",
    "unset_column_tag": "ALTER TABLE {up} ALTER COLUMN {last} UNSET TAGS ({'tagName})",
    "add_constraint": "ALTER TABLE {path} ADD CONSTRAINT {`name}[[ CHECK ({=expression})]][[ {=type} KEY ({,columns})]][[ REFERENCES {`parentTable} ({,parentColumns})]]",
    "drop_constraint": "ALTER TABLE {path} DROP CONSTRAINT IF EXISTS {`name}",
    "add_row_filter": "ALTER TABLE {path} SET ROW FILTER {=udfExpression}",
    "update_row_filter": "ALTER TABLE {path} SET ROW FILTER {=udfExpression}",
    "remove_row_filter": "ALTER TABLE {path} DROP ROW FILTER",
    "add_column_mask": "ALTER TABLE {path} ALTER COLUMN {`column} SET MASK {=maskFunction}",
    "update_column_mask": "ALTER TABLE {path} ALTER COLUMN {`column} SET MASK {=maskFunction}",
    "remove_column_mask": "ALTER TABLE {path} ALTER COLUMN {`column} DROP MASK",
    "add_grant": "GRANT {*privileges} ON {=targetType} {path} TO {`principal}",
    "revoke_grant": "REVOKE [[{*privileges}]] ON {=targetType} {path} FROM {`principal}",
}
for _kind in ("table", "view"):
    STATEMENTS |= {
        f"set_{_kind}_property": f"ALTER {_kind.upper()} {{path}} SET TBLPROPERTIES ({{'key}} = {{'value}})",
        f"unset_{_kind}_property": f"ALTER {_kind.upper()} {{path}} UNSET TBLPROPERTIES IF EXISTS ({{'key}})",
        f"set_{_kind}_tag": f"ALTER {_kind.upper()} {{path}} SET TAGS ({{'tagName}} = {{'tagValue}})",
        f"unset_{_kind}_tag": f"ALTER {_kind.upper()} {{path}} UNSET TAGS ({{'tagName}})",
    }
assert set(STATEMENTS) == {kind for kind, *_ in FIELDS}


def template_of(op: Column) -> Column:
    """The statement of a kind; null where the kind is unknown."""
    return F.create_map(*[F.lit(v) for pair in STATEMENTS.items() for v in pair])[op]


def filled(template: Column, parts: Column, payload: Column) -> Column:
    """The statement with all its fields put in; null where a field that it needs is missing.

    ``parts`` is the object's name, ARRAY<STRING>, ``payload`` a MAP<STRING, STRING>, lists as JSON.
    Fields are filled side by side, so a value that looks like a field stays as it is.
    """

    def path(names):
        return F.array_join(F.transform(names, quoted), ".")

    def fill(part):
        name = F.substring(part, F.lit(3), F.length(part) - 3)
        value = payload[name]
        words = F.split(F.substring(part, F.lit(3), F.length(part) - 3), r"\|")
        names = F.from_json(value, "ARRAY<STRING>")
        return (
            F.when(~part.startswith("{"), part)
            .when(part == "{path}", path(parts))
            .when(part == "{up}", F.when(F.size(parts) > 1, path(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))))
            .when(part == "{last}", quoted(F.try_element_at(parts, F.lit(-1))))
            .when(part.startswith("{`"), F.when(value != "", quoted(value)))
            .when(part.startswith("{'"), text_literal(value))
            .when(part.startswith("{="), F.when(value != "", value))
            .when(part.startswith("{,"), F.when(F.size(names) > 0, F.array_join(F.transform(names, quoted), ", ")))
            .when(part.startswith("{*"), F.when(F.size(names) > 0, F.array_join(names, ", ")))
            .when(payload[F.get(words, F.lit(0))] == "true", F.get(words, F.lit(1)))
            .when(payload[F.get(words, F.lit(0))] == "false", F.get(words, F.lit(2)))
        )

    def joined(text):
        return F.aggregate(F.transform(F.regexp_extract_all(text, F.lit(r"\{[^}]*\}|[^{]+"), F.lit(0)), fill), F.lit(""), lambda a, p: F.concat(a, p))

    def piece(text):
        inside = joined(F.substring(text, F.lit(3), F.length(text) - 4))
        return F.when(text.startswith("[["), F.coalesce(inside, F.lit(""))).otherwise(joined(text))

    pieces = F.regexp_extract_all(template, F.lit(r"\[\[.*?\]\]|(?:(?!\[\[).)++"), F.lit(0))
    return F.aggregate(F.transform(pieces, piece), F.lit(""), lambda a, p: F.concat(a, p))
