"""Large sets of SQL scripts as rows of statements and columns, by flat tokens over whole texts.

Comments, literals and names in back-ticks are one token each, so nothing inside them cuts a
statement; column lists are cut by a running stack of open brackets, to any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogops.functions.sqltext import COMMENT, LITERAL, PATH, TICKED, plain_name
from catalogops.plans.skew import dealt

MARK = "\u0001"

# Tokens of a script and of a column list; statement kinds by their first words.
SCRIPT_TOKEN = rf"""{COMMENT}|{LITERAL}|{TICKED}|;|[^;'"`/-]++|[`/-]"""
LIST_TOKEN = rf"""{LITERAL}|{TICKED}|\s*\(|(?i:\b(?:ARRAY|MAP|STRUCT)\s*<)|[)>,]|\s++(?!\()|[^\s'"`(),>\w]|\w++|`"""
KINDS = """
create_catalog | ^CREATE\\s+CATALOG\\b
create_schema | ^CREATE\\s+(SCHEMA|DATABASE)\\b
create_table | ^CREATE\\s+(OR\\s+REPLACE\\s+)?(EXTERNAL\\s+)?TABLE\\b
create_materialized_view | ^CREATE\\s+(OR\\s+REPLACE\\s+)?MATERIALIZED\\s+VIEW\\b
create_view | ^CREATE\\s+(OR\\s+REPLACE\\s+)?(TEMPORARY\\s+)?VIEW\\b
create_volume | ^CREATE\\s+(EXTERNAL\\s+)?VOLUME\\b
create_function | ^CREATE\\s+(OR\\s+REPLACE\\s+)?FUNCTION\\b
comment_on | ^COMMENT\\s+ON\\b
alter | ^ALTER\\b
"""
NAME = rf"(?is)^(?:CREATE|ALTER|COMMENT\s+ON)\s+(?:OR\s+REPLACE\s+)?(?:EXTERNAL\s+|MATERIALIZED\s+|TEMPORARY\s+)?\w+\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?({PATH})"


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(script_id, script): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("script_id"), F.col("value").alias("script"))


def _whole(text: Column) -> Column:
    """Whether every literal, back-tick and block comment of a text is closed."""
    marks = F.filter(F.regexp_extract_all(text, F.lit(SCRIPT_TOKEN), F.lit(0)), lambda t: t.rlike(r"""^(?:['"`]|/\*)"""))
    last = F.try_element_at(marks, F.lit(-1))
    closed = F.when(last.startswith("/*"), last.endswith("*/") & (F.length(last) > 3)).otherwise(
        (F.length(last) > 1) & (F.left(last, F.lit(1)) == F.right(last, F.lit(1))) & ~last.rlike(r"[^\\](?:\\\\)*+\\.$")
    )
    return F.coalesce(closed, F.lit(True))


def statements(scripts: DataFrame) -> DataFrame:
    """(script_id, idx, statement, kind, name, status): split at ';' outside literals, back-ticks and
    comments; comments are left out.

    ``status`` is created, changed, skipped (a kind that is not read) or error: a known kind without a
    name, or a statement that ends inside a literal, back-tick or comment. A null or empty script has none.
    """
    parts = F.regexp_extract_all("script", F.lit(SCRIPT_TOKEN), F.lit(0))
    # An open block comment stays, as a statement of its own that is an error.
    kept = F.transform(
        parts,
        lambda t: F.when(t == ";", MARK).when(t.startswith("--"), "").when(t.startswith("/*") & t.endswith("*/") & (F.length(t) > 3), " ")
        .when(t.startswith("/*"), F.concat(F.lit(MARK), t)).otherwise(t),
    )
    cut = F.transform(F.split(F.array_join(kept, ""), MARK), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    # Dealt anew: a file of scripts that one task reads would otherwise be one task's to cut.
    rows = dealt(scripts.select("script_id", "script"), "script_id", "script").select("script_id", F.posexplode(F.filter(cut, lambda t: t != "")).alias("idx", "statement"))
    kind = F.lit("unsupported")
    for line in reversed(KINDS.strip().splitlines()):
        name, pattern = (p.strip() for p in line.split("|", 1))
        kind = F.when(F.col("statement").rlike("(?i)" + pattern), name).otherwise(kind)
    found = plain_name(F.regexp_extract("statement", NAME, 1))
    named = rows.withColumn("kind", kind).withColumn("name", F.when((F.col("kind") != "unsupported") & (found != ""), found))
    status = (
        F.when(~_whole(F.col("statement")), "error")
        .when(F.col("kind") == "unsupported", "skipped")
        .when(F.col("name").isNull(), "error")
        .when(F.col("kind").startswith("create_"), "created")
        .otherwise("changed")
    )
    return named.withColumn("status", status)


def scan_report(rows: DataFrame) -> DataFrame:
    """(kind, statements, created, skipped, errors) over all scripts."""
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("statements"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("created", "created"), ("skipped", "skipped"), ("error", "errors"))],
    )


def _definitions(statement: Column) -> Column:
    """The words of each definition in a statement's first bracketed list, ARRAY<ARRAY<STRING>>.

    ``stack`` holds one letter per open bracket, r for round and a for angle; a '>' closes only an
    angle. Commas cut and blanks part words where just the list itself is open.
    """
    start = F.struct(F.lit("").alias("stack"), F.lit("").alias("text"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("done"))

    def state(stack, text, done):
        return F.struct(stack.alias("stack"), text.alias("text"), done.alias("done"))

    def step(acc, t):
        stack, text, done = acc["stack"], acc["text"], acc["done"]
        grown = F.concat(text, t)
        up = F.substring(stack, F.lit(1), F.length(stack) - 1)
        opens = F.when(t.endswith("(") & ~t.rlike("^['\"`]"), "r").when(t.endswith("<") & (F.length(t) > 1) & ~t.rlike("^['\"`]"), "a")
        closes = ((t == ")") & stack.endswith("r")) | ((t == ">") & stack.endswith("a"))
        return (
            F.when(stack == "x", acc)
            .when(stack == "", F.when(opens == "r", state(F.lit("r"), F.lit(""), done)).otherwise(acc))
            .when(opens.isNotNull(), state(F.concat(stack, opens), F.concat(text, F.when(opens == "r", "(").otherwise(t)), done))
            .when(closes & (stack == "r"), state(F.lit("x"), F.lit(""), F.concat(done, F.array(text))))
            .when(closes, state(up, grown, done))
            .when((stack == "r") & (t == ","), state(stack, F.lit(""), F.concat(done, F.array(text))))
            .when((stack == "r") & t.rlike(r"^\s"), state(stack, F.concat(text, F.lit(MARK)), done))
            .otherwise(state(stack, grown, done))
        )

    done = F.aggregate(F.regexp_extract_all(statement, F.lit(LIST_TOKEN), F.lit(0)), start, step, lambda acc: acc["done"])
    return F.filter(F.transform(done, lambda d: F.filter(F.split(d, MARK), lambda w: w != "")), lambda w: F.size(w) > 0)


def columns_from_ddl(rows: DataFrame) -> DataFrame:
    """(table_name, column, type, nullable, comment, position) from CREATE TABLE statements.

    Types of any depth; a comment keeps its quotes' inside, with doubled quotes as one.
    """
    made = F.col("statement").rlike(NAME + r"\s*\(") & (F.col("kind") == "create_table") & (F.col("status") == "created")
    each = rows.where(made).select(F.col("name").alias("table_name"), F.posexplode(_definitions(F.col("statement"))).alias("position", "w"))
    # Literals are blanked, so that only words of the definition itself count.
    bare = F.transform("w", lambda x: F.when(x.rlike("^['\"]"), "''").otherwise(F.upper(x)))
    each = each.withColumns({"rule": F.array_join(bare, " "), "said": F.get("w", F.array_position(bare, "COMMENT").cast("int"))})
    each = each.where(~F.col("rule").rlike(r"^(CONSTRAINT \S+ (PRIMARY|FOREIGN|CHECK|UNIQUE)|PRIMARY KEY|FOREIGN KEY|CHECK\(|UNIQUE\()"))
    inside = F.replace(F.expr("substring(said, 2, length(said) - 2)"), F.lit("''"), F.lit("'"))
    return each.select(
        "table_name", F.regexp_replace(F.element_at("w", 1), "^`|`$", "").alias("column"), F.get("w", F.lit(1)).alias("type"),
        (~F.col("rule").rlike(r"\bNOT NULL\b")).alias("nullable"),
        F.when(F.col("rule").rlike(r"\bCOMMENT ''"), inside).alias("comment"), "position",
    )
