"""License scan by diagonal voting, in DataFrame functions alone.

Templates are license phrases and notices as word sequences. Every ``GRAM`` consecutive words of a
text are hashed and joined to the templates' positions of the same hash; a match votes for the
diagonal, text position minus template position. Votes are counted by diagonal; neighbouring
diagonals (at most ``DRIFT`` apart, as after an inserted or missing word) of one template whose
spans lie together are merged, and a span is verified: its words must be those of the template in
enough places. A phrase with all its words consecutive is a span on a single diagonal.

With two-word grams the first and last word of a match are the gram, so comparing both verifies
each vote literally; hashes only route the join. The templates' grams are a fixed small table, the
one side that is broadcast.

Nulls, ties, repeats: a null or empty text has no words, no labels and score 0. Rows that repeat id
and text are scanned as one and all returned. A null id is an id like any other. Spans of equal
strength all count. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.llm.fingerprints import let, words
from catalogops.llm.registry import query, table

GRAM = 2
DRIFT = 3
#: Share of a notice's grams that must be matched for its label.
VERIFIED = 0.7


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False


#: Phrases that the base labels stand for.
PHRASES = (
    Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True),
)
#: Wording of well-known notices; each gives its label where most of it is found.
NOTICES = (
    Template("mit-notice", "released under the mit license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-notice", "licensed under the apache license version 2 0"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "creative commons attribution license"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "subject to the terms of the mozilla public license"),
    Template("all-rights", "all rights reserved"),
)


def template_grams(spark, templates: tuple[Template, ...]) -> DataFrame:
    """hash, first, last, template, t_pos, t_grams, and one row with hash null to match every text once."""
    rows = []
    for template in templates:
        own = template.text.split()
        rows += [(own[i], own[i + GRAM - 1], own[i : i + GRAM], template.text, i, len(own) - GRAM + 1) for i in range(len(own) - GRAM + 1)]
    frame = spark.createDataFrame(rows, "first string, last string, gram array<string>, template string, t_pos int, t_grams int")
    return frame.select(F.xxhash64("gram").alias("hash"), "first", "last", "template", "t_pos", "t_grams")


def word_grams(own: Column) -> Column:
    """Array of (hash, first, last, pos) of every ``GRAM`` consecutive words."""

    def over(own: Column) -> Column:
        def gram(i: Column) -> Column:
            return let(
                F.slice(own, i + 1, F.lit(GRAM)),
                lambda g: F.struct(F.xxhash64(g).alias("hash"), g[0].alias("first"), g[GRAM - 1].alias("last"), i.alias("pos")),
            )

        none = F.array().cast("array<struct<hash:bigint,first:string,last:string,pos:int>>")
        return F.when(F.size(own) >= GRAM, F.transform(F.sequence(F.lit(0), F.greatest(F.size(own) - GRAM, F.lit(0))), gram)).otherwise(none)

    return let(own, over)


def scan(documents: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """doc_id, n_words, spans: array of (label, base, first, last, coverage) per row, in order of place."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_key"), words(F.col("text")).alias("words"))
    # One entry more stands for the text itself, so that a text without a match is not lost.
    itself = F.struct(F.xxhash64(F.array(F.lit(""))).alias("hash"), F.lit("").alias("first"), F.lit("").alias("last"), F.lit(-1).alias("pos"))
    exploded = texts.select("doc_id", "text_key", F.size("words").alias("n_words"), F.explode(F.concat(F.array(itself), word_grams(F.col("words")))).alias("g"))
    exploded = exploded.select("doc_id", "text_key", "n_words", "g.*")
    known = template_grams(spark, templates).union(
        spark.range(1).select(F.xxhash64(F.array(F.lit(""))), F.lit(""), F.lit(""), F.lit(""), F.lit(0), F.lit(0))
    )
    # The templates' grams are a few hundred rows, whatever the input.
    votes = exploded.join(F.broadcast(known), ["hash", "first", "last"])
    diagonals = votes.groupBy("doc_id", "text_key", "n_words", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.first("t_grams").alias("t_grams"), F.sort_array(F.collect_set("t_pos")).alias("hits"),
        F.count(F.when(F.col("template") == "", 1)).alias("rows"),
    )
    own = ["doc_id", "text_key", "template"]
    # Neighbouring diagonals of a template in one text: a run goes on while the next is close by.
    row = Window.partitionBy(*own).orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(row) > DRIFT, F.lit(True)) | F.col("whole") | F.coalesce(F.lag("whole").over(row), F.lit(False))
    placed = diagonals.withColumn("whole", F.size("hits") == F.col("t_grams")).withColumn("new", gap.cast("int")).withColumn("run", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = placed.groupBy(*own, "n_words", "run").agg(
        F.first("t_grams").alias("t_grams"), F.max("rows").alias("rows"), F.max("whole").alias("whole"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.min(F.col("diagonal") + F.element_at("hits", 1)).alias("first"), F.max(F.col("diagonal") + F.element_at("hits", -1) + (GRAM - 1)).alias("last"),
    )
    facts = spark.createDataFrame([(t.text, t.label, t.base) for t in templates], "template string, label string, base boolean")
    coverage = F.size("hits") / F.col("t_grams")
    spans = merged.join(F.broadcast(facts), "template", "left").withColumn("coverage", F.when(F.col("template") != "", coverage))
    kept = (F.col("template") != "") & F.when(F.col("base"), F.col("whole")).otherwise(F.col("coverage") >= VERIFIED)
    span = F.when(kept, F.struct("first", "last", "label", "base", "coverage"))
    found = spans.groupBy("doc_id", "text_key", "n_words").agg(F.max("rows").alias("rows"), F.sort_array(F.collect_list(span)).alias("spans"))
    # Repeated rows were counted once and come back as often.
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "spans", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_")).drop("_")


def digests(found: DataFrame) -> DataFrame:
    """Counts, places and labels of each scanned row."""
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


@query("op8_license_diagonals")
def op8_license_diagonals(spark, sf_dir):
    """Places and labels of license wording in every document."""
    return digests(scan(table(spark, sf_dir, "documents")))
