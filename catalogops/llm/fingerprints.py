"""Winnowing fingerprints, in DataFrame functions alone.

A text's words (as in the other operators here) give one hash for every ``GRAM`` consecutive words;
of every ``WINDOW`` consecutive hashes the least is kept, the rightmost of equal ones, with its
position. So texts that share a passage of ``GRAM + WINDOW - 1`` words share a kept hash, and no
shared run shorter than ``GRAM`` words is ever seen. Fingerprints are alike by the Jaccard of their
distinct hashes.

Hash and position are one 64-bit number: 32 bits of hash, then the complement of the position, so
that a plain minimum takes the rightmost of equal hashes.

Nulls, ties, repeats: a null text is an empty one. A text with fewer words than a gram gives one
hash of all it has, a text with fewer hashes than a window one minimum; a text without words has an
empty fingerprint. Two empty fingerprints are alike (1), an empty and another are not (0). Rows that
repeat an id are all kept; as a neighbour the id stands for its least text. A null id comes after
all others. With one id only, the next document is the document itself. No rows give no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.registry import query, table
from catalogops.plans.durable import durable
from catalogops.plans.ordered import global_position

GRAM = 4
WINDOW = 8
#: Fixed value: what words are made of, after A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_POSITIONS = (1 << 32) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and deep it is used."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Words of a text; A-Z lower-cased."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD)
    return F.filter(parts, lambda w: w != "")


def gram_hashes(words: Column, size: int = GRAM) -> Column:
    """Hash of every ``size`` consecutive words with its position, as hash << 32 | complement of position."""

    def over(own: Column) -> Column:
        def at(i: Column) -> Column:
            hashed = F.xxhash64(F.slice(own, i + 1, F.lit(size)))
            return hashed.bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.lit(_POSITIONS) - i)

        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(own) - size, F.lit(0))), at)
        return F.when(F.size(own) > 0, grams).otherwise(F.array().cast("array<bigint>"))

    return let(words, over)


def winnowed(hashes: Column, window: int = WINDOW) -> Column:
    """The distinct minima of all windows, in order of position."""

    def over(own: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(own) - window, F.lit(0)) + 1)
        minima = F.transform(places, lambda i: F.array_min(F.slice(own, i, F.lit(window))))
        return F.when(F.size(own) > 0, F.array_distinct(minima)).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, over)


def fingerprint(text: Column) -> Column:
    """Kept hashes with their positions; see ``gram_hashes`` for how they share a number."""
    return winnowed(gram_hashes(words(text)))


def hash_set(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 32).cast("int")))


def position(kept: Column) -> Column:
    """Positions of kept hashes, words from 0."""
    return F.transform(kept, lambda x: F.lit(_POSITIONS) - x.bitwiseAND(F.lit(_POSITIONS)))


def shown(kept: Column) -> Column:
    """``hash:position`` in hexadecimal, comma-joined."""
    one = lambda x: F.concat(
        F.lower(F.hex(F.shiftrightunsigned(x, 32))), F.lit(":"), F.lower(F.hex(F.lit(_POSITIONS) - x.bitwiseAND(F.lit(_POSITIONS))))
    )
    return F.array_join(F.transform(kept, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of hashes."""

    def of(sizes: Column) -> Column:
        return F.when(sizes[1] == 0, F.lit(1.0)).otherwise(sizes[0] / sizes[1])

    return let(a, lambda x: let(b, lambda y: let(F.size(F.array_intersect(x, y)), lambda n: of(F.array(n, F.size(x) + F.size(y) - n)))))


def next_documents(documents: DataFrame) -> DataFrame:
    """(id, next_id) of every distinct id: the greatest smaller one; after the least, the greatest."""
    placed = durable(global_position(documents.select("id").distinct(), ["id"], "at"), "placed")
    greatest = placed.agg(F.max("at").alias("last"))
    asked = placed.crossJoin(F.broadcast(greatest)).select("id", F.when(F.col("at") == 1, F.col("last")).otherwise(F.col("at") - 1).alias("at"))
    return durable(asked.join(placed.select("at", F.col("id").alias("next_id")), "at").select("id", "next_id"), "next")


@query("op10_winnowing")
def op10_winnowing(spark, sf_dir):
    """Fingerprint of every document and of its edited text."""
    return edited(table(spark, sf_dir, "documents"))


def edited(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the text with its tail replaced, and how alike they are.

    The last half of the characters is replaced by the first as many of the next document.
    """
    none = F.lit(-(2**63))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    following = next_documents(rows)
    # How much of a text its neighbour needs is known before any text moves.
    need = rows.select("id", F.floor(F.length("text") / 2).alias("need")).groupBy("id").agg(F.max("need").alias("need"))
    wanted = durable(need.join(following, "id").select(F.col("id").alias("asker"), F.col("next_id").alias("id"), "need"), "wanted")
    # Both joins take the same (id, text) by id, so whole texts are shuffled once; fingerprints are made after it.
    heads = rows.join(wanted, "id").select(
        F.col("asker").alias("id"), F.struct(F.expr("substring(text, 1, int(need))").alias("head"), hash_set(fingerprint(F.col("text"))).alias("hashes")).alias("next")
    )
    heads = heads.groupBy("id").agg(F.min("next").alias("next"))
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    made = rows.join(heads, "id").withColumn(
        "edited", F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.substring(F.col("next.head"), F.lit(1), half))
    )
    doc_id = F.when(F.col("id") != none, F.col("id"))
    made = made.select(doc_id.alias("doc_id"), chars.cast("long").alias("n_chars"), "edited", fingerprint(F.col("text")).alias("kept"), F.col("next.hashes").alias("next"))
    made = made.withColumn("edited_kept", fingerprint(F.col("edited")))
    own = hash_set(F.col("kept"))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("kept")).alias("fingerprint"), shown(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(own, hash_set(F.col("edited_kept"))).alias("near_edited"), likeness(own, F.col("next")).alias("near_next"),
    )
