"""Casts that may fail, guarded so that values which cannot cast never raise inside a task."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = {"tinyint": 7, "smallint": 15, "int": 31, "integer": 31, "bigint": 63}
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def tried(value: Column, source: str, to: str) -> Column:
    """``try_cast`` to a type; null where it fails.

    A failed cast is an exception caught per value, which is slow on a column full of them, so
    values that plainly cannot become an integer are turned away by a cheap test first. The
    test lets through everything that can cast.
    """
    cast = value.try_cast(to)
    bits = BOUNDS.get(to.strip().lower())
    if bits is None:
        return cast
    if source == "string":
        return F.when(value.rlike("^[^A-Za-z]*[0-9][^A-Za-z]*$"), cast)
    if source.startswith(NUMBERS) and not (bits == 63 and source in BOUNDS):
        if source.startswith("decimal"):
            # In its own type: a double cannot tell the last values of a BIGINT apart.
            return F.when((value > F.lit(Decimal(-(2**bits) - 1))) & (value < F.lit(Decimal(2**bits))), cast)
        edge, number = float(2**bits), value.cast("double")
        return F.when(((number > -edge - 1) | (number == -edge)) & (number < edge), cast)
    return cast
