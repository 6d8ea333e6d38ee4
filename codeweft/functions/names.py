"""Names of classes, tables and files as columns; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def class_name(c: Column) -> Column:
    """A class name as written, without outer blanks and a leading separator; null when nothing is left."""
    bare = trimmed(c)
    bare = F.when(bare.startswith("\\"), trimmed(F.substr(bare, F.lit(2)))).otherwise(bare)
    return F.when(bare != "", bare)


def class_key(c: Column) -> Column:
    """A class name as PHP compares it: ASCII letters without case."""
    return ascii_lower(class_name(c))


def table_key(c: Column) -> Column:
    """A table name without quotes, blanks, schema prefix and letter case; null when nothing is left."""
    bare = trimmed(F.translate(c, "`\"'[]", ""))
    last = F.lower(trimmed(F.substring_index(bare, ".", -1)))
    return F.when(last != "", last)
