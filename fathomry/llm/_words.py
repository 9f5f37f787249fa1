"""Words of a text, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII other than letters and digits; beyond ASCII everything belongs to a word.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same words as a class of what belongs to them, which regular expressions find ten times as fast.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does that at once where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words in order; null for null."""
    return F.array_remove(F.split(lower_ascii(text), GAP), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
