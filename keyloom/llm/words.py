"""Words of a text as native columns: ASCII letters lower-cased, cut at ASCII characters that are neither letters nor digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: str | Column) -> Column:
    """`` w1  w2  w3 ``: one space around, two between, so that phrases can't share a space; blank if there is no word.

    ``lower`` also changes letters outside ASCII; these are word characters before and
    after, so words are cut at the same places.
    """
    inner = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), CUT, "  "))
    return F.when(F.octet_length(inner) > 0, F.concat(F.lit(" "), inner, F.lit(" "))).otherwise(F.lit(""))


def count_words(s: Column) -> Column:
    """Words of a ``spaced`` string or of a part of one cut at phrases."""
    return F.when(F.octet_length(s) > 0, F.octet_length(s) - F.octet_length(F.replace(s, F.lit("  "), F.lit(" "))) + 1).otherwise(0).cast("long")


def word_array(s: Column) -> Column:
    """The words of a ``spaced`` string; none for a blank one."""
    return F.when(F.octet_length(s) > 0, F.split(F.trim(s), "  ")).otherwise(F.array().cast("array<string>"))
