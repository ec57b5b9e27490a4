"""Terms of whole texts, counted in the row that holds the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between runs of ASCII letters and signs beyond ASCII; the second leaves digits to the runs.
NO_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
NO_LETTERS_OR_DIGITS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """The text with A-Z alone lower-cased; lower() is that, and faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def terms_of(text: Column, between: str) -> Column:
    """The terms of a text in order, with repeats; none of a null text.  Splitting takes an eighth of
    the time of extracting each match."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), between), "")


def count_terms(rows: DataFrame, text_col: str, between: str) -> DataFrame:
    """rows without the text, but with ``n``, its number of terms, and ``terms``, an array of
    (term, tf), each different term once.

    Equal terms are runs of the sorted array, so counting stays in the row: nothing is shuffled, and
    a text of a million words costs what sorting them costs.  Take the array apart with inline_outer:
    of inline Spark derives a filter on the array's size, which sorts the text once more for each term.
    """
    others = [c for c in rows.columns if c != text_col]
    listed = rows.select(*others, F.sort_array(terms_of(F.col(text_col), between)).alias("listed"))
    starts = "filter(if(size(listed) = 0, array(), sequence(0, size(listed) - 1)), i -> i = 0 or listed[i] <> listed[i - 1])"
    runs = listed.select(*others, "listed", F.expr(starts).alias("starts"))
    counted = "transform(starts, (at, j) -> named_struct('term', listed[at], 'tf', cast(coalesce(get(starts, j + 1), size(listed)) - at as bigint)))"
    return runs.select(*others, F.size("listed").cast("long").alias("n"), F.expr(counted).alias("terms"))
