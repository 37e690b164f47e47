"""Ranking of matches and their presentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The score is kept in one unsigned byte, so distances wrap.
SCORE_MODULUS = 256


def edit_distance(token: Column, term: str) -> Column:
    """Levenshtein distance for a token that contains the term.

    The length difference is a lower bound, and inserting the missing characters reaches it, so no
    dynamic programme is needed.
    """
    return F.char_length(token) - F.lit(len(term))


def priority(token: Column, term: str) -> Column:
    return (edit_distance(token, term) % SCORE_MODULUS).cast("int")


def highlight(token: Column, term: str) -> Column:
    """The token cut around the first case-insensitive hit: STRUCT<pre, hit, post>."""
    at = F.locate(term.lower(), F.lower(token))
    n = len(term)
    found = F.struct(
        F.substring(token, F.lit(1), at - 1).alias("pre"),
        F.substring(token, at, F.lit(n)).alias("hit"),
        F.substring(token, at + n, F.char_length(token)).alias("post"),
    )
    missing = F.struct(token.alias("pre"), F.lit("").alias("hit"), F.lit("").alias("post"))
    return F.when(at > 0, found).otherwise(missing)


def rank_label() -> Column:
    """``#n -> `` over a ranked result, which holds at most k rows, so one window partition is bounded."""
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("priority", "token"))
    return F.format_string("#%d -> ", n)
