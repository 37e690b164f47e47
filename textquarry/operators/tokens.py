"""Corpus to items: the explode-like operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.enums import Scope
from textquarry.functions import tokenize
from textquarry.functions.uax29 import words_any_script


def tokens(corpus: DataFrame, scope: Scope, any_script: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row an item: ``token``, after the columns to ``keep``. Oversize items are left out, empty lines are items."""
    text = F.col("text")
    arr = words_of(text, any_script) if scope is Scope.WORD else tokenize.items(text, scope)
    # The outer form: for the inner one the optimizer adds a filter on the array, which cuts every text twice.
    # Its null for a text without items falls to the size guard.
    return corpus.select(*keep, F.explode_outer(arr).alias("token")).where(tokenize.within_size(F.col("token"), scope))


def words_of(text: Column, any_script: bool = False) -> Column:
    return words_any_script(text) if any_script else tokenize.words(text)


def with_line_words(items: DataFrame, any_script: bool = False) -> DataFrame:
    """Adds the words of each line and its first and last word in lower case."""
    w = F.col("words")
    return items.withColumn("words", words_of(F.col("token"), any_script)).withColumns(
        {"first_lc": F.lower(F.try_element_at(w, F.lit(1))), "last_lc": F.lower(F.try_element_at(w, F.lit(-1)))}
    )


def counted(items: DataFrame) -> DataFrame:
    """Distinct items with their multiplicity ``freq``; partial aggregation runs before the shuffle."""
    return items.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def item_bigrams(scope: Scope, any_script: bool = False) -> Column:
    """Distinct interior bigrams of ``token``: grapheme pairs joined for words, word pairs for lines."""
    if scope is Scope.WORD:
        grams = F.transform(tokenize.interior_pairs(F.col("token")), lambda g: F.array(g))
    else:
        grams = tokenize.interior_bigrams(words_of(F.col("token"), any_script))
    return F.array_distinct(grams)


def bigrams(items: DataFrame, scope: Scope, any_script: bool = False) -> DataFrame:
    """(token, gram) rows."""
    return items.select("token", F.explode_outer(item_bigrams(scope, any_script)).alias("gram")).where(F.col("gram").isNotNull())


def bigram_counts(items: DataFrame, scope: Scope) -> DataFrame:
    """(gram, n_items) of distinct items. Items stay where they are: only their grams are shuffled, as partial counts."""
    grams = items.select(F.explode_outer(item_bigrams(scope)).alias("gram")).where(F.col("gram").isNotNull())
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_items"))
