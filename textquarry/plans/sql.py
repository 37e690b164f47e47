"""The search as a table function of Spark SQL.

``register`` puts the six indexes under temporary views and makes ``text_search(scope, type, term)``: priority, token, freq of all
matches, unranked. A call is opened into the query around it: branches of other scopes and types fall away, the term, a literal
or a bound parameter, reaches the scan, and ORDER BY and LIMIT become a top-k::

    spark.sql("SELECT * FROM text_search('word', 'prefix', :term) ORDER BY priority, token LIMIT 100", args={"term": "me"})

Terms are taken as in extended mode; items that begin or end with the term are no contains matches, as everywhere.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from textquarry.enums import Scope, SearchType
from textquarry.functions.scoring import SCORE_MODULUS
from textquarry.operators.tokens import with_line_words

NAME = "text_search"


def _test(scope: Scope, kind: SearchType) -> str:
    term = f"{NAME}.term"
    if kind is SearchType.PREFIX:
        test = f"startswith(token, {term}) AND token <> {term}"
        return test if scope is Scope.WORD else f"{test} AND first_lc = lower({term})"
    if kind is SearchType.SUFFIX:
        test = f"startswith(token_rev, reverse({term})) AND token <> {term}"
        return test if scope is Scope.WORD else f"{test} AND last_lc = lower({term})"
    test = f"{term} <> '' AND contains(token, {term}) AND NOT startswith(token, {term}) AND NOT endswith(token, {term})"
    if scope is Scope.WORD:
        return test
    # The words after the first, each between blanks: no word holds one, so neighbours equal to the term's parts are found as text.
    inner = "concat(' ', array_join(slice(words, 2, greatest(size(words) - 1, 0)), ' '), ' ')"
    return f"{test} AND size(words) >= 3 AND first_lc <> lower({term}) AND last_lc <> lower({term}) AND contains({inner}, concat(' ', {term}, ' '))"


def register(spark: SparkSession, indexes: Mapping, prefix: str = "text_index") -> None:
    """Makes the function over indexes of ``load_index``; those that are missing have no match."""
    branches = []
    for (scope, kind), index in indexes.items():
        view = f"{prefix}_{scope.value}_{kind.value}"
        if scope is Scope.LINE and "words" not in index.columns:
            index = with_line_words(index, getattr(indexes, "any_script", False))
        index.createOrReplaceTempView(view)
        freq = "CAST(1 AS BIGINT)" if kind is SearchType.CONTAINS else "freq"
        branches.append(
            f"SELECT CAST((char_length(token) - char_length({NAME}.term)) % {SCORE_MODULUS} AS INT), token, {freq} FROM {view} "
            f"WHERE {NAME}.scope = '{scope.value}' AND {NAME}.type = '{kind.value}' AND {_test(scope, kind)}"
        )
    body = " UNION ALL ".join(branches) or "SELECT 0, '', CAST(0 AS BIGINT) WHERE false"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {NAME}(scope STRING, type STRING, term STRING) RETURNS TABLE(priority INT, token STRING, freq BIGINT) RETURN {body}")
