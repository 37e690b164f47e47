"""Prefix, suffix and interior search over words and lines, as filters and a top-k.

A query is one DataFrame: predicate, score, order, limit. Catalyst turns the last two into
``TakeOrderedAndProject``, so no full sort happens, and pushes the prefix test into the Parquet scan.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.enums import Mode, Scope, SearchType
from textquarry.functions import tokenize
from textquarry.functions.scoring import priority
from textquarry.operators.tokens import counted, tokens, with_line_words, words_of

log = logging.getLogger(__name__)
TOP_K = 100
_COMPAT_TERM = re.compile(r"[a-z ]*\Z")


def validate(scope: Scope, kind: SearchType, term: str, mode: Mode) -> None:
    if term is None:
        raise ValueError("a term is needed")
    if mode is Mode.COMPAT and kind is not SearchType.CONTAINS and not _COMPAT_TERM.match(term):
        raise ValueError(f"{kind.value} terms hold only a-z and space in compat mode: {term!r}")


def _interior(term: str) -> Column:
    token = F.col("token")
    return token.contains(term) & ~token.startswith(term) & ~token.endswith(term)


def _grapheme_hit(term: str) -> Column:
    """Some interior pair of graphemes equals a two-byte term, or holds a one-byte term."""
    token = F.col("token")
    grams = F.transform(tokenize.interior_bigrams(tokenize.graphemes(token)), lambda g: F.array_join(g, ""))
    hit = F.array_contains(grams, term) if len(term.encode()) == 2 else F.exists(grams, lambda g: g.contains(term))
    # Without marks or joiners a grapheme is a character, and the plain predicate says the same.
    return ~token.rlike(tokenize.JOINING) | hit


def _line_gram_hit(w: Column, term: str, extended: bool) -> Column:
    """A word, or a pair of neighbouring words, past the first word equals the term."""
    parts = term.split()
    n = F.size(w)
    if len(parts) < 2:
        return (n >= 3) & F.array_contains(F.slice(w, 2, F.greatest(n - 1, F.lit(0))), term)
    if len(parts) == 2 or extended:
        k = len(parts)
        starts = F.when(n >= k + 1, F.sequence(F.lit(1), n - k)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]) == term)
    return F.lit(False)


def _plain_test(kind: SearchType, term: str) -> Column:
    """The part of a test that reads the token alone."""
    token = F.col("token")
    if kind is SearchType.PREFIX:
        return token.startswith(term) & (token != term)
    if kind is SearchType.SUFFIX:
        return token.endswith(term) & (token != term)
    return F.lit(False) if term == "" else _interior(term)


def _line_test(kind: SearchType, term: str, mode: Mode, w: Column, first_lc: Column, last_lc: Column) -> Column:
    """The part of a line's test that reads its words."""
    lc = term.lower()
    if kind is SearchType.PREFIX:
        return first_lc == lc
    if kind is SearchType.SUFFIX:
        return last_lc == lc
    return (first_lc != lc) & (last_lc != lc) & _line_gram_hit(w, term, mode is Mode.EXTENDED)


def _word_test(kind: SearchType, term: str, mode: Mode) -> Column:
    if kind is not SearchType.CONTAINS or mode is Mode.EXTENDED or term == "":
        return F.lit(True)
    n = len(term.encode())
    if n > 2 or (n == 2 and len(term) == 1):
        return F.lit(False)
    return _grapheme_hit(term)


def predicate(scope: Scope, kind: SearchType, term: str, mode: Mode = Mode.COMPAT, any_script: bool = False, stored: bool = True) -> Column:
    """The test of an item in column ``token``; ``stored``: a line's words are in ``words, first_lc, last_lc``."""
    validate(scope, kind, term, mode)
    test = _plain_test(kind, term)
    if scope is Scope.WORD:
        return test & _word_test(kind, term, mode)
    if stored:
        return test & _line_test(kind, term, mode, F.col("words"), F.col("first_lc"), F.col("last_lc"))

    def on(w: Column) -> Column:
        return _line_test(kind, term, mode, w, F.lower(F.try_element_at(w, F.lit(1))), F.lower(F.try_element_at(w, F.lit(-1))))

    # A line is cut once, and only if it passes the test of the token, which stands alone too so that it can reach a scan.
    return test & F.when(test, tokenize.bind(words_of(F.col("token"), any_script), on)).otherwise(F.lit(False))


def prepare(corpus: DataFrame, scope: Scope, any_script: bool = False) -> DataFrame:
    """Items of a corpus with every column that ``predicate`` reads."""
    items = tokens(corpus, scope, any_script)
    return with_line_words(items, any_script) if scope is Scope.LINE else items


def matches(
    source: DataFrame | Mapping, scope: Scope, kind: SearchType, term: str, mode: Mode = Mode.COMPAT, any_script: bool = False
) -> DataFrame:
    """All matches, unranked: (token, freq). Prefix and suffix keep multiplicity, contains is a set.

    ``source``: a corpus (column ``text``), or the indexes of ``load_index``; one that is missing there has no match.
    ``any_script``: full word boundaries for Han, kana, Thai and the like; an index has those it was built with.
    """
    scope, kind, mode = Scope(scope), SearchType(kind), Mode(mode)
    stored = isinstance(source, Mapping)
    indexed = source.get((scope, kind)) if stored else None
    # Indexes of a store hold lines without their words; single ones hold both.
    test = predicate(scope, kind, term, mode, any_script or getattr(source, "any_script", False), indexed is not None and "words" in indexed.columns)
    log.debug("search %s %s %r in %s", scope.value, kind.value, term, "the index of " + kind.index_name if stored else "a corpus")
    if stored:
        if indexed is None:
            log.warning("no index for %s, %s", scope.value, kind.value)
            return SparkSession.active().createDataFrame([], "token string, freq long")
        if kind is SearchType.SUFFIX:
            # Sorted by the reversed token: this is what min/max statistics can prune.
            test = F.col("token_rev").startswith(term[::-1]) & test
        found = indexed.where(test)
    else:
        # The optimizer tests items before they are counted: repeats that don't match are never shuffled.
        found = counted(tokens(source, scope, any_script)).where(test)
    if kind is SearchType.CONTAINS:
        # Tokens are distinct: a corpus is counted, and so are the segments of an index when it is loaded.
        return found.select("token", F.lit(1).cast("long").alias("freq"))
    return found.select("token", "freq")


def search(
    source: DataFrame | Mapping,
    scope: Scope,
    kind: SearchType,
    term: str,
    mode: Mode = Mode.COMPAT,
    k: int = TOP_K,
    any_script: bool = False,
) -> DataFrame:
    """The best ``k`` matches: (priority, token), ordered by both.

    Distinct tokens are ranked first; only the best k of them can reach the result, and each is
    repeated at most k times, so duplicates never cost more than k squared rows.
    """
    return rank(matches(source, scope, kind, term, mode, any_script), term, k)


def rank(found: DataFrame, term: str, k: int = TOP_K) -> DataFrame:
    """The best ``k`` of matches (token, freq)."""
    ranked = found.select(priority(F.col("token"), term).alias("priority"), "token", "freq")
    best = ranked.orderBy("priority", "token").limit(k)
    copies = F.explode(F.sequence(F.lit(1), F.least("freq", F.lit(k)).cast("int")))
    return best.select("priority", "token", copies.alias("copy")).orderBy("priority", "token").limit(k).select("priority", "token")


def count_searches(source: DataFrame, searches: list[tuple[Scope, SearchType, str]], mode: Mode = Mode.COMPAT, any_script: bool = False) -> DataFrame:
    """scope, type, term, n_matches of many searches of a corpus: texts are cut once a scope, and all its tests are sums of one aggregation."""
    rows = None
    for scope in Scope:
        own = [(SearchType(k), t) for s, k, t in searches if Scope(s) is scope]
        if not own:
            continue
        items = counted(tokens(source, scope, any_script))
        # Only items that pass some test's plain part have their words cut.
        if scope is Scope.LINE:
            items = with_line_words(items.where(reduce(or_, [_plain_test(k, t) for k, t in own])), any_script)
        hits = [F.when(predicate(scope, k, t, mode, any_script), F.lit(1).cast("long") if k is SearchType.CONTAINS else F.col("freq")) for k, t in own]
        sums = items.agg(*[F.coalesce(F.sum(h), F.lit(0)).cast("long").alias(f"n{i}") for i, h in enumerate(hits)])
        each = F.array(*[F.struct(F.lit(k.value).alias("type"), F.lit(t).alias("term"), F.col(f"n{i}").alias("n_matches")) for i, (k, t) in enumerate(own)])
        some = sums.select(F.lit(scope.value).alias("scope"), F.explode(each).alias("x")).select("scope", "x.*")
        rows = some if rows is None else rows.unionByName(some)
    return rows


def count_matches(source: DataFrame | Mapping, scope: Scope, kind: SearchType, term: str, mode: Mode = Mode.COMPAT, any_script: bool = False) -> DataFrame:
    """The number of matches before the cut to k, as one row: ``n_matches``."""
    return matches(source, scope, kind, term, mode, any_script).agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("long").alias("n_matches"))
