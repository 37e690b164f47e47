"""The three closed choices of a query: what an item is, how it must match, and how strict the terms are."""

from __future__ import annotations

from enum import Enum


class Scope(str, Enum):
    WORD = "word"
    LINE = "line"

    @property
    def max_bytes(self) -> int:
        """Items longer than this are not indexed (UTF-8 bytes)."""
        return 255 if self is Scope.WORD else 32768


class SearchType(str, Enum):
    PREFIX = "prefix"
    SUFFIX = "suffix"
    CONTAINS = "contains"

    @property
    def index_name(self) -> str:
        return {"prefix": "trie", "suffix": "suffix", "contains": "ngram"}[self.value]


class Mode(str, Enum):
    #: The surveyed behaviour: terms of [a-z ] for prefix and suffix, two bytes or two parts at most for contains.
    COMPAT = "compat"
    #: The same predicates for any term of any length.
    EXTENDED = "extended"
