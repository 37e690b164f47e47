"""Spark-native text search: tokenise, index and query text with DataFrame operators."""

from textquarry.enums import Scope, SearchType, Mode
from textquarry.operators.search import search
from textquarry.plans.index import append_index, build_all, build_index, load_index

__all__ = ["Scope", "SearchType", "Mode", "search", "build_index", "build_all", "load_index", "append_index"]
