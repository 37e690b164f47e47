"""Column expressions that cut text into words, lines, graphemes and bigrams.

All of them are built-in functions, so a scan stays in the JVM. Words follow UAX #29: a piece between
boundaries that holds a letter or digit. The separator pattern has no repetition, so Java's regex
engine needs constant stack however long a token is. Scripts that need dictionary or per-character
rules (Han, kana, Thai, Hebrew quotes, flags) are served by ``textquarry.functions.uax29``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.enums import Scope

#: Characters that join two letters (MidLetter, MidNumLet, Single_Quote of UAX #29).
MID_LETTER = r":.'\x{B7}\x{2018}\x{2019}\x{2024}\x{2027}"
#: Characters that join two digits (MidNum, MidNumLet, Single_Quote).
MID_NUMBER = r",;.'\x{2018}\x{2019}\x{2024}"

#: One separator character: not part of a word, and not a joiner between two letters or two digits. The class comes first: most
#: characters fail there, and only the others are looked at with their neighbours.
WORD_SEPARATOR = (
    r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
    rf"(?<![\p{{L}}\p{{M}}][{MID_LETTER}](?=\p{{L}}))(?<!\p{{Nd}}[{MID_NUMBER}](?=\p{{Nd}}))"
)
HAS_ALNUM = r"[\p{L}\p{N}]"
#: What a token holds if some of its graphemes may have more than one character.
JOINING = r"[\p{M}\p{Cf}\p{So}\p{Sk}\p{IsHangul}]"


def words(text: Column) -> Column:
    """UAX #29 words, in order; null text gives null."""
    return F.filter(F.split(text, WORD_SEPARATOR), lambda w: (w != "") & w.rlike(HAS_ALNUM))


def lines(text: Column) -> Column:
    """Pieces between line feeds; one carriage return before each feed goes, and so does an empty last piece."""
    unix = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(unix, "\n"))


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(text, F.lit(r"(\X)"), 1)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, even where ``use`` reads it inside a lambda.

    The optimizer would otherwise spell the value out at every place, and compute it for each element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def interior_bigrams(units: Column) -> Column:
    """Pairs of neighbours from the second unit on. Items of fewer than three units have none."""

    def pairs(u: Column) -> Column:
        some = F.transform(F.sequence(F.lit(2), F.size(u) - 1), lambda i: F.array(F.get(u, i - 1), F.get(u, i)))
        return F.when(F.size(u) >= 3, some).otherwise(F.array().cast("array<array<string>>"))

    return bind(units, pairs)


def interior_pairs(token: Column) -> Column:
    """Interior pairs of graphemes, each joined to a string; characters where graphemes are such."""
    n = F.char_length(token)
    plain = F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.substring(token, i, F.lit(2)))
    whole = F.transform(interior_bigrams(graphemes(token)), lambda g: F.array_join(g, ""))
    none = F.array().cast("array<string>")
    return F.when(token.rlike(JOINING), whole).otherwise(F.when(n >= 3, plain).otherwise(none))


def items(text: Column, scope: Scope) -> Column:
    return words(text) if scope is Scope.WORD else lines(text)


def within_size(token: Column, scope: Scope) -> Column:
    return F.octet_length(token) <= scope.max_bytes
