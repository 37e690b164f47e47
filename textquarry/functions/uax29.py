"""Word boundaries for scripts outside the separator pattern of ``tokenize.words``.

Only rows that hold such a script leave the JVM; the others keep the built-in path.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textquarry.functions.tokenize import words

#: Scripts and marks whose boundaries the separator pattern does not model.
SPECIAL = (
    r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsHebrew}\p{Cf}\p{Nl}"
    r"\x{1F1E6}-\x{1F1FF}]"
)
_BOUNDARY = regex.compile(r"\b", flags=regex.WORD | regex.V1)
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")


def segment(text: str) -> list[str]:
    """Pieces between default word boundaries that hold a letter or digit."""
    return [piece for piece in _BOUNDARY.split(text) if piece and _ALNUM.search(piece)]


@F.pandas_udf(ArrayType(StringType()))
def _segment_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else segment(t))


def words_any_script(text: Column) -> Column:
    """``words`` with the full segmentation rules where a text needs them."""
    needs = text.rlike(SPECIAL)
    # Null for the rest: the Python worker then sees almost no data.
    return F.when(needs, _segment_batch(F.when(needs, text))).otherwise(words(text))
