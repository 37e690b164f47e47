"""Words within an edit distance of a term, found by the pieces that edits leave whole.

A word is cut into ``max_distance + 1`` pieces of near equal length. So many edits at most can't touch all of them: one piece at
least stands unchanged in the term, moved by no more than the distance. The index has a row for each piece: size (of the
word, in characters), part, piece, token, freq. A term gives, for each size and part, the few substrings that can be the piece;
rows that have one are verified by their distance. Nothing is missed, whatever the lengths, and an index row a piece is all it takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_fuzzy(items: DataFrame, path: str, max_distance: int = 2) -> None:
    """The index of distinct ``token, freq``, for distances up to ``max_distance``."""
    parts, size = max_distance + 1, F.char_length("token")
    edge = lambda i: F.floor(size * i / parts).cast("int")
    pieces = F.array(*[F.struct(F.lit(i).alias("part"), F.substring(F.col("token"), edge(i) + 1, edge(i + 1) - edge(i)).alias("piece")) for i in range(parts)])
    rows = items.select(size.alias("size"), F.explode_outer(pieces).alias("p"), "token", "freq").select("size", "p.part", "p.piece", "token", "freq")
    # Rows stay where their words are, so a piece of many words lies in many files, and each file is sorted.
    rows.withColumn("parts", F.lit(parts)).sortWithinPartitions("size", "part", "piece", "token").write.mode("overwrite").option("compression", "zstd").parquet(path)


def probes(term: str, distance: int, parts: int) -> dict[tuple[int, int], list[str]]:
    """(size, part) -> what the piece can be."""
    found = {}
    for size in range(max(0, len(term) - distance), len(term) + distance + 1):
        for part in range(parts):
            start, end = size * part // parts, size * (part + 1) // parts
            places = range(max(0, start - distance), min(len(term) - (end - start), start + distance) + 1)
            if options := sorted({term[p : p + end - start] for p in places}):
                found[size, part] = options
    return found


def fuzzy_search(spark: SparkSession, path: str, term: str, distance: int) -> DataFrame:
    """distance, token, freq of all words within ``distance`` of the term."""
    held = spark.read.parquet(path)
    parts = held.select("parts").first()
    if parts is None:
        return spark.createDataFrame([], "distance int, token string, freq long")
    if not 0 <= distance < parts.parts:
        raise ValueError(f"the index is for distances up to {parts.parts - 1}")
    wanted: Column = F.lit(False)
    for (size, part), options in probes(term, distance, parts.parts).items():
        wanted = wanted | ((F.col("size") == size) & (F.col("part") == part) & F.col("piece").isin(options))
    away = F.levenshtein("token", F.lit(term), distance)  # -1 beyond it
    near = held.where(wanted).select("token", "freq", away.alias("distance")).where("distance >= 0")
    # A word may share more than one piece.
    return near.dropDuplicates(["token"]).select("distance", "token", "freq")
