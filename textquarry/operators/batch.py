"""Many terms at once: a table of prefixes against the distinct items, joined, never crossed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions.scoring import SCORE_MODULUS
from textquarry.operators.search import TOP_K

#: Terms up to which their table is broadcast, as counted.
MAX_BROADCAST_TERMS = 200_000


def batch_prefix(items: DataFrame, terms: DataFrame, k: int = TOP_K) -> DataFrame:
    """term, priority, token: what ``search`` finds for each distinct ``term``, for items ``token, freq``.

    Every item is laid out by its beginnings, but only those of a length that some term has, and these are equal to terms or
    not: a join by equality that makes matches and nothing else. Terms are broadcast up to ``MAX_BROADCAST_TERMS``;
    the one shuffle is by term, after each task has kept its own best k. Empty and null terms have no match.
    """
    wanted = terms.select(F.col("term").cast("string").alias("term")).where("term <> ''").distinct()
    counted = wanted.groupBy(F.char_length("term").alias("size")).count().collect()  # a row for each length of a term
    if not counted:
        return items.sparkSession.createDataFrame([], "term string, priority int, token string")
    sizes = F.filter(F.array(*[F.lit(s) for s in sorted(r["size"] for r in counted)]), lambda s: s <= F.char_length("token"))
    laid = items.select("token", "freq", F.explode(F.transform(sizes, lambda s: F.substring(F.col("token"), F.lit(1), s))).alias("term"))
    table = F.broadcast(wanted) if sum(r["count"] for r in counted) <= MAX_BROADCAST_TERMS else wanted
    found = laid.join(table, "term").where("token <> term")
    score = ((F.char_length("token") - F.char_length("term")) % SCORE_MODULUS).cast("int").alias("priority")
    by = Window.partitionBy("term").orderBy("priority", "token")
    best = found.select("term", score, "token", "freq").withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
    # Repeats take places too: those before a token are the sum of what stands before it.
    before = F.coalesce(F.sum(F.least("freq", F.lit(k))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = best.withColumn("copies", F.least(F.least("freq", F.lit(k)), F.lit(k) - before)).where("copies > 0")
    return left.select("term", "priority", "token", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
