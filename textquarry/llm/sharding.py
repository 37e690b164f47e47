"""Operator 8: shards of near equal bytes by minimax contiguous partition.

Rows with equal texts form an atomic group, and groups stand in the order of a 64-bit hash of their text. The least
capacity that lets a greedy walk over them close with the wanted number of shards is found by binary search, and
the order is cut so that no shard exceeds it, as near to equal parts as that allows.

The driver never holds all groups. It starts with the bytes of at most ``PLACES`` places, runs of the order with equal first
``STEP_BITS`` bits. The walk with one byte less than the least capacity of these shows where it is stopped: where that is
inside a place, the place is replaced by the places of the next bits in it, down to single groups, and the search goes on. When
every stop is a single group, finer places would stop the walk at the same groups: the capacity is the least one over all groups.

Slots number the rows of a shard without gaps: places with many rows (one text may hold a third of all)
are split by a hash of doc_id, rows are ranked inside each split, and prefix sums of the splits' counts
give the first slot of each.

A null text has no bytes, as an empty one, and both form one group. Null and repeated doc_ids are ranked
with the rest; repeated rows are rows. An empty table gives none. A long text is one row of so many bytes. Further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.storage import written

#: Bits of the hash that tell the places inside a place, and so the rows that one place is replaced by, at most.
STEP_BITS = 16
PLACES = 1 << STEP_BITS
#: Rows that one task ranks at once, about; places with more are split.
SPLIT_ROWS = 20_000


def least_capacity(sizes: list[int], n: int) -> int:
    """The smallest capacity at which a greedy walk over the ordered sizes needs n shards at most."""
    total = [0, *accumulate(sizes)]

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(n):
            at = bisect_right(total, total[at] + capacity) - 1
            if at == len(sizes):
                return True
        return False

    low, high = max([0, *sizes]), total[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def stops(sizes: list[int], n: int, capacity: int) -> list[int]:
    """The sizes that a greedy walk of n shards ends before; the last one may be larger than a whole shard."""
    total = [0, *accumulate(sizes)]
    out, at = [], 0
    for _ in range(n):
        end = bisect_right(total, total[at] + capacity) - 1
        if end == len(sizes):
            break
        out.append(end)
        if end == at:
            break
        at = end
    return out


def cuts(sizes: list[int], n: int) -> list[int]:
    """n + 1 positions; shard i holds sizes[cuts[i]:cuts[i + 1]], none above the least capacity.

    Where that leaves a choice, the position nearest to equal parts is taken.
    """
    capacity = least_capacity(sizes, n)
    total = [0, *accumulate(sizes)]
    earliest = [len(sizes)]  # the first position from which 0, 1, ... shards can hold the rest
    for _ in range(n):
        earliest.append(bisect_left(total, total[earliest[-1]] - capacity))
    out = [0]
    for i in range(1, n):
        low = max(out[-1], earliest[n - i])
        high = bisect_right(total, total[out[-1]] + capacity) - 1
        at = bisect_left(total, total[-1] * i / n)
        if at > 0 and total[-1] * i / n - total[at - 1] < total[min(at, len(sizes))] - total[-1] * i / n:
            at -= 1
        out.append(min(max(at, low), high))
    return [*out, len(sizes)]


@dataclass(frozen=True)
class Place:
    """Groups whose hashes have the same first ``depth`` * STEP_BITS bits: the least and greatest hash, bytes and rows."""

    low: int
    high: int
    bytes: int
    rows: int
    depth: int


def _prefix(depth: int) -> Column:
    return F.shiftright("h", 64 - STEP_BITS * depth)


def _places(rows: DataFrame, depth: int) -> list[Place]:
    sums = rows.groupBy(_prefix(depth)).agg(F.min("h").alias("low"), F.max("h").alias("high"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return [Place(r.low, r.high, r.bytes, r.n, depth) for r in sums.collect()]


def group_places(rows: DataFrame, n_shards: int) -> list[Place]:
    """Places in order, fine enough that their least capacity is that of single groups. rows: h, size."""
    places = sorted(_places(rows, 1), key=lambda p: p.low)  # PLACES at most, however large the input is
    while places:
        sizes = [p.bytes for p in places]
        wide = [places[k] for k in stops(sizes, n_shards, least_capacity(sizes, n_shards) - 1) if places[k].low < places[k].high]
        if not wide:
            break
        finer = []
        for depth in {p.depth for p in wide}:
            # n_shards places at most, each replaced by PLACES at most.
            inside = [int(p.low) >> (64 - STEP_BITS * depth) for p in wide if p.depth == depth]
            finer += _places(rows.where(_prefix(depth).isin(inside)), depth + 1)
        places = sorted([p for p in places if p not in wide] + finer, key=lambda p: p.low)
    return places


def assign(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-rows",
    )
    places = group_places(rows, n_shards)
    ends = cuts([p.bytes for p in places], n_shards)
    # The greatest hash of each shard but the last; an empty shard ends where the one before it does.
    last = [places[e - 1].high if e else -(2**63) for e in ends[1:-1]]
    first_empty = [e == 0 for e in ends[1:-1]]
    after = [F.lit(True) if none else F.col("h") > bound for bound, none in zip(last, first_empty, strict=True)]
    shard = sum([a.cast("int") for a in after], F.lit(0))
    # A place of more than its part of the rows is split, so splits stay within a few times the number of places.
    whole: dict[int, int] = {}
    for p in places:
        whole[p.low >> (64 - STEP_BITS)] = whole.get(p.low >> (64 - STEP_BITS), 0) + p.rows
    split = max(SPLIT_ROWS, 4 * sum(whole.values()) // PLACES)
    # PLACES rows of two integers at most: a proven bound.
    table = F.broadcast(rows.sparkSession.createDataFrame([(p, -(-n // split)) for p, n in whole.items()], "place long, splits int"))
    dealt = rows.withColumns({"shard": shard, "place": _prefix(1)}).join(table, "place").withColumn("split", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("splits")).cast("int"))
    counts = dealt.groupBy("shard", "place", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("place", "split").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "place", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "place", "split").orderBy("doc_id", "text_crc32", "size"))
    ranked = dealt.withColumn("rank", rank)
    return ranked.join(bases, ["shard", "place", "split"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot")
    )
