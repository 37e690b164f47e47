"""Operator 12: the trie of conversations by their first turns, and what a cache of shared prefixes would save.

``rebuilt`` gives every conversation c the first h turns of conversation c - c % 5 before its own turns from the h-th on,
h = crc32(c) % 9. A node is a distinct sequence of first turns: a position-salted hash of each turn, put together by exclusive or,
names it by 128 bits and its depth. Running values along a conversation are taken inside blocks of a range
partitioning, and the blocks' totals are put before them, so that a very long conversation is never one task's.

Subtree totals are found by peeling leaves: each node holds a counter of the children it still waits for; nodes whose counter is 0
send their totals to their parents and leave, until only the root is left. Nodes with one child only pass on what they
get, so they are stepped over: pointer doubling finds the next node above that waits for more than one, and what the
nodes between add; rounds follow the branching of the tree, not the length of conversations. Messages to one node are added up before they are shuffled.

The decimal ids of conversations that end in a node are hashed in ranges of 4,096 ids each, put together in order by a stream, which holds one
range at a time however many there are.

Turns are ordered by turn (null first), then role and text; a null role or text is empty. Rows without conv_id
belong to no conversation and are left out. Repeated rows are turns of their own. An empty table gives no node. Further columns
are not read. Long texts are hashed where they are read and not moved again after their turns are numbered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.storage import drop, written
from textquarry.llm.workers import lean

#: Conversations with equal conv_id - conv_id % FAMILY share their first turns.
FAMILY = 5
#: Shared turns: crc32(conv_id) % HEADS.
HEADS = 9
#: Ids of a range that is hashed at once: 2^12.
ID_BITS = 12
_BEFORE = (Window.unboundedPreceding, -1)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), first and second hash of role and text, bytes of the text, block."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    dealt = rows.where(F.col("conv_id").isNotNull()).repartitionByRange("conv_id", "turn").withColumn("block", F.spark_partition_id())
    hashes = [F.xxhash64("role", "text").alias("c1"), F.xxhash64(F.lit(17), "text", "role").alias("c2"), F.octet_length("text").cast("long").alias("bytes")]
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    # The number of a partition holds only as long as the partitions do: it is written before it is used twice.
    held = written(dealt.withColumn("n", F.row_number().over(inside)).select("conv_id", "block", "n", *hashes), "turns")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(*_BEFORE)
    counts = held.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("own"))
    bases = counts.select("conv_id", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    return held.join(bases, ["conv_id", "block"]).select("conv_id", (F.col("base") + F.col("n") - 1).alias("pos"), "c1", "c2", "bytes", "block")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) of every rebuilt conversation, and its turns: conv_id, p (from 1), c1, c2, bytes, block."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    family = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    known = sizes.select(F.col("conv_id").alias("family"), F.col("n").alias("family_n"))
    convs = written(
        sizes.select("conv_id", "n", h, family).join(known, "family", "left").withColumn("taken", F.least("h", F.coalesce("family_n", F.lit(0)))), "conversations"
    )
    size = (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")
    # HEADS - 1 turns of a family at most, for as many conversations as share it.
    heads = turns.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("family"), "pos", "c1", "c2", "bytes")
    first = convs.where("h > 0").join(heads, "family").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("p"), "c1", "c2", "bytes", F.lit(-1).alias("block"))
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("p"), "c1", "c2", "bytes", "block")
    return convs.select("conv_id", size), first.unionByName(rest)


def _name(depth: Column, a: Column, b: Column) -> Column:
    return F.concat_ws("-", depth.cast("string"), F.hex(a), F.hex(b))


def memberships(turns: DataFrame) -> DataFrame:
    """conv_id, depth, id, parent_id, bytes of every node that a rebuilt conversation goes through but the root."""
    rows = turns.withColumns({"k1": F.xxhash64("p", "c1", "c2"), "k2": F.xxhash64("c2", "c1", "p")})
    inside = Window.partitionBy("conv_id", "block").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(*_BEFORE)
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("s1"), F.bit_xor("k2").alias("s2"))
    bases = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(s) for s in ("s1", "s2")])
    run = rows.withColumns({"r1": F.bit_xor("k1").over(inside), "r2": F.bit_xor("k2").over(inside)}).join(bases, ["conv_id", "block"])
    a, b = F.col("r1").bitwiseXOR(F.col("s1")), F.col("r2").bitwiseXOR(F.col("s2"))
    parent = _name(F.col("p") - 1, a.bitwiseXOR(F.col("k1")), b.bitwiseXOR(F.col("k2")))
    return run.select("conv_id", F.col("p").alias("depth"), _name(F.col("p"), a, b).alias("id"), parent.alias("parent_id"), "bytes")


def tree(sizes: DataFrame, members: DataFrame) -> DataFrame:
    """id, parent_id, depth, conv_id (smallest member), n_convs, own (bytes saved by the node itself), n_children."""
    root = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), _name(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("bytes"))
    every = members.withColumn("depth", F.col("depth").cast("long")).unionByName(root)
    nodes = every.groupBy("id").agg(
        F.max("parent_id").alias("parent_id"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")
    )
    held = written(nodes.select("id", "parent_id", "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")), "trie")
    children = held.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    return written(held.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")


def chains(nodes: DataFrame) -> DataFrame:
    """id, head, target, passed of every node but the root: ``target`` is the next node above that is the root or has not one child,
    ``head`` the last node below it on the way, ``passed`` the sum of ``own`` of the nodes between.

    Pointer doubling: each round doubles the way that an open node has behind it.
    """
    ups = nodes.select(F.col("id").alias("up"), ((F.col("n_children") == 1) & F.col("parent_id").isNotNull()).alias("single"), F.col("own").alias("up_own"))
    start = nodes.where(F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("up")).join(ups, "up")
    at = written(
        start.select("id", "up", F.when(~F.col("single"), F.col("id")).alias("head"), F.when(F.col("single"), F.col("up_own")).otherwise(F.lit(0)).alias("passed")), "chains"
    )
    done = [at.where("head IS NOT NULL")]
    left = at.where("head IS NULL")
    while not left.isEmpty():
        known = left
        for x in done:
            known = known.unionByName(x)
        above = known.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("head").alias("head2"), F.col("passed").alias("passed2"))
        now = left.join(above, "up").select("id", F.col("up2").alias("up"), F.col("head2").alias("head"), (F.col("passed") + F.col("passed2")).alias("passed"))
        at = written(now, "chains")
        done.append(at.where("head IS NOT NULL"))
        left = at.where("head IS NULL")
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return written(every.select("id", "head", F.col("up").alias("target"), "passed"), "chains")


def peeled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, n_leaves, saved of the root and every node that has not one child: the totals of its subtree."""
    leaf = (F.col("n_children") == 0).cast("long")
    ends = nodes.where((F.col("n_children") != 1) | F.col("parent_id").isNull())
    held = ends.join(links.select("id", "target", "passed"), "id", "left")
    waiting = written(held.select("id", "target", F.coalesce("passed", F.lit(0)).alias("passed"), F.col("n_children").alias("left"), leaf.alias("n_leaves"), F.col("own").alias("saved")), "peel")
    done = []
    while True:
        ready, rest = waiting.where("left = 0"), waiting.where("left > 0")
        done.append(ready.select("id", "n_leaves", "saved"))
        if rest.isEmpty():
            break
        sent = ready.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("came"), F.sum("n_leaves").alias("more_leaves"), F.sum(F.col("saved") + F.col("passed")).alias("more"))
        waiting = written(
            rest.join(sent, "id", "left").select(
                "id",
                "target",
                "passed",
                (F.col("left") - F.coalesce("came", F.lit(0))).alias("left"),
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
            ),
            "peel",
        )
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return every


def end_hashes(ends: DataFrame) -> DataFrame:
    """id, ends_sha256: SHA-256 of the decimal conv_ids that end in a node, ascending, comma-joined."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = ends.groupBy("id", F.shiftright("conv_id", ID_BITS).alias("part")).agg(ids.alias("ids"))

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in stream:
            names, sums = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == name:
                    held.update(b",")
                else:
                    if held is not None:
                        names.append(name)
                        sums.append(held.hexdigest())
                    name, held = key, hashlib.sha256()
                held.update(text.encode())
            yield pa.RecordBatch.from_pydict({"id": pa.array(names, pa.string()), "ends_sha256": pa.array(sums, pa.string())})
        if held is not None:
            yield pa.RecordBatch.from_pydict({"id": [name], "ends_sha256": [held.hexdigest()]})

    ordered = ranges.repartition("id").sortWithinPartitions("id", "part").select("id", "ids")
    return ordered.mapInArrow(lean("trie", task), "id string, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    turns = written(numbered(conversations), "numbered")
    sizes, again = rebuilt(turns)
    members = written(memberships(again), "members")
    nodes = tree(sizes, members)
    links = chains(nodes)
    totals = peeled(nodes, links)
    # A node with one child has its chain's last node's leaves, and its own and the savings between besides.
    bottoms = totals.join(links, "id").select("head", F.col("passed").alias("all"), "n_leaves", "saved")
    single = nodes.where((F.col("n_children") == 1) & F.col("parent_id").isNotNull()).select("id")
    between = single.join(links, "id").join(bottoms, "head").select("id", "n_leaves", (F.col("saved") + F.col("all") - F.col("passed")).alias("saved"))
    sums = written(totals.unionByName(between), "totals")
    last = members.join(sizes, "conv_id").where("depth = size").select("id", "conv_id")
    empty = sizes.where("size = 0").select(_name(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("id"), "conv_id")
    hashes = written(end_hashes(last.unionByName(empty)), "ends")
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums, "id").join(parents, "parent_id", "left").join(hashes, "id", "left")
    drop(turns, members)
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
