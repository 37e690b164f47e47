"""Operator 10: documents linked by the Jaccard similarity of their word shingles, through a token-group matrix.

1. A text's set holds 64-bit hashes of its distinct shingles. Equal sets form a class.
2. Similar classes become groups: classes that share a min-hash are compared with one pivot of that
   min-hash, exactly, and the links found are closed to components. A group's members are connected.
   Before any sets are moved, pairs that differ too much in their signatures are dropped: a signature holds the
   parity of the tokens of each of its places, so two differ in no more places than their sets in tokens.
3. The matrix: tokens against groups. Tokens are taken in one global order, frequent ones last, and of a set of n
   only the first n - ceil(t n) + 1 are laid out: two sets that link share one of those. A token that stands
   in one group only is left out; the others give candidates, a class (query) and another group of greater name. With sizes n and m,
   a link has 3 (n + m) / 7 tokens in common, so the first l of them stand so early in both sets that the rest fits
   behind them. Only cells whose places allow that meet, and a candidate stays if l of them do. ``SHARE`` sets l,
   between 1 and what the first tokens laid out can hold.
4. A candidate's bound is the number of the query's tokens in the group's token union. No member can link
   if it is below t n. Only groups that qualify are opened, and the query is compared with their members exactly.
   Tokens of more than ``MAX_GROUPS`` groups go another exact way: their classes are compared block by block,
   each task keeping a spanning forest of the links it finds.
5. All links are closed to components again.

No step caps partners or drops a link. Null and empty texts, and texts without words, have no shingles and
link with nothing. A row without doc_id gets no component and gives none its name. Repeated rows are
equal sets. An empty table gives none. Sets are compared by the 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.components import components
from textquarry.llm.storage import bounded, local, sweep, written
from textquarry.llm.token_counts import runs
from textquarry.llm.workers import lean

WORDS = 5
PERCENT = 75
#: Min-hashes of a set, and the pivots (those of the closest signatures) that a class is compared with in step 2.
MIN_HASHES = 8
PIVOTS = 1
#: Bits of a signature, a power of two. Larger sets than about as many tokens are told apart by their tokens only.
SIGNATURE_BITS = 1024
#: Groups of one token that are candidates of each other; larger lists are compared in blocks.
MAX_GROUPS = 256
BLOCK = 256
#: Of the tokens that a link must have among the first ones, the part that is asked for: less of it, fewer cells meet, but more pairs stay.
SHARE = 0.25
#: Of groups of so few members, those go to the bound of whose members one has a signature that allows a link.
SMALL_GROUP = 4
#: Counters that tell frequent tokens, a power of two; collisions only change the order of tokens. They move in blocks.
COUNTERS = 1 << 22
COUNTER_BLOCK = 1 << 12
BATCH_BYTES = 2_000_000
#: Tokens of a group's union in a row, about; larger unions are cut by the token.
UNION_ROW = 50_000

_U = np.uint64
_BASE, _LANES = _U(0x9E3779B97F4A7C15), [_U(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_LOWER = bytes(0x20 if b in range(9, 14) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no pattern (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(1 << 16, 2 * n)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(size, base, _U)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=_U)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingles(data: bytes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    blank = np.concatenate([[True], raw == 0x20, [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return np.empty(0, _U)
    power, inverse = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * power[:-1], dtype=_U)])
    word = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))
    k = min(n, width)
    out = np.full(n - k + 1, _U(k))
    for j in range(k):
        out = _mix(out * _LANES[j % 5] + word[j : n - k + 1 + j])
    return np.unique(out)


def class_of(s: np.ndarray) -> int:
    """One number for a set."""
    both = _mix(s ^ _U(0x1B873593)).sum(dtype=_U) * _U(3) + _mix(s ^ _U(0xCC9E2D51)).sum(dtype=_U) + _U(len(s))
    return int(_mix(np.array([both], _U)).astype(np.int64)[0])


def signature(s: np.ndarray) -> list[int]:
    """The parity of the tokens at each of SIGNATURE_BITS places, as 64-bit integers."""
    places = (s & _U(SIGNATURE_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=SIGNATURE_BITS) & 1).view(np.int64).tolist()


def _parts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, of bounded bytes of text (the second column)."""
    for batch in stream:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in runs(sizes, BATCH_BYTES):
            yield batch.slice(a, b - a)


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = batch.column(column)
    for k in range(batch.num_rows):
        t = texts[k]
        yield k, shingles(t.as_buffer().to_pybytes()) if t.is_valid else np.empty(0, _U)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), cls, min-hashes and signature of every row."""
    seeds = _mix(np.arange(1, MIN_HASHES + 1).astype(_U) * _BASE) | _U(1)  # odd: each gives another order

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(stream):
            n, cls, low = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            signatures = []
            for k, s in _sets(batch, 1):
                n[k] = len(s)
                if len(s):
                    cls[k] = class_of(s)
                    low.append([int((s * x).min().astype(np.int64)) for x in seeds])
                    signatures.append(signature(s))
                else:
                    low.append([])
                    signatures.append([])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (low, signatures)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(cls), *lists], ["doc_id", "n", "cls", "low", "sig"])

    return _plain(docs).mapInArrow(lean("sets", task), "doc_id long, n long, cls long, low array<long>, sig array<long>")


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> _U(65 - COUNTERS.bit_length())).astype(np.int64)


def token_levels(docs: DataFrame) -> np.ndarray:
    """A level for each counter: 0 for usual tokens, more the more frequent they are. COUNTERS bytes."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.uint32)
        for batch in _parts(stream):
            for _, s in _sets(batch, 1):
                np.add.at(held, _counter(s), 1)
        # Past 65,535 in one task a token is frequent, however often it comes.
        blocks = np.minimum(held, 65_535).astype("<u2").reshape(-1, COUNTER_BLOCK)
        del held
        for k in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blocks[k].tobytes()])], ["block", "counts"])

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in stream:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(k, np.zeros(COUNTER_BLOCK, np.int64))
                sums[k] += np.frombuffer(counts.as_buffer(), "<u2")
        for k, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k * COUNTER_BLOCK + some), pa.array(total[some])], ["counter", "n"])

    counted = _plain(docs).mapInArrow(lean("sets", count), "block int, counts binary")
    sums = written(counted.repartition("block").mapInArrow(lean("sets", add), "counter long, n long"), "counters")
    mean = (sums.agg(F.sum("n")).first()[0] or 0) / COUNTERS
    # Beyond what most counters of usual tokens add up to by chance. A usual token on a fuller counter only stands later in its set.
    least = mean + 2 * mean**0.5 + 2
    levels = np.zeros(COUNTERS, np.uint8)
    frequent = sums.where(F.col("n") > least).toArrow()  # COUNTERS rows at most
    if frequent.num_rows:
        level = 1 + (8 * np.log2(frequent["n"].to_numpy() / least)).astype(np.int64)
        levels[frequent["counter"].to_numpy()] = np.minimum(level, 255)
    return levels


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def prefixes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """token, cls, at: the first tokens of every set in the global order (level, hash), and their places in it."""
    held = docs.sparkSession.sparkContext.broadcast(levels)  # COUNTERS bytes

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for batch in _parts(stream):
            seen, tokens, owners, places = set(), [], [], []
            for _, s in _sets(batch, 1):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)  # copies side by side are laid out once
                order = np.argsort(level[_counter(s)], kind="stable")
                first = s[order[: prefix_size(len(s))]]
                tokens.append(first)
                owners.append(np.full(len(first), c, np.int64))
                places.append(np.arange(len(first), dtype=np.int32))
            if tokens:
                columns = np.concatenate(tokens).astype(np.int64), np.concatenate(owners), np.concatenate(places)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "cls", "at"])

    return _plain(docs).mapInArrow(lean("sets", task), "token long, cls long, at int")


def shared_tokens(rows: DataFrame) -> DataFrame:
    """The distinct rows whose token stands in two classes or more, in one pass over sorted rows."""

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, was_out = [], False  # the last row, and whether it is out already
        for batch in stream:
            columns = [batch.column(k).to_numpy() for k in range(3)]
            if last:
                columns = [np.append(x, y) for x, y in zip(last, columns, strict=True)]
            t, c, _ = columns
            if not len(t):
                continue
            # A class has a token at one place, so rows of equal token and class are equal.
            new = np.append(True, (t[1:] != t[:-1]) | (c[1:] != c[:-1]))
            t, c, at = columns = [x[new] for x in columns]
            same = t[1:] == t[:-1]
            out = np.append(False, same) | np.append(same, False)
            out[0] |= was_out
            emit = out.copy()
            emit[0] &= not was_out
            # The last row stays until it is known whether the next one has its token.
            last, was_out = [x[-1:] for x in columns], bool(out[-1])
            if emit.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[emit]) for x in columns], ["token", "cls", "at"])

    return rows.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(lean("sets", task), "token long, cls long, at int")


def _sets_of(docs: DataFrame, classes: DataFrame, names: DataFrame) -> DataFrame:
    """cls, tokens (array) of the classes named; each from the text of one of its documents."""
    ids = classes.join(names, "cls").select(F.col("cls").alias("want"), F.col("any_id").alias("id_"))
    ids = written(ids, "wanted")
    rows = _plain(docs).join(bounded(ids), F.col("doc_id") == F.col("id_")).select("want", "text")

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(stream):
            want = batch.column(0).to_numpy()
            found = [(int(want[k]), s) for k, s in _sets(batch, 1) if len(s) and class_of(s) == want[k]]
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                flat = np.concatenate([s for _, s in part]).astype(np.int64)
                ends = np.cumsum([0, *(len(s) for _, s in part)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in part]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cls", "tokens"])

    # A class may come twice if its row is repeated; links and bounds don't mind.
    return written(rows.mapInArrow(lean("sets", task), "cls long, tokens array<long>"), "sets")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b (a written table) whose sets link."""
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    held = bounded(pairs)  # so that sets are moved once, with their partner's name
    right = right.join(bounded(written(pairs.select("b").distinct(), "right-sides")), "b", "left_semi")
    joined = left.join(held, "a").join(right, "b").withColumn("both", both)
    return joined.where(100 * F.col("both") >= PERCENT * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b")


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b (a written table) whose signatures allow a link, with the number of places they differ in."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    right = side("b").join(bounded(written(pairs.select("b").distinct(), "right-sides")), "b", "left_semi")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, k: total + k)
    joined = side("a").join(bounded(pairs), "a").join(right, "b").withColumn("differ", differ)
    # A link has at most so large a part of both sets' tokens in one of them only.
    return joined.where((100 + PERCENT) * F.col("differ") <= (100 - PERCENT) * (F.col("na") + F.col("nb"))).select("a", "b", "differ")


def _fits(n: str, m: str):
    """Sizes between which a link is possible."""
    return (100 * F.least(n, m)) >= (PERCENT * F.greatest(n, m))


def _pivot_pairs(classes: DataFrame) -> DataFrame:
    """a (class), b (pivot): of the pivots that share a min-hash with it, those of the closest signatures."""
    laid = classes.select("cls", "n", F.posexplode("low").alias("k", "v"))
    heads = laid.groupBy("k", "v").agg(F.min(F.struct("cls", "n")).alias("p"), F.max("cls").alias("top")).where(F.col("p.cls") != F.col("top"))
    heads = heads.select("k", "v", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pn"))
    met = laid.join(heads, ["k", "v"]).where((F.col("cls") != F.col("pivot")) & _fits("n", "pn"))
    met = written(met.select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct(), "pivots")
    best = F.row_number().over(Window.partitionBy("a").orderBy("differ", "b"))  # MIN_HASHES rows each at most
    return _possible(met, classes).withColumn("r", best).where(F.col("r") <= PIVOTS).select("a", "b")


def _grouped(classes: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("cls"), "root")
    return classes.join(named, "cls", "left").select("cls", "n", F.coalesce("root", "cls").alias("grp"))


def _block_links(docs: DataFrame, hot: DataFrame, names: DataFrame) -> DataFrame:
    """Links among the classes ``hot`` (cls, n): all pairs of blocks whose sizes allow a link, one task each."""
    order = written(hot.distinct(), "hot")
    total = order.count()
    if not total:
        return local(docs.sparkSession, [], a=pa.int64(), b=pa.int64())
    sets = _sets_of(docs, order.select("cls"), names)
    blocks = -(-total // BLOCK)
    cut = sets.withColumn("n", F.size("tokens")).repartitionByRange(blocks, "n", "cls").withColumn("blk", F.spark_partition_id())
    cut = written(cut, "blocks")
    ends = cut.groupBy("blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    i, j = ends.select(F.col("blk").alias("i"), F.col("hi").alias("hi_i")), ends.select(F.col("blk").alias("j"), F.col("lo").alias("lo_j"))
    jobs = i.join(j, (F.col("i") <= F.col("j")) & (100 * F.col("hi_i") >= PERCENT * F.col("lo_j"))).select("i", "j")
    sides = jobs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"))

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        cls, sizes = rows["cls"].to_numpy(), rows["n"].to_numpy()
        flat = np.concatenate(list(rows["tokens"]))
        owner = np.repeat(np.arange(len(cls)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        group = np.cumsum(np.append(0, flat[1:] != flat[:-1]))
        parent = list(range(len(cls)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        by_doc = np.argsort(owner, kind="stable")
        start = np.searchsorted(owner[by_doc], np.arange(len(cls) + 1))
        first, last = np.searchsorted(group, np.arange(group[-1] + 1)), np.searchsorted(group, np.arange(group[-1] + 1), "right")
        out = []
        for x in range(len(cls)):
            g = group[by_doc[start[x] : start[x + 1]]]
            count = np.zeros(len(cls), np.int64)
            for a, b in zip(first[g], last[g], strict=True):
                count[owner[a:b]] += 1
            hit = np.flatnonzero(100 * count >= PERCENT * (sizes[x] + sizes - count))
            for y in hit[hit > x].tolist():
                if root(x) != root(y):
                    parent[root(x)] = root(y)
                    out.append((cls[x], cls[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return cut.join(sides, "blk").groupBy("i", "j").applyInPandas(task, "a long, b long")


def _opened(candidates: DataFrame, sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """The candidates whose bound, the query's tokens in the group's token union, allows a link."""
    wanted = bounded(written(candidates.select(F.col("other").alias("grp")).distinct(), "asked-groups"))
    members = written(grouped.join(wanted, "grp", "left_semi"), "members")
    cuts = bounded(written(members.groupBy("grp").agg(F.ceil(F.sum("n") / UNION_ROW).cast("int").alias("cuts")), "union-cuts"))
    cut = F.pmod("token", "cuts").cast("int").alias("cut")
    held = sets.select("cls", "tokens").join(bounded(members.select("cls", "grp"), members), "cls").join(cuts, "grp")
    asked = sets.select("cls", "tokens").join(bounded(candidates.withColumnRenamed("other", "grp"), candidates), "cls").join(cuts, "grp")
    # Usual unions are one array, of UNION_ROW tokens at most; larger ones are put together token by token, in several.
    whole = held.where("cuts = 1").groupBy("grp").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))
    parts = held.where("cuts > 1").select("grp", "cuts", F.explode("tokens").alias("token")).groupBy("grp", cut).agg(F.collect_set("token").alias("union"))
    most = F.size(F.array_intersect("own", "union")).alias("most")
    met = asked.where("cuts = 1").select("cls", "n", "grp", F.col("tokens").alias("own")).join(whole, "grp").select("cls", "n", "grp", most)
    long = asked.where("cuts > 1").select("cls", "n", "grp", "cuts", F.explode("tokens").alias("token"))
    long = long.groupBy("cls", "n", "grp", cut).agg(F.collect_list("token").alias("own"))  # tokens of one set
    met = met.unionByName(long.join(parts, ["grp", "cut"]).select("cls", "n", "grp", most))
    bound = met.groupBy("cls", "n", "grp").agg(F.sum("most").alias("most"))
    return written(bound.where(100 * F.col("most") >= PERCENT * F.col("n")).select("cls", "n", "grp"), "opened")


def _candidates(matrix: DataFrame, widths: DataFrame, grouped: DataFrame) -> DataFrame:
    """cls, n, other: queries and the groups that have enough tokens in common with them, at places early enough."""
    usual = widths.where(F.col("groups") <= MAX_GROUPS).select("token")
    sizes = written(grouped.groupBy(F.col("grp").alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "sizes")
    # How far a query's size may go for a member's token to be one of the first in common: P n <= room.
    room = F.max(100 * F.col("n") - (100 + PERCENT) * F.col("at")).alias("room")
    cells = matrix.join(usual, "token", "left_semi").groupBy("token", F.col("grp").alias("other")).agg(room).join(bounded(sizes), "other")
    # Sizes of members that can link; the need is least at one of the two ends.
    t, n = PERCENT / 100, F.col("n")
    low, high = F.greatest("lo", F.ceil(t * n)), F.least("hi", F.floor(n / t))
    need = lambda m: PERCENT / (100 + PERCENT) * (n + m) - t * F.greatest(n, m)
    least = SHARE * F.least(need(low), need(high))
    # The first l tokens in common have the other ones behind them in both sets; l is below ``least`` + 1.
    early = (100 + PERCENT) * (n - F.col("at") + least) >= PERCENT * (n + low) - 1e-6
    fits = (100 + PERCENT) * least + F.col("room") >= PERCENT * n - 1e-6
    # A link between two groups is found from either: the one of lesser name asks.
    met = matrix.join(cells, "token").where((F.col("grp") < F.col("other")) & (low <= high) & early & fits)
    shared = met.groupBy("cls", "n", "other").agg(F.count(F.lit(1)).alias("shared"), F.first(least).alias("least"))
    return shared.where(F.col("shared") >= F.col("least") - 1e-6).select("cls", "n", "other")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between classes that connect all that are connected. classes: cls, n, low, sig, any_id."""
    names = classes.select("cls", "any_id")
    pairs = written(_pivot_pairs(classes), "pivot-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    near = written(_linked(pairs, _sets_of(docs, ends, names)), "near")
    grouped = written(_grouped(classes, components(near)), "groups")
    sweep(docs.sparkSession)

    rows = shared_tokens(prefixes(docs, token_levels(docs)))
    matrix = written(rows.join(bounded(grouped), "cls").select("token", "cls", "at", "n", "grp"), "matrix")
    del rows
    sweep(docs.sparkSession)
    widths = written(matrix.groupBy("token").agg(F.count_distinct("grp").alias("groups")).where(F.col("groups") > 1), "widths")
    candidates = written(_candidates(matrix, widths, grouped), "candidates")
    sweep(docs.sparkSession)

    # The bound, tokens of the query in the union of the group's tokens, is asked of every group. Where a group is small, members'
    # signatures come first, so that few unions are put together.
    many = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SMALL_GROUP).select(F.col("grp").alias("other"))
    inside = lambda some: some.join(grouped.select("grp", F.col("cls").alias("b"), F.col("n").alias("m")), "grp").where(_fits("n", "m")).select(F.col("cls").alias("a"), "b")
    small = written(candidates.join(many, "other", "left_anti").withColumnRenamed("other", "grp"), "small")
    possible = _possible(written(inside(small).distinct(), "small-pairs"), classes).select(F.col("a").alias("cls"), F.col("b").alias("member"))
    thinned = possible.join(grouped.select(F.col("cls").alias("member"), F.col("grp").alias("other")), "member").select("cls", "other").distinct()
    asked = candidates.join(many, "other", "left_semi").select("cls", "n", "other").unionByName(thinned.join(candidates, ["cls", "other"]).select("cls", "n", "other"))
    asked = written(asked, "asked")
    members = asked.select(F.col("other").alias("grp")).distinct().join(grouped, "grp").select("cls")
    sets = _sets_of(docs, asked.select("cls").unionByName(members).distinct(), names)
    opened = _opened(asked, sets, grouped)
    inner = written(inside(opened).distinct(), "opened-pairs")
    far = _linked(written(_possible(inner, classes).select("a", "b"), "far-pairs"), sets)

    hot = matrix.join(widths.where(F.col("groups") > MAX_GROUPS), "token").select("cls", "n")
    return near.unionByName(written(far, "far")).unionByName(_block_links(docs, hot, names))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = written(profiles(docs), "profiles")
    named = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(named.groupBy("cls").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.first("sig").alias("sig"), F.min("doc_id").alias("any_id")), "classes")
    grouped = written(_grouped(classes, components(links(docs, classes))), "components")
    least = classes.select("cls", "any_id").join(bounded(grouped), "cls").groupBy("grp").agg(F.min("any_id").alias("component"))
    # Both sides of each join are plain tables, so a hot group or class is split where they are not broadcast.
    of = written(grouped.join(bounded(written(least, "names")), "grp").select(F.col("cls").alias("c__"), "component"), "class-names")
    whole = rows.select("doc_id", "n", "cls").join(bounded(of), (F.col("n") > 0) & (F.col("cls") == F.col("c__")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
