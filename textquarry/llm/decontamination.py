"""Operator 4: benchmark decontamination, in built-in functions only.

Benchmark items are normalised and cut into windows of ``WIDTH`` words (an item of fewer words is one
window). The distinct windows of all items, keyed by 64-bit hash, are one broadcast hash set as long as
their measured bytes stay below ``MAX_BROADCAST_BYTES``; beyond it the same equi-join is shuffled. Texts are
cut into words once, and their windows of all widths that items have probe that set in one pass. A hit is
verified word by word, and the words that hits cover are counted, removed, or lead to the document's removal.

Null texts have no words. A text without words meets no window. Documents are told apart by
(doc_id, hash of the text), so repeated rows give the same result each, and equal doc_ids with other texts
don't mix; null doc_ids are allowed. Without benchmark rows nothing is hit. Null item_ids count as one
item named by the empty string. Further columns pass through ``remove`` and ``clean`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.storage import fresh, quoted, written

WIDTH = 10
#: Bytes of windows and their items, as measured when they are written, up to which they are broadcast.
MAX_BROADCAST_BYTES = 48_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are no letter or digit.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lower, _BREAK), lambda w: w != "")


def _window_hash(h: Column, at: Column | int, width: int) -> Column:
    """Hash of ``width`` word hashes from ``at`` on. ``slice`` would copy the whole array for every window."""
    return F.xxhash64(*[F.get(h, at + F.lit(j)) for j in range(width)])


def _hashes(w: Column, widths: list[int]) -> Column:
    """Hashes of the windows of each width, one width after another; a text shorter than a width has none of it."""

    def windows(h: Column) -> Column:
        def of(width: int) -> Column:
            each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: _window_hash(h, i, width))
            return F.when(F.size(h) >= width, each).otherwise(F.array().cast("array<bigint>"))

        return F.concat(*map(of, widths))

    return F.get(F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), windows), F.lit(0))


def _first_word(place: Column, n: Column, width: Column, widths: list[int]) -> Column:
    """The first word of the window that stands at ``place`` of ``_hashes``, in a text of n words."""
    shorter = [F.when(width > k, F.greatest(n - k + 1, F.lit(0))).otherwise(F.lit(0)) for k in widths[:-1]]
    # Not below 0 where a hash is by chance that of another width: the words then decide.
    return F.greatest(place - sum(shorter, F.lit(0)), F.lit(0))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """win (words), width, items (sorted item_ids) of every distinct window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(width), F.size("w"))
    cut = items.select("item", n.alias("width"), F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice(F.col("w"), i, n))).alias("win"))
    return cut.groupBy("win").agg(F.first("width").alias("width"), F.sort_array(F.collect_set("item")).alias("items"))


def _key(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), words(F.col("text")).alias("w")
    )


def hits(docs: DataFrame, windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, at (first word, from 0), width, items of every verified hit."""
    held = written(windows, "benchmark-windows")
    widths = sorted(r.width for r in held.select("width").distinct().collect())  # ``width`` values at most
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, at int, width int, items array<string>")
    h = F.coalesce(*[F.when(F.col("width") == k, F.get(_hashes(F.col("win"), [k]), F.lit(0))) for k in widths])
    set_ = held.select(h.alias("h"), "win", "width", "items")
    cut = _key(docs).select("doc_id", "text_hash", "w", _hashes(F.col("w"), widths).alias("hs"))
    at = _first_word(F.col("place"), F.col("n"), F.col("width"), widths).alias("at")
    if held.bytes_ <= MAX_BROADCAST_BYTES:
        # The outer form: for the inner one the optimizer derives a filter on the array, and pushes it
        # down with the words spelled out inside the lambda, where each window would cut the text again.
        probed = cut.select("doc_id", "text_hash", "w", F.posexplode_outer("hs").alias("place", "h")).join(F.broadcast(set_), "h")
        laid = probed.select("doc_id", "text_hash", "w", "win", "width", "items", "place", F.size("w").alias("n"))
        found = laid.select("doc_id", "text_hash", "w", "win", "width", "items", at)
        # Not a plain equality, which would become a join key and be computed for every window.
        found = found.where(F.coalesce(F.slice("w", F.col("at") + 1, F.col("width")) == F.col("win"), F.lit(False)))
    else:
        # Only hashes are shuffled; the texts of documents with a hit are looked up again.
        laid = cut.select("doc_id", "text_hash", F.size("w").alias("n"), F.posexplode_outer("hs").alias("place", "h"))
        some = laid.join(set_, "h").select("doc_id", "text_hash", "win", "width", "items", at)
        per_doc = some.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.collect_set(F.struct("at", "win", "width", "items")).alias("c"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
        back = _key(docs).join(per_doc, same).select("doc_id", "text_hash", "w", F.explode_outer("c").alias("c")).select("doc_id", "text_hash", "w", "c.*")
        found = back.where(F.slice("w", F.col("at") + 1, F.col("width")) == F.col("win"))
    return found.select("doc_id", "text_hash", "at", "width", "items")


def spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n_hit, item_ids, and marks (sorted structs start, width) of every hit document."""
    found = hits(docs, benchmark_windows(benchmark, width), width)
    marks = F.sort_array(F.collect_set(F.struct(F.col("at").alias("start"), "width")))
    per_doc = found.groupBy("doc_id", "text_hash").agg(marks.alias("marks"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    # Words covered: each mark adds what lies beyond the furthest end before it.
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a: Column, m: Column) -> Column:
        end = m["start"] + m["width"]
        more = F.greatest(end - F.greatest(a["end"], m["start"]), F.lit(0))
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + more).alias("n"))

    return per_doc.withColumn("n_hit", F.aggregate("marks", zero, step)["n"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = written(spans(docs, benchmark, width), "contaminated").select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "n_hit", "item_ids"
    )
    base = _key(docs).select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_hit: int = 1) -> DataFrame:
    """The rows of ``docs`` with fewer than ``min_hit`` hit words, all columns as they were."""
    d, t = (fresh(docs.columns, x) for x in ("d", "t"))
    bad = written(spans(docs, benchmark, width).where(F.col("n_hit") >= min_hit).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)), "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t))
    return docs.join(bad, same, "left_anti")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with hit words cut out of ``text``, and what stands between them.

    A text is taken as words and the breaks before them; a hit word goes with its break.
    """
    d, t, m = (fresh(docs.columns, x) for x in ("d", "t", "m"))
    found = written(spans(docs, benchmark, width).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), F.col("marks").alias(m)), "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t))
    tokens = F.regexp_extract_all(F.col("text"), F.lit(r"([\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    covered = F.array_distinct(F.flatten(F.transform(m, lambda x: F.sequence(x["start"], x["start"] + x["width"] - 1))))

    def kept(k: Column) -> Column:
        # The difference of positions is hash-based, so long texts stay linear.
        left = F.array_except(F.sequence(F.lit(0), F.size(k) - 1), covered)
        return F.array_join(F.transform(left, lambda i: F.get(k, i)), "")

    cut = F.get(F.transform(F.array(tokens), kept), F.lit(0))  # the tokens are made once
    joined = docs.join(found, same, "left")
    return joined.withColumn("text", F.when(F.col(m).isNotNull(), cut).otherwise(F.col("text"))).select(*quoted(docs.columns))
