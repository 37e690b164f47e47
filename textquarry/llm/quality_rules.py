"""Operator 3: quality rules with adaptive thresholds, in built-in functions only.

Each text gives counts (words, word characters, symbols, repeated lines, words in repeated three-word
windows). Four ratios of them feed KLL quantile sketches per language and source; the sketches are mergeable,
so those of a language and of the whole corpus come from merging, without another look at the rows. A
group's fence lies ``REACH`` interquartile ranges beyond its quartiles; a group with few rows takes
the fence of its language, and a language with few rows that of the corpus. Fences are joined to the rows,
and a row is kept if it passes the base rules and no ratio lies beyond its fence.

Sketches are built from rows that pass the base rules. Null and empty texts have no words: they fail
the base rules. Null languages and sources form groups of their own. Repeated rows are judged alike.
An empty table gives none. The sketch's answer is approximate (rank error about 1.3 %); fences are
wide against that. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.storage import written

SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Interquartile ranges between a quartile and its fence.
REACH = 4.0
#: Rows from which a group has a fence of its own.
MIN_ROWS = 100
#: ratio -> (whether low values are odd too, least interquartile range taken)
RATIOS = {"mean_word": (True, 0.5), "symbol_rate": (False, 0.02), "repeat_rate": (False, 0.05), "line_repeat_rate": (False, 0.1)}


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def _repeat_words(words: Column) -> Column:
    """Positions inside three-word windows that occur twice or more, in n log n of the text's words.

    Windows are compared by 64-bit hash. Sorting (hash, position) puts equal windows side by side.
    """

    def covered(at: Column) -> Column:
        # Each repeated window adds the words that the next repeated window doesn't hold.
        return _sum(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))))

    def repeated(rows: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(rows, j)["h"] == x["h"], F.lit(False))
        twins = F.filter(rows, lambda x, j: same(x, j + 1) | same(x, j - 1))
        return _let(F.sort_array(F.transform(twins, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)
        ))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(words, windows))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))).alias("lines"),
    )
    return cut.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("lines.n").cast("long").alias("n_lines"),
        F.col("lines.again").cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def rates(rows: DataFrame) -> DataFrame:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumns(
        {
            "base_failed": failed,
            "mean_word": per_word("word_chars"),
            "symbol_rate": per_word("n_symbols"),
            "repeat_rate": per_word("n_repeat_words"),
            "line_repeat_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        }
    )


def fences(rows: DataFrame) -> DataFrame:
    """lang, source, and <ratio>_low and <ratio>_high for every group in the rows."""
    sketch = {r: F.kll_sketch_agg_double(F.when(~F.col("base_failed"), F.col(r))).alias(r) for r in RATIOS}
    n = F.sum((~F.col("base_failed")).cast("long")).alias("n")
    groups = written(rows.groupBy("lang", "source").agg(n, *sketch.values()), "sketches")
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(r).alias(r) for r in RATIOS)]
    languages, corpus = groups.groupBy("lang").agg(*merged), groups.agg(*merged)

    def bounds(level: DataFrame) -> list[Column]:
        out = []
        for r, (low_too, least) in RATIOS.items():
            q1, q3 = (F.kll_sketch_get_quantile_double(r, F.lit(q)) for q in (0.25, 0.75))
            reach = REACH * F.greatest(q3 - q1, F.lit(least))
            some = F.col("n") > 0
            out.append(F.when(some, (q1 - reach) if low_too else F.lit(-1.0)).alias(f"{r}_low"))
            out.append(F.when(some, q3 + reach).alias(f"{r}_high"))
        return out

    names = [f"{r}_{side}" for r in RATIOS for side in ("low", "high")]
    own = groups.select("lang", "source", "n", F.struct(*bounds(groups)).alias("own"))
    per_lang = languages.select(F.col("lang").alias("l"), F.col("n").alias("ln"), F.struct(*bounds(languages)).alias("ofl"))
    whole = corpus.select(F.struct(*bounds(corpus)).alias("ofc"))  # one row
    chosen = (
        F.when(F.col("n") >= MIN_ROWS, F.col("own")).when(F.col("ln") >= MIN_ROWS, F.col("ofl")).otherwise(F.col("ofc"))
    )
    # The corpus level is a single row, so this is no product.
    joined = own.join(per_lang, F.col("lang").eqNullSafe(F.col("l"))).join(F.broadcast(whole))
    return joined.select("lang", "source", chosen.alias("f")).select("lang", "source", *[F.col(f"f.{x}").alias(x) for x in names])


def judge(docs: DataFrame) -> DataFrame:
    """Every row with its counts, ratios, fences, base_failed and kept."""
    rows = rates(written(counts(docs), "quality-counts"))
    limits = fences(rows).withColumnRenamed("lang", "lang_").withColumnRenamed("source", "source_")
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    inside = F.lit(True)
    for r in RATIOS:
        inside &= F.coalesce(F.col(r).between(F.col(f"{r}_low"), F.col(f"{r}_high")), F.lit(True))
    # One row a group on the right; where groups are many, the hot one is split by adaptive skew handling.
    return rows.join(limits, same, "left").withColumn("kept", ~F.col("base_failed") & inside).drop("lang_", "source_")
