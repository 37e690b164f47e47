"""Operator 13: phrases whose words stand together more often than their parts would suggest.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``.
The 1..max_n-grams of every piece become rows ``lang, phrase, n``, added up by a hash aggregation per language. Runs of
texts are cut together in arrays, and what a run holds twice is added up before it leaves the task. Shorter
phrases come first: a phrase can only be a candidate if both of its parts of one word less are, so the frequent phrases of a
length are marked in a bitmap of ``FILTER_BITS`` bits, and the next length lays out the n-grams whose two parts are both marked.
A wrong mark costs a row that the count drops again; none is missing. All counts are of phrases, not of hashes.

Candidates are cut after each of their words, the counts of both sides are joined, scores are whole quotients of
decimals, phrases that a one-word extension nearly always continues are anti-joined, and the rest is ranked: in
parts of a language first, so that a language of most rows is never sorted in one task. A longer extension with
the wanted share holds one of one word more, whose count is no smaller, so one-word extensions are enough.

Nulls: a null text is empty, a null lang is ``und``. Texts without words give nothing. Repeated rows count each time.
Equal scores and counts are told apart by the phrase, whose bytes are compared. An empty table gives none. Further columns are not read. A
task holds runs of ``BATCH_BYTES``, or one text where that is longer: about twenty times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.storage import small_batches, written
from textquarry.llm.token_counts import runs
from textquarry.llm.workers import lean

#: Bytes of text cut at once.
BATCH_BYTES = 4_000_000
#: Bits of the bitmap of frequent phrases, a power of two: its size however large the corpus is.
FILTER_BITS = 1 << 25
#: Parts of a language that are ranked by themselves.
RANK_PARTS = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\n\v\f\r")] = _BREAK
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts: ``names`` (distinct), the ``codes`` of all in order, and the ``piece`` each stands in."""

    def __init__(self, texts: pa.Array):
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        size = int(ends[-1]) if len(ends) else 0
        first = np.unique(np.concatenate([[0], ends]))
        first = first[first < size]
        joined = b"".join(x for x in texts.cast(pa.binary()).to_pylist() if x)
        data = _LOWER[np.frombuffer(joined, np.uint8)]
        kind = _KIND[data]
        inside = kind == 0
        before = np.zeros(size + 1, bool)
        before[1:] = inside
        before[first] = False  # a word never goes on into the next text
        opens = np.flatnonzero(inside & ~before[:size])
        mark = kind == _BREAK
        mark[first] = True
        self.piece = np.cumsum(mark, dtype=np.int32)[opens]
        # Letters of all words in a row: those from one opening to the next.
        held = np.cumsum(inside, dtype=np.int32)
        bounds = np.append(held[opens] - 1, held[-1:] if size else [0]).astype(np.int32)
        letters = data[inside]
        words = pa.Array.from_buffers(pa.string(), len(opens), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.names, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.hashes = pd.util.hash_array(np.array(self.names.view(pa.binary()).to_pylist() or [b""], object), categorize=False)

    def part_hashes(self, size: int) -> np.ndarray:
        """A hash for each run of ``size`` words; runs over the end of a piece have one that nobody asks for."""
        n = max(0, len(self.codes) - size + 1)
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total = (total ^ self.hashes[self.codes[j : j + n]]) * _ODD
            total ^= total >> np.uint64(29)
        return total

    def counts(self, size: int, marked: np.ndarray | None, lang: str) -> tuple[pa.Array, np.ndarray]:
        """Phrases of ``size`` words and how often they stand here; for two words and more those with marked parts."""
        if size == 1:
            return self.names, np.bincount(self.codes, minlength=len(self.names))
        n = len(self.codes) - size + 1
        if n <= 0:
            return pa.array([], pa.string()), np.empty(0, np.int64)
        live = _is_marked(self.part_hashes(size - 1), marked, lang)
        at = np.flatnonzero((self.piece[:n] == self.piece[size - 1 :]) & live[:-1] & live[1:])
        key = self.codes[at].astype(np.int64)
        for j in range(1, size):
            if j > 1:  # numbers of the phrases so far, so that products stay within 64 bits
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.names) + self.codes[at + j]
        if size == 2:
            found, counts = np.unique(key, return_counts=True)
            parts = [found // len(self.names), found % len(self.names)]
        else:
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            parts = [self.codes[at[first] + j] for j in range(size)]
        return pc.binary_join_element_wise(*[self.names.take(pa.array(p)) for p in parts], " "), counts


def _places(hashes: np.ndarray, lang: str, n_bits: int) -> np.ndarray:
    salt = pd.util.hash_array(np.array([lang], object), categorize=False)[0]
    return ((hashes ^ salt) * _ODD >> np.uint64(64 - n_bits.bit_length() + 1)).astype(np.int64)


def _is_marked(hashes: np.ndarray, marked: np.ndarray, lang: str) -> np.ndarray:
    at = _places(hashes, lang, 64 * len(marked))
    return (marked[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _by_lang(stream: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language each, in runs of bounded size."""
    for batch in stream:
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).take(pa.array(np.flatnonzero(codes == k)))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in runs(sizes, limit):
                yield lang, texts.slice(a, b - a)


def _rows(spark: SparkSession, texts: DataFrame, size: int, marked: np.ndarray | None) -> DataFrame:
    """lang, phrase, n of all phrases of ``size`` words, added up in each run; for single words also the number of all, under an empty phrase."""
    shared, limit = None if marked is None else spark.sparkContext.broadcast(marked), BATCH_BYTES

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        for lang, part in _by_lang(stream, limit):
            words = Words(part)
            phrases, n = words.counts(size, bits, lang)
            if size == 1:
                phrases, n = pa.concat_arrays([phrases, pa.array([""])]), np.append(n, len(words.codes))
            for at in range(0, len(n), 50_000):
                some, own = phrases.slice(at, 50_000), n[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), "phrase": some, "n": pa.array(own, pa.int64())})

    return texts.mapInArrow(lean("phrases", task), "lang string, phrase string, n long")


def _marks(frequent: DataFrame, size: int, n_bits: int) -> np.ndarray:
    """The bitmap of the frequent phrases of ``size`` words: n_bits / 64 numbers, whatever the corpus holds."""
    limit = BATCH_BYTES

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, phrases in _by_lang(stream, limit):
            at = np.unique(_places(Words(phrases).part_hashes(size)[::size], lang, n_bits))
            bits = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(at >> 6, pa.int64()), "bits": pa.array(bits, pa.int64())})

    rows = frequent.select("lang", "phrase").mapInArrow(lean("phrases", task), "slot long, bits long")
    found = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    marked = np.zeros(n_bits // 64, np.uint64)
    marked[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return marked


def phrase_counts(docs: DataFrame, max_n: int = 4, min_count: int = 30, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, a) of all phrases of 1 to ``max_n`` words found ``min_count`` times or more; (lang, n): words of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    levels, totals, marked = [], None, None
    for size in range(1, max_n + 1):
        with small_batches(spark):
            rows = _rows(spark, texts, size, marked).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
            held = written(rows.where((F.col("a") >= min_count) | (F.col("phrase") == "")), f"phrases-{size}")
            if size == 1:
                totals = held.where(F.col("phrase") == "").select("lang", F.col("a").alias("n"))
                held = held.where((F.col("phrase") != "") & (F.col("a") >= min_count))
            levels.append(held.select("lang", F.lit(size).alias("n_words"), "phrase", "a"))
            if size < max_n:
                marked = _marks(held, size, filter_bits)
                if not marked.any():
                    break
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every, totals


def scored(counts: DataFrame) -> DataFrame:
    """lang, n_words, phrase, a, l, r, score of all phrases of two words and more: the cut of lowest score, the first of these."""
    w = F.split("phrase", " ")
    k = F.sequence(F.lit(1), F.col("n_words") - 1)
    cuts = F.transform(k, lambda i: F.struct(i.alias("k"), F.array_join(F.slice("w", F.lit(1), i), " ").alias("left"), F.array_join(F.slice("w", i + 1, F.col("n_words")), " ").alias("right")))
    laid = counts.where("n_words > 1").withColumn("w", w).select("lang", "n_words", "phrase", "a", F.explode_outer(cuts).alias("c")).select("lang", "n_words", "phrase", "a", "c.*")
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("b")
    found = laid.join(left, ["lang", "left"]).join(right, ["lang", "right"]).groupBy("lang", "n_words", "phrase", "a").agg(best)
    return found.select("lang", "n_words", "phrase", "a", "b.l", "b.r", "b.score")


def unextended(scores: DataFrame, share: int = 80) -> DataFrame:
    """Without phrases that an extension by one word holds in ``share`` of a hundred of their places or more."""
    w = F.split("phrase", " ")
    parts = F.array(F.array_join(F.slice("w", F.lit(1), F.col("n_words") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("n_words") - 1), " "))
    longer = scores.where("n_words > 2").withColumn("w", w).select("lang", F.explode_outer(parts).alias("phrase"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covers = F.expr(f"CAST(longer AS DECIMAL(19,0)) * CAST(100 AS DECIMAL(3,0)) >= CAST(a AS DECIMAL(19,0)) * CAST({int(share)} AS DECIMAL(3,0))")
    gone = scores.join(most, ["lang", "phrase"]).where(covers).select("lang", "phrase")
    return scores.join(gone, ["lang", "phrase"], "left_anti")


def collocations(docs: DataFrame, max_n: int = 4, min_count: int = 30, share: int = 80, top: int = 2000, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language, by score, count and phrase."""
    counts, totals = phrase_counts(docs, max_n, min_count, filter_bits)
    left = unextended(written(scored(counts), "phrase-scores"), share)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = left.withColumn("own", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("own") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
