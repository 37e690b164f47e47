"""Postings by document: phrases, boolean expressions, ranked search and facets, from the index alone.

A segment of the layout ``Documents`` holds, sorted so that tests of a word and of a range of documents reach the scan:

- ``positions``: field, word, doc_id, key, n, at (places of the word, from 0), length (of the field); a hot word's rows lie in many files,
- ``blocks``: field, word, block (2^BLOCK_BITS doc_ids), n_docs, max_n, min_len: what bounds any score in the block,
- ``lengths``: field, doc_id, key, n_words, and the corpus's attributes; a row for each document, with words or not,
- ``summary``: field, n_docs, n_words.

Versions, appends, deletes and compaction are those of ``store``: delete vectors are anti-joined where rows are read. A
row is known by doc_id and ``key``, a hash of its fields' texts: rows that repeat are one document, other texts under one id don't mix, and are found
under the same id. Rows without doc_id cannot be named in a result and are left out. Words are lower-cased; ``store``'s size limit for words holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.enums import Scope
from textquarry.functions import tokenize
from textquarry.plans import store
from textquarry.plans.store import Version

#: Documents of a block have the same doc_id but for so many low bits.
BLOCK_BITS = 8
ID = ["doc_id", "key"]
#: Documents of a part have the same doc_id but for so many low bits; the rows of a word and a part lie in one file.
PART_BITS = 16
#: Words that are put together at once, about.
STEP = 1 << 20
_POSITIONS = "field string, word string, doc_id long, key long, n int, at array<int>, length long"


def _place(root: str, name: str, what: str) -> str:
    return f"{root}/segments/{name}/type={what}"


class Documents:
    """What a segment holds of a corpus with ``doc_id``, text columns ``fields`` and columns to count by, ``attributes``."""

    def __init__(self, fields: tuple[str, ...] = ("text",), attributes: tuple[str, ...] = ()):
        self.fields, self.attributes = tuple(fields), tuple(attributes)

    def write(self, corpus: DataFrame, root: str, name: str) -> None:
        texts = [F.col(f"`{f}`").cast("string") for f in self.fields]
        attributes = [F.col(f"`{a}`") for a in self.attributes]
        each = F.array(*[F.struct(F.lit(f).alias("field"), tokenize.words(F.lower(t)).alias("w")) for f, t in zip(self.fields, texts, strict=True)])
        rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*texts).alias("key"), *attributes, F.explode_outer(each).alias("f"))
        rows = rows.where(F.col("doc_id").isNotNull()).select(*ID, *attributes, "f.field", "f.w")
        self._lay(rows.mapInArrow(_places, _POSITIONS), root, name)
        n_words = F.coalesce(F.size("w"), F.lit(0)).cast("long")
        lengths = rows.select("field", *ID, F.greatest(n_words, F.lit(0).cast("long")).alias("n_words"), *attributes).dropDuplicates(["field", *ID])
        self._finish(corpus.sparkSession, root, name, lengths)

    def _lay(self, rows: DataFrame, root: str, name: str) -> None:
        """Rows of documents that repeat become one where they are sorted."""
        by = ["word", "field", "part", *ID]
        dealt = rows.withColumn("part", F.shiftright("doc_id", PART_BITS)).repartition("word", "field", "part")
        held = dealt.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("n", "at", "length")]).sortWithinPartitions(*by)
        store._put(held.select("field", "word", *ID, "n", "at", "length"), _place(root, name, "positions"))

    def rewrite(self, spark: SparkSession, root: str, held: Version, to: str, name: str) -> None:
        self._lay(alive(spark, root, held, "positions"), to, name)
        self._finish(spark, to, name, alive(spark, root, held, "lengths"))

    def _finish(self, spark: SparkSession, root: str, name: str, lengths: DataFrame) -> None:
        store._put(lengths.sortWithinPartitions("field", "doc_id"), _place(root, name, "lengths"))
        held = spark.read.parquet(_place(root, name, "lengths"))
        held.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words")).coalesce(1).write.parquet(_place(root, name, "summary"))
        rows = spark.read.parquet(_place(root, name, "positions"))
        blocks = rows.groupBy("field", "word", F.shiftright("doc_id", BLOCK_BITS).alias("block")).agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("n").alias("max_n"), F.min("length").alias("min_len")
        )
        store._put(blocks.sortWithinPartitions("word", "field", "block"), _place(root, name, "blocks"))

    def retract(self, root: str, held: Version, gone: DataFrame, low: int, high: int, name: str) -> bool:
        return False  # the vector is enough


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each field, document and word of it, with the word's places in order."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(STEP, ends[-1] if len(ends) else 0, STEP)) + 1, [len(sizes)]]))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            yield from _some_places(batch.slice(low, high - low), sizes[low:high])


def _some_places(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = batch.column("w").flatten()
    fits = pc.less_equal(pc.binary_length(words), Scope.WORD.max_bytes).to_numpy(zero_copy_only=False).astype(bool)
    row = np.repeat(np.arange(len(sizes)), sizes)[fits]
    at = (np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[fits]
    if not len(row):
        return
    coded = words.filter(pa.array(fits)).dictionary_encode()
    whole = row * len(coded.dictionary) + coded.indices.to_numpy()
    order = np.argsort(whole, kind="stable")  # places stay in order
    first = np.flatnonzero(np.diff(whole[order], prepend=-1))
    bounds = np.append(first, len(order))
    take = order[first]
    of_row, word = pa.array(row[take]), coded.dictionary.take(coded.indices.take(pa.array(take)))
    columns = [batch.column(c).take(of_row) for c in ("field", *ID)]
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(at[order].astype(np.int32)))
    n, length = np.diff(bounds).astype(np.int32), sizes[row[take]].astype(np.int64)
    yield pa.RecordBatch.from_arrays([columns[0], word, *columns[1:], pa.array(n), lists, pa.array(length)], names=["field", "word", *ID, "n", "at", "length"])


def alive(spark: SparkSession, root: str, held: Version, what: str) -> DataFrame:
    return store.alive(spark, root, held, lambda name: _place(root, name, what))


class Index:
    """A version of such an index."""

    def __init__(self, spark: SparkSession, root: str, number: int | None = None):
        self.spark, self.root, self.version = spark, root, store.version(spark, root, number)
        if not self.version.segments:
            raise FileNotFoundError(f"no index in {root}")

    def rows(self, what: str) -> DataFrame:
        return alive(self.spark, self.root, self.version, what)

    def postings(self, word: str, field: str = "text") -> DataFrame:
        """doc_id, key, n, at of the documents that hold a word."""
        return self.rows("positions").where((F.col("field") == field) & (F.col("word") == word.lower())).select(*ID, "n", "at")

    def bounds(self, words: list[str], field: str) -> DataFrame:
        """word, block, n_docs, max_n, min_len of all segments; deleted documents still count, so these are bounds."""
        paths = [_place(self.root, s.name, "blocks") for s in self.version.segments]
        return self.spark.read.parquet(*paths).where((F.col("field") == field) & F.col("word").isin([w.lower() for w in words]))

    def estimates(self, words: list[str], field: str = "text") -> dict[str, int]:
        """Documents that hold each word, deleted ones too: what orders joins."""
        found = {r.word: r.n for r in self.bounds(words, field).groupBy("word").agg(F.sum("n_docs").alias("n")).collect()}  # a row a word
        return {w.lower(): found.get(w.lower(), 0) for w in words}

    def _deleted(self, what: str):
        """Rows of deleted documents in the segments, for each set of delete vectors."""
        for vectors, names in store.by_vectors(self.version).items():
            if vectors:
                rows = self.spark.read.parquet(*[_place(self.root, n, what) for n in names])
                yield store.within(self.spark, self.root, rows, vectors)

    def frequencies(self, words: list[str], field: str = "text") -> dict[str, int]:
        """Documents that hold each word: sums of blocks, less what delete vectors took."""
        found = self.estimates(words, field)
        for gone in self._deleted("positions"):
            for r in gone.where((F.col("field") == field) & F.col("word").isin(list(found))).groupBy("word").count().collect():
                found[r["word"]] -= r["count"]
        return found

    def size(self, field: str) -> tuple[int, int]:
        """Documents and words of a field: sums of the segments, less what delete vectors took."""
        paths = [_place(self.root, n, "summary") for names in store.by_vectors(self.version).values() for n in names]
        total = F.sum("n_docs").alias("n"), F.sum("n_words").alias("m")
        n, m = self.spark.read.parquet(*paths).where(F.col("field") == field).agg(*total).first()
        n, m = n or 0, m or 0
        for gone in self._deleted("lengths"):
            lost = gone.where(F.col("field") == field).agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("m")).first()
            n, m = n - lost.n, m - (lost.m or 0)
        return n, m


def _shifted(at: Column, by: int) -> Column:
    return F.transform(at, lambda x: x - by)


def phrase_hits(index: Index, words: list[str], field: str = "text") -> DataFrame:
    """doc_id, key, starts (places of the first word) of the documents that hold the words in a row.

    The rarest word's postings come first; each further word's are joined by document, and its places, shifted to the
    phrase's start, intersected with what is left.
    """
    if not words:
        raise ValueError("a phrase has words")
    known = index.estimates(words, field)
    order = sorted(range(len(words)), key=lambda i: (known[words[i].lower()], i))
    hits = index.postings(words[order[0]], field).select(*ID, _shifted(F.col("at"), order[0]).alias("starts"))
    for i in order[1:]:
        more = index.postings(words[i], field).select(*ID, _shifted(F.col("at"), i).alias("more"))
        hits = hits.join(more, ID).select(*ID, F.array_intersect("starts", "more").alias("starts")).where(F.size("starts") > 0)
    return hits


def phrase_search(index: Index, words: list[str], field: str = "text") -> DataFrame:
    """doc_id, n_hits, first (place of the first hit, in words from 0)."""
    hits = phrase_hits(index, words, field)
    return hits.groupBy("doc_id").agg(F.sum(F.size("starts")).alias("n_hits"), F.min(F.array_min("starts")).cast("long").alias("first"))


@dataclass(frozen=True)
class Word:
    word: str
    field: str = "text"


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    field: str = "text"


class _Parts:
    def __init__(self, *parts):
        if not parts:
            raise ValueError("an expression has parts")
        self.parts = parts


class And(_Parts):
    pass


class Or(_Parts):
    pass


@dataclass(frozen=True)
class Not:
    part: object


def _estimate(e, known: dict) -> int:
    """Documents that an expression has at most."""
    if isinstance(e, Word):
        return known[e]
    if isinstance(e, Phrase):
        return min(known[Word(w, e.field)] for w in e.words)
    if isinstance(e, And):
        return min([_estimate(p, known) for p in e.parts if not isinstance(p, Not)], default=2**62)
    return sum(_estimate(p, known) for p in e.parts) if isinstance(e, Or) else 2**62


def _words(e) -> set[Word]:
    if isinstance(e, Word):
        return {e}
    if isinstance(e, Phrase):
        return {Word(w, e.field) for w in e.words}
    return set().union(*[_words(p) for p in ([e.part] if isinstance(e, Not) else e.parts)])


def matching(index: Index, expression) -> DataFrame:
    """doc_id, key of the documents that an expression of Word, Phrase, And, Or and Not describes.

    And starts with the part of fewest documents, semi-joins the other parts and anti-joins what is negated; Or is a union. Only an
    expression that is negative as a whole reads the list of all documents.
    """
    known = {}
    for field in {w.field for w in _words(expression)}:
        own = [w for w in _words(expression) if w.field == field]
        found = index.estimates([w.word for w in own], field)
        known |= {w: found[w.word.lower()] for w in own}

    def plan(e) -> DataFrame:
        if isinstance(e, Word):
            return index.postings(e.word, e.field).select(*ID)
        if isinstance(e, Phrase):
            return phrase_hits(index, list(e.words), e.field).select(*ID)
        if isinstance(e, Or):
            rows = plan(e.parts[0])
            for p in e.parts[1:]:
                rows = rows.unionByName(plan(p))
            return rows.distinct()
        if isinstance(e, Not):
            return everything().join(plan(e.part), ID, "left_anti")
        wanted = sorted((p for p in e.parts if not isinstance(p, Not)), key=lambda p: _estimate(p, known))
        rows = plan(wanted[0]) if wanted else everything()
        for p in wanted[1:]:
            rows = rows.join(plan(p), ID, "left_semi")
        for p in e.parts:
            if isinstance(p, Not):
                rows = rows.join(plan(p.part), ID, "left_anti")
        return rows

    def everything() -> DataFrame:
        return index.rows("lengths").select(*ID).distinct()

    return plan(expression)


def boolean_search(index: Index, expression) -> DataFrame:
    """doc_id of the documents that match."""
    return matching(index, expression).select("doc_id").distinct()


def facets(index: Index, expression, attributes: list[str], cube: bool = False) -> DataFrame:
    """The attributes, grouping (bits of those that are summed over) and n_docs of the matches: a rollup, or a cube."""
    about = index.rows("lengths").select(*ID, *attributes).dropDuplicates(ID)
    found = matching(index, expression).join(about, ID)
    grouped = found.cube(*attributes) if cube else found.rollup(*attributes)
    return grouped.agg(F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("n_docs"))


def _gain(n: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    """BM25's saturation: rises with n, falls with length."""
    return n * (k1 + 1) / (n + k1 * ((1 - b) + b * length / mean))


def block_scores(index: Index, words: list[str], fields: dict[str, float], k1: float = 1.2, b: float = 0.75):
    """block, most (what a document there can score, at most); and a function that scores the documents of chosen blocks."""
    words = sorted({w.lower() for w in words})
    sums, spec = None, []  # spec: field, mean length, weight of each word
    for field, weight in fields.items():
        n, total = index.size(field)
        idf = {w: weight * log(1 + (n - df + 0.5) / (df + 0.5)) for w, df in index.frequencies(words, field).items() if df > 0}
        if not idf:
            continue
        mean = max(total / n, 1e-9)
        spec.append((field, mean, idf))
        some = index.bounds(list(idf), field).groupBy("word", "block").agg(F.max("max_n").alias("max_n"), F.min("min_len").alias("min_len"))
        rows = some.select("block", (_weight(idf) * _gain(F.col("max_n"), F.col("min_len"), mean, k1, b)).alias("most"))
        sums = rows if sums is None else sums.unionByName(rows)
    if sums is None:
        return None, None

    def scored(chosen: DataFrame) -> DataFrame:
        rows = None
        for field, mean, idf in spec:
            hits = index.rows("positions").where((F.col("field") == field) & F.col("word").isin(list(idf)))
            hits = hits.withColumn("block", F.shiftright("doc_id", BLOCK_BITS)).join(chosen, "block", "left_semi")
            own = hits.select(*ID, (_weight(idf) * _gain(F.col("n"), F.col("length"), mean, k1, b)).alias("score"))
            rows = own if rows is None else rows.unionByName(own)
        one = rows.groupBy(*ID).agg(F.sum("score").alias("score")).groupBy("doc_id").agg(F.max("score").alias("score"))
        return one.select("doc_id", F.round("score", 6).alias("score"))

    return sums.groupBy("block").agg(F.sum("most").alias("most")), scored


def reachable_blocks(blocks: DataFrame, scored, k: int) -> DataFrame:
    """The blocks that can hold one of the best k: those of highest bounds are scored first, and the k-th score there is the bar."""
    first = blocks.orderBy(F.col("most").desc(), "block").limit(k).select("block")  # k blocks hold k documents, unless some were deleted
    bar = scored(first).orderBy(F.col("score").desc()).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).first()
    return blocks.where(F.col("most") >= (bar.score if bar.n >= k else 0.0) - 1e-6).select("block")


def bm25_search(index: Index, words: list[str], fields: dict[str, float], k: int = 100, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score (to six places) of the best k documents; ``fields``: the weight of each.

    Blocks come first: only those whose bound reaches the k-th score found so far have their postings read.
    """
    blocks, scored = block_scores(index, words, fields, k1, b)
    if blocks is None:
        return index.spark.createDataFrame([], "doc_id long, score double")
    return scored(reachable_blocks(blocks, scored, k)).orderBy(F.col("score").desc(), "doc_id").limit(k)


def _weight(idf: dict[str, float]) -> Column:
    """The weight of column ``word``."""
    return F.element_at(F.create_map(*[x for w, v in idf.items() for x in (F.lit(w), F.lit(v))]), F.col("word"))
