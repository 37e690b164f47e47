"""The persisted indexes: six Parquet datasets, sorted so that scans can skip row groups.

``build_all`` and what follows it keep versions (see ``store``); ``build_index`` writes a single one to
``<root>/scope=<word|line>/type=<trie|suffix|ngram>/``. Every dataset holds distinct tokens with
their multiplicity; lines also hold their words. ``trie`` is sorted by token, ``suffix`` by the reversed
token, ``ngram`` by token; ``postings`` (optional) maps each interior bigram to the tokens that hold it.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.enums import Scope, SearchType
from textquarry.operators.search import TOP_K, predicate, rank
from textquarry.operators.tokens import bigrams, counted, item_bigrams, tokens, with_line_words
from textquarry.plans import store

log = logging.getLogger(__name__)


def index_path(root: str, scope: Scope, kind: SearchType) -> str:
    return f"{root}/scope={scope.value}/type={kind.index_name}"


def _items(corpus: DataFrame, scope: Scope, any_script: bool) -> DataFrame:
    items = counted(tokens(corpus, scope, any_script))
    return with_line_words(items, any_script) if scope is Scope.LINE else items


def build_index(corpus: DataFrame, scope: Scope, kind: SearchType, root: str, any_script: bool = False) -> None:
    """One index, without versions; replaces what stands at its place."""
    scope, kind = Scope(scope), SearchType(kind)
    store._clustered(_items(corpus, scope, any_script), kind).write.mode("overwrite").parquet(index_path(root, scope, kind))


def load_one(spark: SparkSession, root: str, scope: Scope, kind: SearchType) -> dict[tuple[Scope, SearchType], DataFrame]:
    """What ``build_index`` wrote, for ``search``; all other searches of it have no match."""
    scope, kind = Scope(scope), SearchType(kind)
    return {(scope, kind): spark.read.parquet(index_path(root, scope, kind))}


def build_all(corpus: DataFrame, root: str, any_script: bool = False) -> float:
    """All six, as a version of their own; each scope is tokenised and counted once. Returns the seconds it took."""
    began = time.monotonic()
    store.build(corpus, root, store.Items(any_script))
    took = time.monotonic() - began
    log.info("built %d indexes in %.3f s", len(store.ALL), took)
    return took


#: Tokens or ids in a row of a gram's postings, about.
POSTINGS_ROW = 10_000


def build_postings(corpus: DataFrame, scope: Scope, root: str, any_script: bool = False) -> None:
    """gram -> words, or gram -> ids of lines and id -> line. Pays off only for terms that hit few grams.

    A word is about as long as an id, so it stands in its postings itself, and a lookup reads nothing else; a line stands once, with the items.
    A gram's list grows with the number of distinct tokens that hold it, so lists are cut into as many
    blocks (by a hash) as that number asks for; a gram may have several rows. Only grams of more than one block, a few, are
    joined with their number. Rows are sorted in the partitions that grouping dealt them to.
    """
    base, whole = f"{root}/scope={scope.value}", scope is Scope.WORD
    items = tokens(corpus, scope, any_script).distinct().withColumn("id", F.xxhash64("token"))
    store._put(items.sortWithinPartitions("id"), f"{base}/type=items")
    stored = items.sparkSession.read.parquet(f"{base}/type=items")
    grams = bigrams(stored, scope, any_script).withColumn("id", F.xxhash64("token"))
    grams = grams.select("gram", "id", *["token"] * whole)
    blocks = grams.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / POSTINGS_ROW).alias("blocks")).where("blocks > 1")
    held = F.sort_array(F.collect_set("token" if whole else "id")).alias("tokens" if whole else "ids")
    dealt = grams.join(F.broadcast(blocks), "gram", "left").withColumn("block", F.coalesce(F.pmod("id", F.col("blocks")), F.lit(0)))
    store._put(dealt.groupBy("gram", "block").agg(held).sortWithinPartitions("gram", "block"), f"{base}/type=postings")


def lookup_postings(spark: SparkSession, root: str, scope: Scope, gram: list[str], any_script: bool = False) -> DataFrame:
    """Tokens that hold the interior bigram. Ids without an item are ignored, and so is an item that only has another's id."""
    base, wanted = f"{root}/scope={scope.value}", F.array(*map(F.lit, gram))
    rows = spark.read.parquet(f"{base}/type=postings").where(F.col("gram") == wanted)
    if scope is Scope.WORD:
        return rows.select(F.explode("tokens").alias("token")).distinct()
    found = rows.select(F.explode("ids").alias("id")).join(spark.read.parquet(f"{base}/type=items"), "id").select("token")
    return found.where(F.array_contains(item_bigrams(scope, any_script), wanted)).distinct()


def search_postings(spark: SparkSession, root: str, scope: Scope, term: str, k: int = TOP_K, any_script: bool = False) -> DataFrame:
    """A contains search by one probe of the postings: two plain characters for words, two words for lines."""
    gram = [term] if scope is Scope.WORD else term.split()
    if scope is Scope.WORD and (len(term) != 2 or not term.isascii()) or scope is Scope.LINE and len(gram) != 2:
        raise ValueError("the term is no bigram")
    found = lookup_postings(spark, root, scope, gram, any_script)
    test = predicate(scope, SearchType.CONTAINS, term, any_script=any_script, stored=False)
    return rank(found.where(test).withColumn("freq", F.lit(1).cast("long")), term, k)


def load_index(spark: SparkSession, root: str, version: int | None = None, strict: bool = True) -> dict[tuple[Scope, SearchType], DataFrame]:
    """All six or an error. Reads footers only; data is read by queries.

    ``version``: an older state of the index. ``strict=False``: an index that is lost has no match, instead of failing all.
    """
    began = time.monotonic()
    if strict and not store.versions(spark, root):
        raise FileNotFoundError(f"no index in {root}")
    found = store.load(spark, root, version, strict)
    log.info("loaded %d indexes in %.3f s", len(found), time.monotonic() - began)
    return found


def append_index(corpus: DataFrame, root: str, any_script: bool = False, source: str | None = None, batch: int | None = None) -> None:
    """Adds the items of new texts without rewriting what is there; ``compact`` merges the batches.

    With ``source`` and ``batch`` a repeated append adds nothing.
    """
    store.append(corpus, root, store.Items(any_script), source, batch)


def compact(spark: SparkSession, root: str, target: str | None = None, any_script: bool = False) -> None:
    """Merges what is alive into one segment: the next version, or an index at another root."""
    store.compact(spark, root, target, store.Items(any_script))
